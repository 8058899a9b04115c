"""Queries of the engine's own operators over the test tables, each over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import columns as fn
from ledgerloom.functions import html, sections
from ledgerloom.operators import catalog, chunking, evaluation, quantiles, routing
from ledgerloom.operators import search as s
from ledgerloom.session import spread, table
from ledgerloom.streaming import streams

STRATEGY, PARAMS = "recursive", "bb4c04092d51ba94"
DIM = 64


def questions(spark: SparkSession, folder: str) -> DataFrame:
    items = table(spark, folder, "eval_items")
    return items.select(F.col("item_id").alias("question_id"), F.col("text").alias("query"), fn.nibbles(F.col("text"), DIM).alias("vector"))


def corpus(spark: SparkSession, folder: str) -> DataFrame:
    return s.corpus(table(spark, folder, "chunks"), table(spark, folder, "embeddings_v1"), table(spark, folder, "documents"), STRATEGY, PARAMS)


def _rounded(hits: DataFrame) -> DataFrame:
    return hits.select(F.col("question_id").alias("item_id"), "chunk_id", "rank", F.round("score", 6).alias("score"))


def _vectors(spark, folder, most):
    return s.vector_hits(corpus(spark, folder).where("embedding is not null"), s.single_legs(questions(spark, folder)), most)


def vector_topk(spark, folder):
    return _rounded(_vectors(spark, folder, 10))


def fts_simple(spark, folder):
    return _rounded(s.simple_text_hits(corpus(spark, folder), questions(spark, folder), 10))


def fts_english(spark, folder):
    return _rounded(s.text_hits(corpus(spark, folder), s.single_legs(questions(spark, folder)), 10))


def rrf_fusion(spark, folder):
    lists = [_vectors(spark, folder, s.POOL), s.simple_text_hits(corpus(spark, folder), questions(spark, folder), s.POOL)]
    return _rounded(s.fuse(lists, 10))


def hybrid_search(spark, folder):
    return _rounded(s.search(corpus(spark, folder), s.single_legs(questions(spark, folder)), 10, "hybrid"))


def _companies(spark, folder, most):
    """The companies with the most chunks of the set, so that legs have something to find."""
    own = corpus(spark, folder).groupBy("company").agg(F.count(F.lit(1)).alias("n"))
    return own.orderBy(F.desc("n"), "company").limit(most)


def _with_companies(spark, folder):
    few = _companies(spark, folder, 3).agg(F.sort_array(F.collect_list("company")).alias("companies"))
    return questions(spark, folder).crossJoin(F.broadcast(few))


def comparison_fanout(spark, folder):
    return _rounded(s.fan_out(corpus(spark, folder), s.company_legs(_with_companies(spark, folder)), 10, "vector"))


def temporal_fanout(spark, folder):
    asked = _with_companies(spark, folder).select("question_id", "query", "vector", F.element_at("companies", 1).alias("company"), F.lit(None).cast("string").alias("form_type"))
    filings = table(spark, folder, "documents").withColumn("company", F.regexp_replace("cik", "[^0-9]", "").cast("bigint").cast("string"))
    return _rounded(s.fan_out(corpus(spark, folder), s.filing_legs(asked, filings), 10, "vector"))


def hash_embed(spark, folder):
    rows = catalog.one_text_each(table(spark, folder, "chunks"))
    return rows.select("content_hash", F.transform(fn.byte_vector(F.col("text")), lambda x: F.round(x, 6)).alias("embedding"))


def content_hash(spark, folder):
    chunks = spread(table(spark, folder, "chunks").select("chunk_id", "text", "content_hash"))
    return chunks.select("chunk_id", fn.content_hash(F.col("text")).alias("computed"), (fn.content_hash(F.col("text")) == F.col("content_hash")).alias("same"))


def dedup_by_hash(spark, folder):
    return catalog.one_text_each(table(spark, folder, "chunks"))


def embed_pending(spark, folder):
    return catalog.pending_embeddings(table(spark, folder, "chunks"), table(spark, folder, "embeddings_v1")).select("content_hash", "chunk_id")


def distinct_hash_count(spark, folder):
    return table(spark, folder, "chunks").groupBy("strategy", "params_hash").agg(F.count_distinct("content_hash").alias("hashes"), F.count(F.lit(1)).alias("chunks"), F.count_distinct("document_id").alias("documents"))


def unchunked_documents(spark, folder):
    return catalog.unchunked(table(spark, folder, "documents"), table(spark, folder, "chunks"), STRATEGY, PARAMS).select("doc_id", "accession_no")


def companies_filings(spark, folder):
    return catalog.company_filings(table(spark, folder, "documents")).select("cik", "nth", "accession_no", "form_type", "filing_date")


def latest_per_form(spark, folder):
    docs = table(spark, folder, "documents").withColumn("form", fn.form_name(F.col("form_type")))
    return s.ranked(docs, ["form"], "filing_date", "doc_id", most=5).select("form", "rank", "doc_id", "filing_date")


def chunk_details(spark, folder):
    return catalog.chunk_details(table(spark, folder, "chunks"), table(spark, folder, "documents"))


def index_versions(spark, folder):
    versions = table(spark, folder, "index_versions")
    return catalog.version_counts(versions, {1: table(spark, folder, "embeddings_v1")}).select("index_version_id", "status", "strategy", "params_hash", "vectors")


def latest_ready_version(spark, folder):
    return catalog.latest_ready(table(spark, folder, "index_versions")).select("index_version_id", "strategy", "params_hash")


def documents_upsert(spark, folder):
    docs = table(spark, folder, "documents")
    columns = ["accession_no", "company", "raw_path", "content_hash", "size_bytes", "ingested_at"]
    each = F.struct("ingested_at", "doc_id", *[c for c in columns if c not in ("accession_no", "ingested_at")])
    ends = docs.groupBy("accession_no").agg(F.min(each).alias("first"), F.max(each).alias("last"))
    pick = lambda end: ends.select("accession_no", *[f"{end}.{c}" for c in columns[1:]])
    out = catalog.upsert(pick("first"), pick("last"), "accession_no", ["raw_path", "content_hash", "size_bytes", "ingested_at"])
    return out.select("accession_no", "company", "content_hash", "size_bytes")


def ingest_classify(spark, folder):
    docs = table(spark, folder, "documents")
    filings = docs.select("accession_no").distinct()
    out = catalog.classify_ingest(filings, docs.where("lang is not null"), docs.where(F.col("raw_path").rlike(r"\.\w+$")))
    return out.groupBy("action").agg(F.count(F.lit(1)).alias("filings"))


def _valid_runs(spark, folder):
    name = lambda c: F.regexp_replace(F.lower(F.trim(c)), "[ -]+", "_").alias(c)
    runs = table(spark, folder, "query_runs").select(name("route"), name("mode"), "refused", "latency_ms")
    return runs.where("latency_ms >= 0 and not isnan(latency_ms) and latency_ms < 9999999")


def service_metrics(spark, folder):
    runs = _valid_runs(spark, folder)
    counts = runs.groupBy("mode").agg(F.count(F.lit(1)).alias("runs"), F.round(F.avg(F.col("refused").cast("int")), 6).alias("refusal_rate"))
    points = quantiles.continuous(runs, ["mode"], "latency_ms", {"p50": 50, "p95": 95})
    return counts.join(points.select("mode", F.round("p50", 4).alias("p50"), F.round("p95", 4).alias("p95")), "mode")


def latency_nearest_rank(spark, folder):
    points = {"p50": 50, "p90": 90, "p95": 95, "p99": 99}
    return quantiles.nearest_rank(_valid_runs(spark, folder), ["route", "mode"], "latency_ms", points)


def hourly_latency(spark, folder):
    out = streams.windowed_latency(table(spark, folder, "query_runs"))
    return out.select(F.col("window.start").alias("hour"), "route", "mode", "runs", "refused", F.round("total_ms", 3).alias("total_ms"))


def form_hints(spark, folder):
    asked = table(spark, folder, "query_runs").select(routing.form_hint(F.col("query")).alias("form_type"))
    return asked.groupBy("form_type").agg(F.count(F.lit(1)).alias("runs"))


def route_questions(spark, folder):
    texts = table(spark, folder, "query_runs").groupBy("query").agg(F.min("run_id").alias("question_id"), F.count(F.lit(1)).alias("runs"))
    plans = routing.planned(texts, routing.company_aliases(table(spark, folder, "documents")))
    return plans.groupBy("route", F.size("companies").alias("companies"), "form_type").agg(F.count(F.lit(1)).alias("questions"), F.sum("runs").alias("runs"))


def ask(spark, folder):
    """Plans, searches, grades, tries once more where that failed, and answers or refuses every item."""
    from ledgerloom.api import Engine

    return Engine.over(spark, folder, lambda q: fn.nibbles(q, DIM), 1).ask(table(spark, folder, "eval_items").select(F.col("item_id").alias("question_id"), F.col("text").alias("query")))


def _labelled(spark, folder):
    """Judgments with labels for relevance: the questions are the vectors whose number 20 divides."""
    own = table(spark, folder, "embeddings")
    chunks = own.select(F.col("vec_id").alias("chunk_id"), F.lit(None).cast("string").alias("company"), F.lit(None).cast("string").alias("document_id"), "embedding")
    asked = own.where("vec_id % 20 = 0").select(F.col("vec_id").alias("question_id"), F.lit("").alias("query"), F.col("embedding").cast("array<double>").alias("vector"), "label")
    hits = s.vector_hits(chunks, s.single_legs(asked), 11).where("chunk_id <> question_id")
    hits = s.ranked(hits.drop("rank"), ["question_id"], "score", "chunk_id", most=10)
    sizes = own.groupBy("label").agg((F.count(F.lit(1)) - 1).alias("relevant_universe"))
    named = hits.join(own.select(F.col("vec_id").alias("chunk_id"), F.col("label").alias("hit_label")), "chunk_id").join(asked.select("question_id", "label"), "question_id")
    same = F.col("hit_label") == F.col("label")
    per = named.groupBy("question_id", "label").agg(
        *[F.max(F.when(same & (F.col("rank") <= k), 1).otherwise(0)).alias(f"hit{k}") for k in (1, 5, 10)],
        F.min(F.when(same, F.col("rank"))).alias("first_rank"),
        F.sum(F.when(same, 1 / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias("dcg"),
        F.max("score").alias("top_vector_score"),
    )
    judged = per.join(sizes, "label").withColumn("should_refuse", F.col("label") == 9).withColumn("refused", F.col("top_vector_score") < 0.5)
    return judged.withColumn("specs", F.lit(1)).withColumn("type", F.concat(F.lit("t"), (F.col("label") % 3).cast("string")))


def judgments(spark, folder):
    return _labelled(spark, folder).select("question_id", "hit1", "hit5", "hit10", "first_rank", F.round("dcg", 6).alias("dcg"), "relevant_universe", F.round("top_vector_score", 6).alias("top_vector_score"))


def eval_summary(spark, folder):
    out = evaluation.summary(_labelled(spark, folder))
    return out.select(*[c if c == "questions" else F.round(c, 6).alias(c) for c in out.columns])


def threshold_sweep(spark, folder):
    out = evaluation.sweep(_labelled(spark, folder))
    return out.select("threshold", F.round("refusal_precision", 6).alias("refusal_precision"), F.round("refusal_recall", 6).alias("refusal_recall"))


def recall_by_type(spark, folder):
    out = evaluation.by_type(_labelled(spark, folder), ["t0", "t1", "t2"])
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


def eval_misses(spark, folder):
    return evaluation.misses(_labelled(spark, folder))


def _specs(spark, folder):
    """A specification for each item: chunks with its first long capitalised word, in some of any item's section."""
    items = table(spark, folder, "eval_items")
    word = F.regexp_extract("text", "[A-Z][a-z]{6,}", 0)
    nothing = F.lit(None).cast("string")
    return items.select(
        F.col("item_id").alias("question_id"), F.col("question_id").alias("spec_id"), nothing.alias("company"), nothing.alias("form_type"), nothing.alias("accession"),
        F.when(F.col("item_id") % 4 == 0, "Item 1").alias("section_prefix"), F.when(word != "", word).alias("must_contain"),
    )


def spec_universe(spark, folder):
    return evaluation.universe(_specs(spark, folder), corpus(spark, folder))


def dead_specs(spark, folder):
    return evaluation.dead_specs(_specs(spark, folder), corpus(spark, folder))


def spec_judgment(spark, folder):
    hits = s.search(corpus(spark, folder), s.single_legs(questions(spark, folder)), 10, "vector")
    asked = table(spark, folder, "eval_items").select(F.col("item_id").alias("question_id"), F.col("item_type").alias("type"), (F.col("item_type") == "out_of_corpus").alias("refuse"), F.lit("all").alias("require"))
    out = evaluation.judged(asked, _specs(spark, folder), hits, corpus(spark, folder), 0.68)
    return out.select("question_id", "should_refuse", "refused", "specs", "hit10", "first_rank")


def section_detect(spark, folder):
    return sections.detect_sections(table(spark, folder, "documents"))


def section_hit_rate(spark, folder):
    docs = table(spark, folder, "documents")
    out = sections.hit_rate(docs, sections.detect_sections(docs))
    return out.withColumn("hit_rate", F.round("hit_rate", 6))


def html_to_text(spark, folder):
    return spread(table(spark, folder, "documents").select("doc_id", "text")).select("doc_id", html.html_text(F.col("text")).alias("text"))


def fixed_chunks(spark, folder):
    fixed = chunking.Fixed(120, 40, 5, chunking.SpaceTokenizer())
    out = chunking.chunk(table(spark, folder, "documents"), [fixed], key="doc_id")
    return out.select(F.col("document_id").cast("long").alias("doc_id"), "ordinal", "token_count", "content_hash")


def all_chunks(spark, folder):
    docs = table(spark, folder, "documents")
    made = chunking.chunk(docs, chunking.get_strategies(), sections.detect_sections(docs), key="doc_id")
    return made.drop("text")


def rate_limit_batch(spark, folder):
    hits = table(spark, folder, "events").select(F.col("user_id").alias("client"), F.col("event_id").alias("hit_id"), F.col("ts").cast("timestamp").alias("ts"))
    return streams.limited(hits, most=3, window=86_400.0)


def revenue_by_nation(spark, folder):
    """Star-schema check: revenue by nation and year."""
    line, orders = table(spark, folder, "lineitem"), table(spark, folder, "orders")
    customer, nation = table(spark, folder, "customer"), table(spark, folder, "nation")
    revenue = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    joined = line.join(orders, line.l_orderkey == orders.o_orderkey).join(customer, orders.o_custkey == customer.c_custkey)
    joined = joined.join(nation, customer.c_nationkey == nation.n_nationkey)
    out = joined.groupBy("n_name", F.year("o_orderdate").alias("year")).agg(F.round(F.sum(revenue), 2).alias("revenue"), F.count(F.lit(1)).alias("items"))
    return out.select("n_name", "year", "revenue", "items")


def filtered_topk(spark, folder):
    """Nearest chunks of annual reports of the largest company, for every item."""
    own = corpus(spark, folder).where("form_type = '10-K' and embedding is not null")
    legs = _with_companies(spark, folder).select("question_id", "query", "vector", F.lit(0).alias("nth"), F.element_at("companies", 1).alias("company"), F.lit(None).cast("string").alias("document_id"))
    return _rounded(s.vector_hits(own, legs, 5))


def form_postfilter(spark, folder):
    """The ten nearest chunks of each item, and of those the annual reports' only."""
    hits = _vectors(spark, folder, 10).join(corpus(spark, folder).select("chunk_id", "form_type"), "chunk_id")
    return _rounded(hits.where("form_type = '10-K'"))


def excerpts(spark, folder):
    text = F.col("text")
    return spread(table(spark, folder, "chunks").select("chunk_id", "text")).select("chunk_id", fn.excerpt(text, 300).alias("short"), fn.excerpt(text, 500, "…").alias("marked"))


def citations(spark, folder):
    rows = catalog.chunk_details(table(spark, folder, "chunks"), table(spark, folder, "documents"))
    return rows.select("chunk_id", fn.citation(F.col("company"), F.col("form_type"), F.col("document_id"), F.col("section"), F.col("chunk_id")).alias("citation"))


def filing_urls(spark, folder):
    docs = table(spark, folder, "documents")
    url = fn.source_url("https://archive.filings.example/data/", F.col("cik"), F.col("accession_no"), F.lit("main.htm"))
    return docs.select("doc_id", fn.cik_number(F.col("cik")).alias("cik_number"), fn.accession_nodash(F.col("accession_no")).alias("nodash"), url.alias("url"))


def page_lines_removed(spark, folder):
    """Texts without lines that are page numbers or rows of a table of contents."""
    line = F.split("text", "\n")
    toc = lambda x: x.contains("|") & F.trim(F.element_at(F.split(x, r"\|"), -1)).rlike(r"^\d{1,3}$")
    kept = F.filter(line, lambda x: ~x.rlike(r"^\s*-?\s*\d{1,3}\s*-?\s*$") & ~toc(x))
    return spread(table(spark, folder, "documents").select("doc_id", "text")).select("doc_id", F.array_join(kept, "\n").alias("text"), (F.size(line) - F.size(kept)).alias("removed"))


def company_names(spark, folder):
    return catalog.company_names(table(spark, folder, "documents"))


def latest_runs(spark, folder):
    """The three newest runs of every question, however often one was asked."""
    runs = s.ranked(table(spark, folder, "query_runs").select("query", "run_id", "ts").distinct(), ["query"], "ts", "run_id", most=3)
    return runs.select("query", "rank", "run_id", "ts")


def retrieved_sections(spark, folder):
    """How often chunks of each section were retrieved by logged runs, and at which place on average."""
    hits = table(spark, folder, "query_runs").select(F.posexplode("retrieved_chunk_ids").alias("pos", "chunk_id"))
    named = hits.join(table(spark, folder, "chunks").select("chunk_id", F.upper(F.trim(F.coalesce("section", F.lit("none")))).alias("section")), "chunk_id")
    return named.groupBy("section").agg(F.count(F.lit(1)).alias("hits"), F.sum(F.col("pos") + 1).alias("rank_sum"))


def refusal_by_route(spark, folder):
    name = F.regexp_replace(F.lower(F.trim("route")), "[ -]+", "_")
    runs = table(spark, folder, "query_runs").groupBy(name.alias("route"), "refused").agg(F.count(F.lit(1)).alias("runs"), F.count_if(F.col("top_vector_score") < 0.68).alias("below"))
    return runs


def answered(spark, folder):
    """Context for the nearest chunks of each item, as an answerer gets it."""
    hits = _vectors(spark, folder, 6)
    return routing.context_blocks(routing.evidence(hits, corpus(spark, folder))).withColumnRenamed("question_id", "item_id")


_ALL = [
    filtered_topk, form_postfilter, excerpts, citations, filing_urls, page_lines_removed, company_names, latest_runs, retrieved_sections, refusal_by_route, answered,
    vector_topk, fts_simple, fts_english, rrf_fusion, hybrid_search, comparison_fanout, temporal_fanout, hash_embed, content_hash, dedup_by_hash, embed_pending,
    distinct_hash_count, unchunked_documents, companies_filings, latest_per_form, chunk_details, index_versions, latest_ready_version, documents_upsert, ingest_classify,
    service_metrics, latency_nearest_rank, hourly_latency, form_hints, route_questions, ask, judgments, eval_summary, threshold_sweep, recall_by_type, eval_misses,
    spec_universe, dead_specs, spec_judgment, section_detect, section_hit_rate, html_to_text, fixed_chunks, all_chunks, rate_limit_batch, revenue_by_nation,
]
QUERIES = {f.__name__: f for f in _ALL}

W = fn.WHITE
_SET = f"c.strategy = '{STRATEGY}' AND c.params_hash = '{PARAMS}'"
_CORPUS = f"""
  filings AS (SELECT accession_no, CAST(min(CAST(cik AS BIGINT)) AS VARCHAR) AS company, min(upper(trim(form_type))) AS form_type FROM documents GROUP BY 1),
  corpus AS (SELECT c.chunk_id, c.document_id, c.section, c.text, f.company, f.form_type, CAST(e.embedding AS DOUBLE[]) AS v
             FROM chunks c JOIN filings f ON f.accession_no = c.document_id LEFT JOIN embeddings_v1 e ON e.content_hash = c.content_hash WHERE {_SET}),
  usable AS (SELECT * FROM corpus WHERE v IS NOT NULL AND len(v) = 64 AND len(list_filter(v, lambda x: isnan(x) OR isinf(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
  asked AS (SELECT item_id, text, list_transform(range(1, 65), lambda i: (strpos('0123456789abcdef', substr(sha256(text), i, 1)) - 1) / 15.0::DOUBLE) AS q FROM eval_items)"""
_VECTOR = f"""{_CORPUS},
  scored AS (SELECT a.item_id, u.chunk_id, list_cosine_similarity(u.v, a.q) AS score FROM asked a, usable u),
  near AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM scored)"""
_SIMPLE = r"""
  want AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS ws FROM eval_items),
  have AS (SELECT chunk_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS ws FROM corpus),
  simple AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, chunk_id) AS rank FROM (
    SELECT w.item_id, h.chunk_id, CAST(len(list_filter(h.ws, lambda x: list_contains(w.ws, x))) AS DOUBLE) AS score
    FROM want w JOIN have h ON list_has_all(h.ws, w.ws) WHERE len(w.ws) > 0))"""
_THREE = "few AS (SELECT company, row_number() OVER (ORDER BY company) - 1 AS nth FROM (SELECT company, count(*) AS n FROM corpus GROUP BY 1 ORDER BY n DESC, company LIMIT 3))"
_MERGE = """
  turn AS (SELECT *, row_number() OVER (PARTITION BY item_id, chunk_id ORDER BY rank, nth) AS t FROM legs WHERE rank <= quota),
  merged AS (SELECT item_id, chunk_id, score, row_number() OVER (PARTITION BY item_id ORDER BY rank, nth) AS rank FROM turn WHERE t = 1)
  SELECT item_id, chunk_id, rank, round(score, 6) AS score FROM merged WHERE rank <= 10"""
_RUNS = """
  runs AS (SELECT regexp_replace(lower(trim(route)), '[ -]+', '_', 'g') AS route, regexp_replace(lower(trim(mode)), '[ -]+', '_', 'g') AS mode, refused, latency_ms
           FROM query_runs WHERE latency_ms >= 0 AND NOT isnan(latency_ms) AND latency_ms < 9999999)"""
_JUDGED = """
  v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
  s AS (SELECT a.vec_id AS question_id, a.label, b.vec_id AS chunk_id, b.label AS hit_label, list_cosine_similarity(a.v, b.v) AS score
        FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id),
  r AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM s),
  j AS (SELECT question_id, r.label, max(CASE WHEN hit_label = r.label AND rank <= 1 THEN 1 ELSE 0 END) AS hit1,
          max(CASE WHEN hit_label = r.label AND rank <= 5 THEN 1 ELSE 0 END) AS hit5, max(CASE WHEN hit_label = r.label THEN 1 ELSE 0 END) AS hit10,
          min(CASE WHEN hit_label = r.label THEN rank END) AS first_rank, sum(CASE WHEN hit_label = r.label THEN 1 / log2(rank + 1.0) ELSE 0 END) AS dcg,
          max(score) AS top_vector_score, max(u.n) - 1 AS relevant_universe, r.label = 9 AS should_refuse, max(score) < 0.5 AS refused
        FROM r JOIN (SELECT label, count(*) AS n FROM embeddings GROUP BY 1) u ON u.label = r.label WHERE rank <= 10 GROUP BY question_id, r.label)"""
_SPECS = """
  specs AS (SELECT item_id, question_id AS spec_id, CASE WHEN item_id % 4 = 0 THEN 'Item 1' END AS prefix, nullif(regexp_extract(text, '[A-Z][a-z]{6,}'), '') AS word FROM eval_items),
  pairs AS (SELECT s.item_id, s.spec_id, c.chunk_id FROM specs s JOIN corpus c ON (s.prefix IS NOT NULL OR s.word IS NOT NULL)
              AND (s.prefix IS NULL OR starts_with(coalesce(c.section, ''), s.prefix)) AND (s.word IS NULL OR contains(lower(c.text), lower(s.word)))),
  counts AS (SELECT s.item_id AS question_id, s.spec_id, count(p.chunk_id) AS chunks FROM specs s LEFT JOIN pairs p USING (spec_id) GROUP BY 1, 2)"""
_SECTIONS = r"""
  lines AS (SELECT doc_id, upper(trim(coalesce(form_type, ''))) LIKE '10-Q%' AS in_parts, length(text) AS size,
              unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS nth FROM documents),
  placed AS (SELECT *, trim(regexp_replace(line, '^[\s\x{a0}]+|[\s\x{a0}]+$', '', 'g')) AS bare,
               coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM lines),
  heads AS (SELECT *, upper(regexp_extract(bare, '(?i)^part\s+([ivxl]+)\b', 1)) AS part, upper(regexp_extract(replace(bare, ' | ', ' '), '(?i)^item\s+(\d{1,2}[a-c]?)[.:]?\s*(.*)$', 1)) AS number,
              trim(regexp_extract(replace(bare, ' | ', ' '), '(?i)^item\s+(\d{1,2}[a-c]?)[.:]?\s*(.*)$', 2), ' .|-—') AS title
            FROM placed WHERE length(bare) BETWEEN 1 AND 150 AND NOT (contains(bare, '|') AND regexp_matches(trim(string_split(bare, '|')[-1]), '^\d{1,3}$'))),
  kept AS (SELECT *, coalesce(last_value(nullif(part, '') IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY nth ROWS UNBOUNDED PRECEDING), 'I') AS current FROM heads WHERE part <> '' OR number <> ''),
  keyed AS (SELECT *, CASE WHEN in_parts THEN current || '.' || number ELSE number END AS section_key FROM kept WHERE part = '' AND number <> ''),
  won AS (SELECT *, row_number() OVER (PARTITION BY doc_id, section_key ORDER BY (title <> '') DESC, start DESC) AS place FROM keyed),
  found AS (SELECT doc_id, section_key, title, 'Item ' || number || '.' || CASE WHEN title <> '' THEN ' ' || title ELSE '' END AS label, CAST(start AS INT) AS start,
              CAST(coalesce(lead(start) OVER (PARTITION BY doc_id ORDER BY start), size) AS INT) AS "end" FROM won WHERE place = 1)"""

ORACLE = {
    "filtered_topk": f"""WITH {_CORPUS}, {_THREE}, scored AS (SELECT a.item_id, u.chunk_id, list_cosine_similarity(u.v, a.q) AS score FROM asked a, few f JOIN usable u ON f.nth = 0 AND u.company = f.company AND u.form_type = '10-K'),
        near AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM scored)
        SELECT item_id, chunk_id, rank, round(score, 6) AS score FROM near WHERE rank <= 5""",
    "form_postfilter": f"WITH {_VECTOR} SELECT item_id, chunk_id, rank, round(score, 6) AS score FROM near JOIN corpus USING (chunk_id) WHERE rank <= 10 AND form_type = '10-K'",
    "excerpts": f"""WITH f AS (SELECT chunk_id, trim(regexp_replace(text, '[{W}]+', ' ', 'g')) AS t FROM chunks)
        SELECT chunk_id, substr(t, 1, 300) AS short, CASE WHEN length(t) > 500 THEN substr(t, 1, 500) || '…' ELSE t END AS marked FROM f""",
    "citations": """SELECT c.chunk_id, d.company || ' ' || d.form_type || ' ' || c.document_id || ' — ' || coalesce(nullif(c.section, ''), 'no section') || ' — chunk ' || c.chunk_id AS citation
        FROM chunks c JOIN (SELECT *, row_number() OVER (PARTITION BY accession_no ORDER BY doc_id) AS nth FROM documents) d ON d.accession_no = c.document_id AND d.nth = 1""",
    "filing_urls": """SELECT doc_id, CAST(cik AS BIGINT) AS cik_number, replace(accession_no, '-', '') AS nodash,
        'https://archive.filings.example/data/' || CAST(cik AS BIGINT) || '/' || replace(accession_no, '-', '') || '/main.htm' AS url FROM documents""",
    "page_lines_removed": r"""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents),
        k AS (SELECT doc_id, a, list_filter(a, lambda x: NOT regexp_matches(x, '^\s*-?\s*\d{1,3}\s*-?\s*$') AND NOT (contains(x, '|') AND regexp_matches(trim(string_split(x, '|')[-1]), '^\d{1,3}$'))) AS kept FROM l)
        SELECT doc_id, coalesce(array_to_string(kept, chr(10)), '') AS text, CAST(len(a) - len(kept) AS INT) AS removed FROM k""",
    "company_names": """SELECT cik, arg_min(company, (-n, company)) AS company, count(*) AS spellings FROM (
        SELECT CAST(cik AS BIGINT) AS cik, trim(company) AS company, count(*) AS n FROM documents WHERE company IS NOT NULL GROUP BY 1, 2) GROUP BY 1""",
    "latest_runs": """SELECT * FROM (SELECT query, row_number() OVER (PARTITION BY query ORDER BY ts DESC, run_id) AS rank, run_id, ts FROM (SELECT DISTINCT query, run_id, ts FROM query_runs)) WHERE rank <= 3""",
    "retrieved_sections": """SELECT upper(trim(coalesce(section, 'none'))) AS section, count(*) AS hits, CAST(sum(pos) AS BIGINT) AS rank_sum FROM (
        SELECT unnest(retrieved_chunk_ids) AS chunk_id, generate_subscripts(retrieved_chunk_ids, 1) AS pos FROM query_runs) JOIN chunks USING (chunk_id) GROUP BY 1""",
    "refusal_by_route": """SELECT regexp_replace(lower(trim(route)), '[ -]+', '_', 'g') AS route, refused, count(*) AS runs, count(*) FILTER (top_vector_score < 0.68) AS below FROM query_runs GROUP BY 1, 2""",
    "vector_topk": f"WITH {_VECTOR} SELECT item_id, chunk_id, rank, round(score, 6) AS score FROM near WHERE rank <= 10",
    "fts_simple": f"WITH {_CORPUS}, {_SIMPLE} SELECT item_id, chunk_id, rank, score FROM simple WHERE rank <= 10",
    "rrf_fusion": f"""WITH {_VECTOR}, {_SIMPLE},
        lists AS (SELECT item_id, chunk_id, rank, 0 AS list FROM near WHERE rank <= 50 UNION ALL SELECT item_id, chunk_id, rank, 1 FROM simple WHERE rank <= 50),
        sums AS (SELECT item_id, chunk_id, sum(1.0::DOUBLE / (60 + rank)) AS score, min(list * 1000 + rank) AS first FROM lists GROUP BY 1, 2),
        fused AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 12) DESC, first) AS rank FROM sums)
        SELECT item_id, chunk_id, rank, round(score, 6) AS score FROM fused WHERE rank <= 10""",
    "comparison_fanout": f"""WITH {_CORPUS}, {_THREE},
        legs AS (SELECT *, row_number() OVER (PARTITION BY item_id, nth ORDER BY round(score, 9) DESC, chunk_id) AS rank, greatest(2, 10 // (SELECT count(*) FROM few)) AS quota FROM (
          SELECT a.item_id, f.nth, u.chunk_id, list_cosine_similarity(u.v, a.q) AS score FROM asked a, few f JOIN usable u ON u.company = f.company)), {_MERGE}""",
    "temporal_fanout": f"""WITH {_CORPUS}, {_THREE},
        newest AS (SELECT *, row_number() OVER (ORDER BY filing_date DESC, accession_no) - 1 AS nth FROM (
          SELECT d.accession_no, max(d.filing_date) AS filing_date FROM documents d JOIN few f ON f.nth = 0 AND CAST(CAST(d.cik AS BIGINT) AS VARCHAR) = f.company GROUP BY 1)
          ORDER BY filing_date DESC, accession_no LIMIT 4),
        legs AS (SELECT *, row_number() OVER (PARTITION BY item_id, nth ORDER BY round(score, 9) DESC, chunk_id) AS rank, greatest(2, 10 // (SELECT count(*) FROM newest)) AS quota FROM (
          SELECT a.item_id, n.nth, u.chunk_id, list_cosine_similarity(u.v, a.q) AS score FROM asked a, newest n JOIN usable u ON u.document_id = n.accession_no)), {_MERGE}""",
    "hash_embed": """WITH one AS (SELECT content_hash, arg_min(text, chunk_id) AS text FROM chunks GROUP BY 1),
        raw AS (SELECT content_hash, list_transform(range(0, 8), lambda i: ((strpos('0123456789abcdef', substr(sha256(text), 2 * i + 1, 1)) - 1) * 16 + strpos('0123456789abcdef', substr(sha256(text), 2 * i + 2, 1)) - 1) / 255.0::DOUBLE) AS r FROM one)
        SELECT content_hash, list_transform(r, lambda x: round(x / sqrt(list_sum(list_transform(r, lambda y: y * y))), 6)) AS embedding FROM raw""",
    "content_hash": f"""SELECT chunk_id, sha256(trim(regexp_replace(text, '[{W}]+', ' ', 'g'))) AS computed, sha256(trim(regexp_replace(text, '[{W}]+', ' ', 'g'))) = content_hash AS same FROM chunks""",
    "dedup_by_hash": "SELECT content_hash, min(chunk_id) AS chunk_id, arg_min(text, chunk_id) AS text FROM chunks GROUP BY 1",
    "embed_pending": "SELECT content_hash, min(chunk_id) AS chunk_id FROM chunks c WHERE NOT EXISTS (SELECT 1 FROM embeddings_v1 e WHERE e.content_hash = c.content_hash) GROUP BY 1",
    "distinct_hash_count": "SELECT strategy, params_hash, count(DISTINCT content_hash) AS hashes, count(*) AS chunks, count(DISTINCT document_id) AS documents FROM chunks GROUP BY 1, 2",
    "unchunked_documents": f"SELECT doc_id, accession_no FROM documents d WHERE NOT EXISTS (SELECT 1 FROM chunks c WHERE c.document_id = d.accession_no AND {_SET})",
    "companies_filings": """SELECT cik, row_number() OVER (PARTITION BY cik ORDER BY filing_date DESC, accession_no) AS nth, accession_no, form_type, filing_date FROM (
        SELECT CAST(cik AS BIGINT) AS cik, accession_no, max(upper(trim(form_type))) AS form_type, max(filing_date) AS filing_date FROM documents GROUP BY 1, 2)""",
    "latest_per_form": """SELECT * FROM (SELECT upper(trim(form_type)) AS form, row_number() OVER (PARTITION BY upper(trim(form_type)) ORDER BY filing_date DESC, doc_id) AS rank, doc_id, filing_date FROM documents) WHERE rank <= 5""",
    "chunk_details": """SELECT c.chunk_id, c.document_id, d.company, d.form_type, d.filing_date, d.source_url, c.section, c.text FROM chunks c
        JOIN (SELECT *, row_number() OVER (PARTITION BY accession_no ORDER BY doc_id) AS nth FROM documents) d ON d.accession_no = c.document_id AND d.nth = 1""",
    "index_versions": "SELECT index_version_id, status, strategy, params_hash, CASE WHEN index_version_id = 1 THEN (SELECT count(*) FROM embeddings_v1) ELSE 0 END AS vectors FROM index_versions",
    "latest_ready_version": "SELECT index_version_id, strategy, params_hash FROM index_versions WHERE status = 'ready' ORDER BY created_at DESC, index_version_id DESC LIMIT 1",
    "documents_upsert": """SELECT accession_no, arg_min(company, (ingested_at, doc_id)) AS company, arg_max(content_hash, (ingested_at, doc_id)) AS content_hash, arg_max(size_bytes, (ingested_at, doc_id)) AS size_bytes FROM documents GROUP BY 1""",
    "ingest_classify": r"""WITH known AS (SELECT accession_no, max(raw_path) AS p FROM documents WHERE lang IS NOT NULL GROUP BY 1),
        files AS (SELECT DISTINCT raw_path AS p FROM documents WHERE regexp_matches(raw_path, '\.\w+$'))
        SELECT CASE WHEN k.accession_no IS NULL THEN 'downloaded' WHEN f.p IS NOT NULL THEN 'skipped' ELSE 'refreshed' END AS action, count(*) AS filings
        FROM (SELECT DISTINCT accession_no FROM documents) d LEFT JOIN known k USING (accession_no) LEFT JOIN files f ON f.p = k.p GROUP BY 1""",
    "service_metrics": f"""WITH {_RUNS} SELECT mode, count(*) AS runs, round(avg(CAST(refused AS INT)), 6) AS refusal_rate, round(quantile_cont(latency_ms, 0.5), 4) AS p50, round(quantile_cont(latency_ms, 0.95), 4) AS p95 FROM runs GROUP BY 1""",
    "latency_nearest_rank": f"""WITH {_RUNS}, l AS (SELECT route, mode, list_sort(list(latency_ms)) AS x, count(*) AS n FROM runs GROUP BY 1, 2)
        SELECT route, mode, n, """
    + ", ".join(f"x[CAST(greatest(1, least(n, round_even({p} / 100.0::DOUBLE * n, 0))) AS INT)] AS p{p}" for p in (50, 90, 95, 99))
    + " FROM l",
    "hourly_latency": """SELECT date_trunc('hour', ts) AS hour, lower(trim(route)) AS route, lower(trim(mode)) AS mode, count(*) AS runs, count(*) FILTER (refused) AS refused,
        round(sum(CASE WHEN latency_ms >= 0 AND NOT isnan(latency_ms) THEN latency_ms END), 3) AS total_ms FROM query_runs GROUP BY 1, 2, 3""",
    "form_hints": r"""SELECT CASE WHEN regexp_matches(query, '(?i)\bannual report|10-Ks?\b') THEN '10-K' WHEN regexp_matches(query, '(?i)\bquarter|10-Qs?\b') THEN '10-Q' END AS form_type, count(*) AS runs FROM query_runs GROUP BY 1""",
    "judgments": f"WITH {_JUDGED} SELECT question_id, hit1, hit5, hit10, first_rank, round(dcg, 6) AS dcg, relevant_universe, round(top_vector_score, 6) AS top_vector_score FROM j",
    "eval_summary": f"""WITH {_JUDGED}, i AS (SELECT *, list_sum(list_transform(range(1, CAST(least(10, relevant_universe) AS INT) + 1), lambda k: 1 / log2(k + 1.0))) AS ideal FROM j)
        SELECT count(*) AS questions, round(avg(hit1) FILTER (NOT should_refuse), 6) AS recall_at_1, round(avg(hit5) FILTER (NOT should_refuse), 6) AS recall_at_5, round(avg(hit10) FILTER (NOT should_refuse), 6) AS recall_at_10,
          round(avg(coalesce(1.0 / first_rank, 0)) FILTER (NOT should_refuse), 6) AS mrr_at_10, round(avg(coalesce(dcg / ideal, 0)) FILTER (NOT should_refuse), 6) AS ndcg_at_10,
          round(CASE WHEN count(*) FILTER (refused) > 0 THEN count(*) FILTER (refused AND should_refuse) / count(*) FILTER (refused) ELSE 1.0 END, 6) AS refusal_precision,
          round(CASE WHEN count(*) FILTER (should_refuse) > 0 THEN count(*) FILTER (refused AND should_refuse) / count(*) FILTER (should_refuse) ELSE 1.0 END, 6) AS refusal_recall FROM i""",
    "threshold_sweep": f"""WITH {_JUDGED}, t AS (SELECT h / 100.0::DOUBLE AS threshold FROM (SELECT unnest(range(40, 71, 2)) AS h))
        SELECT threshold, round(CASE WHEN count(*) FILTER (top_vector_score < threshold) > 0 THEN count(*) FILTER (top_vector_score < threshold AND should_refuse) / count(*) FILTER (top_vector_score < threshold) ELSE 1.0 END, 6) AS refusal_precision,
          round(CASE WHEN count(*) FILTER (should_refuse) > 0 THEN count(*) FILTER (top_vector_score < threshold AND should_refuse) / count(*) FILTER (should_refuse) ELSE 1.0 END, 6) AS refusal_recall FROM j, t GROUP BY 1""",
    "recall_by_type": f"WITH {_JUDGED} SELECT "
    + ", ".join(f"round(avg(hit5) FILTER (NOT should_refuse AND label % 3 = {t}), 6) AS t{t}" for t in range(3))
    + " FROM j",
    "eval_misses": f"WITH {_JUDGED} SELECT question_id FROM j WHERE NOT should_refuse AND first_rank IS NULL",
    "spec_universe": f"WITH {_CORPUS}, {_SPECS} SELECT question_id, spec_id, chunks FROM counts",
    "dead_specs": f"WITH {_CORPUS}, {_SPECS} SELECT question_id, spec_id FROM counts WHERE chunks = 0",
    "spec_judgment": f"""WITH {_VECTOR}, {_SPECS}, top AS (SELECT item_id, chunk_id, rank, score FROM near WHERE rank <= 10)
        SELECT i.item_id AS question_id, i.item_type = 'out_of_corpus' AS should_refuse, coalesce(max(t.score), 0) < 0.68 AS refused, 1 AS specs, CAST(count(DISTINCT p.spec_id) AS INT) AS hit10, min(CASE WHEN p.spec_id IS NOT NULL THEN t.rank END) AS first_rank
        FROM eval_items i LEFT JOIN top t ON t.item_id = i.item_id LEFT JOIN pairs p ON p.item_id = i.item_id AND p.chunk_id = t.chunk_id GROUP BY 1, 2""",
    "section_detect": f'WITH {_SECTIONS} SELECT doc_id, section_key, title, label, start, "end" FROM found',
    "section_hit_rate": f"""WITH {_SECTIONS}, w(form, key) AS (VALUES ('10-K', '1'), ('10-K', '1A'), ('10-K', '7'), ('10-K', '7A'), ('10-K', '8'), ('10-Q', 'I.1'), ('10-Q', 'I.2'), ('10-Q', 'II.1A')),
        d AS (SELECT doc_id, upper(trim(form_type)) AS form FROM documents)
        SELECT d.form, count(DISTINCT d.doc_id) AS documents, count(*) AS expected, count(f.doc_id) AS found, round(count(f.doc_id) / count(*), 6) AS hit_rate
        FROM d JOIN w ON w.form = d.form LEFT JOIN found f ON f.doc_id = d.doc_id AND f.section_key = w.key GROUP BY 1""",
    "fixed_chunks": f"""WITH words AS (SELECT doc_id, regexp_extract_all(text, '[^{W}]+') AS w FROM documents),
        cut AS (SELECT doc_id, unnest(range(0, len(w), 80)) AS low, w FROM words)
        SELECT doc_id, low // 80 AS ordinal, len(w[low + 1 : low + 120]) AS token_count, sha256(array_to_string(w[low + 1 : low + 120], ' ')) AS content_hash FROM cut WHERE len(w[low + 1 : low + 120]) >= 5""",
    "revenue_by_nation": """SELECT n_name, year(o_orderdate) AS year, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS items
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2""",
}
