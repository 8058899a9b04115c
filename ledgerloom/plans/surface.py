"""Queries of the surface's parts that other plans don't show on their own, each over whole tables, and their SQL."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import columns as fn
from ledgerloom.functions import html, sections
from ledgerloom.operators import catalog, evaluation, routing
from ledgerloom.operators import search as s
from ledgerloom.plans import reference as r
from ledgerloom.session import table


def selected_filings(spark: SparkSession, folder: str) -> DataFrame:
    """The two newest annual and quarterly reports of each company, from submission indexes with parallel arrays."""
    docs = table(spark, folder, "documents").where("filing_date is not null")
    # an index for each day, so that none grows with its company
    each = F.sort_array(F.collect_list(F.struct("doc_id", "accession_no", "form_type", F.col("filing_date").cast("string").alias("filed"), F.coalesce(F.col("period").cast("string"), F.lit("")).alias("period"))))
    days = docs.groupBy(F.regexp_replace("cik", "[^0-9]", "").cast("bigint").alias("cik"), "filing_date").agg(each.alias("e"), F.min("company").alias("name"))
    recent = F.struct(
        F.col("e.accession_no").alias("accessionNumber"), F.col("e.form_type").alias("form"), F.col("e.filed").alias("filingDate"), F.col("e.period").alias("reportDate"),
        F.transform("e.doc_id", lambda d: F.when(d % 7 == 0, "").otherwise("main.htm")).alias("primaryDocument"),
    )
    submissions = days.select("cik", "name", F.struct(recent.alias("recent")).alias("filings"))
    return catalog.select_filings(submissions, ["10-k", "10-Q"], 2).select("cik", "form_type", "nth", "accession_no", "filing_date", "period")


def relevant_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return evaluation.relevant_universe(r._specs(spark, folder), r.corpus(spark, folder))


def any_judgment(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of items as one question with two specifications, of which every second question needs one only."""
    pair = F.floor(F.col("question_id") / 2).cast("long")
    specs = r._specs(spark, folder).withColumn("question_id", pair)
    asked = r.questions(spark, folder).where("question_id % 2 = 0").withColumn("question_id", pair)
    hits = s.search(r.corpus(spark, folder), s.single_legs(asked), 10, "vector")
    require = F.when(F.col("question_id") % 2 == 0, "any").otherwise("all")
    questions = asked.select("question_id", F.lit("x").alias("type"), F.lit(False).alias("refuse"), require.alias("require"))
    return evaluation.judged(questions, specs, hits, r.corpus(spark, folder), 0.68).select("question_id", "refused", "specs", "hit1", "hit5", "hit10", "first_rank")


def _first_runs(spark: SparkSession, folder: str) -> DataFrame:
    """The first run of each question."""
    runs = table(spark, folder, "query_runs").where("query is not null")
    one = runs.groupBy("query").agg(F.min(F.struct("run_id", "ts", F.coalesce("top_vector_score", F.lit(0.0)).alias("top"), "retrieved_chunk_ids")).alias("r"))
    return one.select("query", F.col("r.run_id").alias("question_id"), F.col("r.top").alias("top_vector_score"), F.col("r.retrieved_chunk_ids").alias("ids"))


def planned_questions(spark: SparkSession, folder: str) -> DataFrame:
    """Companies, route and form of every question that was asked."""
    plans = routing.planned(_first_runs(spark, folder).select("question_id", "query"), routing.company_aliases(table(spark, folder, "documents")))
    return plans.select("question_id", F.array_join("companies", ",").alias("companies"), F.array_join("unknown", ",").alias("unknown"), "route", "form_type")


def graded_questions(spark: SparkSession, folder: str) -> DataFrame:
    """Whether the first run of every question brought enough, and the reason where it didn't."""
    first = _first_runs(spark, folder)
    owner = s.corpus_companies(table(spark, folder, "documents"))
    hits = first.select("question_id", F.posexplode("ids").alias("pos", "chunk_id")).join(table(spark, folder, "chunks").select("chunk_id", "document_id"), "chunk_id")
    named = hits.join(owner, "document_id").groupBy("question_id").agg(F.sort_array(F.collect_list(F.struct("pos", "company"))).alias("h"))
    plans = routing.planned(first.select("question_id", "query"), routing.company_aliases(table(spark, folder, "documents")))
    rows = plans.join(first.select("question_id", "top_vector_score"), "question_id").join(named.select("question_id", F.col("h.company").alias("hit_companies")), "question_id", "left")
    return routing.graded(rows).select("question_id", "graded_ok", "reason")


def rewritten_questions(spark: SparkSession, folder: str) -> DataFrame:
    plans = routing.planned(_first_runs(spark, folder).select("question_id", "query"), routing.company_aliases(table(spark, folder, "documents")))
    return plans.where("route <> 'out_of_scope'").select("question_id", routing.rewritten(F.col("query"), F.col("companies")).alias("query"))


def extractive_answers(spark: SparkSession, folder: str) -> DataFrame:
    """The answer without a model, from the nearest chunks of each item."""
    proof = routing.evidence(r._vectors(spark, folder, 6), r.corpus(spark, folder))
    return routing.extractive(proof).select(F.col("question_id").alias("item_id"), "answer", F.array_join("citations", "\n").alias("citations"))


def fanout_best_score(spark: SparkSession, folder: str) -> DataFrame:
    """Per item the best score over its legs, one for each company."""
    hits = s.fan_out(r.corpus(spark, folder), s.company_legs(r._with_companies(spark, folder)), 10, "vector")
    return hits.groupBy(F.col("question_id").alias("item_id")).agg(F.round(F.max("top_vector_score"), 6).alias("top_vector_score"), F.count(F.lit(1)).alias("hits"))


def html_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Text of a page made of each filing's own data: entities, tables within tables, page numbers, hidden parts."""
    page = F.concat(
        F.lit("<html><head><title>t</title></head><body><script>var x;</script><ix:header><b>hidden</b></ix:header><h1>"), "company", F.lit("</h1>\n<p>A&nbsp;“quoted” – it’s  "), "accession_no",
        F.lit("</p>\n<table><tr><td>Form</td><td> </td><td>"), "form_type", F.lit("</td></tr><tr><td>outer <table><tr><td>cik</td><td>"), "cik",
        F.lit("</td></tr></table></td></tr></table>\n<p>- 12 -</p>\n\n\n\n<p>filed &amp; read "), F.col("filing_date").cast("string"), F.lit("</p></body></html>"),
    )
    return table(spark, folder, "documents").select("doc_id", html.html_text(page).alias("text"))


def limited_events(spark: SparkSession, folder: str) -> DataFrame:
    return r.rate_limit_batch(spark, folder).select("hit_id", "allowed")


def parameter_hashes(spark: SparkSession, folder: str) -> DataFrame:
    """The stored hash of each parameter set and the one of its parameters; the sets are few."""
    rows = table(spark, folder, "chunk_param_sets").collect()
    made = [(x.strategy, x.params_hash, fn.params_hash(json.loads(x.params))) for x in rows]
    return spark.createDataFrame(made, "strategy string, params_hash string, computed string")


def documents_inserted(spark: SparkSession, folder: str) -> DataFrame:
    """Filings that a table of those with a language doesn't have yet."""
    docs = table(spark, folder, "documents").select("accession_no", "lang")
    return catalog.insert_ignore(docs.where("lang is not null"), docs, ["accession_no"]).select("accession_no")


def missing_sections(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return sections.missing(docs, sections.detect_sections(docs)).select("doc_id", "form", F.array_join("missing", ",").alias("missing"))


def vector_literals(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select("vec_id", fn.vector_text(F.col("embedding")).alias("literal"))


def run_latency(spark: SparkSession, folder: str) -> DataFrame:
    """Median and 95th percentile of latency by nearest rank, of the valid runs of each mode, as reports give them."""
    return evaluation.latencies(r._valid_runs(spark, folder), ["mode"])


def version_by_id(spark: SparkSession, folder: str) -> DataFrame:
    return catalog.version(table(spark, folder, "index_versions"), 2).select("index_version_id", "embedding_model", "status")


def resolved_companies(spark: SparkSession, folder: str) -> DataFrame:
    """Every spelling, and some that aren't in the registry, as the company that it names."""
    docs = table(spark, folder, "documents")
    names = docs.where("company is not null").select(F.col("company").alias("name")).union(docs.select(F.concat(F.lit("Unlisted "), "accession_no"))).distinct()
    return routing.resolved(names, routing.company_aliases(docs)).select("name", "company")


def golden_counts(spark: SparkSession, folder: str) -> DataFrame:
    items = table(spark, folder, "eval_items").select(F.col("item_type").alias("type"), (F.col("item_type") == "out_of_corpus").alias("refuse"), (F.col("item_id") % 3 == 0).alias("verified"))
    return evaluation.golden_counts(items)


_ALL = [
    selected_filings, relevant_chunks, any_judgment, planned_questions, graded_questions, rewritten_questions, extractive_answers, fanout_best_score, html_pages, limited_events, parameter_hashes,
    documents_inserted, missing_sections, vector_literals, run_latency, version_by_id, resolved_companies, golden_counts,
]
QUERIES = {f.__name__: f for f in _ALL}

_ALIASES = r"""
  named AS (SELECT DISTINCT CAST(CAST(cik AS BIGINT) AS VARCHAR) AS company, lower(trim(regexp_replace(company, '[\s,]+', ' ', 'g'))) AS name FROM documents WHERE company IS NOT NULL),
  spelled AS (SELECT company, name AS alias FROM named UNION SELECT company, array_to_string(string_split(name, ' ')[1:2], ' ') FROM named),
  aliases AS (SELECT alias, min(company) AS company FROM spelled WHERE length(alias) > 3 GROUP BY 1 HAVING count(DISTINCT company) = 1)"""
_PLANNED = rf"""{_ALIASES},
  firsts AS (SELECT query, min(run_id) AS question_id FROM query_runs WHERE query IS NOT NULL GROUP BY 1),
  bare AS (SELECT *, ' ' || array_to_string(regexp_split_to_array(lower(regexp_replace(regexp_replace(query, '[?!,;:]|''s\b', '', 'g'), '\.(\s|$)', '\1', 'g')), '\s+'), ' ') || ' ' AS q FROM firsts),
  found AS (SELECT DISTINCT b.question_id, a.company FROM bare b JOIN aliases a ON contains(b.q, ' ' || regexp_replace(a.alias, '\.$', '') || ' ')),
  lists AS (SELECT question_id, string_agg(company, ',' ORDER BY CAST(company AS BIGINT)) AS companies, count(*) AS n FROM found GROUP BY 1),
  capital AS (SELECT question_id, query, list_distinct(regexp_extract_all(regexp_replace(query, '(^|[.?!] )[A-Z]', '\1_', 'g'), '\b([A-Z][A-Za-z&.-]+)', 1)) AS found,
                regexp_extract_all(regexp_replace(query, '(^|[.?!] )[A-Z]', '\1_', 'g'), '\b([A-Z][A-Za-z&.-]+)', 1) AS every FROM firsts),
  strange AS (SELECT question_id, query, array_to_string(list_filter(every, lambda x, i: list_position(every, x) = i AND NOT list_contains(string_split('{" ".join(sorted(routing.VOCABULARY))}', ' '),
                regexp_replace(lower(x), '(^[,.?!]+|[,.?!]+$)', '', 'g'))), ',') AS unknown FROM capital),
  plans AS (SELECT question_id, query, coalesce(companies, '') AS companies, coalesce(n, 0) AS n, coalesce(unknown, '') AS unknown,
      CASE WHEN coalesce(n, 0) = 0 AND coalesce(unknown, '') <> '' THEN 'out_of_scope' WHEN n >= 2 THEN 'comparison'
           WHEN n = 1 AND regexp_matches(query, '{routing.TEMPORAL}') THEN 'temporal' ELSE 'lookup' END AS route,
      CASE WHEN regexp_matches(query, '(?i)\bannual report|10-Ks?\b') THEN '10-K' WHEN regexp_matches(query, '(?i)\bquarter|10-Qs?\b') THEN '10-Q' END AS form_type
    FROM strange LEFT JOIN lists USING (question_id))"""
_PROOF = f"""{r._VECTOR},
  proof AS (SELECT n.item_id, n.rank, trim(regexp_replace(c.text, '[{fn.WHITE}]+', ' ', 'g')) AS flat,
      c.company || ' ' || c.form_type || ' ' || c.document_id || ' — ' || coalesce(nullif(c.section, ''), 'no section') || ' — chunk ' || c.chunk_id AS citation
    FROM near n JOIN corpus c USING (chunk_id) WHERE n.rank <= 6)"""

ORACLE = {
    "selected_filings": """SELECT cik, form_type, nth, accession_no, filing_date, period FROM (
        SELECT CAST(CAST(cik AS BIGINT) AS VARCHAR) AS cik, upper(trim(form_type)) AS form_type, accession_no, filing_date, period,
          row_number() OVER (PARTITION BY CAST(cik AS BIGINT), upper(trim(form_type)) ORDER BY filing_date DESC, doc_id) AS nth
        FROM documents WHERE filing_date IS NOT NULL AND doc_id % 7 <> 0 AND upper(trim(form_type)) IN ('10-K', '10-Q')) WHERE nth <= 2""",
    "relevant_chunks": f"WITH {r._CORPUS}, {r._SPECS} SELECT s.item_id AS question_id, count(DISTINCT p.chunk_id) AS relevant_universe FROM specs s LEFT JOIN pairs p USING (item_id) GROUP BY 1",
    "any_judgment": f"""WITH {r._VECTOR}, {r._SPECS}, top AS (SELECT item_id // 2 AS q, chunk_id, rank, score FROM near WHERE rank <= 10 AND item_id % 2 = 0),
        two AS (SELECT item_id // 2 AS q, spec_id, chunk_id FROM pairs),
        many AS (SELECT item_id // 2 AS q, CAST(count(*) AS INT) AS n FROM specs GROUP BY 1),
        hit AS (SELECT t.q, max(t.score) AS top, count(DISTINCT b.spec_id) FILTER (t.rank <= 1) AS h1, count(DISTINCT b.spec_id) FILTER (t.rank <= 5) AS h5, count(DISTINCT b.spec_id) AS h10,
                  min(t.rank) FILTER (b.spec_id IS NOT NULL) AS first_rank FROM top t LEFT JOIN two b ON b.q = t.q AND b.chunk_id = t.chunk_id GROUP BY 1)
        SELECT i.item_id // 2 AS question_id, coalesce(h.top, 0) < 0.68 AS refused, CASE WHEN i.item_id // 2 % 2 = 0 THEN least(m.n, 1) ELSE m.n END AS specs,
          CASE WHEN i.item_id // 2 % 2 = 0 THEN least(coalesce(h1, 0), 1) ELSE coalesce(h1, 0) END AS hit1, CASE WHEN i.item_id // 2 % 2 = 0 THEN least(coalesce(h5, 0), 1) ELSE coalesce(h5, 0) END AS hit5,
          CASE WHEN i.item_id // 2 % 2 = 0 THEN least(coalesce(h10, 0), 1) ELSE coalesce(h10, 0) END AS hit10, first_rank
        FROM eval_items i LEFT JOIN many m ON m.q = i.item_id // 2 LEFT JOIN hit h ON h.q = i.item_id // 2 WHERE i.item_id % 2 = 0""",
    "planned_questions": f"WITH {_PLANNED} SELECT question_id, companies, unknown, route, form_type FROM plans",
    "graded_questions": f"""WITH {_PLANNED},
        one AS (SELECT run_id AS question_id, arg_min(coalesce(top_vector_score, 0), (ts, coalesce(top_vector_score, 0))) AS top, arg_min(retrieved_chunk_ids, (ts, coalesce(top_vector_score, 0))) AS ids
                FROM query_runs WHERE run_id IN (SELECT question_id FROM firsts) GROUP BY 1),
        owner AS (SELECT accession_no, CAST(min(CAST(cik AS BIGINT)) AS VARCHAR) AS company FROM documents GROUP BY 1),
        hits AS (SELECT question_id, unnest(ids) AS chunk_id, generate_subscripts(ids, 1) AS pos FROM one),
        named_hits AS (SELECT h.question_id, list(o.company ORDER BY pos)[1:10] AS hc FROM hits h JOIN chunks c USING (chunk_id) JOIN owner o ON o.accession_no = c.document_id GROUP BY 1),
        why AS (SELECT p.question_id, CASE
            WHEN route = 'out_of_scope' THEN 'query names entities not in the corpus: ' || array_to_string(string_split(unknown, ',')[1:3], ', ')
            WHEN hc IS NULL THEN 'no chunks retrieved'
            WHEN top < CASE WHEN n > 0 THEN 0.68 ELSE 0.75 END THEN printf('top similarity %.3f below bar %.2f', top, CASE WHEN n > 0 THEN 0.68 ELSE 0.75 END::DOUBLE)
            WHEN n > 0 AND NOT list_has_all(hc, string_split(companies, ',')) THEN 'retrieved evidence does not cover every named company' ELSE '' END AS reason
          FROM plans p JOIN one USING (question_id) LEFT JOIN named_hits USING (question_id))
        SELECT question_id, reason = '' AS graded_ok, reason FROM why""",
    "rewritten_questions": f"""WITH {_PLANNED} SELECT question_id, query || ' ' || CASE WHEN n > 0 THEN replace(companies, ',', ' ') ELSE 'SEC filing' END || ' risk factors MD&A disclosure' AS query
        FROM plans WHERE route <> 'out_of_scope'""",
    "extractive_answers": f"""WITH {_PROOF}
        SELECT item_id, '[strongest evidence, verbatim]' || chr(10) || chr(10) || string_agg('[' || rank || '] ' || citation || chr(10) || '    "' || CASE WHEN length(flat) > 500 THEN substr(flat, 1, 500) || '…' ELSE flat END || '"',
            chr(10) || chr(10) ORDER BY rank) FILTER (rank <= 4) AS answer, string_agg(citation, chr(10) ORDER BY rank) AS citations FROM proof GROUP BY 1""",
    "fanout_best_score": f"""WITH {r._CORPUS}, {r._THREE},
        legs AS (SELECT *, row_number() OVER (PARTITION BY item_id, nth ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM (
          SELECT a.item_id, f.nth, u.chunk_id, list_cosine_similarity(u.v, a.q) AS score FROM asked a, few f JOIN usable u ON u.company = f.company)),
        kept AS (SELECT item_id, chunk_id FROM legs WHERE rank <= greatest(2, 10 // (SELECT count(*) FROM few)))
        SELECT k.item_id, round(max(l.score), 6) AS top_vector_score, least(10, any_value(k.n)) AS hits
        FROM (SELECT item_id, count(DISTINCT chunk_id) AS n FROM kept GROUP BY 1) k JOIN legs l USING (item_id) GROUP BY 1""",
    "html_pages": r"""SELECT doc_id, trim(regexp_replace(company, '[ \t]+', ' ', 'g')) || chr(10) || chr(10) || 'A "quoted" - it''s ' || accession_no || chr(10) || chr(10) || 'Form | ' || trim(form_type) || chr(10) || 'outer cik | ' || trim(cik) || chr(10) || chr(10)
        || 'filed & read ' || filing_date AS text FROM documents""",
    "limited_events": """WITH RECURSIVE e AS (
          SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nth FROM events),
        run AS (
          SELECT user_id, event_id, nth, [t] AS kept, true AS allowed FROM e WHERE nth = 1
          UNION ALL
          SELECT e.user_id, e.event_id, e.nth,
            CASE WHEN len(list_filter(run.kept, lambda k: e.t - k <= 86400000000)) < 3 THEN list_append(list_filter(run.kept, lambda k: e.t - k <= 86400000000), e.t)
                 ELSE list_filter(run.kept, lambda k: e.t - k <= 86400000000) END,
            len(list_filter(run.kept, lambda k: e.t - k <= 86400000000)) < 3
          FROM run JOIN e ON e.user_id = run.user_id AND e.nth = run.nth + 1)
        SELECT event_id AS hit_id, allowed FROM run""",
    "parameter_hashes": """WITH p AS (SELECT strategy, params_hash, unnest(json_keys(params)) AS k, params FROM chunk_param_sets)
        SELECT strategy, params_hash, substr(sha256('{' || string_agg('"' || k || '":' || (params->('$.' || k)), ',' ORDER BY k) || '}'), 1, 16) AS computed FROM p GROUP BY 1, 2""",
    "documents_inserted": "SELECT DISTINCT accession_no FROM documents WHERE accession_no NOT IN (SELECT accession_no FROM documents WHERE lang IS NOT NULL)",
    "missing_sections": f"""WITH {r._SECTIONS}, w(form, key, nth) AS (VALUES ('10-K', '1', 1), ('10-K', '1A', 2), ('10-K', '7', 3), ('10-K', '7A', 4), ('10-K', '8', 5), ('10-Q', 'I.1', 1), ('10-Q', 'I.2', 2), ('10-Q', 'II.1A', 3)),
        d AS (SELECT doc_id, upper(trim(form_type)) AS form FROM documents)
        SELECT d.doc_id, d.form, string_agg(w.key, ',' ORDER BY w.nth) AS missing FROM d JOIN w ON w.form = d.form
        WHERE NOT EXISTS (SELECT 1 FROM found f WHERE f.doc_id = d.doc_id AND f.section_key = w.key) GROUP BY 1, 2""",
    "vector_literals": "SELECT vec_id, '[' || array_to_string(list_transform(embedding, lambda x: printf('%.8f', x::DOUBLE)), ',') || ']' AS literal FROM embeddings",
    "run_latency": f"""WITH {r._RUNS}, l AS (SELECT mode, list_sort(list(latency_ms)) AS x, count(*) AS n FROM runs GROUP BY 1)
        SELECT mode, n, x[CAST(greatest(1, round_even(0.5 * n, 0)) AS INT)] AS p50, x[CAST(greatest(1, round_even(0.95::DOUBLE * n, 0)) AS INT)] AS p95 FROM l""",
    "version_by_id": "SELECT index_version_id, embedding_model, status FROM index_versions WHERE index_version_id = 2",
    "resolved_companies": rf"""WITH {_ALIASES}, names AS (SELECT DISTINCT company AS name FROM documents WHERE company IS NOT NULL UNION SELECT 'Unlisted ' || accession_no FROM documents)
        SELECT name, coalesce(a.company, name) AS company FROM names LEFT JOIN aliases a ON a.alias = lower(trim(regexp_replace(name, '[\s,]+', ' ', 'g')))""",
    "golden_counts": "SELECT count(*) AS questions, count(*) FILTER (item_id % 3 = 0) AS verified, count(*) FILTER (item_type <> 'out_of_corpus') AS in_corpus, count(*) FILTER (item_type = 'out_of_corpus') AS out_of_corpus FROM eval_items",
    "answered": f"WITH {_PROOF} SELECT item_id, string_agg('[' || rank || '] (' || citation || ')' || chr(10) || flat, chr(10) || chr(10) ORDER BY rank) AS context FROM proof GROUP BY 1",
    "route_questions": f"""WITH {_PLANNED}, often AS (SELECT query, count(*) AS runs FROM query_runs GROUP BY 1)
        SELECT route, CAST(n AS INT) AS companies, form_type, count(*) AS questions, CAST(sum(runs) AS BIGINT) AS runs FROM plans JOIN often USING (query) GROUP BY 1, 2, 3""",
}
