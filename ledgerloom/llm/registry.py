"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import copies, leak, lines, markup, mix, neighbours, percentiles, split, subjects
from ledgerloom.llm.text import TOKEN_JVM
from ledgerloom.session import table

SET = ["strategy", "params_hash"]


def _pieces(spark: SparkSession, folder: str) -> DataFrame:
    chunks = table(spark, folder, "chunks").select("chunk_id", "section", "text", *SET)
    sized = split.with_limits(chunks, table(spark, folder, "chunk_param_sets"))
    return split.split_oversized(sized, "chunk_id", "text", "section", "size_limit", "size_overlap")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return _pieces(spark, folder).where("piece = 0").select("chunk_id")


def p1_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return _pieces(spark, folder)


def _found_lines(spark: SparkSession, folder: str) -> DataFrame:
    chunks = table(spark, folder, "chunks")
    known = lines.filings(table(spark, folder, "documents"))
    return lines.repeated_lines(lines.chunk_texts(chunks), 6, 16, chunks.select("section"), known).withColumnRenamed("item", "chunk_id")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return _found_lines(spark, folder).select("chunk_id", "line_no")


def p3_clean(spark: SparkSession, folder: str) -> DataFrame:
    chunks = table(spark, folder, "chunks").select("chunk_id", "text")
    return lines.without_lines(chunks, "chunk_id", "text", _found_lines(spark, folder))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    found = copies.members(table(spark, folder, "chunks"), "chunk_id", "text", SET)
    return found.withColumnRenamed("class_first", "first_chunk_id")


def p4_counts(spark: SparkSession, folder: str) -> DataFrame:
    classes = copies.copy_classes(table(spark, folder, "chunks"), "chunk_id", "text", SET)
    return classes.select(*SET, F.col("class_first").alias("chunk_id"), F.col("class_copies").alias("copies")).distinct()


def _daily(spark: SparkSession, folder: str, *by: str) -> DataFrame:
    return percentiles.sketches(percentiles.valid_runs(table(spark, folder, "query_runs")), ["day", *by, "route", "mode"], "latency_ms")


def p2_by_query(spark: SparkSession, folder: str) -> DataFrame:
    """Percentiles of each question's runs, from the sketches of its days."""
    whole = percentiles.merged(_daily(spark, folder, "query"), ["query", "route", "mode"])
    return percentiles.percentiles(whole, ["query", "route", "mode"], {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99})


def p2_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    whole = percentiles.merged(_daily(spark, folder), ["route", "mode"])
    return percentiles.percentiles(whole, ["route", "mode"], {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99})


def p2_daily(spark: SparkSession, folder: str) -> DataFrame:
    return percentiles.percentiles(_daily(spark, folder), ["day", "route", "mode"], {"p50": 0.5, "p95": 0.95})


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return markup.markup_kinds(table(spark, folder, "chunks"))


def p5_clean(spark: SparkSession, folder: str) -> DataFrame:
    return markup.clean_markup(table(spark, folder, "chunks"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    pairs = neighbours.similar_pairs(table(spark, folder, "embeddings_v1"), "content_hash", "embedding", 64, 5, 0.9)
    return pairs.select(F.col("a").alias("content_hash_a"), F.col("b").alias("content_hash_b"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return p8_spans(spark, folder).select("doc_id", "item_id")


def p8_spans(spark: SparkSession, folder: str) -> DataFrame:
    return leak.leaked_items(table(spark, folder, "documents"), table(spark, folder, "eval_items"))


def _mix(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    documents, targets = table(spark, folder, "documents"), table(spark, folder, "mix_targets")
    return documents, targets, mix.selection(documents, targets)


def p9_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mix.mix_report(*_mix(spark, folder))


def p9_selection(spark: SparkSession, folder: str) -> DataFrame:
    return _mix(spark, folder)[2]


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    assigned = subjects.assign_subjects(table(spark, folder, "documents"), table(spark, folder, "subject_labels"))
    return assigned.select("doc_id", "subject")


QUERIES = {
    "p1_found": p1_found,
    "p1_pieces": p1_pieces,
    "p2_by_query": p2_by_query,
    "p2_percentiles": p2_percentiles,
    "p2_daily": p2_daily,
    "p3_found": p3_found,
    "p3_clean": p3_clean,
    "p4_found": p4_found,
    "p4_counts": p4_counts,
    "p5_found": p5_found,
    "p5_clean": p5_clean,
    "p6_found": p6_found,
    "p8_found": p8_found,
    "p8_spans": p8_spans,
    "p9_selection": p9_selection,
    "p9_mix": p9_mix,
    "p10_found": p10_found,
}

_FOLD = r"regexp_replace(lower({}), '[^\p{{L}}\p{{N}}]+', '', 'g')"

_REPEATED = f"""
        raw AS (
          SELECT c.chunk_id, c.document_id, d.source, generate_subscripts(string_split(c.text, chr(10)), 1) AS line_no,
                 unnest(string_split(c.text, chr(10))) AS line
          FROM chunks c JOIN (SELECT accession_no, min(CAST(cik AS BIGINT)) AS source FROM documents GROUP BY 1) d
            ON d.accession_no = c.document_id),
        folded AS (SELECT *, {_FOLD.format('line')} AS fold FROM raw),
        often AS (
          SELECT source, fold FROM folded WHERE length(fold) >= 16
            AND fold NOT IN (SELECT {_FOLD.format('section')} FROM chunks WHERE section IS NOT NULL)
          GROUP BY 1, 2 HAVING count(DISTINCT document_id) >= 6)"""

_CLASSES = f"""
        pieces AS (
          SELECT chunk_id, strategy, params_hash, {_FOLD.format('text')} AS fold,
                 list_filter(regexp_split_to_array(text, '[\\n;|]'), lambda x: regexp_matches(x, '\\S')) AS p
          FROM chunks),
        keyed AS (
          SELECT *, CASE WHEN len(p) >= 3 AND len(list_filter(p, lambda x: NOT regexp_matches(x, '[:=]'))) = 0
                         THEN list_sort(list_transform(p, lambda x: {_FOLD.format('x')})) END AS fields
          FROM pieces),
        one AS (
          SELECT *, min(fold) OVER (PARTITION BY strategy, params_hash, fields) AS near FROM keyed WHERE fields IS NOT NULL),
        joined AS (
          SELECT strategy, params_hash, fold, min(near) AS near FROM one GROUP BY 1, 2, 3),
        labelled AS (
          SELECT k.chunk_id, k.strategy, k.params_hash, coalesce(j.near, k.fold) AS label
          FROM keyed k LEFT JOIN joined j USING (strategy, params_hash, fold))"""

ORACLE = {
    "p1_found": rf"""
        SELECT c.chunk_id FROM chunks c JOIN chunk_param_sets s USING (strategy, params_hash)
        WHERE len(regexp_extract_all(c.text, '{TOKEN_JVM}'))
              > coalesce(CAST(s.params->>'$.max_tokens' AS INT), CAST(s.params->>'$.size_tokens' AS INT))""",
    "p3_found": f"WITH {_REPEATED} SELECT f.chunk_id, f.line_no FROM folded f JOIN often USING (source, fold)",
    "p3_clean": f"""WITH {_REPEATED},
        hit AS (SELECT chunk_id, list(line_no) AS nos FROM folded JOIN often USING (source, fold) GROUP BY 1)
        SELECT c.chunk_id, CASE WHEN h.nos IS NULL THEN c.text ELSE
          coalesce(array_to_string(list_filter(string_split(c.text, chr(10)), lambda x, i: NOT list_contains(h.nos, i)), chr(10)), '') END AS text
        FROM chunks c LEFT JOIN hit h USING (chunk_id)""",
    "p4_found": f"""WITH {_CLASSES}
        SELECT first_chunk_id, chunk_id FROM (
          SELECT chunk_id, min(chunk_id) OVER (PARTITION BY strategy, params_hash, label) AS first_chunk_id FROM labelled)
        WHERE chunk_id <> first_chunk_id""",
    "p6_found": """
        WITH v AS (
          SELECT content_hash AS h, CAST(embedding AS DOUBLE[]) AS v FROM embeddings_v1
          WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
            AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        near AS (
          SELECT a.h, b.h AS o, list_cosine_similarity(a.v, b.v) AS c FROM v a JOIN v b ON a.h <> b.h
          WHERE list_cosine_similarity(a.v, b.v) >= 0.9),
        top AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY c DESC, o) AS nth FROM near)
        SELECT DISTINCT least(h, o) AS content_hash_a, greatest(h, o) AS content_hash_b FROM top WHERE nth <= 5""",
    "p8_found": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
        i AS (SELECT item_id, w, least(12, len(w)) AS n FROM (
                SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM eval_items) WHERE len(w) > 0),
        ig AS (SELECT DISTINCT item_id, n, array_to_string(w[k : k + n - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS k FROM i)),
        dg AS (SELECT DISTINCT doc_id, n, array_to_string(w[k : k + n - 1], ' ') AS g FROM (
                SELECT d.doc_id, d.w, s.n, unnest(range(1, len(d.w) - s.n + 2)) AS k FROM d, (SELECT DISTINCT n FROM i) s))
        SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (n, g)""",
    "p4_counts": f"""WITH {_CLASSES}
        SELECT strategy, params_hash, min(chunk_id) AS chunk_id, count(*) AS copies
        FROM labelled GROUP BY strategy, params_hash, label HAVING count(*) > 1""",
}
