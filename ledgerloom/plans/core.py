"""The general training-data query: processing only new or changed records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.operators import incremental
from ledgerloom.session import table


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return incremental.pending_chunks(
        table(spark, folder, "chunks"), table(spark, folder, "chunk_manifest"), table(spark, folder, "pipeline_runs")
    ).select("chunk_id")


QUERIES = {"p7_found": p7_found}

ORACLE = {
    "p7_found": """
        WITH state AS (
          SELECT replace(trim(m.document_id), '-', '') AS document, m.strategy, m.params_hash, m.ordinal,
                 lower(trim(m.content_hash)) AS seen,
                 row_number() OVER (
                   PARTITION BY replace(trim(m.document_id), '-', ''), m.strategy, m.params_hash, m.ordinal
                   ORDER BY r.started_at DESC, m.run_id DESC, m.processed_at DESC, lower(trim(m.content_hash)) DESC) AS nth
          FROM chunk_manifest m JOIN pipeline_runs r ON r.run_id = m.run_id AND r.status = 'succeeded')
        SELECT c.chunk_id
        FROM chunks c LEFT JOIN state s
          ON s.nth = 1 AND s.document = replace(trim(c.document_id), '-', '') AND s.strategy = c.strategy
         AND s.params_hash = c.params_hash AND s.ordinal = c.ordinal
        WHERE s.seen IS NULL OR s.seen <> lower(trim(c.content_hash))""",
}
