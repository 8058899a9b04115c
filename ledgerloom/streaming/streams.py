"""Streams: a limiter with state for each client, and incremental chunks and vectors from arriving files."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ledgerloom.operators import catalog

WINDOW_S, MOST = 60.0, 30


def admit(kept: list[float], at: float, most: int = MOST, window: float = WINDOW_S) -> tuple[list[float], bool]:
    """Whether a hit at ``at`` is let in, given those that were; what is turned away isn't remembered."""
    kept = [t for t in kept if at - t <= window]
    if len(kept) >= most:
        return kept, False
    return [*kept, at], True


def _folded(rows: pd.DataFrame, kept: list[float], most: int, window: float) -> tuple[list[float], list[bool]]:
    out = []
    for at in rows["at"]:
        kept, ok = admit(kept, float(at), most, window)
        out.append(ok)
    return kept, out


def limited(hits: DataFrame, most: int = MOST, window: float = WINDOW_S) -> DataFrame:
    """``hits (client, hit_id, ts)`` with ``allowed``, for each client in order of time.

    What is let in depends on each hit before, so a client's hits are one fold; its state is ``most`` times
    at most, and hits come in sorted Arrow batches, so a busy client isn't held in memory.
    """
    kinds = dict(hits.dtypes)
    schema = f"client {kinds['client']}, hit_id {kinds['hit_id']}, ts timestamp, allowed boolean"
    rows = hits.select("client", "hit_id", "ts", F.unix_micros("ts").alias("micros"))
    rows = rows.repartition("client").sortWithinPartitions("client", "micros", "hit_id")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client, kept = None, []
        for frame in frames:
            allowed = []
            for who, micros in zip(frame["client"], frame["micros"], strict=True):
                if who != client:
                    client, kept = who, []
                kept, ok = admit(kept, micros / 1e6, most, window)
                allowed.append(ok)
            yield frame.drop(columns="micros").assign(allowed=allowed)

    return rows.mapInPandas(run, schema)


def limited_stream(hits: DataFrame, most: int = MOST, window: float = WINDOW_S) -> DataFrame:
    """The same over a stream; a client's state is the times let in, at most ``most``."""
    kinds = dict(hits.dtypes)
    schema = f"client {kinds['client']}, hit_id {kinds['hit_id']}, at double, allowed boolean"

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(frames)).sort_values(["at", "hit_id"], kind="stable")
        kept, allowed = _folded(rows, kept, most, window)
        state.update((kept,))
        yield rows.assign(client=key[0], allowed=allowed)[["client", "hit_id", "at", "allowed"]]

    rows = hits.select("client", "hit_id", (F.unix_micros("ts") / 1e6).alias("at"))
    return rows.groupBy("client").applyInPandasWithState(step, schema, "kept array<double>", "append", GroupStateTimeout.NoTimeout)


def embed_arrivals(chunks: DataFrame, store: catalog.Store, provider: catalog.Provider, table: str, checkpoint: str):
    """A stream of chunks, embedded where their hash has no vector yet; runs through what is there and ends.

    A batch that is run again after a failure finds its own vectors and adds none.
    """

    def batch(rows: DataFrame, _: int) -> None:
        have = store.read(table, "content_hash string, embedding array<float>, created_at timestamp")
        store.append(table, catalog.embedded(catalog.pending_embeddings(rows, have), provider))

    return chunks.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def new_documents(documents: DataFrame, late: str = "30 days") -> DataFrame:
    """A stream of documents without later deliveries of the same filing, within the watermark."""
    return documents.withWatermark("ingested_at", late).dropDuplicatesWithinWatermark(["accession_no"])


def windowed_latency(runs: DataFrame, size: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Runs, refusals and latency by window of event time, route and mode; late rows count until the watermark."""
    good = (F.col("latency_ms") >= 0) & ~F.isnan("latency_ms")
    keys = [F.window("ts", size), F.lower(F.trim("route")).alias("route"), F.lower(F.trim("mode")).alias("mode")]
    return runs.withWatermark("ts", late).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("runs"), F.count_if("refused").alias("refused"), F.sum(F.when(good, F.col("latency_ms"))).alias("total_ms"), F.count_if(good).alias("measured")
    )
