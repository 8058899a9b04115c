"""Processing only what is new or changed.

Every record has a sequence number. What has been processed is kept as disjoint closed intervals of
sequence numbers; a run subtracts them from what is available and processes the gaps, so a record that
arrives late, with a number below ones already done, is still a gap. Intervals are cut at multiples of
``2**BLOCK_BITS``, so each step works within blocks of bounded size and no step needs a global order.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BLOCK_BITS = 16


def to_intervals(numbers: DataFrame, column: str) -> DataFrame:
    """Disjoint intervals ``(block, lo, hi)`` that hold just the given numbers.

    Nulls are left out, repeated numbers count once, an empty input gives no interval.
    """
    n = F.col(column).cast("long")
    ids = numbers.select(F.shiftright(n, BLOCK_BITS).alias("block"), n.alias("n")).where("n is not null")
    # dense_rank gives repeated numbers the same island, so no separate distinct is needed
    island = F.col("n") - F.dense_rank().over(Window.partitionBy("block").orderBy("n"))
    return (
        ids.withColumn("island", island)
        .groupBy("block", "island")
        .agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
        .select("block", "lo", "hi")
    )


def merge_intervals(*parts: DataFrame) -> DataFrame:
    """The union of sets of intervals, overlapping and adjacent ones merged within each block."""
    return _sweep([(p, 1, 0) for p in parts], lambda a, _: a > 0)


def subtract_intervals(available: DataFrame, processed: DataFrame) -> DataFrame:
    """The parts of ``available`` that ``processed`` doesn't cover."""
    return _sweep([(available, 1, 0), (processed, 0, 1)], lambda a, p: (a > 0) & (p == 0))


def _sweep(parts: list, keep: Callable) -> DataFrame:
    events = None
    for df, a, p in parts:
        edges = df.select(
            "block",
            F.explode(
                F.array(
                    F.struct(F.col("lo").alias("at"), F.lit(a).alias("a"), F.lit(p).alias("p")),
                    F.struct((F.col("hi") + 1).alias("at"), F.lit(-a).alias("a"), F.lit(-p).alias("p")),
                )
            ).alias("e"),
        ).select("block", "e.at", "e.a", "e.p")
        events = edges if events is None else events.unionByName(edges)
    at = events.groupBy("block", "at").agg(F.sum("a").alias("a"), F.sum("p").alias("p"))
    order = Window.partitionBy("block").orderBy("at")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    spans = at.select(
        "block",
        "at",
        keep(F.sum("a").over(upto), F.sum("p").over(upto)).alias("kept"),
        F.lead("at").over(order).alias("next"),
    )
    # spans that touch become one again
    start = F.when(F.col("kept") & ~F.coalesce(F.lag("kept").over(order), F.lit(False)), F.col("at"))
    runs = spans.withColumn("lo", F.last(start, ignorenulls=True).over(upto)).where("kept")
    return runs.groupBy("block", "lo").agg((F.max("next") - 1).alias("hi")).select("block", "lo", "hi")


def numbers_in(intervals: DataFrame, name: str = "n") -> DataFrame:
    """The numbers in the intervals, one row each; an interval has at most ``2**BLOCK_BITS``."""
    return intervals.select(F.explode(F.sequence("lo", "hi")).alias(name))


def pending(available: DataFrame, processed: DataFrame, column: str) -> DataFrame:
    """Sequence numbers of ``available`` that are not among those of ``processed``."""
    gaps = subtract_intervals(to_intervals(available, column), to_intervals(processed, column))
    return numbers_in(gaps, column)


def succeeded_state(manifest: DataFrame, runs: DataFrame) -> DataFrame:
    """Per chunk key, the content hash that the latest successful run wrote down.

    Latest by the start of the run, then by run number; of several rows of that run for one key, the
    last processed. What failed or unfinished runs wrote is left out.
    """
    done = runs.where(F.col("status") == "succeeded").select("run_id", "started_at").dropDuplicates(["run_id"])
    rows = manifest.select(*_key(), "run_id", "processed_at", _hash().alias("content_hash"))
    latest = F.max(F.struct("started_at", "run_id", "processed_at", "content_hash")).alias("latest")
    return rows.join(done, "run_id").groupBy(*KEY).agg(latest).select(*KEY, F.col("latest.content_hash").alias("seen"))


KEY = ("document", "strategy", "params_hash", "ordinal")


def _key() -> list:
    return [F.translate(F.trim("document_id"), "-", "").alias("document"), *KEY[1:]]


def _hash():
    return F.lower(F.trim("content_hash"))


def pending_chunks(chunks: DataFrame, manifest: DataFrame, runs: DataFrame) -> DataFrame:
    """``chunk_id`` of the chunks that are new or differ from what was last processed successfully.

    The chunk's number is its sequence number. Chunks whose key and hash agree with the state of the
    manifest are processed; their numbers become intervals, which are subtracted from those of all
    chunks. A null in a key or in a hash agrees with null only. A null ``chunk_id`` can't be asked for
    and doesn't come out.
    """
    state = succeeded_state(manifest, runs)
    mine = chunks.select("chunk_id", *_key(), _hash().alias("content_hash"))
    same = F.col("m.content_hash").eqNullSafe(F.col("s.seen"))
    for k in KEY:
        same = same & F.col(f"m.{k}").eqNullSafe(F.col(f"s.{k}"))
    processed = mine.alias("m").join(state.alias("s"), same, "left_semi")
    return pending(mine, processed, "chunk_id")


class IncrementalRun:
    """A sink that processes each record once, and again when its content changes, whatever fails in between.

    A run writes its output, what it saw and the merged intervals into a folder of its own, and then creates
    one marker file under the next number, which names that folder and the commit that it followed; that
    creation is the commit, for all at once. A run that dies before leaves only a folder that nobody reads,
    and the next run takes the same gaps again. Of two runs that race for one number, one creates the marker
    and the other fails with ``FileExistsError``; nothing of the loser is read. What counts are the markers
    that are reached from the last one, so a marker that was created but never filled is passed over.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        path = spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        self._fs = path.getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, *parts):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.folder, *map(str, parts)]))

    def _markers(self) -> dict[int, tuple[str, int]]:
        """Per number the run's folder and the number that it followed, of markers that have both."""
        if not self._fs.exists(self._path("commits")):
            return {}
        out = {}
        for f in self._fs.listStatus(self._path("commits")):
            name = f.getPath().getName()
            if name.isdigit():
                stream = self._fs.open(f.getPath())
                words = bytes(stream.readAllBytes()).decode().split()
                stream.close()
                if len(words) == 2:
                    out[int(name)] = words[0], int(words[1])
        return out

    def _chain(self) -> list[tuple[int, str]]:
        """The commits that count, in order, with their folders."""
        known = self._markers()
        chain, at = [], max(known, default=-1)
        while at >= 0:
            run, before = known[at]
            chain.append((at, f"{self.folder}/runs/{run}"))
            at = before
        return chain[::-1]

    def commits(self) -> list[int]:
        return [n for n, _ in self._chain()]

    def processed(self) -> DataFrame:
        chain = self._chain()
        if not chain:
            return self.spark.createDataFrame([], "block long, lo long, hi long")
        return self.spark.read.parquet(f"{chain[-1][1]}/intervals")

    def output(self) -> DataFrame | None:
        """All that was written; a record that changed has a result for each time that it was processed."""
        chain = self._chain()
        return self.spark.read.parquet(*[f"{at}/output" for _, at in chain]) if chain else None

    def _seen(self, chain: list[tuple[int, str]]) -> DataFrame:
        """``(n, version)``: the version that each number was last processed in."""
        parts = [self.spark.read.parquet(f"{at}/seen").withColumn("commit", F.lit(n)) for n, at in chain]
        every = reduce(DataFrame.unionByName, parts)
        return every.groupBy("n").agg(F.max_by("version", "commit").alias("version"))

    def run(self, records: DataFrame, column: str, process: Callable[[DataFrame], DataFrame], version: str | None = None) -> int:
        """Processes what is new or changed and commits; gives the number of the commit, or -1 if there was nothing.

        ``version`` names a column that changes with the content, a hash as a rule: a record whose version
        isn't the one last processed under its number is taken again. Without it only new numbers count.
        A null number can't be asked for and is left out.
        """
        chain = self._chain()
        last = chain[-1][0] if chain else -1
        own = f"{self.folder}/runs/{uuid.uuid4().hex}"
        done = self.processed()
        if version is not None and chain:
            now = records.select(F.col(column).cast("long").alias("n"), F.col(version).cast("string").alias("now"))
            changed = now.join(self._seen(chain), "n").where(~F.col("now").eqNullSafe(F.col("version")))
            done = subtract_intervals(done, to_intervals(changed, "n"))
        subtract_intervals(to_intervals(records, column), done).write.parquet(f"{own}/gaps")
        gaps = self.spark.read.schema("block long, lo long, hi long").parquet(f"{own}/gaps")
        if gaps.isEmpty():
            self._fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(own), True)
            return -1
        todo = records.join(numbers_in(gaps, column), column, "left_semi")
        process(todo).write.parquet(f"{own}/output")
        mark = F.col(version).cast("string") if version is not None else F.lit(None).cast("string")
        todo.select(F.col(column).cast("long").alias("n"), mark.alias("version")).write.parquet(f"{own}/seen")
        merge_intervals(self.processed(), gaps).write.parquet(f"{own}/intervals")
        number = max([*self._numbers(), -1]) + 1
        if (chain[-1:] or [(-1, "")]) != (self._chain()[-1:] or [(-1, "")]):
            raise FileExistsError(f"another run committed after {last}")
        self._claim(number, f"{own.rsplit('/', 1)[1]} {last}")
        return number

    def _numbers(self) -> list[int]:
        """Numbers that have a marker, filled or not."""
        if not self._fs.exists(self._path("commits")):
            return []
        return [int(f.getPath().getName()) for f in self._fs.listStatus(self._path("commits")) if f.getPath().getName().isdigit()]

    def _claim(self, number: int, text: str) -> None:
        """Creates the marker, or fails if it is there."""
        self._fs.mkdirs(self._path("commits"))
        if self._fs.getUri().getScheme() == "file":  # Hadoop's local file system looks first and creates then
            with open(self._fs.makeQualified(self._path("commits", number)).toUri().getPath(), "x") as f:
                f.write(text)
            return
        try:
            stream = self._fs.create(self._path("commits", number), False)
        except Py4JJavaError as e:
            raise FileExistsError(f"another run took number {number}") from e
        stream.write(bytearray(text.encode()))
        stream.close()
