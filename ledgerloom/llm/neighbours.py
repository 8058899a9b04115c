"""Most similar vectors of every vector, by multi-index hashing.

Rotations learned from a bounded sample (alternating between the signs of the rotated vectors and the
orthogonal matrix that best maps the vectors to those signs) give each vector a binary code. The code is cut
into substrings, and each substring is an index of its own, probed for all codes whose substring differs in at
most ``PROBE`` bits. By the pigeonhole principle that retrieves every code within a Hamming radius of
``(PROBE + 1) * substrings - 1`` bits, and most beyond it. What is within the radius of the least cosine is
reranked by the floats.

Probing is spread by the same principle once more: a substring is cut into ``PROBE + 1`` parts, of which two
codes that differ in at most ``PROBE`` bits share one. So a row goes to one bucket for each part, and within a
bucket the other bits are probed. Substrings are as long as the logarithm of the number of vectors, so what a
probe finds doesn't grow with the table; the longer they are, the more there are of them, so that the chance to
miss a pair of the least cosine, ``(1 - P(Binomial(bits, angle / pi) <= PROBE)) ** substrings``, stays below
``MISS`` at any size. A pair is passed on by the first bucket that it meets in only.

Buckets of more than ``SPLIT`` rows are cut into blocks, every pair of which is a bucket of its own. A row that
has more than ``CROWD`` rows within the radius, or ``PROBED`` within reach of a probe, in one bucket is part of
the crowd there, and pairs of two such rows aren't passed on: the crowd is compared with itself once, every
pair of its blocks as one matrix product, exact and without a limit on its size. That costs the square of the
crowd, and only each vector's best of a block are passed on.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.session import durable

#: Vectors that the rotations are learned from, at most.
SAMPLE = 20_000
#: Chance, at most, that a pair of the least cosine is retrieved by no substring.
MISS = 0.005
#: Bits in which a probed substring may differ.
PROBE = 2
#: Rows of a bucket that one task takes.
SPLIT = 1_000_000
#: Rows near one row, and within reach of its probes, in one bucket; with more, it's part of the crowd.
CROWD, PROBED = 256, 8192
#: Rows of a crowd in one block, and blocks at most; with more rows blocks grow. Rows of a matrix at a time.
BLOCK, BLOCKS, TILE = 8192, 512, 1024
#: What single precision may be off in a cosine.
SLACK = 1e-5


def learn_rotation(x: np.ndarray, seed: int, rounds: int = 25) -> np.ndarray:
    """An orthogonal matrix that brings ``x`` near to its own signs; of no vectors, a random one."""
    turn, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((x.shape[1], x.shape[1])))
    for _ in range(rounds if len(x) else 0):
        u, _, v = np.linalg.svd(x.T @ np.where(x @ turn >= 0, 1.0, -1.0))
        turn = u @ v
    return turn


def reached(bits: int, cosine: float) -> float:
    """The chance that a substring of a pair of this cosine differs in at most ``PROBE`` bits."""
    p = np.arccos(cosine) / np.pi  # a bit differs with probability angle / pi
    return sum(math.comb(bits, i) * p**i * (1 - p) ** (bits - i) for i in range(PROBE + 1))


def substrings(bits: int, least: float) -> int:
    """How many substrings of ``bits`` bits miss a pair of cosine ``least`` with a chance of ``MISS`` at most."""
    chance = reached(bits, least)
    return 1 if chance >= 1 else max(1, math.ceil(math.log(MISS) / math.log1p(-chance)))


class Shape:
    """How codes are cut: ``count`` substrings of ``bits`` bits, each into ``PROBE + 1`` parts."""

    def __init__(self, size: int, least: float):
        self.bits = min(40, max(3 * (PROBE + 1), math.ceil(math.log2(max(2, size)))))
        self.count = substrings(self.bits, least)
        self.length = self.count * self.bits
        self.bytes = -(-self.length // 8)
        edges = [round(i * self.bits / (PROBE + 1)) for i in range(PROBE + 2)]
        self.parts = list(zip(edges, edges[1:], strict=False))
        p = np.arccos(least) / np.pi
        #: four standard deviations above what a pair of the least cosine differs in
        self.radius = math.ceil(self.length * p + 4 * math.sqrt(self.length * p * (1 - p)))

    def bucket(self, tab: int, part: int, value: np.ndarray) -> np.ndarray:
        """One number for substring, part and the part's bits."""
        return (np.int64(tab * len(self.parts) + part) << 20) + value

    def of(self, bucket: int) -> tuple[int, int]:
        return divmod(bucket >> 20, len(self.parts))


def usable(vectors: DataFrame, key: str, vector: str, dim: int) -> DataFrame:
    """``(id, v, rid)`` of the vectors with just ``dim`` finite components that aren't all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    nonzero = F.exists(vector, lambda x: x != 0)
    good = vectors.where(F.col(key).isNotNull() & (F.size(vector) == dim) & finite & nonzero)
    return good.select(F.col(key).alias("id"), F.col(vector).alias("v"), F.xxhash64(key, vector).alias("rid"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    scale = np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    x = np.divide(x, scale, out=np.zeros_like(x), where=scale > 0)
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, size, out=x, where=size > 0)


def _binary(rows: np.ndarray) -> pa.Array:
    """A binary value for each row of bytes."""
    ends = np.arange(len(rows) + 1, dtype="<i4") * rows.shape[1]
    return pa.BinaryArray.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(rows))])


def _encoded(base: DataFrame, rotations: list[np.ndarray], length: int, dim: int) -> DataFrame:
    """``(id, rid, same, code)``: ``same`` is a hash of the components, bit by bit."""
    sent = base.sparkSession.sparkContext.broadcast(np.concatenate(rotations, axis=1)[:, :length])
    kind = dict(base.dtypes)["id"]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                part = batch.slice(start, 2000)
                raw = np.ascontiguousarray(part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim))
                same = pa.array([xxhash.xxh3_128_digest(x) for x in raw], pa.binary())
                on = _matrix(part.column(1), dim) @ sent.value >= 0
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), same, _binary(np.packbits(on, axis=1))], names=["id", "rid", "same", "code"])

    return base.select("id", "v", "rid").mapInArrow(encode, f"id {kind}, rid long, same binary, code binary")


def _bits(codes: np.ndarray, low: int, high: int) -> np.ndarray:
    """Bits ``low`` to ``high`` of packed codes as numbers."""
    first = low // 8
    window = codes[:, first : -(-high // 8)].astype(np.uint64)
    number = np.zeros(len(codes), np.uint64)
    for i in range(window.shape[1]):
        number = number << np.uint64(8) | window[:, i]
    return (number >> np.uint64(-high % 8) & np.uint64((1 << (high - low)) - 1)).astype(np.int64)


def _records(batch: pa.RecordBatch, shape: Shape) -> np.ndarray:
    """Rows of ``(rid, code)`` as bytes."""
    rid = np.ascontiguousarray(batch.column(0).to_numpy()).view(np.uint8).reshape(-1, 8)
    codes = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, shape.bytes)
    return np.concatenate((rid, codes), axis=1)


def _bucket_sizes(codes: DataFrame, shape: Shape) -> dict[int, int]:
    """Blocks that buckets of more than ``SPLIT`` rows are cut into; buckets are few, as many as parts have values."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, int] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            own = _records(batch, shape)[:, 8:]
            for tab in range(shape.count):
                for part, (low, high) in enumerate(shape.parts):
                    keys, n = np.unique(shape.bucket(tab, part, _bits(own, tab * shape.bits + low, tab * shape.bits + high)), return_counts=True)
                    for key, m in zip(keys.tolist(), n.tolist(), strict=True):
                        sums[key] = sums.get(key, 0) + m
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array(list(sums.values()), pa.int64())], names=["bucket", "n"])

    sizes = codes.select("rid", "code").mapInArrow(tally, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    return {r.bucket: -(-r.n // SPLIT) for r in sizes.where(F.col("n") > SPLIT).collect()}


def _dealt(codes: DataFrame, shape: Shape, hot: dict[int, int]) -> DataFrame:
    """``(bucket, low, high, rows)``: records packed by bucket, and in hot ones by pair of blocks."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            records = _records(batch, shape)
            rid = batch.column(0).to_numpy()
            out: list[tuple[int, int, int, bytes]] = []
            for tab in range(shape.count):
                for part, (low, high) in enumerate(shape.parts):
                    key = shape.bucket(tab, part, _bits(records[:, 8:], tab * shape.bits + low, tab * shape.bits + high))
                    order = np.argsort(key, kind="stable")
                    names, first = np.unique(key[order], return_index=True)
                    for name, own in zip(names.tolist(), np.split(order, first[1:]), strict=True):
                        blocks = hot.get(name, 1)
                        if blocks == 1:
                            out.append((name, 0, 0, records[own].tobytes()))
                            continue
                        mine = rid[own] % blocks
                        for b in np.unique(mine).tolist():
                            rows = records[own[mine == b]].tobytes()
                            out.extend((name, min(b, c), max(b, c), rows) for c in range(blocks))
            columns = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.binary())],
                names=["bucket", "low", "high", "rows"],
            )

    return codes.select("rid", "code").mapInArrow(deal, "bucket long, low int, high int, rows binary")


def _masks(bits: int) -> list[int]:
    """Numbers of ``bits`` bits of which at most ``PROBE`` are set, 0 first."""
    return [sum(1 << i for i in on) for n in range(PROBE + 1) for on in combinations(range(bits), n)]


class _Bucket:
    """The rows of one or several buckets of one part of one substring, in order of bucket and other bits."""

    def __init__(self, shape: Shape, tab: int, part: int, names: np.ndarray, blocks: np.ndarray, records: np.ndarray):
        low, high = shape.parts[part]
        at = tab * shape.bits
        self.shape, self.tab, self.part = shape, tab, part
        self.free = shape.bits - (high - low)
        codes = records[:, 8:]
        rest = _bits(codes, at, at + low) << (shape.bits - high) | _bits(codes, at + high, at + shape.bits) if part else _bits(codes, at + high, at + shape.bits)
        key = names << self.free | rest
        order = np.argsort(key, kind="stable")
        self.key, self.blocks = key[order], blocks[order]
        self.rid = np.ascontiguousarray(records[order, :8]).view(np.int64).ravel()
        self.codes = codes[order]
        wide = np.zeros((len(order), -(-shape.bytes // 8) * 8), np.uint8)
        wide[:, : shape.bytes] = self.codes
        self.words = wide.view(np.uint64)

    def reach(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Rows and the range of later rows that one probe of each finds; every pair is found by one of its rows."""
        rows = np.arange(len(self.key))
        yield rows, rows + 1, np.searchsorted(self.key, self.key, "right")
        for mask in _masks(self.free)[1:]:
            up = np.flatnonzero(self.key & (1 << (mask.bit_length() - 1)) == 0)
            wanted = self.key[up] ^ mask
            low = np.searchsorted(self.key, wanted, "left")
            at = np.minimum(low, len(self.key) - 1)
            hit = self.key[at] == wanted
            up, low = up[hit], low[hit]
            if len(up):
                yield up, low, np.searchsorted(self.key, wanted[hit], "right")

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
        """Pairs ``(rid, rid)`` within the radius that meet here first, and rows of the crowd, with None."""
        n = len(self.key)
        if n < 2:
            return
        probes = list(self.reach()) if n * len(_masks(self.free)) < 40_000_000 else None
        load = np.zeros(n + 1, np.int64)
        for rows, low, high in probes or self.reach():
            load[rows] += high - low
            load += np.cumsum(np.bincount(low, minlength=n + 1) - np.bincount(high, minlength=n + 1))
        crowd = load[:n] > PROBED
        outside, where = np.concatenate(([0], np.cumsum(~crowd))), np.flatnonzero(~crowd)
        near_left, near_right = [], []
        for rows, low, high in probes or self.reach():
            own = ~crowd[rows]
            for left, right in _ranges(rows[own], low[own], high[own]):
                self._keep(left, right, near_left, near_right)
            # those of the crowd with rows outside it only
            for left, right in _ranges(rows[~own], outside[low[~own]], outside[high[~own]]):
                self._keep(left, where[right], near_left, near_right)
        left = np.concatenate([np.empty(0, np.int64), *near_left])
        right = np.concatenate([np.empty(0, np.int64), *near_right])
        count = np.bincount(left, minlength=n) + np.bincount(right, minlength=n)
        crowd |= count > CROWD
        if crowd.any():
            yield self.rid[crowd], None
            on = ~(crowd[left] & crowd[right])
            left, right = left[on], right[on]
        left, right = self._first(left, right)
        if len(left):
            yield self.rid[left], self.rid[right]

    def _keep(self, left, right, near_left, near_right) -> None:
        apart = self.blocks[left] != self.blocks[right]
        both = (self.blocks[left] == -1) | apart
        if not both.all():
            left, right = left[both], right[both]
        if not len(left):
            return
        off = np.zeros(len(left), np.uint16)
        for w in range(self.words.shape[1]):
            off += np.bitwise_count(self.words[left, w] ^ self.words[right, w])
        on = off <= self.shape.radius
        near_left.append(left[on])
        near_right.append(right[on])

    def _first(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pairs that no earlier substring or part brings together."""
        shape, keep = self.shape, np.ones(len(left), bool)
        for start in range(0, len(left), 100_000):
            a, b = left[start : start + 100_000], right[start : start + 100_000]
            off = np.unpackbits(self.codes[a] ^ self.codes[b], axis=1, count=shape.length).reshape(-1, shape.count, shape.bits)
            earlier = (off[:, : self.tab].sum(axis=2) <= PROBE).any(axis=1)
            for low, high in shape.parts[: self.part]:
                earlier |= ~off[:, self.tab, low:high].any(axis=1)
            keep[start : start + 100_000] = ~earlier
        return left[keep], right[keep]


def _ranges(rows: np.ndarray, low: np.ndarray, high: np.ndarray, most: int = 2_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Each row with each number of its range, some at a time."""
    sizes = high - low
    some = sizes > 0
    rows, low, sizes = rows[some], low[some], sizes[some]
    ends = np.cumsum(sizes)
    at = 0
    while at < len(rows):
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + most, "right")))
        n = sizes[at:to]
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        yield np.repeat(rows[at:to], n), np.repeat(low[at:to], n) + inside
        at = to


def _candidates(codes: DataFrame, shape: Shape) -> DataFrame:
    """``(ra, rb)``: pairs within the radius that a probe retrieves, each once; without ``rb`` a row of the crowd."""
    hot = _bucket_sizes(codes, shape)
    ordered = _dealt(codes, shape, hot).repartition("bucket", "low", "high").sortWithinPartitions("bucket", "low", "high")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple[tuple, bytes]] = []
        size = 0

        def found() -> Iterator[pa.RecordBatch]:
            by: dict[tuple[int, int], list] = {}
            for key, rows in kept:
                by.setdefault(shape.of(key[0]), []).append((key, rows))
            for (tab, part), own in by.items():
                numbers = {key: i for i, key in enumerate(dict.fromkeys(key for key, _ in own))}
                counts = [len(rows) // (8 + shape.bytes) for _, rows in own]
                records = np.frombuffer(b"".join(rows for _, rows in own), np.uint8).reshape(-1, 8 + shape.bytes)
                names = np.repeat([numbers[key] for key, _ in own], counts).astype(np.int64)
                # rows of two different blocks meet here, those of one meet in the bucket of that block
                mixed = np.repeat([key[1] != key[2] for key, _ in own], counts)
                rid = np.ascontiguousarray(records[:, :8]).view(np.int64).ravel()
                many = np.repeat([hot.get(key[0], 1) for key, _ in own], counts)
                block = np.where(mixed, rid % many, -1)
                for ra, rb in _Bucket(shape, tab, part, names, block, records).pairs():
                    other = pa.nulls(len(ra), pa.int64()) if rb is None else pa.array(np.maximum(ra, rb))
                    first = ra if rb is None else np.minimum(ra, rb)
                    yield pa.RecordBatch.from_arrays([pa.array(first), other], names=["ra", "rb"])

        for batch in batches:
            for *key, rows in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                key = tuple(key)
                # buckets are taken some at a time, and never in pieces
                if size > 1_000_000 and kept[-1][0] != key:
                    yield from found()
                    kept, size = [], 0
                kept.append((key, rows))
                size += len(rows)
        if kept:
            yield from found()

    return ordered.mapInArrow(search, "ra long, rb long")


def _best(owner: np.ndarray, near: np.ndarray, k: int) -> np.ndarray:
    """Whether each cosine is among its owner's ``k`` largest, as far as single precision can tell."""
    order = np.lexsort((-near, owner))
    first = np.concatenate(([0], np.flatnonzero(np.diff(owner[order])) + 1))
    sizes = np.diff(np.append(first, len(owner)))
    bar = near[order][first + np.minimum(sizes, k) - 1] - SLACK
    out = np.empty(len(owner), bool)
    out[order] = near[order] >= np.repeat(bar, sizes)
    return out


def _block_pairs(a: np.ndarray, b: np.ndarray | None, k: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``a`` and ``b`` (None: ``a`` itself) of pairs of unit vectors of at least ``least``.

    Of those, the ``k`` nearest of each vector of either block and all that are as near.
    """
    other = a if b is None else b
    rows, cols, cosines = [], [], []
    for i in range(0, len(a), TILE):
        for j in range(i if b is None else 0, len(other), TILE):
            near = a[i : i + TILE] @ other[j : j + TILE].T
            if b is None and i == j:
                np.fill_diagonal(near, -2)
            on = near >= least - SLACK
            hits = np.count_nonzero(on)
            if not hits:
                continue
            if hits > 4 * k * len(near):
                high, wide = near.shape
                by_row = np.partition(near, wide - min(k, wide), axis=1)[:, wide - min(k, wide), None]
                by_col = np.partition(near, high - min(k, high), axis=0)[high - min(k, high)]
                on &= (near >= by_row - SLACK) | (near >= by_col - SLACK)
            if b is None and i == j:  # each pair once
                on = np.triu(on | on.T, 1)
            r, c = np.nonzero(on)
            rows.append(r + i)
            cols.append(c + j)
            cosines.append(near[r, c])
    if not rows:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    row, col, near = np.concatenate(rows), np.concatenate(cols), np.concatenate(cosines)
    if b is None:  # a pair counts for both of its ends
        both = _best(np.concatenate((row, col)), np.concatenate((near, near)), k)
        on = both[: len(row)] | both[len(row) :]
    else:
        on = _best(row, near, k) | _best(col, near, k)
    return row[on], col[on]


def _crowd_pairs(crowd: DataFrame, size: int, dim: int, k: int, least: float) -> DataFrame:
    """``(ra, rb)``: of all pairs of ``(rid, v)`` of at least ``least``, each row's ``k`` nearest at least."""
    blocks = int(np.clip(-(-size // BLOCK), 1, BLOCKS))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1), dim).astype(np.float32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([y.tobytes() for y in x], pa.binary())], names=["rid", "x"])

    def compare(key: tuple, rows: pa.Table) -> pa.Table:
        x = np.frombuffer(b"".join(rows.column("x").to_pylist()), np.float32).reshape(-1, dim)
        rid, block = rows.column("rid").to_numpy(), rows.column("block").to_numpy()
        low, high = (np.flatnonzero(block == q.as_py()) for q in key)
        i, j = _block_pairs(x[low], None if key[0] == key[1] else x[high], k, least)
        left, right = rid[low[i]], rid[high[j]]
        return pa.table({"ra": np.minimum(left, right), "rb": np.maximum(left, right)})

    packed = crowd.select("rid", "v").mapInArrow(pack, "rid long, x binary").withColumn("block", F.pmod("rid", F.lit(blocks)))
    dealt = packed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    dealt = dealt.select(F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "rid", "x")
    return dealt.groupBy("low", "high").applyInArrow(compare, "ra long, rb long")


def similar_pairs(vectors: DataFrame, key: str, vector: str, dim: int, k: int = 5, least: float = 0.9) -> DataFrame:
    """``(a, b, cosine)``: pairs of at least ``least``, one of which is among the ``k`` most similar to the other.

    ``a`` is the smaller key. Vectors without ``dim`` finite components, zero vectors and null keys take no
    part; of rows that repeat a key, one does. Ties go to the smaller key. Vectors that are equal, bit by bit,
    go into the index as their ``k + 1`` smallest keys; all of them have those as most similar, so a group of
    ``n`` copies gives at most ``n * k`` pairs. An empty table gives none. Rows are known by 64 bits of a hash
    of key and vector, equal vectors by 128 bits. Vectors are read again for the reranking, not kept.
    """
    spark = vectors.sparkSession
    base = usable(vectors, key, vector, dim)
    size = base.count()
    if not size:
        return spark.createDataFrame([], f"a {dict(vectors.dtypes)[key]}, b {dict(vectors.dtypes)[key]}, cosine double")
    sample = base.select("v", "rid").orderBy("rid").limit(SAMPLE)
    learn = np.array(sample.toPandas().v.tolist(), dtype=np.float64).reshape(-1, dim)
    learn = learn / np.abs(learn).max(axis=1, keepdims=True)
    learn = learn / np.linalg.norm(learn, axis=1, keepdims=True)
    shape = Shape(size, least)
    rotations = [learn_rotation(learn, seed) for seed in range(-(-shape.length // dim))]

    chosen = F.min(F.struct("same", "rid", "code")).alias("c")
    one = durable(_encoded(base, rotations, shape.length, dim).groupBy("id").agg(chosen).select("id", "c.same", "c.rid", "c.code"))
    # copies: the k + 1 smallest keys of each group stand for it
    place = F.row_number().over(Window.partitionBy("same").orderBy("id"))
    leads = one.withColumn("place", place).where(F.col("place") <= k + 1)
    leads = durable(leads.select("id", "same", "place", "rid", F.when(F.col("place") == 1, F.col("code")).alias("code")))
    found = durable(_candidates(leads.where("place = 1").select("rid", "code"), shape))
    near = found.where("rb IS NOT NULL")
    few = found.where("rb IS NULL").select(F.col("ra").alias("rid")).distinct()
    if not few.isEmpty():
        crowd = durable(base.select("rid", "v").join(few, "rid").dropDuplicates(["rid"]))
        near = near.union(_crowd_pairs(crowd, crowd.count(), dim, k, least)).distinct()
    left = base.select(F.col("rid").alias("ra"), F.col("id").alias("a"), F.col("v").alias("va"))
    right = base.select(F.col("rid").alias("rb"), F.col("id").alias("b"), F.col("v").alias("vb"))
    scored = near.join(left, "ra").join(right, "rb").select("a", "b", cosine(F.col("va"), F.col("vb")).alias("cosine"))
    scored = durable(scored.where(F.col("cosine") >= least).distinct())

    # from groups of copies to vectors: a lead may be near to the leads of its own and of other groups
    # most groups are of one vector, and stand for themselves
    more = leads.where("place = 2").select("same")
    several = leads.join(more, "same").groupBy("same").agg(F.min("id").alias("g"), F.sort_array(F.collect_list("id")).alias("leads"))
    several = durable(several)
    named = several.select("g", "leads")
    both = scored.union(scored.select("b", "a", "cosine")).toDF("g", "h", "cosine")
    own = named.select("g", F.explode("leads").alias("near"), F.lit(1.0).alias("cosine"))
    other = both.join(named.toDF("h", "leads"), "h", "left").select("g", F.explode(F.coalesce("leads", F.array("h"))).alias("near"), "cosine")
    order = Window.partitionBy("g").orderBy(F.desc("cosine"), "near")
    best = other.union(own).withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k + 1)
    mine = best.join(named, "g", "left").select(F.explode(F.coalesce("leads", F.array("g"))).alias("id"), "near", "cosine").where("id <> near")
    top = mine.withColumn("nth", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("cosine"), "near")))
    top = top.where(F.col("nth") <= k).select("id", "near", "cosine")
    # the other copies of a group have k leads as good as can be
    full = several.where(F.size("leads") > k)
    rest = one.join(full, "same").where(~F.array_contains("leads", F.col("id")))
    rest = rest.select("id", F.explode(F.slice("leads", 1, k)).alias("near"), F.lit(1.0).alias("cosine"))
    ends = top.union(rest).select(F.least("id", "near").alias("a"), F.greatest("id", "near").alias("b"), "cosine")
    return ends.groupBy("a", "b").agg(F.max("cosine").alias("cosine"))


def cosine(x, y):
    """Cosine of two arrays of doubles, in the JVM."""
    x, y = x.cast("array<double>"), y.cast("array<double>")
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda s, t: s * t), F.lit(0.0), lambda s, t: s + t)
    return dot(x, y) / F.sqrt(dot(x, x) * dot(y, y))
