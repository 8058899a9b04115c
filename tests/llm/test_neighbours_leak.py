from __future__ import annotations

import random

import numpy as np

from ledgerloom.llm import leak, neighbours as nb


def brute_pairs(rows, dim, k=5, least=0.9):
    keep = {}
    for key, v in rows:
        if key is None or v is None or len(v) != dim or not all(x is not None and np.isfinite(x) for x in v) or not any(v):
            continue
        keep.setdefault(key, v)
    keys = sorted(keep)
    if not keys:
        return set()
    x = np.array([keep[q] for q in keys], dtype=np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    sims = np.round(x @ x.T, 9)
    out = set()
    for i in range(len(keys)):
        order = sorted((j for j in range(len(keys)) if j != i), key=lambda j: (-sims[i, j], j))[:k]
        out |= {tuple(sorted((keys[i], keys[j]))) for j in order if sims[i, j] >= least}
    return out


def vectors(spark, rows):
    return spark.createDataFrame([(*r, 1, 2) for r in rows], "content_hash string, embedding array<float>, tab int, v int")


def test_pairs_against_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = []
    for c in range(60):
        centre = rng.standard_normal(64)
        for m in range(rng.integers(1, 5)):
            v = centre + rng.standard_normal(64) * rng.uniform(0.05, 0.3)
            rows.append((f"k{c:03d}{m}", (v * rng.uniform(0.01, 40)).tolist()))
    rows += [(f"r{i:04d}", rng.standard_normal(64).tolist()) for i in range(800)]
    rows += [("zero", [0.0] * 64), ("nan", [float("nan")] * 64), ("short", [1.0] * 63), ("inf", [float("inf")] + [1.0] * 63), ("null", None), (None, [1.0] * 64), rows[0], ("hole", [None] + [1.0] * 63)]
    got = {(r.a, r.b) for r in nb.similar_pairs(vectors(spark, rows), "content_hash", "embedding", 64).collect()}
    need = brute_pairs(rows, 64)
    assert len(got & need) >= 0.97 * len(need) and got <= need


def test_many_copies_stay_linear(spark):
    rng = np.random.default_rng(6)
    one = rng.standard_normal(64).tolist()
    rows = [(f"c{i:04d}", one) for i in range(300)] + [(f"r{i:04d}", rng.standard_normal(64).tolist()) for i in range(300)]
    rows.append(("near", (np.array(one) + 0.01).tolist()))
    got = {(r.a, r.b) for r in nb.similar_pairs(vectors(spark, rows), "content_hash", "embedding", 64).collect()}
    assert got == brute_pairs(rows, 64) and len(got) <= 5 * 302


def test_a_hot_bucket_is_searched(spark):
    # a third of all rows in one narrow cone
    rng = np.random.default_rng(7)
    centre = rng.standard_normal(64)
    rows = [(f"h{i:05d}", (centre + 0.28 * rng.standard_normal(64)).tolist()) for i in range(1500)] + [(f"r{i:05d}", rng.standard_normal(64).tolist()) for i in range(1500)]
    got = {(r.a, r.b) for r in nb.similar_pairs(vectors(spark, rows), "content_hash", "embedding", 64).collect()}
    need = brute_pairs(rows, 64)
    assert len(got & need) >= 0.9 * len(need)


def nearest_pairs(x, k=5, least=0.9):
    x = x / np.linalg.norm(x, axis=1)[:, None]
    sims = x @ x.T
    np.fill_diagonal(sims, -2)
    order = np.argsort(-sims, axis=1)[:, :k]
    return {(min(i, j), max(i, j)) for i in range(len(x)) for j in order[i].tolist() if sims[i, j] >= least}


def test_a_crowd_is_compared_whole(spark):
    # far more rows in one cone than a bucket has, in several blocks
    rng = np.random.default_rng(17)
    cone = rng.standard_normal(64) + 0.28 * rng.standard_normal((2000, 64))
    x = np.concatenate((cone, rng.standard_normal((4000, 64)))).astype(np.float32).astype(float)
    before, nb.BLOCK = getattr(nb, "BLOCK", None), 700
    try:
        got = nb.similar_pairs(vectors(spark, [(f"{i:05d}", v) for i, v in enumerate(x.tolist())]), "content_hash", "embedding", 64).collect()
    finally:
        nb.BLOCK = before
    need = nearest_pairs(x)
    assert len(need) > 7000 and {(int(r.a), int(r.b)) for r in got} == need


def test_pairs_of_the_least_cosine_are_met(spark):
    rng = np.random.default_rng(18)
    x = rng.standard_normal((20_000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    # every vector below 1000 has one at a cosine of 0.901
    side = rng.standard_normal((1000, 64))
    side -= (side * x[:1000]).sum(axis=1)[:, None] * x[:1000]
    side /= np.linalg.norm(side, axis=1)[:, None]
    x[1000:2000] = 0.901 * x[:1000] + np.sqrt(1 - 0.901**2) * side
    got = nb.similar_pairs(vectors(spark, [(f"{i:05d}", v) for i, v in enumerate(x.tolist())]), "content_hash", "embedding", 64).collect()
    assert len({(i, i + 1000) for i in range(1000)} & {(int(r.a), int(r.b)) for r in got}) >= 980


def test_probing_finds_all_within_the_pigeonhole_radius():
    rng = np.random.default_rng(3)
    shape = nb.Shape(5000, 0.9)
    bits = rng.integers(0, 2, (3000, shape.length)).astype(np.uint8)
    # partners at all distances up to the radius that is sure
    sure = (nb.PROBE + 1) * shape.count - 1
    for i in range(1500):
        bits[1500 + i] = bits[i]
        off = rng.choice(shape.length, rng.integers(0, sure + 1), replace=False)
        bits[1500 + i, off] ^= 1
    records = np.concatenate((np.arange(3000, dtype=np.int64).view(np.uint8).reshape(-1, 8), np.packbits(bits, axis=1)), axis=1)
    met = []
    for tab in range(shape.count):
        for part, (low, high) in enumerate(shape.parts):
            value = nb._bits(records[:, 8:], tab * shape.bits + low, tab * shape.bits + high)
            _, names = np.unique(value, return_inverse=True)
            bucket = nb._Bucket(shape, tab, part, names, np.full(3000, -1), records)
            for ra, rb in bucket.pairs():
                met += list(zip(np.minimum(ra, rb).tolist(), np.maximum(ra, rb).tolist(), strict=True))
    assert len(met) == len(set(met)) and {(i, i + 1500) for i in range(1500)} <= set(met)
    assert all((bits[a] ^ bits[b]).sum() <= shape.radius for a, b in met)


def test_recall_by_the_model_holds_at_any_size():
    for size in (10**3, 10**5, 10**6, 10**8, 10**10):
        shape = nb.Shape(size, 0.9)
        assert (1 - nb.reached(shape.bits, 0.9)) ** shape.count <= nb.MISS


def test_split_buckets_and_a_small_crowd_give_the_same(spark):
    rng = np.random.default_rng(21)
    cone = rng.standard_normal(64) + 0.3 * rng.standard_normal((500, 64))
    x = np.concatenate((cone, rng.standard_normal((700, 64)), np.repeat(rng.standard_normal((4, 64)), 9, axis=0))).astype(np.float32)
    df = vectors(spark, [(f"{i:05d}", v) for i, v in enumerate(x.tolist())])
    pairs = lambda: {(r.a, r.b) for r in nb.similar_pairs(df, "content_hash", "embedding", 64).collect()}
    need = brute_pairs([(f"{i:05d}", v) for i, v in enumerate(x.tolist())], 64)
    before = nb.SPLIT, nb.CROWD, nb.PROBED
    for nb.SPLIT, nb.CROWD, nb.PROBED in ((40, 10**6, 10**6), (90, 20, 10**6), (10**6, 10**6, 30)):
        got = pairs()
        assert len(got & need) >= 0.99 * len(need), (nb.SPLIT, len(got & need), len(need))
    nb.SPLIT, nb.CROWD, nb.PROBED = before


def test_no_vectors(spark):
    empty = vectors(spark, [("zero", [0.0] * 64)])
    assert nb.similar_pairs(empty, "content_hash", "embedding", 64).count() == 0
    assert nb.similar_pairs(empty.limit(0), "content_hash", "embedding", 64).columns == ["a", "b", "cosine"]


def brute_leaks(docs, items, run=12):
    out = []
    for key, text in docs:
        own = leak.words(text) if text else []
        for item, t in items:
            w = leak.words(t) if t else []
            n = min(run, len(w))
            grams = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
            if any(tuple(own[i : i + n]) in grams for i in range(len(own) - n + 1)):
                out.append((key, item))
    return sorted(out)


def test_leaks_against_brute_force(spark):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(40)] + ["a", "É", "b"]
    some = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, some(rng.choice([1, 2, 3, 5, 7, 9, 11, 12, 13, 20, 40]))) for i in range(40)]
    docs = []
    for k in range(300):
        own = some(rng.randint(0, 120))
        for _ in range(rng.randint(0, 3)):
            w = rng.choice(items)[1]
            n = rng.choice([len(w), 11, 12, 13])
            at = rng.randint(0, max(0, len(w) - n))
            low = rng.randint(0, len(own))
            own[low:low] = w[at : at + n]
        join = rng.choice([" ", ", ", "-", "\n\n"])
        docs.append((k, join.join(own).upper() if rng.random() < 0.3 else join.join(own)))
    docs += [(900, None), (901, ""), (902, "?!"), (903, " ".join(items[-1][1] * 2000)), (0, docs[0][1])]
    texts = [(i, " ".join(w)) for i, w in items] + [(77, None), (78, "!"), (79, "")]
    corpus = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, item_id int")
    wanted = spark.createDataFrame(texts, "item_id long, text string")
    got = leak.leaked_items(corpus, wanted)
    assert sorted((r.doc_id, r.item_id) for r in got.collect()) == brute_leaks(docs, texts)
    assert leak.leaked_items(corpus.limit(0), wanted).count() == 0 and leak.leaked_items(corpus, wanted.limit(0)).count() == 0
    # several blocks give the same
    before, leak.BLOCK_WORDS = leak.BLOCK_WORDS, 60
    try:
        assert sorted((r.doc_id, r.item_id) for r in leak.leaked_items(corpus, wanted).collect()) == brute_leaks(docs, texts)
    finally:
        leak.BLOCK_WORDS = before


def test_every_long_run_shares_a_place():
    rng = np.random.default_rng(9)
    for _ in range(200):
        a, b, shared = (rng.integers(0, 1000, n).astype(np.uint64) for n in (30, 25, 12))
        x, y = np.concatenate((a, shared, b)), np.concatenate((b[:7], shared, a))
        k, w = 7, 6
        hx, hy = leak.grams(x, k), leak.grams(y, k)
        assert set(hx[leak.winnowed(hx, w)].tolist()) & set(hy[leak.winnowed(hy, w)].tolist())
