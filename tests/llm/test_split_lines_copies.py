from __future__ import annotations

import random
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerloom.llm import copies, lines, split
from ledgerloom.llm.text import count_tokens, folded, token_count

ODD = ["", "a_b", "élan 12345678901", "x\u200by\xad\ufeff z", "ab  c\n\u2003d", "日本語テキスト", "no\u00a0break, 5.5%!", "\U0001f600 ok", "1" * 17]


def fold(text):
    return "".join(c for c in text.lower() if c.isalnum())


def test_tokens_and_folding_agree_in_both_languages(spark):
    df = spark.createDataFrame([(t,) for t in ODD], "t string")
    for r in df.select("t", token_count(F.col("t")).alias("n"), folded(F.col("t")).alias("f")).collect():
        assert r.n == count_tokens(r.t) and r.f == fold(r.t), r.t
    assert count_tokens("abcdefghi, 12") == 4 and count_tokens("a_b") == 3 and count_tokens("\u200b \xad") == 0


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab1 .\n,é", max_size=600), st.integers(1, 40), st.integers(0, 12))
def test_pieces_keep_limit_overlap_and_text(text, limit, overlap):
    pieces = split.split_text(text, limit, overlap)
    lap = min(overlap, limit - 1)
    assert "".join(p[again:] for p, _, _, again in pieces) == text
    total = count_tokens(text)
    if total <= limit:
        assert len(pieces) == 1
        return
    assert all(tokens <= limit for _, tokens, _, _ in pieces)
    assert [count_tokens(p) for p, *_ in pieces] == [tokens for _, tokens, _, _ in pieces] or any(c.isalnum() for c in text)
    for before, after in zip(pieces, pieces[1:], strict=False):
        head = after[0][: after[3]]
        assert before[0].endswith(head)
        assert (count_tokens(head) == lap) or not lap or text[after[2] - 1 : after[2] + 1].isalnum() or len(head) < 9 * lap


def test_cuts_take_natural_ends():
    para = "One two three four five six seven. Eight nine ten eleven twelve."
    pieces = split.split_text("\n\n".join([para] * 6), 30)
    assert all(p.rstrip().endswith(".") for p, *_ in pieces) and len(pieces) >= 3
    assert all(p.startswith("One") for p, *_ in pieces)


def test_split_table_cases(spark):
    rows = [(1, "word " * 50, "S", 20, 5), (2, "word " * 20, "S", 20, 5), (3, None, "S", 20, 5), (4, "", None, 20, 5), (5, "word " * 50, None, None, 5), (6, "x" * 100_000, None, 100, None), (1, "word " * 50, "S", 20, 5)]
    df = spark.createDataFrame([(*r, "clash", 7) for r in rows], "chunk_id long, text string, section string, lim int, lap int, key string, piece int")
    got = split.split_oversized(df, "chunk_id", "text", "section", "lim", "lap").collect()
    by = defaultdict(list)
    for r in got:
        by[r.chunk_id].append(r)
    assert set(by) == {1, 6} and len(by[1]) == 2 * 3 or len(by[1]) % 2 == 0
    assert all(r.section == "S" and r.token_count <= 20 for r in by[1]) and all(r.token_count <= 100 for r in by[6])
    assert sum(r.token_count for r in by[6]) == 12_500
    assert split.split_oversized(df.limit(0), "chunk_id", "text", "section", "lim", "lap").count() == 0


def brute_lines(rows, sections, least=6):
    docs = defaultdict(set)
    skip = {fold(s) for s in sections if s}
    cases = []
    for item, source, doc, text in rows:
        if text is None or source is None or doc is None:
            continue
        for n, line in enumerate(text.split("\n"), 1):
            f = fold(line)
            if len(f) >= 16 and f not in skip:
                docs[source, f].add(doc)
                cases.append((item, n, source, f))
    return sorted((i, n) for i, n, s, f in cases if len(docs[s, f]) >= least)


def test_lines_against_brute_force(spark):
    rng = random.Random(4)
    pool = [f"Notice number {i} of the legal department" for i in range(12)] + ["Item 1A. Risk Factors here", "short", ""]
    vary = [str, str.upper, lambda x: x.replace(" ", "  ") + "!", lambda x: "\t" + x]
    rows = []
    for item in range(400):
        text = "\n".join(rng.choice(vary)(rng.choice(pool)) for _ in range(rng.randint(0, 5)))
        # one source holds most rows
        rows.append((item, 1 if rng.random() < 0.7 else rng.choice([2, 3, None]), rng.choice([*range(30), 2**40 + 7, None]), rng.choice([text, text, None, ""])))
    df = spark.createDataFrame([(*r, 0, 0) for r in rows], "item long, source long, doc_no long, text string, part int, line_no int")
    sections = ["item 1a risk factors here", None, ""]
    got = lines.repeated_lines(df, 6, 16, spark.createDataFrame([(s,) for s in sections], "s string"))
    assert sorted(map(tuple, got.collect())) == brute_lines(rows, sections)
    clean = lines.without_lines(df, "item", "text", got)
    hits = set(brute_lines(rows, sections))
    want = {i: None if t is None else "\n".join(x for n, x in enumerate(t.split("\n"), 1) if (i, n) not in hits) for i, _, _, t in rows}
    assert {r.item: r.text for r in clean.collect()} == want
    assert lines.repeated_lines(df.limit(0), 6, 16).count() == 0


def test_bitmaps_count_documents_once(spark):
    rows = [(i, 1, doc, "A line that is long enough") for i, doc in enumerate([5, 5, 5, 69, 70, 2**33])]
    df = spark.createDataFrame(rows, "item long, source long, doc_no long, text string")
    assert lines.repeated_lines(df, 4, 16).count() == 6 and lines.repeated_lines(df, 5, 16).count() == 0


def test_containers_hold_each_document_once(spark):
    # one line in 3000 documents of one source, in three ways of writing, and one in 7
    rows = [(i, 1, i // 2, ["A line of many documents", "A LINE of many documents", "a line, of many documents!"][i % 3]) for i in range(6000)]
    rows += [(9000 + i, 1, 4090 + i, "Another line of a few documents") for i in range(7)]
    df = spark.createDataFrame(rows, "item long, source long, doc_no long, text string")
    keyed = lines.with_places(lines.keyed_lines(df, 16))
    made = lines.containers(keyed, 6)
    kinds = sorted((r.chunk, r.positions is not None, r.words is not None) for r in made.collect())
    assert kinds == [(0, False, True), (0, True, False), (1, True, False)]
    total = lines.bitmap_bytes(made).first()
    assert total.documents == 3007 and total.bytes == 64 * 8 + 14
    dense = made.where("words is not null").first().words
    assert [i for i in range(4096) if dense[i // 64] >> (i % 64) & 1] == list(range(3000))
    assert lines.repeated_lines(df, 7, 16).count() == 6007 and lines.repeated_lines(df, 8, 16).count() == 6000


def test_numbers_are_dense_within_a_source(spark):
    rows = [(i, f"d{i // 2}", "7" if i < 900 else None if i > 995 else "08") for i in range(1000)]
    got = lines.filings(spark.createDataFrame(rows, "doc_id long, accession_no string, cik string")).collect()
    by = defaultdict(list)
    for r in got:
        by[r.source].append(r.doc_no)
    assert sorted(by[7]) == list(range(450)) and sorted(by[8]) == list(range(48)) and None not in by


def brute_copies(rows):
    import re

    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for k, s, t in rows:
        if t is None:
            continue
        parts = [p for p in re.split(r"[\n;|]", t) if p.strip()]
        parent[find((s, "chunk", k))] = find((s, "fold", fold(t)))
        if len(parts) >= 3 and all(":" in p or "=" in p for p in parts):
            parent[find((s, "fields", tuple(sorted(map(fold, parts)))))] = find((s, "fold", fold(t)))
    groups = defaultdict(list)
    for k, s, t in rows:
        if t is not None:
            groups[find((s, "chunk", k))].append(k)
    return sorted((min(g), k) for g in groups.values() for k in g if k != min(g))


def test_copies_against_brute_force(spark):
    rng = random.Random(9)
    fields = ["Name: X", "Type=Y", "Size: 3", "Size: 3", "Note: a b"]
    rows = []
    for k in range(300):
        kind = rng.random()
        if kind < 0.4:
            own = rng.sample(fields, rng.randint(2, 4))
            text = rng.choice(["; ", "\n", " | "]).join(own)
            if rng.random() < 0.3:
                text = text.upper().replace(":", "").replace("=", "") if rng.random() < 0.5 else text.upper()
        else:
            text = rng.choice(["Some text here", "some  TEXT, here.", "other", "", "...", " ", "é É", None, "long " * 5000])
        rows.append((k, rng.choice(["s", "s", "t", None]), text))
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "chunk_id long, strategy string, text string, first int, label string")
    got = copies.members(df, "chunk_id", "text", ["strategy"])
    assert sorted(map(tuple, got.collect())) == brute_copies(rows)
    classes = {r.class_first: r.class_copies for r in copies.copy_classes(df, "chunk_id", "text", ["strategy"]).collect()}
    sizes = defaultdict(int)
    for first, _ in brute_copies(rows):
        sizes[first] += 1
    assert classes == {f: n + 1 for f, n in sizes.items()}
    assert copies.members(df.limit(0), "chunk_id", "text", ["strategy"]).count() == 0


def test_chains_of_both_forms_are_one_class(spark):
    # 1 and 2 share fields, 2 and 3 share the folded text, 3 and 4 share fields of another cut
    rows = [(1, "s", "B: 2; A: 1; C: 3"), (2, "s", "A: 1; B: 2; C: 3"), (3, "s", "A: ;1B: 2; C: 3"), (4, "s", "C: 3; A:; 1B: 2"), (5, "s", "a1b2c3")]
    df = spark.createDataFrame(rows, "chunk_id long, strategy string, text string")
    assert sorted(map(tuple, copies.members(df, "chunk_id", "text", ["strategy"]).collect())) == [(1, k) for k in (2, 3, 4, 5)] == brute_copies(rows)
