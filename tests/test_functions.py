from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from ledgerloom.functions import columns as fn
from ledgerloom.functions import english, html, sections

PAGE = """<html><head><title>No</title><style>p {}</style></head><body><script>var x;</script>
<ix:header><b>hidden</b></ix:header><h1>Harbour survey</h1><p>A&nbsp;“quoted” line – here</p>
<table><tr><td>Item 1.</td><td>Business</td><td>4</td></tr></table>
<p>Item 1. Business</p><p>See Item 1A for more.</p>
<table><tr><td>Cranes in use</td><td></td><td>17 of 20</td></tr><tr><td>outer <table><tr><td>in</td><td>ner</td></tr></table></td></tr></table>
<p>- 12 -</p><p>Item 1A. Risk Factors</p></body></html>"""


def test_html_keeps_tables_and_drops_the_rest():
    text = html.extract_text(PAGE)
    lines = text.split("\n")
    assert lines[0] == "Harbour survey" and 'A "quoted" line - here' in lines
    assert text.count("in | ner") == 1 and "Cranes in use | 17 of 20" in lines
    for gone in ("var x", "- 12 -", "hidden", "No\n"):
        assert gone not in text
    assert html.extract_text("") == "" and html.extract_text("<table><tr><td>open") == "open"
    assert html.decoded("é".encode()) == "é" and html.decoded("é".encode("cp1252")) == "é"


def test_sections_of_both_kinds(spark):
    ten_q = "PART I\nItem 1. Statements\nx\nItem 2. Discussion\nPART II\nItem 1. Legal\nItem 1A. Risks\ny"
    rows = [("k", html.extract_text(PAGE), "10-K"), ("q", ten_q, " 10-q/a"), ("e", "", "10-K"), ("n", None, "10-K"), ("b", "Item 7\nItem 7. Titled\nItem 7\nend", "10-K")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id string, text string, form_type string, start int, title string")
    got = sections.detect_sections(df).collect()
    keys = lambda d: [r.section_key for r in sorted((r for r in got if r.doc_id == d), key=lambda r: r.start)]
    assert keys("k") == ["1", "1A"] and keys("q") == ["I.1", "I.2", "II.1", "II.1A"] and keys("e") == keys("n") == []
    seven = next(r for r in got if r.doc_id == "b")
    assert (seven.title, seven.start, seven.label) == ("Titled", 7, "Item 7. Titled")
    texts = {r[0]: r[1] for r in rows}
    for r in got:
        assert texts[r.doc_id][r.start :].lower().startswith("item") and r.end <= len(texts[r.doc_id])
    rate = {r.form: (r.expected, r.found) for r in sections.hit_rate(df, sections.detect_sections(df)).collect()}
    assert rate == {"10-K": (20, 3)}


def test_scalar_functions(spark):
    df = spark.createDataFrame([("  a  b\n", " 00042 ", "0001-25-07", ""), ("a b", "x1", None, "2025-01-31")], "t string, c string, a string, d string")
    rows = df.select(fn.content_hash(F.col("t")).alias("h"), fn.cik_number(F.col("c")).alias("c"), fn.accession_nodash(F.col("a")).alias("a"), fn.iso_date(F.col("d")).alias("d")).collect()
    assert rows[0].h == rows[1].h == hashlib.sha256(b"a b").hexdigest()
    assert [r.c for r in rows] == [42, None] and rows[0].a == "00012507" and rows[0].d is None and str(rows[1].d) == "2025-01-31"
    assert fn.params_hash({"max_tokens": 350, "min_tokens": 24}) == "bb4c04092d51ba94"
    assert fn.params_hash({"min_tokens": 24, "size_tokens": 350, "overlap_tokens": 60}) == "23c8a23f9e030b1c"
    vec = df.select(fn.byte_vector(F.col("t")).alias("v"), fn.nibbles(F.col("t"), 64).alias("w")).first()
    assert abs(sum(x * x for x in vec.v) - 1) < 1e-12 and len(vec.w) == 64


def test_stemmer_and_queries():
    pairs = "caresses caress ponies poni cats cat agreed agre plastered plaster motoring motor sing sing conflated conflat hopping hop filing file happy happi relational relat rational ration vileli vile formaliti formal triplicate triplic hopeful hope adoption adopt probate probat controlling control"
    words = pairs.split()
    assert [english.stem(w) for w in words[0::2]] == words[1::2]
    where = lambda t: {s: [i for x, i in english.analyse(t) if x == s] for s, _ in english.analyse(t)}
    doc = where("The supply chain risks of the supplier grew; chain stores supply more.")
    rank = lambda q: english.rank(doc, english.parse_query(q))
    assert rank("supply chain") and rank('"supply chain"') and not rank('"chain supply"')
    assert rank("growth or risk") and rank("supply -growth") and not rank("supply -risk") and not rank("the of") and not rank("")
    near, far = english.cover_density([[1], [2]]), english.cover_density([[1], [9]])
    assert near > far > 0


def test_scans_are_dealt_out_where_the_session_says_so(spark, tmp_path):
    from ledgerloom.session import SPREAD, spread

    spark.range(10).coalesce(1).write.parquet(str(tmp_path / "t"))
    scan = spark.read.parquet(str(tmp_path / "t"))
    before = spark.conf.get(SPREAD)
    try:
        spark.conf.set(SPREAD, "3")
        assert spread(scan).rdd.getNumPartitions() == 3 and spread(scan).count() == 10
        spark.conf.unset(SPREAD)
        assert spread(scan) is scan
    finally:
        spark.conf.set(SPREAD, before)
