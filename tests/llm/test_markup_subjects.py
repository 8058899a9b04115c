from __future__ import annotations

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import markup, subjects
from ledgerloom.llm.boost import Boosted

FOUND = [
    ("html", "A <b>bold</b> word"), ("html", "a&nbsp;b"), ("html", "<!-- x -->"), ("html", "line<br/>line"), ("html", "<TABLE><TR><TD>1</TD></TR></TABLE>"), ("html", "stray </td> in text"), ("html", "it&#8217;s"),
    ("markdown", "# Heading"), ("markdown", "Title\n====="), ("markdown", "a **bold** word"), ("markdown", "an *emphatic* word"), ("markdown", "some `code` here"), ("markdown", "a [link](https://x.example/1) here"),
    ("markdown", "![Pic](images/f.png)"), ("markdown", "```python\nx = a_b / 2\n```"), ("markdown", "| a | b |\n|---|---:|\n| 1 | 2 |"), ("markdown", "> quoted words here"),
    ("wiki", "== Heading =="), ("wiki", "an ''italic'' word"), ("wiki", "a [[Link|label]] here"), ("wiki", "{{Infobox|a=1}}"), ("wiki", '{| class="wikitable"\n! a !! b\n|-\n| 1 || 2\n|}'), ("wiki", "[[Category:Things]]"),
    ("latex", "\\textbf{bold} word"), ("latex", "grew by 5.2\\% in"), ("latex", "$x_{1} = \\frac{2}{3}$"), ("latex", "\\begin{itemize}\n\\item one\n\\end{itemize}"), ("latex", "\\[ x_{1} \\leq 5 \\]"), ("latex", "as shown~\\cite{abc12}"), ("latex", "\\S Skellmere 12"),
]
PLAIN = [
    "R&D; and P&L at AT&T", "fell < 5% and rose > 7%", "volume <92,064 or price >87,830", "from $5 million to $6 million & more", "see note [8,570] and [12]", "Ranked #151 by volume", "cost_center_code holds",
    "C:\\finance\\Marmarja\\2022.", "5*9,081 and 2*41,926", "assets == liabilities == 716", "Totals** for a exclude, and margins** for b (** see note 5)", "* Includes 45,415 of items", "• point one\n• point two",
    "Net income | Quessa | $5 | $6\nCash | Jorvale | $7 | $8", "about ~ 10.7% of the total", "- one\n- two", "1. one\n2. two", "the '90s and 'quoted' words", "", "   ",
]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "x", 3) for i, t in enumerate(texts)], "chunk_id long, text string, kind string, at int")


def test_constructs_and_everyday_signs(spark):
    texts = [t for _, t in FOUND] + PLAIN + [None, "long words " * 20_000 + "**end**", FOUND[0][1]]
    got = {(r.chunk_id, r.kind) for r in markup.markup_kinds(frame(spark, texts)).collect()}
    want = {(i, k) for i, (k, _) in enumerate(FOUND)} | {(len(texts) - 2, "markdown"), (len(texts) - 1, "html")}
    assert got == want
    assert markup.markup_kinds(frame(spark, ["x"]).limit(0)).count() == 0


def test_several_languages_in_one_text():
    text = "<p>Funds \\emph{board} of '''credit''' and `code`</p>"
    assert {n.kind for n in markup.constructs([text], markup.model())[0]} == {"html", "latex", "wiki", "markdown"}


@pytest.mark.parametrize(
    "text, clean",
    [
        ("<h3>Note 1</h3>\n<ul>\n<li>one</li>\n</ul>", "Note 1\n\n- one"), ("a&nbsp;b &amp; c", "a b & c"), ("# Head\n\ntext **x** [y](https://z.example/)", "Head\n\ntext x y"), ("```python\na_b = *c*\n```", "a_b = *c*"),
        ("== H ==\n[[A|b]] ''c''", "H\nb c"), ("{|\n! a !! b\n|-\n| 1 || 2\n|}", "a | b\n1 | 2"), ("\\textbf{x} is 5\\%", "x is 5%"), ("r is $x_{1} = \\frac{2}{3}$.", "r is x_{1} = \\frac{2}{3}."), ("| a | b |\n|---|---|\n| 1 | 2 |", "a | b\n\n1 | 2"),
    ],
)
def test_clean_text_keeps_structure(text, clean):
    out = markup.clean(text, markup.constructs([text], markup.model())[0])
    squeeze = lambda t: "\n".join(x.strip() for x in t.split("\n") if x.strip())
    assert squeeze(out) == squeeze(clean)


def test_cleaning_leaves_plain_texts_alone(spark):
    rows = markup.clean_markup(frame(spark, [*PLAIN, None])).orderBy("chunk_id").collect()
    assert [r.text for r in rows] == [*PLAIN, None] and all(r.kinds == [] for r in rows)


def test_formulas_of_plain_letters_are_read(spark):
    texts = ["where $x$ is the price", "the $n$ firms", "from $5 to $6", "$ 5 and $ 6"]
    assert {(r.chunk_id, r.kind) for r in markup.markup_kinds(frame(spark, texts)).collect()} == {(0, "latex"), (1, "latex")}
    assert [markup.signs_in(t) for t in texts] == [True, True, False, False]


def test_decoding_weighs_a_node_against_what_is_in_it():
    text = "from $12 <b>net</b> to $14"
    nodes = markup.parse(text)
    names = lambda odds: [n.name for n, k in zip(nodes, markup.decode(nodes, np.array([odds[n.name] for n in nodes])), strict=True) if k]
    assert [n.name for n in nodes] == ["formula", "tag", "tag"]
    assert names({"formula": 3.0, "tag": 2.0}) == ["tag", "tag"] and names({"formula": 5.0, "tag": 2.0}) == ["formula"]
    assert names({"formula": -1.0, "tag": 2.0}) == ["tag", "tag"] and names({"formula": 1.0, "tag": -2.0}) == ["formula"]
    # what the trees say
    assert [n.name for n in markup.constructs([text], markup.model())[0]] == ["tag", "tag"]
    assert [n.name for n in markup.constructs(["use `<b>` here"], markup.model())[0]] == ["code"]


def test_the_trees_decide():
    class Refusing:
        def margin(self, x):
            return -np.ones(len(x))

    class Taking:
        def margin(self, x):
            return np.ones(len(x))

    texts = [t for _, t in FOUND]
    assert not any(markup.constructs(texts, Refusing()))
    plain = [t for t in PLAIN if t.strip()]
    assert sum(map(bool, markup.constructs(plain, Taking()))) >= 6 and not any(markup.constructs(plain, markup.model()))


def test_elements_are_those_of_a_dom():
    text = "<div><p>one <b>two</b></p><p>three</p></div></i>"
    tags = [n for n in markup.parse(text) if n.name == "tag"]
    assert [(n.key, n.depth, n.elements, n.close is not None) for n in tags if text[n.start + 1] != "/"] == [("div", 0, 2, True), ("p", 1, 1, True), ("b", 2, 0, True), ("p", 1, 0, True)]
    assert tags[-1].close is None


@pytest.mark.parametrize("mark", ["\\begin{a} ", "<!-- ", "``` \n", "![", "{| \n", "\\( ", "$$ ", "** ", "\\a[", "[http://a ", "$_ ", "| :", " "])
def test_marks_without_an_end_cost_no_more_than_others(mark):
    began = time.perf_counter()
    markup.parse(mark * 8000)
    markup.signs_in(mark * 8000)
    assert time.perf_counter() - began < 2  # 0.1 s alone on a core; quadratic patterns took up to 5.5 s at this size


def test_held_out_accuracy():
    trees = markup.model()
    for noise, least in ((False, 0.995), (True, 0.985)):
        rng = random.Random(99)
        rows = [row for _ in range(300) for row in markup._labelled(rng, noise)]
        said = trees.margin(np.array([x for x, _ in rows], dtype=float)) > 0
        assert (said == np.array([y for _, y in rows])).mean() > least


def test_boosted_trees_learn_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.uniform(-1, 1, (2000, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.2)).astype(float)
    m = Boosted(30, 3).fit(x[:1500], y[:1500])
    assert ((m.margin(x[1500:]) > 0) == y[1500:]).mean() > 0.95


ENERGY = "Spending on wind turbine rose. The transmission grid needs a substation upgrade. Peak load fell."
SPORT = "Der Spielertransfer kostet. Neben Dauerkarte bleibt Stadionpacht der größte Posten."
MONEY = "Working capital rose and goodwill fell. Retained earnings and interest expense are stable."


def test_subjects_by_paragraph(spark):
    texts = [
        (1, f"{MONEY}\n\n{ENERGY}"), (2, f"{MONEY} One season ticket was sold. {MONEY}"), (3, f"{SPORT}\n\n{ENERGY}"), (4, MONEY), (5, ""), (6, None), (7, "nothing here"),
        (8, ENERGY + " " + "\n\n".join([MONEY] * 300)), (9, "SUBSTATION UPGRADES. wind turbines."), (9, "SUBSTATION UPGRADES. wind turbines."),
    ]
    df = spark.createDataFrame([(*t, "x", 1.0) for t in texts], "doc_id long, text string, subject string, score double")
    got = sorted((r.doc_id, r.subject) for r in subjects.assign_subjects(df).collect())
    assert got == [(1, "energy"), (3, "energy"), (3, "sport"), (8, "energy"), (9, "energy")]
    assert subjects.assign_subjects(df.limit(0)).count() == 0


def test_thresholds_follow_the_labels(spark):
    scores = spark.createDataFrame([(i, "law", s) for i, s in enumerate([0.41, 0.43, 0.45, 0.9, 0.3])], "doc_id long, subject string, score double")
    labels = spark.createDataFrame([(0, "law"), (1, "law"), (2, "law"), (3, "law"), (4, "none"), (4, None)], "doc_id long, subject string")
    assert subjects.calibrated(scores, labels)["law"] == 0.4
    assert subjects.calibrated(scores, labels.limit(0)) == {}


def test_terms_are_learned_from_labels(spark):
    # words of a subject that nobody curated, and names that stand everywhere
    texts = [(i, f"Acme sells. The zorbine flux grew near Acme in {i}." if i % 4 == 0 else "Acme sells. Margins of Acme fell.") for i in range(80)]
    df = spark.createDataFrame([*texts, (900, None), (901, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, "energy" if i % 4 == 0 else "none") for i in range(80)] + [(900, "energy"), (None, "law"), (5, None)], "doc_id long, subject string")
    got = subjects.learned_terms(df, labels, known={"grew near"})
    assert {t for t, *_ in got} == {"zorbine", "flux", "grew", "near", "the zorbine", "zorbine flux", "flux grew", "near acme", "acme in"} and {s for _, s, _ in got} == {"energy"}
    assert subjects.learned_terms(df, labels.limit(0)) == [] and subjects.learned_terms(df.limit(0), labels) == []


@pytest.mark.parametrize("most", [4_000, 20_000])
def test_every_labelled_document_counts(spark, most):
    # those that a sample of so many by a hash of the key leaves out decide
    ids = spark.range(most + 40).select(F.col("id").alias("doc_id"))
    last = {r.doc_id for r in ids.orderBy(F.xxhash64("doc_id").desc()).limit(40).collect()}
    labels = ids.withColumn("subject", F.when(F.col("doc_id").isin(last), "energy").otherwise("none"))
    docs = ids.withColumn("text", F.when(F.col("doc_id").isin(last), "Zorbine flux.").otherwise("Acme fell."))
    scores = labels.where("subject = 'energy'").withColumn("score", F.lit(0.43))
    if most == 4_000:
        assert subjects.learned_terms(docs, labels) == [(t, "energy", 1.0) for t in ("flux", "zorbine", "zorbine flux")]
    assert subjects.calibrated(scores, labels) == {"energy": 0.42}


def test_held_out_labels(spark):
    # learned and calibrated on four fifths of the labelled documents, judged by the last
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "subject_labels"))
    got = {(r.doc_id, r.subject) for r in subjects.assign_subjects(docs, labels.where("doc_id % 5 <> 0")).collect()}
    held = labels.where("doc_id % 5 = 0").collect()
    known, want = {r.doc_id for r in held}, {(r.doc_id, r.subject) for r in held if r.subject != "none"}
    said = {x for x in got if x[0] in known}
    f1 = 2 * len(said & want) / (len(said) + len(want))
    print(f"F1 {f1:.4f} over {len(want)} held-out labels")
    assert f1 >= 0.95


def test_most_curated_terms_are_of_no_corpus(spark):
    whole = " ".join(r.text.lower() for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("text is not null").select("text").collect())
    terms = subjects.curated()
    assert sum(t in whole for t, *_ in terms) < len(terms) / 2
