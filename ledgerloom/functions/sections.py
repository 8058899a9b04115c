"""Sections of filings, found by their headings in a plan of windows; no Python runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.columns import section_label
from ledgerloom.session import spread

LONGEST_HEADING = 150
# The items that a filing of each form should have.
EXPECTED = {"10-K": ["1", "1A", "7", "7A", "8"], "10-Q": ["I.1", "I.2", "II.1A"]}
_TRIM = " .|-—"


def detect_sections(documents: DataFrame, key: str = "doc_id", text: str = "text", form: str = "form_type") -> DataFrame:
    """``(key, section_key, title, label, start, end)``: half-open character spans of the detected sections.

    A heading is a line of up to 150 characters that starts with ``Item <number>`` and isn't a row of a table
    of contents. In 10-Q forms the part in force stands before the number. Of several headings with one key,
    titled ones beat bare ones, and the last wins. A section lasts until the next heading that won. Texts
    without a heading, empty and null ones have no section.
    """
    rows = spread(documents.select(key, text, form)).select(
        F.col(key).alias("key"),
        F.upper(F.trim(F.coalesce(F.col(form), F.lit("")))).startswith("10-Q").alias("in_parts"),
        F.length(text).alias("size"),
        F.split(text, "\n").alias("lines"),
    )
    # only lines that may be headings leave their row, so texts aren't shuffled
    # one walk along the lines keeps the characters before, with a line feed after each
    none = F.array().cast("array<struct<nth:int,start:int,line:string>>")
    zero = F.struct(F.lit(0).alias("nth"), F.lit(0).alias("start"), none.alias("heads"))

    def walk(done, line):
        head = F.array(F.struct(done.nth.alias("nth"), done.start.alias("start"), line.alias("line")))
        heads = F.when(line.rlike(r"(?i)^[\s\x{a0}]*(?:part|item)\s"), F.concat(done.heads, head)).otherwise(done.heads)
        return F.struct((done.nth + 1).alias("nth"), (done.start + F.length(line) + 1).alias("start"), heads.alias("heads"))

    lines = rows.select("key", "in_parts", "size", F.explode(F.aggregate("lines", zero, walk, lambda done: done.heads)).alias("h")).select("key", "in_parts", "size", "h.nth", "h.start", "h.line")
    inside = Window.partitionBy("key").orderBy("nth")
    bare = F.trim(F.regexp_replace("line", r"^[\s\x{a0}]+|[\s\x{a0}]+$", ""))
    toc = bare.contains("|") & F.trim(F.element_at(F.split(bare, r"\|"), -1)).rlike(r"^\d{1,3}$")
    lines = lines.withColumn("bare", bare).where(F.length("bare").between(1, LONGEST_HEADING) & ~toc)
    part = F.regexp_extract("bare", r"(?i)^part\s+([ivxl]+)\b", 1)
    flat = F.replace("bare", F.lit(" | "), F.lit(" "))
    item = r"(?i)^item\s+(\d{1,2}[a-c]?)[.:]?\s*(.*)$"
    heads = lines.select("key", "in_parts", "size", "nth", "start", F.upper(part).alias("part"), F.upper(F.regexp_extract(flat, item, 1)).alias("number"), F.btrim(F.regexp_extract(flat, item, 2), F.lit(_TRIM)).alias("title"))
    heads = heads.where("part <> '' or number <> ''")
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    current = F.coalesce(F.last(F.when(F.col("part") != "", F.col("part")), ignorenulls=True).over(upto), F.lit("I"))
    heads = heads.withColumn("section_key", F.when(F.col("in_parts"), F.concat(current, F.lit("."), "number")).otherwise(F.col("number")))
    items = heads.where("part = '' and number <> ''")
    best = F.max(F.struct((F.col("title") != "").alias("titled"), "start", "title", "size")).alias("best")
    won = items.groupBy("key", "section_key").agg(best).select("key", "section_key", "best.*")
    follows = F.lead("start").over(Window.partitionBy("key").orderBy("start"))
    return won.select(
        F.col("key").alias(key),
        "section_key",
        "title",
        section_label(F.col("section_key"), F.col("title")).alias("label"),
        F.col("start").cast("int").alias("start"),
        F.coalesce(follows, F.col("size")).cast("int").alias("end"),
    )


def _wanted(documents: DataFrame, sections: DataFrame, key: str, form: str) -> DataFrame:
    """Documents of forms with expected sections, with ``form``, ``wanted`` and ``found``."""
    table = F.create_map(*[x for f, keys in EXPECTED.items() for x in (F.lit(f), F.array(*map(F.lit, keys)))])
    wanted = documents.select(key, F.upper(F.trim(form)).alias("form")).withColumn("wanted", F.try_element_at(table, F.col("form"))).where("wanted is not null")
    found = sections.groupBy(key).agg(F.collect_set("section_key").alias("found"))
    return wanted.join(found, key, "left").withColumn("found", F.coalesce("found", F.array().cast("array<string>")))


def missing(documents: DataFrame, sections: DataFrame, key: str = "doc_id", form: str = "form_type") -> DataFrame:
    """``(key, form, missing)``: the expected sections that a document lacks, for those that lack any."""
    rows = _wanted(documents, sections, key, form).withColumn("missing", F.array_except("wanted", "found"))
    return rows.where(F.size("missing") > 0).select(key, "form", "missing")


def hit_rate(documents: DataFrame, sections: DataFrame, key: str = "doc_id", form: str = "form_type") -> DataFrame:
    """Per form with expected sections: documents, expected and found keys, and their ratio."""
    both = _wanted(documents, sections, key, form).withColumn("hit", F.array_intersect("wanted", "found"))
    return both.groupBy("form").agg(
        F.count(F.lit(1)).alias("documents"),
        F.sum(F.size("wanted")).alias("expected"),
        F.sum(F.size("hit")).alias("found"),
        (F.sum(F.size("hit")) / F.sum(F.size("wanted"))).alias("hit_rate"),
    )
