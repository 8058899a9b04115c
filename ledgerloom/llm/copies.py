"""Records that are the same but for formatting.

Rows with the same bytes collapse first, with counts. Only the distinct survivors are canonicalised, and
then grouped again on the canonical text. A survivor has one or two canonical texts: its folded text, and,
if it is a record of fields, its folded fields in order of sort. Two survivors are copies if they share
either, so a class is a connected component; nearly all classes are settled by the first look.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.text import WHITE, folded
from ledgerloom.session import durable, spread


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def field_form(text: Column) -> Column:
    """The sorted folded fields, or null if the text isn't a record of fields."""
    pieces = F.filter(F.split(text, "[\n;|]"), lambda x: x.rlike(f"[^{WHITE}]"))
    fielded = (F.size(pieces) >= 3) & F.forall(pieces, lambda x: x.contains(":") | x.contains("="))
    # a letter or digit can't be in the separator, and blank folded fields count too
    return F.when(fielded, F.array_join(F.array_sort(F.transform(pieces, folded)), "|"))


def distinct_texts(records: DataFrame, key: str, text: str, within: list[str]) -> DataFrame:
    """One row for each distinct raw text within a group: ``(*within, raw, first, copies, text)``."""
    rows = records.where(F.col(text).isNotNull()).select(*within, F.col(key).alias("_key"), F.col(text).alias("text"))
    return rows.groupBy(*within, "text").agg(F.min("_key").alias("first"), F.count(F.lit(1)).alias("copies"))


def copy_classes(records: DataFrame, key: str, text: str, within: list[str]) -> DataFrame:
    """``(*within, raw, class_first, class_copies)`` for each distinct raw text, by the digest of its bytes.

    ``class_first`` is the smallest key of the class and ``class_copies`` the number of its rows. Null
    texts are in no class; empty texts are copies of each other and of texts without letters and digits;
    rows that repeat a key count each. Null group columns form a group like any value.
    """
    whole = distinct_texts(records, key, text, within)
    forms = whole.select(
        *within,
        _digest(F.col("text")).alias("raw"),
        "first",
        "copies",
        _digest(folded(F.col("text"))).alias("fold"),
        _digest(field_form(F.col("text"))).alias("fields"),
    )
    forms = durable(forms)
    label = _labels(forms, within)
    named = forms.join(label, [F.col(f"{c}").eqNullSafe(F.col(f"_l_{c}")) for c in within] + [F.col("fold") == F.col("_l_fold")])
    named = named.select(*within, "raw", "first", "copies", "label")
    classes = named.groupBy(*within, "label").agg(F.min("first").alias("class_first"), F.sum("copies").alias("class_copies"))
    same = [F.col(f"n.{c}").eqNullSafe(F.col(f"c.{c}")) for c in [*within, "label"]]
    joined = named.alias("n").join(classes.where("class_copies > 1").alias("c"), same)
    return joined.select(*[F.col(f"n.{c}") for c in within], "n.raw", "c.class_first", "c.class_copies")


def _labels(forms: DataFrame, within: list[str]) -> DataFrame:
    """A label for each fold: the smallest fold of its component."""
    edges = forms.select(*within, "fold", "fields").where("fields is not null").distinct()
    label = durable(edges.select(*within, "fold", "fields", F.col("fold").alias("label")))
    while True:
        by_fields = label.groupBy(*within, "fields").agg(F.min("label").alias("label"))
        spread = _with(label.drop("label"), by_fields, [*within, "fields"])
        by_fold = spread.groupBy(*within, "fold").agg(F.min("label").alias("label"))
        after = _with(spread.withColumnRenamed("label", "_near"), by_fold, [*within, "fold"])
        moved = after.where("label < _near").limit(1)
        # if no fold has fields with different labels, the labels by fields are final
        settled = moved.isEmpty()
        label = durable(after.drop("_near"))
        if settled:
            break
    final = label.select(*within, "fold", "label").distinct()
    rest = forms.select(*within, "fold").distinct()
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"f.{c}")) for c in [*within, "fold"]]
    out = rest.alias("r").join(final.alias("f"), same, "left")
    return out.select(
        *[F.col(f"r.{c}").alias(f"_l_{c}") for c in [*within, "fold"]], F.coalesce("f.label", "r.fold").alias("label")
    )


def _with(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in on]
    return left.alias("l").join(right.alias("r"), same).select("l.*", "r.label")


def members(records: DataFrame, key: str, text: str, within: list[str]) -> DataFrame:
    """``(class_first, key)`` for each row of a class but the one with the smallest key."""
    classes = copy_classes(records, key, text, within)
    rows = spread(records.select(*within, key, text)).where(F.col(text).isNotNull()).select(*within, F.col(key).alias("_key"), _digest(F.col(text)).alias("raw"))
    same = [F.col(f"m.{c}").eqNullSafe(F.col(f"c.{c}")) for c in within] + [F.col("m.raw") == F.col("c.raw")]
    out = rows.alias("m").join(classes.alias("c"), same).where("m._key <> c.class_first")
    return out.select("class_first", F.col("m._key").alias(key))
