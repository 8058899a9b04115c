"""Lines repeated across the documents of one source, found by compressed bitmaps.

A line's documents within a source are a bitmap of document numbers, kept as containers of 4096 numbers each:
the sorted positions that are set, or where those are many, 64 words of 64 bits. Every way of writing a line
has its own containers; those of ways that fold alike are united, and a cardinality is the sum over
containers. Lines come off a document by looking up its bit in the containers of the frequent lines. No bitmap
is ever one object in memory, however many documents share a line. Numbers are dense within a source, so that
containers are as full as they can be.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.text import folded
from ledgerloom.session import durable, spread

#: Bits of a document's number within a container, and positions from which words take less room.
BITS, DENSE = 12, 256
#: Parts of a source within which documents are numbered in order.
PARTS = 256
KEY = ("source", "line_a", "line_b")


def _key(fold) -> list:
    return [F.xxhash64(fold).alias("line_a"), F.xxhash64(F.reverse(fold), F.length(fold)).alias("line_b")]


def keyed_lines(texts: DataFrame, least_chars: int) -> DataFrame:
    """``(line_a, line_b, variant, line_no)`` of each line that is long enough, with the other columns of ``texts`` but ``text``.

    The first two hashes are of the folded line, 128 bits together; ``variant`` is of the line as it stands.
    """
    kept = [c for c in texts.columns if c != "text"]
    # folded before lines become rows: a condition on the folded line would else fold it once more
    fold = lambda x, i: F.struct((i + 1).alias("line_no"), F.xxhash64(x).alias("variant"), F.when(F.length(x) >= least_chars, folded(x)).alias("fold"))
    long = F.filter(F.transform(F.split("text", "\n"), fold), lambda x: F.length(x.fold) >= least_chars)
    lines = texts.select(*kept, F.explode(long).alias("_line"))
    return lines.select(*kept, *_key(F.col("_line.fold")), "_line.variant", "_line.line_no")


def with_places(lines: DataFrame) -> DataFrame:
    """With the ``chunk`` of each line's document, which is its container's number, and its ``pos`` in there."""
    pos = F.col("doc_no").bitwiseAND((1 << BITS) - 1).cast("smallint")
    return lines.select(*KEY, "variant", F.shiftright("doc_no", BITS).alias("chunk"), pos.alias("pos"), "item", "line_no")


def _dense(positions: Column) -> Column:
    """Positions as 64 words."""
    word = lambda w: F.aggregate(F.filter(positions, lambda p: F.shiftright(p.cast("int"), 6) == w), F.lit(0).cast("long"), lambda s, p: s.bitwiseOR(_power(p)))
    return F.transform(F.sequence(F.lit(0), F.lit((1 << BITS) // 64 - 1)), word)


def _power(p: Column) -> Column:
    """The bit of a position in its word."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), p.cast("int").bitwiseAND(63))


def containers(lines: DataFrame, least_documents: int = 1) -> DataFrame:
    """``(*KEY, chunk, positions, words)`` of the lines with enough documents; one of the last two is null.

    A container has at most 4096 positions. Containers of a line are counted together in one task, one row for
    every 4096 documents that may have it.
    """
    own = lines.groupBy(*KEY, "variant", "chunk").agg(F.collect_set("pos").alias("pos"))
    # one exchange for the union and for the count
    united = own.repartition(*KEY).groupBy(*KEY, "chunk").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("pos")))).alias("pos"))
    total = F.sum(F.size("pos")).over(Window.partitionBy(*KEY))
    often = united.withColumn("documents", total).where(F.col("documents") >= least_documents)
    many = F.size("pos") > DENSE
    return often.select(*KEY, "chunk", F.when(~many, F.col("pos")).alias("positions"), F.when(many, _dense(F.col("pos"))).alias("words"))


def bitmap_bytes(bitmaps: DataFrame) -> DataFrame:
    """One row: ``documents`` that are set in all, and the ``bytes`` that positions and words take."""
    bits = F.aggregate("words", F.lit(0), lambda s, w: s + F.bit_count(w))
    sparse = F.col("positions").isNotNull()
    count = F.when(sparse, F.size("positions")).otherwise(bits)
    size = F.when(sparse, 2 * F.size("positions")).otherwise(8 * F.size("words"))
    return bitmaps.agg(F.sum(count).alias("documents"), F.sum(size).alias("bytes"))


def repeated_lines(
    texts: DataFrame, least_documents: int = 6, least_chars: int = 16, except_texts: DataFrame | None = None, documents: DataFrame | None = None
) -> DataFrame:
    """``(item, line_no)`` of each line whose folded form stands in enough documents of its source.

    ``texts`` has ``item``, ``text`` and either ``source`` and ``doc_no`` (bigint, one per document) or
    ``document``, by which ``documents`` has those two. Null texts, sources and document numbers give no rows;
    an empty text has one empty line, which is too short. Repeated rows of one item give repeated rows.
    ``except_texts`` has one column of texts; lines that fold like one of them don't count. Texts are split
    and folded where they are read; the keyed lines, without their text, are written once and read for the
    bitmaps and for the lookup.
    """
    known = ["document"] if documents is not None else ["source", "doc_no"]
    lines = keyed_lines(texts.select("item", "text", *known).where("text is not null"), least_chars)
    if documents is not None:
        lines = lines.join(documents, "document")
    lines = durable(with_places(lines.where("source is not null and doc_no is not null")))
    often = containers(lines, least_documents)
    if except_texts is not None:
        distinct = except_texts.toDF("text").where("text is not null").distinct()
        often = often.join(distinct.select(*_key(folded(F.col("text")))), ["line_a", "line_b"], "left_anti")
    both = lines.join(often, [*KEY, "chunk"])
    bit = F.element_at("words", F.shiftright(F.col("pos").cast("int"), 6) + 1).bitwiseAND(_power(F.col("pos"))) != 0
    return both.where(F.coalesce(F.array_contains("positions", F.col("pos")), bit)).select("item", "line_no")


def without_lines(texts: DataFrame, key: str, text: str, found: DataFrame) -> DataFrame:
    """``texts`` with the found lines (``key``, ``line_no``) taken out of each; the rest stays as it is."""
    # an item has at most as many found lines as lines, so the set is no larger than the text
    drop = found.groupBy(F.col(key).alias("_key")).agg(F.collect_set("line_no").alias("_drop"))
    kept = F.filter(F.split(text, "\n"), lambda _, i: ~F.array_contains(F.col("_drop"), i + 1))
    out = texts.join(drop, F.col(key) == F.col("_key"), "left")
    cleaned = F.when(F.col("_drop").isNull(), F.col(text)).otherwise(F.array_join(kept, "\n"))
    return out.withColumn(text, cleaned).drop("_key", "_drop")


def chunk_texts(chunks: DataFrame) -> DataFrame:
    return spread(chunks.select(F.col("chunk_id").alias("item"), F.col("document_id").alias("document"), "text"))


def filings(documents: DataFrame) -> DataFrame:
    """``(document, source, doc_no)``: the source is the company, ``cik`` as a number; numbers are dense within it.

    A filing delivered again counts once. Documents are put in order within parts of their source, and parts
    one after the other, so no task orders a whole source.
    """
    cik = F.regexp_replace("cik", "[^0-9]", "").cast("bigint")
    each = documents.groupBy(F.col("accession_no").alias("document")).agg(F.min(cik).alias("source")).withColumn("part", F.pmod(F.xxhash64("document"), F.lit(PARTS)))
    sizes = each.groupBy("source", "part").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("source", "part", (F.sum("n").over(Window.partitionBy("source").orderBy("part")) - F.col("n")).alias("before"))
    placed = each.withColumn("nth", F.row_number().over(Window.partitionBy("source", "part").orderBy("document")))
    return placed.join(before, ["source", "part"]).select("document", "source", (F.col("before") + F.col("nth") - 1).alias("doc_no"))
