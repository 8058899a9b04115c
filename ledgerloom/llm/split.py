"""Splitting oversized items at natural boundaries, by balanced targets."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.text import TOKEN, token_count
from ledgerloom.session import spread

#: Strength of a boundary by what lies between two tokens.
PARAGRAPH, LINE, SENTENCE, SPACE, TOUCHING, INSIDE = 6.0, 4.0, 3.0, 1.5, 0.5, 0.0
_PARAGRAPH = re.compile(r"\n[^\S\n]*\n")
_CLOSERS = "\"'”’»)]"


def _strengths(text: str, starts: list[int], ends: list[int]) -> np.ndarray:
    """Strength of cutting before each token; those at 0 and after the last mean nothing."""
    out = np.zeros(len(starts) + 1)
    last = ""  # the last token that isn't a closing mark
    for i in range(1, len(starts)):
        token = text[ends[i - 1] - 1]
        if token not in _CLOSERS:
            last = token
        if starts[i] == ends[i - 1]:
            out[i] = INSIDE if token.isalnum() and text[starts[i]].isalnum() else TOUCHING
            continue
        gap = text[ends[i - 1] : starts[i]]
        if "\n" in gap:
            out[i] = PARAGRAPH if _PARAGRAPH.search(gap) else LINE
        elif gap.isspace():
            out[i] = SENTENCE if last in ".!?…。" else SPACE
        else:
            out[i] = TOUCHING
    return out


def cut_points(strength: np.ndarray, size: int, limit: int, overlap: int) -> list[int]:
    """Token numbers at which pieces begin anew, 0 first, the end last.

    The least number of pieces gets targets that make all pieces, with their overlaps, equally long. Each
    target moves to the boundary nearby whose strength, less a penalty for the distance, is greatest. If a
    piece then exceeds the limit, one more piece is tried; more pieces leave more room to move. At twice
    the least number, the targets themselves are taken, which always keep the limit.
    """
    fresh = limit - overlap
    least = 1 + -(-(size - limit) // fresh)
    for pieces in range(least, 2 * least + 2):
        length = (size + (pieces - 1) * overlap) / pieces
        targets = [round(length + i * (length - overlap)) for i in range(pieces - 1)]
        reach = max(1, int((length - overlap) * 0.45))
        cuts = [0]
        for target in targets:
            low, high = max(cuts[-1] + 1, target - reach), min(size - 1, target + reach)
            # what the limit allows after the piece before
            high = min(high, cuts[-1] + (limit if len(cuts) == 1 else fresh))
            if low > high:
                break
            near = np.arange(low, high + 1)
            cuts.append(int(near[np.argmax(strength[low : high + 1] - 2.0 * np.abs(near - target) / reach)]))
        if len(cuts) == pieces and size - cuts[-1] <= fresh:
            return [*cuts, size]
    length = (size + (least - 1) * overlap) / least
    return [0, *(int(length + i * (length - overlap)) for i in range(least - 1)), size]


def split_text(text: str, limit: int, overlap: int = 0) -> list[tuple[str, int, int, int]]:
    """Pieces ``(text, tokens, start, repeated)``; ``repeated`` is how many leading characters repeat.

    The pieces without what they repeat join to the text again. A text within the limit is one piece.
    """
    limit = max(1, limit)
    overlap = min(max(0, overlap), limit - 1)
    spans = [m.span() for m in TOKEN.finditer(text)]
    if len(spans) <= limit:
        return [(text, len(spans), 0, 0)]
    starts, ends = [a for a, _ in spans], [b for _, b in spans]
    cuts = cut_points(_strengths(text, starts, ends), len(spans), limit, overlap)
    at = [*starts, len(text)]
    at[0] = 0
    out = []
    for i in range(len(cuts) - 1):
        first = max(0, cuts[i] - overlap) if i else 0
        out.append((text[at[first] : at[cuts[i + 1]]], cuts[i + 1] - first, at[first], at[cuts[i]] - at[first]))
    return out


def split_oversized(items: DataFrame, key: str, text: str, section: str, limit: str, overlap: str) -> DataFrame:
    """One row for each piece of each item with more tokens than its limit.

    Gives ``key``, ``piece`` (from 0), ``section``, ``text``, ``token_count``, ``repeated_chars``. Items
    within their limit, with a null text or limit, give none. Other columns of ``items`` are ignored. Repeated
    rows give repeated pieces. Sizes are counted in the JVM, so only oversized texts reach Python, whole.
    """
    kind = dict(items.dtypes)[key]
    rows = items.select(
        F.col(key).alias("key"),
        F.col(section).alias("section"),
        F.col(text).alias("text"),
        F.col(limit).cast("int").alias("limit"),
        F.coalesce(F.col(overlap).cast("int"), F.lit(0)).alias("overlap"),
    )
    # a text has at most as many tokens as characters
    big = rows.where((F.length("text") > F.col("limit")) & (token_count(F.col("text")) > F.col("limit")))

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got: list[list] = [[], [], [], [], [], []]
            for k, sec, whole, most, lap in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                for n, (piece, tokens, _, again) in enumerate(split_text(whole, most, lap)):
                    for column, value in zip(got, (k, n, sec, piece, tokens, again), strict=True):
                        column.append(value)
            types = (batch.schema.field(0).type, pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(got, types, strict=True)], names=NAMES)

    out = big.mapInArrow(pieces, f"key {kind}, piece int, section string, text string, token_count int, repeated_chars int")
    return out.withColumnRenamed("key", key)


NAMES = ["key", "piece", "section", "text", "token_count", "repeated_chars"]


def with_limits(chunks: DataFrame, param_sets: DataFrame) -> DataFrame:
    """Chunks with the ``size_limit`` and ``size_overlap`` of their parameter set, one for each key."""
    number = lambda name: F.get_json_object("params", f"$.{name}").cast("int")
    limits = param_sets.groupBy("strategy", "params_hash").agg(F.min("params").alias("params"))
    limits = limits.select(
        "strategy",
        "params_hash",
        F.coalesce(number("max_tokens"), number("size_tokens")).alias("size_limit"),
        F.coalesce(number("overlap_tokens"), F.lit(0)).alias("size_overlap"),
    )
    return spread(chunks).join(limits, ["strategy", "params_hash"])
