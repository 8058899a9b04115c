"""Scalar functions of the engine, as expressions that stay in the JVM."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of Unicode, as in Python's str.split, for character classes of Java and RE2.
WHITE = r"\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def squeezed(text: Column) -> Column:
    """Runs of white space made one space, the ends trimmed."""
    return F.trim(F.regexp_replace(text, f"[{WHITE}]+", " "))


def content_hash(text: Column) -> Column:
    """SHA-256 of the squeezed text: incidental reflowing keeps it, any visible change doesn't."""
    return F.sha2(squeezed(text), 256)


def params_hash(params: dict) -> str:
    """First 16 hex digits of the SHA-256 of the parameters as canonical JSON."""
    return hashlib.sha256(json.dumps(params, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:16]


def cik_number(cik: Column) -> Column:
    """A company's number, however many zeros lead it; null if it isn't one."""
    digits = F.trim(cik)
    return F.when(digits.rlike(r"^\d{1,18}$"), digits.cast("bigint"))


def accession_nodash(accession: Column) -> Column:
    return F.translate(accession, "-", "")


def source_url(base: str, cik: Column, accession: Column, primary: Column) -> Column:
    return F.concat_ws("/", F.lit(base.rstrip("/")), cik_number(cik).cast("string"), accession_nodash(accession), primary)


def iso_date(text: Column) -> Column:
    """A date from ISO text; blank is null."""
    return F.to_date(F.nullif(F.trim(text), F.lit("")))


def form_name(form: Column) -> Column:
    return F.upper(F.trim(form))


def excerpt(text: Column, most: int, mark: str = "") -> Column:
    flat = squeezed(text)
    cut = F.substring(flat, 1, most)
    return F.when(F.length(flat) > most, F.concat(cut, F.lit(mark))).otherwise(flat) if mark else cut


def citation(company: Column, form: Column, document: Column, section: Column, chunk: Column) -> Column:
    return F.concat(
        company, F.lit(" "), form, F.lit(" "), document, F.lit(" — "),
        F.coalesce(F.when(section != "", section), F.lit("no section")), F.lit(" — chunk "), chunk.cast("string"),
    )


def section_label(key: Column, title: Column) -> Column:
    """``Item <number>. <title>`` without the part that a key may start with."""
    number = F.element_at(F.split(key, "\\."), -1)
    return F.concat(F.lit("Item "), number, F.lit("."), F.when(title != "", F.concat(F.lit(" "), title)).otherwise(F.lit("")))


def nibbles(text: Column, size: int) -> Column:
    """A deterministic unit vector from a text: hex digits of its SHA-256 over 15, ``size`` of them, at most 64."""
    digits = F.sha2(text, 256)
    raw = F.transform(F.sequence(F.lit(1), F.lit(size)), lambda i: F.conv(F.substr(digits, i, F.lit(1)), 16, 10).cast("double") / 15)
    norm = F.sqrt(F.aggregate(raw, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(raw, lambda x: x / norm)


def byte_vector(text: Column, size: int = 8) -> Column:
    """A deterministic unit vector from a text: leading bytes of its SHA-256 over 255."""
    digits = F.sha2(text, 256)
    raw = F.transform(
        F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.conv(F.substr(digits, i * 2 + 1, F.lit(2)), 16, 10).cast("double") / 255
    )
    norm = F.sqrt(F.aggregate(raw, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(raw, lambda x: F.when(norm > 0, x / norm).otherwise(x))


def vector_text(vector: Column) -> Column:
    """A vector as text with eight decimals."""
    return F.concat(F.lit("["), F.array_join(F.transform(vector, lambda x: F.format_string("%.8f", x.cast("double"))), ","), F.lit("]"))


def cosine(x: Column, y: Column) -> Column:
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda s, t: s.cast("double") * t.cast("double")), F.lit(0.0), lambda s, t: s + t)
    return dot(x, y) / F.sqrt(dot(x, x) * dot(y, y))
