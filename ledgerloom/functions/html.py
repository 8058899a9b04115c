"""HTML of filings to readable text, on the parser of the standard library."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# What is left out with its content, and what lies between lines.
DROPPED = frozenset({"script", "style", "head", "ix:header"})
VOID = frozenset({"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"})

_BLANKS = re.compile(r"[ \t\f\v]+")
_PAGE = re.compile(r"\s*-?\s*\d{1,3}\s*-?\s*")
_CHARACTERS = str.maketrans({"\xa0": " ", "’": "'", "‘": "'", "“": '"', "”": '"', "–": "-"})


class _Table:
    """A table while it is open: rows of cells, each a list of texts."""

    def __init__(self):
        self.rows: list[list[list[str]]] = []
        self.open = False

    def text(self) -> str:
        lines = []
        for row in self.rows:
            cells = [_BLANKS.sub(" ", " ".join(t for t in (s.strip() for s in cell) if t)) for cell in row]
            cells = [c for c in cells if c.strip()]
            if cells:
                lines.append(" | ".join(cells))
        return "\n".join(lines) + "\n"


class _Reader(HTMLParser):
    """Collects text nodes; an inner table becomes one text in the cell of the outer."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.tables: list[_Table] = []
        self.dropping: list[str] = []

    def handle_starttag(self, tag, attrs):
        if tag in VOID:
            return
        if self.dropping:
            if tag == self.dropping[-1]:
                self.dropping.append(tag)
            return
        if tag in DROPPED:
            self.dropping.append(tag)
        elif tag == "body":
            self.dropping.clear()
        elif tag == "table":
            self.tables.append(_Table())
        elif self.tables:
            table = self.tables[-1]
            if tag == "tr":
                table.rows.append([])
                table.open = False
            elif tag in ("td", "th"):
                if not table.rows:
                    table.rows.append([])
                table.rows[-1].append([])
                table.open = True

    def handle_startendtag(self, tag, attrs):
        if tag not in DROPPED:
            self.handle_starttag(tag, attrs)
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if self.dropping:
            if tag == self.dropping[-1]:
                self.dropping.pop()
            elif tag == "head" or tag == "html":
                self.dropping.clear()
        elif tag == "table" and self.tables:
            self.put(self.tables.pop().text())
        elif self.tables and tag in ("td", "th"):
            self.tables[-1].open = False

    def put(self, text: str):
        if not self.tables:
            self.out.append(text)
        elif self.tables[-1].open:
            self.tables[-1].rows[-1][-1].append(text)

    def handle_data(self, data):
        if not self.dropping:
            self.put(data)


def extract_text(html: str) -> str:
    """Clean text of one HTML document: scripts and styles gone, table rows as cells with bars between.

    Non-breaking spaces, curly quotes and en dashes become plain; lines of up to three digits are page
    numbers and go; more than one blank line becomes one. Unclosed tables come out as far as they go.
    """
    reader = _Reader()
    reader.feed(html)
    reader.close()
    while reader.tables:
        text = reader.tables.pop().text()
        reader.put(text)
    lines = (_BLANKS.sub(" ", line).strip() for line in "\n".join(reader.out).translate(_CHARACTERS).split("\n"))
    kept = "\n".join(line for line in lines if not _PAGE.fullmatch(line))
    return re.sub(r"\n{3,}", "\n\n", kept).strip()


def decoded(data: bytes) -> str:
    """UTF-8, or else Windows-1252 with what it lacks replaced."""
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        return data.decode("cp1252", errors="replace")


def html_text(column: Column) -> Column:
    """``extract_text`` over a column, by Arrow batches; null stays null."""

    @F.pandas_udf("string")
    def extract(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: None if t is None else extract_text(t))

    return extract(column)


def decoded_text(column: Column) -> Column:
    @F.pandas_udf("string")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for blobs in batches:
            yield blobs.map(lambda b: None if b is None else decoded(bytes(b)))

    return decode(column)
