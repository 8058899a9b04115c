"""Three ways to cut documents into chunks, as row-to-rows functions on Arrow batches."""

from __future__ import annotations

import hashlib
import re
from abc import ABC, abstractmethod
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from typing import ClassVar

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.columns import params_hash
from ledgerloom.session import spread

SEPARATORS = ("\n\n", "\n", ". ", " ")


class Tokenizer(ABC):
    """Spans of tokens in a text; a span may take in white space."""

    name: str
    #: Whether no token reaches over white space, so that counts of parts add up.
    additive = False

    @abstractmethod
    def spans(self, text: str) -> list[tuple[int, int]]: ...

    def count(self, text: str) -> int:
        return len(self.spans(text))


class WordTokenizer(Tokenizer):
    """Words and single marks; needs no vocabulary."""

    name = "words"
    additive = True
    _pattern = re.compile(r"\w+|[^\w\s]")

    def spans(self, text):
        return [m.span() for m in self._pattern.finditer(text)]


class SpaceTokenizer(Tokenizer):
    """Runs of what isn't white space."""

    name = "spaces"
    additive = True
    _pattern = re.compile(r"\S+")

    def spans(self, text):
        return [m.span() for m in self._pattern.finditer(text)]


class RankTokenizer(Tokenizer):
    """A public byte-level vocabulary in a file of ranks, whose path is a parameter."""

    name = "ranks"

    def __init__(self, path: str, pattern: str):
        self.path, self.pattern, self._encoding = path, pattern, None

    def spans(self, text):
        if self._encoding is None:
            import base64

            import tiktoken

            with open(self.path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self._encoding = tiktoken.Encoding("own", pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={})
        ids = self._encoding.encode_ordinary(text)
        _, starts = self._encoding.decode_with_offsets(ids)
        return list(zip(starts, [*starts[1:], len(text)], strict=True)) if ids else []

    def __getstate__(self):
        return {"path": self.path, "pattern": self.pattern, "_encoding": None}


@dataclass(frozen=True)
class Region:
    """A section of a document that chunks are labelled with."""

    label: str
    start: int
    end: int


class Strategy(ABC):
    name: str

    def __init__(self, tokenizer: Tokenizer | None = None):
        self.tokenizer = tokenizer or WordTokenizer()

    @property
    @abstractmethod
    def params(self) -> dict: ...

    @property
    def params_hash(self) -> str:
        return params_hash(self.params)

    @abstractmethod
    def spans(self, text: str, regions: list[Region]) -> list[tuple[int, int]]: ...

    def split(self, text: str, regions: list[Region] = ()) -> list[tuple[int, str, str | None, int]]:
        """``(ordinal, text, section, tokens)``; blank and too short pieces go before ordinals are given."""
        starts = [r.start for r in regions]
        out = []
        for low, high in self.spans(text, list(regions)):
            piece = text[low:high].strip()
            tokens = self.tokenizer.count(piece) if piece else 0
            if not piece or tokens < self.params["min_tokens"]:
                continue
            at = bisect_right(starts, low) - 1
            label = regions[at].label if at >= 0 and low < regions[at].end else None
            out.append((len(out), piece, label, tokens))
        return out


class Fixed(Strategy):
    """Windows of ``size`` tokens that each repeat ``overlap`` of the one before."""

    name = "fixed"

    def __init__(self, size: int = 350, overlap: int = 60, least: int = 24, tokenizer: Tokenizer | None = None):
        if overlap >= size:
            raise ValueError("the overlap must be less than the size")
        super().__init__(tokenizer)
        self.size, self.overlap, self.least = size, overlap, least

    @property
    def params(self):
        return {"size_tokens": self.size, "overlap_tokens": self.overlap, "min_tokens": self.least}

    def spans(self, text, regions):
        tokens = self.tokenizer.spans(text)
        step = self.size - self.overlap
        return [(tokens[i][0], tokens[min(i + self.size, len(tokens)) - 1][1]) for i in range(0, len(tokens), step)]


class Recursive(Strategy):
    """Cuts at the coarsest separator that leaves pieces within the budget and packs neighbours up to it."""

    name = "recursive"

    def __init__(self, most: int = 350, least: int = 24, tokenizer: Tokenizer | None = None):
        super().__init__(tokenizer)
        self.most, self.least = most, least

    @property
    def params(self):
        return {"max_tokens": self.most, "min_tokens": self.least}

    def spans(self, text, regions):
        return self.within(text, [0, len(text)])

    def within(self, text: str, edges: list[int]) -> list[tuple[int, int]]:
        """Spans that don't reach across the edges."""
        if self.tokenizer.additive:
            # separators end in white space, so tokens can be counted by where they start
            starts = [a for a, _ in self.tokenizer.spans(text)]
            self._count = lambda a, b: bisect_left(starts, b) - bisect_left(starts, a)
        else:
            self._count = lambda a, b: self.tokenizer.count(text[a:b])
        return [(a, b) for low, high in zip(edges, edges[1:], strict=False) for a, b, _ in self._packed(text, low, high, 0)]

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_count"}

    def _packed(self, text: str, low: int, high: int, level: int) -> list[tuple[int, int, int]]:
        tokens = self._count(low, high)
        if tokens <= self.most:
            return [(low, high, tokens)]
        while level < len(SEPARATORS) and text.find(SEPARATORS[level], low, high) < 0:
            level += 1
        if level == len(SEPARATORS):
            spans = self.tokenizer.spans(text[low:high])
            edges = [low + spans[i][0] for i in range(0, len(spans), self.most)]
            edges[0] = low
            return [(a, b, self.most) for a, b in zip(edges, [*edges[1:], high], strict=True)]
        cut = re.compile(re.escape(SEPARATORS[level]))
        edges = [low, *(m.end() for m in cut.finditer(text, low, high)), high]
        packed: list[tuple[int, int, int]] = []
        for a, b in zip(edges, edges[1:], strict=False):
            for piece in self._packed(text, a, b, level + 1) if a < b else ():
                if packed and packed[-1][2] + piece[2] <= self.most:
                    packed[-1] = (packed[-1][0], piece[1], packed[-1][2] + piece[2])
                else:
                    packed.append(piece)
        return packed


class SectionAware(Recursive):
    """Recursive, but no chunk reaches across the start of a section."""

    name = "section_aware"

    def spans(self, text, regions):
        edges = sorted({0, len(text), *(r.start for r in regions)})
        return self.within(text, edges)


STRATEGIES: dict[str, type[Strategy]] = {s.name: s for s in (Fixed, Recursive, SectionAware)}


def get_strategies(names: list[str] | None = None, most: int | None = None, tokenizer: Tokenizer | None = None) -> list[Strategy]:
    """Strategies by name, all by default; ``most`` overrides the token budget, and so the parameter hash."""
    wanted = list(STRATEGIES) if names in (None, ["all"]) else names
    unknown = [n for n in wanted if n not in STRATEGIES]
    if unknown:
        raise ValueError(f"unknown strategies {unknown}; known: {sorted(STRATEGIES)}")
    return [STRATEGIES[n](*([] if most is None else [most]), tokenizer=tokenizer) for n in wanted]


NAMES = ["document_id", "strategy", "params_hash", "section", "ordinal", "text", "token_count", "content_hash"]
SCHEMA = "document_id string, strategy string, params_hash string, section string, ordinal int, text string, token_count int, content_hash string"


def chunk(documents: DataFrame, strategies: list[Strategy], sections: DataFrame | None = None, key: str = "accession_no", text: str = "text") -> DataFrame:
    """Chunks of every document by every strategy; ``sections`` is what ``detect_sections`` gives, by ``key``.

    Null and blank texts give no chunk.
    """
    rows = spread(documents.select(F.col(key).cast("string").alias("document_id"), F.col(text).alias("text")))
    if sections is not None:
        # a document has at most one section for each item number and part
        own = sections.groupBy(F.col(key).cast("string").alias("document_id")).agg(F.sort_array(F.collect_list(F.struct("start", "end", "label"))).alias("sections"))
        rows = rows.join(own, "document_id", "left")
    else:
        rows = rows.withColumn("sections", F.lit(None).cast("array<struct<start:int,end:int,label:string>>"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got: list[list] = [[] for _ in NAMES]
            for document, whole, parts in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                regions = [Region(p["label"], p["start"], p["end"]) for p in parts or ()]
                for s in strategies if whole else ():
                    for ordinal, piece, label, tokens in s.split(whole, regions):
                        digest = hashlib.sha256(" ".join(piece.split()).encode()).hexdigest()
                        for column, value in zip(got, (document, s.name, s.params_hash, label, ordinal, piece, tokens, digest), strict=True):
                            column.append(value)
            kinds = [pa.int32() if n in ("ordinal", "token_count") else pa.string() for n in NAMES]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(got, kinds, strict=True)], names=NAMES)

    return rows.select("document_id", "text", "sections").mapInArrow(run, SCHEMA)
