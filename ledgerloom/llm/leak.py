"""Evaluation texts in a corpus, by winnowed fingerprints.

Of each window of ``w`` consecutive hashes of ``k`` words the least is kept, in items and in corpus
texts alike, so any shared run of ``w + k - 1`` words shares a fingerprint at the same place of the run.
Items shorter than the run that counts go by their own length. Every hit is extended to the longest
shared run around it, word by word, and kept if that is long enough.

The items are the stated query set: they go to the workers in blocks of bounded size, and the corpus is
read once for each block. No corpus row is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from ledgerloom.session import spread

#: A run of letters and digits.
WORD = re.compile(r"[^\W_]+")
#: Words of items that one block may hold; 16 bytes each, with their fingerprints under 50 MB.
BLOCK_WORDS = 1_000_000
_MIX = np.uint64(0x9E3779B97F4A7C15)
_TURN = np.uint64(0xBF58476D1CE4E5B9)


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * _TURN
    return x ^ (x >> np.uint64(32))


def grams(codes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the ``k``-grams of a sequence of word codes, one for each place where one starts."""
    n = len(codes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = out * _MIX + codes[i : i + n]
    return _mixed(out)


def winnowed(hashes: np.ndarray, w: int) -> np.ndarray:
    """Places of the least hash of each window of ``w``, the last of equals; all places where there are fewer."""
    if len(hashes) <= w:
        return np.flatnonzero(hashes == hashes.min())[-1:] if len(hashes) == w else np.arange(len(hashes))
    # windows by doubling: after step i each place has the least of the window of that length
    best = np.arange(len(hashes))
    done = 1
    while done < w:
        step = min(done, w - done)
        left, right = best[:-step], best[step:]
        best = np.where(hashes[right] <= hashes[left], right, left)
        done += step
    return np.unique(best)


def word_codes(tokens: list[str]) -> np.ndarray:
    return pd.util.hash_array(np.array(tokens, dtype=object), categorize=True) if tokens else np.empty(0, np.uint64)


class Block:
    """Items by their fingerprints. ``classes``: ``(run, k, w)``, each with its own sorted fingerprints."""

    def __init__(self, items: list[tuple[int, str]], run: int):
        self.run = run
        self.ids, self.words, starts = [], [], [0]
        for item, text in items:
            own = words(text)
            if own:
                self.ids.append(item)
                self.words.append(own)
                starts.append(starts[-1] + len(own))
        self.starts = np.array(starts)
        self.codes = word_codes([w for own in self.words for w in own])
        self.need = np.array([min(run, len(own)) for own in self.words], dtype=np.int64)
        self.classes = []
        # items of nearly the same need share a class, whose run is the least of them
        for low, high in [(n, n) for n in range(1, 6)] + [(6, 8), (9, run)] if run > 8 else [(n, n) for n in range(1, run + 1)]:
            mine = np.flatnonzero((self.need >= low) & (self.need <= high))
            if not len(mine):
                continue
            short = int(self.need[mine].min())
            k = short // 2 + 1
            w = short - k + 1
            prints, owners, places = [], [], []
            for i in mine:
                h = grams(self.codes[self.starts[i] : self.starts[i + 1]], k)
                at = winnowed(h, w)
                prints.append(h[at])
                owners.append(np.full(len(at), i))
                places.append(at)
            prints, owners, places = np.concatenate(prints), np.concatenate(owners), np.concatenate(places)
            order = np.argsort(prints, kind="stable")
            self.classes.append((k, w, prints[order], owners[order], places[order]))

    def matches(self, tokens: list[str], hits: Iterator[tuple[int, int, int]]) -> dict[int, tuple[int, int]]:
        """The longest shared run, and where it starts in the text, of each item that leaked into a text."""
        found: dict[int, tuple[int, int]] = {}
        seen: dict[tuple[int, int], int] = {}  # how far each diagonal has been followed
        for owner, place, at in hits:
            if at < seen.get((owner, at - place), 0):
                continue
            own = self.words[owner]
            if tokens[at] != own[place]:
                continue
            back = 0
            while back < min(at, place) and tokens[at - back - 1] == own[place - back - 1]:
                back += 1
            on = 0
            while at + on < len(tokens) and place + on < len(own) and tokens[at + on] == own[place + on]:
                on += 1
            seen[owner, at - place] = at + on
            if back + on >= self.need[owner] and back + on > found.get(owner, (0, 0))[0]:
                found[owner] = (back + on, at - back)
        return found


def _leaks(block: Block, texts: list[str | None]) -> Iterator[tuple[int, int, int, int]]:
    """``(row, item, words, first word)`` of each text and item."""
    lists = [words(t) if t else [] for t in texts]
    ends = np.cumsum([len(x) for x in lists])
    begins = ends - [len(x) for x in lists]
    codes = word_codes([w for x in lists for w in x])
    row = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    hits: dict[int, list[tuple[int, int, int]]] = {}
    for k, w, prints, owners, places in block.classes:
        h = grams(codes, k)
        if not len(h):
            continue
        # a gram that would run past its text is greater than any other, so it's never the least of a window
        # that has a whole one; windows across texts can only add places, which does no harm
        across = row[: len(h)] != row[k - 1 : k - 1 + len(h)]
        h[across] = np.uint64(0xFFFFFFFFFFFFFFFF)
        at = winnowed(h, w)
        at = at[~across[at]]
        left = np.searchsorted(prints, h[at], "left")
        right = np.searchsorted(prints, h[at], "right")
        for i in np.flatnonzero(right > left):
            for j in range(left[i], right[i]):
                hits.setdefault(int(row[at[i]]), []).append((int(owners[j]), int(places[j]), int(at[i] - begins[row[at[i]]])))
    for r, own in hits.items():
        for owner, (length, first) in block.matches(lists[r], iter(sorted(own, key=lambda x: x[2]))).items():
            yield r, block.ids[owner], length, first


def _blocks(items: DataFrame, key: str, text: str, run: int) -> Iterator[Block]:
    """Blocks of items of at most ``BLOCK_WORDS`` words each, one at a time."""
    rows, size = [], 0
    for item, whole in items.where(f"{text} is not null").select(key, text).toLocalIterator():
        n = len(words(whole))
        if rows and size + n > BLOCK_WORDS:
            yield Block(rows, run)
            rows, size = [], 0
        rows.append((item, whole))
        size += n
    if rows:
        yield Block(rows, run)


def leaked_items(
    corpus: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", run: int = 12
) -> DataFrame:
    """``(key, item_key, shared_words, first_word)`` for each text and item with a shared run that is long enough.

    Long enough is ``run`` consecutive words, or all words of an item with fewer. Items without a word leak
    nowhere; empty and null texts hold nothing. Repeated corpus rows come out repeatedly, repeated items once
    per corpus row and copy. Other columns are ignored.
    """
    kind, item_kind = dict(corpus.dtypes)[key], dict(items.dtypes)[item_key]
    schema = f"`{key}` {kind}, `{item_key}` {item_kind}, shared_words int, first_word int"
    rows = spread(corpus.select(key, text))
    out = corpus.sparkSession.createDataFrame([], schema)
    for block in _blocks(items, item_key, item_text, run):
        sent = corpus.sparkSession.sparkContext.broadcast(block)

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for start in range(0, batch.num_rows, 256):
                    part = batch.slice(start, 256)
                    found = list(_leaks(sent.value, part.column(1).to_pylist()))
                    if not found:
                        continue
                    at, item, length, first = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).take(pa.array(at)), pa.array(item), pa.array(length, pa.int32()), pa.array(first, pa.int32())],
                        names=[key, item_key, "shared_words", "first_word"],
                    )

        out = out.unionByName(rows.mapInArrow(search, schema))
    return out
