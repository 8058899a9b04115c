"""English full-text analysis: words, stop words, Porter's stemmer (1980), queries and cover density."""

from __future__ import annotations

import re
from functools import lru_cache

# Common words that carry no meaning in a search.
STOP = frozenset(
    """a about above after again against all am an and any are as at be because been before being below between both but by can
    did do does doing don down during each few for from further had has have having he her here hers herself him himself his how
    i if in into is it its itself just me more most my myself no nor not now of off on once only or other our ours ourselves out
    over own s same she should so some such t than that the their theirs them themselves then there these they this those through
    to too under until up very was we were what when where which while who whom why will with you your yours yourself
    yourselves""".split()
)
WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")


def _vowel(w: str, i: int) -> bool:
    return w[i] in "aeiou" or (w[i] == "y" and i > 0 and not _vowel(w, i - 1))


def _measure(w: str) -> int:
    kinds = [_vowel(w, i) for i in range(len(w))]
    return sum(a and not b for a, b in zip(kinds, kinds[1:], strict=False))


def _has_vowel(w: str) -> bool:
    return any(_vowel(w, i) for i in range(len(w)))


def _cvc(w: str) -> bool:
    n = len(w)
    return n > 2 and not _vowel(w, n - 3) and _vowel(w, n - 2) and not _vowel(w, n - 1) and w[-1] not in "wxy"


# Endings of the published algorithm's steps 2, 3 and 4.
_STEP2 = "ational ate;tional tion;enci ence;anci ance;izer ize;abli able;alli al;entli ent;eli e;ousli ous;ization ize;ation ate;ator ate;alism al;iveness ive;fulness ful;ousness ous;aliti al;iviti ive;biliti ble"
_STEP3 = "icate ic;ative ;alize al;iciti ic;ical ic;ful ;ness "
_STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize"
_RULES = [[tuple(r.split(" ")) for r in step.split(";")] for step in (_STEP2, _STEP3)]


@lru_cache(maxsize=200_000)
def stem(w: str) -> str:
    """Porter's stem of a lower-case word; words with other than ASCII letters stay."""
    if len(w) < 3 or not (w.isascii() and w.isalpha()):
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    else:
        cut = w[:-2] if w.endswith("ed") else w[:-3] if w.endswith("ing") else ""
        if cut and _has_vowel(cut):
            w = cut
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif len(w) > 1 and w[-1] == w[-2] and not _vowel(w, len(w) - 1) and w[-1] not in "lsz":
                w = w[:-1]
            elif _measure(w) == 1 and _cvc(w):
                w += "e"
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    for rules in _RULES:
        for old, new in sorted(rules, key=lambda r: -len(r[0])):
            if w.endswith(old):
                if _measure(w[: -len(old)]) > 0:
                    w = w[: -len(old)] + new
                break
    for old in sorted(_STEP4.split(), key=len, reverse=True):
        if w.endswith(old):
            base = w[: -len(old)]
            if _measure(base) > 1 and (old != "ion" or base.endswith(("s", "t"))):
                w = base
            break
    if w.endswith("e") and (_measure(w[:-1]) > 1 or (_measure(w[:-1]) == 1 and not _cvc(w[:-1]))):
        w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


def analyse(text: str) -> list[tuple[str, int]]:
    """Stems with their word positions; stop words take a position but give no stem."""
    return [(stem(w), i) for i, w in enumerate(WORD.findall(text.lower().replace("’", "'"))) if w not in STOP]


def parse_query(text: str) -> list[list[tuple[bool, list[tuple[str, int]]]]]:
    """A web-style query: alternatives of conjunctions of ``(wanted, phrase)``.

    Words must all be there, quoted words next to each other, ``or`` parts alternatives, a minus excludes.
    A phrase is stems with their distance from its first word.
    """
    clauses: list[list] = [[]]
    for minus, quoted, word in re.findall(r'(-?)"([^"]*)"|((?:-)?[^\s"]+)', text):
        raw = quoted if quoted or not word else word
        if not quoted and word.lower() == "or":
            clauses.append([])
            continue
        wanted = not (minus or (not quoted and word.startswith("-") and len(word) > 1))
        stems = analyse(raw.lstrip("-"))
        if stems:
            first = stems[0][1]
            if quoted:
                clauses[-1].append((wanted, [(s, at - first) for s, at in stems]))
            else:
                clauses[-1].extend((wanted, [(s, 0)]) for s, _ in stems)
    return [c for c in clauses if any(wanted for wanted, _ in c)]


def _places(where: dict[str, list[int]], phrase: list[tuple[str, int]]) -> list[int]:
    first, *rest = phrase
    at = where.get(first[0], [])
    for s, gap in rest:
        own = set(where.get(s, []))
        at = [x for x in at if x + gap in own]
    return at


def cover_density(lists: list[list[int]]) -> float:
    """Sum over minimal spans that hold every term: dense spans count more (Clarke, Cormack and Tudhope, 2000)."""
    marks = sorted((at, n) for n, own in enumerate(lists) for at in own)
    last: dict[int, int] = {}
    score, before = 0.0, -1
    for at, n in marks:
        last[n] = at
        if len(last) == len(lists):
            start = min(last.values())
            if start > before:
                score += len(lists) / max(len(lists), at - start + 1)
                before = start
    return score / 10


def rank(where: dict[str, list[int]], query: list) -> float | None:
    """The cover density of the best alternative that matches, or null if none does."""
    best = None
    for clause in query:
        lists = [_places(where, phrase) for wanted, phrase in clause if wanted]
        if not all(lists) or any(_places(where, phrase) for wanted, phrase in clause if not wanted):
            continue
        score = cover_density(lists)
        best = score if best is None or score > best else best
    return best
