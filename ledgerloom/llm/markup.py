"""Markup residue in texts: HTML, Markdown, wiki and LaTeX.

A text is parsed into a tree of nodes: everything that could be a construct of one of the languages, and
much that only looks like one. Tags that belong together span an element, whose depth, siblings and subtree
are those of a DOM. Boosted trees over features of each node (its subtree's density of text, attribute
tokens, depth, siblings, what stands at its edges, the verbatim node around it) give the odds that it is
markup, and these decide. Decoding is hierarchical: a verbatim node (code, comment, formula) and what is in it
can't both be markup, so the reading with the greater gain in log odds is taken, from the inside out.

The trees are fitted on texts generated here, with a fixed seed; they see no corpus. Half of the texts are made
of constructs and of signs in everyday use, so the truth about their nodes is known. The others are random
strings of words and signs, which hold forms that nobody thought of; ``taught`` labels their nodes by what the
languages' definitions say about edges and names, and is used for nothing else. ``SAMPLE`` bounds their number.
"""

from __future__ import annotations

import html as _html
import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from html.entities import html5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.boost import Boosted
from ledgerloom.session import spread

#: Generated texts of each kind that the trees are fitted on.
SAMPLE = 2000

#: The element names of HTML, with old ones that filings use.
TAGS = frozenset(
    """a abbr acronym address applet area article aside audio b base basefont bdi bdo big blink blockquote body br button canvas
    caption center cite code col colgroup data datalist dd del details dfn dialog dir div dl dt em embed fieldset figcaption
    figure font footer form frame frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html i iframe img input ins kbd label legend
    li link main map mark marquee menu meta meter nav nobr noframes nolink noscript nowiki object ol optgroup option output p
    param picture pre progress q rb rp rt rtc ruby s samp script section select slot small source span strike strong style
    sub summary sup svg table tbody td template text textarea tfoot th thead time title tr track tt type u ul var video wbr xbrl
    ref references gallery math syntaxhighlight document page sequence filename description""".split()
)

# name, language, pattern; a group "in" is the content, "key" a name; later entries don't shadow earlier ones
_FORMS: list[tuple[str, str, str]] = [
    ("comment", "html", ""),
    ("tag", "html", r"</?(?P<key>[A-Za-z][A-Za-z0-9]*)(?P<in>(?:\s[^<>]*)?)/?>"),
    ("declaration", "html", r"<[!?](?P<in>[A-Za-z\[][^<>]*)>"),
    ("angle", "html", r"<(?P<in>[^<>\n]*)>"),
    ("reference", "html", r"&(?P<key>#\d+|#[xX][0-9A-Fa-f]+|[A-Za-z][A-Za-z0-9]*);"),
    ("fence", "markdown", ""),
    ("atx", "markdown", r"^[ \t]{0,3}#{1,6}[ \t]+(?P<in>\S[^\n]*)$"),
    ("hash", "markdown", r"#(?P<in>\d[\d,]*)"),
    ("setext", "markdown", r"^(?P<in>[^\n]+)\n[ \t]{0,3}(?:={3,}|-{3,})[ \t]*$"),
    ("strong", "markdown", r"\*\*(?P<in>[^*\n][^\n]*?)\*\*"),
    ("strong", "markdown", r"(?<!\w)__(?P<in>[^_\n]+?)__(?!\w)"),
    ("emphasis", "markdown", r"(?<!\*)\*(?P<in>[^*\n]+)\*(?!\*)"),
    ("underscore", "markdown", r"_(?P<in>[^_\n]+)_"),
    ("strike", "markdown", r"~~(?P<in>[^~\n]+)~~"),
    ("code", "markdown", r"(?<!`)`(?P<in>[^`\n]+)`(?!`)"),
    ("image", "markdown", r"!\[(?P<in>[^\[\]\n]*)\]\((?P<key>[^()\s]*)(?:\s[^()\n]*)?\)"),
    ("link", "markdown", r"(?<!!)\[(?P<in>[^\[\]\n]*)\]\((?P<key>[^()\s]*)(?:\s[^()\n]*)?\)"),
    ("bracket", "markdown", r"(?<![\[\]!])\[(?P<in>[^\[\]\n]+)\](?![\](])"),
    ("delimiter", "markdown", r"^[ \t]*+(?P<in>(?:\|[ \t]*+)?:?-{2,}+:?[ \t]*+(?:\|[ \t]*+:?-{2,}+:?[ \t]*+)++\|?)[ \t]*+$"),
    ("quote", "markdown", r"^[ \t]{0,3}>[ \t]?(?P<in>\S[^\n]*)$"),
    ("rule", "markdown", r"^[ \t]{0,3}(?P<in>(?:\*[ \t]*){3,}|(?:_[ \t]*){3,})$"),
    ("heading", "wiki", r"^(?P<key>={2,6})[ \t]*(?P<in>[^=\n][^\n]*?)[ \t]*(?P=key)[ \t]*$"),
    ("equals", "wiki", r"(?<=\S )==(?P<in>[^=\n]+)==(?!=)"),
    ("apostrophes", "wiki", r"(?P<key>'{2,5})(?P<in>[^'\n](?:[^\n]*?[^'\n])?)(?P=key)"),
    ("wikilink", "wiki", r"\[\[(?P<in>[^\[\]]+)\]\]"),
    ("template", "wiki", r"\{\{(?P<in>[^{}]+)\}\}"),
    ("wikitable", "wiki", ""),
    ("cells", "wiki", r"^[|!](?P<in>-|[^|\n]*(?:\|\||!!)[^\n]*)$"),
    ("external", "wiki", r"(?<!\[)\[(?P<key>https?://[^\s\[\]]+)(?P<in>[^\[\]\n]*)\](?!\()"),
    ("magic", "wiki", r"__(?P<in>NOTOC|TOC|FORCETOC|NOEDITSECTION)__"),
    ("environment", "latex", ""),
    ("display", "latex", r"\$\$(?P<in>[^$]+)\$\$"),
    ("formula", "latex", r"(?<![\\$])\$(?P<in>[^$\n]+)\$(?!\$)"),
    ("command", "latex", r"\\(?P<key>[A-Za-z]+)\*?(?P<in>(?:\[[^\[\]\n]*\])?(?:\{[^{}\n]*\})*)"),
    ("escape", "latex", r"\\(?P<key>[%&$#_{}])"),
    ("break", "latex", r"^(?P<in>[^\\\n]*)\\\\[ \t]*$"),
]
FORMS = [(name, kind, re.compile(pattern, re.M | re.S) if pattern else None) for name, kind, pattern in _FORMS]
_NUMBER = {name: n for n, (name, _, _) in enumerate(FORMS)}
# what a text must hold for a form to be looked for; strong and the like have none of their own
_NEEDS = {
    "tag": "<", "declaration": "<", "angle": "<", "reference": "&", "atx": "#", "hash": "#", "emphasis": "*", "underscore": "_", "strike": "~~", "code": "`", "image": "![", "link": "](", "bracket": "[",
    "delimiter": "--", "quote": ">", "heading": "==", "equals": "==", "apostrophes": "''", "wikilink": "[[", "template": "{{", "external": "[http", "magic": "__", "display": "$$", "formula": "$",
    "command": "\\", "escape": "\\", "break": "\\\\",
}
# forms over many lines: name, opening mark, closing mark; ends are looked up, so marks without one cost nothing
_PAIRED = [
    (name, re.compile(opening, re.M), re.compile(closing, re.M))
    for name, opening, closing in [
        ("comment", r"<!--", r"-->"),
        ("fence", r"^[ \t]{0,3}(?:```|~~~)", r"^[ \t]{0,3}(?:```|~~~)[ \t]*$"),
        ("wikitable", r"^\{\|", r"^\|\}"),
        ("environment", r"\\begin\{([A-Za-z]+\*?)\}", r"\\end\{([A-Za-z]+\*?)\}"),
        ("display", r"\\\[", r"\\\]"),
        ("display", r"\\\(", r"\\\)"),
    ]
]
#: Forms whose content is no markup of its own.
VERBATIM = frozenset({"comment", "fence", "code", "display", "formula"})
#: Forms that no language has; they are there to be told from the others.
LOOKALIKE = frozenset({"angle", "hash", "underscore", "bracket", "equals"})
#: What a text must match one of for any form to; the JVM's filter before Python. The first starts with a class
#: of single characters, which both engines scan for quickly; the second holds what starts a line.
SIGNS = (
    r"[<&`~*_'\[\]!{\\$](?:(?<=<)[A-Za-z/!?]|(?<=&)[#A-Za-z][A-Za-z0-9]*;|(?<=`)|(?<=~)~|(?<=\*)(?:\*[^*\n]+\*\*|[^*\n]+\*)|(?<=_)_"
    r"|(?<=(?<!\w)_)[^_\n]+_(?!\w)|(?<=')'|(?<=\[)(?:\[|https?://)|(?<=\])\(|(?<=\{)\{|(?<=\\)[A-Za-z%&$#_{}\[(\\]|(?<=\$)(?:\$|[^$\n\\_^={}]*+[\\_^={}][^$\n]*+\$|[^\s\d$][^ \n$]*+\$))",
    r"(?m)^(?:[ \t]{0,3}(?:#{1,6}[ \t]|>|={3,}[ \t]*$|-{3,}[ \t]*$|(?:\*[ \t]*){3,}$|_[ \t]*_)|={2,6}[^\n]*==[ \t]*$|\{\||[|!][^\n]*(?:\|\||!!)|\|-|[ \t]*+(?:\|[ \t]*+)?:?-{2,}+:?[ \t]*+\|)",
)
_SIGNS = tuple(map(re.compile, SIGNS))


def signs_in(text: str) -> bool:
    return bool(_SIGNS[0].search(text) or _SIGNS[1].search(text))


class Node:
    __slots__ = ("children", "close", "depth", "elements", "end", "form", "inner", "key", "kind", "parent", "rank", "same", "start", "verbatim")

    def __init__(self, form: int, start: int, end: int, inner: tuple[int, int], key: str):
        self.form, self.start, self.end, self.inner, self.key = form, start, end, inner, key
        self.kind = FORMS[form][1]
        self.parent: Node | None = None
        self.verbatim: Node | None = None  # the nearest verbatim node around
        self.children: list[Node] = []
        self.close: Node | None = None  # of a tag: the one that it opens or closes with
        self.depth, self.same, self.rank, self.elements = 0, 1, 0, 0

    @property
    def name(self) -> str:
        return FORMS[self.form][0]


def _long(text: str) -> Iterator[Node]:
    """Nodes of the forms that may reach over lines; each mark is looked at once."""
    for name, opening, closing in _PAIRED:
        ends: dict[str, list[tuple[int, int]]] = {}
        for m in closing.finditer(text) if opening.search(text) else ():
            ends.setdefault(m.group(1) if closing.groups else "", []).append(m.span())
        at = 0
        for m in opening.finditer(text) if ends else ():
            key = m.group(1) if opening.groups else ""
            own = ends.get(key, ())
            i = bisect_left(own, (m.end(), -1))
            if m.start() >= at and i < len(own):
                low, high = own[i]
                yield Node(_NUMBER[name], m.start(), high, (m.end(), low), key)
                at = high


def parse(text: str) -> list[Node]:
    """The nodes of a text in order; each knows the narrowest node around it."""
    nodes: list[Node] = list(_long(text))
    for n, (name, _, pattern) in enumerate(FORMS):
        if pattern is None or _NEEDS.get(name, "") not in text:
            continue
        for m in pattern.finditer(text):
            groups = m.groupdict()
            inner = m.span("in") if groups.get("in") is not None else (m.end(), m.end())
            if name == "angle" and re.match(r"[A-Za-z/!?]", groups["in"]):
                continue  # a tag or declaration
            nodes.append(Node(n, *m.span(), inner, groups.get("key") or ""))
    nodes.sort(key=lambda x: (x.start, -x.end, x.form))
    stack: list[Node] = []
    names: dict[int, int] = {}
    for x in nodes:
        while stack and stack[-1].end < x.end:
            stack.pop()
        while stack and stack[-1].end <= x.start:
            stack.pop()
        if stack:
            x.parent = stack[-1]
            x.depth = x.parent.depth + 1
            x.rank = len(x.parent.children)
            x.verbatim = x.parent if x.parent.name in VERBATIM else x.parent.verbatim
            x.parent.children.append(x)
        stack.append(x)
        names[x.form] = names.get(x.form, 0) + 1
    for x in nodes:
        x.same = names[x.form]
    _elements(text, [x for x in nodes if x.name == "tag"])
    return nodes


def _elements(text: str, tags: list[Node]) -> None:
    """Opening and closing tags that belong together, with the element's depth, place and number of elements in it.

    A closing tag closes the nearest open one of its name and all opened since, as in a DOM.
    """
    stack: list[Node] = []
    open_now: dict[str, int] = {}
    for x in tags:
        key = x.key.lower()
        if text[x.start + 1] == "/":
            if open_now.get(key):
                while stack:
                    y = stack.pop()
                    open_now[y.key.lower()] -= 1
                    if y.key.lower() == key:
                        x.close, y.close = y, x
                        x.depth, x.rank, x.elements = y.depth, y.rank, y.elements
                        break
            continue
        if stack:
            x.rank = max(x.rank, stack[-1].elements)
            for y in stack[-1:]:
                y.elements += 1
        x.depth = max(x.depth, len(stack))
        if text[x.end - 2] != "/" and key not in ("br", "hr", "img", "input", "meta", "link"):
            stack.append(x)
            open_now[key] = open_now.get(key, 0) + 1


def _class(c: str) -> int:
    """What stands at an edge: nothing or a line's end, space, mark, word."""
    if not c or c == "\n":
        return 0
    if c.isspace():
        return 1
    if c.isalpha():
        return 9
    if c.isdigit():
        return 8
    at = _EDGES.find(c)
    return 2 + at if at >= 0 else 5 if c in ".,;!?%)\"'" else 6


# marks with a meaning of their own, from class 2 on
_EDGES = "\\:/"


@lru_cache(maxsize=1)
def _alnum() -> np.ndarray:
    return np.array([chr(i).isalnum() for i in range(0x110000)])


class _Text:
    """A text with a running count of its letters and digits, so that an element's density costs the same however long it is."""

    def __init__(self, text: str):
        self.text = text
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        self.letters = np.concatenate(([0], np.cumsum(_alnum()[codes])))
        self.around: dict[int, tuple] = {}  # of verbatim nodes, what all in them are told


_TEX = re.compile(r"[{\\_^=}]")


def features(text: _Text, x: Node) -> tuple:
    """Of one node: form, place in the tree, siblings, subtree's density of text, attribute tokens, edges.

    Nodes of one form don't overlap, so counting in what each holds reads a text once for each form at most.
    """
    t, (low, high), start, end = text.text, x.inner, x.start, x.end
    letters = text.letters
    size, room = max(1, end - start), high - low
    own = int(letters[high] - letters[low])
    # the subtree of a tag is its element
    first, last = (min(start, x.close.start), max(end, x.close.end)) if x.close else (start, end)
    v = x.verbatim
    up = (-1, -1, -1, -1, -1)
    if v is not None:
        up = text.around.get(id(v))
        if up is None:
            a, b = v.inner
            up = text.around[id(v)] = (v.form, _class(t[a : a + 1]), _class(t[max(a, b - 1) : b]), _class(t[v.end : v.end + 1]), _TEX.search(t, a, b) is not None)
    begin = low
    while begin < high and begin < low + 4 and t[begin] in " \t":
        begin += 1
    before, after = t[start - 1 : start] if start else "", t[end : end + 1]
    siblings = len(x.parent.children) if x.parent else 0
    return (
        x.form,
        x.depth,
        len(x.children) + x.elements,
        siblings,
        x.rank,
        x.same,
        x.parent.form if x.parent else -1,
        *up,
        own / max(1, room),
        int(letters[last] - letters[first]) / max(1, last - first),  # density of the subtree's text
        (size - room) / size,
        min(size, 2000),
        x.close is not None,
        known(x),
        t.count("=", low, high),  # attributes
        min(t.count(" ", low, high), 50),
        t.count("&", low, high),
        t.count("|", low, high) + t.count("!", low, high),
        room > 0 and t.count("-", low, high) == room,
        _class(before),
        _class(after),
        _class(t[low]) if room else -1,
        _class(t[high - 1]) if room else -1,
        t[begin] in "|=" if begin < high else -1,
        room > 0 and t[low] == "*",
        before in ("*", "_", "("),
        before == "\\",
        after == "\\",
        room > 0 and _TEX.search(t, low, high) is not None,
        own > 0,
        x.name == "cells" and (t.find("||", low, high) >= 0 or t.find("!!", low, high) >= 0),
        room > 0 and t[low:high].isspace(),
        len(x.key),
    )


def known(x: Node) -> int:
    """1 if the name that the node uses exists in its language."""
    if x.name == "tag":
        return int(x.key.lower() in TAGS)
    if x.name == "reference":
        return int(x.key[0] == "#" or x.key + ";" in html5)
    return int(bool(x.key))


def decode(nodes: list[Node], odds: np.ndarray) -> list[bool]:
    """Which nodes are markup, so that no verbatim node and something in it both are, with the greatest sum of log odds.

    From the inside out: a node's best reading is its own gain, where that is positive, with the best readings of
    what is in it, and for a verbatim node either of the two.
    """
    index = {id(x): i for i, x in enumerate(nodes)}
    gain = np.maximum(odds, 0.0)
    below = np.zeros(len(nodes))
    closed = np.zeros(len(nodes), bool)
    for i in range(len(nodes) - 1, -1, -1):  # children stand after their parents
        x = nodes[i]
        if x.name in VERBATIM and gain[i] > below[i]:
            closed[i], best = True, gain[i]
        else:
            if x.name in VERBATIM and below[i] > 0:
                gain[i] = 0.0
            best = gain[i] + below[i]
        if x.parent is not None:
            below[index[id(x.parent)]] += best
    hidden = np.zeros(len(nodes), bool)
    for i, x in enumerate(nodes):
        up = index[id(x.parent)] if x.parent is not None else -1
        hidden[i] = up >= 0 and (hidden[up] or closed[up])
    return [bool(g > 0 and not h) for g, h in zip(gain, hidden, strict=True)]


# ---- the generated texts


_TAGS = sorted(TAGS)
_WORDS = "revenue demand for the segment grew while costs of storage fell in most regions and management expects volume to remain stable"


def _sample(rng: random.Random) -> tuple[str, list[tuple[int, int, str]]]:
    """A text and the spans in it that are markup."""
    words = _WORDS.split()
    odd = lambda: rng.choice([f"{rng.randint(1, 99999):,}", "R&D", f"{rng.randint(1, 99)}.{rng.randint(0, 9)}%", "(net)", f"${rng.randint(1, 999)}", "non-cash", "2018,", "P&L", "and/or", "No. 5"])
    some = lambda a=1, b=6: " ".join(odd() if rng.random() < 0.12 else rng.choice(words) for _ in range(rng.randint(a, b))) + (rng.choice([",", ".", ";", ":", "!"]) if rng.random() < 0.1 else "")
    num = lambda: f"{rng.randint(1, 99999):,}"
    tag = lambda: rng.choice(["b", "SPAN", "i", "em", "font", "div", "p", "td", "a", "sup", "li", "u"])
    name = lambda: "".join(rng.choice(["Mar", "bel", "Tor", "wex", "kin", "Sol"]) for _ in range(2))
    t = tag()
    inline = [
        ("html", f"<{t}>{some()}</{t}>"), ("html", f'<{t} class="x{rng.randint(1, 9)}">{some()}</{t}>'), ("html", "<br/>"), ("html", "<BR>"),
        ("html", f"</{t}>"), ("html", f"<!-- {some()} -->"), ("html", rng.choice(["&nbsp;", "&amp;", "&#8217;", "&#x2022;", "&mdash;", "&lt;"])),
        ("html", f'<a href="https://x.example/{num()}">{some()}</a>'), ("html", f"<ref>{some()}</ref>"),
        ("markdown", f"**{some(1, 4)}**"), ("markdown", f"*{some(1, 4)}*"), ("markdown", f"*{num()}*"), ("markdown", f"*${num()}*"), ("markdown", f"**{num()} of**"),
        ("markdown", f"`{some(1, 3)}`"), ("markdown", f"`{num()}`"), ("markdown", f"`{num()} {some(1, 2)}{rng.choice([',', '.', ''])}`"), ("markdown", f"`{some(1, 2)} {num()}`"), ("markdown", f"[{some(1, 3)}](https://x.example/{rng.randint(1, 9999)})"),
        ("markdown", f"![{name()}](images/f_{rng.randint(1, 99)}.png)"), ("markdown", f"~~{some(1, 3)}~~"), ("markdown", f"__{some(1, 3)}__"), ("markdown", f"_{some(1, 2)}_"),
        ("wiki", f"''{some(1, 3)}''"), ("wiki", f"'''{some(1, 3)}'''"), ("wiki", f"''{num()}''"), ("wiki", f"[[{some(1, 3)}]]"), ("wiki", f"[[{name()} ({name()} {num()})|{some(1, 2)}]]"),
        ("wiki", f"[https://x.example/{num()} {some(1, 3)}]"), ("wiki", f"{{{{{name()}|{some(1, 2)}={num()}}}}}"),
        ("latex", f"\\textbf{{{some(1, 3)}}}"), ("latex", f"\\emph{{{some(1, 3)}}}"), ("latex", f"~\\cite{{{name()}{rng.randint(1, 99)}}}"), ("latex", f"{num()}\\%"),
        ("latex", f"$x_{{{rng.randint(1, 9999)}}} = \\frac{{{num()}}}{{{num()}}}$"), ("latex", "$a^2 + b$"), ("latex", f"\\S {name()}"), ("latex", f"R\\&D {some()}"),
        ("latex", "\\( x_1 < y \\)"), ("latex", "\\LaTeX"), ("latex", "$n = 5$"), ("latex", f"${rng.choice('abcnxyzNPV')}$"), ("latex", f"${rng.choice('abxy')}_{rng.randint(1, 9)} & {rng.choice('abxy')}$"),
        ("html", f"<{(any_tag := rng.choice(_TAGS))}>{some(1, 3)}</{any_tag}>"), ("html", f"<{rng.choice(_TAGS)} id='{name()}' {rng.choice('abc')}={num()}>"), ("html", f"&{rng.choice(_REFERENCES)}"),
        ("markdown", f"`<{t}>`"), ("markdown", f"`{name()} <{t}> {rng.choice('ab')}_{rng.choice('xy')} &amp;`"), ("markdown", f"`\\{name()}{{{some(1, 2)}}}`"), ("html", f"<!-- <{t}>{some(1, 2)}</{t}> **{some(1, 1)}** -->"),
    ]
    block = [
        ("html", f"<table><tr><td>{some()}</td><td align=right>{num()}</td></tr></table>"), ("html", f"<ul>\n<li>{some()}</li>\n<li>{some()}</li>\n</ul>"),
        ("html", f"<pre><code>{name()} = a / {num()}\nprint({name()})\n</code></pre>"), ("html", f"<h2>{some()}</h2>"),
        ("markdown", "#" * rng.randint(1, 6) + f" {some()}"), ("markdown", f"{some()}\n{rng.choice('=-') * rng.randint(3, 20)}"), ("markdown", f"```python\nm_{rng.randint(1, 99)} = gross / net\n```"),
        ("markdown", f"| {some(1, 2)} | now |\n|:---|---:|\n| {some(1, 2)} | {num()} |"), ("markdown", f"> {some(3, 9)}"),
        ("wiki", f"== {some(1, 3)} =="), ("wiki", f"=== {some(1, 3)} {num()} ==="), ("wiki", f"[[Category:{name()}]]"), ("wiki", f'{{| class="wikitable"\n! {name()} !! now\n|-\n| {some(1, 2)} || {num()}\n|}}'),
        ("latex", f"\\begin{{itemize}}\n\\item {some()}\n\\item {some()}\n\\end{{itemize}}"), ("latex", f"\\section{{{some(1, 3)}}}"), ("latex", f"\\[ x_{{{rng.randint(1, 99)}}} \\leq {num()} \\]"),
        ("latex", f"\\begin{{tabular}}{{lr}}\n{some(1, 2)} & {num()} \\\\\n{some(1, 2)} & {num()} \\\\\n\\end{{tabular}}"), ("latex", f"\\begin{{equation}}\nV_{{{rng.randint(1, 99)}}} = \\sum_{{t=1}}^{{9}} C_t (1+i)^{{-t}}\n\\end{{equation}}"),
        ("latex", f"$$ x = {num()} + y_1 $$"), ("markdown", f"```\n<{t}>{some()}</{t}>\n**{some(1, 2)}** &amp; \\{name()}{{x}}\n```"), ("html", f"<div><p>{some()}</p><p><{t}>{some(1, 2)}</{t}> {num()}</p></div>"),
        ("html", f"<!--\n{some()}\n<{t}>{num()}\n-->"),
    ]
    plain = [
        "R&D;", "R&D", "P&L", "r&d;", f"AT&T; {some()}", f"{num()} & {some()}", f"< {num()}% and {some()} > {num()}%", f"<{num()} or {some()} >{num()}", f"{num()} <= {num()}",
        f"#{num()}", f"[{num()}]", f"(see note [{num()}])", f"${num()} to ${num()} per unit", f"${num()} million and {some()} ${num()} thousand", f"~ {num()}%", f"{num()} * {num()}",
        f"5*{num()} and 2*{num()}", f"Totals** for {some()} exclude, and margins** for {some()}", f"(** see note {num()})", "cost_center_code", f"{name()}_{name()}_id and total_{name()}_x",
        f"C:\\finance\\{name()}\\2022.", f"\\\\server\\share\\{name()}.xls", f"D:\\{name()}\\{name()}", f"a == b == {num()}", f"assets == liabilities == {num()} held", f"{some()} | {num()} | ${num()}",
        f"'{some(1, 2)}'", "the '90s", f"{num()}* and {num()}*", f"https://x.example/{name()}_a/{name()}", f"{some()} -- {some()}", f"{{{some(1, 2)}}}", f"{name()}@x.example", f"[{some(1, 2)}]", f"<{name()}>", f"<{some(2, 3)}>", f"&{name()};", f"${num()} {some(1, 3)} to ${num()}", f"{num()}$ and {num()}$", "a_b_c",
    ]
    plain_block = [f"* Includes {num()} of {some()}", f"• {some()}", f"- {some()}\n- {some()}", f"1. {some()}", f"{some(1, 2)} | {name()} | {num()}\n{some(1, 2)} | {name()} | {num()}", f"* {some()} **", f"— {some()} —"]
    out, spans, at = [], [], 0

    def put(piece: str) -> None:
        nonlocal at
        out.append(piece)
        at += len(piece)

    for _ in range(rng.choice([1, 2, 4, 7, 12])):
        whole = rng.random() >= 0.6
        pieces: list[tuple[str, str]] = [rng.choice(block) if rng.random() < 0.6 else ("", rng.choice(plain_block))] if whole else []
        for _ in range(0 if whole else rng.randint(1, 4)):
            pieces += [("", some(2, 9)), rng.choice(inline) if rng.random() < 0.45 else ("", rng.choice(plain))]
        for i, (kind, piece) in enumerate(pieces):
            command = re.match(r"\\[A-Za-z]", piece) is not None
            if i and (kind not in ("html", "latex") or command or rng.random() < 0.7):
                put(rng.choice([" "] * 6 + [", ", " (", '"', "-"]))
            elif i and kind and rng.random() < 0.3:
                put(rng.choice([",", ".", "(", ")", "%", '"', "-"]))
            if kind:
                spans.append((at, at + len(piece), kind))
            put(piece)
            if kind and not whole and rng.random() < 0.25 and not command:
                put(rng.choice([",", ".", ";", ")", ":", '"']))
            elif kind == "html" and not whole and rng.random() < 0.2:
                put(rng.choice(words))
        put(rng.choice(["\n", "\n\n"] if whole else [".\n", "\n", "\n\n", ".\n\n"]))
    return "".join(out), spans


def _noise(rng: random.Random) -> str:
    """Words and signs in any order."""
    out = []
    for _ in range(rng.randint(8, 90)):
        out.append(rng.choice(_WORDS.split()) if rng.random() < 0.45 else str(rng.randint(0, 9999)) if rng.random() < 0.15 else rng.choice(_MARKS))
        out.append(rng.choice(["", "", " ", " ", "\n"]) if rng.random() < 0.9 else rng.choice(["\n\n", ", ", ". "]))
    return "".join(out)


_MARKS = r"""* ** _ __ ` `` ``` $ $$ \ \\ < </ > & ; # ## [ ] [[ ]] { } {{ }} == === '' ''' | || ! !! ~ ~~ ( ) - --- = \% \& \( \) \[ \] % <b> </b> <br/> <x> <!-- --> &amp;
    &no; \alpha \item \begin{a} \end{a} ^ : / C:\ {| |} |- ![ ]( https://x.example/a # *a* _b_ $x_1$ $5 **c** `d` ''e'' [[f]] {{g}} \h{i}""".split()
_REFERENCES = sorted(x for x in html5 if x.endswith(";"))


def taught(text: str, x: Node) -> bool:
    """What a node of random signs is called for the fit: the languages' rules on names and edges, as a label only."""
    name, (low, high) = x.name, x.inner
    inner, before, after = text[low:high], text[x.start - 1 : x.start] if x.start else "", text[x.end : x.end + 1]
    flanked = inner.strip() != "" and not inner[0].isspace() and not inner[-1].isspace()
    word = before.isalnum() or after.isalnum()
    if name in LOOKALIKE - {"underscore"}:
        return False
    if name in ("tag", "reference"):
        return bool(known(x))
    if name in ("strong", "emphasis", "strike", "underscore"):
        return flanked and not word and not (inner[0] == "*" and before in ("*", "_", "("))
    if name == "apostrophes":
        return flanked and not word
    if name == "formula":  # between two amounts of money there is text
        return flanked and not after.isdigit() and (bool(re.search(r"[\\_^={}]", inner)) or (" " not in inner and not inner[0].isdigit()))
    if name == "command":
        return not (before.isalnum() or before in ("\\", ":", "/") or after == "\\")
    if name == "escape":
        return before != "\\"
    if name == "setext":
        return inner.strip() != "" and not inner.lstrip().startswith(("|", "="))
    if name == "break":
        return "&" in inner
    if name == "cells":
        return (x.parent is not None and x.parent.name == "wikitable") or "||" in inner or "!!" in inner or inner == "-"
    return True


def _labelled(rng: random.Random, noise: bool) -> Iterator[tuple[tuple, bool]]:
    """Features and labels of the nodes of one generated text."""
    text, spans = (_noise(rng), []) if noise else _sample(rng)
    nodes = parse(text)
    own = _Text(text)
    true: dict[int, bool] = {}
    for x in nodes:
        made = x.name not in LOOKALIKE - {"underscore"} and any(a <= x.start and x.end <= b + 2 and k == x.kind for a, b, k in spans)
        up, hidden = x.verbatim, False
        while up is not None:  # content of what is markup and verbatim is none of its own
            hidden, up = hidden or true[id(up)], up.verbatim
        true[id(x)] = (taught(text, x) if noise else made) and not hidden
        yield features(own, x), true[id(x)]


@lru_cache(maxsize=1)
def model(seed: int = 7) -> Boosted:
    """The trees, fitted on generated texts; the same on every machine.

    A fifth of the texts is held out; odds are shifted so that 0 is where F1 on those is best.
    """
    rng = random.Random(seed)
    x, y, held = [], [], []
    for i in range(2 * SAMPLE):
        for row, label in _labelled(rng, i % 2 == 1):
            x.append(row)
            y.append(label)
            held.append(i % 10 >= 8)
    x, y, held = np.array(x, dtype=float), np.array(y, dtype=float), np.array(held)
    trees = Boosted(100, 6, columns=0.4).fit(x[~held], y[~held])
    odds, true = trees.margin(x[held]), y[held] > 0
    grid = np.arange(-2.0, 2.01, 0.25)
    f1 = [2 * np.sum((odds > g) & true) / max(1, np.sum(odds > g) + true.sum()) for g in grid]
    trees.base -= float(max(zip(f1, -np.abs(grid), grid, strict=True))[2])
    return trees


def constructs(texts: list[str], trees: Boosted) -> list[list[Node]]:
    """The nodes of each text that are markup."""
    parsed = [parse(t) for t in texts]
    x = []
    for t, nodes in zip(texts, parsed, strict=True):
        if nodes:
            own = _Text(t)
            x.extend(features(own, n) for n in nodes)
    if not x:
        return [[] for _ in texts]
    odds = trees.margin(np.array(x, dtype=float))
    out, at = [], 0
    for nodes in parsed:
        kept = decode(nodes, odds[at : at + len(nodes)])
        at += len(nodes)
        out.append([n for n, k in zip(nodes, kept, strict=True) if k])
    return out


# ---- clean text


def _lines(x: str) -> str:
    return re.sub(r"\n{3,}", "\n\n", x)


def _latex_word(key: str) -> str:
    return {"S": "§", "P": "¶", "ldots": "…", "dots": "…", "LaTeX": "LaTeX", "TeX": "TeX", "item": "- "}.get(key, "")


def clean(text: str, nodes: list[Node]) -> str:
    """The text without the given constructs; their content stays.

    Headings keep their own line, list entries start with ``- ``, cells of a table row are joined by bars,
    code and formulas stay letter by letter, links and images leave their labels, comments, citations and
    categories go. A text without constructs comes back as it is.
    """
    if not nodes:
        return text
    chosen = {id(n) for n in nodes}
    top: list[Node] = []
    below: dict[int, list[Node]] = {}
    for n in nodes:
        up = n.parent
        while up is not None and id(up) not in chosen:
            up = up.parent
        (top if up is None else below.setdefault(id(up), [])).append(n)

    def span(low: int, high: int, own: list[Node]) -> str:
        out, at = [], low
        for n in sorted(own, key=lambda n: n.start):
            if n.start < at or n.end > high:
                continue
            out.append(text[at : n.start])
            out.append(one(n))
            at = n.end
        out.append(text[at:high])
        return "".join(out)

    def one(n: Node) -> str:
        name, (low, high) = n.name, n.inner
        inner = text[low:high]
        kids = below.get(id(n), [])
        if name in ("comment", "declaration", "delimiter", "rule", "magic"):
            return ""
        if name == "tag":
            return _tag(n.key.lower(), text[n.start + 1] == "/")
        if name == "reference":
            return _html.unescape(text[n.start : n.end]).replace("\xa0", " ")
        if name == "fence":
            return inner.partition("\n")[2].rstrip("\n")
        if name in ("image", "link", "external"):
            return span(low, high, kids).strip()
        if name == "wikilink":
            return "" if re.match(r"(?i)\s*(category|kategorie|catégorie|categoría)\s*:", inner) else inner.rpartition("|")[2]
        if name == "template":
            head, *fields = inner.split("|")
            return "; ".join([head.strip(), *(f.strip() for f in fields)])
        if name == "wikitable":
            rows, row = [], []
            for line in inner.split("\n")[1:]:
                if line.startswith("|-"):
                    rows.append(row)
                    row = []
                elif line[:1] in ("|", "!"):
                    row.extend(c.strip() for c in re.split(r"\|\||!!", line[1:]))
            return "\n".join(" | ".join(r) for r in [*rows, row] if r)
        if name == "cells":
            return "" if inner == "-" else " | ".join(c.strip() for c in re.split(r"\|\||!!", inner))
        if name == "environment":
            inside = span(low, high, kids)
            return re.sub(r"^\{[^}\n]*\}", "", inside).strip("\n")
        if name == "display":
            return next(text[a:b] for a, b in [n.inner]).strip()
        if name == "command":
            if n.key in ("cite", "label", "ref", "footnotemark", "bibliography"):
                return ""
            arguments = re.findall(r"\{([^{}\n]*)\}", inner)
            return arguments[-1] if arguments and n.key not in ("begin", "end", "frac") else text[n.start : n.end] if n.key == "frac" else _latex_word(n.key)
        if name == "escape":
            return n.key
        if name == "break":
            return " | ".join(c.strip() for c in span(low, high, kids).split("&"))
        return span(low, high, kids)

    lines = span(0, len(text), top).split("\n")
    # rows of a table in Markdown lose the bars around them once a delimiter row went
    if any(n.name == "delimiter" for n in nodes):
        lines = [re.sub(r"^\s*\|\s*|\s*\|\s*$", "", x) if x.strip().startswith("|") else x for x in lines]
    return _lines("\n".join(lines))


def _tag(key: str, closing: bool) -> str:
    if key in ("br", "hr") or closing and key in ("tr", "table", "p", "div", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "li", "pre", "blockquote"):
        return "\n"
    if not closing and key == "li":
        return "- "
    return " | " if closing and key in ("td", "th") else ""


# ---- on tables


def markup_kinds(items: DataFrame, key: str = "chunk_id", text: str = "text") -> DataFrame:
    """``(key, kind)`` for each item and markup language that its text has a construct of.

    Null and empty texts have none; repeated rows give repeated rows. Texts without any sign of markup are
    passed over in the JVM; the others go to Python whole.
    """
    trees = model()

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                at, kinds = [], []
                for i, nodes in enumerate(constructs(part.column(1).to_pylist(), trees)):
                    for kind in sorted({n.kind for n in nodes}):
                        at.append(i)
                        kinds.append(kind)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at, pa.int32())), pa.array(kinds, pa.string())], names=[key, "kind"])

    signs = spread(items.select(key, text)).where(F.col(text).rlike(SIGNS[0]) | F.col(text).rlike(SIGNS[1]))
    return signs.mapInArrow(search, f"`{key}` {dict(items.dtypes)[key]}, kind string")


def clean_markup(items: DataFrame, key: str = "chunk_id", text: str = "text") -> DataFrame:
    """``(key, text, kinds)`` of every item: clean text, and the languages whose constructs were taken out.

    Null texts stay null. One pass; texts without any sign of markup take the short way through Python.
    """
    trees = model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                texts = part.column(1).to_pylist()
                dirty = [i for i, t in enumerate(texts) if t and signs_in(t)]
                kinds: list[list[str]] = [[] for _ in texts]
                for i, nodes in zip(dirty, constructs([texts[i] for i in dirty], trees), strict=True):
                    kinds[i] = sorted({n.kind for n in nodes})
                    texts[i] = clean(texts[i], nodes)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string()), pa.array(kinds, pa.list_(pa.string()))], names=[key, "text", "kinds"])

    return spread(items.select(key, text)).mapInArrow(run, f"`{key}` {dict(items.dtypes)[key]}, text string, kinds array<string>")
