"""Folding and tokens, as expressions of Spark and as Python, with the same results."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of Unicode, for a character class of Java or RE2.
WHITE = r"\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: Characters that are no white space but aren't visible either.
UNSEEN = WHITE + r"\x{200b}\x{ad}\x{feff}"
#: One token: a started group of eight letters or digits, or one other visible character.
TOKEN_JVM = r"[\p{L}\p{N}]{1,8}|[^\p{L}\p{N}" + UNSEEN + "]"
TOKEN = re.compile("[^\\W_]{1,8}|[^\\w\\s​­﻿]|_")
NOT_FOLDED = r"[^\p{L}\p{N}]+"


def folded(text: Column) -> Column:
    """Lower case, letters and digits only."""
    return F.regexp_replace(F.lower(text), NOT_FOLDED, "")


def token_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(TOKEN_JVM))


def count_tokens(text: str) -> int:
    return sum(1 for _ in TOKEN.finditer(text))
