"""Word normalisation shared by transcript operators."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tickloom.functions.timebase import col

EDGES = r"^[^\p{IsAlphabetic}\p{N}]+|[^\p{IsAlphabetic}\p{N}]+$"


def normal(x) -> Column:
    """Lower case without punctuation at either end."""
    return F.lower(F.regexp_replace(col(x), EDGES, ""))


def normal_str(s: str) -> str:
    a, b = 0, len(s)
    while a < b and not s[a].isalnum():
        a += 1
    while b > a and not s[b - 1].isalnum():
        b -= 1
    return s[a:b].lower()


def tokens(text) -> Column:
    """Normalised words of a text; hyphenated words count as two."""
    return F.filter(F.transform(F.split(col(text), r"(?U)[\s\-]"), normal), lambda w: w != "")
