"""Quality rules as a short-circuit cascade, ordered by rejections per cost measured on a sample."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.repeats import covered, grams
from tickloom.llm.sampling import bounded
from tickloom.llm.text import BYTE_CODES, SPACE, prefix_sums, span_hash, word_spans

_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LOWER = np.zeros(256, bool)
_LOWER[97:123] = True


class Text:
    """One whole text and what rules ask of it, made when first asked for."""

    def __init__(self, text: bytes | None) -> None:
        self.bytes = text or b""

    @cached_property
    def raw(self) -> np.ndarray:
        return np.frombuffer(self.bytes, np.uint8)

    @cached_property
    def spans(self) -> tuple[np.ndarray, np.ndarray]:
        return word_spans(self.raw)

    @cached_property
    def n_words(self) -> int:
        return len(self.spans[0])

    @cached_property
    def codes(self) -> np.ndarray:
        return span_hash(prefix_sums(BYTE_CODES[self.raw]), *self.spans) if self.n_words else np.zeros(0, np.uint64)

    @cached_property
    def word_chars(self) -> int:
        return int(np.count_nonzero(((self.raw & 0xC0) != 0x80) & ~SPACE[self.raw]))

    @cached_property
    def n_symbols(self) -> int:
        return int(np.count_nonzero(_SYMBOL[self.raw]))

    @cached_property
    def lines(self) -> list[bytes]:
        return [x for x in self.bytes.split(b"\n") if x.split(None, 1)]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words in runs of five words that occur at least twice in the text."""
        if self.n_words < 6:
            return 0
        _, back, n = np.unique(grams(prefix_sums(self.codes), 5), return_inverse=True, return_counts=True)
        at = np.flatnonzero(n[back] > 1)
        return int(covered(self.n_words, at, at + 5).sum())

    @cached_property
    def base_failed(self) -> bool:
        return self.n_words < 10 or 100 * self.n_repeat_words > 20 * self.n_words


def _shouts(t: Text) -> bool:
    up, low = int(np.count_nonzero(_UPPER[t.raw])), int(np.count_nonzero(_LOWER[t.raw]))
    return up > 2 * low and up > 20


def _stutters(t: Text) -> bool:
    return t.n_words > 1 and 5 * int(np.count_nonzero(t.codes[1:] == t.codes[:-1])) > t.n_words


#: name -> what the rule rejects. Each reads the whole text.
RULES: dict[str, Callable[[Text], bool]] = {
    "symbols": lambda t: 5 * t.n_symbols > t.n_words,
    "shouting": _shouts,
    "word_length": lambda t: not 2 * t.n_words <= t.word_chars <= 20 * t.n_words,
    "duplicate_lines": lambda t: t.n_dup_lines >= 3 and 2 * t.n_dup_lines > len(t.lines),
    "stutter": _stutters,
}


def cascade_order(docs: DataFrame, rules: dict[str, Callable[[Text], bool]] = RULES, sample: int = 2000, id_col: str = "doc_id", text_col: str = "text") -> list[tuple[str, float, float]]:
    """(rule, share rejected, seconds per text), best first: by rejected share per second, measured on a sample.

    The sample has about ``sample`` texts, chosen by a hash; each rule is timed alone on a fresh text where the text is.
    The order decides only what is spared, never what is kept, so timings that differ between runs do not show.
    """

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for name, rule in rules.items():
                began, bad = time.perf_counter(), 0
                for t in b["text"]:
                    bad += rule(Text(t))
                out.append((name, len(b), bad, time.perf_counter() - began))
            yield pd.DataFrame(out, columns=["rule", "n", "bad", "s"])

    some = bounded(docs.select(id_col, F.col(text_col).cast("binary").alias("text")), F.coalesce(F.col(id_col).cast("string"), F.lit("")), sample).select("text")
    seen = some.mapInPandas(measure, "rule string, n long, bad long, s double").groupBy("rule").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.sum("s").alias("s"))
    rows = {r["rule"]: (r["bad"] / r["n"], r["s"] / r["n"]) for r in seen.collect()}  # one row per rule
    found = [(name, *rows.get(name, (0.0, 1.0))) for name in rules]
    return sorted(found, key=lambda r: (-r[1] / max(r[2], 1e-9), r[0]))


def apply_rules(docs: DataFrame, rules: dict[str, Callable[[Text], bool]] = RULES, order: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept) of every document.

    ``kept`` is false if the base rule fails; else the rules run in ``order`` (measured by ``cascade_order`` where not
    given) and stop at the first that rejects. Null and empty texts have zero counts and fail the base rule; null ids
    are carried; rows that repeat are judged each; other columns are ignored; an empty table has an empty result.
    """
    order = [r[0] for r in cascade_order(docs, rules, id_col=id_col, text_col=text_col)] if order is None else order

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for key, text in zip(b["id"], b["text"], strict=True):
                t = Text(text)
                kept = not t.base_failed and not any(rules[name](t) for name in order)
                out.append((key, t.n_words, t.word_chars, t.n_symbols, t.n_dup_lines, t.n_repeat_words, t.base_failed, kept))
            yield pd.DataFrame(out, columns=["id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]).astype({"id": "Int64"})

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text")).mapInPandas(
        judge, "id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean"
    )
