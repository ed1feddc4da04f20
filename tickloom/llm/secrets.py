"""Secret scan: wide candidate search, false positives removed by a random forest trained from labelled findings."""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.sampling import bounded

#: Bound of the sample of labelled findings that the forest is fitted on (rows), and the forest's shape.
SAMPLE = 20_000
TREES = 48
DEPTH = 9

#: A candidate is a part of a run of token characters of at least this length with a digit in it, or what follows a
#: name such as ``password =``, then of any characters and at least the second length.
LEAST = 10
NAMED_LEAST = 4
_CANDIDATE = re.compile(rb"[A-Za-z0-9+/=_.@:\-]{%d,}" % LEAST)
_DIGIT = re.compile(rb"[0-9]")
#: Parts of a run; padding at the end of a part belongs to it.
_PART = re.compile(rb"[^=:]+(?:=+(?=:|\Z))?")
_NAME = re.compile(rb"""(?i)(?:(?:key|token|secret|passw|pwd|auth|credential)[\w\-]{0,40}["']?[ \t]{0,8}(?:=>|:=|[=:])|bearer)[ \t]{0,8}""")
_VALUE = re.compile(rb"""(?:"([^"\r\n]{%d,})"|'([^'\r\n]{%d,})'|["']?([^\s"']\S{%d,}))""" % (NAMED_LEAST, NAMED_LEAST, NAMED_LEAST - 1))
_DIRECT = re.compile(_NAME.pattern + rb"""["']?\Z""")
_USER = re.compile(rb"://[^\s/:@]{0,40}:\Z")
_NAMED = re.compile(rb"(?i)(key|token|secret|passw|pwd|auth|credential|bearer)")
_SAMPLE_WORD = re.compile(rb"(?i)(example|sample|dummy|test|fake|placeholder|changeme|xxxx|your)")
#: Common parts of identifiers and prose, for dictionary coverage.
DICTIONARY = (
    "about access account address admin after album also application array author based before block build cache call "
    "check class client code common config content count create data database date default delete document domain download "
    "email entry error event example field file filter find first form from function group have header home host html http "
    "https image index info input item just language last level line link list local login mail main make more name network "
    "null number object only open option order other page param password path people phone port post private process product "
    "project public query read record request result return right root sample save search secret section select send server "
    "service session site size some source start state string system table target test text that there this time title token "
    "type update upload user value version video view with word world write year your"
).split()
_WORDS = re.compile("|".join(sorted(DICTIONARY, key=len, reverse=True)).encode())
FEATURES = ("length", "transitions", "digits", "upper", "lower", "other", "entropy", "longest_run", "hex", "coverage", "sample_word", "name_before", "assigned", "quoted", "words_before", "path_depth", "path_test", "named", "credential")


def candidates_of(text: bytes | None) -> list[tuple[int, int]]:
    """Byte ranges of the candidates of a whole text, in order; they can overlap.

    Every part of a run between ``=`` and ``:`` is one, and what stands before the ``@`` of ``user:value@host``. Values
    behind a name (``password = "..."``) are candidates whatever characters they have, also up to their first ``&``.
    """
    text, found = text or b"", set()
    for m in _CANDIDATE.finditer(text):
        for part in _PART.finditer(m.group()):
            a, b = m.start() + part.start(), m.start() + part.end()
            at = text.rfind(b"@", a, b) if text[a - 1 : a] == b":" and a > m.start() else -1
            for b in (b, at):
                while b > a and text[b - 1 : b] in (b".", b":", b"-"):
                    b -= 1
                if b - a >= LEAST and _DIGIT.search(text, a, b):
                    found.add((a, b))
    for m in _NAME.finditer(text):
        if v := _VALUE.match(text, m.end()):
            a, b = v.span(v.lastindex)
            if v.lastindex == 3:
                b = a + len(text[a:b].rstrip(b"\"',;"))
            cut = text.find(b"&", a, b)
            found |= {(a, e) for e in (b, cut) if e - a >= NAMED_LEAST}
    return sorted(found)


def features_of(text: bytes, a: int, b: int, path: str | None) -> list[float]:
    """Length, character transitions, dictionary coverage, neighbouring words and path of one candidate."""
    value = text[a:b]
    raw = np.frombuffer(value, np.uint8)
    digit, upper, lower = (raw >= 48) & (raw < 58), (raw >= 65) & (raw < 91), (raw >= 97) & (raw < 123)
    kind = digit + 2 * upper + 3 * lower
    n = len(raw)
    share = np.bincount(raw)
    share = share[share > 0] / n
    change = np.flatnonzero(np.diff(kind) != 0)
    before = text[max(0, a - 48) : a]
    words = before.split()
    last = before.rstrip(b" \"'")
    where = (path or "").lower()
    return [
        n, len(change) / max(1, n - 1), digit.sum() / n, upper.sum() / n, lower.sum() / n, (kind == 0).sum() / n, float(-(share * np.log2(share)).sum()),
        float(np.diff(np.concatenate(([-1], change, [n - 1]))).max()), float(re.fullmatch(rb"[0-9a-f]+|[0-9A-F]+", value) is not None),
        sum(len(m) for m in _WORDS.findall(value.lower())) / n, float(_SAMPLE_WORD.search(value) is not None), float(_NAMED.search(b" ".join(words[-3:])) is not None),
        float(last[-1:] in (b"=", b":")), float(before[-1:] in (b'"', b"'")), float(len(words)), float(where.count("/")), float("test" in where or "example" in where),
        float(_DIRECT.search(before) is not None), float(text[b : b + 1] == b"@" and _USER.search(before) is not None),
    ]


def findings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source") -> DataFrame:
    """(id, start, length, value, features) of every candidate of every whole text; ``start`` counts bytes from 0.

    Null and empty texts have none, null ids are carried, repeated rows give repeated findings, a null path is empty.
    """

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            out = [(i, a, b - a, t[a:b].decode(errors="replace"), features_of(t, a, b, p)) for i, t, p in zip(x["id"], x["text"], x["path"], strict=True) if t for a, b in candidates_of(t)]
            yield pd.DataFrame(out, columns=["id", "start", "length", "value", "features"]).astype({"id": "Int64"})

    path = F.col(path_col).cast("string") if path_col else F.lit(None).cast("string")
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"), path.alias("path"))
    return d.mapInPandas(find, "id long, start long, length long, value string, features array<double>")


def grow(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, depth: int = DEPTH, least: int = 3) -> list[tuple]:
    """One tree: nodes (feature, threshold, left, right, share of true) in the order they were made; leaves have feature -1.

    Each split looks at a random third of the features and takes the threshold with the least Gini impurity.
    """
    nodes: list[tuple] = []

    def node(rows: np.ndarray, d: int) -> int:
        me = len(nodes)
        share = float(y[rows].mean())
        nodes.append((-1, 0.0, -1, -1, share))
        if d == 0 or len(rows) < 2 * least or share in (0.0, 1.0):
            return me
        best = None
        for f in rng.choice(x.shape[1], max(1, x.shape[1] // 3), replace=False):
            order = rows[np.argsort(x[rows, f], kind="stable")]
            v, t = x[order, f], np.cumsum(y[order])
            n = np.arange(1, len(order))
            ok = (v[1:] > v[:-1]) & (n >= least) & (n <= len(order) - least)
            if not ok.any():
                continue
            left, right = t[:-1] / n, (t[-1] - t[:-1]) / (len(order) - n)
            gini = np.where(ok, n * left * (1 - left) + (len(order) - n) * right * (1 - right), np.inf)
            i = int(gini.argmin())
            if best is None or gini[i] < best[0]:
                best = (gini[i], int(f), float((v[i] + v[i + 1]) / 2))
        if best:
            _, f, cut = best
            low = x[rows, f] <= cut
            a = node(rows[low], d - 1)
            b = node(rows[~low], d - 1)
            nodes[me] = (f, cut, a, b, share)
        return me

    node(np.arange(len(y)), depth)
    return nodes


def vote(forest: list[list[tuple]], x: np.ndarray) -> np.ndarray:
    """Mean share of true over the trees."""
    total = np.zeros(len(x))
    for tree in forest:
        f, cut, a, b, share = (np.array(c) for c in zip(*tree, strict=True))
        at = np.zeros(len(x), np.int64)
        while (inner := f[at] >= 0).any():
            i = np.flatnonzero(inner)
            n = at[i]
            at[i] = np.where(x[i, f[n]] <= cut[n], a[n], b[n])
        total += share[at]
    return total / max(1, len(forest))


def learn(labelled: DataFrame, key: Column, trees: int = TREES, sample: int = SAMPLE) -> list[list[tuple]]:
    """Fits the forest on findings with ``features`` and ``label`` (boolean), about ``sample`` of them, one task a tree."""
    spark = labelled.sparkSession
    rows = bounded(labelled.where("label is not null"), key, sample).select("features", "label").toPandas()  # bounded
    if not len(rows) or rows["label"].nunique() < 2:
        return [[(-1, 0.0, -1, -1, float(rows["label"].mean()) if len(rows) else 0.0)]]
    rows = rows.assign(k=[tuple(v) for v in rows["features"]]).sort_values(["k", "label"])
    x, y = np.array(rows["k"].tolist()), rows["label"].to_numpy(np.float64)

    def plant(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k in b["id"]:
                rng = np.random.default_rng(1000 + k)
                some = rng.integers(0, len(y), len(y))
                yield pd.DataFrame({"id": [k], "tree": [pickle.dumps(grow(x[some], y[some], rng))]})

    got = spark.range(0, trees, 1, min(trees, 12)).mapInPandas(plant, "id long, tree binary").collect()
    return [pickle.loads(r["tree"]) for r in sorted(got, key=lambda r: r["id"])]


def judge(found: DataFrame, forest: list[list[tuple]]) -> DataFrame:
    """Adds ``score``, the forest's share of votes for a true secret, to findings."""

    @F.pandas_udf("double")
    def scored(features: pd.Series) -> pd.Series:
        return pd.Series(vote(forest, np.array(features.tolist())) if len(features) else [], dtype="float64")

    return found.withColumn("score", scored("features"))
