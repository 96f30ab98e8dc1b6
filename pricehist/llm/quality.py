"""Quality classifier: a generalised additive model with pairwise interactions (operator 8).

Text statistics are cut into bins at quantiles of a bounded sample of labelled rows. Boosting goes over the features in turn,
round after round; each step fits a tree of three leaves on one feature's bins and adds it to that feature's lookup table. The
pairs with the most left to gain then get two-way tables from four-leaf trees in the same way. A score is a sum of table
entries.

Defined results: null and empty texts are scored as texts without words; very long texts are scored whole (memory: about ten times
their bytes, one text at a time); documents without a label are scored like others, and repeated documents once for each row; label
rows that repeat count once (two labels of one id both count), null labels not at all; without usable labels every score is 0.5; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import combinations
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricehist.llm.common import bounded, crc, cut, hand_back, label_sample, texts

#: Labelled rows that the model is fitted on, at most.
SAMPLE_ROWS = 20_000
BINS, PAIR_BINS = 32, 8
CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digit": b"0123456789",
    "space": b" \t",
    "line": b"\n",
    "stop": b".?",
    "comma": b",;:",
    "shout": b"!",
    "symbol": b"#$%&*+=@^_~",
    "table": b"|<>{}[]\\/",
}
NAMES = [*CLASSES, "high", "chars", "words", "word_length", "longest", "distinct", "repeats", "line_length", "line_copies", "packed", "sentence", "commonest"]
_SUMS = np.array([[b in c for c in CLASSES.values()] + [b >= 128] for b in range(256)], float)


def features(column: list[str]) -> np.ndarray:
    """One row of statistics for each text."""
    out = np.zeros((len(column), len(NAMES)))
    for i, text in enumerate(column):
        raw = text.encode("utf-8", "replace")
        words, n, sums = raw.split(), max(1, len(raw)), np.zeros(_SUMS.shape[1])
        for a in range(0, len(raw), 1 << 20):
            sums += np.bincount(np.frombuffer(raw, np.uint8, min(1 << 20, len(raw) - a), a), minlength=256) @ _SUMS
        w, kinds, lines = max(1, len(words)), Counter(words), raw.split(b"\n")
        out[i] = [
            *(sums / n), np.log1p(len(raw)), np.log1p(len(words)), (n - sums[2] - sums[3]) / w, max(map(len, kinds), default=0), len(kinds) / w,
            sum(map(eq, words, words[1:])) / w, np.log1p(n / len(lines)), 1 - len(set(lines)) / len(lines), len(zlib.compress(raw, 1)) / (n + 20),
            np.log1p(w / (1 + sums[4] + sums[6])),
            max(kinds.values(), default=0) / w,
        ]
    return out


def _split(g: np.ndarray, h: np.ndarray, smooth: float) -> tuple[float, int]:
    """Best gain of cutting ordered bins in two, and where."""
    a, b = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gain = a**2 / (b + smooth) + (g.sum() - a) ** 2 / (h.sum() - b + smooth) - g.sum() ** 2 / (h.sum() + smooth)
    return (float(gain.max()), int(gain.argmax()) + 1) if len(gain) else (0.0, 0)


def _leaves(g: np.ndarray, h: np.ndarray, smooth: float) -> np.ndarray:
    """Values by bin of a tree of up to three leaves."""
    cuts = [0, len(g)]
    for _ in range(2):
        best = max(((*_split(g[a:b], h[a:b], smooth), a) for a, b in zip(cuts, cuts[1:], strict=False) if b - a > 1), default=(0, 0, 0))
        if best[0] <= 1e-9:
            break
        cuts = sorted([*cuts, best[2] + best[1]])
    out = np.zeros(len(g))
    for a, b in zip(cuts, cuts[1:], strict=False):
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + smooth)
    return out


def _quarters(g: np.ndarray, h: np.ndarray, smooth: float) -> np.ndarray:
    """Values by cell of a tree that cuts one axis and then each side by the other."""
    best = None
    for turn in (False, True):
        a, b = (g.T, h.T) if turn else (g, h)
        _, row = _split(a.sum(1), b.sum(1), smooth)
        out, gain = np.zeros(a.shape), 0.0
        for part in (slice(0, row), slice(row, None)):
            x, y = a[part].sum(0), b[part].sum(0)
            _, col = _split(x, y, smooth)
            for cells in (slice(0, col), slice(col, None)):
                s, t = x[cells].sum(), y[cells].sum()
                out[part, cells] = s / (t + smooth)
                gain += s**2 / (t + smooth)
        if best is None or gain > best[0]:
            best = (gain, out.T if turn else out)
    return best[1]


@dataclass
class AdditiveModel:
    edges: list[np.ndarray]
    base: float = 0.0
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)
    coarse: list[np.ndarray] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], 1)

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.zeros(0)
        b = self.bins(x)
        z = np.full(len(x), self.base)
        for j, t in enumerate(self.tables):
            z += t[b[:, j]]
        for (i, j), t in self.pairs.items():
            z += t[self.coarse[i][b[:, i]], self.coarse[j][b[:, j]]]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 120, rate: float = 0.12, pairs: int = 10, smooth: float = 4.0) -> AdditiveModel:
    k = x.shape[1] if x.ndim == 2 else len(NAMES)
    if not len(y) or y.min() == y.max():
        rate_of = (y.sum() + 1) / (len(y) + 2)
        return AdditiveModel([np.zeros(0)] * k, float(np.log(rate_of / (1 - rate_of))) if len(y) else 0.0)
    model = AdditiveModel([np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(k)])
    b, sizes = model.bins(x), [len(e) + 1 for e in model.edges]
    model.base = float(np.log(y.mean() / (1 - y.mean())))
    model.tables = [np.zeros(s) for s in sizes]
    model.coarse = [np.arange(s) * PAIR_BINS // max(PAIR_BINS, s) for s in sizes]
    z = np.full(len(y), model.base)

    def residual() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-z))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for j in range(k):
            r, w = residual()
            step = rate * _leaves(np.bincount(b[:, j], r, sizes[j]), np.bincount(b[:, j], w, sizes[j]), smooth)
            model.tables[j] += step
            z += step[b[:, j]]
    c = np.stack([model.coarse[j][b[:, j]] for j in range(k)], 1)

    def cells(i: int, j: int, v: np.ndarray) -> np.ndarray:
        return np.bincount(c[:, i] * PAIR_BINS + c[:, j], v, PAIR_BINS**2).reshape(PAIR_BINS, PAIR_BINS)

    r, w = residual()
    gains = {(i, j): float((cells(i, j, r) ** 2 / (cells(i, j, w) + smooth)).sum()) for i, j in combinations(range(k), 2)}
    chosen = sorted(gains, key=lambda p: (-gains[p], p))[:pairs]
    model.pairs = {p: np.zeros((PAIR_BINS, PAIR_BINS)) for p in chosen}
    for _ in range(rounds // 3):
        for i, j in chosen:
            r, w = residual()
            step = rate * _quarters(cells(i, j, r), cells(i, j, w), smooth)
            model.pairs[i, j] += step
            z += step[c[:, i], c[:, j]]
    return model


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", keep: Column | None = None, rows: int = SAMPLE_ROWS) -> AdditiveModel:
    """The model of a bounded sample of the labelled documents for which keep (a condition on doc_id) holds."""
    sample = label_sample(labels, label, keep, rows, 8)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"y": b["y"].to_numpy(), "x": list(features(texts(b["text"])))})
        hand_back()

    found = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").mapInPandas(run, "y int, x array<double>")
    got = bounded(cut(found), rows, 8, "x", "y").toPandas()  # more than the sample only where ids repeat in docs
    order = np.lexsort(np.array([*zip(*got["x"], strict=True), got["y"]])) if len(got) else []
    got = got.iloc[order]  # in an order that does not depend on the tasks
    return fit(np.array(got["x"].tolist()).reshape(len(got), len(NAMES)), got["y"].to_numpy(float))


def scorer(spark: SparkSession, model: AdditiveModel) -> Callable[[str], Column]:
    """A function of a text column: its score (0 to 1; higher: better)."""
    sent = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for text in parts:
            yield pd.Series(sent.value.score(features(texts(text))))
        hand_back()

    return score


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    held = F.pmod(crc(F.col("doc_id")), F.lit(5)) == 0
    score = scorer(docs.sparkSession, train(docs, labels, keep=~held))
    scored = docs.select("doc_id", score("text").alias("score"))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of docs that score at least threshold, with all their columns."""
    held = F.pmod(crc(F.col("doc_id")), F.lit(5)) == 0
    return docs.filter(scorer(docs.sparkSession, train(docs, labels, keep=~held))("text") >= threshold)
