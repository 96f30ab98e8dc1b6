"""Toxicity: a counterfactual-regularised classifier (operator 2).

A logistic model on which words and beginnings of words a text has, fitted on a bounded sample of labelled rows. For every labelled text that names a
group, copies with the group swapped for another of the same kind are made, and the squared change of the score (before the
logistic function) is penalised, so that naming a group does not by itself raise a score. An absolute-value penalty leaves
weights on few words, so that long texts do not add up noise.

Defined results: null and empty texts get the score of a text without known words; very long texts are scored whole (memory: about
twenty times their bytes, one text at a time); repeated documents are scored once for each row; null and repeated ids (all 64 bits of them) are returned as they are; repeated label rows count once (two
labels of one id both count), null labels not at all; without usable labels every score is 0.5; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricehist.llm.common import bounded, crc, cut, hand_back, label_sample, texts

#: Labelled rows that the model is fitted on, at most; words that it may weigh.
SAMPLE_ROWS, MOST_WORDS = 12_000, 4_000
#: Identity terms by kind (fixed values): a term is swapped for others of its kind.
IDENTITY = {
    "gender": ["woman", "women", "man", "men", "girl", "girls", "boy", "boys", "female", "male", "transgender"],
    "orientation": ["gay", "lesbian", "bisexual", "straight", "queer", "heterosexual", "homosexual"],
    "religion": ["muslim", "muslims", "christian", "christians", "jew", "jews", "jewish", "hindu", "hindus", "buddhist", "buddhists", "atheist",
    "atheists", "catholic", "catholics"],
    "origin": ["black", "white", "asian", "asians", "african", "africans", "american", "americans", "european", "europeans", "arab", "arabs",
    "mexican", "mexicans", "immigrant", "immigrants", "refugee", "refugees"],
    "state": ["old", "young", "disabled", "blind", "deaf", "elderly"],
}
KIND = {t: kind for kind, terms in IDENTITY.items() for t in terms}
EDGES = ".,;:!?\"'()[]{}<>*#$%&|_-+=/\\~^@`´’“”„«»…"


def words(text: str) -> set[str]:
    """Distinct lower-cased words of the whole text, without marks at their ends, and their beginnings of four and five letters
    (marked by a hyphen), which stand for words that the sample does not have. An identity term has no beginnings, so that a swap of terms
    changes all that it tells."""
    plain = {w.strip(EDGES) for w in set(text.lower().split())} - {""}
    open_words = plain - KIND.keys()
    return plain | {f"{w[:4]}-" for w in open_words if len(w) > 4} | {f"{w[:5]}-" for w in open_words if len(w) > 5}


@dataclass
class WordModel:
    base: float = 0.0
    weight: dict[str, float] = field(default_factory=dict)

    def logit(self, text: str) -> float:
        w = self.weight
        return self.base + sum([w[t] for t in words(text) if t in w])

    def score(self, column: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip([self.logit(t) for t in column], -30, 30))) if column else np.zeros(0)


def distance(n: float, bad: float, rate: float) -> float:
    """How far a word's count among toxic rows is from its share, in standard deviations."""
    return abs(bad - n * rate) / np.sqrt(n * rate * (1 - rate))


def constant(y: np.ndarray) -> WordModel:
    rate = (y.sum() + 1) / (len(y) + 2)
    return WordModel(float(np.log(rate / (1 - rate))) if len(y) else 0.0)


def solve(names: list[str], found: list[np.ndarray], y: np.ndarray, pairing: float = 1.0, sparse: float = 3e-4, swaps: int = 3, steps: int = 400) -> WordModel:
    """Weights of names (all identity terms among them) for rows that have the words found (places in names).

    pairing: weight of the penalty on score changes under swaps; sparse: of the absolute weights."""
    at = {w: j for j, w in enumerate(names)}
    kind = np.array([w in KIND for w in names])
    rows, cols = np.repeat(np.arange(len(found)), [len(f) for f in found]), np.concatenate(found)
    # Swapped copies: a row of differences for each, +1 for the term that goes and -1 for the one that comes.
    gone, come = [], []
    for i, f in enumerate(found):
        own = f[kind[f]].tolist()
        for t in own:
            others = [at[o] for o in IDENTITY[KIND[names[t]]] if at[o] not in own]
            for k in range(min(swaps, len(others))):
                gone.append(t)
                come.append(others[(i + k * 7) % len(others)])
    gone, come = np.array(gone, np.int64), np.array(come, np.int64)
    n, m, rate = len(y), len(names), y.mean()
    weigh = np.where(y > 0, 0.5 / rate, 0.5 / (1 - rate))  # both labels count alike: 0.5 is where neither is likelier than it is overall
    w, b = np.zeros(m), 0.0
    mean, square = np.zeros(m + 1), np.zeros(m + 1)
    for k in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(b + np.bincount(rows, w[cols], n), -30, 30)))
        e = weigh * (p - y) / n
        g = np.append(np.bincount(cols, e[rows], m), e.sum())
        if len(gone):
            d = 2 * pairing * (w[gone] - w[come]) / len(gone)
            g[:m] += np.bincount(gone, d, m) - np.bincount(come, d, m)
        mean, square = 0.9 * mean + 0.1 * g, 0.99 * square + 0.01 * g * g
        scale = 0.1 / np.sqrt(1 + k / 50) / (np.sqrt(square / (1 - 0.99**k)) + 1e-6)
        step = scale * mean / (1 - 0.9**k)
        w, b = w - step[:m], b - step[m]
        w = np.sign(w) * np.maximum(np.abs(w) - scale[:m] * sparse, 0)
    return WordModel(float(b), {t: float(x) for t, x in zip(names, w, strict=True) if abs(x) > 1e-3})


def fit(column: list[str], y: np.ndarray, least: int = 3, **how: float) -> WordModel:
    """The model of a few texts at hand; train() does the same over tables."""
    if not len(y) or y.min() == y.max():
        return constant(y)
    sets = [words(t) for t in column]
    seen, bad = Counter(w for s in sets for w in s), Counter(w for s, v in zip(sets, y, strict=True) if v for w in s)
    far = {w: distance(n, bad[w], y.mean()) for w, n in seen.items() if n >= least}
    names = sorted({*sorted(far, key=lambda w: (-far[w], w))[:MOST_WORDS], *KIND})
    at = {w: j for j, w in enumerate(names)}
    return solve(names, [np.array(sorted(at[w] for w in s if w in at), np.int64) for s in sets], y, **how)


def train(docs: DataFrame, labels: DataFrame, keep: Column | None = None, rows: int = SAMPLE_ROWS, least: int = 3) -> WordModel:
    """The model of a bounded sample of the labelled documents for which keep (a condition on doc_id) holds. Words are counted and chosen by
    Spark; the driver gets the chosen words and, for each sampled row, the places of those it has."""
    sample = label_sample(labels, "toxic", keep, rows, 2)
    # More than the sample only where ids repeat in docs.
    texts_of = bounded(cut(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")), rows, 2, "doc_id", "y", "text")
    y = texts_of.agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("bad")).first()
    if not y["bad"] or y["bad"] == y["n"]:
        return constant(np.array([1.0 if y["bad"] else 0.0] * y["n"]))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            seen, bad = Counter(), Counter()
            for t, v in zip(texts(b["text"]), b["y"], strict=True):
                s = words(t)
                seen.update(s)
                if v:
                    bad.update(s)
            yield pd.DataFrame({"word": list(seen), "n": list(seen.values()), "bad": [bad[w] for w in seen]})
        hand_back()

    rate = y["bad"] / y["n"]
    far = F.abs(F.col("bad") - F.col("n") * rate) / F.sqrt(F.col("n") * rate * (1 - rate))
    counts = texts_of.mapInPandas(count, "word string, n long, bad long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    top = counts.filter(F.col("n") >= least).orderBy(far.desc(), "word").limit(MOST_WORDS).select("word").collect()
    names = sorted({*(r["word"] for r in top), *KIND})
    at = {w: j for j, w in enumerate(names)}

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "y": b["y"], "found": [sorted(at[w] for w in words(t) if w in at) for t in texts(b["text"])]})

    got = texts_of.mapInPandas(find, "doc_id long, y int, found array<int>").toPandas().sort_values(["doc_id", "y"], kind="stable")
    return solve(names, [np.asarray(f, np.int64) for f in got["found"]], got["y"].to_numpy(float))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    held = F.pmod(crc(F.col("doc_id")), F.lit(3)) == 1
    sent = docs.sparkSession.sparkContext.broadcast(train(docs, labels, ~held))

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for text in parts:
            yield pd.Series(sent.value.score(texts(text)), dtype=float)
        hand_back()

    scored = docs.select("doc_id", score("text").alias("score"))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
