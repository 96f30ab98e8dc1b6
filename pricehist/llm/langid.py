"""Language ID of code-switched text by a linear-chain conditional random field (operator 5).

Every word gets a label. A word's evidence is a sum of learned weights of its features: character n-grams, those at its ends
(affixes) and whether it stands in the lexicon of a language; labels of neighbouring words are tied by learned transitions.
Forward-backward gives each word's label probabilities, and a document's language is the one with the largest mean
probability over its words.

The chain is run exactly and in bulk: texts are cut into blocks, the label-to-label products of all blocks are computed side
by side, the few values at block borders are passed along each text, and all blocks are then filled in side by side.

Memory: texts are predicted in slices of about 1 MB, and of one very long text only a group of blocks is filled in at a time; what
grows with it are its words and, for every 64 of them, a table of labels by labels (with more than MANY labels, two vectors of labels).

Defined results: a null text, and one without a letter, is `und` with score 0; very long texts are predicted whole; rows without a
language are predicted like others but never learned from; rows without a text are not learned from; without any labelled row
everything is `und`; equal probabilities go to the language first in order; repeated rows are predicted once for each row; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pricehist.llm.common import crc, hand_back, slices, texts

#: Labelled rows that the model is fitted on, at most; words of the training sequences, about. A text with more than PARTS * PART characters
#: is learned from PARTS stretches of it, at even distances from its begin to its end.
SAMPLE_ROWS, SAMPLE_WORDS, PARTS, PART = 2_500, 160_000, 16, 250
BUCKETS, BLOCK, LEXICON = 1 << 16, 64, 2_000
#: Blocks times labels whose scratch arrays are held at once.
GROUP = 8_192
#: With more labels than this, what happens at block borders is passed on from word to word, not by tables of labels by labels.
MANY = 32


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hash bucket and word number of every n-gram (1 to 4 bytes, with marks at both ends) of the words."""
    raw = np.frombuffer(("\x01" + "\x01".join(words) + "\x01").encode("utf-8", "replace"), np.uint8)
    marks = np.cumsum(raw == 1)
    h, buckets, owners = np.zeros(len(raw), np.uint64), [], []
    for n in range(1, 5):
        size = len(raw) - n + 1
        if size <= 0:
            break
        h = h[:size] * np.uint64(1_000_003) + raw[n - 1 :].astype(np.uint64)
        # No mark but at the n-gram's own ends; the last mark of all belongs to no word.
        inner = marks[max(n - 2, 0) : max(n - 2, 0) + size] - marks[:size]
        ok = (inner == 0) & (marks[:size] <= len(words))
        ok &= (raw[:size] != 1) | (n > 2) if n <= 2 else True
        at = np.flatnonzero(ok)
        buckets.append((((h[at] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.int64))
        owners.append(marks[at] - 1)
    return np.concatenate(buckets), np.concatenate(owners)


@dataclass
class Chain:
    labels: list[str]
    weights: np.ndarray  # bucket, label
    lexicon: dict[str, tuple[int, ...]] = field(default_factory=dict)  # word -> languages that list it
    listed: np.ndarray | None = None  # language that lists a word, label
    move: np.ndarray | None = None  # label, next label

    def evidence(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Evidence for each label, and whether there is a letter, of each word."""
        out, letters = np.zeros((len(words), len(self.labels))), np.array([any(map(str.isalpha, w)) for w in words], bool)
        a = size = 0
        for z, w in enumerate(words, 1):  # some words at a time, so that the arrays of n-grams stay small
            size += len(w) + 1
            if size > 250_000 or z == len(words):
                out[a:z] = self.weigh(*grams(words[a:z]), *self.entries(words[a:z]), z - a)
                a, size = z, 0
        out[~letters] = 0
        return out, letters

    def entries(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Word number and language of every lexicon entry of the words."""
        found = [(i, j) for i, w in enumerate(words) for j in self.lexicon.get(w, ())]
        return tuple(np.array(found, np.int64).reshape(-1, 2).T)

    def weigh(self, bucket: np.ndarray, owner: np.ndarray, word: np.ndarray, lang: np.ndarray, n: int) -> np.ndarray:
        out = np.stack([np.bincount(owner, self.weights[bucket, j], n) for j in range(len(self.labels))], 1)
        np.add.at(out, word, self.listed[lang])
        return out

    def marginals(self, evidence: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Label probabilities of every word. evidence: of the words of all texts, one text after the other."""
        out = np.empty_like(evidence)

        def visit(words: slice, p: np.ndarray) -> None:
            out[words] = p

        self.run(evidence, np.arange(len(evidence)), lengths, visit)
        return out

    def run(self, evidence: np.ndarray, ids: np.ndarray, lengths: np.ndarray, visit: Callable[[slice, np.ndarray], None], pairs: bool = False) -> np.ndarray:
        """Calls visit with label probabilities of one run of words after the other; with pairs, gives the expected number of each
        transition. evidence: of each different word; ids: the word at each place; lengths: words of each text."""
        k, step = len(self.labels), np.exp(self.move - self.move.max())
        force = np.exp(evidence - evidence.max(1, keepdims=True))
        blocks = -(-lengths // BLOCK)
        n, first = int(blocks.sum()), np.cumsum(blocks) - blocks
        text = np.repeat(np.arange(len(lengths)), blocks)
        size = np.minimum(BLOCK, lengths[text] - (np.arange(n) - first[text]) * BLOCK)
        begin = np.append(0, np.cumsum(size))
        many = max(32, GROUP // k)
        groups = [(lo, min(lo + many, n)) for lo in range(0, n, many)]

        def spread(lo: int, hi: int) -> tuple:
            """Evidence of the blocks lo to hi as an array of places, blocks and labels; which places have a word."""
            words = slice(int(begin[lo]), int(begin[hi]))
            row = np.repeat(np.arange(hi - lo), size[lo:hi])
            col = np.arange(words.stop - words.start) - np.repeat(begin[lo:hi] - begin[lo], size[lo:hi])
            psi, real = np.ones((BLOCK, hi - lo, k)), np.zeros((BLOCK, hi - lo), bool)
            psi[col, row] = force[ids[words]]
            real[col, row] = True
            return psi, real, col, row, words

        last, into, back = None, np.full((n, k), 1 / k), np.ones((n, k))
        if k > MANY:
            # Vectors from place to place, of all texts side by side: no tables of labels by labels.
            starts, a, b = np.cumsum(lengths) - lengths, np.full((len(lengths), k), 1 / k), np.ones((len(lengths), k))
            for t in range(int(lengths.max(initial=0))):
                live = np.flatnonzero(lengths > t)
                if t % BLOCK == 0:
                    into[first[live] + t // BLOCK] = a[live]
                f = (a[live] @ step) * force[ids[starts[live] + t]]
                a[live] = f / f.sum(1, keepdims=True)
            for t in range(int(lengths.max(initial=0)) - 1, -1, -1):
                live = np.flatnonzero(lengths > t)
                border = live[(t % BLOCK == BLOCK - 1) | (lengths[live] == t + 1)]
                back[first[border] + t // BLOCK] = b[border]
                g = (force[ids[starts[live] + t]] * b[live]) @ step.T
                b[live] = g / g.sum(1, keepdims=True)
        else:
            product = np.empty((n, k, k))
            for lo, hi in groups:
                last = psi, real, *_ = spread(lo, hi)
                x = np.broadcast_to(np.eye(k), (hi - lo, k, k)).copy()
                for t in range(BLOCK):
                    m = real[t]
                    p = (x[m] @ step) * psi[t, m][:, None, :]
                    x[m] = p / p.sum((1, 2), keepdims=True)
                product[lo:hi] = x
            for b in range(1, int(blocks.max(initial=0))):
                at = first[blocks > b] + b
                a = (into[at - 1][:, None, :] @ product[at - 1])[:, 0]
                into[at] = a / a.sum(1, keepdims=True)
                at = (first + blocks - 1)[blocks > b] - b
                a = (product[at + 1] @ back[at + 1][:, :, None])[:, :, 0]
                back[at] = a / a.sum(1, keepdims=True)
        both = np.zeros((k, k))
        for lo, hi in groups:
            psi, real, col, row, words = last if last is not None and len(groups) == 1 else spread(lo, hi)
            forward, a = np.empty((BLOCK, hi - lo, k)), into[lo:hi]
            for t in range(BLOCK):
                f = (a @ step) * psi[t]
                a = np.where(real[t][:, None], f / f.sum(1, keepdims=True), a)
                forward[t] = a
            out, b = np.empty((BLOCK, hi - lo, k)), back[lo:hi]
            for t in range(BLOCK - 1, -1, -1):
                f = forward[t] * b
                out[t] = f / f.sum(1, keepdims=True)
                use = psi[t] * b
                if pairs:
                    before = forward[t - 1] if t else into[lo:hi]
                    joint = before[:, :, None] * step * use[:, None, :]
                    joint /= joint.sum((1, 2), keepdims=True)
                    both += joint[real[t]].sum(0)
                g = use @ step.T
                b = np.where(real[t][:, None], g / g.sum(1, keepdims=True), b)
            visit(words, out[col, row])
        return both

    def predict(self, column: list[str]) -> tuple[list[str], list[float]]:
        found, score = ["und"] * len(column), [0.0] * len(column)
        number: dict[str, int] = {}
        ids, lengths = [], np.zeros(len(column), np.int64)
        for i, t in enumerate(column):
            one = [number.setdefault(w, len(number)) for w in t.lower().split()]
            lengths[i] = len(one)
            ids.append(np.array(one, np.int32))
        if not number or not self.labels:
            return found, score
        ids, (evidence, letters) = np.concatenate(ids), self.evidence(list(number))
        text, counted = np.repeat(np.arange(len(column)), lengths), letters[ids]
        n, sums = np.bincount(text, counted, len(column)), np.zeros((len(column), len(self.labels)))

        def visit(words: slice, p: np.ndarray) -> None:
            for j in range(len(self.labels)):
                sums[:, j] += np.bincount(text[words], p[:, j] * counted[words], len(column))

        self.run(evidence, ids, lengths, visit)
        for i in np.flatnonzero(n):
            j = int(sums[i].argmax())
            found[i], score[i] = self.labels[j], min(1.0, float(sums[i, j] / n[i]))
        return found, score


def sequences(parts: list[list[str]], langs: np.ndarray, seed: int = 5) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Words, labels and sequence lengths: half of the sequences follow one text, half switch between pieces of several."""
    rng = np.random.default_rng(seed)
    pieces: list[tuple[int, list[str]]] = []
    for words, y in zip(parts, langs, strict=True):
        a = 0
        while a < len(words):
            n = int(rng.integers(3, 30))
            pieces.append((int(y), words[a : a + n]))
            a += n
    mixed = [pieces[i] for i in rng.permutation(len(pieces))]
    out, labels, lengths = [], [], []
    for source in (pieces, mixed):
        run = 0
        for y, p in source:
            out += p
            labels += [y] * len(p)
            run += len(p)
            if run >= 200:
                lengths.append(run)
                run = 0
        if run:
            lengths.append(run)
    return out, np.array(labels, np.int64), np.array(lengths, np.int64)


def spread_over(words: list[str], most: int, run: int = 16) -> list[str]:
    """About `most` words of a longer text: runs of words at even distances from its begin to its end."""
    if len(words) <= most:
        return words
    n = max(1, most // run)
    begins = np.linspace(0, len(words) - run, n).astype(int) if n > 1 else np.array([(len(words) - run) // 2])
    return [w for a in begins.tolist() for w in words[a : a + run]]


class Training:
    """Forward and backward vectors over whole training sequences, some of about equal length side by side. No table of labels by labels is
    made for a place, so that the work for a place is a vector times the transitions."""

    def __init__(self, lengths: np.ndarray, labels: int) -> None:
        starts, order, self.groups = np.cumsum(lengths) - lengths, np.argsort(lengths, kind="stable"), []
        while len(order):
            # About 2 million numbers in an array of places, sequences and labels.
            longest = int(lengths[order[-1]])
            n = max(1, 2_000_000 // (longest * labels))
            part, order = order[-n:], order[:-n]
            place = np.arange(longest)[:, None]
            self.groups.append((np.where(place < lengths[part], starts[part] + place, 0), place < lengths[part]))

    def expect(self, evidence: np.ndarray, ids: np.ndarray, move: np.ndarray, visit: Callable[[np.ndarray, np.ndarray], None]) -> np.ndarray:
        """Calls visit with places and their label probabilities; gives the expected number of each transition."""
        k, step = len(move), np.exp(move - move.max())
        force, both = np.exp(evidence - evidence.max(1, keepdims=True)), np.zeros((len(move), len(move)))
        for at, real in self.groups:
            psi = force[ids[at]]
            forward = np.empty_like(psi)
            a = np.full((at.shape[1], k), 1 / k)
            for t in range(len(at)):
                f = (a @ step) * psi[t]
                a = np.where(real[t][:, None], f / f.sum(1, keepdims=True), a)
                forward[t] = a
            b = np.ones((at.shape[1], k))
            for t in range(len(at) - 1, -1, -1):
                m = real[t]
                use = psi[t] * b
                before = forward[t - 1] if t else np.full((at.shape[1], k), 1 / k)
                g = use @ step.T
                # before' step use is the chance of all that is seen, up to a factor of the place.
                both += (before[m] / (before[m] * g[m]).sum(1, keepdims=True)).T @ use[m]
                p = forward[t] * b
                forward[t] = p / p.sum(1, keepdims=True)
                b = np.where(m[:, None], g / g.sum(1, keepdims=True), b)
            visit(at[real], forward[real])
        return both * step


def fit(column: list[list[str]], langs: list[str], steps: int = 30, rate: float = 0.3, ridge: float = 1e-6, most: int = SAMPLE_WORDS) -> Chain:
    """The model of texts given as lists of lower-case words. most: words of all texts together, about, that it learns from; longer texts
    give runs of words from all over them."""
    labels = sorted(set(langs))
    k = len(labels)
    chain = Chain(labels, np.zeros((BUCKETS, k)), {}, np.zeros((k, k)), np.zeros((k, k)))
    if not any(column):
        return Chain([], np.zeros((BUCKETS, 0)))
    y = np.array([labels.index(v) for v in langs])
    order = np.random.default_rng(1).permutation(len(column))
    words, gold, lengths = sequences([spread_over(column[i], max(8, most // (2 * len(column)))) for i in order], y[order])
    number: dict[str, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    kinds = list(number)
    # The lexicon: each language's commonest words.
    for j in range(k):
        n = np.bincount(ids[gold == j], minlength=len(kinds))
        for u in np.lexsort((np.arange(len(kinds)), -n))[:LEXICON]:
            if n[u] > 1:
                chain.lexicon[kinds[u]] = (*chain.lexicon.get(kinds[u], ()), j)
    b, o = grams(kinds)
    word, lang = chain.entries(kinds)
    letters = np.array([any(map(str.isalpha, w)) for w in kinds], bool)
    used, b = np.unique(b, return_inverse=True)
    starts = np.cumsum(lengths) - lengths
    inside = np.ones(len(gold), bool)
    inside[starts] = False
    seen = np.bincount(gold[np.flatnonzero(inside) - 1] * k + gold[inside], minlength=k * k).reshape(k, k).astype(float)
    weights = np.zeros((len(used), k))  # of the n-grams that are there; the others stay 0
    n, state = len(gold), [(np.zeros_like(a), np.zeros_like(a)) for a in (weights, chain.listed, chain.move)]
    counted, training = letters[ids], Training(lengths, k)
    for s in range(1, steps + 1):
        evidence = np.stack([np.bincount(o, weights[b, j], len(kinds)) for j in range(k)], 1)
        np.add.at(evidence, word, chain.listed[lang])
        evidence[~letters] = 0
        by_word = np.zeros((len(kinds), k))
        np.add.at(by_word, (ids[counted], gold[counted]), 1.0)

        def visit(at: np.ndarray, p: np.ndarray, by_word: np.ndarray = by_word) -> None:
            m = counted[at]
            np.subtract.at(by_word, ids[at[m]], p[m])

        both = training.expect(evidence, ids, chain.move, visit)
        listed = np.zeros((k, k))
        np.add.at(listed, lang, by_word[word])
        grads = (
            np.stack([np.bincount(b, by_word[o, j], len(used)) for j in range(k)], 1) / n - ridge * weights,
            listed / n,
            (seen - both * (seen.sum() / both.sum())) / n,
        )
        for a, g, (mean, square) in zip((weights, chain.listed, chain.move), grads, state, strict=True):
            mean += 0.2 * (g - mean)
            square += 0.02 * (g * g - square)
            a += rate / np.sqrt(s) * (mean / (1 - 0.8**s)) / (np.sqrt(square / (1 - 0.98**s)) + 1e-8)
    chain.weights[used] = weights
    return chain


def shares(counts: dict[str, int], rows: int) -> dict[str, int]:
    """Rows to take of each language: all of rare ones, equally many of the others, `rows` together at most."""
    out, left = {}, rows
    for k, (lang, n) in enumerate(sorted(counts.items(), key=lambda x: (x[1], x[0]))):
        out[lang] = min(n, left // (len(counts) - k))
        left -= out[lang]
    return out


def train(docs: DataFrame, keep: Column | None = None, rows: int = SAMPLE_ROWS) -> Chain:
    """The model of a bounded sample of the documents with a language for which keep (a condition on doc_id) holds: the same number of
    rows of every language, but for rare ones, so that every language has a row unless there are more languages than rows; then the
    commonest have one."""
    known = docs.filter(F.col("lang").isNotNull())
    known = known.filter(keep) if keep is not None else known
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(rows).collect()}
    if not counts:
        return fit([], [])
    take = shares(counts, rows)
    # A share of the hash's range a language, a fifth above what is taken in the end. One row for each of at most `rows` languages.
    most = [(v, q, -(2**63) + int(2**64 * min(1.0, (1.2 * q + 40 * q**0.5) / counts[v])) - 1) for v, q in take.items()]
    wanted = docs.sparkSession.createDataFrame(most, "lang string, _take long, _most long")
    some = known.withColumn("lang", F.col("lang").cast("string")).withColumn("_rank", F.xxhash64(F.lit(5), "doc_id")).filter(F.col("text").isNotNull()).select("doc_id", "lang", "_rank", "text")
    some = some.join(F.broadcast(wanted), "lang").filter(F.col("_rank") <= F.col("_most"))
    n, last = F.length("text"), PARTS - 1
    apart = F.transform(F.sequence(F.lit(0), F.lit(last)), lambda i: F.substring(F.col("text"), (i * (n - PART) / last).cast("int") + 1, F.lit(PART)))
    some = some.select("doc_id", "lang", "_rank", "_take", F.when(n <= PARTS * PART, F.array("text")).otherwise(apart).alias("parts"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("_rank", "doc_id", "parts"))
    got = some.withColumn("_place", place).filter(F.col("_place") <= F.col("_take")).select("doc_id", "lang", "parts").toPandas()
    got["parts"] = [tuple(x) for x in got["parts"]]
    got = got.sort_values(["doc_id", "parts", "lang"], kind="stable")
    column = []
    for parts in got["parts"]:
        words = [t.lower().split() for t in parts]
        # The words at a cut may not be whole.
        column.append([w for i, x in enumerate(words) for w in x[i > 0 : len(x) - (i < len(words) - 1)]])
    return fit(column, got["lang"].tolist())


def predictor(spark: SparkSession, chain: Chain) -> Callable[[str], Column]:
    """A function of a text column: lang_pred and score."""
    sent = spark.sparkContext.broadcast(chain)
    size = max(1 << 14, (1 << 24) // max(16, len(chain.labels) ** 2))

    @F.pandas_udf("lang_pred string, score double")
    def predict(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for text in parts:
            column, lang, score = texts(text), [], []
            for lo, hi in slices(column, 256, size):
                x, y = sent.value.predict(column[lo:hi])
                lang += x
                score += y
            yield pd.DataFrame({"lang_pred": pd.Series(lang, dtype=object), "score": pd.Series(score, dtype=float)})
        hand_back()

    return predict


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    held = F.pmod(crc(F.col("doc_id")), F.lit(3)) == 1
    predict = predictor(docs.sparkSession, train(docs, ~held))
    return docs.select("doc_id", predict("text").alias("p")).select("doc_id", held.alias("held_out"), "p.lang_pred", "p.score")


def keep_known(docs: DataFrame, least: float = 0.35) -> DataFrame:
    """The rows of docs, with all their columns, whose language is known: not `und`, and a score of at least `least` (a text
    that switches between two languages is above it)."""
    held = F.pmod(crc(F.col("doc_id")), F.lit(3)) == 1
    p = predictor(docs.sparkSession, train(docs, ~held))("text")
    return docs.filter(F.when(p["lang_pred"] == "und", F.lit(-1.0)).otherwise(p["score"]) >= least)
