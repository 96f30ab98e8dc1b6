"""Which terms set a source apart from its language, and how far sources of a language are apart (operator 13).

Terms are counted inside each batch and partition, then by (lang, source, term). A language keeps the terms in at least 30 of its documents.
p = 1 + floor(10^9 * (count + 5) / (N + 5 * V)) for a group and for a language, in exact integers.

Part `term` needs the 50 largest p - q of a group (p the group's, q the language's; both on the same V). p grows with the group's count and
q with the language's, so a term is beaten by each that has no smaller count in the group, no larger count in the language and comes
earlier in UTF-8. Parts of a group's terms therefore keep their skyband (terms that fewer than 50 others beat), the skybands of a group are
merged by the same rule, and only what is left is ranked exactly.

Part `pair` sums |p - q| over all kept terms: parts of a language's terms, dealt by term, are laid out as a matrix of terms by sources and
each gives one partial sum for a pair, so that no pair is made for each term.

Defined results: null text, lang and source are ''; texts of any length are counted whole, in blocks; rows with null or repeated ids are documents of
their own (a repeated row counts again); an empty table gives no rows; a group without terms has p = 1 + floor(10^9 * 5 / (5 * V)) for every term,
and pairs of value 0 where V = 0; a language of one source has no pairs; other columns are ignored. A third of all rows in one group or
one term do not matter: counts are combined before each shuffle, and a group's terms are dealt to parts by term."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricehist.llm.common import hand_back, stored

#: On lower-cased UTF-8 bytes: all but 00-40, 5B-60 and 7B-7F.
TERM = re.compile(rb"[a-z\x80-\xff]+")
LEAST_DOCUMENTS, TOP = 30, 50
#: Different (lang, source, term) held in a task before they are handed on; characters of a text looked at in one go.
HELD, BLOCK = 200_000, 1 << 20
#: Terms of a group in a part of its skyband; cells of a matrix of terms by sources.
PART_TERMS, PART_CELLS = 20_000, 2_000_000


def term_counts(text: bytes) -> Counter:
    """Terms of a text; a long one is cut where a term ends, so that only different terms are held."""
    if len(text) <= BLOCK:
        return Counter(TERM.findall(text.lower()))
    return Counter(m.group() for m in TERM.finditer(text.lower()))


def counted(docs: DataFrame) -> DataFrame:
    """lang, source, term, count, documents: summed over all rows; docs: lang, source, text without nulls, text as binary."""
    names = ["lang", "source", "term", "count", "documents"]

    def flush(held: dict) -> pa.RecordBatch:
        keys, terms, n, d = [], [], [], []
        for key, (count, documents) in held.items():
            keys += [key] * len(count)
            terms += count.keys()
            n += count.values()
            d += [documents[t] for t in count]
        lang, source = zip(*keys, strict=True) if keys else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(source, pa.string()), pa.array(terms, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()),
            pa.array(d, pa.int64())], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple[Counter, Counter]] = {}
        size = 0
        for b in batches:
            for lang, source, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                count, documents = held.setdefault((lang, source), (Counter(), Counter()))
                size -= len(count)
                found = term_counts(text)
                count.update(found)
                documents.update(found.keys())
                size += len(count)
                if size > HELD:
                    yield flush(held)
                    held, size = {}, 0
        yield flush(held)
        hand_back()

    rows = docs.mapInArrow(run, "lang string, source string, term string, count long, documents long")
    return rows.groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("documents").alias("documents"))


def level(count: Column, total: Column, kept: Column) -> Column:
    """p; in decimals, as 10^9 times a count may not fit into 64 bits. total: N, kept: V."""
    wide = "decimal(19,0)"
    return F.lit(1) + F.call_function("div", (count + F.lit(5)).cast(wide) * F.lit(1_000_000_000).cast(wide), (total + 5 * kept).cast(wide))


def skyband(high: np.ndarray, low: np.ndarray, early: np.ndarray, k: int) -> np.ndarray:
    """Indices of points that fewer than k others beat: by no smaller `high`, no larger `low` and a smaller `early` (all different)."""
    order = np.lexsort((early, low, -high))
    # More than k points with equal counts: only the first k can stay.
    h, w = high[order], low[order]
    new = np.append(True, (h[1:] != h[:-1]) | (w[1:] != w[:-1]))
    order = order[np.arange(len(order)) - np.maximum.accumulate(np.where(new, np.arange(len(order)), 0)) < k]
    held_low, held_early, out = np.empty(len(order), low.dtype), np.empty(len(order), early.dtype), []
    for i in order:
        n = len(out)
        # Whoever is beaten k times is beaten by k points that stay.
        if np.count_nonzero((held_low[:n] <= low[i]) & (held_early[:n] < early[i])) < k:
            held_low[n], held_early[n] = low[i], early[i]
            out.append(i)
    return np.array(out, int)


def skybands(terms: DataFrame, part: Column, k: int) -> DataFrame:
    """The rows of terms (lang, source, term, count, all) in the skyband of their part of a group."""
    columns = ["lang", "source", "term", "count", "all"]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        early = np.argsort(np.argsort([t.encode() for t in rows["term"]]))
        return rows.iloc[skyband(rows["count"].to_numpy(), rows["all"].to_numpy(), early, k)][columns]

    parted = terms.select(*columns, part.alias("part"))
    return parted.groupBy("lang", "source", "part").applyInPandas(run, "lang string, source string, term string, count long, all long")


def parts(column: str, most: int, rows: DataFrame, *keys: str) -> int:
    """Into how many parts the largest group of rows has to be dealt by term."""
    n = rows.groupBy(*keys).agg(F.expr(column).alias("n")).agg(F.max("n")).first()[0] or 0
    return max(1, math.ceil(n / most))


def pair_sums(cells: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item, value for source < item; cells: lang, source, term, p of terms with a count; groups: lang, source, base (p of
    a term without one), v."""
    n = parts("count(DISTINCT source) * count(DISTINCT term)", PART_CELLS, cells, "lang")
    dealt = cells.withColumn("part", F.pmod(F.xxhash64("term"), F.lit(n)).cast("int"))
    used = dealt.select(F.col("lang").alias("of"), F.col("part").alias("of_part")).distinct()

    def run(rows: pd.DataFrame, sources: pd.DataFrame) -> pd.DataFrame:
        lang, names = sources["of"].iloc[0], np.array(sorted(sources["source"], key=str.encode), object)
        at = {s: i for i, s in enumerate(names)}
        base = sources.set_index("source")["base"].reindex(names).to_numpy(np.int64)
        term, terms = pd.factorize(rows["term"])
        matrix = np.tile(base[:, None], (1, len(terms)))
        matrix[rows["source"].map(at).to_numpy(int), term] = rows["p"].to_numpy(np.int64)
        out = []
        for i in range(len(names) - 1):
            out.append(pd.DataFrame({"lang": lang, "source": names[i], "item": names[i + 1 :], "value": np.abs(matrix[i + 1 :] - matrix[i]).sum(axis=1)}))
        return pd.concat(out) if out else pd.DataFrame({"lang": [], "source": [], "item": [], "value": []})

    sources = used.join(groups.select(F.col("lang").alias("of"), "source", "base"), "of")
    found = dealt.groupBy("lang", "part").cogroup(sources.groupBy("of", "of_part")).applyInPandas(run, "lang string, source string, item string, value long")
    return found.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def divergence(docs: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank."""
    empty = F.lit("")
    lang, source = (F.coalesce(F.col(c).cast("string"), empty).alias(c) for c in ("lang", "source"))
    rows = docs.select(lang, source, F.coalesce(F.col("text").cast("string"), empty).cast("binary").alias("text"))
    counts = stored(counted(rows), "term-counts")
    kept = stored(counts.groupBy("lang", "term").agg(F.sum("count").alias("all"), F.sum("documents").alias("documents")).filter(F.col("documents") >= least).drop("documents"), "kept-terms")
    # A kept term has at most as many rows as its language has sources.
    cells = stored(counts.select("lang", "source", "term", "count").join(kept, ["lang", "term"]), "cells")
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("all").alias("total"))
    totals = cells.groupBy("lang", "source").agg(F.sum("count").alias("n"))
    groups = rows.select("lang", "source").distinct().join(langs, "lang", "left").join(totals, ["lang", "source"], "left").fillna(0, ["v", "total", "n"])
    zero = F.when(F.col("v") > 0, level(F.lit(0).cast("long"), F.col("n"), F.col("v"))).cast("long")
    groups = stored(groups.withColumn("base", zero), "groups")
    sums = pair_sums(cells.join(groups.select("lang", "source", "n", "v"), ["lang", "source"]).select("lang", "source", "term", level(F.col("count"), F.col("n"), F.col("v")).alias("p")), groups)
    sums = stored(sums, "pair-sums")
    both = sums.unionByName(sums.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    every = groups.select("lang", "source").join(groups.select("lang", F.col("source").alias("item")), "lang").filter("source <> item")
    pairs = every.join(both, ["lang", "source", "item"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).cast("long").alias("value"))
    n = parts("count(1)", PART_TERMS, cells, "lang", "source")
    band = skybands(cells, F.pmod(F.xxhash64("term"), F.lit(n)), top)
    band = skybands(stored(band, "skybands"), F.lit(0), top) if n > 1 else band
    p, q = level(F.col("count"), F.col("n"), F.col("v")), level(F.col("all"), F.col("total"), F.col("v"))
    terms = band.join(groups, ["lang", "source"]).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (p - q).cast("long").alias("value")).filter("value > 0")
    ranked = pairs.unionByName(terms).withColumn("rank", F.expr("row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)"))
    return ranked.filter((F.col("part") == "pair") | (F.col("rank") <= top))
