"""Operators 11 to 13 against brute force, ids of 64 bits in all operators on documents, and the learning of operator 5."""

import hashlib
import random
import re
import sys
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, __file__.rsplit("/", 2)[0])
from compare import same

import corpus_pipeline
from pricehist.llm import bpe, dedup_exact, dedup_near, divergence, filter_audit, langid, packing, quality, queries, suffix_dedup, token_counts, toxicity

DOCS = "doc_id long, text string, lang string, source string, row string, `class` string, part string, p string, n string, anchor string, term string, count string"


def docs_of(spark, rows):
    """doc_id, text, lang, source and columns with clashing names."""
    return spark.createDataFrame([(*r, *["x"] * 8) for r in rows], DOCS)


# ---- 11: suffix sort ------------------------------------------------------------------------------------------------


def removed_by_force(texts, length):
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(c for c, x in zip(t, gone, strict=True) if not x)
        out.append((len(t), sum(gone), sum(x and not (i and gone[i - 1]) for i, x in enumerate(gone)), hashlib.sha256(kept).hexdigest(), kept))
    return sorted(out)


@pytest.mark.parametrize("length", [20, 21, 22])
def test_suffix_dedup(spark, length):
    draw = random.Random(length)
    base = "".join(draw.choice("abc") for _ in range(1500))
    texts = [None, "", "x" * 50, "ab" * 40, "y" * (length - 1), "z" * length, "ß" * 30]
    for _ in range(60):
        parts = [base[(a := draw.randrange(1400)) : a + draw.randrange(10, 60)] if draw.random() < 0.5 else "".join(draw.choice("abcdé ") for _ in range(draw.randrange(5, 40)))
            for _ in range(draw.randrange(1, 6))]
        texts.append("".join(parts))
    texts += texts[10:13]
    docs = docs_of(spark, [(None if i % 7 == 0 else i % 40, t, None, None) for i, t in enumerate(texts)]).repartition(3)
    got = suffix_dedup.remove_repeats(docs, length).select("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept").collect()
    assert sorted((*r[:4], bytes(r[4])) for r in got) == removed_by_force([(t or "").encode() for t in texts], length)


def test_suffix_dedup_of_tables(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    got = suffix_dedup.remove_repeats(docs).select("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept").collect()
    assert sorted((*r[:4], bytes(r[4])) for r in got) == removed_by_force([(r["text"] or "").encode() for r in docs.collect()], 200)
    assert suffix_dedup.remove_repeats(docs.limit(0)).count() == 0


def test_last_names_order_the_sample(spark):
    """Blocks and pieces: a long text gives the same result however it is cut into blocks."""
    draw = random.Random(3)
    text = "".join(draw.choice("ab") for _ in range(4000))
    before = suffix_dedup.BLOCK
    found = []
    for suffix_dedup.BLOCK in (256, 1 << 18):
        found.append(sorted(map(tuple, suffix_dedup.spans_of(spark.createDataFrame([(1, bytearray(text.encode()))], "row long, text binary"), 20, suffix_dedup.Scratch(spark)).select(
            F.expr("array_distinct(array_sort(flatten(transform(spans, s -> sequence(s.`from`, s.`to` - 1)))))")).collect())))
    suffix_dedup.BLOCK = before
    assert found[0] == found[1] and len(found[0]) == 1


def test_repeated_keys_are_spread(spark, monkeypatch):
    """A key that nine of ten rows have, keys of two rows and keys that are alone; the same rows with and without sampling."""
    rows = spark.range(20_000).select("id", F.when(F.col("id") % 10 > 0, 0).otherwise(F.col("id") % 15_000 + 1).alias("k"))
    for sample in (1_000, 1_000_000):
        monkeypatch.setattr(suffix_dedup, "SAMPLE", sample)
        found = suffix_dedup.repeated(rows, "k", 20_000).withColumn("part", F.spark_partition_id()).collect()
        assert {r["id"] for r in found} == {i for i in range(20_000) if i % 10 or i < 5_000 or i >= 15_000} and len(found) == len({r["id"] for r in found})
    monkeypatch.setattr(suffix_dedup, "SAMPLE", 1_000)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = Counter(r["part"] for r in suffix_dedup.repeated(rows, "k", 20_000).withColumn("part", F.spark_partition_id()).collect())
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) > 1 and max(sizes.values()) < 2 * sum(sizes.values()) / len(sizes)


def test_adjacent_equals_across_partitions(spark):
    """One key in all partitions, and keys that are alone."""
    rows = spark.range(1000).select(F.col("id").alias("at"), F.when(F.col("id") % 10 == 0, F.col("id")).otherwise(-1).alias("k"))
    got = {r["at"] for r in suffix_dedup.adjacent_equals(rows, ["k"], "at").collect()}
    assert got == {i for i in range(1000) if i % 10}


# ---- 12: filters ----------------------------------------------------------------------------------------------------


def audit_by_force(rows, good, toxic):
    first = {}
    for i, t, *_ in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    parts = defaultdict(list)
    for i, t, _, source in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t), "D": bool(re.search("[#$%&*|]", t)),
            "E": i is not None and first[t] < i}
        parts[source or ""].append((fails, i in good, i in toxic))
    out = []
    for part, docs in parts.items():
        lost = Counter()
        found = []
        for order in permutations("ABCDE"):
            left = docs
            for k, f in enumerate(order, 1):
                gone, kept = [d for d in left if d[0][f]], [d for d in left if not d[0][f]]
                lost[f] += len(gone)
                alone = sum(d[0][f] and sum(d[0].values()) == 1 for d in docs)
                found.append(("".join(order), k, len(kept), len(gone), sum(d[0][f] for d in docs) - len(gone), alone, sum(d[1] for d in gone), sum(d[2] for d in gone)))
                left = kept
        out += [(part, *r, lost[r[0][r[1] - 1]]) for r in found]
    return sorted(out)


def test_filter_audit(spark):
    draw = random.Random(9)
    words = ["alpha", "Beta", "g#", "délta", "e", "F", "ge h", "i\x1cj"]
    rows = [(1, None, None, None), (2, "", None, ""), (3, " \n\t", None, "s"), (None, "a b", None, "s"), (None, "a b", None, "s"), (4, "a b", None, "s"), (4, "a b", None, "s"), (5, "a b", None, "s")]
    for i in range(6, 60):
        rows.append((i, draw.choice([" ", "\n", "\x0b"]).join(draw.choice(words) for _ in range(draw.randrange(30, 90))), None, draw.choice(["s", "t", None])))
    rows += [(70 + k, rows[20 + k][1], None, "t") for k in range(5)]
    labels = spark.createDataFrame([(4, 1, 0), (4, 0, 1), (5, None, None), (None, 1, 1), *[(i, i % 2, i % 3 % 2) for i in range(6, 60)]], "doc_id long, quality int, toxic int")
    columns = ["part", "filter_order", "step", *filter_audit.COUNTS]
    got = filter_audit.audit(docs_of(spark, rows).repartition(3), labels).select(columns).collect()
    good = {4, *[i for i in range(6, 60) if i % 2]}
    assert sorted(map(tuple, got)) == audit_by_force(rows, good, {4, *[i for i in range(6, 60) if i % 3 % 2]})
    assert filter_audit.audit(docs_of(spark, []), labels).count() == 0


# ---- 13: divergence -------------------------------------------------------------------------------------------------


def test_skyband():
    draw = np.random.default_rng(1)
    for k in (1, 3, 10):
        high, low, early = draw.integers(0, 12, 300), draw.integers(0, 12, 300), draw.permutation(300)
        beaten = ((high[None] >= high[:, None]) & (low[None] <= low[:, None]) & (early[None] < early[:, None])).sum(1)
        assert sorted(divergence.skyband(high, low, early, k)) == list(np.flatnonzero(beaten < k))


def divergence_by_force(rows, least, top):
    count, documents, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, t, lang, source in rows:
        w = [x.decode() for x in re.findall(rb"[a-z\x80-\xff]+", (t or "").encode().lower())]
        groups.add((lang or "", source or ""))
        count[lang or "", source or ""].update(w)
        documents[lang or ""].update(set(w))
    out = []
    for lang, source in groups:
        kept = [t for t, n in documents[lang].items() if n >= least]
        whole = Counter()
        for g in groups:
            if g[0] == lang:
                whole.update(count[g])
        p = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c[x] for x in kept) + 5 * len(kept)) for t in kept}
        mine, q = p(count[lang, source]), p(whole)
        pairs = [(x, sum(abs(mine[t] - v) for t, v in p(count[lang, x]).items())) for g, x in groups if g == lang and x != source]
        terms = [(t, mine[t] - q[t]) for t in kept if count[lang, source][t] and mine[t] > q[t]]
        for part, found, most in (("pair", pairs, None), ("term", terms, top)):
            found.sort(key=lambda x: (-x[1], x[0].encode()))
            out += [(lang, source, part, x, v, r) for r, (x, v) in enumerate(found[:most], 1)]
    return sorted(out)


@pytest.mark.parametrize("part_terms", [20_000, 7])
def test_divergence(spark, monkeypatch, part_terms):
    monkeypatch.setattr(divergence, "PART_TERMS", part_terms)
    monkeypatch.setattr(divergence, "PART_CELLS", part_terms * 5)
    draw = random.Random(2)
    words = [f"{a}{b}" for a in "abcdeÉß日" for b in "xyzß"]
    rows = [(None, None, None, None), (1, "", "en", "empty"), (1, "123 [x] `", "en", "empty"), (2, "only here", "fr", "a")]
    for i in range(200):
        rows.append((i % 50, " ".join(draw.choices(words, [1 / (k + 1) for k in range(len(words))], k=draw.randrange(0, 25))), draw.choice(["en", "de", None]), draw.choice(["a", "b", "ß", None])))
    got = divergence.divergence(docs_of(spark, rows).repartition(3), 5, 4).select("lang", "source", "part", "item", "value", "rank").collect()
    assert sorted(map(tuple, got)) == divergence_by_force(rows, 5, 4)
    assert divergence.divergence(docs_of(spark, [])).count() == 0


def test_levels_beyond_64_bits(spark):
    n = 10**16
    got = spark.range(1).select(divergence.level(F.lit(n), F.lit(3 * n), F.lit(7))).first()[0]
    assert got == 1 + 10**9 * (n + 5) // (3 * n + 35)


def test_long_texts_are_counted_in_blocks(monkeypatch):
    monkeypatch.setattr(divergence, "BLOCK", 10)
    assert divergence.term_counts("Aé b aé-B c".encode()) == {"aé".encode(): 2, b"b": 2, b"c": 1}


@pytest.mark.parametrize("name", ["op12_filter_audit", "op13_divergence"])
def test_against_sql(spark, small, name):
    same(spark, small, queries.QUERIES[name], queries.SQL[name])


# ---- ids of 64 bits, rows of the pipeline ---------------------------------------------------------------------------

BIG = [2**60 + 1, None, 2**60 + 3]


def test_ids_of_64_bits(spark):
    docs = docs_of(spark, [(i, f"some words of text number {k} and more of them", "en", "s") for k, i in enumerate(BIG)]).coalesce(1)
    labels = spark.createDataFrame([(2**60 + 1, 1, 0), (2**60 + 3, 0, 1)], "doc_id long, quality int, toxic int")
    found = {
        1: packing.pack_documents(docs, queries.WORD_BPE), 2: toxicity.classify(docs, labels), 3: token_counts.count_edited(token_counts.with_edits(docs), queries.WORD_BPE),
        5: langid.identify(docs), 6: dedup_near.near_duplicates(docs, width=3, least=85), 7: bpe.round_trip(docs, queries.BYTE_BPE), 8: quality.classify(docs, labels),
        9: dedup_exact.dedup(docs), 11: suffix_dedup.remove_repeats(docs),
    }
    for k, rows in found.items():
        assert {r["doc_id"] for r in rows.select("doc_id").collect()} == set(BIG), k
    again = bpe.decode(bpe.encode(docs, queries.BYTE_BPE), queries.BYTE_BPE)
    assert {r["doc_id"] for r in again.collect()} == set(BIG)


def test_pipeline_keeps_rows_when_cores_change(spark, tmp_path):
    rows = [(None if i % 5 == 0 else i // 2, f"text number {i % 80} of all", "en", "s", f"mine-{i}") for i in range(160)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, `_ROW` string")
    frame.repartition(16).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    before = spark.conf.get("spark.sql.leafNodeDefaultParallelism", None)

    def dedup(x):
        spark.conf.set("spark.sql.leafNodeDefaultParallelism", "64")
        return dedup_exact.dedup(x)

    try:
        spark.conf.set("spark.sql.leafNodeDefaultParallelism", "1")
        kept = corpus_pipeline._kept(docs, dedup).collect()
    finally:
        if before is None:
            spark.conf.unset("spark.sql.leafNodeDefaultParallelism")
    assert len({r["text"] for r in kept}) == 80 and len(kept) == 80
    assert all(r["_ROW"].startswith("mine-") for r in kept)


# ---- 5: learning ----------------------------------------------------------------------------------------------------


def test_training_vectors_equal_the_chain():
    k, lengths, draw = 3, np.array([5, 1, 70, 7]), np.random.default_rng(0)
    n, evidence, move = lengths.sum(), draw.normal(size=(9, 3)), draw.normal(size=(3, 3))
    ids = draw.integers(0, 9, n)
    chain = langid.Chain(list("abc"), np.zeros((1, k)), {}, np.zeros((k, k)), move)
    found = [np.empty((n, k)) for _ in range(3)]
    pairs = chain.run(evidence, ids, lengths, lambda at, p: found[0].__setitem__(at, p), pairs=True)
    again = langid.Training(lengths, k).expect(evidence, ids, move, lambda at, p: found[1].__setitem__(at, p))
    before, langid.MANY = langid.MANY, 2
    chain.run(evidence, ids, lengths, lambda at, p: found[2].__setitem__(at, p))
    langid.MANY = before
    assert np.allclose(found[0], found[1]) and np.allclose(found[0], found[2]) and np.allclose(pairs, again)


def test_expected_counts_are_the_gradient():
    """Marginals and expected transitions against numeric differences of the log of the sum over all paths."""
    draw = np.random.default_rng(1)
    k, lengths = 3, np.array([4, 6])
    ids, evidence, move = np.arange(10), draw.normal(size=(10, k)), draw.normal(size=(k, k))

    def log_sum(evidence, move):
        total = 0.0
        for a, b in ((0, 4), (4, 10)):
            f = np.full(k, 1 / k)
            for t in range(a, b):
                f = (f @ np.exp(move)) * np.exp(evidence[t])
            total += np.log(f.sum())
        return total

    p = np.empty((10, k))
    both = langid.Training(lengths, k).expect(evidence, ids, move, lambda at, x: p.__setitem__(at, x))
    for grad, array in ((p, evidence), (both, move)):
        for i in np.ndindex(array.shape):
            old, values = array[i], []
            for d in (1e-5, -1e-5):
                array[i] = old + d
                values.append(log_sum(evidence, move))
            array[i] = old
            assert abs((values[0] - values[1]) / 2e-5 - grad[i]) < 1e-6


def test_every_language_is_learned(spark):
    langs = [f"l{k:03d}" for k in range(260)]
    docs = docs_of(spark, [(i, " ".join([f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + j)}" for j in range(5)]), langs[i % 260], None) for i in range(520)])
    assert set(langid.train(docs, rows=520).labels) == set(langs)


def test_words_come_from_all_over_a_text():
    words = [str(i) for i in range(10_000)]
    got = [int(w) for w in langid.spread_over(words, 320)]
    assert len(got) == 320 and got == sorted(got) and max(np.diff(got)) < 1000 and got[0] == 0 and got[-1] == 9999
