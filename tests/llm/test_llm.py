"""The training-data operators: brute force, round trips, held-out accuracy, and edge cases."""

import hashlib
import random
import sys
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

sys.path.insert(0, __file__.rsplit("/", 2)[0])
from compare import same

from pricehist.llm import bpe, dedup_exact, dedup_near, langid, packing, quality, queries, token_counts, topk, toxicity, url_filters
from pricehist.llm.common import bounded, label_sample

BYTE, WORD = queries.BYTE_BPE, queries.WORD_BPE
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, `key` string, n string, bucket string, piece string, lang_pred string, y string, task string"


def docs_of(spark, texts, lang="en"):
    """Documents with extra columns whose names clash with those that the operators use."""
    rows = [(i, t, lang, None, None, None, "k", "n", "b", "p", "l", "y", "t") for i, t in texts]
    return spark.createDataFrame(rows, DOCS)


LONG = " ".join(random.Random(4).choice(["alpha", "beta", "Gamma,", "délta", "x1"]) for _ in range(30_000))
MESSY = [(0, None), (1, ""), (2, " \n\t "), (3, LONG), (4, "Same text here and there"), (5, "same TEXT here and there"),
    (6, "Same text here and there"), (6, "Same text here and there"), (7, "123 456 !!"), (8, "a"), (9, "日本語 <|endoftext|> ’quote’ …")]


@pytest.fixture(scope="module")
def messy(spark):
    return docs_of(spark, MESSY).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return docs_of(spark, [])


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(3, 1, 0), (4, 1, 1), (5, 0, 0), (7, None, None), (77, 1, 1)], "doc_id long, quality int, toxic int")


# ---- 1: packing -----------------------------------------------------------------------------------------------------


def check_packing(rows, texts, capacity=2048):
    t = Tokenizer.from_file(WORD)
    want = []
    for doc, text in texts:
        raw = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4").tobytes()
        want += [(doc, k, a // 4, len(raw[a : a + 4 * capacity]) // 4, zlib.crc32(raw[a : a + 4 * capacity])) for k, a in enumerate(range(0, len(raw), 4 * capacity))]
    assert sorted(map(tuple, rows[["doc_id", "piece", "start", "length", "ids_crc32"]].to_numpy().tolist())) == sorted(want)
    for _, g in rows.sort_values("offset").groupby("sequence_id"):
        assert list(g["offset"]) == [0, *np.cumsum(g["length"])[:-1]] and g["length"].sum() <= capacity


def test_packing(spark, messy, small):
    check_packing(packing.pack_documents(messy, WORD).toPandas(), MESSY)
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = packing.pack_documents(docs, WORD).toPandas()
    check_packing(rows, [(r["doc_id"], r["text"]) for r in docs.collect()])
    assert rows["sequence_id"].nunique() <= -(-rows["length"].sum() // 2048) + 1  # within one of the least there can be


def test_packing_takes_the_least_sum_of_squares():
    sequence, offset = packing.place(np.array([6, 4, 4, 3, 3]), 10)
    # A gap that is filled leaves the sum, so 4 goes to 6; the second 4 opens; 3 goes to it, and the last 3 as well.
    assert list(sequence) == [0, 0, 1, 1, 1] and list(offset) == [0, 6, 0, 4, 7]


def place_by_force(lengths, capacity):
    """The rule itself: of all open sequences and a new one where none has room, the one that leaves the least sum of squares; ties go to the smallest gap."""
    gaps, out = [], []
    for s in lengths:
        options = []
        for i in {g: i for i, g in enumerate(gaps) if g >= s}.values():
            after = [*gaps[:i], gaps[i] - s, *gaps[i + 1 :]]
            options.append((sum(after.count(g) ** 2 for g in set(after) - {0}), gaps[i], i))
        if options:
            i = min(options)[2]
            gaps[i] -= s
        else:
            i = len(gaps)
            gaps.append(capacity - s)
        out.append(gaps.copy())
    return [sorted(g) for g in out]


def test_packing_rule_on_random_lists():
    r = random.Random(6)
    for _ in range(60):
        capacity = r.choice([10, 30])
        lengths = sorted((r.randint(1, capacity - 1) for _ in range(25)), reverse=True)
        sequence, offset = packing.place(np.array(lengths), capacity)
        gaps = {}
        for s, at, o, want in zip(lengths, sequence, offset, place_by_force(lengths, capacity), strict=True):
            assert o == capacity - gaps.get(at, capacity)
            gaps[at] = gaps.get(at, capacity) - s
            assert sorted(gaps.values()) == want


def test_word_encoder_against_the_library():
    t, coder, r = Tokenizer.from_file(WORD), packing.WordEncoder(WORD), random.Random(8)
    bits = ["the", "Réa", "ÉCOLE", "straße", "İx", "ΑΣ", "'ll", "it's", "!!", "...", "12", "a1b2", "日本。", " ", " ", "\n", "\t ", "\x1c", "\x85",
        "\u2028", "e\u0301", "<|endoftext|>", "½", ".,", "x" * 80]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(0, 30))) for _ in range(3000)]
    got = [x for _, part in packing.column_slices(pa.array([None, *texts]), 700, 4000) for x in coder.encode(part)]
    want = [np.array(t.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in ["", *texts]]
    assert got == want
    assert [coder.count_one(x) for x in texts] == [len(x) // 4 for x in want[1:]] == coder.count(pa.array(texts)).tolist()


def test_packing_of_nothing(empty):
    assert packing.pack_documents(empty, WORD).count() == 0


# ---- 2: toxicity ----------------------------------------------------------------------------------------------------


def test_toxicity_held_out(spark):
    d = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    got = toxicity.classify(spark.read.parquet(f"{d}/documents.parquet").join(labels.select("doc_id"), "doc_id", "left_semi"), labels).join(labels,
        "doc_id").filter("held_out").toPandas()
    # Some labels are noise: junk texts marked as toxic.
    assert got[got.toxic == 1].predicted.mean() > 0.75 and got[got.toxic == 0].predicted.mean() < 0.01


def test_counterfactual_pairs_lower_identity_weights():
    r = random.Random(1)
    text = lambda group, bad: " ".join(r.choice(["we", "saw", "the", "house", "tree"]) for _ in range(8)) + f" {group}" + (" vermin" if bad else "")
    column = [text("muslims", k % 10 < 8) for k in range(200)] + [text("christians", k % 10 < 1) for k in range(200)]
    y = np.array([k % 10 < 8 for k in range(200)] + [k % 10 < 1 for k in range(200)], float)
    gap = lambda m: abs(m.logit("the muslims saw the tree") - m.logit("the christians saw the tree"))
    free, tied = toxicity.fit(column, y, pairing=0.0), toxicity.fit(column, y, pairing=5.0)
    assert gap(tied) < 0.3 * gap(free) or gap(tied) < 0.05
    assert tied.score(["we saw vermin"])[0] > 0.9 and tied.score(["the muslims saw the tree"])[0] < 0.5


def test_toxicity_weights_against_a_plain_full_gradient_fit():
    r = random.Random(3)
    column = [" ".join(r.choice(["good", "bad", "tree", "house", "muslim", "woman"]) for _ in range(4)) for _ in range(120)]
    y = np.array([float("bad" in t) for t in column])
    m = toxicity.fit(column, y, pairing=1.0, sparse=0.0, steps=3000)
    names = sorted({w for t in column for w in toxicity.words(t)} | set(toxicity.KIND))
    sets, rate = [toxicity.words(t) for t in column], y.mean()

    def loss(weight):
        """The penalised loss, written out row by row."""
        total = 0.0
        for s, v in zip(sets, y, strict=True):
            z = weight["_"] + sum(weight.get(w, 0.0) for w in s)
            total += (0.5 / rate if v else 0.5 / (1 - rate)) * (np.log1p(np.exp(z)) - v * z) / len(y)
        gaps = []
        for i, s in enumerate(sets):
            own = [t for t in names if t in s and t in toxicity.KIND]
            for t in own:
                others = [o for o in toxicity.IDENTITY[toxicity.KIND[t]] if o not in own]
                gaps += [(weight.get(t, 0.0) - weight.get(others[(i + k * 7) % len(others)], 0.0)) ** 2 for k in range(min(3, len(others)))]
        return total + sum(gaps) / max(1, len(gaps))

    weight = {"_": m.base, **m.weight}
    here = loss(weight)
    for w in ["_", "good", "tree", "muslim", "woman"]:
        for d in (-0.3, 0.3):
            assert loss({**weight, w: weight.get(w, 0.0) + d}) > here - 2e-3
    for t in column[:20]:
        z = m.base + sum(m.weight.get(w, 0.0) for w in toxicity.words(t))
        assert abs(m.score([t])[0] - 1 / (1 + np.exp(-z))) < 1e-12


def test_toxicity_edges(messy, empty, labels):
    got = toxicity.classify(messy, labels).toPandas()
    assert len(got) == len(MESSY) and got.score.between(0, 1).all() and set(got.predicted) <= {0, 1}
    assert toxicity.classify(empty, labels).count() == 0
    assert set(toxicity.classify(messy, labels.limit(0)).toPandas().score) == {0.5}


# ---- 3: token counts ------------------------------------------------------------------------------------------------


def test_count_tree_against_whole_encoding():
    t, coder, r = Tokenizer.from_file(WORD), packing.word_encoder(WORD), random.Random(3)
    bits = ["the ", "réa", " ", "\n", "Ab'll ", "\x1c", "日本", "語。", "!! ", "1 2", "a1", "x.y", "'", "s", "e\u0301", "İ", "Σ", "<|endof", "text|>"]
    for _ in range(400):
        text = "".join(r.choice(bits) for _ in range(r.randint(0, 120)))
        parts = token_counts.blocks_of(text, r.choice([3, 20]))
        tree = token_counts.CountTree(parts, [coder.count_one(p) for p in parts], coder.count_one)
        for _ in range(5):
            a, n, new = r.randint(0, len(text) + 3), r.randint(0,
                12), "".join(r.choice(["the", " ", "\n", "ing ", "!", ",", "\x1f", "\x1d", "7", "本", "'"]) for _ in range(r.choice([0, 1, 3, 60])))
            tree.edit(a, n, new)
            a = min(a, len(text))
            text = text[:a] + new + text[a + n :]
            assert tree.text() == text and tree.total == len(t.encode(text, add_special_tokens=False).ids)


def test_edit_beside_a_separator_that_is_no_white_space():
    coder, text = packing.word_encoder(WORD), "w" * 398 + "!, \x1f tail"
    parts = token_counts.blocks_of(text)
    tree = token_counts.CountTree(parts, [coder.count_one(p) for p in parts], coder.count_one)
    tree.edit(len(parts[0]), 1, "")
    assert tree.total == coder.count_one(tree.text())


def test_blocks_of_texts_without_spaces():
    for text in ("これは文です。" * 2000, "line\n" * 5000, "a1" * 5000):
        parts = token_counts.blocks_of(text)
        assert len(parts) > 20 and "".join(parts) == text
    assert token_counts.blocks_of("x" * 5000) == ["x" * 5000]


def test_kept_trees_take_a_later_batch_of_edits(spark, messy):
    docs = token_counts.with_edits(messy)
    once = token_counts.apply_edits(token_counts.count_trees(docs, WORD), WORD, keep_trees=True)
    more = once.select("doc_id", "blocks", "counts", F.expr("array(named_struct('start', 1, 'length', 2, 'insert', 'new word'))").alias("edits"))
    got = token_counts.apply_edits(more, WORD, keep_trees=True).toPandas()
    t = Tokenizer.from_file(WORD)
    assert len(got) == len(MESSY)
    assert list(got["tokens_after"]) == [len(t.encode("".join(b), add_special_tokens=False).ids) for b in got["blocks"]]
    assert sorted(got["tokens_before"]) == sorted(once.toPandas()["tokens_after"])


def test_token_counts(spark, messy, empty, small):
    t = Tokenizer.from_file(WORD)
    docs = token_counts.with_edits(spark.read.parquet(f"{small}/documents.parquet").unionByName(messy.select("doc_id", "text", "lang", "source", "n_chars"))).collect()
    got = sorted(map(tuple, token_counts.count_edited(spark.createDataFrame(docs,
        "doc_id long, text string, edits array<struct<start: int, length: int, insert: string>>"), WORD).select("doc_id", "tokens_before",
        "tokens_after").collect()))
    want = []
    for r in docs:
        text = before = r["text"] or ""
        for e in r["edits"]:
            text = text[: e["start"]] + e["insert"] + text[e["start"] + e["length"] :]
        want.append((r["doc_id"], *[len(t.encode(x, add_special_tokens=False).ids) for x in (before, text)]))
    assert got == sorted(want)
    none = messy.withColumn("edits", F.lit(None).cast(f"array<{token_counts.EDIT}>"))
    assert token_counts.count_edited(none, WORD).filter("tokens_before <> tokens_after").count() == 0
    assert token_counts.count_edited(token_counts.with_edits(empty), WORD).count() == 0


# ---- 4: URL filters -------------------------------------------------------------------------------------------------


def test_url_filters_sql(spark, small):
    same(spark, small, queries.QUERIES["op4_url_filters"], queries.SQL["op4_url_filters"])


def test_url_filters_edges(spark, monkeypatch):
    captures = spark.createDataFrame(
        [(1, "http://User@a.B.org:80/x", 5, "z"), (2, "https://b.org/", 9, "z"), (3, None, 5, "z"), (4, "nonsense", 5, "z"),
        (5, "http://ab.org/", 5, "z"), (6, "http://b.org", None, "z"), (7, "http://b.org", 10, "z"), (7, "http://b.org", 10, "z"),
        (8, "http://c.b.org?q", 20, "z")],
        "page_id long, url string, day int, domain string",
    )
    lines = spark.createDataFrame([("b.org", 5, "add"), ("b.org", 10, "remove"), ("b.org", 5, "add"), ("a.b.org", 2, "add"), ("c.b.org", 20, "add"),
        ("c.b.org", 20, "remove"), ("b.org", 15, "add")], "domain string, day int, action string")
    want = {(1, True, "a.b.org"), (2, True, "b.org"), (3, False, None), (4, False, None), (5, False, None), (6, False, None), (7, False, None), (8, True, "b.org")}
    for rows in (url_filters.BROADCAST_ROWS, 1):
        monkeypatch.setattr(url_filters, "BROADCAST_ROWS", rows)  # the other join beyond the bound
        assert {(r["page_id"], r["listed"], r["domain"]) for r in url_filters.evaluate(captures, lines).collect()} == want
    assert url_filters.evaluate(captures.limit(0), lines).count() == 0
    twice = spark.createDataFrame([(1, "http://a.org/", 5), (1, "http://z.org/", 50), (1, "http://a.org/", 5)], "page_id long, url string, day int")
    listed = spark.createDataFrame([("a.org", 0, "add")], "domain string, day int, action string")
    assert sorted(map(tuple, url_filters.evaluate(twice, listed).select("host", "day", "listed", "domain").collect())) == [("a.org", 5, True, "a.org"), ("z.org", 50, False, None)]
    assert url_filters.evaluate(captures, lines.limit(0)).filter("listed").count() == 0


def test_hosts_of_urls(spark):
    want = {"http://evil.org./x": "evil.org", "http://a@b@evil.org/": "evil.org", "//evil.org/x": "evil.org", "http://u:p@EVIL.org.:80?q": "evil.org", "http://evil.org": "evil.org",
        "http://a.org/@evil.org": "a.org", "http://a.org?u=@evil.org": "a.org", "http://user@/x": "", "http://...": "", "evil.org/x": "", "http://[::1]:80/": "[::1]", "": ""}
    rows = spark.createDataFrame(list(want.items()), "url string, host string")
    assert [(r["url"], r["got"]) for r in rows.select("url", "host", url_filters.host_of(F.col("url")).alias("got")).collect()] == list(want.items())


def test_hot_host_is_spread(spark):
    """A host and day that nine of ten captures have: no task gets twice its share, and captures without a day are kept."""
    captures = spark.range(8_000).select(F.col("id").alias("page_id"), F.when(F.col("id") % 10 > 0, "http://hot.org/").otherwise(F.concat(F.lit("http://h"), "id", F.lit(".org/"))).alias("url"),
        F.when(F.col("id") % 10 > 0, 5).when(F.col("id") % 20 == 0, 7).cast("int").alias("day"))
    lines = spark.createDataFrame([("org", 3, "add")], "domain string, day int, action string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = url_filters.evaluate(captures, lines).withColumn("part", F.spark_partition_id()).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(got) == 8_000 and all(r["listed"] == (r["day"] is not None) for r in got)
    hot = Counter(r["part"] for r in got if r["host"] == "hot.org")
    assert len(hot) > 1 and max(hot.values()) < 2 * 7_200 / len(hot)


# ---- 5: language ID -------------------------------------------------------------------------------------------------


def test_forward_backward_against_brute_force():
    rng = np.random.default_rng(0)
    m = langid.Chain(["a", "b", "c"], np.zeros((langid.BUCKETS, 3)), {}, np.zeros((3, 3)), rng.normal(size=(3, 3)))
    lengths = np.array([1, 70, 0, 130])
    e = rng.normal(size=(lengths.sum(), 3))
    got, at, step = m.marginals(e, lengths), 0, np.exp(m.move - m.move.max())
    for n in lengths:
        a, forward = np.full(3, 1 / 3), []
        for t in range(n):
            a = (a @ step) * np.exp(e[at + t])
            a /= a.sum()
            forward.append(a)
        b = np.ones(3)
        for t in range(n - 1, -1, -1):
            p = forward[t] * b
            assert np.allclose(p / p.sum(), got[at + t])
            b = step @ (np.exp(e[at + t]) * b)
            b /= b.sum()
        at += n


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.97


def test_language_labels_words_of_mixed_text():
    en, de = ["the house and the tree of the garden".split()] * 40, ["der hund und die katze im garten mit dem ball".split()] * 40
    m = langid.fit(en + de, ["en"] * 40 + ["de"] * 40)
    words = "the house and der hund und die katze the tree of the".split()
    e, _ = m.evidence(words)
    p = m.marginals(e, np.array([len(words)]))
    assert [m.labels[j] for j in p.argmax(1)] == ["en"] * 3 + ["de"] * 5 + ["en"] * 4


def test_language_of_a_long_text_does_not_depend_on_its_slices(monkeypatch):
    r = random.Random(9)
    m = langid.fit([["the", "house", "and"], ["der", "hund", "und"]] * 40, ["en", "de"] * 40)
    texts = [" ".join(r.choice(["the", "house", "hund", "und"]) for _ in range(n)) for n in (5000, 3, 0, 700)]
    whole = m.predict(texts)
    monkeypatch.setattr(langid, "GROUP", 1)
    assert m.predict(texts)[0] == whole[0] and np.allclose(m.predict(texts)[1], whole[1])
    assert [m.predict([t])[0][0] for t in texts] == whole[0]


def test_language_learned_from_long_texts_alone_and_from_rare_languages(spark):
    en, de = "the house and the tree of the garden ", "der hund und die katze im garten mit dem ball "
    rows = [(i, (en if i % 2 else de) * 400, "en" if i % 2 else "de") for i in range(40)]
    got = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).toPandas()
    assert (got.lang_pred == np.where(got.doc_id % 2, "en", "de")).all()
    many = [(i, en, "en") for i in range(400)] + [(i, de, "de") for i in range(400, 408)]
    chain = langid.train(spark.createDataFrame(many, "doc_id long, text string, lang string"), rows=20)
    assert chain.labels == ["de", "en"] and chain.predict([de, en])[0] == ["de", "en"]
    assert langid.shares({"a": 3, "b": 1000, "c": 10**11}, 100) == {"a": 3, "b": 48, "c": 49}


@pytest.mark.parametrize("n", [10**11, 10**15])
def test_samples_of_huge_tables_are_not_empty(spark, n):
    # A table that is said to have n rows: the rows at hand are what its smallest hashes would look like.
    df = spark.range(20_000).select(F.col("id").alias("doc_id"))
    share = 20_000 / n
    low = df.filter(F.xxhash64(F.lit(3), "doc_id") <= F.lit(-(2**63) + int(2**64 * 0.5)))
    assert bounded(df, 100, 3, "doc_id", known=20_000).count() == 100
    assert bounded(low, 100, 3, "doc_id", known=n).count() <= 100 and share > 0
    most = -(2**63) + int(2**64 * min(1.0, 1.2 * 2500 / n + 40 * 2500**0.5 / n)) - 1
    assert (most + 2**63) / 2**64 * n > 2500


def test_a_repeated_label_does_not_fill_the_sample(spark):
    labels = spark.range(100_000).selectExpr("1L AS doc_id", "1 AS quality").unionByName(spark.range(50).selectExpr("id + 2 AS doc_id", "int(id % 2) AS quality"))
    got = label_sample(labels, "quality", None, 30, 8).collect()
    assert len(got) == 30 and len({(r["doc_id"], r["y"]) for r in got}) == 30


def test_language_edges(messy, empty):
    got = langid.identify(messy).toPandas().set_index("doc_id")
    assert len(got) == len(MESSY) and set(got.loc[[0, 1, 2, 7], "lang_pred"]) == {"und"} and got.score.between(0, 1).all()
    assert langid.identify(empty).count() == 0
    unknown = langid.identify(messy.withColumn("lang", F.lit(None).cast("string"))).toPandas()
    assert set(unknown.lang_pred) == {"und"}


# ---- 6: near-dedup --------------------------------------------------------------------------------------------------


def near_by_force(texts, width, least):
    sets = {}
    for i, t in texts:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            c = len(sets[a] & sets[b])
            if a < b and c and 100 * c >= least * (len(sets[a]) + len(sets[b]) - c):
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    return {(i, len(sets[i]), top(i)) for i in sets}


def copies(seed=5, n=160):
    r = random.Random(seed)
    base = [[r.choice("abcdefghijklmnopqrstuvwxyz") + str(r.randrange(300)) for _ in range(120)] for _ in range(4)]
    out = []
    for i in range(n):
        w = list(base[i % 4]) if i % 5 else list(base[0])
        for _ in range(r.choice([0, 1, 2, 3, 5, 8])):
            w[r.randrange(len(w))] = f"new{r.randrange(10**6)}"
        out.append((i, " ".join(w)))
    return out


@pytest.mark.parametrize(("width", "least", "cap"), [(3, 85, 4000), (3, 85, 2), (5, 80, 4000), (5, 80, 2)])
def test_near_copies(spark, width, least, cap):
    texts = copies()
    got = dedup_near.near_duplicates(docs_of(spark, texts).repartition(3), width, least, family_classes=cap)
    assert {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()} == near_by_force(texts, width, least)
    assert got.filter("kept <> (doc_id = component_id)").count() == 0


def test_links_of_an_id_with_two_texts_and_of_rows_without_id(spark):
    r = random.Random(2)
    a, b = ([f"{x}{r.randrange(10**6)}" for _ in range(60)] for x in "ab")
    rows = [(1, " ".join(a)), (1, " ".join(b)), (7, " ".join([*a, "end"])), (8, " ".join([*b, "end"])), (None, " ".join(a)), (None, "only here it is"), (9, "quite another text")]
    got = sorted(map(tuple, dedup_near.near_duplicates(docs_of(spark, rows), 3, 85).select("doc_id", "component_id", "kept").collect()), key=str)
    assert got == sorted([(1, 1, True), (1, 1, True), (7, 1, False), (8, 1, False), (None, 1, False), (None, None, True), (9, 9, True)], key=str)


def test_signatures_do_not_depend_on_their_parts():
    sets = [np.unique(np.random.default_rng(i).integers(0, 2**63, n).astype(np.uint64)) for i, n in enumerate((900, 0, 5, 300))]
    assert (dedup_near.signatures(sets, 150) == dedup_near.signatures(sets, 150, part=64)).all()


def test_superminhash_estimates_similarity():
    rng = np.random.default_rng(1)
    a = np.unique(rng.integers(0, 2**63, 400).astype(np.uint64))
    b = np.unique(np.concatenate([a[:300], rng.integers(0, 2**63, 100).astype(np.uint64)]))
    s = dedup_near.signatures([a, b, a[:1], a[:0]], 200)
    assert abs((s[0] == s[1]).mean() - 300 / 500) < 0.1
    assert (s[:3] >> np.uint64(32)).max() < 200 and (s[3] == np.iinfo(np.uint64).max).all()


def test_near_edges(messy, empty):
    got = {(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in dedup_near.near_duplicates(messy, 3, 85).collect()}
    assert {(0, 0, 0, True), (1, 0, 1, True), (2, 0, 2, True), (4, 3, 4, True), (5, 3, 4, False), (6, 3, 4, False), (8, 1, 8, True)} <= got
    assert dedup_near.near_duplicates(empty, 3, 85).count() == 0


# ---- 7: BPE ---------------------------------------------------------------------------------------------------------


def test_bpe_against_the_library():
    t, mine, r = Tokenizer.from_file(BYTE), bpe.PrefixBpe(BYTE), random.Random(7)
    letters = "aab  \n\t'sré’1 23\x1c\x85\xa0  日本語😀!?.thereIN\r\x00"
    texts = ["".join(r.choice(["<|endoftext|>", "the ", " ", "aaaa", "'ll",
        "  \n"]) if r.random() < 0.3 else r.choice(letters) for _ in range(r.randint(0, 40))) for _ in range(3000)]
    for text in [*texts, LONG[:20_000], "x" * 5000, "".join(r.choice("abcdefgh") for _ in range(5000))]:
        ids = t.encode(text, add_special_tokens=False).ids
        assert mine.encode(text) == ids
        assert mine.decode(ids) == t.decode(ids, skip_special_tokens=False)


def test_bpe_over_tables(spark, messy, empty, small):
    t = Tokenizer.from_file(BYTE)
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").unionByName(messy.select("doc_id", "text"))
    want = []
    for r in docs.collect():
        ids = t.encode(r["text"] or "", add_special_tokens=False).ids
        want.append((r["doc_id"], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
            hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(map(tuple, bpe.round_trip(docs, BYTE).collect())) == sorted(want)
    back = bpe.decode(bpe.encode(messy.filter("text IS NOT NULL"), BYTE), BYTE)
    assert sorted(map(tuple, back.collect())) == sorted((i, x) for i, x in MESSY if x is not None)
    assert bpe.round_trip(empty, BYTE).count() == 0


# ---- 8: quality -----------------------------------------------------------------------------------------------------


def test_quality_held_out(spark):
    d = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    got = quality.classify(spark.read.parquet(f"{d}/documents.parquet").join(labels.select("doc_id"), "doc_id", "left_semi"), labels).join(labels,
        "doc_id").filter("held_out").toPandas()
    assert got[got.quality == 1].predicted.mean() > 0.97 and got[got.quality == 0].predicted.mean() < 0.25


def test_quality_learns_an_interaction():
    rng = np.random.default_rng(2)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    m = quality.fit(x, y)
    assert ((m.score(x) > 0.5) == y).mean() > 0.9 and (0, 1) in m.pairs


def test_quality_scores_by_naive_walk_over_bins():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(500, 4))
    y = (x[:, 0] + x[:, 1] * x[:, 2] > 0).astype(float)
    m = quality.fit(x, y, rounds=9, pairs=3)
    for row, got in zip(x[:60], m.score(x[:60]), strict=True):
        b = [sum(1 for e in edges if e <= v) for edges, v in zip(m.edges, row, strict=True)]
        z = m.base + sum(t[k] for t, k in zip(m.tables, b, strict=True))
        z += sum(t[m.coarse[i][b[i]]][m.coarse[j][b[j]]] for (i, j), t in m.pairs.items())
        assert abs(got - 1 / (1 + np.exp(-z))) < 1e-12


def test_quality_step_is_the_best_of_all_cuts():
    rng = np.random.default_rng(5)
    for n in (2, 3, 7):
        g, h = rng.normal(size=n), rng.random(n) + 0.1
        gain = lambda a, b: g[a:b].sum() ** 2 / (h[a:b].sum() + 4.0)
        best, at = quality._split(g, h, 4.0)
        force = {c: gain(0, c) + gain(c, n) - gain(0, n) for c in range(1, n)}
        assert abs(best - max(force.values())) < 1e-12 and force[at] == pytest.approx(best)
        leaves = quality._leaves(g, h, 4.0)
        cuts = [0, *(np.flatnonzero(np.diff(leaves)) + 1), n]
        assert len(cuts) <= 4
        assert all(np.allclose(leaves[a:b], g[a:b].sum() / (h[a:b].sum() + 4.0)) for a, b in zip(cuts, cuts[1:], strict=False))


def test_commonest_word_is_counted_whatever_its_length():
    at = quality.NAMES.index("commonest")
    assert quality.features(["a bb ccc extraordinary extraordinary extraordinary"])[0, at] == 3 / 6


def test_quality_edges(messy, empty, labels):
    got = quality.classify(messy, labels).toPandas()
    assert len(got) == len(MESSY) and got.score.between(0, 1).all()
    assert quality.classify(empty, labels).count() == 0
    assert set(quality.classify(messy, labels.limit(0)).toPandas().score) == {0.5}
    assert quality.keep_good(messy, labels).columns == messy.columns


# ---- 9: exact dedup -------------------------------------------------------------------------------------------------


def test_exact_sql(spark, small):
    same(spark, small, queries.QUERIES["op9_exact_dedup"], queries.SQL["op9_exact_dedup"])


@pytest.mark.parametrize(("capacity", "size"), [(2, 1 << 20), (50_000, 1 << 26), (50_000, 40)])
def test_exact_edges(messy, empty, capacity, size):
    got = {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in dedup_exact.dedup(messy, capacity, size).collect()}
    assert {(0, 1, 2, False), (1, 1, 2, True), (2, 2, 1, True), (4, 6, 4, False), (5, 6, 4, False), (6, 6, 4, True), (8, 8, 1, True)} <= got
    assert dedup_exact.dedup(messy, capacity).count() == len(MESSY)
    assert dedup_exact.dedup(empty, capacity).count() == 0


def test_exact_rows_without_id(spark):
    big = 2**60 + 1  # not a whole number as a double
    docs = docs_of(spark, [(None, "a"), (3, "A"), (big, "a"), (None, "b"), (None, "B")]).coalesce(1)
    got = sorted(map(tuple, dedup_exact.dedup(docs).select("doc_id", "keep_id", "kept").collect()), key=str)
    assert got == sorted([(None, big, False), (3, big, False), (big, big, True), (None, None, True), (None, None, True)], key=str)


def test_colliding_keys_are_told_apart(messy, monkeypatch):
    monkeypatch.setattr(dedup_exact, "key_of", lambda text: -7)  # one chain for all texts
    want = {(4, 6, 4), (5, 6, 4), (6, 6, 4), (0, 1, 2), (1, 1, 2), (8, 8, 1)}
    assert want <= {(r["doc_id"], r["keep_id"], r["group_size"]) for r in dedup_exact.dedup(messy, 1).collect()}


@pytest.mark.parametrize(("capacity", "size"), [(100, 1 << 40), (10_000, 2_000), (10_000, 1 << 40)])
def test_directory_splits_until_buckets_fit(spark, capacity, size):
    keys = spark.range(5000).select(F.xxhash64("id").alias("key"), F.expr("if(id % 100 = 0, 1500L, 10L)").alias("bytes")).cache()
    rows = keys.toPandas()
    k = np.sort(rows["key"].to_numpy(np.int64).view(np.uint64)).view(np.int64)
    d = dedup_exact.directory(keys, capacity, size)
    at = d.bucket(k)
    assert (np.diff(at) >= 0).all() and at.min() >= 0  # buckets are ranges of keys
    sizes = rows.groupby(d.bucket(rows["key"].to_numpy()))["bytes"].agg(["sum", "count"])
    assert sizes["count"].max() <= capacity and (sizes["sum"].max() <= size or size == 2_000 and sizes[sizes["sum"] > size]["count"].max() == 1)
    assert (len(sizes) == 1) == (capacity == 10_000 and size == 1 << 40)


# ---- 10: top k ------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("spread", [0.0, 1.0])
def test_top_k(spark, spread):
    rng = np.random.default_rng(3)
    v = (rng.normal(size=(1500, 6)) * np.exp(spread * rng.normal(size=(1500, 1)))).round(1)
    v[::7] = v[3]  # many ties
    df = spark.createDataFrame(pd.DataFrame({"vec_id": range(1500), "embedding": v.tolist()}), "vec_id long, embedding array<double>")
    got = topk.top_k(df, bucket_rows=150, block_rows=30).toPandas()
    x = np.floor(64 * v)
    for q in range(0, 1500, 20):
        s = x @ x[q]
        want = [j for j in np.lexsort((np.arange(1500), -s)) if j != q][:20]
        g = got[got.query_id == q].sort_values("rank")
        assert list(g.vec_id) == want and list(g.score) == list(s[want].astype(int)) and list(g["rank"]) == list(range(1, 21))


def test_top_k_edges(spark, small):
    same(spark, small, queries.QUERIES["op10_top_k"], queries.SQL["op10_top_k"])
    rows = [(0, [1.0, 0.0], 9), (0, [1.0, 0.0], 9), (1, None, 9), (2, [None, 1.0], 9), (3, [float("nan"), 1.0], 9), (4, [float("inf"), 1.0], 9),
        (5, [0.5, 0.5], 9), (6, [0.5, 0.5], 9), (6, [0.5, 0.5], 9), (20, [1.0, 2.0, 3.0], 9)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score long")
    assert sorted(tuple(r) for r in topk.top_k(df).collect()) == [(0, 1, 5, 2048), (0, 2, 6, 2048), (0, 3, 6, 2048)]
    assert topk.top_k(df.limit(0)).count() == 0
