"""The pipeline's stages, each held against a plain version over its own input."""

import sys
import zlib

import numpy as np
import pytest

sys.path.insert(0, __file__.rsplit("/", 2)[0])
sys.path.insert(0, __file__.rsplit("/", 1)[0])
import corpus_pipeline as cp
from test_llm import MESSY, check_packing, docs_of, near_by_force

from pricehist.llm import langid, quality


def rows_of(df):
    return {r["doc_id"]: r for r in df.collect()}


def good_by_force(rows, labels):
    """Ids that the plain additive model keeps: fitted on all labelled rows outside the held-out fifth, scored one by one."""
    known = [(i, labels[i]) for i in rows if labels.get(i) is not None and zlib.crc32(str(i).encode()) % 5 != 0]
    x, y = quality.features([rows[i]["text"] for i, _ in known]), np.array([v for _, v in known], float)
    order = np.lexsort(np.array([*x.T, y]))
    m = quality.fit(x[order], y[order])
    return {i for i, r in rows.items() if m.score(quality.features([r["text"]]))[0] >= 0.3}


def known_by_force(rows):
    """Ids whose language is known to the plain chain model, text by text."""
    known = sorted(i for i, r in rows.items() if r["lang"] is not None and zlib.crc32(str(i).encode()) % 3 != 1)
    words = []
    for i in known:
        t = rows[i]["text"]
        n, size, last = len(t), langid.PART, langid.PARTS - 1
        parts = [t] if n <= langid.PARTS * size else [t[i * (n - size) // last :][:size] for i in range(last + 1)]
        cut = [p.lower().split() for p in parts]
        words.append([w for i, c in enumerate(cut) for w in c[i > 0 : len(c) - (i < len(cut) - 1)]])
    m = langid.fit(words, [rows[i]["lang"] for i in known])
    found = {i: m.predict([r["text"]]) for i, r in rows.items()}
    return {i for i, ([lang], [score]) in found.items() if lang != "und" and score >= 0.35}


def test_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    for name, stage in cp.STAGES:
        before = rows_of(docs)
        out = stage(spark, docs, small)
        if name == "packing":
            check_packing(out.toPandas(), [(i, r["text"]) for i, r in before.items()])
            continue
        assert out.columns == docs.columns
        after = rows_of(out)
        assert all(before[i] == r for i, r in after.items()) and out.count() == len(after)
        if name == "exact_dedup":
            last = {}
            for i, r in before.items():
                k = r["text"].encode().lower()
                last[k] = max(i, last.get(k, i))
            assert set(after) == set(last.values())
        elif name == "near_dedup":
            assert set(after) == {c for _, _, c in near_by_force([(i, r["text"]) for i, r in before.items()], 5, 80)}
        else:
            assert set(after) == (good_by_force(before, labels) if name == "quality" else known_by_force(before))
            assert len(after) > 0.6 * len(before)
        docs = spark.createDataFrame(out.collect(), out.schema)


def test_dedup_stages_where_ids_repeat_or_are_null(spark, small):
    rows = [(1, "one text of five words or more"), (1, "quite another text that has five words"), (None, "a third text of five words"),
        (None, "A third text of five words"), (2, "One text of five words or more")]
    docs = docs_of(spark, rows).coalesce(1)
    for stage in (cp.drop_exact_copies, cp.drop_near_copies):
        out = stage(spark, docs, small)
        assert out.columns == docs.columns
        assert sorted(r["text"].lower() for r in out.collect()) == sorted({t.lower() for _, t in rows})


@pytest.mark.parametrize("texts", [MESSY, []])
def test_stages_on_messy_rows(spark, small, texts):
    for name, stage in cp.STAGES:
        out = stage(spark, docs_of(spark, texts), small)
        ids = [r["doc_id"] for r in out.collect()]
        if name in ("exact_dedup", "near_dedup"):
            assert len(ids) == len(set(ids)) and (6 in ids or name == "near_dedup" or not texts)
        assert set(ids) <= {i for i, _ in texts}
