"""Batches merged by bucket into a table of latest rows, against a rescan of all rows."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from pricehist.sources import keyed

COLUMNS = "k string, n long, note string"


def newest(batches):
    best = {}
    for number, batch in enumerate(batches):
        for k, n, note in batch:
            rank = (n is not None, n or 0, number, note is not None, note or "")
            if k not in best or rank > best[k][0]:
                best[k] = (rank, (k, n, note))
    return sorted((row for _, row in best.values()), key=str)


def read(spark, root):
    return sorted((tuple(r) for r in keyed.latest(spark, root).select("k", "n", "note").collect()), key=str)


def test_batches_are_a_rescan(spark, tmp_path):
    draw, root, batches = random.Random(3), str(tmp_path), []
    for number in range(3):
        batches.append([(draw.choice([None, "", *map(str, range(30))]), draw.choice([None, *range(9)]), draw.choice(["a", "b", None])) for _ in range(40)])
        keyed.merge(spark.createDataFrame(batches[-1], COLUMNS), number, root, "k", "n", buckets=8)
        assert read(spark, root) == newest(batches)


def test_only_touched_buckets_change_and_a_retry_changes_nothing(spark, tmp_path):
    root = str(tmp_path)
    first = spark.createDataFrame([(str(i), i, "old") for i in range(200)], COLUMNS)
    assert keyed.merge(first, 0, root, "k", "n", buckets=16) == list(range(16))
    before, reader = keyed._listed(spark, root)[1], keyed.latest(spark, root)
    batch = spark.createDataFrame([("7", 900, "new"), ("7", 1, "late")], COLUMNS)
    (touched,) = keyed.merge(batch, 1, root, "k", "n", buckets=16)
    after = keyed._listed(spark, root)[1]
    assert {b for b in after if after[b] != before[b]} == {touched}
    # Files of other buckets are not even read: the merge works without them.
    others = [p for b, f in after.items() if b != touched for p in Path(root, f).glob(f"_bucket={b}/*.parquet")]
    hidden = {p: p.with_suffix(f".{i}") for i, p in enumerate(others)}
    for p, q in hidden.items():
        p.rename(q)
    assert keyed.merge(spark.createDataFrame([("7", 901, "newer")], COLUMNS), 2, root, "k", "n", buckets=16) == [touched]
    for p, q in hidden.items():
        q.rename(p)
    state = keyed._listed(spark, root)
    for number in (0, 1, 2):
        assert keyed.merge(batch, number, root, "k", "n", buckets=16) == [] and keyed._listed(spark, root) == state
    assert keyed.merge(batch.limit(0), 3, root, "k", "n", buckets=16) == [] and keyed._listed(spark, root) == state
    assert read(spark, root) == sorted([(str(i), i, "old") for i in range(200) if i != 7] + [("7", 901, "newer")], key=str)
    assert reader.filter("k = '7'").first()["n"] == 7  # a reader from before keeps its rows
    assert len(keyed.vacuum(spark, root)) == 1 and keyed.vacuum(spark, root) == [] and len(read(spark, root)) == 200


def test_a_merge_that_fails_changes_nothing(spark, tmp_path):
    root = str(tmp_path)
    with pytest.raises(ValueError, match="no batch"):
        keyed.latest(spark, root)
    keyed.merge(spark.createDataFrame([("a", 1, None)], COLUMNS), 0, root, "k", "n")
    bad = spark.createDataFrame([("a", 2, "x")], COLUMNS)
    with pytest.raises(Exception, match="too bad"):
        keyed.merge(bad.withColumn("note", F.raise_error(F.lit("too bad")).cast("string")), 1, root, "k", "n")
    with pytest.raises(ValueError, match="own"):
        keyed.merge(bad.withColumnRenamed("note", "_Batch"), 1, root, "k", "n")
    assert read(spark, root) == [("a", 1, None)]
    keyed.merge(bad, 1, root, "k", "n")
    assert read(spark, root) == [("a", 2, "x")]
