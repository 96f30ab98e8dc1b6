"""Releases by several writers, and brand statistics without a grid."""

import random

import pytest
from pyspark.sql import functions as F

from pricehist.operators import context, panel
from pricehist.sources import publish as pub


def rows(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "v long")


def active(spark, root):
    return {r["model_version"] for r in pub.registry(spark, root).filter("is_active").collect()}


def values(df):
    return sorted(r["v"] for r in df.collect())


def test_two_writers_at_once_lose_nothing(spark, tmp_path):
    root = str(tmp_path)
    pub.release(rows(spark, 1), "v1", root)
    # Both write their rows and read the same last number before either adds its line.
    a, b = pub.write_rows(rows(spark, 2, 3), root), pub.write_rows(rows(spark, 4), root)
    seen = pub.releases(spark, root).collect()
    for version, folder, writer in (("v2", a, "aa"), ("v3", b, "bb")):
        spark.createDataFrame([(version, folder, len(seen) + 1, writer)], pub.RELEASE).write.parquet(f"{root}/registry/{writer}")
    assert {r["model_version"] for r in pub.registry(spark, root).collect()} == {"v1", "v2", "v3"}
    assert active(spark, root) == {"v3"} and values(pub.released(spark, root)) == [4]
    assert values(pub.released(spark, root, "v2")) == [2, 3] and values(pub.released(spark, root, "v1")) == [1]


def test_a_writer_that_fails_before_the_flip_changes_nothing(spark, tmp_path):
    root = str(tmp_path)
    with pytest.raises(ValueError, match="no release"):
        pub.released(spark, root)
    pub.release(rows(spark, 1), "v1", root)
    pub.write_rows(rows(spark, 9), root)
    with pytest.raises(Exception, match="too bad"):
        pub.release(rows(spark, 5).select(F.raise_error(F.lit("too bad")).cast("long").alias("v")), "v2", root)
    assert active(spark, root) == {"v1"} and values(pub.released(spark, root)) == [1]


def test_releasing_a_version_again_leaves_readers_their_rows(spark, tmp_path):
    root = str(tmp_path)
    pub.release(rows(spark, 1, 2), "v1", root)
    reader = pub.released(spark, root)
    pub.release(rows(spark, 7), "v1", root)
    assert values(reader) == [1, 2] and values(pub.released(spark, root)) == [7] and active(spark, root) == {"v1"}
    pub.release(rows(spark, 8), "v2", root)
    pub.release(rows(spark, 6), "v1", root)
    assert active(spark, root) == {"v1"} and values(pub.released(spark, root, "v2")) == [8]


def test_brand_counts_are_the_grid_where_the_brand_is_listed(spark):
    draw = random.Random(6)
    listed = []
    for wine in range(60):
        brand, price = draw.choice(["a", "a", "a", "b", "c", None]), 10.0
        for t in range(14):
            price *= draw.choice([1, 1, 1.1, 0.9])
            # Brand c is on few lists, so that its last four lists are not its last four rows.
            if draw.random() < (0.15 if brand == "c" else 0.7):
                listed.append((wine, t, f"20{10 + t}-01-01", price, None, None, brand, "NV", None, None, None, "red", "premium"))
    names = "wine_id long, t int, date string, price double, promo_price double, promo_type string, brand string, vintage string, region string, grape string, classification string, style string, tier string"
    s = spark.createDataFrame(listed, names).withColumn("date", F.to_date("date"))
    order = lambda x: sorted((r["t"], r["brand"], *(round(r[c], 9) for c in (*context.COUNTS, "n_valid_4", "n_up_4", "n_down_4"))) for r in x.collect())
    sparse = order(context.brand_counts(panel.features(s)))
    grid = order(context.brand_stats(s.select("wine_id", "t", "date", "price", "brand"), s.select("t", "date").distinct()))
    assert sparse == [r for r in grid if r[2] > 0] and len(grid) == 3 * 14
    plan = context.brand_features(panel.features(s), context.brand_counts(panel.features(s)))._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "BroadcastNestedLoop" not in plan
