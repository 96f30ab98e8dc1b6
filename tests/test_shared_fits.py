"""One encoding for all models of the same rows, without flags that no tree can split on, and one pass for samples and newest listings."""

from pyspark.sql import functions as F

from pricehist.operators import models, panel


def _rows(spark):
    rows = [(k, 1 + k % 2, float(k % 7), None if k % 5 == 0 else float(k % 3), 0.01 * (k % 9 - 4)) for k in range(400)]
    return spark.createDataFrame(rows, "id int, h int, x double, gap double, y double")


def test_flags_of_numbers_without_nulls_are_left_out(spark):
    rows = _rows(spark)
    assert models.flagged(models.prepared(rows, ["x", "gap"], []), ["x", "gap"]) == ["gap"]
    encode, x = models.encoded(rows, ["x", "gap"], [])
    assert encode.stages[-1].getInputCols() == ["n_x", "n_gap", "z_gap"] and x.columns == ["features", "y", "h"]


def test_shared_encoding_gives_the_same_models(spark):
    rows = _rows(spark)
    made = models.encoded(rows, ["x", "gap"], [])
    for fit in (models.fit_range, models.fit_change):
        a, b = (fit(rows, None, ["x", "gap"], [], depth=2, rounds=2, made=m).transform(rows).orderBy("id").collect() for m in (None, made))
        assert a == b


def test_newest_listings_come_with_the_samples(spark):
    s = spark.createDataFrame([(1, 0, 10.0), (1, 1, 11.0), (1, 3, 12.0), (2, 1, 5.0)], "wine_id int, t int, price double")
    x = panel.horizons(panel.diffs(s), 2, 4, newest=True)
    assert {(r["wine_id"], r["t"]) for r in x.filter("h = 0").collect()} == {(1, 3), (2, 1)}
    plain = panel.horizons(panel.diffs(s), 2, 4)
    key = lambda d: sorted(tuple(r) for r in d.select("wine_id", "t", "h", "target_t", F.round("y", 9)).collect())
    assert key(x.filter("h > 0")) == key(plain)
