"""Trees that are grown over binned rows: what Spark's models make of them, leaf tables, and how they compare with Spark's learners."""

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from pricehist.functions.shared import cut
from pricehist.operators import forest, metrics, models, trees

NUMBERS, CATEGORIES = ["x", "gap"], ["kind"]


@pytest.fixture(scope="module")
def rows(spark):
    """y follows x, kind and the missing gap; every y is another one, but for a third of zeros."""
    x = spark.range(0, 3000, 1, 3).select("id", (F.col("id") % 4 + 1).cast("int").alias("h"), F.round(F.rand(1), 3).alias("x"), F.when(F.col("id") % 5 > 0, F.rand(2)).alias("gap"),
        F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("c")), (F.col("id") % 3 + 1).cast("int")).alias("kind"))
    y = F.when(F.col("id") % 3 == 0, 0.0).otherwise(F.when(F.col("kind") == "b", 0.2).otherwise(-0.1) + F.col("x") * 0.3 + F.when(F.col("gap").isNull(), 0.1).otherwise(0.0) + F.randn(3) / 50)
    return cut(x.withColumn("y", y))


@pytest.fixture(scope="module")
def made(rows):
    return models.encoded(rows, NUMBERS, CATEGORIES)


def test_boosted_trees_score_as_spark_scores_them(rows, made):
    m = [trees.Model("absolute", models.every, 3, rounds=4), trees.Model("logistic", models._rises("up"), 3, rounds=4), trees.Model("squared", models.every, 2, rounds=3, features=[0, 1])]
    blocks = made.blocks
    trees.grow(blocks, m)
    x = made[0].transform(models.prepared(rows, NUMBERS, CATEGORIES))
    for one, column in zip(m, ("prediction", "rawPrediction", "prediction"), strict=True):
        own = blocks.over(lambda parts, one=one: ({"y": b.y, "v": one.score(b)} for b in parts), "y double, v double").filter("y <> 0").collect()
        p = vector_to_array(column)[1] if column == "rawPrediction" else F.col(column)
        got = {r["y"]: r["p"] for r in trees.spark_model(blocks, one).transform(x).filter("y <> 0").select("y", p.alias("p")).collect()}
        assert len(own) == len(got) == 2000 and max(abs(r["v"] - got[r["y"]]) for r in own) < 1e-9


def test_leaf_tables_are_those_of_all_rows_in_sparks_leaves(rows, made):
    """Leaves have Spark's numbers, and percentiles are exact though no row is shuffled for each tree."""
    blocks, how = made.blocks, forest.Forests(trees=3, depth=5)
    m = trees.grow(blocks, [how.mean(blocks, models.every)])[0]
    found = {(t, leaf): (n, list(v)) for t, leaf, n, v in trees.leaf_percentiles(blocks, [m], 9)[0]}
    x = trees.spark_model(blocks, m).setLeafCol("leaf").transform(made[0].transform(models.prepared(rows, NUMBERS, CATEGORIES)))
    want = {(r["tree"], r["leaf"]): (r["n"], list(r["values"])) for r in forest.leaf_table(x.select(vector_to_array("leaf").alias("leaf"), "y"), 9).collect()}
    assert found == want and len({t for t, _ in found}) == 3 and len(found) > 30


def test_percentiles_are_exact_where_a_stretch_has_many_values(rows, made, monkeypatch):
    monkeypatch.setattr(trees, "STRETCHES", 4)
    blocks = made.blocks
    m = trees.grow(blocks, [forest.Forests(trees=2, depth=2).mean(blocks, lambda b: (np.flatnonzero(b.y != 0), b.y))])[0]
    few = trees.leaf_percentiles(blocks, [m], 5)
    monkeypatch.setattr(trees, "STRETCHES", 1024)
    assert sorted(few[0]) == sorted(trees.leaf_percentiles(blocks, [m], 5)[0]) and sum(n for t, _, n, _ in few[0] if t == 0) == 2000


def test_thresholds_come_from_all_rows(spark):
    """One row in 30,000 has another value: a sample of 10,000 rows may miss it."""
    x = spark.range(0, 30_000, 1, 2).select(F.array(F.when(F.col("id") == 17, 5.0).otherwise(1.0)).alias("features"), F.lit(1.0).alias("y"))
    blocks = trees.pack(x, ["n_x"], {}, 64)
    assert list(blocks.cuts[0]) == [3.0] and list(blocks.sizes) == [2]
    many = trees.thresholds(np.arange(1000.0), np.where(np.arange(1000) == 500, 5000, 1), 10)
    assert {499.5, 500.5} <= set(many) and len(many) <= 20


def test_trees_fit_as_well_as_sparks(rows, made):
    x = cut(made[0].transform(models.prepared(rows, NUMBERS, CATEGORIES)))
    m = trees.grow(made.blocks, [trees.Model("squared", models.every, 3, rounds=8)])[0]
    error = lambda model: model.transform(x).agg(F.avg(F.abs(F.col("y") - F.col("prediction")))).first()[0]
    theirs = GBTRegressor(featuresCol="features", labelCol="y", maxDepth=3, maxIter=8, maxBins=64, subsamplingRate=0.8, seed=1).fit(x)
    assert error(trees.spark_model(made.blocks, m)) < 1.05 * error(theirs)


def test_sets_are_grown_in_the_same_passes(rows, monkeypatch):
    calls, grow = [], trees.grow
    monkeypatch.setattr(trees, "grow", lambda blocks, m: (calls.append(len(m)), grow(blocks, m))[1])
    fit, calibration = rows.filter("id % 2 = 0"), rows.filter("id % 2 = 1")
    found = models.fit_changes(fit, calibration, {"few": (["x"], []), "all": (NUMBERS, CATEGORIES)}, depth=2, rounds=2)
    assert calls == [8] and set(found) == {"few", "all"}
    # A set's trees use its own features alone.
    p = {k: m.transform(calibration.withColumn("kind", F.lit("b"))).select("id", "p_up").collect() for k, m in found.items()}
    q = {k: m.transform(calibration.withColumn("kind", F.lit("a"))).select("id", "p_up").collect() for k, m in found.items()}
    assert sorted(p["few"]) == sorted(q["few"]) and sorted(p["all"]) != sorted(q["all"])


def test_calibration_is_the_least_penalised_loss(spark):
    rng = np.random.default_rng(5)
    v = [(1, 0.1 if u < p else -0.1 if u > 0.9 else 0.0, float(p), float(1 - p)) for p, u in rng.random((500, 2))]
    platt = models.fit_platt(cut(spark.createDataFrame(v, "h int, y double, raw_up double, raw_down double")))
    x, hit = np.array([np.log(p / (1 - p)) for _, _, p, _ in v]), np.array([y > 0.01 for _, y, _, _ in v])
    loss = lambda w, b: np.log1p(np.exp(np.where(hit, -1, 1) * (w * x + b))).sum() + w * w / 2
    w, b = platt[1, "up"]
    assert all(loss(w, b) <= loss(w + d, b + e) for d, e in ((1e-3, 0), (-1e-3, 0), (0, 1e-3), (0, -1e-3)))


def test_importance_of_all_rows(spark, rows):
    """45,000 rows take part, more than the 40,000 of the sample before, and the AUC as they are is that of all rows scored by Spark's model."""
    fit = rows.filter("id % 2 = 0")
    made = models.encoded(fit, NUMBERS, CATEGORIES)
    model, chances = models.grown_changes(made, {"": (NUMBERS, CATEGORIES)}, 3, 3)[""]
    models.calibrate(model, rows.filter("id % 2 = 1"))
    many = cut(rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(15)))).withColumn("x", F.round(F.rand(7), 3)))
    blocks = models.packed(made[0], models.arrays(made[0], models.prepared(many, NUMBERS, CATEGORIES)), like=made.blocks)
    got = {r["_k"]: r for r in metrics.ranked(models.moved_scores(model, chances, blocks, [*NUMBERS, *CATEGORIES]), ["_k"]).collect()}
    assert {k: r["n"] for k, r in got.items()} == dict.fromkeys(range(4), 45_000)
    want = metrics.ranking(model.transform(many).withColumns({"hit": F.col("y") > models.MOVE, "all": F.lit(1)}), ["all"], "p_up", "hit").first()
    assert abs(got[0]["roc_auc"] - want["roc_auc"]) < 1e-4
    # x says nothing about y here, kind does.
    assert abs(got[1]["roc_auc"] - got[0]["roc_auc"]) < 0.02 and got[3]["roc_auc"] < got[0]["roc_auc"] - 0.1
