"""Invariants of fitted models on a small panel."""

import datetime as dt
import math

import numpy as np
from pyspark.sql import functions as F

from pricehist.operators import metrics, models
from pricehist.plans import models as q
from pricehist.plans.evaluation import latest


def test_forecast_invariants(spark, small):
    x = q.m4_forecast(spark, small).toPandas()
    assert len(x) and set(x["h"]) == {1, 2, 3, 4}
    assert (x["p10"] <= x["p50"]).all() and (x["p50"] <= x["p90"]).all()
    assert x[["p_up", "p_down"]].min().min() >= 0 and (x["p_up"] + x["p_down"]).max() <= 1 + 1e-3
    assert (x["up_pct"] >= 0.5).all() and (x["down_pct"] <= -0.5).all()


def test_change_model_holdout_and_calibration(spark, small):
    x = q.m2_change_model(spark, small).toPandas()
    assert len(x) and (x["p_up"] + x["p_down"]).max() <= 1 + 1e-9 and not x.duplicated(["wine_id", "t", "h"]).any()
    got = q.m3_calibration(spark, small).toPandas()
    # The rates of the holdout are those of the rows themselves, whatever the model.
    for r in got.itertuples():
        mine = x[x["h"] == r.h]
        hit = mine["y"] > math.log(1.005) if r.side == "up" else mine["y"] < -math.log(1.005)
        assert r.n == len(mine) and r.positives == hit.sum() and abs(r.actual_rate - hit.mean()) < 1e-9
        assert 0 <= r.predicted_rate <= 1


def test_ablation_has_four_sets_by_segment(spark, small):
    x = q.m10_ablation(spark, small).toPandas()
    assert set(x["set"]) == set(q.SETS) and "all" in set(x["segment"]) <= set(q.SEGMENTS)
    # Sets are scored on the same rows.
    assert (x.groupby(["segment", "h", "side"])[["n", "positives"]].nunique() == 1).all().all()


def test_importance_of_the_fitted_model(spark, small):
    x = q.m9_model_importance(spark, small).toPandas()
    assert sorted(x["feature"]) == sorted([*q.BASE, *q.WINDOW, "style", "tier"]) and x["auc_drop"].is_monotonic_decreasing


def test_importance_scores_once(spark):
    """A feature that alone makes the score loses the whole of the AUC over chance, one that is ignored nothing; all is scored in one call."""
    rows = spark.range(400).selectExpr("CAST(id AS string) AS id", "IF(id % 4 = 0, 0.2D, 0D) AS y", "IF(id % 4 = 0, 1D, 0D) AS good", "CAST(id % 7 AS string) AS other")
    calls = []
    got = metrics.importance(rows, ["other", "good"], lambda d: (calls.append(1), d.withColumn("p_up", F.col("good")))[1]).collect()
    assert len(calls) == 1 and [r["feature"] for r in got] == ["good", "other"]
    assert got[1]["auc_drop"] == 0 and 0.3 < got[0]["auc_drop"] < 0.7
    assert metrics.importance(rows.limit(0), ["good"], lambda d: d.withColumn("p_up", F.col("good"))).count() == 0


def test_weather_of_vintages(spark, small):
    """Transitions and wines meet the weather of some of their vintages, and no rows are lost or doubled."""
    w = q._weather(spark, small)
    assert w.count() == w.select("region", "vintage").distinct().count() > 0
    x = latest(spark, small).withColumn("vint", F.expr("try_cast(vintage AS int)") + q.LATER)
    assert 0 < x.join(w.withColumnRenamed("vintage", "vint"), ["region", "vint"]).count() < x.count()


def test_next_vintage_outlook(spark, small):
    x = q.m11_next_vintage(spark, small).toPandas()
    assert (x["p10_pct"] <= x["p50_pct"]).all() and (x["p50_pct"] <= x["p90_pct"]).all() and (x["p_up"] + x["p_down"] <= 1 + 1e-3).all()


def test_fair_price_order(spark, small):
    x = q.m14_fair_price(spark, small).toPandas()
    assert len(x) and (x["fair_p10"] <= x["fair_p50"]).all() and (x["fair_p50"] <= x["fair_p90"]).all()


def test_name_score_of_every_wine(spark, small):
    x = q.m12_name_score(spark, small).toPandas()
    assert sorted(x["wine_id"]) == sorted(r["wine_id"] for r in latest(spark, small).select("wine_id").collect())
    assert x["name_score"].notna().all()


def _brute_scores(train, texts):
    """Ridge of weight 1 on TF-IDF of words and pairs, with an unpenalised intercept. train: text, y."""
    terms = lambda t: t.split() + [" ".join(p) for p in zip(t.split(), t.split()[1:], strict=False)]
    docs = [terms(t) for t, _ in train]
    df = {w: sum(w in d for d in docs) for d in docs for w in d}
    names = sorted(w for w in df if df[w] >= 2)

    def vector(t):
        v = np.array([(1 + math.log(terms(t).count(w))) * (math.log((1 + len(docs)) / (1 + df[w])) + 1) if w in terms(t) else 0.0 for w in names])
        return v / max(np.linalg.norm(v), 1e-12)

    m, y = np.array([vector(t) for t, _ in train]), np.array([v for _, v in train])
    y = y - y.mean()
    c = m - m.mean(0)
    w = np.linalg.solve(c.T @ c + np.eye(len(names)), c.T @ y)
    return [float((vector(t) - m.mean(0)) @ w) for t in texts]


def test_held_out_scores_against_brute_force(spark):
    words = ["oak", "reserve", "hill", "valley"]
    rows = [(i, f"{words[i % 4]} {words[i * 7 // 3 % 4]}" if i != 5 else "unseen thing", float(i % 4) + i % 3 / 10, i % 3) for i in range(24)]
    x = models.held_out_scores(spark.createDataFrame(rows, "wine_id long, text string, y double, fold int"), [(0,), (1,), (2,), (0, 1)]).collect()
    for group in ([0], [1], [2], [0, 1]):
        got = {r["wine_id"]: r["name_score"] for r in x if r["left_out"] == group}
        mine = [r for r in rows if r[3] in group]
        want = _brute_scores([(r[1], r[2]) for r in rows if r[3] not in group], [r[1] for r in mine])
        assert set(got) == {r[0] for r in mine}
        assert max(abs(got[r[0]] - v) for r, v in zip(mine, want, strict=True)) < 2e-3


def test_fair_price_of_every_wine(spark, small, monkeypatch):
    kept = models.cut(q._fair_rows(spark, small))
    monkeypatch.setattr(q, "_fair_rows", lambda *_: kept)
    rows = kept.toPandas()
    wines = {r["wine_id"] for r in latest(spark, small).select("wine_id").collect()}
    # Every wine once for each fold left out, with a name score.
    assert len(rows) == q.FOLDS * len(wines) and set(rows["wine_id"]) == wines and not rows.duplicated(["wine_id", "outer"]).any() and rows["name_score"].notna().all()
    # The brand level comes from other families of the training folds.
    for r in rows.sample(40, random_state=1).itertuples():
        y = rows[(rows["outer"] == r.outer) & (rows["fold"] != r.outer) & (rows["brand"] == r.brand) & (rows["family"] != r.family)]["y"]
        assert abs(r.brand_mean_logp - y.mean()) < 1e-9 if len(y) else math.isnan(r.brand_mean_logp)
    x = q.m14_fair_price(spark, small).toPandas()
    assert sorted(x["wine_id"]) == sorted(wines)
    assert "name_score" in q.FAIR_NUMBERS
    # Bands come from held-out errors, differ in width and, once scaled, cover 80 percent.
    y = {r.wine_id: math.exp(r.y) for r in rows.itertuples()}
    raw = np.mean([r.fair_p10 - 0.01 <= y[r.wine_id] <= r.fair_p90 + 0.01 for r in x.itertuples()])
    assert 0.65 <= raw <= 0.95 and (x["fair_p90"] / x["fair_p50"]).round(3).nunique() > 5
    z = q.m15_model_prices(spark, small).toPandas()
    assert sorted(z["wine_id"]) == sorted(wines) and z["k"].nunique() == 1 and 1 <= z["k"][0] < 3
    assert np.mean([r.fair_p10 - 0.01 <= y[r.wine_id] <= r.fair_p90 + 0.01 for r in z.itertuples()]) >= 0.8


def test_widths_follow_the_row(spark):
    """Errors of ten times the size where x = 1: the band is wider there, and covers both kinds alike."""
    rng = np.random.default_rng(3)
    rows = [(i, 1, float(i % 2), float(v * (0.5 if i % 2 else 0.05))) for i, v in enumerate(rng.normal(size=1200))]
    m = models.fit_range(spark.createDataFrame(rows, "id int, h int, x double, y double"), None, ["x"], [], depth=2, rounds=5)
    x = m.transform(spark.createDataFrame(rows, "id int, h int, x double, y double")).toPandas()
    width = (x["p90"] - x["p10"]).groupby(x["x"]).mean()
    inside = ((x["p10"] <= x["y"]) & (x["y"] <= x["p90"])).groupby(x["x"]).mean()
    assert width[1.0] > 5 * width[0.0] and ((inside > 0.7) & (inside < 0.9)).all()
    assert (x["p10"] <= x["p50"]).all() and (x["p50"] <= x["p90"]).all()


def test_rolling_windows_train_on_the_past(spark):
    """The sign of y turns in the last windows: a model that saw it would not be this wrong."""
    start = dt.date(2016, 3, 1)
    rows = [(start + dt.timedelta(days=91 * (i // 8)), (0.1 if i % 2 else -0.1) * (-1 if i >= 136 else 1), 1, float(i % 2), 0.05 if i % 3 else None) for i in range(160)]
    t = spark.createDataFrame(rows, "date date, y double, h int, x double, family_mean_change double")
    p = models.cut(models.rolling_predictions(t, {"current": (["x"], []), "+same": (["y"], [])}, (1,), rounds=1))
    got = {(r["fold"], r["set"]): r for r in models.rolling_scores(p).collect()}
    last = max(r[0] for r in rows)
    assert {k for k, _ in got} == {0, 1, 2, 3} and {s for _, s in got} == {"current", "+same"}
    for k in range(4):
        to, since = last.replace(year=last.year - k), last.replace(year=last.year - k - 1)
        mine = [r for r in rows if since < r[0] <= to]
        r = got[k, "current"]
        assert r["fold_end"] == to and r["transitions"] == len(mine)
        assert abs(r["same_price_mae"] - 0.1) < 1e-9 and abs(r["family_history_mae"] - np.mean([abs(m[1] - (m[4] or 0)) for m in mine])) < 1e-9
    assert got[3, "current"]["auc"] == 1 and got[3, "current"]["mae"] < 0.02 and got[3, "current"]["coverage_80"] is not None
    assert got[0, "current"]["auc"] < 0.5 and got[0, "+same"]["auc"] == 1
    assert {r["set"] for r in metrics.cv_summary(models.rolling_scores(p)).collect()} == {"current", "+same"}
