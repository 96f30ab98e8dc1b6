"""Queries of fitted models (M2-M4, M10-M12, M14, M15). Their rows depend on the learner, so they have no oracle; the tests hold their invariants."""

from __future__ import annotations

from functools import partial

from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from pricehist.functions.shared import cut, written
from pricehist.operators import context, fair, metrics, models, panel, vintages
from pricehist.plans.context import NORMAL, daily, supply
from pricehist.plans.evaluation import CALIBRATION, CUTOFF, _base, latest
from pricehist.plans.vintages import dated_series
from pricehist.sources import adapters as a
from pricehist.sources.adapters import day

# The names of the features.
BASE = ["log_price", "lr_1", "lr_2", "lr_4", "lr_8", "vol_4", "changes_8", "periods_since_change", "age", "on_sale", "on_clearance", "discount",
    "vintage_age", "is_nv", "h", "target_period_of_year"]
WINDOW = ["years_to_window", "years_past_window", "in_window"]
BRAND = ["brand_n_others", "brand_up_1q", "brand_up_4q", "brand_down_4q", "brand_rel_price"]
CATEGORIES = ["style", "tier", "grape", "classification"]


#: Lines of `lineitem` a task. A line gives about 1.5 samples, each with a vector of some 400 bytes.
LINES = 100_000


def _tasks(spark, sf_dir):
    """How many tasks share the samples: as many as their number asks for. Left to itself, Spark goes by the shuffled series, which are far smaller."""
    return max(spark.sparkContext.defaultParallelism, -(-a.table(spark, sf_dir, "lineitem").count() // LINES))


def _origins(spark, sf_dir, brand=False):
    # All windows and what is made of their rows follow this partitioning.
    x = context.window_features(panel.features(a.series(spark, sf_dir).repartition(_tasks(spark, sf_dir), "wine_id"), fixed=True))
    if not brand:
        return x
    x = written(x, "origins")
    return context.brand_features(x, cut(context.brand_counts(x)))


def _samples(spark, sf_dir, brand=False, newest=False):
    """newest: also rows with h = 0, each wine's newest listing."""
    x = _origins(spark, sf_dir, brand)
    x = panel.horizons(x.repartition(_tasks(spark, sf_dir), "wine_id") if brand else x, 4, 4, newest)
    keep = ["wine_id", "t", "target_t", "y", *BASE, *WINDOW, *(BRAND if brand else []), *CATEGORIES]
    x = cut(x.select(*keep))
    split = F.when(F.col("target_t") <= CUTOFF - CALIBRATION, "fit").when(F.col("target_t") <= CUTOFF, "calibration").otherwise("holdout")
    return x.withColumn("split", split)


def m2_change_model(spark, sf_dir):
    x = _samples(spark, sf_dir)
    m = models.fit_change(x.filter("split = 'fit'"), x.filter("split = 'calibration'"), BASE + WINDOW, CATEGORIES)
    return m.transform(x.filter("split = 'holdout'")).select("wine_id", "t", "h", "y", "p_up", "p_down", "up_pct", "down_pct")


def m3_calibration(spark, sf_dir):
    """Actual and predicted rates on the holdout, by horizon and side."""
    x = _samples(spark, sf_dir)
    m = models.fit_change(x.filter("split = 'fit'"), x.filter("split = 'calibration'"), BASE, ["style", "tier"], depth=3, rounds=5)
    return metrics.change_scores(m.transform(x.filter("split = 'holdout'")), _base(x))


def m4_forecast(spark, sf_dir):
    # Listings and samples come from one pass over the series, and all models from one encoding of the fit rows.
    x = _samples(spark, sf_dir, newest=True)
    fit, calibration = (x.filter(F.col("h") > 0).filter(F.col("split") == k) for k in ("fit", "calibration"))
    change, band = models.fit_both(fit, calibration, BASE + WINDOW, CATEGORIES, depth=3, rounds=8)
    o = x.filter(F.col("h") == 0).drop("h", "target_t", "target_period_of_year", "y", "split")
    newest = o.agg(F.max("t").alias("newest"))
    dates = panel.future_dates(a.lists(spark, sf_dir), 4)
    rows = o.join(F.broadcast(newest), F.col("t") == F.col("newest")).join(F.broadcast(dates), F.lit(True)).withColumn("target_period_of_year",
        F.pmod(F.col("t") + F.col("h"), F.lit(4)))
    return models.forecast(rows, change, band).withColumn("target_date", day("target_date"))


SETS = {
    "current": (BASE + WINDOW, ["style", "tier"]),
    "+brand": (BASE + WINDOW + BRAND, ["style", "tier"]),
    "+attributes": (BASE + WINDOW, CATEGORIES),
    "+both": (BASE + WINDOW + BRAND, CATEGORIES),
}
SEGMENTS = {
    "all": "true", "with a vintage": "is_nv = 0", "luxury": "tier = 'luxury'", "red": "style = 'red'",
    "large brand": "brand_n_others >= 10", "small brand": "brand_n_others < 3",
}


def m10_ablation(spark, sf_dir):
    """Four feature sets on one split, scored by segment a quarter and a year ahead."""
    x = _samples(spark, sf_dir, brand=True)
    base = cut(_base(x))
    # All sets are grown in the same passes over the fit rows.
    found = models.fit_changes(x.filter("split = 'fit'"), x.filter("split = 'calibration'"), SETS, depth=3, rounds=5)

    def job(name):
        m = found[name]
        y = metrics.segments(m.transform(x.filter("split = 'holdout' AND h IN (1, 4)")), {k: F.expr(v) for k, v in SEGMENTS.items()})
        s = metrics.change_scores(y, base, ("segment", "h", "side"))
        return s.select(F.lit(name).alias("set"), "segment", "h", "side", "n", "positives", "roc_auc", "avg_precision", "brier_skill")

    return models.side_by_side([partial(job, name) for name in SETS])


def m9_model_importance(spark, sf_dir):
    """How much the AUC of the fitted model's rises falls on the holdout when a feature's values change places."""
    x = _samples(spark, sf_dir)
    fit, calibration, holdout = (x.filter(F.col("split") == k) for k in ("fit", "calibration", "holdout"))
    return models.importance(fit, calibration, holdout, BASE + WINDOW, ["style", "tier"], depth=3, rounds=5)


# The names of the features.
NEXT = ["prev_log_price", "vintage_gap", "prev_life_quarters", "prev_life_change", "prev_changes", "prev_on_sale", "prev_on_clearance",
    "family_prev_transitions", "family_mean_change", "market_up_share_4q", "brand_recent_vintage_change", "brand_recent_vintage_n"]


def m11_next_vintage(spark, sf_dir):
    """The outlook for each current vintage, in percent."""
    s = dated_series(spark, sf_dir).withColumn("vintage", F.expr("CASE WHEN vintage = 'NV' THEN 'NV' ELSE CAST(CAST(vintage AS int) + 8 AS string) END"))
    t = vintages.transitions(s)
    t = cut(vintages.brand_history(t, t).withColumn("h", F.lit(1)).select("wine_id", "date", "y", "h", *NEXT, "style", "tier"))
    change, band = models.fit_both(t, None, NEXT, ["style", "tier"], depth=3, rounds=8)
    nxt = vintages.next_vintages(s, vintages.transitions(s)).withColumn("h", F.lit(1))
    x = change.transform(band.transform(nxt))
    pct = lambda c: F.round(F.expm1(c) * 100, 1).alias(f"{c}_pct")
    return x.select("wine_id", "new_vintage", F.round("p_up", 4).alias("p_up"), F.round("p_down", 4).alias("p_down"), pct("p10"), pct("p50"), pct("p90"))


# The names of the features.
WEATHER = ["gdd_anom", "frost_days_anom", "heat_days_anom", "harvest_rain_anom", "gs_rain_anom"]
NEXT_WEATHER = [f"new_{v}" for v in WEATHER] + [f"diff_{v}" for v in WEATHER]
#: Vintages of the tables end where their weather begins; this many years later they meet it (as in the queries of J8 and J13).
LATER = 5


def _weather(spark, sf_dir):
    return context.anomalies(context.season_features(daily(spark, sf_dir)), *NORMAL).select("region", "vintage", *WEATHER)


NEXT_BRAND = ["brand_n_listed", "brand_up_share_4q", "brand_recent_vintage_change", "brand_recent_vintage_n"]
NEXT_SUPPLY = [c for c in NEXT if not c.startswith("brand_")] + ["new_tons_yoy", "new_grape_price_yoy"]
NEXT_SETS = {
    "current": (NEXT_SUPPLY, ["style", "tier"]),
    "+weather": (NEXT_SUPPLY + NEXT_WEATHER, ["style", "tier"]),
    "+brand": (NEXT_SUPPLY + NEXT_BRAND, ["style", "tier"]),
    "+attributes": (NEXT_SUPPLY, ["style", "tier", "grape", "classification"]),
    "+both": (NEXT_SUPPLY + NEXT_BRAND, ["style", "tier", "grape", "classification"]),
}


def m11_rolling_cv(spark, sf_dir):
    """Each set of features on the last four years, with two seeds."""
    s = cut(dated_series(spark, sf_dir))
    t = vintages.transitions(s)
    t = vintages.published_supply(vintages.brand_history(t, t), supply(spark, sf_dir))
    stats = context.brand_stats(s.select("wine_id", "t", "date", "price", "brand"), s.select("t", "date").distinct())
    stats = stats.select("date", "brand", F.col("n_listed").alias("brand_n_listed"), context.ratio(F.col("n_up_4"), F.col("n_valid_4")).alias("brand_up_share_4q"))
    t = t.join(stats, ["date", "brand"], "left").withColumn("h", F.lit(1))
    t = t.withColumns({c: F.col(c) + LATER for c in ("new_vintage", "prev_vintage")})
    t = vintages.weather_difference(t, written(_weather(spark, sf_dir), "weather"), a.regions(spark, sf_dir), WEATHER)
    t = cut(t.select("date", "y", "h", *NEXT_SUPPLY, *NEXT_WEATHER, *NEXT_BRAND, "style", "tier", "grape", "classification"))
    return models.rolling_scores(models.rolling_predictions(t, NEXT_SETS, (1, 2)))


def m11_cv_summary(spark, sf_dir):
    """The means of m11_rolling_cv by set, against the current one."""
    return metrics.cv_summary(m11_rolling_cv(spark, sf_dir))


FOLDS = 5


def m12_name_score(spark, sf_dir):
    """Out-of-fold name scores of every wine."""
    x = cut(latest(spark, sf_dir).select("wine_id", "text", "y", "fold"))
    return models.held_out_scores(x, [(k,) for k in range(FOLDS)]).select("wine_id", "name_score")


BRAND_LEVEL = ["brand_mean_logp", "brand_n_families", "brand_std_logp"]
FAIR_NUMBERS = ["vintage_age", "is_nv", "listing_year", *BRAND_LEVEL, "name_score"]
FAIR_CATEGORIES = ["style", "region", "grape", "classification"]
VINTAGE_WEATHER = [f"vint_{v}" for v in WEATHER]
FAIR_SETS = {
    "full": FAIR_NUMBERS, "no name text": [c for c in FAIR_NUMBERS if c != "name_score"],
    "no producer level": [c for c in FAIR_NUMBERS if c not in BRAND_LEVEL], "+vintage weather": FAIR_NUMBERS + VINTAGE_WEATHER,
}


def _fair_rows(spark, sf_dir):
    """A row for every wine and fold left out (`outer`), with its features from the other folds: a wine of that fold is to be priced, the others train.

    A training row's name score is out of fold too: its own fold is left out as well, so one fit serves both folds of a pair."""
    w = _weather(spark, sf_dir).select("region", F.col("vintage").alias("vint"), *[F.col(v).alias(f"vint_{v}") for v in WEATHER])
    x = latest(spark, sf_dir).withColumn("vint", F.expr("try_cast(vintage AS int)") + LATER).join(w, ["region", "vint"], "left")
    x = cut(x.select("wine_id", "tier", "text", "brand", "family", "y", "fold", "vintage_age", "is_nv", "listing_year", *VINTAGE_WEATHER, *FAIR_CATEGORIES))
    groups = [(k,) for k in range(FOLDS)] + [(j, k) for j in range(FOLDS) for k in range(j + 1, FOLDS)]
    scores = models.held_out_scores(x.select("wine_id", "text", "y", "fold"), groups)
    other = F.coalesce(F.get(F.filter("left_out", lambda k: k != F.col("fold")), F.lit(0)), F.col("fold"))
    rows = x.join(scores.select("wine_id", other.alias("outer"), "name_score"), "wine_id").drop("text")
    return cut(fair.brand_encoding(rows.filter("fold <> outer"), rows, ("outer",)).withColumn("h", F.lit(1)))


def _fair_predictions(rows, numbers):
    """p10, p50 and p90 of every wine by models of the folds that it is not in.

    Bands come from held-out errors: a fold's widths are fitted on the errors that the wines of the other folds had when they were held out, and its
    percentiles are those of the other folds' errors over their widths, each by a model that had not seen the wine's error."""
    args = {"depth": 5, "rounds": 15}

    def middle(k):
        train, test = rows.filter((F.col("outer") == k) & (F.col("fold") != k)), rows.filter((F.col("outer") == k) & (F.col("fold") == k))
        return models.fit_range(train, None, numbers, FAIR_CATEGORIES, median_only=True, **args).middle(test)

    held_out = models.side_by_side([partial(middle, k) for k in range(FOLDS)], FOLDS).withColumn("e", F.col("y") - F.col("p50"))

    def width(k):
        others = models.prepared(held_out.filter(F.col("fold") != k), numbers, FAIR_CATEGORIES)
        encode = Pipeline(stages=models.encoder(numbers, FAIR_CATEGORIES)).fit(others)
        m = models.fit_width(encode, cut(encode.transform(others).select("features", "e")), numbers, FAIR_CATEGORIES, **args)
        return m.transform(held_out.filter(F.col("fold") == k)).select("wine_id", "tier", "fold", "y", "p50", "e", "w")

    x = models.side_by_side([partial(width, k) for k in range(FOLDS)], FOLDS)
    others = F.explode(F.expr(f"filter(sequence(0, {FOLDS - 1}), k -> k <> fold)"))
    return models.band(x, models.spread(x.select(others.alias("fold"), "e", "w"), "fold"), "fold").select("wine_id", "tier", "y", "p10", "p50", "p90")


def m14_fair_price(spark, sf_dir):
    """Out-of-fold fair prices of every wine."""
    p = _fair_predictions(_fair_rows(spark, sf_dir), FAIR_NUMBERS)
    usd = lambda c: F.round(F.exp(c), 2).alias(f"fair_{c}")
    return p.select("wine_id", usd("p10"), usd("p50"), usd("p90"), metrics.value_pct(F.col("y"), F.col("p50")).alias("value_pct"))


def m15_model_prices(spark, sf_dir):
    """Out-of-fold fair prices of every wine with the band widened k times, so that it covers 80 percent of all."""
    p = _fair_predictions(_fair_rows(spark, sf_dir), FAIR_NUMBERS)
    # One row, which is broadcast.
    p = p.join(F.broadcast(metrics.band_scale(p)), F.lit(True))
    usd = lambda c: F.round(F.exp(F.col("p50") + F.col("k") * (F.col(c) - F.col("p50"))), 2).alias(f"fair_{c}")
    return p.select("wine_id", F.round("k", 2).alias("k"), usd("p10"), usd("p50"), usd("p90"), metrics.value_pct(F.col("y"), F.col("p50")).alias("value_pct"))


def m14_model_scores(spark, sf_dir):
    """Scores of the fitted models, of all wines and by tier, for each set of features."""
    rows, out = _fair_rows(spark, sf_dir), None
    for name, numbers in FAIR_SETS.items():
        p = _fair_predictions(rows, numbers).withColumn("tier", F.explode(F.array(F.lit("all"), F.col("tier"))))
        s = fair.evaluate(p, ["tier"]).select(F.lit(name).alias("set"), "*")
        out = s if out is None else out.unionByName(s)
    return out


QUERIES = {f.__name__: f for f in (m2_change_model, m3_calibration, m4_forecast, m9_model_importance, m10_ablation, m11_next_vintage, m11_rolling_cv,
    m11_cv_summary, m12_name_score, m14_fair_price, m14_model_scores, m15_model_prices)}
SQL: dict[str, str] = {}
