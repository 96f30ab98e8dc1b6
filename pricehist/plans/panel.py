"""Queries of the panel features."""

from __future__ import annotations

from pyspark.sql import functions as F

from pricehist.operators import panel
from pricehist.sources import adapters as a
from pricehist.sources.adapters import PRELUDE, day, r6


def _features(columns: list[str], whole: tuple[str, ...] = ()):
    def query(spark, sf_dir):
        x = panel.features(a.series(spark, sf_dir))
        return x.select("wine_id", "t", *[F.col(c) if c in whole else r6(F.col(c)).alias(c) for c in columns])

    return query


def _samples(spark, sf_dir):
    rows = a.series(spark, sf_dir).select("wine_id", "t", "date", "price")
    return panel.horizons(panel.diffs(rows), 4, 4)


def f21_one_per_list(spark, sf_dir):
    return a.obs(spark, sf_dir).withColumn("date", day("date"))


def j1_series(spark, sf_dir):
    return a.series(spark, sf_dir).select("wine_id", day("date").alias("date"), "t", "price", "promo_price", "promo_type", "family", "vintage", "region", "style", "tier", "name")


def j7_future_targets(spark, sf_dir):
    return _samples(spark, sf_dir).select("wine_id", "t", "h", "target_t", "target_period_of_year", r6(F.col("y")).alias("y"))


def f12_target_period(spark, sf_dir):
    return _samples(spark, sf_dir).groupBy("h", "target_period_of_year").agg(F.count(F.lit(1)).alias("n"))


def p27_direction(spark, sf_dir):
    return _samples(spark, sf_dir).groupBy("h", panel.direction(F.col("y")).alias("direction")).agg(F.count(F.lit(1)).alias("n"))


def a14_base_rates(spark, sf_dir):
    b = panel.base_rates(_samples(spark, sf_dir))
    return b.select("h", r6(F.col("up")).alias("up"), r6(F.col("down")).alias("down"), "n")


def a18_grid(spark, sf_dir):
    p = a.lists(spark, sf_dir)
    return panel.grid(p).select("lists", "per_year", "step_months", day("last").alias("last"))


def a18_future_dates(spark, sf_dir):
    p = a.lists(spark, sf_dir)
    return panel.future_dates(p, 4).select("h", day("target_date").alias("target_date"))


QUERIES = {
    "f1_lagged_returns": _features(["log_price", "lr_1", "lr_2", "lr_4", "lr_8"]),
    "f2_vol_4": _features(["vol_4"]),
    "f3_changes_8": _features(["changes_8"]),
    "f4_periods_since_change": _features(["periods_since_change"], ("periods_since_change",)),
    "f5_age": _features(["age"], ("age",)),
    "f6_own_moves": _features(["own_valid", "own_up", "own_down", "own_valid_4", "own_up_4", "own_down_4"]),
    "f7_promotions": _features(["on_sale", "on_clearance", "discount"]),
    "f8_vintage_age": _features(["vintage_age", "is_nv", "vintage_year"], ("vintage_age", "vintage_year")),
    "f9_static_attributes": _features(["region", "brand", "grape", "classification"], ("region", "brand", "grape", "classification")),
    "f10_filled_style_tier": _features(["style", "tier"], ("style", "tier")),
    "f12_target_period": f12_target_period,
    "f21_one_per_list": f21_one_per_list,
    "j1_series": j1_series,
    "j7_future_targets": j7_future_targets,
    "p27_direction": p27_direction,
    "a14_base_rates": a14_base_rates,
    "a18_grid": a18_grid,
    "a18_future_dates": a18_future_dates,
}

# The oracle lays every series on the full grid of lists, with ROWS frames and lags.
DENSE = PRELUDE + """, dense AS (
    SELECT w.wine_id, p.t, p.date, s.price, s.promo_type, s.promo_price, s.style, s.tier, ln(s.price) AS logp, s.price IS NOT NULL AS listed
    FROM (SELECT DISTINCT wine_id FROM obs) w CROSS JOIN periods p LEFT JOIN series s ON s.wine_id = w.wine_id AND s.t = p.t
), d AS (
    SELECT *, logp - lag(logp) OVER w AS diff FROM dense WINDOW w AS (PARTITION BY wine_id ORDER BY t)
), m AS (
    SELECT *, CASE WHEN diff IS NOT NULL THEN CAST(abs(diff) > 1e-9 AS INTEGER) END AS changed, CAST(diff IS NOT NULL AS DOUBLE) AS valid,
        CAST(coalesce(diff > ln(1.005), false) AS DOUBLE) AS up, CAST(coalesce(diff < -ln(1.005), false) AS DOUBLE) AS down FROM d
), samples AS (
    SELECT a.wine_id, a.t, h, a.t + h AS target_t, (a.t + h) % 4 AS target_period_of_year, b.logp - a.logp AS y
    FROM dense a CROSS JOIN (SELECT unnest([1, 2, 3, 4]) AS h) JOIN dense b ON b.wine_id = a.wine_id AND b.t = a.t + h WHERE a.listed AND b.listed
)"""


def _dense(columns: str) -> str:
    return f"{DENSE} SELECT * FROM (SELECT wine_id, t, listed, {columns} FROM m WINDOW w AS (PARTITION BY wine_id ORDER BY t)) WHERE listed"


def _only(names: str, columns: str) -> str:
    return f"{DENSE} SELECT wine_id, t, {names} FROM (SELECT *, {columns} FROM m WINDOW w AS (PARTITION BY wine_id ORDER BY t)) WHERE listed"


_lr = ", ".join(f"logp - lag(logp, {k}) OVER w AS lr{k}" for k in (1, 2, 4, 8))
_r = lambda e, n: f"round({e}, 6) + 0.0 AS {n}"
SQL = {
    "f1_lagged_returns": _only(", ".join([_r("logp", "log_price"), *[_r(f"lr{k}", f"lr_{k}") for k in (1, 2, 4, 8)]]), _lr),
    "f2_vol_4": _only(_r("v", "vol_4"), "stddev_samp(diff) OVER (PARTITION BY wine_id ORDER BY t ROWS 3 PRECEDING) AS v"),
    "f3_changes_8": _only("CAST(c AS DOUBLE) AS changes_8", "sum(changed) OVER (PARTITION BY wine_id ORDER BY t ROWS 7 PRECEDING) AS c"),
    "f4_periods_since_change": _only(
        "CAST(t - coalesce(c, f) AS INTEGER) AS periods_since_change",
        "max(CASE WHEN changed = 1 THEN t END) OVER w AS c, min(CASE WHEN listed THEN t END) OVER (PARTITION BY wine_id) AS f"
    ),
    "f5_age": _only("CAST(n AS BIGINT) AS age", "sum(CAST(listed AS INTEGER)) OVER w AS n"),
    "f6_own_moves": _only(
        "valid AS own_valid, up AS own_up, down AS own_down, v4 AS own_valid_4, u4 AS own_up_4, d4 AS own_down_4",
        "sum(valid) OVER r AS v4, sum(up) OVER r AS u4, sum(down) OVER r AS d4",
    ).replace("WINDOW w AS", "WINDOW r AS (PARTITION BY wine_id ORDER BY t ROWS 3 PRECEDING), w AS"),
    "f7_promotions": PRELUDE + """ SELECT wine_id, t, CAST(coalesce(promo_type = 'sale', false) AS DOUBLE) AS on_sale,
        CAST(coalesce(promo_type = 'clearance', false) AS DOUBLE) AS on_clearance,
        round(coalesce(1 - promo_price / price, 0), 6) + 0.0 AS discount FROM series""",
    "f8_vintage_age": PRELUDE + """ SELECT wine_id, t, CAST(year(date) - TRY_CAST(vintage AS INTEGER) AS INTEGER) AS vintage_age,
        CAST(vintage = 'NV' AS DOUBLE) AS is_nv, TRY_CAST(vintage AS INTEGER) AS vintage_year FROM series""",
    "f9_static_attributes": PRELUDE + " SELECT wine_id, t, region, brand, grape, classification FROM series",
    "f10_filled_style_tier": PRELUDE + " SELECT wine_id, t, style, tier FROM series",
    "f12_target_period": DENSE + " SELECT CAST(h AS INTEGER) AS h, CAST(target_period_of_year AS INTEGER) AS target_period_of_year, count(*) AS n FROM samples GROUP BY ALL",
    "f21_one_per_list": PRELUDE + " SELECT * REPLACE (strftime(date, '%Y-%m-%d') AS date) FROM obs",
    "j1_series": PRELUDE + " SELECT wine_id, strftime(date, '%Y-%m-%d') AS date, t, price, promo_price, promo_type, family, vintage, region, style, tier, name FROM series",
    "j7_future_targets": DENSE + """ SELECT wine_id, t, CAST(h AS INTEGER) AS h, CAST(target_t AS INTEGER) AS target_t,
        CAST(target_period_of_year AS INTEGER) AS target_period_of_year, round(y, 6) + 0.0 AS y FROM samples""",
    "p27_direction": DENSE + """ SELECT CAST(h AS INTEGER) AS h, CASE WHEN y > ln(1.005) THEN 'up' WHEN y < -ln(1.005) THEN 'down'
        ELSE 'same' END AS direction, count(*) AS n FROM samples GROUP BY ALL""",
    "a14_base_rates": DENSE + """ SELECT CAST(h AS INTEGER) AS h, round(avg(CAST(y > ln(1.005) AS DOUBLE)), 6) + 0.0 AS up,
        round(avg(CAST(y < -ln(1.005) AS DOUBLE)), 6) + 0.0 AS down, count(*) AS n FROM samples GROUP BY ALL""",
    "a18_grid": PRELUDE + """ SELECT count(*) AS lists, CAST(greatest(1, round_even(count(*) / (date_diff('day', min(date),
        max(date)) / 365.25 + 1e-9), 0)) AS INTEGER) AS per_year,
        CAST(round_even(date_diff('day', (list_sort(list(date), 'DESC'))[2], max(date)) / 30.44, 0) AS INTEGER) AS step_months, strftime(max(date),
            '%Y-%m-%d') AS last FROM periods""",
    "a18_future_dates": PRELUDE + """ SELECT CAST(h AS INTEGER) AS h, strftime(max_date + to_months(CAST(h * 3 AS INTEGER)), '%Y-%m-%d') AS target_date
        FROM (SELECT max(date) AS max_date FROM periods) CROSS JOIN (SELECT unnest([1, 2, 3, 4]) AS h)""",
}
