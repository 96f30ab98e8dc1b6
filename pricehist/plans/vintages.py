"""Queries of vintage transitions."""

from __future__ import annotations

from pyspark.sql import functions as F

from pricehist.operators import vintages as v
from pricehist.plans.context import CONTEXT, daily
from pricehist.operators.context import season_features
from pricehist.sources import adapters as a
from pricehist.sources.adapters import day, r6


def dated_series(spark, sf_dir):
    """The series with one wine for each family and vintage (the lowest number)."""
    s = a.series(spark, sf_dir)
    w = a.wines(spark, sf_dir).groupBy("family", "vintage").agg(F.min("wine_id").alias("wine_id")).select("wine_id")
    return s.join(w, "wine_id", "left_semi")


def _transitions(spark, sf_dir):
    return v.transitions(dated_series(spark, sf_dir))


def a9_market_up_share(spark, sf_dir):
    return v.market_up_share(dated_series(spark, sf_dir)).select(day("date").alias("date"), r6(F.col("market_up_share_4q")).alias("market_up_share_4q"))


def a10_wine_spans(spark, sf_dir):
    x = v.spans(dated_series(spark, sf_dir))
    return x.select("wine_id", "family", "vint", "region", "style", "tier", day("first_seen").alias("first_seen"), day("last_seen").alias("last_seen"))


def a11_family_history(spark, sf_dir):
    return v.family_history(_transitions(spark, sf_dir)).select("family", "family_prev_transitions", r6(F.col("family_mean_change")).alias("family_mean_change"))


def f13_transitions(spark, sf_dir):
    return _transitions(spark, sf_dir).select("wine_id", "prev_wine_id", "family", day("date").alias("date"), "new_vintage", "prev_vintage",
        "vintage_gap", r6(F.col("y")).alias("y"))


def f14_previous_life(spark, sf_dir):
    return _transitions(spark, sf_dir).select("wine_id", "prev_life_quarters", r6(F.col("prev_life_change")).alias("prev_life_change"),
        "prev_changes", "prev_on_sale", "prev_on_clearance")


def f15_family_history(spark, sf_dir):
    return _transitions(spark, sf_dir).select("wine_id", "family_prev_transitions", r6(F.col("family_mean_change")).alias("family_mean_change"),
        r6(F.col("market_up_share_4q")).alias("market_up_share_4q"))


def f17_next_vintages(spark, sf_dir):
    s = dated_series(spark, sf_dir).withColumn("vintage", F.expr("CASE WHEN vintage = 'NV' THEN 'NV' ELSE CAST(CAST(vintage AS int) + 8 AS string) END"))
    x = v.next_vintages(s, v.transitions(s))
    return x.select("family", "wine_id", day("date").alias("date"), "new_vintage", "prev_life_quarters", "prev_changes", "family_prev_transitions",
        r6(F.col("family_mean_change")).alias("family_mean_change"), "brand_recent_vintage_n",
        r6(F.col("brand_recent_vintage_change")).alias("brand_recent_vintage_change"))


def j11_previous_price(spark, sf_dir):
    return _transitions(spark, sf_dir).select("wine_id", "prev_wine_id", "prev_price", r6(F.col("prev_log_price")).alias("prev_log_price"))


def j12_brand_recent(spark, sf_dir):
    t = _transitions(spark, sf_dir)
    return v.brand_history(t, t).select("wine_id", "brand_recent_vintage_n", r6(F.col("brand_recent_vintage_change")).alias("brand_recent_vintage_change"))


def j13_weather_difference(spark, sf_dir):
    t = _transitions(spark, sf_dir).withColumns({"new_vintage": F.col("new_vintage") + 5, "prev_vintage": F.col("prev_vintage") + 6})
    x = v.weather_difference(t, season_features(daily(spark, sf_dir)), a.regions(spark, sf_dir), ["gdd", "heat_days"])
    return x.select("wine_id", a.r3(F.col("new_gdd")).alias("new_gdd"), a.r3(F.col("diff_gdd")).alias("diff_gdd"), "new_heat_days", "diff_heat_days")


QUERIES = {f.__name__: f for f in (
    a9_market_up_share, a10_wine_spans, a11_family_history, f13_transitions, f14_previous_life, f15_family_history, f17_next_vintages,
    j11_previous_price, j12_brand_recent, j13_weather_difference,
)}


def chain(shift: int = 0) -> str:
    """The oracle's transitions: pairs by lag, the past by correlated subqueries."""
    return CONTEXT + f""", vs AS (
    SELECT s.* REPLACE (CASE vintage WHEN 'NV' THEN 'NV'
        ELSE CAST(CAST(vintage AS INTEGER) + {shift} AS VARCHAR) END AS vintage), TRY_CAST(vintage AS INTEGER) + {shift} AS vint FROM series s
    WHERE wine_id IN (SELECT min(wine_id) FROM wines GROUP BY family, vintage) AND vintage <> 'NV'
), vgrid AS (
    SELECT date, row_number() OVER (ORDER BY date) AS k FROM (SELECT DISTINCT date FROM vs)
), market AS (
    SELECT date, sum(rose) OVER r / nullif(sum(pairs) OVER r, 0) AS share FROM (
        SELECT g.k, g.date, count(b.price) AS pairs, count(*) FILTER (ln(a.price / b.price) > ln(1.005)) AS rose
        FROM vs a JOIN vgrid g ON g.date = a.date LEFT JOIN vgrid h ON h.k = g.k - 1 LEFT JOIN vs b ON b.wine_id = a.wine_id AND b.date = h.date GROUP BY g.k, g.date
    ) WINDOW r AS (ORDER BY k ROWS 3 PRECEDING)
), sp AS (
    SELECT wine_id, any_value(family) AS family, any_value(vint) AS vint, any_value(region) AS region, any_value(brand) AS brand,
        any_value(style) AS style, any_value(tier) AS tier,
        min(date) AS first_seen, max(date) AS last_seen, arg_min(price, date) AS first_price FROM vs GROUP BY wine_id
), pr AS (
    SELECT *, lag(wine_id) OVER w AS prev_wine_id, lag(vint) OVER w AS prev_vintage FROM sp WINDOW w AS (PARTITION BY family ORDER BY vint, wine_id)
), moves AS (
    SELECT *, abs(ln(price) - ln(lag(price) OVER (PARTITION BY wine_id ORDER BY date))) > ln(1.005) AS move FROM vs
), t0 AS (
    SELECT p.wine_id, p.prev_wine_id, p.family, p.brand, p.region, p.first_seen AS date, p.vint AS new_vintage, p.prev_vintage,
        p.vint - p.prev_vintage AS vintage_gap, p.first_price,
        arg_max(h.price, h.date) AS prev_price, count(*) AS prev_life_quarters, ln(arg_max(h.price, h.date)) - ln(arg_min(h.price,
            h.date)) AS prev_life_change, count(*) FILTER (move) AS prev_changes,
        coalesce(arg_max(coalesce(h.promo_type, '-'), h.date) = 'sale', false) AS sale, coalesce(arg_max(coalesce(h.promo_type, '-'), h.date) = 'clearance', false) AS clearance
    FROM pr p JOIN moves h ON h.wine_id = p.prev_wine_id AND h.date <= p.first_seen GROUP BY ALL
), t1 AS (
    SELECT *, ln(first_price / prev_price) AS y, count(*) OVER w AS family_prev_transitions, avg(ln(first_price / prev_price)) OVER w AS family_mean_change FROM t0
    WINDOW w AS (PARTITION BY family ORDER BY new_vintage, wine_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), tr AS (
    SELECT t1.*, share FROM t1 LEFT JOIN market USING (date) WHERE date > (SELECT min(date) FROM vs)
)"""


_r = lambda e, n: f"round({e}, 6) + 0.0 AS {n}"
_day = lambda e, n: f"strftime({e}, '%Y-%m-%d') AS {n}"
_recent = """(SELECT {0} FROM tr h WHERE h.brand = t.brand AND h.family <> t.family AND h.date < t.date AND h.date >= CAST(t.date - INTERVAL 24 MONTH AS DATE))"""
SQL = {
    "a9_market_up_share": chain() + f" SELECT {_day('date', 'date')}, {_r('share', 'market_up_share_4q')} FROM market",
    "a10_wine_spans": chain() + f" SELECT wine_id, family, vint, region, style, tier, {_day('first_seen', 'first_seen')}, {_day('last_seen', 'last_seen')} FROM sp",
    "a11_family_history": chain() + f" SELECT family, count(*) AS family_prev_transitions, {_r('avg(y)', 'family_mean_change')} FROM tr GROUP BY family",
    "f13_transitions": chain() + f" SELECT wine_id, prev_wine_id, family, {_day('date', 'date')}, new_vintage, prev_vintage, vintage_gap, {_r('y', 'y')} FROM tr",
    "f14_previous_life": chain() + f""" SELECT wine_id, prev_life_quarters, {_r('prev_life_change', 'prev_life_change')}, prev_changes,
        CAST(sale AS DOUBLE) AS prev_on_sale, CAST(clearance AS DOUBLE) AS prev_on_clearance FROM tr""",
    "f15_family_history": chain() + f" SELECT wine_id, family_prev_transitions, {_r('family_mean_change', 'family_mean_change')}, {_r('share', 'market_up_share_4q')} FROM tr",
    "f17_next_vintages": chain(8) + f""", c AS (
            SELECT vs.*, CAST(max(date) OVER () + INTERVAL 3 MONTH AS DATE) AS next FROM vs WHERE date = (SELECT max(date) FROM vs)
                QUALIFY row_number() OVER (PARTITION BY family ORDER BY vint DESC, wine_id DESC) = 1
        ), t AS (SELECT family, brand, wine_id, next AS date, vint FROM c WHERE vint >= year(date) - 8)
        SELECT family, wine_id, {_day('date', 'date')}, vint + 1 AS new_vintage, (SELECT count(*) FROM vs
            WHERE vs.wine_id = t.wine_id) AS prev_life_quarters, (SELECT count(*) FILTER (move) FROM moves
            WHERE moves.wine_id = t.wine_id) AS prev_changes,
            (SELECT count(*) FROM tr h WHERE h.family = t.family) AS family_prev_transitions, round((SELECT avg(y) FROM tr h
                WHERE h.family = t.family), 6) + 0.0 AS family_mean_change,
            {_recent.format('count(*)')} AS brand_recent_vintage_n, round({_recent.format('avg(y)')}, 6) + 0.0 AS brand_recent_vintage_change FROM t""",
    "j11_previous_price": chain() + f" SELECT wine_id, prev_wine_id, prev_price, {_r('ln(prev_price)', 'prev_log_price')} FROM tr",
    "j12_brand_recent": chain() + f""" SELECT wine_id, {_recent.format('count(*)')} AS brand_recent_vintage_n, round({_recent.format('avg(y)')},
        6) + 0.0 AS brand_recent_vintage_change FROM tr t""",
    "j13_weather_difference": chain() + """ SELECT wine_id, round(CASE WHEN new_vintage + 5 <= done THEN a.gdd END, 3) + 0.0 AS new_gdd, round(CASE
        WHEN new_vintage + 5 <= done THEN a.gdd - b.gdd END, 3) + 0.0 AS diff_gdd,
            CASE WHEN new_vintage + 5 <= done THEN a.heat_days END AS new_heat_days, CASE WHEN new_vintage + 5 <= done THEN a.heat_days - b.heat_days END AS diff_heat_days
        FROM (SELECT tr.*, year(date) - CASE WHEN month(date) >= CASE hemisphere WHEN 'S' THEN 5 ELSE 11 END THEN 0 ELSE 1 END AS done FROM tr LEFT
            JOIN regions r ON r.region = tr.region) t
        LEFT JOIN seasons a ON a.region = t.region AND a.vintage = new_vintage + 5 LEFT JOIN seasons b ON b.region = t.region AND b.vintage = prev_vintage + 6""",
}
