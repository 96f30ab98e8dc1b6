"""Queries of the context tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from pricehist.operators import context as c
from pricehist.functions.shared import cut, written
from pricehist.operators import panel
from pricehist.sources import adapters as a
from pricehist.sources.adapters import r3, r6
from pricehist.plans.panel import DENSE

NORMAL = (1996, 1998)


def daily(spark, sf_dir):
    o, cu = a.table(spark, sf_dir, "orders"), a.table(spark, sf_dir, "customer")
    x = o.join(cu, o["o_custkey"] == cu["c_custkey"]).join(F.broadcast(a.regions(spark, sf_dir)), F.col("c_nationkey") == F.col("n_nationkey"))
    mean = F.avg(45 * F.col("o_totalprice") / 5e5 - 5)
    g = x.groupBy("region", "hemisphere", F.to_date("o_orderdate").alias("date")).agg(mean.alias("t_mean"), F.avg((F.col("o_custkey") % 50) / 10).alias("rain"))
    return g.withColumns({"t_max": F.col("t_mean") + 6, "t_min": F.col("t_mean") - 6})


def supply(spark, sf_dir):
    line, s = a.table(spark, sf_dir, "lineitem"), a.table(spark, sf_dir, "supplier")
    x = line.join(s, line["l_suppkey"] == s["s_suppkey"]).join(F.broadcast(a.regions(spark, sf_dir)), F.col("s_nationkey") == F.col("n_nationkey"))
    g = x.groupBy("region", F.year("l_shipdate").alias("crop_year")).agg(F.sum("l_quantity").alias("tons"), F.avg("l_extendedprice").alias("price_per_ton"))
    return c.year_on_year(g)


def _listings(spark, sf_dir):
    vint = F.expr("try_cast(vintage AS int)")
    return a.series(spark, sf_dir).select("wine_id", "t", "date", "region", "style", "tier", vint.alias("vintage_year"), (F.year("date") - vint).alias("vintage_age"))


def a5_season_features(spark, sf_dir):
    return c.season_features(daily(spark, sf_dir)).select("region", "vintage", *[r3(F.col(f)).alias(f) if f not in ("frost_days", "heat_days") else f for f in c.SEASON])


def a6_season_anomalies(spark, sf_dir):
    x = c.anomalies(c.season_features(daily(spark, sf_dir)), *NORMAL)
    return x.select("region", "vintage", *[r3(F.col(f"{f}_anom")).alias(f"{f}_anom") for f in c.SEASON])


def _crush(spark, sf_dir):
    """Two files a crop year from the supply view: districts are supplier keys mod 12, and some files lack a state total or disagree."""
    line = a.table(spark, sf_dir, "lineitem").withColumns({"crop_year": F.year("l_shipdate"), "district": (F.col("l_suppkey") % 12).cast("string")})
    files = F.explode(F.array(F.lit("a"), F.lit("b")))
    g = line.groupBy("crop_year", "district").agg(F.sum("l_quantity").alias("tons"), F.sum(F.floor("l_extendedprice")).cast("double").alias("price")).withColumn("f", files)
    x = g.select(
        F.concat_ws("__", F.col("crop_year"), F.col("f")).alias("file"), "crop_year", F.when(F.col("district") == "0", "state").otherwise(F.col("district")).alias("district"),
        (F.col("tons") + F.when(F.col("f") == "b", 1).otherwise(0)).alias("tons"), "price",
    )
    x = x.filter(~((F.col("district") == "state") & (F.col("crop_year") % 3 == 0)))
    wrong = F.when((F.substring("file", -1, 1) == "b") & (F.col("crop_year") % 2 == 0), F.col("crop_year") + 1).otherwise(F.col("crop_year"))
    tons = x.select("file", F.lit("tons").alias("kind"), "crop_year", "district", F.col("tons").alias("value"))
    return tons.unionByName(x.select("file", F.lit("price").alias("kind"), wrong.alias("crop_year"), "district", F.col("price").alias("value")))


def a7_latest_crush(spark, sf_dir):
    return c.latest_crush(_crush(spark, sf_dir))


def _districts(spark, sf_dir):
    r = a.regions(spark, sf_dir).filter("n_nationkey < 16")
    return r.select("region", F.when(F.col("n_nationkey") % 8 == 0, "state").otherwise((F.col("n_nationkey") % 12).cast("string")).alias("district"))


def j16_crush_by_region(spark, sf_dir):
    return c.by_region(c.latest_crush(_crush(spark, sf_dir)), _districts(spark, sf_dir))


def a8_brand_stats(spark, sf_dir):
    s = a.series(spark, sf_dir).select("wine_id", "t", "date", "price", "brand")
    x = c.brand_stats(s, s.select("t", "date").distinct())
    return x.select("t", "brand", "n_listed", r6(F.col("sum_logp")).alias("sum_logp"), "n_valid", "n_up", "n_down", "n_valid_4", "n_up_4", "n_down_4")


def j10_brand_momentum(spark, sf_dir):
    keep = ["wine_id", "t", "brand", "log_price", "own_valid", "own_up", "own_down", "own_valid_4", "own_up_4", "own_down_4"]
    x = written(panel.features(a.series(spark, sf_dir)).select(*keep), "origins")
    x = c.brand_features(x, cut(c.brand_counts(x)))
    return x.select("wine_id", "t", *[r6(F.col(k)).alias(k) for k in ("brand_n_others", "brand_up_1q", "brand_up_4q", "brand_down_4q", "brand_rel_price")])


def j8_weather(spark, sf_dir):
    w = c.season_features(daily(spark, sf_dir))
    late = _listings(spark, sf_dir).withColumn("vintage_year", F.col("vintage_year") + 5)
    x = c.weather_features(late, w, a.regions(spark, sf_dir), ["gdd", "heat_days"])
    return x.select("wine_id", "t", *[r3(F.col(k)).alias(k) for k in ("vint_gdd", "last_gdd")], "vint_heat_days", "last_heat_days")


def j9_supply(spark, sf_dir):
    late = _listings(spark, sf_dir).withColumn("vintage_year", F.col("vintage_year") + 5)
    x = c.supply_features(late, supply(spark, sf_dir))
    return x.select("wine_id", "t", *[r6(F.col(k)).alias(k) for k in ("vint_tons_yoy", "vint_grape_price_yoy", "last_tons_yoy", "last_grape_price_yoy")])


def f11_drinking_window(spark, sf_dir):
    return c.window_features(_listings(spark, sf_dir)).select("wine_id", "t", "years_to_window", "years_past_window", "in_window")


def f18_year_on_year(spark, sf_dir):
    return supply(spark, sf_dir).select("region", "crop_year", "tons", r6(F.col("tons_yoy")).alias("tons_yoy"), r6(F.col("price_yoy")).alias("price_yoy"))


#: Regions of the window table for nation keys, so that every group of it is met.
WINDOW_REGIONS = ["Bordeaux", "Burgundy", "Beaujolais", "Piedmont", "Rhone", "Tuscany", "Rioja", "Napa Valley", "Barossa", "Oregon", "Mosel", "Alsace", "Douro", "Loire"]


def p28_window(spark, sf_dir):
    w = a.wines(spark, sf_dir).withColumn("region", F.get(F.array(*[F.lit(r) for r in WINDOW_REGIONS]), (F.col("wine_id") % 16).cast("int")))
    x = w.withColumn("w", c.window(F.col("region"), F.col("style"), F.col("tier")))
    return x.select("wine_id", "region", F.col("w.opens").alias("opens"), F.col("w.closes").alias("closes"))


QUERIES = {f.__name__: f for f in (
    a5_season_features, a6_season_anomalies, a7_latest_crush, a8_brand_stats, f11_drinking_window, f18_year_on_year,
    j8_weather, j9_supply, j10_brand_momentum, j16_crush_by_region, p28_window,
)}


def _case(tiers: dict, k: int) -> str:
    return f"CASE tier WHEN 'luxury' THEN {tiers['luxury'][k]} WHEN 'premium' THEN {tiers['premium'][k]} ELSE {tiers['everyday'][k]} END"


def window_sql(k: int) -> str:
    """The window's start (0) or end (1), over region, style, tier."""
    red = " ".join(f"WHEN region IN ({', '.join(repr(n) for n in names)}) THEN {_case(c.RED_WINDOWS[g], k)}" for g, names in c.RED_GROUPS.items())
    aged = f"region IN ({', '.join(repr(n) for n in c.AGEWORTHY_WHITES)}) AND tier <> 'everyday'"
    return f"""CASE style WHEN 'red' THEN CASE {red} ELSE {_case(c.RED_WINDOWS['default'], k)} END
        WHEN 'white' THEN CASE WHEN {aged} THEN CASE tier WHEN 'luxury' THEN {(3, 15)[k]} ELSE {(2, 10)[k]} END WHEN tier = 'luxury' THEN {(1, 6)[k]} ELSE {(0, 3)[k]} END
        WHEN 'sparkling' THEN {_case(c.SPARKLING_WINDOWS, k)} WHEN 'dessert' THEN CASE WHEN region IN ('Bordeaux', 'Douro') THEN {(8, 40)[k]}
            ELSE {(2, 15)[k]} END ELSE {(0, 2)[k]} END"""


CONTEXT = DENSE + """, daily AS (
    SELECT region, hemisphere, CAST(o_orderdate AS DATE) AS date, avg(45 * o_totalprice / 5e5 - 5) AS t_mean, avg((o_custkey % 50) / 10) AS rain
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN regions ON c_nationkey = n_nationkey GROUP BY ALL
), years AS (
    SELECT region, hemisphere, unnest(range(CAST(year(min(date)) + CASE hemisphere WHEN 'S' THEN 1
        ELSE 0 END AS BIGINT), CAST(year(max(date)) + 1 AS BIGINT))) AS vintage, max(date) AS last FROM daily GROUP BY region, hemisphere
), spans AS (
    SELECT *, CASE hemisphere WHEN 'S' THEN make_date(vintage - 1, 10, 1) ELSE make_date(vintage, 4, 1) END AS a, CASE hemisphere
        WHEN 'S' THEN make_date(vintage, 4, 30) ELSE make_date(vintage, 10, 31) END AS b,
        CASE hemisphere WHEN 'S' THEN make_date(vintage - 1, 11, 15) ELSE make_date(vintage, 5, 15) END AS frost, CASE hemisphere
            WHEN 'S' THEN make_date(vintage, 3, 1) ELSE make_date(vintage, 9, 1) END AS harvest FROM years
), seasons AS (
    SELECT s.region, CAST(vintage AS INTEGER) AS vintage, sum(greatest(t_mean - 10, 0)) AS gdd, avg(t_mean) AS gs_tmean, sum(rain) AS gs_rain,
        coalesce(sum(rain) FILTER (date >= harvest), 0) AS harvest_rain,
        count(*) FILTER (date <= frost AND t_mean - 6 < 0) AS frost_days, count(*) FILTER (t_mean + 6 > 35) AS heat_days
    FROM spans s JOIN daily d ON d.region = s.region AND d.date BETWEEN a AND b WHERE last >= b GROUP BY s.region, vintage
), supply AS (
    SELECT region, CAST(crop_year AS INTEGER) AS crop_year, tons, price_per_ton, ln(tons / lag(tons) OVER w) AS tons_yoy, ln(price_per_ton / lag(price_per_ton) OVER w) AS price_yoy
    FROM (SELECT region, year(l_shipdate) AS crop_year, sum(l_quantity) AS tons, avg(l_extendedprice) AS price_per_ton FROM lineitem
        JOIN supplier ON l_suppkey = s_suppkey JOIN regions ON s_nationkey = n_nationkey GROUP BY ALL)
    WINDOW w AS (PARTITION BY region ORDER BY crop_year)
), listings AS (
    SELECT wine_id, t, date, s.region, hemisphere, style, tier, TRY_CAST(vintage AS INTEGER) AS vintage_year,
        year(date) - TRY_CAST(vintage AS INTEGER) AS vintage_age FROM series s LEFT JOIN regions r ON r.region = s.region
), brands AS (
    SELECT p.t, b.brand, coalesce(n_listed, 0) AS n_listed, coalesce(sum_logp, 0) AS sum_logp, coalesce(n_valid, 0) AS n_valid, coalesce(n_up,
        0) AS n_up, coalesce(n_down, 0) AS n_down
    FROM periods p CROSS JOIN (SELECT DISTINCT brand FROM series) b LEFT JOIN (
        SELECT t, brand, CAST(count(logp) AS DOUBLE) AS n_listed, sum(logp) AS sum_logp, sum(valid) AS n_valid, sum(up) AS n_up, sum(down) AS n_down
            FROM m JOIN wines USING (wine_id) GROUP BY t, brand
    ) g ON g.t = p.t AND g.brand = b.brand
), stats AS (
    SELECT *, sum(n_valid) OVER w AS n_valid_4, sum(n_up) OVER w AS n_up_4, sum(n_down) OVER w AS n_down_4 FROM brands WINDOW w AS (PARTITION BY brand ORDER BY t ROWS 3 PRECEDING)
), crush0 AS (
    SELECT year(l_shipdate) AS crop_year, CAST(l_suppkey % 12 AS VARCHAR) AS district, sum(l_quantity) AS tons,
        CAST(sum(floor(l_extendedprice)) AS DOUBLE) AS price FROM lineitem GROUP BY ALL
), crush AS (
    -- the second file of an even year names another crop in its prices, so the first one counts
    SELECT CAST(crop_year AS INTEGER) AS crop_year, CASE district WHEN '0' THEN 'state' ELSE district END AS district, tons + CASE
        WHEN crop_year % 2 = 0 THEN 0 ELSE 1 END AS tons, price AS price_per_ton FROM crush0 WHERE district <> '0' OR crop_year % 3 <> 0
), crush2 AS (
    SELECT * FROM crush UNION ALL SELECT crop_year, 'state', sum(tons), NULL FROM crush GROUP BY crop_year HAVING count(*) FILTER (district = 'state') = 0
)"""
_r = lambda e, n: f"round({e}, 6) + 0.0 AS {n}"
_r3 = lambda e, n: f"round({e}, 3) + 0.0 AS {n}"
_own = lambda k: f"CASE WHEN s.n_valid{k} - m.v{k} > 0 THEN (s.%s{k} - m.%s{k}) / (s.n_valid{k} - m.v{k}) END"
SQL = {
    "a5_season_features": CONTEXT + " SELECT region, vintage, " + ", ".join(_r3(f, f) for f in c.SEASON[:4]) + ", frost_days, heat_days FROM seasons",
    "a6_season_anomalies": CONTEXT + " SELECT region, vintage, " + ", ".join(_r3(f"""{f} - (SELECT avg(n.{f}) FROM seasons n
        WHERE n.region = s.region AND n.vintage BETWEEN 1996 AND 1998)""", f"{f}_anom") for f in c.SEASON) + " FROM seasons s",
    "a7_latest_crush": CONTEXT + " SELECT * FROM crush2",
    "j16_crush_by_region": CONTEXT + """ SELECT region, y.crop_year, r.district, tons, price_per_ton FROM (SELECT DISTINCT crop_year FROM crush2) y
        CROSS JOIN (SELECT region, CASE WHEN n_nationkey % 8 = 0 THEN 'state' ELSE CAST(n_nationkey % 12 AS VARCHAR) END AS district FROM regions WHERE n_nationkey < 16) r
        LEFT JOIN crush2 k ON k.crop_year = y.crop_year AND k.district = r.district""",
    "a8_brand_stats": CONTEXT + " SELECT t, brand, n_listed, round(sum_logp, 6) + 0.0 AS sum_logp, n_valid, n_up, n_down, n_valid_4, n_up_4, n_down_4 FROM stats",
    "f11_drinking_window": CONTEXT + f""" SELECT wine_id, t, CAST(a - vintage_age AS INTEGER) AS years_to_window,
        CAST(vintage_age - b AS INTEGER) AS years_past_window, CAST(vintage_age BETWEEN a AND b AS DOUBLE) AS in_window
        FROM (SELECT *, {window_sql(0)} AS a, {window_sql(1)} AS b FROM listings)""",
    "f18_year_on_year": CONTEXT + " SELECT region, crop_year, tons, round(tons_yoy, 6) + 0.0 AS tons_yoy, round(price_yoy, 6) + 0.0 AS price_yoy FROM supply",
    "j8_weather": CONTEXT + """, l AS (SELECT *, vintage_year + 5 AS v, year(date) - CASE WHEN month(date) >= CASE hemisphere WHEN 'S' THEN 5
        ELSE 11 END THEN 0 ELSE 1 END AS lv FROM listings)
        SELECT wine_id, t, round(CASE WHEN v <= lv THEN a.gdd END, 3) + 0.0 AS vint_gdd, round(b.gdd, 3) + 0.0 AS last_gdd, CASE
            WHEN v <= lv THEN a.heat_days END AS vint_heat_days, b.heat_days AS last_heat_days
        FROM l LEFT JOIN seasons a ON a.region = l.region AND a.vintage = v LEFT JOIN seasons b ON b.region = l.region AND b.vintage = lv""",
    "j9_supply": CONTEXT + """, l AS (SELECT *, vintage_year + 5 AS v, year(date - INTERVAL 16 MONTH) AS pub FROM listings)
        SELECT wine_id, t, round(CASE WHEN v <= pub THEN a.tons_yoy END, 6) + 0.0 AS vint_tons_yoy, round(CASE WHEN v <= pub THEN a.price_yoy END, 6) + 0.0 AS vint_grape_price_yoy,
            round(b.tons_yoy, 6) + 0.0 AS last_tons_yoy, round(b.price_yoy, 6) + 0.0 AS last_grape_price_yoy
        FROM l LEFT JOIN supply a ON a.region = l.region AND a.crop_year = v LEFT JOIN supply b ON b.region = l.region AND b.crop_year = pub""",
    "j10_brand_momentum": CONTEXT + """, o AS (SELECT m.*, brand, valid AS v, up AS n_up, down AS n_down, sum(valid) OVER r AS v_4,
        sum(up) OVER r AS n_up_4, sum(down) OVER r AS n_down_4
            FROM m JOIN wines USING (wine_id) WINDOW r AS (PARTITION BY wine_id ORDER BY t ROWS 3 PRECEDING))
        SELECT wine_id, m.t, s.n_listed - 1 AS brand_n_others, """ + ", ".join(
        _r(_own(k) % (n, n), name) for k, n, name in (("", "n_up", "brand_up_1q"), ("_4", "n_up", "brand_up_4q"), ("_4", "n_down", "brand_down_4q"))
    ) + """, round(CASE WHEN s.n_listed > 1 THEN logp - (s.sum_logp - logp) / (s.n_listed - 1) END, 6) + 0.0 AS brand_rel_price
        FROM o m LEFT JOIN stats s ON s.t = m.t AND s.brand = m.brand WHERE listed""",
    "p28_window": CONTEXT + f""" SELECT wine_id, region, {window_sql(0)} AS opens, {window_sql(1)} AS closes
        FROM (SELECT * REPLACE (({WINDOW_REGIONS!r})[wine_id % 16 + 1] AS region) FROM wines)""",
}
