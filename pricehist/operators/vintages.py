"""Transitions between vintages of a family."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pricehist.operators.context import SUPPLY_LAG_MONTHS, latest_harvest
from pricehist.operators.panel import MOVE

MAX_CURRENT_AGE = 8
LOOKBACK_MONTHS = 24


def dated(series: DataFrame) -> DataFrame:
    """Listings of wines with a vintage year, with vint."""
    return series.withColumn("vint", F.expr("try_cast(vintage AS int)")).filter("vint IS NOT NULL")


def market_up_share(series: DataFrame) -> DataFrame:
    """Date and the share of dated wines whose price rose over the last four lists (those that dated wines are on).

    The previous list is the date before it on this grid; a wine that it lacks gives no pair."""
    x = dated(series).select("wine_id", "date", "price")
    grid = x.select("date").distinct().select("date", F.row_number().over(Window.orderBy("date")).alias("k"))
    x = x.join(F.broadcast(grid), "date")
    w = Window.partitionBy("wine_id").orderBy("k").rangeBetween(-1, -1)
    x = x.withColumn("before", F.first("price").over(w))
    day = x.groupBy("k", "date").agg(F.count("before").alias("pairs"), F.count_if(F.log(F.col("price") / F.col("before")) > MOVE).alias("rose"))
    last4 = Window.orderBy("k").rowsBetween(-3, 0)  # one row for each list
    return day.select("date", F.try_divide(F.sum("rose").over(last4), F.sum("pairs").over(last4)).alias("market_up_share_4q"))


def spans(series: DataFrame) -> DataFrame:
    """A10: one row per dated wine: its first non-null attributes, its last style and tier, and when it was listed."""
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("date"))).alias(c)
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("date"))).alias(c)
    return dated(series).groupBy("wine_id").agg(
        *[first(c) for c in ("family", "vint", "region", "brand", "grape", "classification")], last("style"), last("tier"), F.min("date").alias("first_seen"),
        F.max("date").alias("last_seen"), F.min_by("price", "date").alias("first_price"),
    )


def pairs(wines: DataFrame) -> DataFrame:
    """wine and prev_wine, consecutive vintages of a family (equal vintages in order of wine_id)."""
    w = Window.partitionBy("family").orderBy("vint", "wine_id")
    x = wines.withColumns({"prev_wine_id": F.lag("wine_id").over(w), "prev_vintage": F.lag("vint").over(w)}).filter("prev_wine_id IS NOT NULL")
    return x.withColumnsRenamed({"vint": "new_vintage", "first_seen": "date"})


def life(series: DataFrame, until: DataFrame, wine: str) -> DataFrame:
    """Until (with wine and date) joined to what was known of that wine on that date; without a listing, no row.

    Listed rows are compared with the listed row before them, across gaps. The history meets only the pairs' own wine, and the date condition
    is part of the join."""
    w = Window.partitionBy("wine_id").orderBy("at")
    h = series.select("wine_id", F.col("date").alias("at"), F.col("price").alias("p"), "promo_type").withColumn("move", F.abs(F.log("p") - F.log(F.lag("p").over(w))) > MOVE)
    h = h.withColumnRenamed("wine_id", wine)
    x = until.join(h, wine).filter("at <= date")
    keys = until.columns
    return x.groupBy(*keys).agg(
        F.max_by(F.struct("p", "promo_type"), "at").alias("l"), F.min_by("p", "at").alias("f"), F.count(F.lit(1)).alias("prev_life_quarters"),
        F.count_if("move").alias("prev_changes"),
    ).select(
        *keys, F.col("l.p").alias("prev_price"), F.log("l.p").alias("prev_log_price"), "prev_life_quarters", (F.log("l.p") - F.log("f")).alias("prev_life_change"), "prev_changes",
        F.coalesce(F.col("l.promo_type") == "sale", F.lit(False)).cast("double").alias("prev_on_sale"),
        F.coalesce(F.col("l.promo_type") == "clearance", F.lit(False)).cast("double").alias("prev_on_clearance"),
    )


def transitions(series: DataFrame, by_date: bool = False) -> DataFrame:
    """One row per vintage change with what was known then, and y, the log change of price.

    The family's history counts the earlier kept changes, those of the first list among them, which are left out at the end. It goes in vintage
    order; by_date takes only changes that had happened by then."""
    x = dated(series)
    new = pairs(spans(series))
    t = life(x, new.select("wine_id", "prev_wine_id", "family", "date", "new_vintage", "prev_vintage", "region", "brand", "grape", "classification",
        "style", "tier", "first_price"), "prev_wine_id")
    t = t.withColumn("y", F.log(F.col("first_price") / F.col("prev_price"))).withColumn("vintage_gap", F.col("new_vintage") - F.col("prev_vintage"))
    order = [F.col("date"), F.col("new_vintage"), F.col("wine_id")] if by_date else [F.col("new_vintage"), F.col("wine_id")]
    w = Window.partitionBy("family").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumns({"family_prev_transitions": F.count("y").over(w), "family_mean_change": F.avg("y").over(w)})
    first = x.agg(F.min("date").alias("first_list"))
    return t.join(F.broadcast(market_up_share(series)), "date", "left").join(F.broadcast(first), F.lit(True)).filter("date > first_list").drop("first_list", "first_price")


def brand_history(t: DataFrame, history: DataFrame) -> DataFrame:
    """T with the mean change and number of releases of the brand's other families in the 24 months before (the day itself excluded).

    Releases are first summed by (brand, family, date); sums over the brand less sums over the family then need no join of releases with releases.
    Rows of t that are no releases take part in the windows with weight 0."""
    h = history.filter("brand IS NOT NULL").groupBy("brand", "family", "date").agg(F.sum("y").alias("s"), F.count("y").alias("n"))
    asked = t.filter("brand IS NOT NULL").select("brand", "family", "date").distinct()
    x = h.unionByName(asked.select("*", F.lit(0.0).alias("s"), F.lit(0).cast("bigint").alias("n"))).groupBy("brand", "family",
        "date").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    month = "INTERVAL '24' MONTH"
    frame = f"RANGE BETWEEN {month} PRECEDING AND CURRENT ROW"
    same = "RANGE BETWEEN CURRENT ROW AND CURRENT ROW"
    part = lambda c, by: f"(sum({c}) OVER (PARTITION BY {by} ORDER BY date {frame}) - sum({c}) OVER (PARTITION BY {by} ORDER BY date {same}))"
    x = x.selectExpr("brand", "family", "date", f"{part('n', 'brand')} - {part('n', 'brand, family')} AS brand_recent_vintage_n",
        f"{part('s', 'brand')} - {part('s', 'brand, family')} AS s")
    x = x.selectExpr("brand", "family", "date", "brand_recent_vintage_n", "CASE WHEN brand_recent_vintage_n > 0 THEN s / brand_recent_vintage_n END AS brand_recent_vintage_change")
    return t.join(x, ["brand", "family", "date"], "left").withColumn("brand_recent_vintage_n", F.coalesce("brand_recent_vintage_n", F.lit(0)))


def weather_difference(t: DataFrame, weather: DataFrame, hemispheres: DataFrame, names: list[str]) -> DataFrame:
    """Weather of the new vintage (null before its season is over) and its difference from the one before."""
    x = t.join(F.broadcast(hemispheres.select("region", "hemisphere")), "region", "left").withColumn("done", latest_harvest(F.col("date"), F.col("hemisphere")))
    new = weather.select("region", F.col("vintage").alias("new_vintage"), *[F.col(n).alias(f"new_{n}") for n in names])
    old = weather.select("region", F.col("vintage").alias("prev_vintage"), *[F.col(n).alias(f"old_{n}") for n in names])
    x = x.join(new, ["region", "new_vintage"], "left").join(old, ["region", "prev_vintage"], "left")
    x = x.withColumns({f"new_{n}": F.when(F.col("new_vintage") <= F.col("done"), F.col(f"new_{n}")) for n in names})
    return x.withColumns({f"diff_{n}": F.col(f"new_{n}") - F.col(f"old_{n}") for n in names}).drop("done", *[f"old_{n}" for n in names])


def published_supply(t: DataFrame, supply: DataFrame) -> DataFrame:
    """Grape supply of the new vintage, once published."""
    s = supply.select("region", F.col("crop_year").alias("new_vintage"), F.col("tons_yoy").alias("new_tons_yoy"), F.col("price_yoy").alias("new_grape_price_yoy"))
    x = t.join(s, ["region", "new_vintage"], "left")
    known = F.col("new_vintage") <= F.year(F.add_months("date", -SUPPLY_LAG_MONTHS))
    return x.withColumns({c: F.when(known, F.col(c)) for c in ("new_tons_yoy", "new_grape_price_yoy")})


def family_history(t: DataFrame) -> DataFrame:
    """Family, number of transitions and their mean change."""
    return t.groupBy("family").agg(F.count("y").alias("family_prev_transitions"), F.avg("y").alias("family_mean_change"))


def next_vintages(series: DataFrame, t: DataFrame) -> DataFrame:
    """for each family the newest vintage on the latest list (not older than MAX_CURRENT_AGE years), as a change still to come: dated at the
    next list, with the wine's whole life, the family's and the market's history so far, and the brand's releases up to that date."""
    x = dated(series)
    lists = x.groupBy("date").count().agg(F.max("date").alias("last"), F.sort_array(F.collect_list("date"), False).alias("d"))  # one row for each list
    lists = lists.select("last", F.bround(F.datediff("last", F.coalesce(F.get("d", F.lit(1)), F.col("last"))) / 30.44).cast("int").alias("step"))
    cur = x.join(F.broadcast(lists), F.col("date") == F.col("last"))
    newest = cur.groupBy("family").agg(F.max_by(F.struct("wine_id", "vint", "region", "brand", "grape", "classification", "style", "tier", "last",
        "step"), F.struct("vint", "wine_id")).alias("c")).select("family", "c.*")
    newest = newest.filter(F.col("vint") >= F.year("last") - MAX_CURRENT_AGE)
    rows = life(x, newest.withColumnRenamed("last", "date"), "wine_id").withColumnsRenamed({"date": "last"})
    rows = rows.join(family_history(t), "family", "left").withColumn("family_prev_transitions", F.coalesce("family_prev_transitions", F.lit(0)))
    market = market_up_share(series).withColumnRenamed("date", "last")
    rows = rows.join(F.broadcast(market), "last", "left").withColumn("date", F.add_months("last", F.col("step")))
    out = rows.withColumns({"new_vintage": F.col("vint") + 1, "prev_vintage": F.col("vint"), "vintage_gap": F.lit(1)})
    return brand_history(out.drop("vint", "step"), t)
