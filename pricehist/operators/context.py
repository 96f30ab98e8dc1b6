"""Point-in-time context of listings: brand momentum, weather, supply and drinking windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pricehist.operators.panel import MOVE, diffs, whole

#: Crop year Y is published by the end of April of Y + 1, so it can be used from May on.
SUPPLY_LAG_MONTHS = 16
SEASON = ("gdd", "gs_tmean", "gs_rain", "harvest_rain", "frost_days", "heat_days")

# Drinking windows in years after the vintage by kind and tier (fixed values).
RED_WINDOWS = {
    "bordeaux": {"luxury": (10, 35), "premium": (5, 15), "everyday": (1, 6)},
    "burgundy": {"luxury": (8, 25), "premium": (4, 12), "everyday": (1, 5)},
    "piedmont": {"luxury": (8, 25), "premium": (5, 15), "everyday": (1, 5)},
    "rhone": {"luxury": (6, 20), "premium": (3, 10), "everyday": (1, 4)},
    "tuscany": {"luxury": (6, 20), "premium": (4, 12), "everyday": (1, 5)},
    "iberia": {"luxury": (6, 20), "premium": (3, 12), "everyday": (1, 5)},
    "new_world_cab": {"luxury": (6, 20), "premium": (3, 12), "everyday": (1, 4)},
    "australia": {"luxury": (8, 25), "premium": (3, 12), "everyday": (1, 4)},
    "cool_pinot": {"luxury": (5, 15), "premium": (3, 10), "everyday": (1, 4)},
    "default": {"luxury": (5, 15), "premium": (2, 8), "everyday": (0, 4)},
}
RED_GROUPS = {
    "bordeaux": ["Bordeaux"],
    "burgundy": ["Burgundy"],
    "cool_pinot": ["Beaujolais", "Oregon", "Santa Barbara", "Marlborough"],
    "piedmont": ["Piedmont"],
    "rhone": ["Rhone"],
    "tuscany": ["Tuscany"],
    "iberia": ["Rioja", "Ribera del Duero", "Priorat", "Douro", "Rueda / Toro"],
    "new_world_cab": ["Napa Valley", "Sonoma", "Washington", "Paso Robles"],
    "australia": ["Barossa", "McLaren Vale", "South Australia"],
}
AGEWORTHY_WHITES = ["Burgundy", "Mosel", "Rheingau", "Rheinhessen / Pfalz", "Alsace", "Loire"]
SPARKLING_WINDOWS = {"luxury": (5, 20), "premium": (3, 12), "everyday": (1, 4)}


def window(region: Column, style: Column, tier: Column) -> Column:
    """struct(opens, closes), years after the vintage, as one expression over the fixed tables."""

    def pair(p: tuple[int, int]) -> Column:
        return F.struct(F.lit(p[0]).alias("opens"), F.lit(p[1]).alias("closes"))

    def by_tier(t: dict) -> Column:
        return F.when(tier == "luxury", pair(t["luxury"])).when(tier == "premium", pair(t["premium"])).otherwise(pair(t["everyday"]))

    red = by_tier(RED_WINDOWS["default"])
    for group, names in RED_GROUPS.items():
        red = F.when(region.isin(names), by_tier(RED_WINDOWS[group])).otherwise(red)
    aged = F.coalesce(region.isin(AGEWORTHY_WHITES), F.lit(False)) & (tier != "everyday")
    white = F.when(aged & (tier == "luxury"), pair((3, 15))).when(aged, pair((2, 10))).when(tier == "luxury", pair((1, 6))).otherwise(pair((0, 3)))
    dessert = F.when(region.isin("Bordeaux", "Douro"), pair((8, 40))).otherwise(pair((2, 15)))
    return F.when(style == "red", red).when(style == "white", white).when(style == "sparkling", by_tier(SPARKLING_WINDOWS)).when(style == "dessert",
        dessert).otherwise(pair((0, 2)))


def window_features(rows: DataFrame) -> DataFrame:
    """years to and past the drinking window, and whether the wine is in it (null without a vintage)."""
    x = rows.withColumn("_w", window(F.col("region"), F.col("style"), F.col("tier")))
    age = F.col("vintage_age")
    inside = F.when(age.isNotNull(), ((age >= F.col("_w.opens")) & (age <= F.col("_w.closes"))).cast("double"))
    return x.withColumns({"years_to_window": F.col("_w.opens") - age, "years_past_window": age - F.col("_w.closes"), "in_window": inside}).drop("_w")


COUNTS = ("n_listed", "sum_logp", "n_valid", "n_up", "n_down")


def brand_counts(origins: DataFrame) -> DataFrame:
    """A8 where it is not zero: by (t, brand) the wines listed, the sum of their log prices, and how many changed since the previous list and over the
    last four. A brand has a row for each list that it is on: no grid of brands by lists is laid out, as the last four lists are a RANGE frame.

    origins: t, brand, log_price and own_valid, own_up, own_down (panel.features)."""
    counts = origins.filter(F.col("brand").isNotNull()).groupBy("t", "brand").agg(
        F.count(F.lit(1)).cast("double").alias("n_listed"), F.sum("log_price").alias("sum_logp"), *[F.sum(f"own_{k}").alias(f"n_{k}") for k in ("valid", "up", "down")])
    return counts.withColumns(_last_four())


def _last_four() -> dict[str, Column]:
    last4 = Window.partitionBy("brand").orderBy("t").rangeBetween(-3, 0)
    return {f"{k}_4": F.sum(k).over(last4) for k in ("n_valid", "n_up", "n_down")}


def brand_stats(series: DataFrame, periods: DataFrame) -> DataFrame:
    """As brand_counts, with a row of every brand for every list, since that is what is asked for. series: wine_id, t, date, price, brand.

    Changes come from the series' own window, so the wide matrix of lists by wines never exists."""
    x = diffs(series).withColumn("brand", F.first("brand", ignorenulls=True).over(whole()))
    x = x.filter(F.col("brand").isNotNull())
    counts = x.groupBy("t", "brand").agg(
        F.count(F.lit(1)).cast("double").alias("n_listed"), F.sum("log_price").alias("sum_logp"), F.count("diff").cast("double").alias("n_valid"),
        F.count_if(F.col("diff") > MOVE).cast("double").alias("n_up"), F.count_if(F.col("diff") < -MOVE).cast("double").alias("n_down"),
    )
    # The lists without a brand come from its one row, which carries all list numbers (a few hundred at most), and are filled up with zeros.
    lists = periods.agg(F.collect_set("t").alias("all"))
    seen = counts.groupBy("brand").agg(F.collect_set("t").alias("seen")).join(F.broadcast(lists), F.lit(True))
    absent = seen.select(F.explode(F.array_except("all", "seen")).alias("t"), "brand", *[F.lit(0.0).alias(k) for k in COUNTS])
    return counts.unionByName(absent).withColumns(_last_four()).join(F.broadcast(periods.select("t", "date")), "t")


def ratio(num: Column, den: Column) -> Column:
    return F.when(den > 0, num / den)


def brand_features(origins: DataFrame, stats: DataFrame) -> DataFrame:
    """The producer's other wines: statistics of (date, brand) without the wine's own part. Counts are tested for zero, never sums."""
    own = lambda k: F.col(k) - F.col(f"own_{k[2:]}")
    x = origins.join(stats.drop("date"), ["t", "brand"], "left")
    others = F.col("n_listed") - 1
    cols = {
        "brand_n_others": others,
        "brand_up_1q": ratio(own("n_up"), own("n_valid")),
        "brand_up_4q": ratio(own("n_up_4"), own("n_valid_4")),
        "brand_down_4q": ratio(own("n_down_4"), own("n_valid_4")),
        "brand_rel_price": F.col("log_price") - ratio(F.col("sum_logp") - F.col("log_price"), others),
    }
    return x.withColumns(cols).drop("n_listed", "sum_logp", "n_valid", "n_up", "n_down", "n_valid_4", "n_up_4", "n_down_4")


def latest_harvest(date: Column, hemisphere: Column) -> Column:
    """The last vintage whose season is over: in the south from May, else from November (unknown: as in the north)."""
    return F.year(date) - F.when(F.month(date) >= F.when(hemisphere == "S", 5).otherwise(11), 0).otherwise(1)


def season_features(daily: DataFrame) -> DataFrame:
    """A5: region, vintage and season features in one pass. daily: region, hemisphere, date, t_max, t_min, t_mean, rain.

    A southern season starts in October of the year before. Seasons that the data do not reach the end of have no row."""
    m, md, south = F.month("date"), F.month("date") * 100 + F.dayofmonth("date"), F.col("hemisphere") == "S"
    season = F.when(south, (m >= 10) | (m <= 4)).otherwise((m >= 4) & (m <= 10))
    vintage = F.when(south & (m >= 10), F.year("date") + 1).otherwise(F.year("date"))
    frost = F.when(south, (md >= 1001) & (md <= 1115)).otherwise((md >= 401) & (md <= 515))
    harvest = F.when(south, (m >= 3) & (m <= 4)).otherwise((m >= 9) & (m <= 10))
    last = daily.groupBy("region").agg(F.max("date").alias("last"), F.min("date").alias("first"))
    x = daily.filter(season).withColumn("vintage", vintage)
    agg = x.groupBy("region", "hemisphere", "vintage").agg(
        F.coalesce(F.sum(F.greatest(F.col("t_mean") - 10, F.lit(0.0))), F.lit(0.0)).alias("gdd"), F.avg("t_mean").alias("gs_tmean"),
        F.coalesce(F.sum("rain"), F.lit(0.0)).alias("gs_rain"), F.coalesce(F.sum(F.when(harvest, F.col("rain"))), F.lit(0.0)).alias("harvest_rain"),
        F.count_if(frost & (F.col("t_min") < 0)).alias("frost_days"), F.count_if(F.col("t_max") > 35).alias("heat_days"),
    )
    end = F.when(F.col("hemisphere") == "S", F.make_date("vintage", F.lit(4), F.lit(30))).otherwise(F.make_date("vintage", F.lit(10), F.lit(31)))
    first = F.year("first") + F.when(F.col("hemisphere") == "S", 1).otherwise(0)
    return agg.join(F.broadcast(last), "region").filter((F.col("last") >= end) & (F.col("vintage") >= first)).drop("last", "first", "hemisphere")


def anomalies(seasons: DataFrame, first: int, last: int) -> DataFrame:
    """Each feature less its region's mean over the normal years."""
    w = Window.partitionBy("region")
    return seasons.withColumns({f"{f}_anom": F.col(f) - F.avg(F.when(F.col("vintage").between(first, last), F.col(f))).over(w) for f in SEASON})


def weather_features(rows: DataFrame, weather: DataFrame, hemispheres: DataFrame, names: list[str]) -> DataFrame:
    """Weather of the wine's own vintage (null before its season is over) and of the latest harvest. rows: region, date, vintage_year."""
    x = rows.join(F.broadcast(hemispheres.select("region", "hemisphere")), "region", "left")
    x = x.withColumn("last_vint", latest_harvest(F.col("date"), F.col("hemisphere")))
    own = weather.select("region", F.col("vintage").alias("vintage_year"), *[F.col(n).alias(f"vint_{n}") for n in names])
    late = weather.select("region", F.col("vintage").alias("last_vint"), *[F.col(n).alias(f"last_{n}") for n in names])
    x = x.join(own, ["region", "vintage_year"], "left").join(late, ["region", "last_vint"], "left")
    return x.withColumns({f"vint_{n}": F.when(F.col("vintage_year") <= F.col("last_vint"), F.col(f"vint_{n}")) for n in names})


def supply_features(rows: DataFrame, supply: DataFrame) -> DataFrame:
    """Grape supply of the own vintage (null before it is published) and of the latest published crop."""
    x = rows.withColumn("published", F.year(F.add_months("date", -SUPPLY_LAG_MONTHS)))
    own = supply.select("region", F.col("crop_year").alias("vintage_year"), F.col("tons_yoy").alias("vint_tons_yoy"), F.col("price_yoy").alias("vint_grape_price_yoy"))
    late = supply.select("region", F.col("crop_year").alias("published"), F.col("tons_yoy").alias("last_tons_yoy"), F.col("price_yoy").alias("last_grape_price_yoy"))
    x = x.join(own, ["region", "vintage_year"], "left").join(late, ["region", "published"], "left")
    return x.withColumns({c: F.when(F.col("vintage_year") <= F.col("published"), F.col(c)) for c in ("vint_tons_yoy", "vint_grape_price_yoy")})


def year_on_year(supply: DataFrame) -> DataFrame:
    """log ratios to the previous row of the region (a missing year gives a ratio over several years)."""
    w = Window.partitionBy("region").orderBy("crop_year")
    return supply.withColumns({"tons_yoy": F.log(F.col("tons") / F.lag("tons").over(w)), "price_yoy": F.log(F.col("price_per_ton") / F.lag("price_per_ton").over(w))})


def latest_crush(tables: DataFrame) -> DataFrame:
    """crop_year, district, tons, price_per_ton from the last file of each crop year.

    tables: file, kind ('tons' or 'price'), crop_year, district, value. Files whose two tables name different crop years, or that lack one,
    are left out; a missing state total of tons is the sum of the districts."""
    file = tables.groupBy("file").agg(F.max(F.when(F.col("kind") == "tons", F.col("crop_year"))).alias("crop_year"),
        F.max(F.when(F.col("kind") == "price", F.col("crop_year"))).alias("other"))
    latest = file.filter("crop_year = other").groupBy("crop_year").agg(F.max("file").alias("file"))
    x = tables.join(F.broadcast(latest), ["file", "crop_year"])
    wide = x.groupBy("crop_year", "district").agg(F.max(F.when(F.col("kind") == "tons", F.col("value"))).alias("tons"),
        F.max(F.when(F.col("kind") == "price", F.col("value"))).alias("price_per_ton"))
    total = wide.groupBy("crop_year").agg(F.sum(F.when(F.col("district") != "state", F.col("tons"))).alias("t"),
        F.max(F.when(F.col("district") == "state", F.col("tons"))).alias("s"),
        F.max(F.when(F.col("district") == "state", F.col("price_per_ton"))).alias("p"))
    state = total.select("crop_year", F.lit("state").alias("district"), F.coalesce("s", "t").alias("tons"), F.col("p").alias("price_per_ton"))
    return wide.filter("district <> 'state'").unionByName(state)


def by_region(crush: DataFrame, districts: DataFrame) -> DataFrame:
    """Districts to regions (one district may feed several). districts: region, district."""
    years = crush.select("crop_year").distinct()
    keys = years.join(F.broadcast(districts), F.lit(True))
    return keys.join(crush, ["crop_year", "district"], "left").select("region", "crop_year", "district", "tons", "price_per_ton")
