"""Catalog marts and lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pricehist.functions.numbers import rounded
from pricehist.operators.context import window


def latest(obs: DataFrame, *columns: str) -> DataFrame:
    """Each wine's newest listing, its first date and count; wines without one have no row. One pass by wine, no correlated lookups."""
    return obs.groupBy("wine_id").agg(F.max_by(F.struct("date", *columns), "date").alias("cur"), F.min("date").alias("first_date"),
        F.count(F.lit(1)).alias("quarters")).select("wine_id", "cur.*", "first_date", "quarters")


def price_ago(obs: DataFrame, cur: DataFrame, years: tuple[int, ...] = (1, 5), slack: int = 7) -> DataFrame:
    """wine_id and change_<n>y_pct, the newest price over the one nearest to n years before it, within `slack` days (ties: the earlier).

    All horizons share one join by wine, which follows the partitioning that cur has already."""
    x = obs.select("wine_id", F.col("date").alias("then"), F.col("price").alias("was")).join(cur.select("wine_id", "date", "price"), "wine_id")
    out = []
    for n in years:
        goal = F.add_months("date", -12 * n)
        off = F.abs(F.datediff("then", goal))
        was = F.min_by("was", F.when(off <= slack, F.struct(off, F.col("then"))))
        out.append(rounded(100 * (F.first("price") / F.nullif(was, F.lit(0.0)) - 1), 1).alias(f"change_{n}y_pct"))
    return x.groupBy("wine_id").agg(*out)


def active(rows: DataFrame, runs: DataFrame) -> DataFrame:
    """Rows of the active model version (one row: broadcast)."""
    return rows.join(F.broadcast(runs.filter("is_active").select("model_version").limit(1)), "model_version")


def year_ahead(forecasts: DataFrame, runs: DataFrame) -> DataFrame:
    """each wine's forecast for the latest date."""
    x = active(forecasts, runs).groupBy("wine_id").agg(F.max_by(F.struct("p_up", "p_down", "up_pct", "down_pct"), "target_date").alias("f"))
    return x.select("wine_id", F.col("f.p_up").alias("p_up_1y"), F.col("f.p_down").alias("p_down_1y"), "f.up_pct", "f.down_pct")


def selected(wines: DataFrame, style=None, tier=None, q=None, featured=False, listed=False, slug=None, family=None, investor=False) -> DataFrame:
    """Filters; None filters nothing. q is an ILIKE fragment with live wildcards."""
    keep = F.lit(True)
    for c, v in (("style", style), ("tier", tier), ("slug", slug), ("family", family)):
        keep = keep & (F.col(c) == v) if v is not None else keep
    keep = keep & F.col("name").ilike(f"%{q}%") if q is not None else keep
    keep = keep & F.col("is_featured") if featured else keep
    keep = keep & F.col("is_active") if listed else keep
    keep = keep & (F.col("vintage") != "NV") & F.col("tier").isin("premium", "luxury") if investor else keep
    return wines.filter(keep)


def catalog(wines: DataFrame, obs: DataFrame, forecasts: DataFrame, fair: DataFrame, runs: DataFrame) -> DataFrame:
    """One row per wine with a listing: newest price, changes over one and five years, year-ahead forecast and fair price."""
    cur = latest(obs, "price", "promo_price", "promo_type")
    fair = active(fair, runs).select("wine_id", F.col("fair_p50").alias("fair_price"), F.col("fair_p10").alias("fair_low"), F.col("fair_p90").alias("fair_high"), "value_pct")
    x = wines.join(cur, "wine_id").join(price_ago(obs, cur), "wine_id", "left").join(year_ahead(forecasts, runs), "wine_id", "left").join(fair, "wine_id", "left")
    return x.withColumnRenamed("date", "latest_date")


#: O1: sort keys with their columns and default directions.
SORTS = {
    "name": ("name", "asc"), "price": ("shelf", "desc"), "change_1y": ("change_1y_pct", "desc"), "change_5y": ("change_5y_pct", "desc"), "fair": ("value_pct", "desc"),
    "likely_up": ("p_up_1y", "desc"), "likely_down": ("p_down_1y", "desc"), "value": ("value_pct", "asc"),
}


def page(rows: DataFrame, sort: str = "name", direction: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """O1, O2: one page; nulls last both ways, ties by name and slug. `value` puts prices below their fair range first (unknown ranges after
    them). The limit (at most 200) keeps this a top-k, not a full sort."""
    column, default = SORTS[sort]
    x = rows.withColumn("shelf", F.coalesce("promo_price", "price"))
    key = F.col(column).desc_nulls_last() if (direction or default) == "desc" else F.col(column).asc_nulls_last()
    first = [F.coalesce(F.col("price") < F.col("fair_low"), F.lit(False)).desc()] if sort == "value" else []
    return x.orderBy(*first, key, F.col("name").asc(), F.col("slug").asc()).offset(offset).limit(min(limit, 200))


#: Views as filters and sort.
VIEWS = {
    "featured": ({"featured": True, "listed": True}, "name"), "rising": ({"listed": True}, "likely_up"), "investor": ({"investor": True, "listed": True}, "likely_up"),
    "value": ({"listed": True}, "value"), "all": ({}, "name"),
}


def vintages(wines: DataFrame, family: str) -> DataFrame:
    """O3: a family's vintages, newest first, NV last."""
    return wines.filter(F.col("family") == family).orderBy(F.col("vintage") == "NV", F.desc("vintage"))


def featured(wines: DataFrame, rules: DataFrame) -> DataFrame:
    """For each rule (item, match, exclude) the best 750 ML wine whose name has all terms of match and none of exclude: listed today, newest
    vintage, most quarters, then the smallest slug. Rules are few, so they are broadcast and only the best match of each is kept."""
    hit = F.expr("forall(match, m -> contains(lower(name), lower(m))) AND NOT exists(coalesce(exclude, array()), e -> contains(lower(name), lower(e)))")
    x = wines.filter("size = '750 ML'").join(F.broadcast(rules), hit)
    rank = F.struct(F.col("is_active").cast("int"), F.coalesce(F.expr("try_cast(vintage AS int)"), F.lit(0)), F.col("quarters"))
    tied = x.groupBy("item", rank.alias("rank")).agg(F.min("slug").alias("slug"))
    return tied.groupBy("item").agg(F.max_by("slug", "rank").alias("slug"))


def window_status(wines: DataFrame, year: int) -> DataFrame:
    """When the window of a dated wine opens and closes, and where `year` is."""
    w = wines.filter("vintage <> 'NV'").withColumn("w", window(F.col("region"), F.col("style"), F.col("tier"))).withColumn("v", F.col("vintage").cast("int"))
    x = w.select("wine_id", (F.col("v") + F.col("w.opens")).alias("opens"), (F.col("v") + F.col("w.closes")).alias("closes"))
    return x.withColumn("status", F.when(F.lit(year) < F.col("opens"), "before").when(F.lit(year) > F.col("closes"), "past").otherwise("in"))


def stickiness(obs: DataFrame) -> DataFrame:
    """A4: changes between consecutive listings (gaps are bridged) and sales of each wine."""
    w = Window.partitionBy("wine_id").orderBy("date")
    x = obs.withColumn("before", F.lag("price").over(w))
    return x.groupBy("wine_id").agg(F.count_if(F.col("before").isNotNull() & (F.col("price") != F.col("before"))).alias("changes"),
        F.count_if(F.col("promo_type") == "sale").alias("sales"))


def chart(obs: DataFrame, forecasts: DataFrame, years: int | None) -> DataFrame:
    """U4: wine_id, date, kind, price, low, high: the history of the last years (7 days' slack) and the forecast, which starts at the last price."""
    last = obs.groupBy("wine_id").agg(F.max("date").alias("last"), F.max_by("price", "date").alias("price"))
    past = obs.select("wine_id", "date", "price").join(last.select("wine_id", "last"), "wine_id")
    past = past.filter(F.col("date") >= F.date_sub(F.add_months("last", -12 * years), 7)) if years else past
    anchor = last.select("wine_id", F.col("last").alias("date"), F.lit("forecast").alias("kind"), "price", F.col("price").alias("low"), F.col("price").alias("high"))
    ahead = forecasts.select("wine_id", F.col("target_date").alias("date"), F.lit("forecast").alias("kind"), F.col("p50").alias("price"),
        F.col("p10").alias("low"), F.col("p90").alias("high"))
    return past.select("wine_id", "date", F.lit("history").alias("kind"), "price").unionByName(anchor, allowMissingColumns=True).unionByName(ahead, allowMissingColumns=True)


def parity(a: DataFrame, b: DataFrame, keys: tuple[str, ...], price: float = 0.011, share: float = 1e-4) -> DataFrame:
    """Rows of both and how many differ, by kind of difference."""
    x = a.select(*keys, F.struct("p10", "p50", "p90", "p_up", "p_down").alias("x")).join(b.select(*keys,
        F.struct("p10", "p50", "p90", "p_up", "p_down").alias("y")), list(keys), "full")
    off = lambda c, most: F.coalesce(F.abs(F.col(f"x.{c}") - F.col(f"y.{c}")) > most, F.lit(False))
    far = off("p10", price) | off("p50", price) | off("p90", price)
    return x.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("x").isNull() | F.col("y").isNull()).alias("missing"),
        F.count_if(far).alias("price_off"), F.count_if(off("p_up", share) | off("p_down", share)).alias("share_off"))


def dimension(rows: DataFrame) -> DataFrame:
    """A2: a wine from its group's listings (grp, date, code, name, price): attributes of the last one, all codes, and whether it is on the newest list."""
    newest = rows.agg(F.max("date").alias("newest"))
    g = rows.groupBy("grp").agg(F.max(F.struct("date", "code", "name", "price")).alias("last"), F.array_sort(F.collect_set("code")).alias("codes"))
    return g.join(F.broadcast(newest), F.lit(True)).select("grp", "last.name", "last.price", "codes", (F.col("last.date") == F.col("newest")).alias("is_active"))


def quality(wines: DataFrame, obs: DataFrame, runs: DataFrame, forecasts: DataFrame) -> DataFrame:
    """Rule, violations of the declared constraints."""
    one = lambda rule, df: df.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(rule).alias("rule"), "violations")
    twice = lambda df, *k: df.groupBy(*k).count().filter("count > 1")
    rules = [
        one("price over 0", obs.filter("NOT coalesce(price > 0, false)")), one("known style", wines.filter("style NOT IN ('red', 'white', 'sparkling', 'dessert', 'rose')")),
        one("known tier", wines.filter("tier NOT IN ('everyday', 'premium', 'luxury')")), one("known promo", obs.filter("promo_type NOT IN ('sale', 'clearance')")),
        one("unique slug", twice(wines, "slug")), one("unique listing", twice(obs, "wine_id", "date")),
        one("one active run", runs.filter("is_active").groupBy().count().filter("count <> 1")),
        one("listing of a wine", obs.join(wines, "wine_id", "left_anti")), one("forecast of a run", forecasts.join(runs, "model_version", "left_anti")),
    ]
    out = rules[0]
    for r in rules[1:]:
        out = out.unionByName(r)
    return out


def facts(rows: DataFrame, year: int) -> DataFrame:
    """M5: a fact text for each row of a catalog with quarters, sales, first price and drinking window."""
    pct = lambda p: F.when(p < 0.005, F.lit("under 1%")).otherwise(F.concat(F.round(p * 100, 0).cast("int").cast("string"), F.lit("%")))
    usd = lambda x: F.concat(F.lit("$"), F.format_number(x, 2))
    title = F.when(F.col("vintage") == "NV", F.col("name")).otherwise(F.concat_ws(" ", "name", "vintage"))
    w = window(F.col("region"), F.col("style"), F.col("tier"))
    v = F.expr("try_cast(vintage AS int)")
    where = F.when(F.lit(year) < v + w["opens"], "before").when(F.lit(year) > v + w["closes"], "past").otherwise("inside")
    lines = [
        F.concat(F.lit("Wine: "), title, F.lit(" ("), F.concat_ws(", ", "style", F.coalesce("region", F.lit("region not stated")), "grape", "classification"), F.lit(").")),
        F.concat(F.lit("Price tier: "), "tier", F.lit(". List price "), usd(F.col("price")),
        F.when(F.col("promo_price").isNotNull(), F.concat(F.lit(", on "), "promo_type", F.lit(" at "),
        usd(F.col("promo_price")))).otherwise(F.lit("")), F.lit(".")),
        F.concat(F.lit("Listed "), F.col("quarters").cast("string"), F.lit(" times since "), F.date_format("first_date", "yyyy-MM-dd"),
        F.lit(", on sale in "), F.col("sales").cast("string"), F.lit(".")),
        F.when(v.isNotNull(), F.concat(F.lit("Drinking window "), (v + w["opens"]).cast("string"), F.lit("-"), (v + w["closes"]).cast("string"),
        F.lit("; now "), where, F.lit(" it."))),
        F.when(F.col("p_up_1y").isNotNull(), F.concat(F.lit("Chance of a higher list price within a year "), pct(F.col("p_up_1y")),
        F.lit(", of a lower one "), pct(F.col("p_down_1y")), F.lit("."))),
        F.when(F.col("fair_price").isNotNull(), F.concat(F.lit("Fair price "), usd(F.col("fair_price")), F.lit(" ("), usd(F.col("fair_low")),
        F.lit(" to "), usd(F.col("fair_high")), F.lit(")."))),
    ]
    return rows.select("wine_id", F.concat_ws("\n", *lines).alias("facts"))


def chosen(by: Column, df: DataFrame, n: int) -> DataFrame:
    """N rows in the order of a hash, the same in every run."""
    return df.orderBy(F.md5(by.cast("string")), by).limit(n)
