"""Gap-aware panel features.

All windows share one partitioning (wine_id) and one order (the list number t), so a series is shuffled and sorted once. Frames
are RANGE frames over t: a list without the wine stays a gap and is not bridged."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A smaller change of the log list price counts as none.
MOVE = math.log(1.005)
LAGS = (1, 2, 4, 8)


def by_wine():
    return Window.partitionBy("wine_id").orderBy("t")


def so_far():
    return by_wine().rangeBetween(Window.unboundedPreceding, 0)


def whole():
    return by_wine().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def back(frame: int):
    return by_wine().rangeBetween(-frame, 0)


def direction(y: Column) -> Column:
    """Up, down or same."""
    return F.when(y > MOVE, "up").when(y < -MOVE, "down").when(y.isNotNull(), "same")


def diffs(series: DataFrame, log: Callable[[Column], Column] = F.log) -> DataFrame:
    """log_price and its change since the previous list (null across a gap). log: numbers.ln where its last bit counts."""
    log = series.withColumn("log_price", log(F.col("price")))
    return log.withColumn("diff", F.col("log_price") - F.first("log_price").over(by_wine().rangeBetween(-1, -1)))


def features(series: DataFrame, fixed: bool = False) -> DataFrame:
    """series with all features known at each listing. series: wine_id, t, date, price, promo_price, promo_type and wine attributes.
    fixed: the attributes are the same in all rows of a wine, so there is nothing to fill in (it takes half of the windows' time)."""
    x = diffs(series)
    log, diff = F.col("log_price"), F.col("diff")
    changed = F.when(diff.isNotNull(), (F.abs(diff) > 1e-9).cast("double"))
    vint = F.expr("try_cast(vintage AS int)")
    cols = {f"lr_{k}": log - F.first("log_price").over(by_wine().rangeBetween(-k, -k)) for k in LAGS}
    cols["vol_4"] = F.when(F.count(diff).over(back(3)) >= 2, F.stddev_samp(diff).over(back(3)))
    cols["changes_8"] = F.sum(changed).over(back(7))
    last = F.max(F.when(F.abs(diff) > 1e-9, F.col("t"))).over(so_far())
    cols["periods_since_change"] = F.col("t") - F.coalesce(last, F.min("t").over(so_far()))
    cols["age"] = F.count(F.lit(1)).over(so_far())
    own = {"valid": diff.isNotNull(), "up": F.coalesce(diff > MOVE, F.lit(False)), "down": F.coalesce(diff < -MOVE, F.lit(False))}
    for k, v in own.items():
        cols[f"own_{k}"] = v.cast("double")
        cols[f"own_{k}_4"] = F.sum(v.cast("double")).over(back(3))
    cols["on_sale"] = F.coalesce(F.col("promo_type") == "sale", F.lit(False)).cast("double")
    cols["on_clearance"] = F.coalesce(F.col("promo_type") == "clearance", F.lit(False)).cast("double")
    cols["discount"] = F.coalesce(1 - F.col("promo_price") / F.col("price"), F.lit(0.0))
    cols["vintage_year"] = vint
    cols["vintage_age"] = F.year("date") - vint
    cols["is_nv"] = vint.isNull().cast("double")
    for c in () if fixed else ("region", "brand", "grape", "classification"):
        cols[c] = F.first(c, ignorenulls=True).over(whole())
    for c in () if fixed else ("style", "tier"):
        cols[c] = F.coalesce(F.last(c, ignorenulls=True).over(so_far()), F.first(c, ignorenulls=True).over(by_wine().rangeBetween(0, Window.unboundedFollowing)))
    return x.withColumns(cols)


def grid(periods: DataFrame) -> DataFrame:
    """One row with the number of lists, lists a year and months from the last list but one to the last."""
    g = periods.agg(F.count(F.lit(1)).alias("lists"), F.min("date").alias("first"), F.max("date").alias("last"),
        F.max_by("date", F.struct(F.col("t"))).alias("x"), F.sort_array(F.collect_list("date"), False).alias("d"))
    days = F.datediff("last", "first")
    before = F.coalesce(F.get("d", F.lit(1)), F.col("last"))
    return g.select(
        "lists", F.greatest(F.lit(1), F.bround(F.col("lists") / (days / 365.25 + 1e-9))).cast("int").alias("per_year"),
        F.bround(F.datediff("last", before) / 30.44).cast("int").alias("step_months"), "last",
    )


def future_dates(periods: DataFrame, horizon: int) -> DataFrame:
    """h, target_date of the next price lists, in whole calendar months."""
    return grid(periods).select(F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("h"), "last", "step_months").select("h",
        F.add_months("last", F.col("h") * F.col("step_months")).alias("target_date"))


def horizons(origins: DataFrame, horizon: int, per_year: int, newest: bool = False) -> DataFrame:
    """Origins with h = 1..horizon, the target list and y, the log change up to it; without a listing there, no row. newest: also a row with h = 0 for
    each wine's newest listing, which is what forecasts start from.

    The targets are read through the windows' own frames ahead, so there is no join and no further shuffle."""
    later = {f"_later_{h}": F.first("log_price").over(by_wine().rangeBetween(h, h)) for h in range(1, horizon + 1)}
    ahead = F.array(*[F.struct(F.lit(h).alias("h"), F.col(f"_later_{h}").alias("later")) for h in range(1, horizon + 1)])
    found = F.filter(ahead, lambda s: s["later"].isNotNull())
    if newest:
        own = F.array(F.struct(F.lit(0).alias("h"), F.col("log_price").alias("later")))
        later["_newest"] = F.max("t").over(whole())
        found = F.when(F.col("t") == F.col("_newest"), F.concat(own, found)).otherwise(found)
    rows = origins.withColumns(later).withColumn("x", F.explode(found))
    target = F.col("t") + F.col("x.h")
    out = {"h": F.col("x.h"), "target_t": target, "target_period_of_year": F.pmod(target, F.lit(per_year)), "y": F.col("x.later") - F.col("log_price")}
    return rows.withColumns(out).drop("x", *later)


def base_rates(samples: DataFrame) -> DataFrame:
    """Share of rises and cuts by horizon."""
    return samples.groupBy("h").agg(F.avg((F.col("y") > MOVE).cast("double")).alias("up"), F.avg((F.col("y") < -MOVE).cast("double")).alias("down"), F.count(F.lit(1)).alias("n"))
