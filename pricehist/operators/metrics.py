"""Evaluation of predictions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pricehist.functions.numbers import exp, rounded
from pricehist.functions.shared import cut
from pricehist.operators.panel import MOVE


def running(df: DataFrame, by: list[str], order: str, columns: list[str], descending: bool = False) -> DataFrame:
    """df with cum_<c>: running sums within `by` in the order of a column, equal values together (the sum includes them all).

    Two passes, so that no group is brought to one task: range partitions sum up by themselves, and each adds what lies before it. Ties lie in one
    partition, since rows are ranged by value alone."""
    key = F.col(order).desc() if descending else F.col(order).asc()
    x = cut(df.repartitionByRange(*[F.col(c) for c in by], key).withColumn("_p", F.spark_partition_id()))
    part = x.groupBy(*by, "_p").agg(*[F.sum(c).alias(f"_{c}") for c in columns])  # groups times partitions
    before = Window.partitionBy(*by).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    part = part.select(*by, "_p", *[F.coalesce(F.sum(f"_{c}").over(before), F.lit(0)).alias(f"_{c}") for c in columns])
    w = Window.partitionBy(*by, "_p").orderBy(key).rangeBetween(Window.unboundedPreceding, 0)
    at = x.withColumns({f"cum_{c}": F.sum(c).over(w) for c in columns}).join(part, [*by, "_p"])
    return at.withColumns({f"cum_{c}": F.col(f"cum_{c}") + F.col(f"_{c}") for c in columns}).drop("_p", *[f"_{c}" for c in columns])


def ranking(rows: DataFrame, by: list[str], score: str, label: str) -> DataFrame:
    """M8: n, positives, ROC AUC (ties count half; null with one class) and average precision (null without positives) of each group.

    Rows are first counted by score, so only distinct scores are ordered."""
    return ranked(rows.groupBy(*by, F.col(score).alias("s")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("bigint")).alias("pos")), by)


def ranked(x: DataFrame, by: list[str]) -> DataFrame:
    """ranking() of rows that are counted already: by, s (each score of a group once), n, pos."""
    x = running(x.withColumn("neg", F.col("n") - F.col("pos")), by, "s", ["n", "pos", "neg"], descending=True)
    total = x.groupBy(*by).agg(F.sum("n").alias("rows"), F.sum("pos").alias("positives"))
    x = x.join(total, by)
    negatives = F.col("rows") - F.col("positives")
    pairs = F.sum(F.col("pos") * (negatives - F.col("cum_neg") + F.col("neg") / 2.0))
    precision = F.sum(F.col("pos") * F.col("cum_pos") / F.col("cum_n"))
    g = x.groupBy(*by).agg(F.first("rows").alias("n"), F.first("positives").alias("positives"), pairs.alias("a"), precision.alias("p"))
    both = (F.col("positives") > 0) & (F.col("positives") < F.col("n"))
    auc = F.when(both, F.col("a") / (F.col("positives") * (F.col("n") - F.col("positives"))))
    return g.select(*by, "n", "positives", auc.alias("roc_auc"), F.when(F.col("positives") > 0, F.col("p") / F.col("positives")).alias("avg_precision"))


def sides(rows: DataFrame) -> DataFrame:
    """Two rows for each prediction: side, hit and score."""
    up = F.struct(F.lit("up").alias("side"), (F.col("y") > MOVE).alias("hit"), F.col("p_up").alias("score"))
    down = F.struct(F.lit("down").alias("side"), (F.col("y") < -MOVE).alias("hit"), F.col("p_down").alias("score"))
    return rows.withColumn("x", F.explode(F.array(up, down))).select("*", "x.side", "x.hit", "x.score").drop("x")


def change_scores(rows: DataFrame, base: DataFrame, by: tuple[str, ...] = ("h", "side")) -> DataFrame:
    """M8: rates, AUC, average precision and Brier skill against the base rate. base: h, side, base_rate of the calibration slice."""
    x = sides(rows).join(F.broadcast(base), ["h", "side"])
    hit = F.col("hit").cast("double")
    g = x.groupBy(*by).agg(
        F.avg(hit).alias("actual_rate"), F.avg("score").alias("predicted_rate"),
        (1 - F.try_divide(F.avg((F.col("score") - hit) ** 2), F.avg((F.col("base_rate") - hit) ** 2))).alias("brier_skill"),
    )
    return ranking(x, list(by), "score", "hit").join(g, list(by))


def segments(rows: DataFrame, tests: dict[str, Column]) -> DataFrame:
    """A row for every segment that it belongs to (segments may overlap; their number is fixed)."""
    names = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in tests.items()]), lambda s: s.isNotNull())
    return rows.withColumn("segment", F.explode(names))


def range_scores(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """M7: errors in price terms against the last price and drift, coverage and pinball losses. rows: y, p10, p50, p90 (log ratios), h, lr_4."""
    y, drift = F.col("y"), F.coalesce("lr_4", F.lit(0.0)) / 4 * F.col("h")
    mape = lambda p: F.abs(F.exp(p) - F.exp(y)) / F.exp(y) * 100
    changed = F.abs(y) > 1e-9
    loss = lambda c, q: F.avg(F.greatest(q * (y - F.col(c)), (q - 1) * (y - F.col(c))))
    return rows.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("n"), (F.avg(changed.cast("double")) * 100).alias("changed_pct"), F.avg(mape(F.col("p50"))).alias("mape"),
        F.avg(mape(F.lit(0.0))).alias("mape_naive"), F.avg(mape(drift)).alias("mape_drift"),
        F.avg(F.when(changed, mape(F.col("p50")))).alias("mape_changed"), F.avg(F.when(changed, mape(F.lit(0.0)))).alias("mape_naive_changed"),
        (F.avg(y.between(F.col("p10"), F.col("p90")).cast("double")) * 100).alias("coverage_80"),
        loss("p10", 0.1).alias("pinball_10"), loss("p50", 0.5).alias("pinball_50"), loss("p90", 0.9).alias("pinball_90"),
    )


def order_statistics(rows: DataFrame, by: list[str], value: str, ranks: DataFrame) -> DataFrame:
    """by, r, v: the values of given ranks (from 0) within each group. ranks: by, r."""
    x = running(rows.groupBy(*by, F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("n")), by, "v", ["n"])
    return x.join(F.broadcast(ranks), by).filter(F.col("cum_n") > F.col("r")).groupBy(*by, "r").agg(F.min("v").alias("v"))


def conformal_adjust(calibration: DataFrame, share: float = 0.8) -> DataFrame:
    """M6: h, adjust: how far the band must be widened (or narrowed, if negative): the quantile of max(p10 - y, y - p90) at
    min(1, ceil((n + 1) * share) / n), interpolated."""
    x = calibration.withColumn("s", F.greatest(F.col("p10") - F.col("y"), F.col("y") - F.col("p90")))
    n = x.groupBy("h").agg(F.count(F.lit(1)).alias("n")).withColumn("pos", F.least(F.lit(1.0), F.ceil((F.col("n") + 1) * share) / F.col("n")) * (F.col("n") - 1))
    asked = n.select("h", F.explode(F.array_distinct(F.array(F.floor("pos"), F.ceil("pos")))).alias("r"))
    v = order_statistics(x, ["h"], "s", asked).groupBy("h").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    return v.join(n, "h").select("h", (F.col("lo") + (F.col("hi") - F.col("lo")) * (F.col("pos") - F.floor("pos"))).alias("adjust"))


def widen(rows: DataFrame, adjust: DataFrame) -> DataFrame:
    """rows with their band widened by horizon (an unknown horizon by the most) and its three values in order."""
    most = adjust.agg(F.max("adjust").alias("most"))
    x = rows.join(F.broadcast(adjust), "h", "left").join(F.broadcast(most), F.lit(True)).withColumn("a", F.coalesce("adjust", "most"))
    p = F.array_sort(F.array(F.col("p10") - F.col("a"), F.col("p50"), F.col("p90") + F.col("a")))
    return x.withColumn("p", p).withColumns({"p10": F.col("p")[0], "p50": F.col("p")[1], "p90": F.col("p")[2]}).drop("p", "a", "adjust", "most")


def fold_of(group: Column, folds: int) -> Column:
    """A fold for every group, so that no group is in two: the first 32 bits of its md5, modulo the number of folds."""
    return F.pmod(F.conv(F.substring(F.md5(group), 1, 8), 16, 10).cast("bigint"), F.lit(folds)).cast("int")


def band_scale(rows: DataFrame, share: float = 0.8) -> DataFrame:
    """K, the least of 1.00, 1.01, ... for which `share` of the rows lie in the band around p50 widened k times.

    Every row has a k that it needs, in hundredths and rounded up; rows are counted by it in one pass, and the answer is the order statistic of at most
    201 counts. Over 3 is an error, as no sensible band needs it."""
    need = F.when(F.col("y") >= F.col("p50"), (F.col("y") - F.col("p50")) / F.nullif(F.col("p90") - F.col("p50"),
        F.lit(0.0))).otherwise((F.col("p50") - F.col("y")) / F.nullif(F.col("p50") - F.col("p10"), F.lit(0.0)))
    need = F.coalesce(need, F.when(F.col("y") == F.col("p50"), 0.0).otherwise(1e9))
    step = F.greatest(F.lit(100), F.ceil(F.least(need, F.lit(3.0)) * 100 - 1e-9))
    x = rows.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n"))
    x = x.select("step", F.sum("n").over(Window.orderBy("step")).alias("cum_n"), F.sum("n").over(Window.partitionBy()).alias("rows"))
    least = x.filter(F.col("cum_n") >= F.ceil(F.col("rows") * share)).groupBy("rows").agg((F.min("step") / 100).alias("k"))
    return least.select(F.when(F.col("k") < 3, F.col("k")).otherwise(F.raise_error(F.lit("no scale under 3 covers enough rows"))).alias("k"))


def value_pct(y: Column, p50: Column) -> Column:
    return rounded((exp(y - p50) - 1) * 100, 1)


def cv_summary(scores: DataFrame, current: str = "current") -> DataFrame:
    """By set the mean over folds of mae and auc, the mean difference from the current set, and in how many folds it is better. scores: fold,
    set, mae, auc (one row for each seed)."""
    per = scores.groupBy("fold", "set").agg(F.avg("mae").alias("mae"), F.avg("auc").alias("auc"))
    own = per.filter(F.col("set") == current).select("fold", F.col("mae").alias("m0"), F.col("auc").alias("a0"))
    x = per.join(F.broadcast(own), "fold")
    dm, da = F.col("mae") - F.col("m0"), F.col("auc") - F.col("a0")
    return x.groupBy("set").agg(F.avg("mae").alias("mae"), F.avg("auc").alias("auc"), F.avg(dm).alias("mae_vs_current"),
        F.count_if(dm < 0).alias("folds_mae_better"), F.avg(da).alias("auc_vs_current"), F.count_if(da > 0).alias("folds_auc_better"))


def importance(rows: DataFrame, features: list[str], score: Callable[[DataFrame], DataFrame], most: int = 40_000, seed: int = 7) -> DataFrame:
    """Feature and auc_drop, largest first: how much the AUC of p_up falls when a feature's values change places. rows: id (one row each), y and
    features; score adds p_up. At most `most` rows take part, chosen by a hash of id (a sampling operator).

    Every row is laid out once as it is (k = 0) and once for each feature k, with the value of another row there; all are scored in one pass."""
    sample = cut(rows.orderBy(F.md5(F.concat_ws("|", F.lit(seed), "id")), "id").limit(most))
    # Places are numbered within k: at most `most` rows a task.
    place = F.row_number().over(Window.partitionBy("_k").orderBy(F.md5(F.concat_ws("|", "_k", "id")), "id"))
    placed = cut(sample.select("id", F.explode(F.sequence(F.lit(0), F.lit(len(features)))).alias("_k")).withColumn("_r", place))
    own = placed.filter("_k = 0")
    moves = placed.filter("_k > 0").withColumnRenamed("id", "_giver").join(own.select("_r", "id"), "_r").select("_k", "id", "_giver")
    moves = moves.unionByName(own.select("_k", "id", F.col("id").alias("_giver")))
    given = sample.select(F.col("id").alias("_giver"), *[F.col(f).alias(f"_v_{f}") for f in features])
    moved = {f: F.when(F.col("_k") == k + 1, F.col(f"_v_{f}")).otherwise(F.col(f)) for k, f in enumerate(features)}
    x = sample.join(moves, "id").join(given, "_giver").withColumns(moved).select("_k", *sample.columns)
    auc = cut(ranking(score(x).withColumn("hit", F.col("y") > MOVE), ["_k"], "p_up", "hit").select("_k", "roc_auc"))
    base = auc.filter("_k = 0").select(F.col("roc_auc").alias("base"))
    name = F.element_at(F.array(*[F.lit(f) for f in features]), F.col("_k"))
    out = auc.filter("_k > 0").join(F.broadcast(base), F.lit(True)).select(name.alias("feature"), rounded(F.col("base") - F.col("roc_auc"), 4).alias("auc_drop"))
    return out.orderBy(F.desc("auc_drop"), "feature")
