"""Fair prices from comparable wines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricehist.functions.names import name_text
from pricehist.functions.numbers import ln


def latest_rows(series: DataFrame) -> DataFrame:
    """F16: each wine's newest listing with vintage_age, is_nv, listing_year, y (log price) and the name's text."""
    x = series.groupBy("wine_id").agg(F.max_by(F.struct(*[c for c in series.columns if c != "wine_id"]), "date").alias("x")).select("wine_id", "x.*")
    v = F.expr("try_cast(vintage AS int)")
    return x.withColumns({"vintage_age": F.year("date") - v, "is_nv": v.isNull().cast("double"),
        "listing_year": F.year("date") + (F.month("date") - 1) / 12, "y": ln(F.col("price")), "text": name_text(F.col("name"))})


def brand_encoding(train: DataFrame, target: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Target with the level of its brand from train rows of other families: mean, number of families and standard deviation (population;
    null below two rows). by: further keys, such as a fold, that both sides have.

    Totals of brand less those of the family: two aggregations, no row meets another."""
    by = list(by)
    fam = train.filter("brand IS NOT NULL").groupBy(*by, "brand", "family").agg(F.sum("y").alias("s"), F.count("y").alias("n"), F.sum(F.col("y") ** 2).alias("q"))
    tot = fam.groupBy(*by, "brand").agg(F.sum("s").alias("ts"), F.sum("n").alias("tn"), F.sum("q").alias("tq"), F.count_if(F.col("n") > 0).alias("tf"))
    x = target.join(tot, [*by, "brand"], "left").join(fam, [*by, "brand", "family"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    n, s, q = zero("tn") - zero("n"), zero("ts") - zero("s"), zero("tq") - zero("q")
    mean = F.when(n > 0, s / n)
    return x.withColumns({
        "brand_mean_logp": mean, "brand_n_families": zero("tf") - (zero("n") > 0).cast("bigint"),
        "brand_std_logp": F.when(n > 1, F.sqrt(F.greatest(q / n - (s / n) ** 2, F.lit(0.0)))),
    }).drop("ts", "tn", "tq", "tf", "s", "n", "q")


def baselines(rows: DataFrame, folds: int) -> DataFrame:
    """Rows (with fold) and two baselines from the other folds: the median of the same region and grape (else of all), and of the brand (else the
    first). Rows are counted by fold, keys and y, and the counts are given to the folds that they train: folds - 1 copies of distinct values, not of rows.
    rows are read more than once: they should be a table or a checkpoint."""
    trains = F.explode(F.expr(f"filter(sequence(0, {folds - 1}), k -> k <> fold)")).alias("fold")

    def middle(name, *keys):
        x = rows.dropna(subset=list(keys)) if keys else rows
        counted = x.groupBy("fold", *keys, "y").agg(F.count(F.lit(1)).alias("n")).select(trains, *keys, "y", "n")
        return counted.groupBy("fold", *keys).agg(F.percentile("y", F.lit(0.5), F.col("n")).alias(name))

    x = rows.join(F.broadcast(middle("m_all")), "fold", "left").join(middle("m_rg", "region", "grape"), ["fold", "region", "grape"], "left")
    x = x.join(middle("m_br", "brand"), ["fold", "brand"], "left")
    x = x.withColumn("region_grape", F.coalesce("m_rg", "m_all"))
    return x.withColumn("producer", F.coalesce("m_br", "region_grape")).drop("m_all", "m_rg", "m_br")


def evaluate(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Wines, median absolute error in percent, mean absolute log error, R2 and coverage. rows: y, p10, p50, p90."""
    e = F.col("p50") - F.col("y")
    return rows.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("wines"), (F.median(F.abs(F.exp(e) - 1)) * 100).alias("median_abs_pct_error"), F.avg(F.abs(e)).alias("mae_log"),
        (1 - F.try_divide(F.sum(e**2), F.var_pop("y") * F.count("y"))).alias("r2_log"),
        (F.avg(F.col("y").between(F.col("p10"), F.col("p90")).cast("double")) * 100).alias("coverage_80"),
    )


def terms(rows: DataFrame, key: str = "wine_id") -> DataFrame:
    """key, term, tf of the words (two letters or more) and word pairs of each text."""
    words = F.regexp_extract_all("text", F.lit(r"\b(\w\w+)\b"), 1)
    x = rows.select(key, words.alias("w"))
    pairs = F.when(F.size("w") > 1, F.transform(F.sequence(F.lit(1), F.size("w") - 1),
        lambda k: F.concat_ws(" ", F.element_at("w", k), F.element_at("w", k + 1)))).otherwise(F.array())
    return x.select(key, F.explode(F.concat("w", pairs)).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))


def tfidf(train: DataFrame, target: DataFrame, key: str = "wine_id", least: int = 2) -> DataFrame:
    """Key, term, weight of target's texts: (1 + ln tf) * (ln((1 + n) / (1 + df)) + 1) with n and df of train, terms in fewer than `least` train texts
    left out, scaled to length 1. The vocabulary is a table: it is joined and never collected."""
    n = train.select(F.countDistinct(key).alias("n"))
    df = terms(train, key).groupBy("term").agg(F.count(F.lit(1)).alias("df")).filter(F.col("df") >= least)
    idf = df.join(F.broadcast(n), F.lit(True)).select("term", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))
    x = terms(target, key).join(idf, "term").select(key, "term", ((1 + F.log("tf")) * F.col("idf")).alias("w"))
    norm = x.groupBy(key).agg(F.sqrt(F.sum(F.col("w") ** 2)).alias("norm"))
    return x.join(norm, key).select(key, "term", (F.col("w") / F.col("norm")).alias("w"))
