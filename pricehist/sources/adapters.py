"""Price-history views over the star-schema tables, the same in Spark and (as PRELUDE) in SQL.

A wine is a part; its price list is the quarter of a line's ship date; list prices stick to the part's base price."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pricehist.functions.numbers import rounded


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cents(x: Column) -> Column:
    """Rounded half up to two places by plain arithmetic."""
    return F.floor(x * 100 + 0.5) / 100


def r6(x: Column) -> Column:
    """Rounded to six places, without a negative zero."""
    return rounded(x, 6) + F.lit(0.0)


def r3(x: Column) -> Column:
    """Rounded to three places, for sums whose order may differ."""
    return rounded(x, 3) + F.lit(0.0)


def day(c: str) -> Column:
    """A date as text."""
    return F.date_format(c, "yyyy-MM-dd")


def quarter(ts: str) -> Column:
    return F.to_date(F.date_trunc("quarter", ts))


def list_price() -> Column:
    """A line's list price, from the base price of its part."""
    return cents(F.col("base") * F.when(F.col("l_discount") > 0.085, 1.07).when(F.col("l_tax") > 0.075, 0.95).otherwise(1.0))


def obs_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_retailprice") / F.col("p_size")).alias("base"))
    line = table(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
    kind = F.when(F.col("l_returnflag") == "R", "sale").when(F.col("l_returnflag") == "A", "clearance")
    rows = line.select(
        F.col("l_partkey").alias("wine_id"), quarter("l_shipdate").alias("date"), F.col("l_orderkey").alias("code"),
        F.col("l_linenumber").alias("line"), F.col("l_suppkey").alias("supp"), F.col("l_extendedprice").alias("ext"),
        F.col("l_quantity").alias("qty"), F.col("l_discount").alias("disc"), F.col("l_tax").alias("tax"),
        list_price().alias("price"), kind.alias("promo_type"),
    )
    return rows.withColumn("promo_price", F.when(F.col("promo_type").isNotNull(), cents(F.col("price") * (1 - F.col("qty") / 100))))


def one_per_list(rows: DataFrame) -> DataFrame:
    """of a wine's rows on one list the one with the lowest code, then line and so on (a total order).

    A minimum of structs, so copies are dropped before the shuffle and no window is needed."""
    order = ["code", "line", "supp", "ext", "qty", "disc", "tax", "price", "promo_type", "promo_price"]
    return rows.groupBy("wine_id", "date").agg(F.min(F.struct(*order)).alias("x")).select("wine_id", "date", "x.code", "x.price", "x.promo_type", "x.promo_price")


def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return one_per_list(obs_raw(spark, sf_dir))


def periods(rows: DataFrame) -> DataFrame:
    """T, date of the distinct price-list dates (one row a list, so the one-task numbering is tiny)."""
    return rows.select("date").distinct().select((F.row_number().over(Window.orderBy("date")) - 1).alias("t"), "date")


def lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """t, date of the price lists, from the ship dates alone (every line has a part, so obs() has the same dates)."""
    return periods(table(spark, sf_dir, "lineitem").select(quarter("l_shipdate").alias("date")))


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    joined = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.select("n_nationkey", F.col("n_name").alias("region"), F.when(F.col("r_name").isin("AFRICA", "AMERICA"), "S").otherwise("N").alias("hemisphere"))


def wines(spark: SparkSession, sf_dir: str, *more: Column) -> DataFrame:
    """more: further columns, from those of part."""
    base = F.col("p_retailprice") / F.col("p_size")
    styles = F.array(*[F.lit(s) for s in ("red", "white", "sparkling", "dessert", "rose")])
    vintage = F.when(F.col("p_size") % 10 == 0, "NV").otherwise((F.col("p_size") + 1945).cast("string"))
    family = F.concat_ws("|", "p_brand", "p_type")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("region"))
    part = table(spark, sf_dir, "part").withColumn("n_nationkey", (F.col("p_partkey") % 25).cast("int"))
    return part.join(F.broadcast(nation), "n_nationkey", "left").select(
        F.col("p_partkey").alias("wine_id"), F.concat_ws("-", F.lower("p_brand"), F.lower("p_type"), "p_size", "p_partkey").alias("slug"), family.alias("family"),
        F.col("p_name").alias("name"), vintage.alias("vintage"), "region", F.col("p_brand").alias("brand"),
        F.split("p_name", " ")[0].alias("grape"), F.when(F.col("p_partkey") % 4 != 0, F.split("p_name", " ")[1]).alias("classification"),
        F.lit("750 ML").alias("size"), F.get(styles, (F.col("p_partkey") % 5).cast("int")).alias("style"),
        F.when(base < 25, "everyday").when(base < 75, "premium").otherwise("luxury").alias("tier"), *more,
    )


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations with the list's number t and their wine's attributes."""
    return obs(spark, sf_dir).join(F.broadcast(lists(spark, sf_dir)), "date").join(wines(spark, sf_dir), "wine_id")


def newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each wine's series() the row on its newest list: date, price and the wine's attributes.

    A line is picked before its part is joined, by one minimum over the lines of a wine (the latest list, then the order of one_per_list(), whose further
    columns follow from these or from the part): lines are read once, and one of each wine and task is shuffled."""
    order = ["l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax"]
    line = table(spark, sf_dir, "lineitem").withColumn("date", quarter("l_shipdate")).filter("date IS NOT NULL")
    picked = line.groupBy(F.col("l_partkey").alias("wine_id")).agg(F.min(F.struct((-F.unix_date("date")).alias("age"), *order)).alias("x")).select("wine_id", "x.*")
    base = (F.col("p_retailprice") / F.col("p_size")).alias("base")
    return picked.join(wines(spark, sf_dir, base), "wine_id").withColumns({
        "date": F.date_from_unix_date(-F.col("age")), "price": list_price(),
    }).drop("age", "base", *order)


PRELUDE = """
WITH obs_raw AS (
    SELECT *, CASE WHEN promo_type IS NOT NULL THEN floor(price * (1 - qty / 100) * 100 + 0.5) / 100 END AS promo_price
    FROM (
        SELECT l_partkey AS wine_id, CAST(date_trunc('quarter', l_shipdate) AS DATE) AS date, l_orderkey AS code, l_linenumber AS line, l_suppkey AS supp,
            l_extendedprice AS ext, l_quantity AS qty, l_discount AS disc, l_tax AS tax,
            floor((p_retailprice / p_size) * (CASE WHEN l_discount > 0.085 THEN 1.07::DOUBLE WHEN l_tax > 0.075 THEN 0.95::DOUBLE ELSE 1::DOUBLE END) * 100 + 0.5) / 100 AS price,
            CASE l_returnflag WHEN 'R' THEN 'sale' WHEN 'A' THEN 'clearance' END AS promo_type
        FROM lineitem JOIN part ON l_partkey = p_partkey
    )
), obs AS (
    SELECT wine_id, date, code, price, promo_type, promo_price FROM obs_raw
    QUALIFY row_number() OVER (PARTITION BY wine_id, date ORDER BY code, line, supp, ext, qty, disc, tax) = 1
), periods AS (
    SELECT CAST(row_number() OVER (ORDER BY date) - 1 AS INTEGER) AS t, date FROM (SELECT DISTINCT date FROM obs)
), wines AS (
    SELECT p_partkey AS wine_id, lower(p_brand) || '-' || lower(p_type) || '-' || p_size || '-' || p_partkey AS slug, p_brand || '|' || p_type AS family, p_name AS name,
        CASE WHEN p_size % 10 = 0 THEN 'NV' ELSE CAST(1945 + p_size AS VARCHAR) END AS vintage, n_name AS region, p_brand AS brand,
        split_part(p_name, ' ', 1) AS grape, CASE WHEN p_partkey % 4 <> 0 THEN split_part(p_name, ' ', 2) END AS classification, '750 ML' AS size,
        (['red', 'white', 'sparkling', 'dessert', 'rose'])[p_partkey % 5 + 1] AS style,
        CASE WHEN p_retailprice / p_size < 25 THEN 'everyday' WHEN p_retailprice / p_size < 75 THEN 'premium' ELSE 'luxury' END AS tier
    FROM part LEFT JOIN nation ON n_nationkey = p_partkey % 25
), series AS (
    SELECT * FROM obs JOIN periods USING (date) JOIN wines USING (wine_id)
), regions AS (
    SELECT n_nationkey, n_name AS region, CASE WHEN r_name IN ('AFRICA', 'AMERICA') THEN 'S' ELSE 'N' END AS hemisphere
    FROM nation JOIN region ON n_regionkey = r_regionkey
)"""
