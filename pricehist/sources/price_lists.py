"""Price-list text to rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pricehist.functions import names as n


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """File, page, line_no, text of every line; pages end at form feeds."""
    return lines_of(spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value"))


def lines_of(files: DataFrame) -> DataFrame:
    """file, page, line_no, text from whole files (file, value)."""
    pages = files.select("file", F.posexplode(F.split("value", "\f")).alias("page", "p"))
    return pages.select("file", "page", F.posexplode(F.split("p", "\r?\n")).alias("line_no", "text"))


def report_date(file: F.Column) -> F.Column:
    """The date at the end of a file's name."""
    return F.to_date(F.nullif(F.regexp_extract(file, r"_(\d{8})(?:\.[^./]+)?$", 1), F.lit("")), "yyyyMMdd")


def matched(lines: DataFrame) -> DataFrame:
    """lines with kind: orphan (tested first), product, miss, name or noise (P3), and g: an orphan's or product's groups with \\x01 between them.

    A product line is matched once: its groups, with the description last (it alone may hold any character), are written side by side. What does
    not match stays as it is; what does starts with a digit or a space, and its groups with a letter."""
    t = F.col("text")
    product = F.regexp_replace(t, n.LINE, "\x01".join(["p", "$1", "$3", "$4", "$5", "$6", "$7", "$2"]))
    groups = F.when(t.rlike(n.ORPHAN), F.regexp_replace(t, n.ORPHAN, "\x01".join(["o", "$1", "$2", "$3", "$4", "$5", "$6", ""]))).otherwise(product)
    x = lines.withColumn("g", groups)
    kind = (
        F.when(F.col("g") != t, F.when(F.col("g").startswith("o"), "orphan").otherwise("product")).when(t.rlike(r"^\s*\d{3,}\s+\S") & t.contains("$"), "miss")
        .when((F.trim(t) != "") & ~F.trim(t).rlike(n.NOT_NAME), "name").otherwise("noise")
    )
    return x.withColumn("kind", kind)


def marked(lines: DataFrame) -> DataFrame:
    """lines with kind."""
    return matched(lines).drop("g")


def parse(lines: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row for each product line, and miss = true rows for product-looking lines that could not be read.

    An orphan takes its description from the last two names since the product line before it on its page. Only pages are
    windowed; a miss neither joins nor ends the pending names. keep: further columns of marked() to return, such as kind."""
    page = Window.partitionBy("file", "page").orderBy("line_no")
    before = page.rowsBetween(Window.unboundedPreceding, -1)
    x = matched(lines)
    # An orphan without a pending name is a miss; it ends a block too, which changes nothing, as nothing is pending.
    ends = F.col("kind").isin("product", "orphan")
    x = x.withColumn("block", F.coalesce(F.sum(F.when(ends, 1).otherwise(0)).over(before), F.lit(0)))
    # A name pends if it is of the line's own block: names know their block, so both windows have one order and pages are sorted once.
    x = x.withColumn("name", F.when(F.col("kind") == "name", F.struct("block", F.trim("text").alias("name"))))
    before_it = "IGNORE NULLS OVER (PARTITION BY file, page ORDER BY line_no)"
    x = x.selectExpr("*", f"lag(name, 1) {before_it} AS one", f"lag(name, 2) {before_it} AS two").filter(F.col("kind").isin("product", "orphan", "miss"))
    pending = lambda c: F.when(F.col(f"{c}.block") == F.col("block"), F.col(f"{c}.name"))
    x = x.withColumns({"last_name": pending("one"), "name_before": pending("two")})
    orphan = F.col("kind") == "orphan"
    x = x.withColumn("miss", (F.col("kind") == "miss") | (orphan & F.col("last_name").isNull()))
    x = x.withColumn("g", F.split(F.when(F.col("kind").isin("product", "orphan"), F.col("g")), "\x01", 8))
    part = lambda k: F.nullif(F.get("g", F.lit(k)), F.lit(""))
    desc = F.when(orphan, F.concat_ws(" ", "name_before", "last_name")).otherwise(F.trim(F.coalesce(F.get("g", F.lit(7)), F.lit(""))))
    x = x.select(
        *keep, "file", "page", "line_no", "miss", part(1).alias("code"), desc.alias("desc"), part(2).alias("size"), part(3).alias("start"), part(4).alias("end"),
        n.money(part(5)).alias("promo_price"), n.money(part(6)).alias("regular_price"),
    )
    start, promo = F.col("start"), F.col("promo_price")
    return x.select(
        *keep, "file", "page", "line_no", "miss", report_date(F.col("file")).alias("report_date"), "code", F.when(~F.col("miss"), F.col("desc")).alias("description"),
        n.vintage_of(F.col("desc")).alias("vintage"), n.normalized_size(F.col("size")).alias("size"), "regular_price", "promo_price",
        n.promo_type(promo, start).alias("promo_type"), n.date_of(start).alias("sale_start"),
        n.date_of(F.col("end")).alias("sale_end"),
    )


def write_prices(rows: DataFrame, path: str) -> None:
    """S3: parsed rows, by report date; a date's rows replace those that were there."""
    rows.filter("NOT miss").drop("miss").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("report_date").parquet(path)
