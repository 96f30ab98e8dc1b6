"""Sinks and stable tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException
from pyspark.sql.window import Window

from pricehist.functions.shared import cut

SERIES = "wine_id bigint, date date, price double, promo_price double, promo_type string, style string, tier string, vintage string, region string, family string, brand string, name string"


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """A typed CSV table with a header, or None where there is none."""
    try:
        return spark.read.schema(schema).option("header", True).csv(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def daily_weather(text: DataFrame) -> DataFrame:
    """Region, date and one column for each parameter, from JSON of parameters keyed by yyyymmdd; -999 is missing. text: region, json."""
    maps = F.from_json("json", "map<string, map<string, double>>")
    names = {"T2M_MAX": "t_max", "T2M_MIN": "t_min", "T2M": "t_mean", "PRECTOTCORR": "rain"}
    x = text.select("region", F.explode(maps).alias("parameter", "days")).select("region", "parameter", F.explode("days").alias("day", "v"))
    pick = lambda p: F.max(F.when(F.col("parameter") == p, F.nullif("v", F.lit(-999.0))))
    return x.groupBy("region", F.to_date("day", "yyyyMMdd").alias("date")).agg(*[pick(p).alias(c) for p, c in names.items()])


def wide_crush(sheet: DataFrame, title: str = "c0") -> DataFrame:
    """File, crop_year, district, value from a table of text cells: a title with the crop year, a header row of district numbers (or STATE
    something), and a TOTAL WINE row. sheet: file, row, and cells from `title` on. Cells that are no numbers are left out."""
    cells = [c for c in sheet.columns if c not in ("file", "row", title)]
    crop = sheet.groupBy("file").agg(F.max(F.when(F.upper(title).rlike(r"\d{4} CROP"), F.regexp_extract(F.upper(title), r"(\d{4}) CROP", 1).cast("int"))).alias("crop_year"))
    long = lambda rows, c: rows.unpivot(["file"], cells, "cell", c).select("file", "cell", c)
    head = long(sheet.filter(F.col(title).startswith("Type and Var")), "head")
    total = long(sheet.filter(F.upper(F.trim(title)) == "TOTAL WINE"), "v")
    x = head.join(total, ["file", "cell"]).join(crop, "file").withColumn("value", F.col("v").try_cast("double"))
    number = F.col("head").try_cast("double").cast("int").cast("string")
    district = F.coalesce(number, F.when(F.upper("head").contains("STATE"), "state"))
    return x.withColumn("district", district).filter("value IS NOT NULL AND district IS NOT NULL").select("file", "crop_year", "district", "value")


def rules(spark: SparkSession, path: str) -> DataFrame:
    """Item, match, exclude of a JSON list of rules."""
    x = spark.read.schema("item string, match array<string>, exclude array<string>").json(path, multiLine=True)
    return x.withColumn("exclude", F.coalesce("exclude", F.expr("array()")))


def ranks(df: DataFrame, column: str) -> DataFrame:
    """df with rank, 1.. in the order of a column, without bringing all rows to one task: range partitions are numbered by themselves, and
    each adds the sizes of those before it (a list as long as the number of partitions)."""
    x = cut(df.repartitionByRange(column).withColumn("_p", F.spark_partition_id()))
    sizes, offset, rows = sorted((r["_p"], r["count"]) for r in x.groupBy("_p").count().collect()), 0, []
    for p, n in sizes:
        rows.append((p, offset))
        offset += n
    if not rows:
        return x.withColumn("rank", F.lit(None).cast("long")).drop("_p")
    at = x.join(F.broadcast(df.sparkSession.createDataFrame(rows, "_p int, _o long")), "_p")
    return at.withColumn("rank", F.col("_o") + F.row_number().over(Window.partitionBy("_p").orderBy(column))).drop("_p", "_o")


def upsert(old: DataFrame, new: DataFrame, refresh: bool = True) -> DataFrame:
    """Old (id, slug, is_active) with the wines of new (slug, is_active): known slugs keep their id, others get the next ones in order.

    refresh: wines missing from new are no longer active; without it they keep what they had."""
    top = old.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    fresh = ranks(new.join(old, "slug", "left_anti").select("slug", "is_active"), "slug").join(F.broadcast(top), F.lit(True))
    known = old.join(new.select("slug", F.col("is_active").alias("now")), "slug", "left")
    kept = known.select("id", "slug", F.coalesce("now", F.lit(False) if refresh else F.col("is_active")).alias("is_active"))
    return kept.unionByName(fresh.select((F.col("top") + F.col("rank")).alias("id"), "slug", "is_active"))


def replace_source(obs: DataFrame, path: str) -> None:
    """The sources of obs replace what path had of them; other sources stay."""
    obs.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source").parquet(path)


def export(series: DataFrame, path: str) -> None:
    """The training table, in order of wine and date within range partitions."""
    series.repartitionByRange("wine_id").sortWithinPartitions("wine_id", "date").write.mode("overwrite").option("header", True).csv(path)


RELEASE = "model_version string, folder string, snapshot bigint, writer string"


def releases(spark: SparkSession, root: str) -> DataFrame:
    """model_version, folder, snapshot, writer of all releases under root; empty before the first one."""
    try:
        return spark.read.schema(RELEASE).option("recursiveFileLookup", True).parquet(f"{root}/registry")
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], RELEASE)
        raise


def registry(spark: SparkSession, root: str) -> DataFrame:
    """model_version, is_active, folder: of each version its newest release, and whether it is the newest of all. Of two writers that took the same number
    the one with the later name counts."""
    x = releases(spark, root).groupBy("model_version").agg(F.max(F.struct("snapshot", "writer", "folder")).alias("x"))
    newest = x.agg(F.max("x").alias("newest"))
    return x.join(F.broadcast(newest), F.lit(True)).select("model_version", (F.col("x") == F.col("newest")).alias("is_active"), "x.folder")


def write_rows(output: DataFrame, root: str) -> str:
    """The first half of a release: rows in a folder of their own, which no reader knows yet."""
    folder = f"rows/{uuid.uuid4().hex}"
    output.write.parquet(f"{root}/{folder}")
    return folder


def activate(spark: SparkSession, root: str, version: str, folder: str) -> None:
    """The second half: one more line of the registry, numbered after the last one that is there. Lines are only added, so a writer that runs at the same
    time loses nothing, and a release that fails before this line changes nothing."""
    last, writer = releases(spark, root).agg(F.max("snapshot")).first()[0] or 0, uuid.uuid4().hex
    spark.createDataFrame([(version, folder, last + 1, writer)], RELEASE).coalesce(1).write.parquet(f"{root}/registry/{writer}")


def release(output: DataFrame, version: str, root: str) -> None:
    """Writes a version's rows and makes that version the active one. The rows of every release, of the same version too, have a folder of their own
    and never change, so readers see the old release or the new one, whole."""
    activate(output.sparkSession, root, version, write_rows(output, root))


def released(spark: SparkSession, root: str, version: str | None = None) -> DataFrame:
    """The rows of the active version, or of a given one."""
    runs = registry(spark, root)
    found = runs.filter(F.col("model_version") == version if version is not None else F.col("is_active")).first()
    if found is None:
        raise ValueError(f"no release of {version or 'any version'} under {root}")
    return spark.read.parquet(f"{root}/{found['folder']}").withColumn("model_version", F.lit(found["model_version"]))


def metrics_document(metrics: DataFrame) -> DataFrame:
    """One JSON document for each row."""
    return metrics.select(F.to_json(F.struct(*metrics.columns)).alias("value"))
