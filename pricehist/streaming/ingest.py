"""Incremental ingest (T1): every file is read once, and a rerun changes nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricehist.sources import keyed


def ingest(spark: SparkSession, source: str, target: str, state: str, schema: str, key: str, order: str, day: str) -> None:
    """Reads the files of `source` that earlier runs have not seen and adds their rows to `target`, partitioned by day.

    Within a batch the newest row of a key wins. A batch's rows go to a folder of its own number, which a retry overwrites, so each file
    counts once even if a run breaks off. The records of what has been read are in `state`."""

    def write(batch: DataFrame, number: int) -> None:
        columns = [c for c in batch.columns if c != key]
        newest = batch.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(order)).alias("x")).select(key, "x.*")
        newest.withColumn("batch", F.lit(number)).write.mode("overwrite").partitionBy(day).parquet(f"{target}/run={number}")

    stream = spark.readStream.schema(schema).parquet(source)
    stream.writeStream.foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()


def current(spark: SparkSession, target: str, key: str, order: str) -> DataFrame:
    """The newest row of every key over all batches."""
    rows = spark.read.parquet(target)
    columns = [c for c in rows.columns if c not in (key, "run", "batch")]
    return rows.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(order, "run")).alias("x")).select(key, "x.*")


def ingest_latest(spark: SparkSession, source: str, root: str, state: str, schema: str, key: str, order: str, buckets: int = keyed.BUCKETS) -> None:
    """Merges the files of `source` that earlier runs have not seen into the table of latest rows under `root`: only the buckets of keys that have
    arrived are read and written. A retried batch has the number that it had, and changes nothing if it was merged."""
    stream = spark.readStream.schema(schema).parquet(source)
    merge = lambda batch, number: keyed.merge(batch, number, root, key, order, buckets) and None
    stream.writeStream.foreachBatch(merge).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
