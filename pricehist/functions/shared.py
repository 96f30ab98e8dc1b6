"""Cutting lineage with files that the driver and all executors share, and joins that spread hot keys."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, from spark.checkpoint.dir.

    Only where a session in local mode (as in tests) has none, a temporary folder is set; on a cluster that is an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        own = spark.conf.get("spark.checkpoint.dir", None)
        if own is None and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir is not set; it must name a folder that the driver and all executors share")
        sc.setCheckpointDir(own or tempfile.mkdtemp(prefix="spark-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df, computed once, with its lineage cut by files in the shared folder: it survives the loss of executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """df, computed once and kept as Parquet in the shared folder: like cut(), but columns can be left out when it is read."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def spread_join(rows: DataFrame, keyed: DataFrame, key: str, count: str = "n", most: int = 2_000, total: int | None = None) -> DataFrame:
    """Inner join of rows with keyed, which has one row for each key and says in `count` how many of rows have it.

    Keys of more than a `most`-th of all rows, which are fewer than `most`, are broadcast, so that no task gets all rows of a hot
    key; the others are joined by a shuffle. Both frames are read more than once: they should be tables or checkpoints."""
    if total is None:
        total = keyed.agg(F.sum(count)).first()[0] or 0
    heavy = keyed.filter(F.col(count) * most > total)
    light = rows.join(keyed.drop(count), key)
    if total < most or not heavy.take(1):
        return light
    few = F.broadcast(heavy.drop(count))
    rest = rows.join(F.broadcast(heavy.select(key)), key, "left_anti").join(keyed.filter(F.col(count) * most <= total).drop(count), key)
    return rest.unionByName(rows.join(few, key))
