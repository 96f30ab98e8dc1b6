"""A table of the latest row of every key (T1), into which batches are merged by the buckets of keys that they touch.

Rows lie in folders by bucket (a hash of the key); a release of `publish` lists the folder of every bucket. A merge reads and writes the
buckets that its batch touches, and then adds one release, so readers see the table before or after a batch, whole; untouched
buckets stay the files they are. One writer at a time is assumed, as a stream is."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricehist.functions.shared import written
from pricehist.sources import publish

#: Buckets of keys, which a table keeps for good.
BUCKETS = 256
HELD = ("_bucket", "_batch")


def _listed(spark: SparkSession, root: str) -> tuple[int, dict[int, str]]:
    """The number of the last batch (-1 before the first) and the folder of every bucket that has rows: at most as many as there are buckets."""
    active = publish.registry(spark, root).filter("is_active").first()
    if active is None:
        return -1, {}
    return int(active["model_version"]), {r["bucket"]: r["folder"] for r in spark.read.parquet(f"{root}/{active['folder']}").collect()}


def _rows(spark: SparkSession, root: str, folders: dict[int, str]) -> DataFrame:
    return spark.read.parquet(*[f"{root}/{folder}/_bucket={bucket}" for bucket, folder in sorted(folders.items())])


def merge(batch: DataFrame, number: int, root: str, key: str, order: str, buckets: int = BUCKETS) -> list[int]:
    """Merges a batch; returns the touched buckets. Of a key the row with the greatest `order` stays (null is least); of equals that of the
    later batch, then the greatest in its other columns, in the order of their names.

    number: batches count upwards; one that was merged already changes nothing, nor does an empty one, nor does one that fails before its
    release. A null key is a key. Columns called _bucket or _batch are an error. A batch has the columns of the first one."""
    if taken := {c.lower() for c in batch.columns} & set(HELD):
        raise ValueError(f"columns {sorted(taken)} are the table's own")
    spark = batch.sparkSession
    last, folders = _listed(spark, root)
    if number <= last:
        return []
    rest = sorted(c for c in batch.columns if c not in (key, order))
    newest = F.max(F.struct(order, "_batch", *rest)).alias("_x")
    fresh = batch.withColumn("_batch", F.lit(number).cast("long")).groupBy(key).agg(newest).select(key, "_x.*")
    fresh = written(fresh.withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")), "batch")
    touched = sorted(r["_bucket"] for r in fresh.select("_bucket").distinct().collect())
    if not touched:
        return []
    rows, known = fresh.drop("_bucket"), {b: folders[b] for b in touched if b in folders}
    if known:
        rows = rows.unionByName(_rows(spark, root, known)).groupBy(key).agg(newest).select(key, "_x.*")
    rows = rows.withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    # Ranges of buckets and keys: a task writes few files, and a bucket with many rows is written by several tasks.
    folder = f"buckets/{number:012d}-{publish.uuid.uuid4().hex}"
    rows.repartitionByRange("_bucket", key).write.partitionBy("_bucket").parquet(f"{root}/{folder}")
    folders |= dict.fromkeys(touched, folder)
    publish.release(spark.createDataFrame(sorted(folders.items()), "bucket int, folder string").coalesce(1), f"{number:012d}", root)
    return touched


def latest(spark: SparkSession, root: str) -> DataFrame:
    """The latest row of every key. An error before the first batch with rows, as there are no columns yet."""
    folders = _listed(spark, root)[1]
    if not folders:
        raise ValueError(f"no batch under {root}")
    return _rows(spark, root, folders).drop(*HELD)


def vacuum(spark: SparkSession, root: str) -> list[str]:
    """Deletes the bucket folders that the active release does not name, and returns them. Readers of older releases must be done."""
    used = set(_listed(spark, root)[1].values())
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/buckets")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    old = [x.getPath() for x in fs.listStatus(path)] if fs.exists(path) else []
    old = [x for x in old if f"buckets/{x.getName()}" not in used]
    for x in old:
        fs.delete(x, True)
    return sorted(f"buckets/{x.getName()}" for x in old)
