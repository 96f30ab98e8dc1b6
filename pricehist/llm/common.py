"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import re
import uuid
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricehist.functions.shared import cut, shared_dir

__all__ = ["bounded", "crc", "cut", "hand_back", "label_sample", "partitions", "shared_dir", "slices", "stored", "table", "texts"]

#: Unicode White_Space, as the tokenizers' regex engine understands \s.
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
#: Separators that str.split() knows but White_Space does not have.
INFO_SEPARATORS = re.compile("[\x1c-\x1f]")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet in the shared folder and read again."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def crc(doc_id: Column) -> Column:
    """crc32 of the id as text."""
    return F.crc32(doc_id.cast("string").cast("binary"))


def bounded(df: DataFrame, rows: int, seed: int, *keys: str, known: int | None = None) -> DataFrame:
    """At most `rows` rows of df (all, if it has no more), the same ones in every run: those with the smallest 64-bit hashes of
    the keys. known: a row count that need not be counted again.

    Rows far from the smallest hashes are left out by themselves, so that about 1.2 times `rows` rows, whatever the table's
    size, are sorted in the end."""
    n = df.count() if known is None else known
    if n <= rows:
        return df
    rank = F.xxhash64(F.lit(seed), *[F.col(k) for k in keys])
    # A share of the hash's whole range; it does not fall to nothing however large n is.
    most = -(2**63) + int(2**64 * min(1.0, 1.2 * rows / n + 40 * rows**0.5 / n)) - 1
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= F.lit(most)).orderBy("_rank", *keys).limit(rows).drop("_rank")


def label_sample(labels: DataFrame, label: str, keep: Column | None, rows: int, seed: int) -> DataFrame:
    """doc_id and y of at most `rows` different labels for which keep (a condition on doc_id) holds; null labels are left out. It is
    small enough to broadcast, whatever the size of labels."""
    known = labels.filter(F.col(label).isNotNull())
    known = known.filter(keep) if keep is not None else known
    return bounded(known.select("doc_id", F.col(label).cast("int").alias("y")).distinct(), rows, seed, "doc_id", "y")


def slices(column, rows: int = 256, size: int = 1 << 20):
    """(from, to) ranges of a batch of texts with at most `rows` texts and, but for a single longer text, `size` characters, so
    that scratch arrays stay small."""
    a = n = 0
    for b, t in enumerate(column):
        if b > a and (b - a == rows or n + len(t) > size):
            yield a, b
            a, n = b, 0
        n += len(t)
    if a < len(column):
        yield a, len(column)


def texts(series) -> list[str]:
    """Strings of a pandas column, null as empty."""
    return [t if isinstance(t, str) else "" for t in series]


@lru_cache(maxsize=1)
def _libc():
    try:
        return ctypes.CDLL("libc.so.6")
    except OSError:
        return None


def hand_back() -> None:
    """Gives memory that a partition's scratch arrays no longer use back to the system: Python workers live on and run the next
    stage's tasks beside the executor."""
    pa.default_memory_pool().release_unused()
    if libc := _libc():
        libc.malloc_trim(0)
