"""Exact dedup with an extendible-hash index on shared files (operator 9).

A document's key is a 64-bit hash of its normalised text. The directory says which bucket owns which range of keys: it
doubles, splitting a bucket by the next leading bit of the keys, until none holds more than `capacity` texts or `size` bytes of
them. It starts at the depth that the whole table asks for, and jobs count the overfull buckets alone, so the driver holds those
few and not the directory's other entries, which follow from the depth.

Every batch of rows is first reduced to its distinct texts, so a text that fills a third of the table reaches its bucket as a
few rows. Owner tasks each get a range of keys, whole buckets, and group their rows by key and bytes; texts that share a key form a
chain. The index (owner, bucket, key, chain, text_sha256, keep_id, group_size, text) is written to the shared folder as Parquet, and
rows are resolved against it by key and, within a chain, by text digest; digests with very many rows are broadcast.

Defined results: a null text counts as empty, and empty texts are equal; repeated rows count as copies; of equal texts the
largest doc_id stays, and a null doc_id only where all are null; texts of any length are compared whole (a very long one takes some
five times its bytes in a task); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricehist.functions.shared import spread_join
from pricehist.llm.common import cut, hand_back, partitions, stored

#: Distinct texts, and their bytes, that a bucket may hold.
CAPACITY, SIZE = 50_000, 64 << 20
#: Leading bits of a key that a bucket's range can be told by.
MOST_BITS = 62


def normalised(text: object) -> bytes:
    """A-Z lower-cased and nothing else, in UTF-8; a null text as an empty one."""
    return text.encode("utf-8", "replace").lower() if isinstance(text, str) else b""


def key_of(text: bytes) -> int:
    k = xxhash.xxh64_intdigest(text)
    return k - (1 << 64) if k >> 63 else k


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, key, text_sha256, bytes of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(key_of(t), hashlib.sha256(t).hexdigest(), len(t)) for t in map(normalised, b.column(1).to_pylist())]
            made = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.int64()), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), *made], names=["doc_id", "key", "text_sha256", "bytes"])
        hand_back()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, key long, text_sha256 string, bytes long")


def prefix(key: Column, bits: int) -> Column:
    return F.shiftrightunsigned(key, 64 - bits) if bits else F.lit(0).cast("long")


@dataclass
class Directory:
    """Buckets of keys: those of `depth` leading bits, and at each deeper level what has split."""

    depth: int
    splits: dict[int, np.ndarray] = field(default_factory=dict)  # level -> prefixes of this many bits that have split

    def bucket(self, key: np.ndarray) -> np.ndarray:
        """Where each key's bucket begins: the first MOST_BITS bits of its smallest possible key."""
        k = key.astype(np.int64).view(np.uint64)
        level = np.full(len(k), self.depth)
        for d in sorted(self.splits):
            at = level == d
            at[at] = np.isin(k[at] >> np.uint64(64 - d) if d else np.zeros(at.sum(), np.uint64), self.splits[d])
            level[at] = d + 1
        top = k >> np.uint64(64 - MOST_BITS)
        low = (MOST_BITS - level).astype(np.uint64)
        return (top >> low << low).astype(np.int64)


def directory(keys: DataFrame, capacity: int, size: int, least: int = 1) -> Directory:
    """keys: key and bytes of distinct texts, a checkpoint. Every round splits the buckets that are overfull by one bit more. least: of
    buckets, so that owners get about the same number of them."""
    all_of = keys.agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes")).first()
    need = max(all_of["n"] / capacity, (all_of["bytes"] or 0) / size, least)
    out = Directory(min(MOST_BITS, max(0, math.ceil(math.log2(need)))))
    left, level = keys, out.depth
    while level < MOST_BITS:
        p = prefix(F.col("key"), level)
        over = left.groupBy(p.alias("p")).agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("b"), F.count_distinct("key").alias("k"))
        # A bucket of one key (a chain, or one long text) cannot split.
        found = [r["p"] for r in over.filter("k > 1").filter((F.col("n") > capacity) | (F.col("b") > size)).select("p").collect()]
        if not found:
            break
        out.splits[level] = np.array(found, np.uint64)
        left = left.filter(p.isin(found)) if len(found) < 500 else left
        level += 1
    return out


def distinct_in_batches(docs: DataFrame, buckets: Directory, owners: int) -> DataFrame:
    """owner, bucket, key, text, keep_id, n: each batch's rows of one text become one, so that copies do not travel.

    An owner has the buckets that begin in its part of the whole range of keys."""
    kinds = {"owner": pa.int32(), "bucket": pa.int64(), "key": pa.int64(), "text": pa.string(), "keep_id": pa.int64(), "n": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: dict[bytes, list] = {}
            for doc, t in zip(b.column(0).to_pylist(), map(normalised, b.column(1).to_pylist()), strict=True):
                x = found.get(t)
                if x is None:
                    found[t] = [key_of(t), doc, 1]
                else:
                    x[1] = doc if x[1] is None else x[1] if doc is None else max(x[1], doc)
                    x[2] += 1
            key, keep, n = zip(*found.values(), strict=True)
            bucket = buckets.bucket(np.array(key, np.int64))
            owner = (bucket.astype(float) / 2.0**MOST_BITS * owners).astype(np.int64)
            columns = [owner, bucket, key, [t.decode() for t in found], keep, n]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds.values(), strict=True)], names=list(kinds))
        hand_back()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "owner int, bucket long, key long, text string, keep_id long, n long")


def build_index(docs: DataFrame, rows: DataFrame, capacity: int = CAPACITY, size: int = SIZE) -> DataFrame:
    """The index of docs (doc_id, text), written to the shared folder and read again. rows: digests(docs), a checkpoint."""
    texts_of = cut(rows.groupBy("key", "text_sha256").agg(F.max("bytes").alias("bytes")))
    total = texts_of.agg(F.sum("bytes")).first()[0] or 0
    owners = max(partitions(docs.sparkSession), math.ceil(total / size))
    owned = distinct_in_batches(docs, directory(texts_of, capacity, size, 4 * owners), owners).repartitionById(owners, "owner")
    groups = owned.groupBy("owner", "bucket", "key", "text").agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("group_size"))
    chained = groups.withColumn("text_sha256", F.sha2("text", 256)).selectExpr("*", "row_number() OVER (PARTITION BY owner, bucket, key ORDER BY text_sha256) - 1 AS chain")
    return stored(chained, "extendible")


def dedup(docs: DataFrame, capacity: int = CAPACITY, size: int = SIZE) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row."""
    rows = stored(digests(docs), "digests")
    index = build_index(docs, rows, capacity, size).selectExpr("struct(key, text_sha256) AS k", "keep_id", "group_size", "group_size AS n")
    found = spread_join(rows.selectExpr("struct(key, text_sha256) AS k", "doc_id"), index, "k")
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "k.text_sha256")
