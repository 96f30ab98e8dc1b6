"""Removal of long repeated passages by a distributed difference-cover suffix sort (operator 11).

A byte goes if a string of `length` bytes that covers it also starts anywhere else, in the same document or another. Two exact reductions
come before the sort, since a suffix sort of a whole corpus would shuffle many times its size:

1. Every window of `length` bytes is tied to the anchor in it: of its grams of half the length, the one with the least hash (the last of
   equals). Equal windows have equal anchors, so windows whose anchor is nowhere else are settled. Neighbouring windows with one
   anchor are a piece.
2. Pieces of equal content are one class. An anchor with a single class is settled: all windows of a class with two or more pieces
   repeat. One piece stands for each class of the other anchors, and of its windows those whose hash is found once are settled.
   The rest are runs of windows, of which equal ones are again one class with one that stands for it.

What is left is sorted: positions 1 and 2 modulo 3 are the sample; their triples of strings (a third of the depth) are sorted and
named by rank, and triples of these names, a third of the depth apart, are sorted and named again. As only `length` bytes matter, two levels
are deep enough: the last names order the sample by all but two bytes of a window. The remaining suffixes take one or two leading
bytes and the name of the sampled suffix that follows, are merged with the sample in one order, and windows next to each other are
compared. Hashes only rule windows out (unequal hashes are unequal strings), and contents are compared by 128-bit digests; every
window of a class that is alone is found by the sort.

Defined results: null and empty texts, and those shorter than `length`, lose nothing; texts of any length are worked on whole, in
blocks; repeated rows and rows with null or repeated ids are documents of their own, so that all their passages repeat; an empty table
gives no rows; other columns are ignored. No key is sent to one task as a whole: hot anchors and windows are
found in a sample and dealt to many tasks, hot contents and names are counted first and broadcast, and equal windows may lie in several partitions of the last order, whose borders the driver compares (two rows a partition)."""

from __future__ import annotations

import gc
import hashlib
import uuid
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pricehist.functions.shared import spread_join
from pricehist.llm.common import cut, hand_back, shared_dir, slices

LENGTH = 200
#: Bytes worked on at once.
BLOCK = 1 << 18
#: Rows that hot keys are looked for in (about as many), the most hot keys there can be, and the parts that each is dealt to.
SAMPLE, HOT_KEYS, SALTS = 1_000_000, 4_000, 1_024
#: Of the rolling hash; odd, so that it has an inverse modulo 2^64.
BASE = 0x9E3779B97F4A7C15


class Scratch:
    """Tables of one run in the shared folder, which go as soon as the tables made from them are written."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.root = spark, f"{shared_dir(spark)}/suffix-{uuid.uuid4().hex}"

    def stored(self, df: DataFrame, name: str, *done: str) -> DataFrame:
        """df, written and read again. done: tables that are not needed any more. Shuffle files of what df was made from go as well: Spark's
        cleaner deletes them when the driver has collected its garbage, which an idle driver may not do for long."""
        df.write.option("compression", "zstd").parquet(f"{self.root}/{name}")
        jvm = self.spark.sparkContext._jvm
        for x in done:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{x}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        gc.collect()
        jvm.System.gc()
        return self.spark.read.parquet(f"{self.root}/{name}")


class Rolling:
    """Hashes of all strings of some length in a block, from sums modulo 2^64; mixed, as the low bits of such sums are weak."""

    def __init__(self, most: int) -> None:
        ones = np.ones(most, np.uint64)
        ones[0] = 1
        power, inverse = ones.copy(), ones.copy()
        power[1:], inverse[1:] = BASE, pow(BASE, -1, 1 << 64)
        self.power, self.inverse = np.cumprod(power), np.cumprod(inverse)

    def __call__(self, block: np.ndarray, width: int) -> np.ndarray:
        sums = np.zeros(len(block) + 1, np.uint64)
        np.cumsum((block.astype(np.uint64) + np.uint64(1)) * self.power[: len(block)], out=sums[1:])
        h = sums[width:] - sums[:-width]
        h *= self.inverse[: len(h)]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
        return h


def last_minimum(h: np.ndarray, width: int) -> np.ndarray:
    """For every run of `width` values the place of its least one, of equal ones the last."""
    at, w = np.arange(len(h), dtype=np.int32), 1
    while w < width:
        step = min(w, width - w)
        a, b = at[:-step], at[step:]
        at = np.where(h[b] <= h[a], b, a)
        w += step
    return at


def pieces_of(block: np.ndarray, ends: np.ndarray, length: int, rolling: Rolling) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows and hash of the anchor of each piece of a block whose documents end at `ends`."""
    n = len(block) - length + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    gram = length // 2
    h = rolling(block, gram)
    at = last_minimum(h, length - gram + 1)
    document = np.searchsorted(ends, np.arange(n), "right")
    whole = np.arange(n) + length <= ends[document]
    first = np.ones(n, bool)
    first[1:] = (at[1:] != at[:-1]) | (document[1:] != document[:-1])
    first &= whole
    starts = np.flatnonzero(first)
    # A piece ends where the next begins or where its document has no more whole windows.
    last = np.flatnonzero(whole & np.append(first[1:] | ~whole[1:], True))
    return starts, last - starts + 1, h[at[starts]].view(np.int64)


def anchors_of(docs: DataFrame, length: int) -> DataFrame:
    """row, start, n, anchor of every piece of docs (row, text as binary)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = Rolling(BLOCK + length)
        for b in batches:
            rows, column = b.column(0).to_numpy(), b.column(1).to_pylist()
            for x, y in slices(column, 4096, BLOCK):
                text, ends = b"".join(column[x:y]), np.cumsum([len(t) for t in column[x:y]])
                begins = np.concatenate([[0], ends[:-1]])
                for a in range(0, len(text), BLOCK):
                    block = np.frombuffer(text[a : a + BLOCK + length - 1], np.uint8)
                    start, n, anchor = pieces_of(block, np.minimum(ends[ends > a] - a, len(block)), length, rolling)
                    doc = np.searchsorted(ends, start + a, "right")
                    yield pa.RecordBatch.from_arrays([pa.array(rows[x:y][doc]), pa.array((start + a - begins[doc]).astype(np.int32)),
                        pa.array(n.astype(np.int32)), pa.array(anchor)], names=["row", "start", "n", "anchor"])
        hand_back()

    return docs.select("row", "text").mapInArrow(run, "row long, start int, n int, anchor long")


def repeated(rows: DataFrame, key: str, total: int) -> DataFrame:
    """The rows whose key another row has too, of `total` rows, no two of which are alike; key is never null.

    Rows are dealt by key once and counted where they lie. Hot keys, found in a sample beforehand, are dealt to many tasks: a key that
    is seen twice in the sample repeats, so that its rows need no count."""
    dealt = F.xxhash64(*rows.columns)
    sample = rows.filter(dealt.between(-(2**63), -(2**63) + int(2**64 * min(1.0, SAMPLE / max(1, total))) - 1))
    hot = sample.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= max(2, min(SAMPLE, total) // HOT_KEYS)).select(key)
    salted = rows.join(F.broadcast(cut(hot).withColumn("hot", F.lit(True))), key, "left").withColumn("salt", F.when(F.col("hot"), F.pmod(dealt, F.lit(SALTS)).cast("int")))
    counted = salted.withColumn("of", F.count(F.lit(1)).over(Window.partitionBy(key, "salt")))
    return counted.filter("salt IS NOT NULL OR of > 1").select(rows.columns)


def segments_of(docs: DataFrame, marked: DataFrame, length: int) -> DataFrame:
    """row, begin, bytes and the pieces (start, n, anchor, digest of their content) of each stretch of neighbouring pieces."""
    kinds = pa.schema([("row", pa.int64()), ("begin", pa.int32()), ("bytes", pa.binary()), ("start", pa.list_(pa.int32())), ("n", pa.list_(pa.int32())),
        ("anchor", pa.list_(pa.int64())), ("digest", pa.list_(pa.binary()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                out: list[list] = [[] for _ in kinds]
                for row, text, found in zip(*(c.to_pylist() for c in b.slice(at, 256).columns[:2]), b.slice(at, 256).column(2), strict=True):
                    start, n, anchor = (found.values.field(k).to_numpy() for k in range(3))
                    order = np.argsort(start)
                    start, n, anchor = start[order], n[order], anchor[order]
                    breaks = np.flatnonzero(start[1:] != (start + n)[:-1]) + 1
                    for s, k, h in zip(np.split(start, breaks), np.split(n, breaks), np.split(anchor, breaks), strict=True):
                        digest = [hashlib.blake2b(text[x : x + y + length - 1], digest_size=16).digest() for x, y in zip(s.tolist(), k.tolist(), strict=True)]
                        for column, value in zip(out, (row, int(s[0]), text[s[0] : s[-1] + k[-1] + length - 1], s, k, h, digest), strict=True):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds.types, strict=True)], schema=kinds)
        hand_back()

    return docs.join(marked.groupBy("row").agg(F.collect_list(F.struct("start", "n", "anchor")).alias("found")), "row").select("row", "text", "found").mapInArrow(
        run, "row long, begin int, bytes binary, start array<int>, n array<int>, anchor array<long>, digest array<binary>")


def contents_of(segments: DataFrame, classes: DataFrame, length: int) -> DataFrame:
    """class, bytes of the piece that stands for each class."""
    wanted = classes.groupBy("row").agg(F.collect_list(F.struct("class", "start", "n")).alias("wanted"))
    near = segments.select("row", "begin", "bytes").join(wanted, "row")
    inside = F.filter("wanted", lambda w: (w.start >= F.col("begin")) & (w.start + w.n + length - 1 <= F.col("begin") + F.length("bytes")))
    return near.select("begin", "bytes", F.inline(inside)).select("class", F.expr(f"substring(bytes, start - begin + 1, n + {length - 1})").alias("bytes"))


def window_hashes(contents: DataFrame, length: int) -> DataFrame:
    """class, offset, hash of every window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = Rolling(BLOCK + 4 * length)
        for b in batches:
            classes, column = b.column(0).to_numpy(), b.column(1).to_pylist()
            for x, y in slices(column, 4096, BLOCK):
                sizes = np.array([len(t) for t in column[x:y]])
                n, begins = sizes - length + 1, np.cumsum(sizes) - sizes
                offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                h = rolling(np.frombuffer(b"".join(column[x:y]), np.uint8), length)[np.repeat(begins, n) + offset]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(classes[x:y], n)), pa.array(offset.astype(np.int32)), pa.array(h.view(np.int64))], names=["class", "offset", "hash"])
        hand_back()

    return contents.select("class", "bytes").mapInArrow(run, "class long, offset int, hash long")


def named(rows: DataFrame, key: str, scratch: Scratch, table: str) -> DataFrame:
    """rows (a table) with `name`, the rank of their key in the sorted order of all different keys; ranks have gaps."""
    different = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_of")).orderBy(key)
    return spread_join(rows, scratch.stored(different.withColumn("name", F.monotonically_increasing_id()), table), key, "_of")


def adjacent_equals(rows: DataFrame, keys: list[str], tie: str) -> DataFrame:
    """The rows that have a neighbour with equal keys in the order of keys and tie. Equal keys may lie in several partitions."""
    ordered = cut(rows.repartitionByRange(*keys, tie).sortWithinPartitions(*keys, tie))
    first, last = F.min(F.struct(*keys, tie)), F.max(F.struct(*keys, tie))
    ends = ordered.groupBy(F.spark_partition_id().alias("part")).agg(first.alias("first"), last.alias("last")).orderBy("part").collect()
    joints = [(x["part"], y["part"]) for x, y in pairwise(ends) if all(x["last"][k] == y["first"][k] for k in keys)]
    after, before = {x for x, _ in joints}, {y for _, y in joints}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, twin = TaskContext.get().partitionId(), None, False
        for b in batches:
            if not b.num_rows:
                continue
            equal = np.ones(b.num_rows, bool)  # to the row before
            for k in keys:
                column = b.column(k)
                equal[1:] &= pc.equal(column.slice(1), column.slice(0, b.num_rows - 1)).to_numpy(zero_copy_only=False)
            equal[0] = part in before if held is None else all(b.column(k)[0] == held.column(k)[0] for k in keys)
            if held is not None and (twin or equal[0]):
                yield held.select([tie])
            twins = equal.copy()
            twins[:-1] |= equal[1:]
            held, twin = b.slice(b.num_rows - 1), bool(equal[-1])
            yield b.select([tie]).filter(pa.array(twins & (np.arange(b.num_rows) < b.num_rows - 1)))
        if held is not None and (twin or part in after):
            yield held.select([tie])

    return ordered.mapInArrow(run, f"{tie} long")


def runs_of(contents: DataFrame, windows: DataFrame, length: int) -> DataFrame:
    """class, offset, n, bytes, digest of each run of neighbouring windows; contents: class, bytes; windows: class, offset."""
    kinds = pa.schema([("class", pa.int64()), ("offset", pa.int32()), ("n", pa.int32()), ("bytes", pa.binary()), ("digest", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in kinds]
            for k, text, offsets in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                at = np.sort(offsets.values.to_numpy())
                for x in np.split(at, np.flatnonzero(at[1:] != at[:-1] + 1) + 1):
                    part = text[x[0] : x[-1] + length]
                    for column, value in zip(out, (k, int(x[0]), len(x), part, hashlib.blake2b(part, digest_size=16).digest()), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds.types, strict=True)], schema=kinds)
        hand_back()

    joined = contents.join(windows.groupBy("class").agg(F.collect_list("offset").alias("offsets")), "class").select("class", "bytes", "offsets")
    return joined.mapInArrow(run, "class long, offset int, n int, bytes binary, digest binary")


def sort_windows(texts: DataFrame, length: int, scratch: Scratch) -> DataFrame:
    """class, offset of the windows that are equal to another; texts: a table of class, bytes, offsets (of windows).

    The text is the contents one after the other, each in a place of `stride` bytes."""
    stride, depth = 2 * length // 3 * 3 + 4, (length - 2) // 3 * 3
    part = -(-depth // 9) * 3  # bytes of a first name
    steps, third = (0, min(part, depth - part), depth - part), part // 3

    def place(offset: Column) -> Column:
        return F.pmod(F.col("class") * stride + offset, F.lit(3))

    # The sampled suffixes that begin a window or the two places after it, and the places of their triples.
    leads = F.filter(F.array_distinct(F.flatten(F.transform("offsets", lambda o: F.array(o, o + 1, o + 2)))), lambda o: place(o) > 0)
    places = F.array_distinct(F.flatten(F.transform(leads, lambda o: F.array(*[o + s for s in steps]))))
    triple = F.struct(*[F.substring("bytes", F.col("at") + 1 + k * third, F.lit(third)).alias(f"s{k}") for k in range(3)])
    triples = scratch.stored(texts.select("class", "bytes", F.explode(places).alias("at")).select("class", "at", triple.alias("triple")), "triples")
    first = named(triples, "triple", scratch, "names")
    names = first.groupBy("class").agg(F.map_from_entries(F.collect_list(F.struct("at", "name"))).alias("names"))
    again = names.join(texts.select("class", F.explode(leads).alias("at")), "class")
    triple = F.struct(*[F.element_at("names", F.col("at") + s).alias(f"n{k}") for k, s in enumerate(steps)])
    triples = scratch.stored(again.select("class", "at", triple.alias("triple")), "triples of names", "triples", "names")
    ranks = named(triples, "triple", scratch, "names of names")
    ranks = ranks.groupBy("class").agg(F.map_from_entries(F.collect_list(F.struct("at", "name"))).alias("ranks"))
    # Positions 0 modulo 3 are one before a sampled one, and two before another; a pair of suffixes meets at one common step.
    offset, ahead = F.col("offset"), F.col("ahead")
    meets = F.when(place(offset) == 0, F.array(F.lit(1), F.lit(2))).when(place(offset) == 1, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0), F.lit(2)))
    merged = texts.join(ranks, "class").select("class", "bytes", "ranks", F.explode("offsets").alias("offset")).select("*", F.explode(meets).alias("ahead")).select(
        "ahead", F.substring("bytes", offset + 1, ahead).alias("head"), F.element_at("ranks", offset + ahead).alias("rank"),
        F.substring("bytes", offset + ahead + depth + 1, length - depth - ahead).alias("tail"), (F.col("class") * stride + offset).alias("at"))
    found = scratch.stored(adjacent_equals(merged, ["ahead", "head", "rank", "tail"], "at").distinct(), "equal", "triples of names", "names of names")
    return found.select(F.expr(f"at div {stride}").alias("class"), F.expr(f"CAST(at % {stride} AS INT)").alias("offset"))


def open_windows(contents: DataFrame, length: int) -> DataFrame:
    """class, offset of windows whose hash another window has; contents (class, bytes) is a table, hashed twice rather than written."""
    total = contents.agg(F.sum(F.length("bytes") - (length - 1))).first()[0] or 0
    return repeated(window_hashes(contents, length), "hash", total).select("class", "offset")


def lone_windows(contents: DataFrame, length: int, scratch: Scratch) -> DataFrame:
    """class, offset of the windows of contents (class, bytes; a table of different contents) that are equal to another."""
    runs = scratch.stored(runs_of(contents, open_windows(contents, length), length), "runs", "contents")
    kinds = runs.groupBy("digest").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("class", "offset")).alias("one"))
    kinds = scratch.stored(kinds.withColumn("kind", F.monotonically_increasing_id()), "kinds")
    heads = runs.join(kinds.select("kind", "one.*"), ["class", "offset"]).select(F.col("kind").alias("class"), "bytes")
    heads = scratch.stored(heads, "heads")
    offsets = open_windows(heads, length).groupBy("class").agg(F.collect_list("offset").alias("offsets"))
    found = sort_windows(scratch.stored(heads.join(offsets, "class"), "windows", "heads"), length, scratch)
    at = F.col("offset").alias("at")
    sorted_out = kinds.filter("copies = 1").select(F.col("kind"), "one.*").join(found.select(F.col("class").alias("kind"), at), "kind").select("class", (F.col("offset") + F.col("at")).alias("offset"))
    copied = spread_join(runs, kinds.filter("copies > 1").select("digest", "copies"), "digest", "copies")
    return sorted_out.unionByName(copied.select("class", F.explode(F.expr("sequence(offset, offset + n - 1)")).alias("offset")))


def spans_of(texts: DataFrame, length: int, scratch: Scratch) -> DataFrame:
    """row, spans (arrays of `from` and `to`, in any order) of the windows of texts (row, text; a table) that repeat."""
    anchors = scratch.stored(anchors_of(texts, length), "anchors")
    marked = repeated(anchors, "anchor", anchors.count())
    segments = scratch.stored(segments_of(texts, marked, length), "segments", "anchors")
    pieces = segments.select("row", F.inline(F.arrays_zip("start", "n", "anchor", "digest"))).select("row", "start", "n", "anchor", "digest")
    kinds = pieces.groupBy("digest").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("row", "start", "n", "anchor")).alias("one"))
    classes = scratch.stored(kinds.select("digest", "copies", "one.*", F.monotonically_increasing_id().alias("class")), "classes")
    several = scratch.stored(repeated(classes, "anchor", classes.count()).select("class", "copies", "row", "start", "n"), "several")
    contents = scratch.stored(contents_of(segments, several, length), "contents")
    found = lone_windows(contents, length, scratch).join(several.filter("copies = 1"), "class")
    copied = spread_join(pieces.drop("anchor"), classes.filter("copies > 1").select("digest", "copies"), "digest", "copies")
    spans = copied.selectExpr("row", "start AS `from`", f"start + n + {length - 1} AS `to`").unionByName(
        found.selectExpr("row", "start + offset AS `from`", f"start + offset + {length} AS `to`"))
    spans = spans.groupBy("row").agg(F.collect_list(F.struct("from", "to")).alias("spans"))
    return scratch.stored(spans, "spans", "segments", "classes", "several", "runs", "kinds", "windows", "equal")


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the kept bytes of every row of docs (doc_id, text)."""
    scratch = Scratch(docs.sparkSession)
    texts = scratch.stored(docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"), F.monotonically_increasing_id().alias("row")), "texts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            removed, runs, kept = [], [], []
            for text, spans in zip(b.column(1).to_pylist(), b.column(2), strict=True):
                if not spans.is_valid:
                    removed.append(0), runs.append(0), kept.append(text)
                    continue
                begin, end = (spans.values.field(k).to_numpy() for k in range(2))
                order = np.argsort(begin, kind="stable")
                begin, end = begin[order], np.maximum.accumulate(end[order])
                new = np.flatnonzero(begin[1:] > end[:-1]) + 1
                begin, end = begin[np.append(0, new)], end[np.append(new - 1, -1)]
                removed.append(int((end - begin).sum())), runs.append(len(begin))
                kept.append(b"".join(text[x:y] for x, y in zip([0, *end.tolist()], [*begin.tolist(), len(text)], strict=True)))
            digests = [hashlib.sha256(t).hexdigest() for t in kept]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(len, b.column(1).to_pylist()), pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()),
                pa.array(digests), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])
        hand_back()

    joined = texts.join(spans_of(texts, length, scratch), "row", "left").select(F.col("doc_id").cast("long"), "text", "spans")
    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
