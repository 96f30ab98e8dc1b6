"""Exact top-k search by inner product with norm buckets (operator 10).

Vectors are ordered by length and cut into buckets of bounded size. The bucket of the longest vectors is searched first, then rounds
of 1, 2, 4, ... further ones. After each round a query knows its k-th best so far, and with it how long a vector must be to
reach that score at all: buckets whose longest vector is shorter are never sent to it, and most queries are done early. Queries that
are not are put into classes by that length and these into blocks, so that a bucket goes only to the blocks that still need it.

Where a block meets a bucket, the bucket's longest vector turns the score that a query has to reach into a threshold on the cosine.
Over 1 the bucket is skipped; with a high one, vectors whose coordinate at the query's largest one lies outside the range that such a
cosine allows are left out, else those too short for the score; products of what is left are computed exactly, and the best k are
merged with those of the rounds before.

The driver holds one length for each bucket of some 16,000 vectors.

Defined results: null vectors and vectors with null or non-finite components take no part; a query is compared with vectors
of its own number of components; repeated rows are candidates each, rows with the query's own id never; a repeated query id
is answered once, with its smallest vector; equal scores go by vec_id; an empty table gives no rows; very long vectors only make
their buckets larger in bytes; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pricehist.llm.common import cut

QUERY_BLOCK, BUCKET = 4_096, 16_384
#: Classes of queries by the length that they still need.
CLASSES = 64
#: Cosine from which coordinates prune better than lengths.
STEEP = 0.6
PAIR = "query_id long, vec_id long, score long"


def quantised(df: DataFrame, scale: int = 64) -> DataFrame:
    """vec_id, vec (floor(scale * x) of every component), size, square (squared length)."""
    fit = "embedding IS NOT NULL AND NOT exists(embedding, x -> x IS NULL OR isnan(x) OR abs(x) = double('infinity'))"
    v = df.filter("vec_id IS NOT NULL").filter(fit).selectExpr("vec_id", f"transform(embedding, x -> double(floor({scale} * double(x)))) AS vec")
    return v.selectExpr("vec_id", "vec", "size(vec) AS size", "aggregate(vec, double(0), (a, x) -> a + x * x) AS square")


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= least)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))][:k]


def search(queries: pd.DataFrame, bucket: pd.DataFrame, k: int) -> pd.DataFrame:
    """The best k of a bucket for each query, but for those that cannot be among its best k of all. queries: query_id, vec, square,
    least and last (score and id of its k-th answer so far; least is null before it has one)."""
    if not len(queries) or not len(bucket):
        return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
    bucket = bucket.sort_values(["square", "vec_id"], ascending=[False, True])
    ids, c, length = bucket["vec_id"].to_numpy(), np.stack(bucket["vec"].to_numpy()), np.sqrt(bucket["square"].to_numpy())
    q, qlen = np.stack(queries["vec"].to_numpy()), np.sqrt(queries["square"].to_numpy())
    least, last = queries["least"].to_numpy(float), queries["last"].to_numpy(np.int64)
    exact = float(qlen.max()) * float(length.max()) < 2**52
    if not exact:
        c, q = c.astype(np.int64), q.astype(np.int64)
        least = least - np.abs(least) * 1e-15  # scores so large are not exact as doubles: nothing is left out for its id
    unit = c / np.maximum(length, 1e-300)[:, None]
    out = []
    for lo in range(0, len(q), 256):
        part = q[lo : lo + 256]
        products = None
        for i in range(len(part)):
            own, theta, n = int(queries["query_id"].iloc[lo + i]), least[lo + i], qlen[lo + i]
            keep = None
            if theta == theta and theta > 0:
                bound = n * length[0]
                if bound * (1 + 1e-9) < theta:
                    continue  # the whole bucket is too short
                t = min(1.0, theta / bound)
                if t >= STEEP:
                    f = int(np.abs(part[i]).argmax())
                    x = part[i, f] / n
                    wide = np.sqrt(max(0.0, (1 - t * t) * (1 - x * x))) + 1e-9
                    low, high = x * t - wide, (1.0 if x >= t else x * t + wide)
                    if x < 0:
                        low, high = (-1.0 if -x >= t else x * t - wide), x * t + wide
                    keep = np.flatnonzero((unit[:, f] >= low - 1e-9) & (unit[:, f] <= high + 1e-9))
                else:
                    keep = np.arange(int(np.searchsorted(-length, -theta / n * (1 - 1e-9), side="right")))
            if keep is not None and len(keep) < len(ids) // 4:
                s, some = c[keep] @ part[i], ids[keep]
            else:
                if products is None:
                    products = part @ c.T
                s, some = products[i], ids
            if theta == theta:
                at = np.flatnonzero(((s > theta) | ((s == theta) & ((some < last[lo + i]) | (not exact)))) & (some != own))
            else:
                at = np.flatnonzero(some != own)
            at = at[best(some[at], s[at], k)]
            out.append(pd.DataFrame({"query_id": own, "vec_id": some[at], "score": s[at].astype(np.int64)}))
    return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")


def _asked(found: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """queries with least and last, where k answers are found, and reach: the shortest length that can still matter. found: answers so
    far, with rank."""
    kth = found.filter(F.col("rank") == k).select("query_id", F.col("score").cast("double").alias("least"), F.col("vec_id").alias("last"))
    reach = F.coalesce(F.when(F.col("least") > 0, F.col("least") / F.sqrt("square") * (1 - 1e-9)), F.lit(0.0))
    return queries.join(kth, "query_id", "left").withColumns({"reach": reach, "last": F.coalesce("last", F.lit(0).cast("long"))})


def _blocks(asked: DataFrame, block_rows: int) -> tuple[DataFrame, list[tuple[float, int]]]:
    """asked with block, and the shortest reach and the end of the blocks of each class. Queries are put into at most CLASSES classes at
    quantiles of reach, and those of one class are dealt to blocks of about block_rows by their ids."""
    blocks = -(-asked.count() // block_rows)
    share = [k / min(blocks, CLASSES) for k in range(1, min(blocks, CLASSES))]
    bounds = sorted(set(asked.select(F.percentile_approx("reach", share, 1000)).first()[0])) if share else []
    place = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda x: x < F.col("reach"))) if bounds else F.lit(0)
    asked = cut(asked.withColumn("class", place))
    rows = {r["class"]: r for r in asked.groupBy("class").agg(F.min("reach").alias("reach"), F.count(F.lit(1)).alias("n")).collect()}
    end, many, classes = 0, {}, []
    for c in sorted(rows):
        many[c] = end, -(-rows[c]["n"] // block_rows)
        end += many[c][1]
        classes.append((rows[c]["reach"], end))
    deal = F.lit(0)
    for c, (first, n) in many.items():
        deal = F.when(F.col("class") == c, first + F.pmod(F.xxhash64("query_id"), F.lit(n)).cast("int")).otherwise(deal)
    return asked.withColumn("block", deal), classes


def top_k(vectors: DataFrame, k: int = 20, every: int = 20, bucket_rows: int = BUCKET, block_rows: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: rows whose id is divisible by `every` against all rows."""
    spark = vectors.sparkSession
    all_rows = cut(quantised(vectors))
    buckets = max(1, -(-all_rows.count() // bucket_rows))
    # Partitions of the ordered rows are the buckets; equal lengths are split by id.
    ordered = cut(all_rows.repartitionByRange(buckets, F.desc("square"), F.asc("vec_id")).withColumn("bucket", F.spark_partition_id()))
    longest = {r["bucket"]: r["x"] for r in ordered.groupBy("bucket").agg(F.sqrt(F.max("square")).alias("x")).collect()}
    same = all_rows.filter(F.pmod("vec_id", F.lit(every)) == 0).groupBy("vec_id", "size").agg(F.min("vec").alias("vec"))
    square = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)
    queries = cut(same.select(F.col("vec_id").alias("query_id"), "size", "vec", square.alias("square")))
    best_of = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found, asked, done, width = None, queries.selectExpr("*", "double(null) AS least", "0L AS last", "0D AS reach"), 0, 1
    end = 1 + max(longest, default=-1)
    while done < end:
        now = {b: x for b, x in longest.items() if done <= b < done + width}
        asked, classes = _blocks(asked, block_rows)
        # Blocks are in order of reach: those that need a bucket are the first ones.
        last_block = {b: max((end - 1 for reach, end in classes if reach <= x), default=-1) for b, x in now.items()}
        plan = [(b, x, last_block[b]) for b, x in now.items() if last_block[b] >= 0]
        if plan:
            wanted = F.broadcast(spark.createDataFrame(plan, "bucket int, longest double, last_block int"))
            left = asked.join(wanted, (asked["reach"] <= wanted["longest"]) & (asked["block"] <= wanted["last_block"]))
            left = left.select("query_id", "vec", "square", "least", "last", F.col("size").alias("q_size"), F.col("block").alias("q_block"), F.col("bucket").alias("q_bucket"))
            right = ordered.filter(F.col("bucket").between(done, done + width - 1)).join(wanted, "bucket").withColumn("block", F.explode(F.sequence(F.lit(0), "last_block")))
            right = right.select("vec_id", "vec", "size", "square", "bucket", "block")
            pairs = left.groupBy("q_block", "q_bucket", "q_size").cogroup(right.groupBy("block", "bucket", "size"))
            new = pairs.applyInPandas(lambda a, b: search(a, b, k), PAIR)
            both = new if found is None else found.drop("rank").unionByName(new)
            found = cut(both.withColumn("rank", F.row_number().over(best_of)).filter(F.col("rank") <= k))
        done, width = done + width, 2 * width
        if done < end:
            # Queries that no later bucket can help are answered.
            to_come = max(x for b, x in longest.items() if b >= done)
            asked = _asked(found, queries, k).filter(F.col("reach") <= to_come)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return found.select("query_id", "rank", "vec_id", "score")
