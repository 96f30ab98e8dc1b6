"""Connected components of a graph given as edges (A1), whole or as more edges come.

Alternating large-star and small-star steps: every step links each node's neighbours to the smallest node it knows, until
all nodes of a component hang on its smallest one. Minima are taken by partial aggregation and joined back; those of hubs are
broadcast to the edges in both steps, so a hub with very many neighbours is neither collected nor sent to one task as a whole.
A graph of at most SMALL different edges is settled by a union-find in one task instead, with the same result."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

from pricehist.functions.shared import cut, spread_join
from pricehist.sources.publish import ranks

#: Edges that one task settles.
SMALL = 100_000


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _large(edges: DataFrame, n: int) -> DataFrame:
    """n: number of edges, each of which is seen upwards once."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count_if(F.col("v") > F.col("u")).alias("n")).filter("n > 0")
    moved = spread_join(both.filter("v > u"), cut(least), "u", total=n)
    return moved.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small(edges: DataFrame) -> DataFrame:
    """edges: a table of large-star's edges, which all point down (u > v)."""
    least = cut(edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")))
    moved = spread_join(edges, least, "u")
    return moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def _settled(edges: DataFrame) -> DataFrame:
    """The stars of a small graph, by a union-find in one task."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        above: dict = {}

        def root(x):
            while (y := above.setdefault(x, x)) != x:
                above[x] = above[y]
                x = above[x]
            return x

        for part in parts:
            for u, v in zip(part["u"].tolist(), part["v"].tolist(), strict=True):
                low, high = sorted((root(u), root(v)))
                above[high] = low
        below = [x for x in above if above[x] != x]
        yield pd.DataFrame({"u": pd.Series(below, dtype=object), "v": pd.Series([root(x) for x in below], dtype=object)})

    return edges.coalesce(1).mapInPandas(run, edges.schema)


def _stars(stars: DataFrame, small: int, most_rounds: int) -> DataFrame:
    before = _mark(stars)
    if before[0] <= small and not isinstance(stars.schema["u"].dataType, (ArrayType, MapType, StructType)):
        return cut(_settled(stars))
    for _ in range(most_rounds):
        stars = cut(_small(cut(_large(stars, before[0]))))
        now = _mark(stars)
        if now == before:
            return stars
        before = now
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60, small: int = SMALL) -> DataFrame:
    """node, component (its smallest node) for every node that has an edge; nodes with edges to themselves alone count too.

    Null ends are ignored. small: edges up to which one task settles the graph; the result does not depend on it."""
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u IS NOT NULL AND v IS NOT NULL")
    pairs = cut(pairs.distinct())
    nodes = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    stars = cut(pairs.filter("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    stars = _stars(stars, small, most_rounds)
    return nodes.join(stars.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left").select("node",
        F.coalesce("component", "node").alias("component"))


def link_more(kept: DataFrame, edges: DataFrame, a: str = "a", b: str = "b", small: int = SMALL) -> DataFrame:
    """node, component, id after more edges: kept (node, component, id; one row a node) is what earlier calls returned, or empty.

    Only the components that new edges touch are linked, as nodes of a graph of their own, and relabelled; all others keep their rows. Components
    are those of one run over all edges. Groups that merge keep the smallest of their ids, so the one that was known first stays; groups
    without an id get the next ones in the order of their components. Null ends are ignored; edges that are known change nothing."""
    pairs = cut(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u IS NOT NULL AND v IS NOT NULL").distinct())
    ends = pairs.select(F.inline(F.expr("array(struct(u AS node, 1 AS nu, 0 AS nv), struct(v AS node, 0 AS nu, 1 AS nv))")))
    ends = ends.groupBy("node").agg(F.sum("nu").alias("nu"), F.sum("nv").alias("nv")).join(kept, "node", "left")
    ends = cut(ends.select("node", "nu", "nv", F.col("component").isNull().alias("new"), F.coalesce("component", "node").alias("label")))
    lifted = spread_join(pairs, ends.filter("nu > 0").select(F.col("node").alias("u"), "nu", F.col("label").alias("x")), "u", "nu")
    lifted = spread_join(cut(lifted.select("v", "x")), ends.filter("nv > 0").select(F.col("node").alias("v"), "nv", F.col("label").alias("y")), "v", "nv")
    linked = connected_components(lifted, "x", "y", small=small).select(F.col("node").alias("label"), F.col("component").alias("into"))
    rows = kept.select("node", F.col("component").alias("label"), "id").unionByName(ends.filter("new").select("node", "label", F.lit(None).cast("long").alias("id")))
    rows = cut(rows)
    # Every touched label with its rows and its id; the smallest id of those that merge stays.
    sizes = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("old"))
    touched = cut(linked.join(sizes, "label"))
    groups = cut(touched.groupBy("into").agg(F.min("old").alias("id")))
    top = rows.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    fresh = ranks(groups.filter("id IS NULL").select("into"), "into").join(F.broadcast(top), F.lit(True)).select("into", (F.col("top") + F.col("rank")).alias("id"))
    named = groups.filter("id IS NOT NULL").select("into", "id").unionByName(fresh)
    changed = cut(touched.join(named, "into").filter("NOT (label <=> into AND old <=> id)").select("label", "into", F.col("id").alias("now"), "n"))
    moved = spread_join(rows, changed, "label").select("node", F.col("into").alias("component"), F.col("now").alias("id"))
    same = rows.join(changed.select("label"), "label", "left_anti").select("node", F.col("label").alias("component"), "id")
    return moved.unionByName(same)
