"""Linkage in batches against linkage of everything, and hubs."""

import random

import pytest

from pricehist.functions.shared import spread_join
from pricehist.operators import components as c

KEPT = "node string, component string, id long"


def groups(edges):
    up = {}

    def top(v):
        while up.setdefault(v, v) != v:
            v = up[v]
        return v

    for a, b in edges:
        if a is not None and b is not None:
            x, y = top(a), top(b)
            up[max(x, y)] = min(x, y)
    return {v: top(v) for v in list(up)}


@pytest.mark.parametrize("seed", [1, 2])
def test_batches_give_the_components_of_one_run(spark, seed):
    draw = random.Random(seed)
    node = lambda: draw.choice(["é", "z", ""]) + str(draw.randrange(60))
    kept, seen, ids = spark.createDataFrame([], KEPT), [], {}
    for batch in range(4):
        edges = [(node(), node()) for _ in range(25)] + [(None, "z1"), ("z2", None)] + seen[:2]
        seen += edges
        kept = c.cut(c.link_more(kept, spark.createDataFrame(edges, "a string, b string"), small=0 if batch == 2 else c.SMALL))
        rows = kept.collect()
        assert len(rows) == len({r["node"] for r in rows}) and {r["node"]: r["component"] for r in rows} == groups(seen)
        now = {r["component"]: r["id"] for r in rows}
        # One id a component, no id twice, and a merged group keeps the smallest id that one of its nodes had.
        assert len({(r["component"], r["id"]) for r in rows}) == len(now) == len(set(now.values()))
        for component in now:
            had = [ids[r["node"]] for r in rows if r["component"] == component and r["node"] in ids]
            assert now[component] == min(had) if had else now[component] not in ids.values()
        ids = {r["node"]: r["id"] for r in rows}


def test_known_edges_and_no_edges_change_nothing(spark):
    edges = spark.createDataFrame([("a", "b"), ("c", "d"), ("e", "e")], "a string, b string")
    kept = c.cut(c.link_more(spark.createDataFrame([], KEPT), edges))
    assert sorted(map(tuple, kept.collect())) == [("a", "a", 1), ("b", "a", 1), ("c", "c", 2), ("d", "c", 2), ("e", "e", 3)]
    for more in (edges, edges.limit(0)):
        assert sorted(c.link_more(kept, more).collect()) == sorted(kept.collect())
    assert c.link_more(kept.limit(0), edges.limit(0)).count() == 0


@pytest.mark.parametrize("high", [True, False])
def test_no_task_gets_a_hub(spark, monkeypatch, high):
    """The hub is the largest or the smallest node of 90 % of 10,000 edges; the rows of the joins are counted by partition."""
    hub = 10**9 if high else -1
    edges = [(hub, i) for i in range(9_000)] + [(i, i + 1) for i in range(20_000, 22_000, 2)]
    worst = []

    def watched(rows, keyed, *args, **more):
        out = spread_join(rows, keyed, *args, **more)
        sizes = [n for n in out.rdd.mapPartitions(lambda part: [sum(1 for _ in part)]).collect() if n]
        worst.append(max(sizes) / sum(sizes))
        return out

    monkeypatch.setattr(c, "spread_join", watched)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as partitions this small would be put together
    frame = spark.createDataFrame(edges, "a long, b long").repartition(4)
    try:
        got = {r["node"]: r["component"] for r in c.connected_components(frame, small=0).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == groups(edges)
    # A hub would be 0.9 of the rows; readers of local shuffle files may give half of the rows to one task, whatever their keys.
    assert worst and max(worst) < 0.6
