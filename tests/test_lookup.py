"""Keywords by n-grams against a search for each keyword."""

import random

import pytest

from pricehist.operators import lookup
from pricehist.operators.lookup import keyword_lookup


def test_a_table_of_thousands_of_keywords(spark):
    draw = random.Random(4)
    word = lambda: draw.choice("abcdefgh") + draw.choice("aeiou") + draw.choice("stv")
    keywords = sorted({" ".join(word() for _ in range(draw.choice([1, 2, 2, 3, 3, 3]))) for _ in range(3_000)})
    table = [(k, f"r{i % 70}", i) for i, k in enumerate(keywords) if " " in k or i % 9 == 0]
    names = [" ".join(word() for _ in range(draw.randrange(1, 9))) for _ in range(300)] * 2 + [None, "", "'", " ".join(word() for _ in range(2_000))]

    def best(name):
        hits = [(-len(k), i, v) for k, v, i in table if f" {k} " in f" {name} "]
        return min(hits)[2] if hits else None

    rows = spark.createDataFrame(list(enumerate(names)), "id long, name string")
    got = {r["id"]: r["value"] for r in keyword_lookup(rows, "name", spark.createDataFrame([*table, ("", "x", -1), (None, "x", -1)], "keyword string, value string, place long")).collect()}
    assert got == {i: best(x) if x else None for i, x in enumerate(names)} and len({v for v in got.values() if v}) > 20


def test_apostrophes_ties_and_names_of_columns(spark):
    rows = spark.createDataFrame([(1, "Stag's Leap"), (2, "STAGS  LEAP"), (3, "l'île rouge"), (4, "sassicaia's")], "_gram long, place string")
    table = spark.createDataFrame([("stags leap", "napa"), ("ile", "east"), ("rouge", "west"), ("rouge", "north"), ("sassicaia", "coast")], "keyword string, value string")
    got = {r["_gram"]: r["region"] for r in keyword_lookup(rows, "place", table, "region").collect()}
    assert got == {1: "napa", 2: "napa", 3: "north", 4: "coast"}
    assert {r["region"] for r in keyword_lookup(rows, "place", table.limit(0), "region").collect()} == {None}
    with pytest.raises(ValueError, match="column Place"):
        keyword_lookup(rows, "place", table, "Place")


def test_names_are_never_broadcast(spark, monkeypatch):
    """However small a table of names seems to Spark, only keywords are broadcast, and not even these where they are many."""
    rows = spark.createDataFrame([(k, f"w{k} napa") for k in range(50)], "id long, name string")
    table = spark.createDataFrame([("napa", "Napa Valley")], "keyword string, value string")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    small = keyword_lookup(rows, "name", table)
    assert plan(small).count("BroadcastExchange") == 1 and small.filter("value = 'Napa Valley'").count() == 50
    monkeypatch.setattr(lookup, "SMALL", 0)
    large = keyword_lookup(rows, "name", table)
    assert plan(large).count("BroadcastExchange") == 0 and large.filter("value = 'Napa Valley'").count() == 50
