"""Rounding and logarithms to the last bit, as the SQL has them."""

import sys

sys.path.insert(0, __file__.rsplit("/", 1)[0])
import duckdb
from pyspark.sql import functions as F

from pricehist.functions.numbers import exp, ln, rounded
from pricehist.operators import metrics
from pricehist.plans import marts
from pricehist.sources import adapters as a


def test_doubles_just_under_a_half(spark):
    """A price of 25.97 over a fair one of 20.00 gives 29.849999999999998, which SQL rounds to 29.9."""
    values = [(25.97 / 20.0 - 1) * 100, -55.449999999999996, 107.44999999999999, 0.049999999999999996, -0.04, 0.0, 1e300, 2.5]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "x double").select(rounded(F.col("x"), 1)).collect()]
    assert got == duckdb.sql(f"SELECT round(unnest({values!r}::DOUBLE[]), 1)").df().iloc[:, 0].tolist() and got[0] == 29.9
    six = [k / 1e6 + 5e-7 for k in range(0, 40_000, 7)]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in six], "x double").select(a.r6(F.col("x"))).collect()]
    assert got == duckdb.sql(f"SELECT round(unnest({six!r}::DOUBLE[]), 6) AS r").df()["r"].tolist()


def test_value_of_a_price_at_a_tie(spark):
    o = spark.createDataFrame([(7, "2001-01-01", 25.97), (8, "2001-01-01", 25.97)], "wine_id long, date string, price double").withColumn("date", F.to_date("date"))
    got = {r["wine_id"]: r["value_pct"] for r in marts._fair(spark, "", o).filter("model_version = 'v2'").collect()}
    assert got[7] == 29.9


def test_values_in_percent_at_ties(spark):
    """Prices that are an odd number of half tenths of a percent over another: the last bit of logarithms decides."""
    pairs = [(p / 100, m / 100) for m in range(400, 6000, 100) for p in range(m // 2, m * 2, 3) if 2000 * (p - m) % m == 0 and 2000 * (p - m) // m % 2]
    df = spark.createDataFrame(pairs, "p double, m double").select("p", "m", metrics.value_pct(ln(F.col("p")), ln(F.col("m"))).alias("v"))
    got = {(r["p"], r["m"]): r["v"] for r in df.collect()}
    want = duckdb.sql(f"SELECT p, m, round((exp(ln(p) - ln(m)) - 1) * 100, 1) AS v FROM (SELECT unnest({[p for p, _ in pairs]!r}::DOUBLE[]) AS p, unnest({[m for _, m in pairs]!r}::DOUBLE[]) AS m)")
    assert len(pairs) > 500 and got == {(p, m): v for p, m, v in want.fetchall()}


def test_a_price_on_the_border_of_its_band(spark):
    """The row that the band was widened for is inside it by the same bits as in SQL."""
    prices = [(p / 100, (p + 137) / 100) for p in range(500, 4000)]
    df = spark.createDataFrame(prices, "a double, b double").withColumn("y", ln(F.col("b")) - ln(F.col("a"))).withColumn("wide", F.lit(0.015) - F.col("y"))
    got = df.filter(F.col("y") >= 0.015 - F.col("wide")).count()
    want = f"SELECT count(*) FROM (SELECT ln(unnest({[b for _, b in prices]!r}::DOUBLE[])) - ln(unnest({[a for a, _ in prices]!r}::DOUBLE[])) AS y) WHERE y >= 0.015::DOUBLE - (0.015::DOUBLE - y)"
    assert got == duckdb.sql(want).fetchall()[0][0]


def test_logarithms_of_what_has_none(spark):
    x = spark.createDataFrame([(1, None), (2, 0.0), (3, -1.0), (4, float("nan")), (5, 1.0)], "k int, v double")
    got = {r["k"]: (r["l"], r["e"]) for r in x.select("k", ln("v").alias("l"), exp("v").alias("e")).collect()}
    assert [got[k][0] for k in (1, 2, 3, 5)] == [None, None, None, 0.0] and got[1][1] is None and got[2][1] == 1.0
