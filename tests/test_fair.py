"""Newest rows, baselines and the scale of bands: the same rows with each input read once."""

import datetime as dt
import random
import statistics
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, __file__.rsplit("/", 1)[0])
from compare import same

from pricehist.operators import fair, metrics
from pricehist.plans import catalog
from pricehist.plans import evaluation as q
from pricehist.sources import adapters as a

BAND = "y double, p50 double, p10 double, p90 double"


def counted(df):
    """df, and how many rows of it were made, in all its passes."""
    made = df.sparkSession.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    return df.mapInArrow(count, df.schema), made


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Lines that tie in list, code and number, lines without a date or a part, and parts without lines."""
    root, draw, line = str(tmp_path_factory.mktemp("odd")), random.Random(5), []
    for k in range(3000):
        day = None if k % 41 == 0 else dt.datetime(2020 + draw.randrange(2), 1 + draw.randrange(12), 1 + draw.randrange(28), draw.randrange(24))
        line.append((k // 9, draw.randrange(130), draw.randrange(9), draw.randrange(2), float(draw.randrange(1, 50)), float(draw.randrange(100, 105)), draw.randrange(11) / 100,
            draw.randrange(9) / 100, draw.choice("RAN"), "O", day))
    part = [(k, f"{'oak elm ash'.split()[k % 3]} hill", f"Brand#{k % 4}", f"T{k % 7}", 1 + k % 50, 900.0 + k % 13) for k in range(120)]
    spark.createDataFrame(line, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
        "l_returnflag string, l_linestatus string, l_shipdate timestamp").repartition(5).coalesce(1).write.parquet(f"{root}/parts/lineitem")
    spark.createDataFrame(part, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").coalesce(1).write.parquet(f"{root}/parts/part")
    for t in ("lineitem", "part"):
        spark.read.parquet(f"{root}/parts/{t}").toPandas().to_parquet(f"{root}/{t}.parquet", coerce_timestamps="us")
    for t in ("nation", "region"):
        spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").toPandas().to_parquet(f"{root}/{t}.parquet")
    return root


def test_newest_is_the_last_row_of_the_series(spark, odd):
    columns = ["wine_id", "date", "price", "family", "name", "vintage", "region", "brand", "grape", "tier"]
    got, want = ([tuple(r) for r in fair.latest_rows(x).select(*columns, "y").orderBy("wine_id").collect()] for x in (a.newest(spark, odd), a.series(spark, odd)))
    assert len(got) > 100 and got == want


@pytest.mark.parametrize("name", ["f16_latest_rows", "a13_baselines", "m15_band_scale", "m15_value_pct", "m14_fair_scores"])
def test_odd_lines_against_sql(spark, odd, name):
    same(spark, odd, catalog.queries()[name], catalog.oracle_sql()[name])


def test_lines_are_read_once(spark, small):
    """One scan for the newest rows; what reads them more than once reads what was written."""
    scans = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("l_shipdate")
    assert scans(a.newest(spark, small).select("wine_id", "date")) < scans(a.series(spark, small).select("wine_id", "date"))
    assert [scans(f(spark, small)) for f in (q.a13_baselines, q.m15_band_scale, q.m15_value_pct, q.m14_fair_scores)] == [0, 0, 0, 0]


def test_baselines_of_many_copies(spark):
    draw = random.Random(3)
    kinds = [(draw.randrange(3), draw.choice(["r", "s", None]), draw.choice(["g", None]), draw.choice(["b", "c", None]), draw.choice([None, 1.0, 2.5, 4.0, 7.0])) for _ in range(60)]
    rows = [k for k in kinds for _ in range(draw.randrange(1, 9))]
    x = fair.baselines(spark.createDataFrame(rows, "fold int, region string, grape string, brand string, y double"), 3)

    def middle(keep):
        found = [y for *k, y in rows if y is not None and keep(*k)]
        return statistics.median(found) if found else None

    want = []
    for fold, region, grape, brand, y in rows:
        first = middle(lambda f, r, g, b: f != fold and None not in (region, grape) and (r, g) == (region, grape))  # noqa: B023
        first = middle(lambda f, r, g, b: f != fold) if first is None else first  # noqa: B023
        own = middle(lambda f, r, g, b: f != fold and brand is not None and b == brand)  # noqa: B023
        want.append((fold, region, grape, brand, y, first, first if own is None else own))
    got = x.select("fold", "region", "grape", "brand", "y", "region_grape", "producer").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_band_scale_reads_its_rows_once(spark):
    draw = random.Random(7)
    rows = [(draw.gauss(0, 1), 0.0, -draw.random() - 0.3, draw.random() + 0.4) for _ in range(2000)]
    x, made = counted(spark.createDataFrame(rows, BAND))
    k = metrics.band_scale(x, 0.7).first()["k"]
    inside = lambda k: sum(p50 - k * (p50 - p10) - 1e-12 <= y <= p50 + k * (p90 - p50) + 1e-12 for y, p50, p10, p90 in rows) / len(rows)
    assert k == min(1 + i / 100 for i in range(200) if inside(1 + i / 100) >= 0.7)
    assert made.value == len(rows)


def test_band_scale_of_rows_that_no_band_holds(spark):
    inf, nan = float("inf"), float("nan")
    x = spark.createDataFrame([(0.5, 0.0, -1.0, 1.0)] * 4 + [(1.2, 0.0, -1.0, 1.0), (nan, 0.0, -1.0, 1.0), (inf, 0.0, -1.0, 1.0), (1e300, 0.0, -1.0, 1e-9), (1.0, 0.0, 0.0, 0.0)], BAND)
    assert metrics.band_scale(x, 5 / 9).first()["k"] == 1.2
    with pytest.raises(Exception, match="no scale under 3"):
        metrics.band_scale(x, 6 / 9).collect()
    assert metrics.band_scale(x.limit(0)).count() == 0
    assert metrics.band_scale(x.filter(F.col("y") == 0.5)).first()["k"] == 1.0
