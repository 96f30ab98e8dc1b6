"""Plans of parsing: methods that the JVM compiles, one sort of a page, lines written after the shuffle."""

import re

import pytest

from pricehist.plans import names
from pricehist.sources import price_lists as pl

#: The JVM interprets methods with more bytes of code.
COMPILED = 8000


def _codegen(spark, df):
    df._jdf.queryExecution().executedPlan()
    return spark._jvm.org.apache.spark.sql.execution.debug.package.codegenString(df._jdf.queryExecution().executedPlan())


@pytest.fixture()
def planned(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield spark
    spark.conf.unset("spark.sql.adaptive.enabled")


def test_methods_are_compiled(planned, small):
    for df in (names.p1_parsed_prices(planned, small), names._parsed(planned, small).filter("NOT miss")):
        sizes = [int(s) for s in re.findall(r"maxMethodCodeSize:(\d+)", _codegen(planned, df))]
        assert sizes and max(sizes) < COMPILED


def test_a_page_is_sorted_once(planned):
    lines = planned.createDataFrame([("list_19950101.txt", 0, 1, "x")], "file string, page int, line_no int, text string")
    plan = pl.parse(lines)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"\bSort \[", plan)) == 1 and plan.count("Exchange") == 1


def test_lines_are_written_after_the_shuffle(planned, small):
    plan = names.listing_lines(planned, small)._jdf.queryExecution().executedPlan().toString()
    before = plan[plan.index("Exchange hashpartitioning(file"):]
    assert "Code Size" in plan and "Code Size" not in before


def test_pending_names_of_a_block(spark):
    """Names before a product do not pend for the orphan after it; of three names the last two do."""
    t = "  000000101 750 mL ........ $10.00"
    texts = ["Old Name", "000000100 Some Wine 1990 750 mL ........ $9.00", "New Name", t, t, "A", "B", "C", t]
    rows = [("list_19950101.txt", 0, k, text) for k, text in enumerate(texts)]
    got = pl.parse(spark.createDataFrame(rows, "file string, page int, line_no int, text string")).select("line_no", "miss", "description").collect()
    assert {r[0]: (r[1], r[2]) for r in got} == {1: (False, "Some Wine 1990"), 3: (False, "New Name"), 4: (True, None), 8: (False, "B C")}
