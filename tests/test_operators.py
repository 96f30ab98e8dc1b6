"""Operators on small hand-made frames, edge cases first."""

import datetime as dt
import math
import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from pricehist.functions import names as n
from pricehist.operators import context, marts, metrics, panel, vintages
from pricehist.operators.components import connected_components
from pricehist.sources import price_lists as pl
from pricehist.sources import publish as pub


def one(spark, f, *values):
    df = spark.createDataFrame([values], ", ".join(f"c{i} string" for i in range(len(values))))
    return df.select(f(*[F.col(f"c{i}") for i in range(len(values))]).alias("x")).first()["x"]


PAGE = [
    "Code Size Retail", "000012346 Beta Rosé 2021 750 mL 07/01/24 07/28/24 $15.99 $18.99", "Delta Estate Long Vineyard Name",
    "Cabernet Sauvignon 2018", "000012348 1.5 L $1,199.00",
    "000012349 750 mL $5.00", "One", "Two", "000012350 no size here $5.00", "Three", "000012351 750 mL $7.00", "000012347 Gamma Port Nonvintage 0.75 L $9.99 $24.99",
    "000012345 Alpha Cellars Merlot Napa 2019 750 mL ......... $19.99", "Last name of the page",
]


def test_parse_pages(spark):
    lines = [("list_20240701.txt", 0, i, t) for i, t in enumerate(PAGE)] + [("list_20240701.txt", 1, 0, "000012352 750 mL $6.00")]
    got = {r["line_no"] + 100 * r["page"]: r for r in pl.parse(spark.createDataFrame(lines, "file string, page int, line_no int, text string")).collect()}
    assert got[1]["description"] == "Beta Rosé 2021" and got[1]["promo_type"] == "sale" and got[1]["sale_start"] == dt.date(2024, 7, 1)
    assert got[4]["description"] == "Delta Estate Long Vineyard Name Cabernet Sauvignon 2018" and got[4]["size"] == "1500 ML" and float(got[4]["regular_price"]) == 1199.0
    assert got[5]["miss"] and got[8]["miss"] and got[100]["miss"]  # nothing pending; a broken line; names do not cross pages
    assert got[10]["description"] == "Two Three"  # the last two of three, the broken line between them
    assert got[11]["promo_type"] == "clearance" and got[11]["vintage"] == "NV" and got[11]["size"] == "750 ML"
    assert got[12]["promo_price"] is None and got[12]["vintage"] == "2019" and got[12]["report_date"] == dt.date(2024, 7, 1)


@pytest.mark.parametrize(("text", "size"), [("1.750 L", "1750 ML"), ("750 mL", "750 ML"), ("12 OZ", "355 ML"), ("EACH", "EACH"),
    ("1,000 ml", "1000 ML"), ("3 LTR", "3000 ML"), (None, None)])
def test_sizes(spark, text, size):
    assert one(spark, n.normalized_size, text) == size


@pytest.mark.parametrize(
    ("text", "style"),
    [("Bourbon Barrel Zinfandel 2019", "red"), ("Old Bourbon 12 yr", None), ("Rosé de Provence", "rose"), ("Unknown Thing 2018", "red"),
    ("Unknown Thing", None), ("Grüner Veltliner", "white"), ("Brut Rosé", "sparkling"), (None, None)],
)
def test_styles(spark, text, style):
    assert one(spark, n.style_of, text) == style


@pytest.mark.parametrize(
    ("text", "brand"),
    [
        ("Château Margaux 2015", "chateau margaux"), ("The Prisoner Wine Company Red", "the prisoner"), ("Stag's Leap Cellars Cabernet", "stag s"),
        ("Domaine de la Romanee Conti", "domaine de la romanee conti"),
        ("Caymus Cabernet Sauvignon 2019", "caymus"), ("Clos du Bois Merlot", "clos du bois"), ("2019", None), (None, None), ("La", None), ("Joseph de la", "joseph"),
    ],
)
def test_brands(spark, text, brand):
    assert one(spark, n.brand_of, text) == brand


def test_regions_and_grapes(spark):
    assert one(spark, n.region_of, "Montepulciano d'Abruzzo 2019") == "Abruzzo"  # the longest keyword wins
    assert one(spark, n.region_of, "Stag's Leap Cabernet") == "Napa Valley" and one(spark, n.region_of, "Stags Leap Cabernet") == "Napa Valley"
    assert one(spark, n.region_of, "Export Lager") is None  # whole words only
    assert one(spark, n.grape_of, "Barolo Riserva") == "Nebbiolo" and one(spark, n.grape_of, "Barolo Merlot") == "Merlot"


def test_folding_matches_unicode(spark):
    random.seed(1)
    letters = "aÉüßñçŁø’'ﬁ½ -_Ωж\n9"
    texts = ["".join(random.choice(letters) for _ in range(12)) for _ in range(200)]
    want = ["".join(c if c.isascii() and c.isalnum() else " " for c in unicodedata.normalize("NFKD", t).encode("ascii",
        "ignore").decode().lower().replace("'", " ")).split() for t in texts]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(n.folded_any(F.col("t")).alias("x")).collect()
    assert [r["x"].split() for r in got] == want


def test_dates_and_money(spark):
    assert one(spark, n.date_of, "7/4/24") == dt.date(2024, 7, 4) and one(spark, n.date_of, "07/04/1999") == dt.date(1999, 7, 4) and one(spark, n.date_of, None) is None
    assert float(one(spark, n.money, "1,199.00")) == 1199.0 and one(spark, n.money, "") is None


PANEL = {1: [10, 10, 11, 11, 11, 10], 2: [20, None, 20, 22, None, 22], 3: [None, None, None, 30, 30, 30], 4: [None] * 5 + [40], 5: [50, 50.1, 50.1, 50.1, 50.1, 50.1]}


def panel_frame(spark):
    rows = [(w, t, dt.date(2020 + t // 4, 1 + 3 * (t % 4), 1), float(p), None, None, "red", "premium", "NV" if w == 5 else "2015", "R",
        "B" if w != 5 else None, "G", "C", f"F{w}", f"wine {w}") for w, ps in PANEL.items() for t, p in enumerate(ps) if p]
    return spark.createDataFrame(rows,
        "wine_id long, t int, date date, price double, promo_price double, promo_type string, style string, tier string, vintage string, region string, brand string, grape string, classification string, family string, name string")


def test_panel_gaps(spark):
    x = {(r["wine_id"], r["t"]): r for r in panel.features(panel_frame(spark)).collect()}
    assert x[2, 2]["lr_1"] is None and x[2, 2]["lr_2"] == 0.0  # a gap is not bridged
    assert x[1, 2]["periods_since_change"] == 0 and x[1, 4]["periods_since_change"] == 2
    assert x[3, 5]["periods_since_change"] == 2 and x[3, 5]["age"] == 3  # counted from the first listing
    assert x[4, 5]["vol_4"] is None and x[4, 5]["changes_8"] is None
    assert x[5, 1]["changes_8"] == 1.0 and x[5, 1]["own_up"] == 0.0  # changed, but not moved
    assert x[5, 1]["vintage_age"] is None and x[5, 1]["is_nv"] == 1.0


def test_horizons_drop_missing_targets(spark):
    got = {(r["wine_id"], r["t"], r["h"]) for r in panel.horizons(panel.diffs(panel_frame(spark)), 2, 4).filter("wine_id = 2").collect()}
    assert got == {(2, 0, 2), (2, 2, 1), (2, 3, 2)}


def test_brand_features_leave_the_wine_out(spark):
    s = panel_frame(spark)
    stats = context.brand_stats(s, s.select("t", "date").distinct())
    x = {(r["wine_id"], r["t"]): r for r in context.brand_features(panel.features(s), stats).collect()}
    assert x[1, 2]["brand_n_others"] == 1 and x[1, 2]["brand_up_1q"] is None  # the other wine has no previous list
    assert x[5, 2]["brand_n_others"] is None  # no brand
    assert abs(x[1, 3]["brand_rel_price"] - (math.log(11) - (math.log(22) + math.log(30)) / 2)) < 1e-9


def test_season_features(spark):
    days = [(r, h, dt.date(2000, 9, 1) + dt.timedelta(d), None if d % 50 == 3 else 36.0, -1.0, 12.0, 1.0) for r, h in (("south", "S"), ("north", "N")) for d in range(300)]
    x = {(r["region"], r["vintage"]): r for r in context.season_features(spark.createDataFrame(days,
        "region string, hemisphere string, date date, t_max double, t_min double, t_mean double, rain double")).collect()}
    assert set(x) == {("south", 2001), ("north", 2000)}  # the north's 2001 is not over, the south's 2000 had begun before
    assert x["south", 2001]["frost_days"] == 46 and x["south", 2001]["harvest_rain"] == 61.0 and x["north", 2000]["frost_days"] == 0


@pytest.mark.parametrize("small", [0, 100_000])
@pytest.mark.parametrize("shape", ["chain", "hub", "mixed"])
def test_components(spark, shape, small):
    random.seed(2)
    edges = [(i, i + 1) for i in range(50)] if shape == "chain" else [(0, i) for i in range(1, 1000)] if shape == "hub" else [(random.randrange(300),
        random.randrange(300)) for _ in range(200)] + [(7, 7), (None, 3), (900, 900)]
    up = {}

    def top(v):
        while up.setdefault(v, v) != v:
            v = up[v]
        return v

    for a, b in edges:
        if a is not None and b is not None:
            x, y = top(a), top(b)
            up[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long"), small=small).collect()}
    assert got == {v: top(v) for v in list(up)}


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_metrics_ties_and_single_classes(spark):
    rows = [("a", 0.5, True), ("a", 0.5, False), ("a", 0.9, True), ("a", 0.1, False), ("b", 0.5, False), ("b", 0.2, False)]
    x = {r["g"]: r for r in metrics.ranking(spark.createDataFrame(rows, "g string, s double, hit boolean"), ["g"], "s", "hit").collect()}
    assert x["a"]["roc_auc"] == 3.5 / 4 and abs(x["a"]["avg_precision"] - (1 + 2 / 3) / 2) < 1e-12
    assert x["b"]["roc_auc"] is None and x["b"]["avg_precision"] is None


def test_band_scale(spark):
    rows = [(float(i) / 10, 0.0, -1.0, 1.0) for i in range(10)] + [(1.5, 0.0, -1.0, 1.0), (-1.254, 0.0, -1.0, 1.0)]
    assert metrics.band_scale(spark.createDataFrame(rows, "y double, p50 double, p10 double, p90 double"), 0.9).first()["k"] == 1.26


def test_value_order_puts_unknown_ranges_last(spark):
    rows = [("a", "a", 10.0, None, None, 1.0), ("b", "b", 10.0, None, 12.0, -5.0), ("c", "c", 10.0, None, 8.0, -9.0), ("d", "d", 10.0, 5.0, 11.0, -20.0)]
    x = marts.page(spark.createDataFrame(rows, "name string, slug string, price double, promo_price double, fair_low double, value_pct double"), "value")
    assert [r["slug"] for r in x.collect()] == ["d", "b", "c", "a"]


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([(1, "a", True), (2, "b", True)], "id long, slug string, is_active boolean")
    new = spark.createDataFrame([("b", True), ("d", True), ("c", False)], "slug string, is_active boolean")
    once = pub.upsert(old, new)
    want = {(1, "a", False), (2, "b", True), (3, "c", False), (4, "d", True)}
    assert {tuple(r) for r in once.select("id", "slug", "is_active").collect()} == want == {tuple(r) for r in pub.upsert(once, new).select("id", "slug", "is_active").collect()}


def test_brand_history_bounds(spark):
    d = dt.date
    h = [("f1", "b", d(2020, 1, 1), 0.1), ("f1", "b", d(2022, 1, 1), 0.3), ("f2", "b", d(2022, 1, 1), 0.5), ("f3", None, d(2021, 1, 1), 0.7), ("f4", "b", d(2019, 12, 31), 0.9)]
    t = spark.createDataFrame(h, "family string, brand string, date date, y double")
    x = {(r["family"], r["date"]): r for r in vintages.brand_history(t, t).collect()}
    assert x["f2", d(2022, 1, 1)]["brand_recent_vintage_n"] == 1 and abs(x["f2",
        d(2022, 1, 1)]["brand_recent_vintage_change"] - 0.1) < 1e-9  # 24 months count, the day itself does not
    assert x["f3", d(2021, 1, 1)]["brand_recent_vintage_n"] == 0 and x["f3", d(2021, 1, 1)]["brand_recent_vintage_change"] is None


def test_folds_keep_families_together(spark):
    x = spark.range(500).select((F.col("id") % 40).cast("string").alias("f")).withColumn("k", metrics.fold_of(F.col("f"), 5))
    assert x.distinct().count() == 40 and x.select("k").distinct().count() == 5


def test_price_history_of_every_wine(spark, small):
    from pricehist.plans import marts as q
    from pricehist.sources import adapters as a

    wines = {r["slug"]: r["tier"] for r in a.wines(spark, small).join(a.obs(spark, small).select("wine_id").distinct(), "wine_id").select("slug", "tier").collect()}
    x = q.j2_price_history_all(spark, small).collect()
    assert set(wines.values()) == {"everyday", "premium", "luxury"}
    assert {r["slug"] for r in x if r["kind"] == "list"} == set(wines) and sum(r["kind"] == "list" for r in x) == a.obs(spark, small).count()
    assert {r["slug"] for r in x if r["kind"] == "forecast"} == set(wines) and sum(r["kind"] == "forecast" for r in x) == 4 * len(wines)


def test_wrapped_names_read_the_lists_once(spark, small):
    """The kind of a line comes with the parsed row: one scan of the lines, and no join of the lists with themselves."""
    from pricehist.plans import names

    assert names.p2_wrapped_names(spark, small)._jdf.queryExecution().optimizedPlan().toString().count("l_shipdate") < names._parsed(spark, small).join(
        names.listing_lines(spark, small), ["file", "page", "line_no"])._jdf.queryExecution().optimizedPlan().toString().count("l_shipdate")
    rows = [("list_20010101.txt", 0, 1, "Old"), ("list_20010101.txt", 0, 2, "Red"), ("list_20010101.txt", 0, 3, "123 750 ML ........ $5.00"), ("list_20010101.txt", 0, 4, "124 Blue 750 ML ........ $6.00")]
    got = names.pl.parse(spark.createDataFrame(rows, "file string, page int, line_no int, text string"), ("kind",)).select("kind", "code", "description").collect()
    assert sorted(tuple(r) for r in got) == [("orphan", "123", "Old Red"), ("product", "124", "Blue")]
