"""Queries of links, marts, sinks and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from pricehist.functions.numbers import rounded
from pricehist.functions.shared import cut, shared_dir
from pricehist.operators import marts as m
from pricehist.operators.components import connected_components, link_more
from pricehist.plans.context import daily, window_sql
from pricehist.plans.context import CONTEXT as CONTEXT_SQL
from pricehist.sources import adapters as a
from pricehist.sources import keyed
from pricehist.sources import publish as pub
from pricehist.sources.adapters import PRELUDE, day, r6
from pricehist.streaming import ingest as t

YEAR = 1990


def _runs(spark):
    return spark.createDataFrame([("v1", False), ("v2", True)], "model_version string, is_active boolean")


def _folder(spark, name):
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _wines(spark, sf_dir, o=None):
    """Wines with is_active (on the newest list), is_featured and quarters. o: the observations, where they are at hand."""
    o = a.obs(spark, sf_dir) if o is None else o
    newest = o.agg(F.max("date").alias("newest"))
    seen = o.groupBy("wine_id").agg(F.max("date").alias("last"), F.count(F.lit(1)).alias("quarters")).join(F.broadcast(newest), F.lit(True))
    return a.wines(spark, sf_dir).join(seen, "wine_id").select("*", (F.col("last") == F.col("newest")).alias("is_active"),
        (F.col("wine_id") % 11 == 0).alias("is_featured")).drop("last", "newest")


def _forecasts(spark, sf_dir, o=None):
    """Forecasts of two versions that follow from each wine's newest price: a stand-in for a fitted model."""
    cur = m.latest(a.obs(spark, sf_dir) if o is None else o, "price")
    x = cur.withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(4)))).withColumn("model_version", F.explode(F.array(F.lit("v1"), F.lit("v2"))))
    k = F.col("wine_id") * 37 + F.col("h") * 11 + F.when(F.col("model_version") == "v2", 5).otherwise(0)
    return x.select(
        "wine_id", "model_version", F.add_months("date", 3 * F.col("h")).alias("target_date"), (k % 100 / 200).alias("p_up"),
        (k % 37 / 100).alias("p_down"), (k % 17 + 1).cast("double").alias("up_pct"),
        (-(k % 13) - 1).cast("double").alias("down_pct"), a.cents(F.col("price") * 0.9).alias("p10"),
        a.cents(F.col("price") * (1 + k % 7 / 100)).alias("p50"), a.cents(F.col("price") * 1.2).alias("p90"),
    )


def _fair(spark, sf_dir, o=None):
    cur = m.latest(a.obs(spark, sf_dir) if o is None else o, "price").filter("wine_id % 9 <> 0").withColumn("model_version", F.explode(F.array(F.lit("v1"), F.lit("v2"))))
    fair = a.cents(F.col("price") * (0.7 + F.col("wine_id") % 60 / 100))
    return cur.select("wine_id", "model_version", fair.alias("fair_p50"), a.cents(fair * 0.85).alias("fair_p10"),
        a.cents(fair * 1.15).alias("fair_p90"), rounded((F.col("price") / fair - 1) * 100, 1).alias("value_pct"))


def _catalog(spark, sf_dir):
    """The catalog over observations that are deduplicated once and kept as a table."""
    o = cut(a.obs(spark, sf_dir))
    return m.catalog(_wines(spark, sf_dir, o).drop("quarters"), o, _forecasts(spark, sf_dir, o), _fair(spark, sf_dir, o), _runs(spark))


COLUMNS = ["slug", "name", "vintage", "tier", "price", "promo_price", "change_1y_pct", "change_5y_pct", "p_up_1y", "p_down_1y", "fair_price", "value_pct"]


def o1_catalog_page(spark, sf_dir):
    return m.page(_catalog(spark, sf_dir), "price", limit=50, offset=10).select(*COLUMNS, day("latest_date").alias("latest_date"))


def o2_best_value(spark, sf_dir):
    return m.page(_catalog(spark, sf_dir), "value", limit=100).select("slug", "price", "fair_low", "value_pct")


def o3_family_vintages(spark, sf_dir):
    return m.vintages(a.wines(spark, sf_dir), "Brand#1|ECONOMY").select("slug", "vintage")


def o4_md5_sample(spark, sf_dir):
    return m.chosen(F.col("slug"), a.wines(spark, sf_dir), 40).select("slug")


def o5_capped_sample(spark, sf_dir):
    o = a.obs(spark, sf_dir).withColumn("k", F.concat_ws("|", F.col("wine_id").cast("string"), F.col("date").cast("string")))
    return m.chosen(F.col("k"), o, 40_000).agg(F.count(F.lit(1)).alias("n"), r6(F.avg("price")).alias("mean"))


def f19_year_ahead(spark, sf_dir):
    return m.year_ahead(_forecasts(spark, sf_dir), _runs(spark))


def f20_total(spark, sf_dir):
    return m.selected(_catalog(spark, sf_dir), tier="premium", listed=True).agg(F.count(F.lit(1)).alias("total"))


def p21_filters(spark, sf_dir):
    w = _wines(spark, sf_dir)
    cases = {"style": {"style": "red"}, "text": {"q": "r_d"}, "featured": {"featured": True}, "investor": {"investor": True, "listed": True}, "none": {}}
    out = None
    for name, f in cases.items():
        x = m.selected(w, **f).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("filter"), "n")
        out = x if out is None else out.unionByName(x)
    return out


def p22_saved_views(spark, sf_dir):
    c, out = _catalog(spark, sf_dir), None
    for name, (filters, sort) in m.VIEWS.items():
        x = m.page(m.selected(c, **filters), sort, limit=20).select(F.lit(name).alias("view"), "slug")
        out = x if out is None else out.unionByName(x)
    return out


def p29_window_status(spark, sf_dir):
    return m.window_status(a.wines(spark, sf_dir), YEAR)


def _price_history(spark, sf_dir, w):
    """Every listing and active forecast of the wines w. The observations are deduplicated once and kept as a table."""
    w, o = w.select("wine_id", "slug"), cut(a.obs(spark, sf_dir))
    past = o.join(w, "wine_id").select("slug", F.lit("list").alias("kind"), day("date").alias("date"), "price")
    ahead = m.active(_forecasts(spark, sf_dir, o), _runs(spark)).join(w, "wine_id").select("slug", F.lit("forecast").alias("kind"),
        day("target_date").alias("date"), F.col("p50").alias("price"))
    return past.unionByName(ahead)


def j2_price_history(spark, sf_dir):
    """The selection of the oracle's SQL: one luxury wine in 50. j2_price_history_all has every wine."""
    return _price_history(spark, sf_dir, m.selected(a.wines(spark, sf_dir), tier="luxury").filter("wine_id % 50 = 7"))


def j2_price_history_all(spark, sf_dir):
    return _price_history(spark, sf_dir, a.wines(spark, sf_dir))


def j3_latest(spark, sf_dir):
    return m.latest(a.obs(spark, sf_dir), "price", "promo_type").select("wine_id", day("date").alias("date"), "price", "promo_type",
        day("first_date").alias("first_date"), "quarters")


def j4_price_ago(spark, sf_dir):
    o = a.obs(spark, sf_dir)
    return m.price_ago(o, m.latest(o, "price"))


def j5_marts_joined(spark, sf_dir):
    return _catalog(spark, sf_dir).select("slug", "p_up_1y", "p_down_1y", "up_pct", "down_pct", "fair_price", "fair_low", "fair_high", "value_pct")


def _rules(spark, sf_dir):
    x = a.table(spark, sf_dir, "part").select(F.split("p_name", " ").alias("w")).distinct()
    return x.select(F.concat_ws(" ", "w").alias("item"), F.array(F.upper(F.col("w")[0]), F.col("w")[1]).alias("match"),
        F.when(F.col("w")[0] == "hot", F.array(F.lit("bolt"))).alias("exclude"))


def j6_featured(spark, sf_dir):
    return m.featured(_wines(spark, sf_dir), _rules(spark, sf_dir))


def s7_rules(spark, sf_dir):
    path = _folder(spark, "rules")
    rows = _rules(spark, sf_dir).agg(F.to_json(F.sort_array(F.collect_list(F.struct("item", "match", "exclude")))).alias("value"))  # at most one row for each pair of words
    rows.write.text(path)
    return pub.rules(spark, path).select("item", F.array_join("match", ",").alias("match"), F.array_join("exclude", ",").alias("exclude"))


def j14_active_with_forecast(spark, sf_dir):
    f = _forecasts(spark, sf_dir).filter("p_up > 0.4 AND model_version = 'v2'")
    return _wines(spark, sf_dir).filter("is_active").join(f, "wine_id", "left_semi").select("slug")


def j15_not_seen(spark, sf_dir):
    seen = a.obs(spark, sf_dir).filter("date < '1996-01-01'")
    return a.wines(spark, sf_dir).join(seen, "wine_id", "left_anti").select("slug")


def j17_parity(spark, sf_dir):
    f = _forecasts(spark, sf_dir)
    return m.parity(f.filter("model_version = 'v1'"), f.filter("model_version = 'v2' AND wine_id % 10 <> 3"), ("wine_id", "target_date"))


def _edges(spark, sf_dir):
    k = lambda kind, *c: F.concat_ws("|", F.lit(kind), *c)
    return a.table(spark, sf_dir, "part").select("p_partkey", k("c", "p_brand", "p_size", "p_type").alias("a"), k("n", "p_name", "p_size", "p_type").alias("b"))


def a1_components(spark, sf_dir):
    return connected_components(_edges(spark, sf_dir))


def a1_linked_batches(spark, sf_dir):
    """The components of a1_components, linked in two batches: rows of even keys first, the others joined to what is then known."""
    e, kept = _edges(spark, sf_dir), spark.createDataFrame([], "node string, component string, id long")
    for batch in (0, 1):
        kept = cut(link_more(kept, e.filter(F.col("p_partkey") % 2 == batch)))
    return kept.select("node", "component")


def a2_wine_dimension(spark, sf_dir):
    e = _edges(spark, sf_dir)
    grp = e.join(connected_components(e), F.col("a") == F.col("node")).select(F.col("p_partkey").alias("wine_id"), F.col("component").alias("grp"), "b")
    rows = a.obs(spark, sf_dir).select("wine_id", "date", "price").join(grp, "wine_id").select("grp", "date", F.col("wine_id").alias("code"), F.col("b").alias("name"), "price")
    return m.dimension(rows).withColumn("codes", F.array_join(F.transform("codes", lambda c: c.cast("string")), ","))


def a3_family_counts(spark, sf_dir):
    o = a.obs(spark, sf_dir).groupBy("wine_id").agg(F.count(F.lit(1)).alias("quarters"), F.count_if(F.col("promo_type") == "sale").alias("sales"), F.min("date").alias("first"))
    x = a.wines(spark, sf_dir).join(o, "wine_id")
    return x.groupBy("family").agg(F.count(F.lit(1)).alias("wines"), F.countDistinct("vintage").alias("vintages"),
        F.sum("quarters").alias("quarters"), F.sum("sales").alias("sales"), day_min("first"))


def day_min(c):
    return F.date_format(F.min(c), "yyyy-MM-dd").alias("first_seen")


def a4_stickiness(spark, sf_dir):
    return m.stickiness(a.obs(spark, sf_dir))


def a19_quality(spark, sf_dir):
    o = a.obs(spark, sf_dir).withColumn("price", F.when(F.col("wine_id") % 97 != 5, F.col("price")))
    w = a.wines(spark, sf_dir).filter("wine_id % 101 <> 3").withColumn("style", F.when(F.col("wine_id") % 89 == 2, "orange").otherwise(F.col("style")))
    return m.quality(w, o, _runs(spark), _forecasts(spark, sf_dir).withColumn("model_version", F.when(F.col("wine_id") % 83 == 1, "v0").otherwise(F.col("model_version"))))


def u2_distinct(spark, sf_dir):
    o = a.obs(spark, sf_dir)
    return o.groupBy("promo_type").agg(F.countDistinct("code").alias("codes"), F.size(F.collect_set("date")).cast("bigint").alias("lists"))


def u4_chart(spark, sf_dir):
    x = m.chart(a.obs(spark, sf_dir), _forecasts(spark, sf_dir).filter("model_version = 'v2'"), 2)
    return x.withColumn("date", day("date"))


def s4_typed_csv(spark, sf_dir):
    path = _folder(spark, "series")
    pub.export(a.series(spark, sf_dir).select(*[c.split()[0] for c in pub.SERIES.split(", ")]), path)
    none = pub.read_csv(spark, f"{path}-missing", pub.SERIES)
    x = pub.read_csv(spark, path, pub.SERIES)
    return x.groupBy("vintage").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("price")).alias("total"), F.lit(none is None).alias("missing_is_none"))


def s5_weather_json(spark, sf_dir):
    d = daily(spark, sf_dir).withColumn("k", F.date_format("date", "yyyyMMdd"))
    one = lambda c: F.map_from_entries(F.collect_list(F.struct("k", F.when(F.dayofmonth("date") % 9 != 0, F.col(c)).otherwise(F.lit(-999.0)).alias("v"))))
    names = {"T2M_MAX": "t_max", "T2M_MIN": "t_min", "T2M": "t_mean", "PRECTOTCORR": "rain"}
    text = d.groupBy("region").agg(F.to_json(F.create_map(*[x for p, c in names.items() for x in (F.lit(p), one(c))])).alias("json"))
    x = pub.daily_weather(text)
    return x.select("region", day("date").alias("date"), *[a.r3(F.col(c)).alias(c) for c in ("t_max", "t_min", "t_mean", "rain")])


def s6_wide_crush(spark, sf_dir):
    line = a.table(spark, sf_dir, "lineitem").withColumns({"y": F.year("l_shipdate"), "d": (F.col("l_suppkey") % 5 + 1).cast("int")})
    wide = line.groupBy("y").pivot("d", [1, 2, 3, 4, 5]).agg(F.sum("l_quantity"))
    file = F.concat(F.lit("crush_"), F.col("y")).alias("file")
    cells = ["1", "2", "3", "4", "5"]
    title = wide.select(file, F.lit(1).alias("row"), F.concat(F.lit("Final "), F.col("y"), F.lit(" Crop report")).alias("c0"), *[F.lit("").alias(f"c{c}") for c in cells])
    head = wide.select(file, F.lit(2).alias("row"), F.lit("Type and Variety").alias("c0"),
        *[F.lit("State total" if c == "5" else f"{c}.0" if c != "4" else "note").alias(f"c{c}") for c in cells])
    total = wide.select(file, F.lit(3).alias("row"), F.lit(" Total Wine ").alias("c0"),
        *[F.when((F.col("y") % 3 == 0) & F.lit(c == "2"), "n/a").otherwise(F.col(c).cast("string")).alias(f"c{c}") for c in cells])
    return pub.wide_crush(title.unionByName(head).unionByName(total))


def s8_upsert(spark, sf_dir):
    w = a.wines(spark, sf_dir)
    old = w.filter("wine_id % 3 <> 0").select(F.col("wine_id").alias("id"), "slug", (F.col("wine_id") % 2 == 0).alias("is_active"))
    new = w.filter("wine_id % 5 <> 0").select("slug", (F.col("wine_id") % 7 != 0).alias("is_active"))
    return pub.upsert(old, new)


def s9_replace_source(spark, sf_dir):
    o, path = a.obs(spark, sf_dir).select("wine_id", "date", "price"), _folder(spark, "observations")
    pub.replace_source(o.withColumn("source", F.when(F.col("wine_id") % 2 == 0, "a").otherwise("b")), path)
    pub.replace_source(o.filter("wine_id % 2 = 0 AND price > 50").withColumn("source", F.lit("a")), path)
    return spark.read.parquet(path).groupBy("source").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("price")).alias("total"))


def s10_export(spark, sf_dir):
    path = _folder(spark, "export")
    pub.export(a.series(spark, sf_dir).select("wine_id", "date", "price", "family"), path)
    x = spark.read.schema("wine_id bigint, date date, price double, family string").option("header", True).csv(path)
    return x.groupBy("family").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("price")).alias("total"))


def s11_publish(spark, sf_dir):
    path, f = _folder(spark, "forecasts"), _forecasts(spark, sf_dir)
    pub.release(f.filter("model_version = 'v1'"), "v1", path)
    pub.release(f.filter("model_version = 'v2' AND wine_id % 2 = 0"), "v2", path)
    rows = pub.released(spark, path, "v1").unionByName(pub.released(spark, path))
    n = rows.groupBy("model_version").agg(F.count(F.lit(1)).alias("n"))
    return pub.registry(spark, path).join(n, "model_version").select("model_version", "is_active", "n")


def s12_metrics(spark, sf_dir):
    path = _folder(spark, "metrics")
    x = a.obs(spark, sf_dir).groupBy("promo_type").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("wine_id").alias("wines"))
    pub.metrics_document(x).write.text(path)
    return spark.read.text(path).select(F.get_json_object("value", "$.promo_type").alias("promo_type"),
        F.get_json_object("value", "$.rows").cast("bigint").alias("rows"), F.get_json_object("value", "$.wines").cast("bigint").alias("wines"))


def m5_facts(spark, sf_dir):
    c = _catalog(spark, sf_dir).join(m.stickiness(a.obs(spark, sf_dir)).select("wine_id", "sales"), "wine_id")
    return m.facts(c, YEAR)


def t1_incremental_ingest(spark, sf_dir):
    """Events arrive in two runs of the stream; a third run finds nothing new; the newest event of every user wins."""
    source, target, state = (_folder(spark, k) for k in ("arrived", "ingested", "progress"))
    e = a.table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value", F.to_date("ts").alias("day"))
    schema = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, day date"
    for half in ("day < '2024-01-16'", "day >= '2024-01-16'", "false"):
        e.filter(half).write.mode("append").parquet(source)
        t.ingest(spark, source, target, state, schema, "user_id", "event_id", "day")
    return t.current(spark, target, "user_id", "event_id").select("user_id", "event_id", "event_type", "value")


def t1_latest_rows(spark, sf_dir):
    """The newest event of every user from a table of latest rows, into which three runs of the stream merge what has arrived."""
    source, root, state = (_folder(spark, k) for k in ("arrived", "latest", "progress"))
    e = a.table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", F.to_date("ts").alias("day"))
    for part in ("day < '2024-01-16'", "day >= '2024-01-16'", "false"):
        e.filter(part).drop("day").write.mode("append").parquet(source)
        t.ingest_latest(spark, source, root, state, "event_id bigint, user_id bigint, event_type string, value double", "user_id", "event_id")
    return keyed.latest(spark, root).select("user_id", "event_id", "event_type", "value")


QUERIES = {f.__name__: f for f in (
    o1_catalog_page, o2_best_value, o3_family_vintages, o4_md5_sample, o5_capped_sample, f19_year_ahead, f20_total, p21_filters, p22_saved_views, p29_window_status,
    j2_price_history, j2_price_history_all, j3_latest, j4_price_ago, j5_marts_joined, j6_featured, s7_rules, j14_active_with_forecast, j15_not_seen,
    j17_parity, a1_components, a1_linked_batches, a2_wine_dimension,
    a3_family_counts, a4_stickiness, a19_quality, u2_distinct, u4_chart, s4_typed_csv, s5_weather_json, s6_wide_crush, s8_upsert, s9_replace_source, s10_export, s11_publish,
    s12_metrics, m5_facts, t1_incremental_ingest, t1_latest_rows,
)}

MARTS = PRELUDE + """, cur AS (
    SELECT wine_id, date, price, promo_price, promo_type, min(date) OVER w AS first_date, count(*) OVER w AS quarters, max(date) OVER () AS newest FROM obs
    WINDOW w AS (PARTITION BY wine_id) QUALIFY row_number() OVER (PARTITION BY wine_id ORDER BY date DESC) = 1
), listed AS (
    SELECT w.*, quarters, date = newest AS is_active, wine_id % 11 = 0 AS is_featured FROM wines w JOIN cur USING (wine_id)
), f0 AS (
    SELECT *, wine_id * 37 + h * 11 + CASE model_version WHEN 'v2' THEN 5 ELSE 0 END AS k FROM cur CROSS JOIN (SELECT unnest([1, 2, 3, 4]) AS h) CROSS
        JOIN (SELECT unnest(['v1', 'v2']) AS model_version)
), forecasts AS (
    SELECT wine_id, model_version, CAST(date + to_months(CAST(3 * h AS INTEGER)) AS DATE) AS target_date, k % 100 / 200 AS p_up,
        k % 37 / 100 AS p_down, CAST(k % 17 + 1 AS DOUBLE) AS up_pct, CAST(-(k % 13) - 1 AS DOUBLE) AS down_pct,
        floor(price * 0.9::DOUBLE * 100 + 0.5) / 100 AS p10, floor(price * (1 + k % 7 / 100) * 100 + 0.5) / 100 AS p50, floor(price * 1.2::DOUBLE * 100 + 0.5) / 100 AS p90 FROM f0
), fair0 AS (
    SELECT wine_id, price, floor(price * (0.7::DOUBLE + wine_id % 60 / 100) * 100 + 0.5) / 100 AS fair_price FROM cur WHERE wine_id % 9 <> 0
), fair AS (
    SELECT wine_id, fair_price, floor(fair_price * 0.85::DOUBLE * 100 + 0.5) / 100 AS fair_low,
        floor(fair_price * 1.15::DOUBLE * 100 + 0.5) / 100 AS fair_high, round((price / fair_price - 1) * 100, 1) AS value_pct FROM fair0
), ahead AS (
    SELECT wine_id, p_up AS p_up_1y, p_down AS p_down_1y, up_pct, down_pct FROM forecasts WHERE model_version = 'v2'
        QUALIFY row_number() OVER (PARTITION BY wine_id ORDER BY target_date DESC) = 1
), ago AS (
    SELECT c.wine_id, """ + ", ".join(
    f"""round(100 * (c.price / (SELECT o.price FROM obs o WHERE o.wine_id = c.wine_id AND abs(date_diff('day', CAST(c.date - INTERVAL {n} YEAR AS DATE), o.date)) <= 7
        ORDER BY abs(date_diff('day', CAST(c.date - INTERVAL {n} YEAR AS DATE), o.date)), o.date LIMIT 1) - 1), 1) AS change_{n}y_pct""" for n in (1, 5)
) + """ FROM cur c
), catalog AS (
    SELECT l.* EXCLUDE (quarters), c.date AS latest_date, c.price, c.promo_price, c.promo_type, c.first_date, c.quarters, change_1y_pct,
        change_5y_pct, p_up_1y, p_down_1y, up_pct, down_pct, fair_price, fair_low, fair_high, value_pct
    FROM listed l JOIN cur c USING (wine_id) LEFT JOIN ago USING (wine_id) LEFT JOIN ahead USING (wine_id) LEFT JOIN fair USING (wine_id)
)"""
_view = lambda name, where, order: f"(SELECT '{name}' AS view, slug FROM catalog WHERE {where} ORDER BY {order}, name, slug LIMIT 20)"
_day = lambda e, n: f"strftime({e}, '%Y-%m-%d') AS {n}"
_usd = lambda c: f"'$' || format('{{:,.2f}}', {c})"
_pct = lambda p: f"CASE WHEN {p} < 0.005 THEN 'under 1%' ELSE CAST(CAST(round({p} * 100) AS INTEGER) AS VARCHAR) || '%' END"
SQL = {
    "o1_catalog_page": MARTS + f""" SELECT {', '.join(COLUMNS)}, {_day('latest_date', 'latest_date')}
        FROM catalog ORDER BY coalesce(promo_price, price) DESC NULLS LAST, name, slug LIMIT 50 OFFSET 10""",
    "o2_best_value": MARTS + """ SELECT slug, price, fair_low, value_pct
        FROM catalog ORDER BY coalesce(price < fair_low, false) DESC, value_pct ASC NULLS LAST, name, slug LIMIT 100""",
    "o3_family_vintages": MARTS + " SELECT slug, vintage FROM wines WHERE family = 'Brand#1|ECONOMY'",
    "o4_md5_sample": MARTS + " SELECT slug FROM wines ORDER BY md5(slug), slug LIMIT 40",
    "o5_capped_sample": MARTS + " SELECT count(*) AS n, round(avg(price), 6) + 0.0 AS mean FROM (SELECT price FROM obs ORDER BY md5(wine_id || '|' || date) LIMIT 40000)",
    "f19_year_ahead": MARTS + " SELECT * FROM ahead",
    "f20_total": MARTS + " SELECT count(*) AS total FROM catalog WHERE tier = 'premium' AND is_active",
    "p21_filters": MARTS + """ SELECT 'style' AS filter, count(*) AS n FROM listed WHERE style = 'red' UNION ALL SELECT 'text', count(*) FROM listed
        WHERE name ILIKE '%r_d%' UNION ALL SELECT 'featured', count(*) FROM listed WHERE is_featured
        UNION ALL SELECT 'investor', count(*) FROM listed WHERE vintage <> 'NV' AND tier IN ('premium', 'luxury') AND is_active UNION ALL SELECT 'none', count(*) FROM listed""",
    "p22_saved_views": MARTS + " UNION ALL ".join([" " + _view("featured", "is_featured AND is_active", "name ASC"),
    _view("rising", "is_active", "p_up_1y DESC NULLS LAST"),
    _view("investor", "vintage <> 'NV' AND tier IN ('premium', 'luxury') AND is_active", "p_up_1y DESC NULLS LAST"),
        _view("value", "is_active", "coalesce(price < fair_low, false) DESC, value_pct ASC NULLS LAST"), _view("all", "true", "name ASC")]),
    "p29_window_status": MARTS + f""" SELECT wine_id, CAST(o AS INTEGER) AS opens, CAST(c AS INTEGER) AS closes, CASE WHEN {YEAR} < o THEN 'before'
        WHEN {YEAR} > c THEN 'past' ELSE 'in' END AS status
        FROM (SELECT wine_id, CAST(vintage AS INTEGER) + {window_sql(0)} AS o, CAST(vintage AS INTEGER) + {window_sql(1)} AS c FROM wines WHERE vintage <> 'NV')""",
    "j2_price_history": MARTS + f""", s AS (SELECT wine_id, slug FROM wines
        WHERE tier = 'luxury' AND wine_id % 50 = 7) SELECT slug, 'list' AS kind, {_day('date', 'date')}, price FROM obs JOIN s USING (wine_id)
        UNION ALL SELECT slug, 'forecast', {_day('target_date', 'date')}, p50 FROM forecasts JOIN s USING (wine_id) WHERE model_version = 'v2'""",
    "j2_price_history_all": MARTS + f""" SELECT slug, 'list' AS kind, {_day('date', 'date')}, price FROM obs JOIN wines USING (wine_id)
        UNION ALL SELECT slug, 'forecast', {_day('target_date', 'date')}, p50 FROM forecasts JOIN wines USING (wine_id) WHERE model_version = 'v2'""",
    "j3_latest": MARTS + f" SELECT wine_id, {_day('date', 'date')}, price, promo_type, {_day('first_date', 'first_date')}, quarters FROM cur",
    "j4_price_ago": MARTS + " SELECT * FROM ago",
    "j5_marts_joined": MARTS + " SELECT slug, p_up_1y, p_down_1y, up_pct, down_pct, fair_price, fair_low, fair_high, value_pct FROM catalog",
    "j6_featured": MARTS + """, rules AS (SELECT DISTINCT p_name AS item, split_part(p_name, ' ', 1) AS x, split_part(p_name, ' ', 2) AS y FROM part)
        SELECT item, slug FROM rules JOIN listed ON contains(name, x) AND contains(name, y) AND NOT (x = 'hot' AND contains(name, 'bolt')) WHERE size = '750 ML'
        QUALIFY row_number() OVER (PARTITION BY item ORDER BY is_active DESC, coalesce(TRY_CAST(vintage AS INTEGER), 0) DESC, quarters DESC, slug) = 1""",
    "s7_rules": """SELECT DISTINCT p_name AS item, upper(split_part(p_name, ' ', 1)) || ',' || split_part(p_name, ' ', 2) AS match, CASE
        WHEN p_name LIKE 'hot %' THEN 'bolt' ELSE '' END AS exclude FROM part""",
    "j14_active_with_forecast": MARTS + """ SELECT slug FROM listed WHERE is_active AND EXISTS (SELECT 1 FROM forecasts f
        WHERE f.wine_id = listed.wine_id AND p_up > 0.4 AND model_version = 'v2')""",
    "j15_not_seen": MARTS + " SELECT slug FROM wines WHERE wine_id NOT IN (SELECT wine_id FROM obs WHERE date < DATE '1996-01-01')",
    "j17_parity": MARTS + """ SELECT count(*) AS rows, count(*) FILTER (a.wine_id IS NULL
        OR b.wine_id IS NULL) AS missing, count(*) FILTER (abs(a.p10 - b.p10) > 0.011 OR abs(a.p50 - b.p50) > 0.011
        OR abs(a.p90 - b.p90) > 0.011) AS price_off,
        count(*) FILTER (abs(a.p_up - b.p_up) > 1e-4 OR abs(a.p_down - b.p_down) > 1e-4) AS share_off
        FROM (SELECT * FROM forecasts WHERE model_version = 'v1') a FULL JOIN (SELECT * FROM forecasts
            WHERE model_version = 'v2' AND wine_id % 10 <> 3) b ON a.wine_id = b.wine_id AND a.target_date = b.target_date""",
    "a1_components": """WITH RECURSIVE e AS (SELECT DISTINCT 'c|' || p_brand || '|' || p_size || '|' || p_type AS a,
        'n|' || p_name || '|' || p_size || '|' || p_type AS b FROM part), both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
        r(node, m) AS (SELECT a, a FROM both_ways UNION SELECT b, m FROM r JOIN both_ways ON a = node) SELECT node, min(m) AS component FROM r GROUP BY node""",
    "a2_wine_dimension": MARTS.replace("WITH obs_raw", "WITH RECURSIVE obs_raw") + """, e AS (SELECT p_partkey,
        'c|' || p_brand || '|' || p_size || '|' || p_type AS a, 'n|' || p_name || '|' || p_size || '|' || p_type AS b FROM part),
        both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r(node, m) AS (SELECT a, a FROM both_ways UNION SELECT b, m FROM r
            JOIN both_ways ON a = node), comp AS (SELECT node, min(m) AS grp FROM r GROUP BY node),
        rows_ AS (SELECT grp, date, wine_id AS code, b AS name, price, max(date) OVER () AS newest FROM obs JOIN e ON p_partkey = wine_id JOIN comp ON node = a)
        SELECT grp, arg_max(name, (date, code)) AS name, arg_max(price, (date, code)) AS price, array_to_string(list_sort(list(DISTINCT code)),
            ',') AS codes, max(date) = any_value(newest) AS is_active FROM rows_ GROUP BY grp""",
    "a3_family_counts": MARTS + f""" SELECT family, count(DISTINCT wine_id) AS wines, count(DISTINCT vintage) AS vintages, count(*) AS quarters,
        count(*) FILTER (promo_type = 'sale') AS sales, {_day('min(date)', 'first_seen')} FROM series GROUP BY family""",
    "a4_stickiness": MARTS + """ SELECT wine_id, count(*) FILTER (price <> was) AS changes, count(*) FILTER (promo_type = 'sale') AS sales
        FROM (SELECT *, lag(price) OVER (PARTITION BY wine_id ORDER BY date) AS was FROM obs) GROUP BY wine_id""",
    "a19_quality": MARTS + """, w AS (SELECT * FROM wines WHERE wine_id % 101 <> 3) SELECT 'price over 0' AS rule, count(*) AS violations FROM obs
        WHERE wine_id % 97 = 5 UNION ALL SELECT 'known style', count(*) FROM w WHERE wine_id % 89 = 2
        UNION ALL SELECT 'known tier', 0 UNION ALL SELECT 'known promo', 0 UNION ALL SELECT 'unique slug', 0 UNION ALL SELECT 'unique listing', 0
            UNION ALL SELECT 'one active run', 0
        UNION ALL SELECT 'listing of a wine', count(*) FROM obs WHERE wine_id % 101 = 3 UNION ALL SELECT 'forecast of a run', count(*) FROM forecasts WHERE wine_id % 83 = 1""",
    "m5_facts": MARTS + f""", x AS (
            SELECT c.*, sales, TRY_CAST(vintage AS INTEGER) + {window_sql(0)} AS o, TRY_CAST(vintage AS INTEGER) + {window_sql(1)} AS e
            FROM catalog c JOIN (SELECT wine_id, count(*) FILTER (promo_type = 'sale') AS sales FROM obs GROUP BY wine_id) USING (wine_id)
        ) SELECT wine_id, concat_ws(chr(10),
            'Wine: ' || CASE vintage WHEN 'NV' THEN name
                ELSE name || ' ' || vintage END || ' (' || concat_ws(', ', style, coalesce(region, 'region not stated'),
                grape, classification) || ').',
            'Price tier: ' || tier || '. List price ' || {_usd('price')} || CASE
                WHEN promo_price IS NOT NULL THEN ', on ' || promo_type || ' at ' || {_usd('promo_price')} ELSE '' END || '.',
            'Listed ' || quarters || ' times since ' || strftime(first_date, '%Y-%m-%d') || ', on sale in ' || sales || '.',
            'Drinking window ' || CAST(o AS INTEGER) || '-' || CAST(e AS INTEGER) || '; now ' || CASE WHEN {YEAR} < o THEN 'before'
                WHEN {YEAR} > e THEN 'past' ELSE 'inside' END || ' it.',
            'Chance of a higher list price within a year ' || {_pct('p_up_1y')} || ', of a lower one ' || {_pct('p_down_1y')} || '.',
            'Fair price ' || {_usd('fair_price')} || ' (' || {_usd('fair_low')} || ' to ' || {_usd('fair_high')} || ').') AS facts FROM x""",
    "u2_distinct": MARTS + " SELECT promo_type, count(DISTINCT code) AS codes, count(DISTINCT date) AS lists FROM obs GROUP BY promo_type",
    "u4_chart": MARTS + f""" SELECT o.wine_id, {_day('o.date', 'date')}, 'history' AS kind, o.price, CAST(NULL AS DOUBLE) AS low,
        CAST(NULL AS DOUBLE) AS high FROM obs o JOIN cur c USING (wine_id) WHERE o.date >= CAST(c.date - INTERVAL 2 YEAR AS DATE) - 7
        UNION ALL SELECT wine_id, {_day('date', 'date')}, 'forecast', price, price, price FROM cur
            UNION ALL SELECT wine_id, {_day('target_date', 'date')}, 'forecast', p50, p10, p90 FROM forecasts WHERE model_version = 'v2'""",
    "s4_typed_csv": MARTS + " SELECT vintage, count(*) AS n, round(sum(price), 6) + 0.0 AS total, true AS missing_is_none FROM series GROUP BY vintage",
    "s5_weather_json": CONTEXT_SQL + f" SELECT region, {_day('date', 'date')}, " + ", ".join(f"""CASE
        WHEN day(date) % 9 <> 0 THEN round({e}, 3) + 0.0 END AS {n}""" for n,
    e in (("t_max", "t_mean + 6"), ("t_min", "t_mean - 6"), ("t_mean", "t_mean"), ("rain", "rain"))) + " FROM daily",
    "s6_wide_crush": """SELECT 'crush_' || y AS file, CAST(y AS INTEGER) AS crop_year, CASE d WHEN 5 THEN 'state' ELSE CAST(d AS VARCHAR) END AS district, sum(l_quantity) AS value
        FROM (SELECT year(l_shipdate) AS y, l_suppkey % 5 + 1 AS d, l_quantity FROM lineitem) WHERE d <> 4 AND NOT (d = 2 AND y % 3 = 0) GROUP BY y, d""",
    "s8_upsert": MARTS + """, old AS (SELECT wine_id AS id, slug FROM wines
        WHERE wine_id % 3 <> 0), new AS (SELECT slug, wine_id % 7 <> 0 AS is_active FROM wines WHERE wine_id % 5 <> 0)
        SELECT id, slug, coalesce(is_active, false) AS is_active FROM old LEFT JOIN new USING (slug) UNION ALL SELECT (SELECT max(id)
            FROM old) + row_number() OVER (ORDER BY slug), slug, is_active FROM new WHERE slug NOT IN (SELECT slug FROM old)""",
    "s9_replace_source": MARTS + """ SELECT CASE wine_id % 2 WHEN 0 THEN 'a' ELSE 'b' END AS source, count(*) AS n, round(sum(price), 6) + 0.0 AS total
        FROM obs WHERE wine_id % 2 = 1 OR price > 50 GROUP BY ALL""",
    "s10_export": MARTS + " SELECT family, count(*) AS n, round(sum(price), 6) + 0.0 AS total FROM series GROUP BY family",
    "s11_publish": MARTS + """ SELECT model_version, model_version = 'v2' AS is_active, count(*) AS n FROM forecasts
        WHERE model_version = 'v1' OR wine_id % 2 = 0 GROUP BY model_version""",
    "s12_metrics": MARTS + " SELECT promo_type, count(*) AS rows, count(DISTINCT wine_id) AS wines FROM obs GROUP BY promo_type",
    "t1_incremental_ingest": """SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, arg_max(value,
        event_id) AS value FROM events GROUP BY user_id""",
}
SQL |= {"a1_linked_batches": SQL["a1_components"], "t1_latest_rows": SQL["t1_incremental_ingest"]}
