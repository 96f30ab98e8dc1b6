"""Queries of metrics and fair prices over a fixed scoring expression."""

from __future__ import annotations

from pyspark.sql import functions as F

from pricehist.functions.numbers import ln
from pricehist.functions.shared import cut, written
from pricehist.operators import fair, metrics, panel
from pricehist.plans.panel import DENSE
from pricehist.sources import adapters as a
from pricehist.sources.adapters import PRELUDE, day, r6

CUTOFF, CALIBRATION = 23, 4  # the last four of 28 lists are the holdout


def scored(spark, sf_dir):
    """Samples with predictions that follow from their keys (many tied scores): a stand-in for a fitted model."""
    s = a.series(spark, sf_dir).select("wine_id", "t", "date", "price", "tier", "region", "vintage")
    x = panel.diffs(s, ln).withColumn("lr_4", F.col("log_price") - F.first("log_price").over(panel.by_wine().rangeBetween(-4, -4)))
    x = panel.horizons(x, 4, 4)
    k = (F.col("wine_id") * 31 + F.col("t") * 7 + F.col("h") * 3) % 100
    return x.withColumns({
        "p10": -(k % 10 + 1) / 200, "p50": (k % 7 - 3) / 200, "p90": (k % 12 + 1) / 150, "p_up": F.floor(k / 5) / 20, "p_down": (k % 8) / 8,
    })


def split(x):
    """M1: fit, calibration or holdout, by the target's list."""
    return F.when(x["target_t"] <= CUTOFF - CALIBRATION, "fit").when(x["target_t"] <= CUTOFF, "calibration").otherwise("holdout")


def _base(x):
    c = panel.base_rates(x.filter(split(x) == "calibration"))
    return c.select("h", F.explode(F.array(F.struct(F.lit("up").alias("side"), F.col("up").alias("base_rate")),
        F.struct(F.lit("down").alias("side"), F.col("down").alias("base_rate")))).alias("b")).select("h", "b.*")


def _rounded(df, keep, *columns):
    return df.select(*keep, *[r6(F.col(c)).alias(c) for c in columns])


def m1_time_split(spark, sf_dir):
    x = scored(spark, sf_dir)
    return x.groupBy(split(x).alias("split"), "h").agg(F.count(F.lit(1)).alias("n"), F.min("target_t").alias("first_t"), F.max("target_t").alias("last_t"))


def m6_conformal(spark, sf_dir):
    x = scored(spark, sf_dir)
    adjust = metrics.conformal_adjust(x.filter(split(x) == "calibration"))
    inside = metrics.widen(x.filter(split(x) == "holdout"), adjust).groupBy("h").agg(F.count_if(F.col("y").between(F.col("p10"), F.col("p90"))).alias("covered"))
    return adjust.join(inside, "h").select("h", r6(F.col("adjust")).alias("adjust"), "covered")


RANGE = ["changed_pct", "mape", "mape_naive", "mape_drift", "mape_changed", "mape_naive_changed", "coverage_80", "pinball_10", "pinball_50", "pinball_90"]


def m7_range_scores(spark, sf_dir):
    x = scored(spark, sf_dir)
    return _rounded(metrics.range_scores(x.filter(split(x) == "holdout"), ["h"]), ["h", "n"], *RANGE)


CHANGE = ["roc_auc", "avg_precision", "actual_rate", "predicted_rate", "brier_skill"]


def m8_change_scores(spark, sf_dir):
    x = scored(spark, sf_dir)
    return _rounded(metrics.change_scores(x.filter(split(x) == "holdout"), _base(x)), ["h", "side", "n", "positives"], *CHANGE)


def a16_segment_grid(spark, sf_dir):
    x = scored(spark, sf_dir)
    tests = {"all": F.lit(True), "dated": F.col("vintage") != "NV", "luxury": F.col("tier") == "luxury", "north": F.col("region").isin("NATION_2", "NATION_3")}
    y = metrics.segments(x.filter(split(x) == "holdout").filter("h IN (1, 4)"), tests)
    return _rounded(metrics.change_scores(y, _base(x), ("segment", "h", "side")), ["segment", "h", "side", "n", "positives"], *CHANGE)


def m9_importance(spark, sf_dir):
    x = scored(spark, sf_dir).withColumn("id", F.concat_ws("|", "wine_id", "t", "h")).select("id", "y", "lr_4", "log_price", F.col("h").cast("double").alias("h"))
    score = lambda d: d.withColumn("p_up", F.coalesce(F.col("lr_4"), F.lit(0.0)) * -1 + F.col("log_price") * 0.01)
    return metrics.importance(x, ["lr_4", "log_price", "h"], score)


def o6_importance_ranking(spark, sf_dir):
    return m9_importance(spark, sf_dir).orderBy(F.desc("auc_drop"))


def a15_cv_summary(spark, sf_dir):
    """Rolling one-year windows: errors of four ways to predict y, as sets."""
    x = scored(spark, sf_dir).withColumn("fold", F.floor((27 - F.col("target_t")) / 4)).filter("fold < 4")
    ways = {"current": F.lit(0.0), "+p50": F.col("p50"), "+drift": F.coalesce("lr_4", F.lit(0.0)) / 4 * F.col("h"), "+both": (F.col("p50") + F.coalesce("lr_4", F.lit(0.0))) / 2}
    e = F.explode(F.array(*[F.struct(F.lit(n).alias("set"), F.abs(F.col("y") - p).alias("e"), F.signum(p) .alias("s")) for n, p in ways.items()]))
    g = x.withColumn("w", e).groupBy("fold", "w.set").agg(F.avg("w.e").alias("mae"), F.avg((F.signum("y") == F.col("w.s")).cast("double")).alias("auc"))
    return _rounded(metrics.cv_summary(g), ["set", "folds_mae_better", "folds_auc_better"], "mae", "auc", "mae_vs_current", "auc_vs_current")


def latest(spark, sf_dir):
    return fair.latest_rows(a.newest(spark, sf_dir)).withColumn("fold", metrics.fold_of(F.col("family"), 5))


def f16_latest_rows(spark, sf_dir):
    return latest(spark, sf_dir).select("wine_id", day("date").alias("date"), "vintage_age", "is_nv", r6(F.col("listing_year")).alias("listing_year"),
        r6(F.col("y")).alias("y"), "text")


def m13_family_folds(spark, sf_dir):
    return latest(spark, sf_dir).groupBy("fold").agg(F.count(F.lit(1)).alias("wines"), F.countDistinct("family").alias("families"))


def a12_brand_encoding(spark, sf_dir):
    x = latest(spark, sf_dir)
    e = fair.brand_encoding(x.select("brand", "family", "y"), x.select("wine_id", "brand", "family"))
    return e.select("wine_id", r6(F.col("brand_mean_logp")).alias("brand_mean_logp"), "brand_n_families", r6(F.col("brand_std_logp")).alias("brand_std_logp"))


def _comparable(spark, sf_dir):
    """What baselines and bands need of the latest rows, computed once: both read it several times."""
    return written(latest(spark, sf_dir).select("wine_id", "date", "tier", "fold", "region", "grape", "brand", "y"), "latest")


def a13_baselines(spark, sf_dir):
    return _rounded(fair.baselines(_comparable(spark, sf_dir), 5), ["wine_id", "fold"], "region_grape", "producer")


def _banded(rows):
    x = fair.baselines(rows, 5)
    return x.withColumns({"p50": F.col("producer"), "p10": F.col("producer") - 0.6, "p90": F.col("producer") + 0.5})


def m15_band_scale(spark, sf_dir):
    x = _banded(_comparable(spark, sf_dir))
    return metrics.band_scale(x).select(F.round("k", 2).alias("k"))


def m15_value_pct(spark, sf_dir):
    rows = _comparable(spark, sf_dir)
    newest = rows.agg(F.max("date").alias("newest"))
    return _banded(rows).join(F.broadcast(newest), F.col("date") == F.col("newest")).select("wine_id", metrics.value_pct(F.col("y"), F.col("p50")).alias("value_pct"))


FAIR = ["median_abs_pct_error", "mae_log", "r2_log", "coverage_80"]


def m14_fair_scores(spark, sf_dir):
    return _rounded(fair.evaluate(_banded(_comparable(spark, sf_dir)), ["tier"]), ["tier", "wines"], *FAIR)


def m12_name_terms(spark, sf_dir):
    """The selection of the oracle's SQL: the texts of one fold. m12_name_terms_all has every text."""
    x = latest(spark, sf_dir)
    return _rounded(fair.tfidf(x.select("wine_id", "text"), x.filter("fold = 0").select("wine_id", "text")), ["wine_id", "term"], "w")


def m12_name_terms_all(spark, sf_dir):
    x = cut(latest(spark, sf_dir).select("wine_id", "text"))
    return _rounded(fair.tfidf(x, x), ["wine_id", "term"], "w")


QUERIES = {f.__name__: f for f in (
    m1_time_split, m6_conformal, m7_range_scores, m8_change_scores, a16_segment_grid, m9_importance, o6_importance_ranking, a15_cv_summary,
    f16_latest_rows, m13_family_folds, a12_brand_encoding,
    a13_baselines, m15_band_scale, m15_value_pct, m14_fair_scores, m12_name_terms, m12_name_terms_all,
)}

_up = "ln(1.005)"
SCORED = DENSE + """, sc0 AS (
    SELECT s.*, CAST(s.h AS INTEGER) AS hh, (s.wine_id * 31 + s.t * 7 + s.h * 3) % 100 AS k, o.logp, o.logp - b.logp AS lr_4, w.tier, w.region, w.vintage,
        CASE WHEN target_t <= 19 THEN 'fit' WHEN target_t <= 23 THEN 'calibration' ELSE 'holdout' END AS split
    FROM samples s JOIN dense o ON o.wine_id = s.wine_id AND o.t = s.t LEFT JOIN dense b ON b.wine_id = s.wine_id AND b.t = s.t - 4 JOIN wines w ON w.wine_id = s.wine_id
), sc AS (
    SELECT *, -(k % 10 + 1) / 200 AS p10, (k % 7 - 3) / 200 AS p50, (k % 12 + 1) / 150 AS p90, floor(k / 5) / 20 AS p_up, (k % 8) / 8 AS p_down FROM sc0
), base AS (
    SELECT hh, side, avg(CAST(CASE side WHEN 'up' THEN y > ln(1.005) ELSE y < -ln(1.005) END AS DOUBLE)) AS base_rate FROM sc CROSS
        JOIN (SELECT unnest(['up', 'down']) AS side) WHERE split = 'calibration' GROUP BY ALL
), sd AS (
    SELECT sc.*, s.side, CASE s.side WHEN 'up' THEN p_up ELSE p_down END AS score, CAST(CASE s.side WHEN 'up' THEN y > ln(1.005)
        ELSE y < -ln(1.005) END AS DOUBLE) AS hit, base_rate
    FROM sc CROSS JOIN (SELECT unnest(['up', 'down']) AS side) s JOIN base b ON b.hh = sc.hh AND b.side = s.side WHERE split = 'holdout'
)"""
_r = lambda e, n: f"round({e}, 6) + 0.0 AS {n}"


def _change(source: str, by: str) -> str:
    """AUC by average ranks, average precision by cumulative counts of whole ties."""
    return f""", x AS ({source}), ranked AS (
        SELECT *, rank() OVER (PARTITION BY {by} ORDER BY score) + (count(*) OVER (PARTITION BY {by}, score) - 1) / 2 AS r,
            sum(hit) OVER (PARTITION BY {by} ORDER BY score DESC) AS tp, count(*) OVER (PARTITION BY {by} ORDER BY score DESC) AS pp FROM x
    ) SELECT {by.replace('hh', 'hh AS h')}, count(*) AS n, CAST(sum(hit) AS BIGINT) AS positives,
        round(CASE WHEN sum(hit) BETWEEN 1 AND count(*) - 1 THEN (sum(r) FILTER (hit = 1) - sum(hit) * (sum(hit) + 1) / 2) / (sum(hit) * (count(*) -
            sum(hit))) END, 6) + 0.0 AS roc_auc,
        round(CASE WHEN sum(hit) > 0 THEN sum(hit * tp / pp) / sum(hit) END, 6) + 0.0 AS avg_precision, {_r('avg(hit)', 'actual_rate')}, {_r('avg(score)', 'predicted_rate')},
        {_r('1 - avg((score - hit) ** 2) / avg((base_rate - hit) ** 2)', 'brier_skill')} FROM ranked GROUP BY {by}"""


_auc = "CASE WHEN sum(hit) BETWEEN 1 AND count(*) - 1 THEN (sum(r) FILTER (hit = 1) - sum(hit) * (sum(hit) + 1) / 2) / (sum(hit) * (count(*) - sum(hit))) END"
_place = lambda k: f"row_number() OVER (ORDER BY md5('{k}|' || id), id)"
_moved = lambda k, f: f"SELECT '{f}' AS feature, a.hit, " + ", ".join(f"{'b' if c == f else 'a'}.{c}" for c in ("lr_4", "log_price", "h")) + f"""
    FROM drawn a JOIN drawn b ON b.r{k + 1} = a.r0"""  # noqa: E731
IMPORTANCE = SCORED + f""", drawn AS (
    SELECT *, {", ".join(f"{_place(k)} AS r{k}" for k in range(4))} FROM (
        SELECT wine_id || '|' || t || '|' || hh AS id, lr_4, logp AS log_price, CAST(hh AS DOUBLE) AS h, CAST(y > ln(1.005) AS DOUBLE) AS hit
            FROM sc ORDER BY md5('7|' || wine_id || '|' || t || '|' || hh), id LIMIT 40000)
), moved AS (
    SELECT '' AS feature, hit, lr_4, log_price, h FROM drawn UNION ALL {" UNION ALL ".join(_moved(k, f) for k, f in enumerate(("lr_4", "log_price", "h")))}
), ranks AS (
    SELECT *, rank() OVER (PARTITION BY feature ORDER BY score) + (count(*) OVER (PARTITION BY feature, score) - 1) / 2 AS r
        FROM (SELECT feature, hit, coalesce(lr_4, 0) * -1 + log_price * 0.01::DOUBLE AS score FROM moved)
), aucs AS (
    SELECT feature, {_auc} AS auc FROM ranks GROUP BY feature
) SELECT feature, round((SELECT auc FROM aucs WHERE feature = '') - auc, 4) + 0.0 AS auc_drop FROM aucs WHERE feature <> ''"""
_mape = lambda p: f"abs(exp({p}) - exp(y)) / exp(y) * 100"
_drift = "(coalesce(lr_4, 0) / 4 * hh)"
LATEST = PRELUDE + """, latest AS (
    SELECT *, year(date) - TRY_CAST(vintage AS INTEGER) AS vintage_age, ln(price) AS y, CAST(('0x' || substr(md5(family), 1,
        8)) AS BIGINT) % 5 AS fold FROM series QUALIFY row_number() OVER (PARTITION BY wine_id ORDER BY date DESC) = 1
), bl AS (
    SELECT wine_id, fold, y, tier, date, coalesce((SELECT median(y) FROM latest b
        WHERE b.fold <> a.fold AND b.region = a.region AND b.grape = a.grape), (SELECT median(y) FROM latest b
        WHERE b.fold <> a.fold)) AS region_grape,
        (SELECT median(y) FROM latest b WHERE b.fold <> a.fold AND b.brand = a.brand) AS m_br FROM latest a
), banded AS (
    SELECT *, coalesce(m_br, region_grape) AS p50, coalesce(m_br, region_grape) - 0.6::DOUBLE AS p10, coalesce(m_br, region_grape) + 0.5::DOUBLE AS p90 FROM bl
)"""
SQL = {
    "m1_time_split": SCORED + " SELECT split, hh AS h, count(*) AS n, CAST(min(target_t) AS INTEGER) AS first_t, CAST(max(target_t) AS INTEGER) AS last_t FROM sc GROUP BY ALL",
    "m6_conformal": SCORED + """, q AS (SELECT hh, list_sort(list(greatest(p10 - y, y - p90))) AS l, count(*) AS n, least(1,
        ceil((count(*) + 1) * 0.8::DOUBLE) / count(*)) * (count(*) - 1) AS pos FROM sc WHERE split = 'calibration' GROUP BY hh),
        adj AS (SELECT hh, l[CAST(floor(pos) AS BIGINT) + 1] + (l[CAST(ceil(pos) AS BIGINT) + 1] - l[CAST(floor(pos) AS BIGINT) + 1]) * (pos - floor(pos)) AS adjust FROM q)
        SELECT hh AS h, round(adjust, 6) + 0.0 AS adjust, count(*) FILTER (y BETWEEN least(p10 - adjust, p50, p90 + adjust)
            AND greatest(p10 - adjust, p50, p90 + adjust)) AS covered FROM sc JOIN adj USING (hh) WHERE split = 'holdout' GROUP BY hh, adjust""",
    "m7_range_scores": SCORED + f""" SELECT hh AS h, count(*) AS
        n, {_r('avg(CAST(abs(y) > 1e-9 AS DOUBLE)) * 100', 'changed_pct')}, {_r(f"avg({_mape('p50')})", 'mape')}, {_r(f"avg({_mape('0')})", 'mape_naive')}, {_r(f"avg({_mape(_drift)})", 'mape_drift')},
        {_r(f"avg({_mape('p50')}) FILTER (abs(y) > 1e-9)", 'mape_changed')}, {_r(f"avg({_mape('0')}) FILTER (abs(y) > 1e-9)", 'mape_naive_changed')}, {_r('avg(CAST(y BETWEEN p10 AND p90 AS DOUBLE)) * 100', 'coverage_80')},
        """ + ", ".join(_r(f"avg(greatest({q} * (y - p{n}), ({q} - 1) * (y - p{n})))", f"pinball_{n}") for n,
        q in ((10, "0.1::DOUBLE"), (50, "0.5::DOUBLE"), (90, "0.9::DOUBLE"))) + " FROM sc WHERE split = 'holdout' GROUP BY hh",
    "m8_change_scores": SCORED + _change("SELECT * FROM sd", "hh, side"),
    "a16_segment_grid": SCORED + _change("""SELECT 'all' AS segment, * FROM sd WHERE hh IN (1, 4) UNION ALL SELECT 'dated', * FROM sd
        WHERE hh IN (1, 4) AND vintage <> 'NV' UNION ALL SELECT 'luxury', * FROM sd WHERE hh IN (1, 4) AND tier = 'luxury'
        UNION ALL SELECT 'north', * FROM sd WHERE hh IN (1, 4) AND region IN ('NATION_2', 'NATION_3')""", "segment, hh, side"),
    "m9_importance": IMPORTANCE,
    "o6_importance_ranking": IMPORTANCE,
    "a15_cv_summary": SCORED + """, ways AS (SELECT CAST(floor((27 - target_t) / 4) AS BIGINT) AS fold, y, u.set, u.p FROM sc CROSS
        JOIN LATERAL (VALUES ('current', 0.0::DOUBLE), ('+p50', p50), ('+drift', coalesce(lr_4, 0) / 4 * hh), ('+both',
        (p50 + coalesce(lr_4, 0)) / 2)) u(set, p)),
        g AS (SELECT fold, set, avg(abs(y - p)) AS mae, avg(CAST(sign(y) = sign(p) AS DOUBLE)) AS auc FROM ways WHERE fold < 4 GROUP BY ALL)
        SELECT a.set, count(*) FILTER (a.mae < c.mae) AS folds_mae_better, count(*) FILTER (a.auc > c.auc) AS folds_auc_better,
            """ + ", ".join([_r("avg(a.mae)", "mae"), _r("avg(a.auc)", "auc"), _r("avg(a.mae - c.mae)", "mae_vs_current"),
        _r("avg(a.auc - c.auc)", "auc_vs_current")]) + """
        FROM g a JOIN g c ON c.fold = a.fold AND c.set = 'current' GROUP BY a.set""",
    "f16_latest_rows": LATEST + """ SELECT wine_id, strftime(date, '%Y-%m-%d') AS date, CAST(vintage_age AS INTEGER) AS vintage_age,
        CAST(vintage = 'NV' AS DOUBLE) AS is_nv, """ + _r("year(date) + (month(date) - 1) / 12", "listing_year") + ", " + _r("y",
    "y") + ", lower(name) AS text FROM latest",
    "m13_family_folds": LATEST + " SELECT CAST(fold AS INTEGER) AS fold, count(*) AS wines, count(DISTINCT family) AS families FROM latest GROUP BY fold",
    "a12_brand_encoding": LATEST + """ SELECT a.wine_id, round(avg(b.y), 6) + 0.0 AS brand_mean_logp, count(DISTINCT b.family) AS brand_n_families,
        round(CASE WHEN count(b.y) > 1 THEN stddev_pop(b.y) END, 6) + 0.0 AS brand_std_logp
        FROM latest a LEFT JOIN latest b ON b.brand = a.brand AND b.family <> a.family GROUP BY a.wine_id""",
    "a13_baselines": LATEST + " SELECT wine_id, CAST(fold AS INTEGER) AS fold, round(region_grape, 6) + 0.0 AS region_grape, round(p50, 6) + 0.0 AS producer FROM banded",
    "m15_band_scale": LATEST + """, k AS (SELECT 1 + i / 100 AS k FROM range(200) r(i)) SELECT round(min(k), 2) AS k
        FROM (SELECT k, avg(CAST(y >= p50 - k * (p50 - p10) - 1e-12 AND y <= p50 + k * (p90 - p50) + 1e-12 AS DOUBLE)) AS c FROM banded CROSS JOIN k
        GROUP BY k) WHERE c >= 0.8""",
    "m15_value_pct": LATEST + " SELECT wine_id, round((exp(y - p50) - 1) * 100, 1) AS value_pct FROM banded WHERE date = (SELECT max(date) FROM banded)",
    "m14_fair_scores": LATEST + f""" SELECT tier, count(*) AS
        wines, {_r('median(abs(exp(p50 - y) - 1)) * 100', 'median_abs_pct_error')}, {_r('avg(abs(p50 - y))', 'mae_log')}, {_r('1 - sum((p50 - y) ** 2) / (var_pop(y) * count(*))', 'r2_log')},
        {_r('avg(CAST(y BETWEEN p10 AND p90 AS DOUBLE)) * 100', 'coverage_80')} FROM banded GROUP BY tier""",
    "m12_name_terms": LATEST + """, w AS (SELECT wine_id, fold, string_split(lower(name), ' ') AS w
        FROM latest), tm AS (SELECT wine_id, fold, unnest(w || [w[1] || ' ' || w[2]]) AS term
        FROM w), tf AS (SELECT wine_id, fold, term, count(*) AS tf FROM tm GROUP BY ALL),
        idf AS (SELECT term, ln((1 + (SELECT count(*) FROM latest)) / (1 + count(*))) + 1 AS idf FROM tf GROUP BY term
            HAVING count(*) >= 2), x AS (SELECT wine_id, term, (1 + ln(tf)) * idf AS w FROM tf JOIN idf USING (term) WHERE fold = 0)
        SELECT wine_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY wine_id)), 6) + 0.0 AS w FROM x""",
    "m12_name_terms_all": LATEST + """, w AS (SELECT wine_id, string_split(lower(name), ' ') AS w
        FROM latest), tm AS (SELECT wine_id, unnest(w || [w[1] || ' ' || w[2]]) AS term
        FROM w), tf AS (SELECT wine_id, term, count(*) AS tf FROM tm GROUP BY ALL),
        idf AS (SELECT term, ln((1 + (SELECT count(*) FROM latest)) / (1 + count(*))) + 1 AS idf FROM tf GROUP BY term
            HAVING count(*) >= 2), x AS (SELECT wine_id, term, (1 + ln(tf)) * idf AS w FROM tf JOIN idf USING (term))
        SELECT wine_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY wine_id)), 6) + 0.0 AS w FROM x""",
}
