"""Queries of parsing and classification (S1-S3, P1-P20, P23-P26, U1, U3, A17) over price lists written from lineitem and part."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pricehist.functions import names as n
from pricehist.functions.shared import shared_dir
from pricehist.operators.lookup import keyword_lookup
from pricehist.sources import adapters as a
from pricehist.sources import price_lists as pl
from pricehist.sources.adapters import PRELUDE, day

# Words of the written names, by the part's number: every rule is met.
LEADS = ["Château", "The", "Stag's Leap", "Bourbon Barrel", "Rosé de", "Villa", "Vodka", "Domaine du"]
GRAPES = ["Cabernet Sauvignon", "Merlot", "Chardonnay", "Brut", "Port", "Red Blend", "Grüner Veltliner", "Albariño", "", "Malbec"]
PLACES = ["Napa", "Rioja", "Barolo Riserva", "Chianti Classico", "Sonoma Vineyard", "Grand Cru", "Montepulciano d'Abruzzo", "Mosel", "", "New York", "Haut-Médoc"]
SIZES = ["750 mL", "0.75 L", "1.5 L", "375 ML", "12 OZ", "1,750 ML", "EACH", "25.4 oz"]
WHOLE_SIZES = ["750 ML", "750 ML", "1500 ML", "375 ML", "355 ML", "1750 ML", "EACH", "751 ML"]


def _pick(words: list[str], by: F.Column) -> F.Column:
    return F.get(F.array(*[F.lit(w) for w in words]), (by % len(words)).cast("int"))


def descriptions(spark, sf_dir):
    """wine_id, description, size, vint (its year or Nonvintage) of every part."""
    k = F.col("p_partkey")
    vint = F.when(F.col("p_size") % 10 == 0, "Nonvintage").otherwise((F.col("p_size") + 1950).cast("string"))
    words = F.concat_ws(" ", _pick(LEADS, k), F.initcap("p_name"), _pick(GRAPES, F.floor(k / 3)), _pick(PLACES, F.floor(k / 7)), vint)
    return a.table(spark, sf_dir, "part").select(k.alias("wine_id"), F.regexp_replace(words, " +", " ").alias("description"),
        _pick(SIZES, k).alias("size"), vint.alias("vint"), "p_name", "p_brand", (F.col("p_retailprice") / F.col("p_size")).alias("base"))


def listing_lines(spark, sf_dir):
    """file, page, line_no, text: a price list for every quarter, in pages of bounded size."""
    d = descriptions(spark, sf_dir).select("wine_id", "description", "size")
    x = a.obs_raw(spark, sf_dir).join(d, "wine_id")
    file = F.concat(F.lit("list_"), F.date_format("date", "yyyyMMdd"), F.lit(".txt"))
    key = ["code", "line", "supp", "ext", "qty", "disc", "tax"]
    x = x.select(file.alias("file"), F.floor(F.col("code") / 100).cast("int").alias("page"), *key, "date", "price", "promo_type", "promo_price", "description", "size")
    # Lines are written after the shuffle, which then carries each description once.
    x = x.withColumn("at", F.row_number().over(Window.partitionBy("file", "page").orderBy(*key)))
    usd = lambda c: F.concat(F.lit("$"), F.format_number(c, 2))
    code, kind = F.lpad(F.col("code").cast("string"), 9, "0"), (F.col("code") + F.col("line")) % 6
    mdy = lambda days: F.when(F.year(F.date_add("date", days)) < 2000,
        F.date_format(F.date_add("date", days), "MM/dd/yyyy")).otherwise(F.date_format(F.date_add("date", days), "M/d/yy"))
    promo = (
        F.when(F.col("promo_type") == "sale", F.concat_ws(" ", mdy(5), mdy(33), usd(F.col("promo_price")))).when(F.col("promo_type") == "clearance",
        usd(F.col("promo_price"))).otherwise(F.lit("........"))
    )
    # Parts that several lines use are columns of their own, so that each is formatted once a row.
    x = x.withColumns({"c": code, "kind": kind, "tail": F.concat_ws(" ", F.col("size"), promo, usd(F.col("price"))), "words": F.split("description", " ")})
    kind, half = F.col("kind"), F.floor(F.size("words") / 2).cast("int")
    first, rest = F.array_join(F.slice("words", 1, half), " "), F.array_join(F.slice("words", half + 1, 99), " ")
    orphan, line = F.concat_ws(" ", "c", "tail"), F.concat_ws(" ", "c", "description", "tail")
    noise, broken = F.lit("Code Size Retail prices"), F.concat("c", F.lit(" no size here $5.00"))
    text = (
        F.when(kind == 0, F.array(F.concat(F.lit("  "), first), rest, orphan)).when(kind == 1, F.array(noise, line))
        .when(kind == 2, F.array(F.lit("Old Name"), first, broken, rest, orphan)).when(kind == 3, F.array(line, orphan)).otherwise(F.array(line))
    )
    return x.select("file", "page", "at", F.posexplode(text).alias("j", "text")).select("file", "page", (F.col("at") * 8 + F.col("j")).cast("int").alias("line_no"), "text")


def _parsed(spark, sf_dir):
    return pl.parse(listing_lines(spark, sf_dir))


def p1_parsed_prices(spark, sf_dir):
    x = _parsed(spark, sf_dir).filter("NOT miss")
    # Dates and decimals are shorter keys than what they are shown as.
    g = x.groupBy("report_date", "code", "description", "vintage", "size", "regular_price", "promo_price", "promo_type", "sale_start", "sale_end").agg(F.count(F.lit(1)).alias("n"))
    return g.withColumns({c: day(c) for c in ("report_date", "sale_start", "sale_end")} | {c: F.col(c).cast("double") for c in ("regular_price", "promo_price")})


def p2_wrapped_names(spark, sf_dir):
    x = pl.parse(listing_lines(spark, sf_dir), ("kind",))
    return x.filter("NOT miss AND kind = 'orphan'").groupBy("code", "description").agg(F.count(F.lit(1)).alias("n"))


def p3_line_kinds(spark, sf_dir):
    return pl.marked(listing_lines(spark, sf_dir)).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def a17_ingest_audit(spark, sf_dir):
    return _parsed(spark, sf_dir).groupBy("file").agg(F.count_if(~F.col("miss")).alias("rows"), F.count_if(F.col("miss")).alias("misses"))


def _written(spark, sf_dir) -> str:
    """The lists as text files, one a quarter, with form feeds between pages."""
    path = f"{shared_dir(spark)}/lists-{uuid.uuid4().hex}"
    x = listing_lines(spark, sf_dir)
    pages = x.groupBy("file", "page").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "text"))), lambda s: s["text"]), "\n").alias("p"))
    # Pages stay separate lines of one file's partition: a file is as large as its quarter, and is split again by readers that need it.
    pages.withColumn("name", F.regexp_extract("file", r"(\d{8})", 1)).select("name", F.concat("p", F.lit("\f")).alias("value")).write.partitionBy("name").text(path)
    return path


def s1_read_lines(spark, sf_dir):
    x = pl.read_lines(spark, _written(spark, sf_dir)).filter("text <> ''")
    return x.groupBy("text").agg(F.count(F.lit(1)).alias("n"))


def s2_report_dates(spark, sf_dir):
    return listing_lines(spark, sf_dir).groupBy("file").agg(F.count(F.lit(1)).alias("lines")).select("file", "lines", day(pl.report_date(F.col("file"))).alias("report_date"))


def s3_written_prices(spark, sf_dir):
    path = f"{shared_dir(spark)}/prices-{uuid.uuid4().hex}"
    pl.write_prices(_parsed(spark, sf_dir), path)
    return spark.read.parquet(path).groupBy(day("report_date").alias("report_date")).agg(F.count(F.lit(1)).alias("rows"),
        F.sum(F.col("regular_price").cast("double")).alias("total"))


def u1_all_lists(spark, sf_dir):
    """Rows of the early and the late lists, put together again."""
    x = _parsed(spark, sf_dir)
    both = x.filter("report_date < '1998-01-01'").unionByName(x.filter("report_date >= '1998-01-01'"))
    return both.groupBy("miss").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("code").alias("codes"))


def _column(**columns):
    """A query of column functions over descriptions, each called on its row's columns."""

    def query(spark, sf_dir):
        return descriptions(spark, sf_dir).select("wine_id", *[f().alias(c) for c, f in columns.items()])

    return query


D, S = F.col, F.col
_d = lambda: F.col("description")
_s = lambda: n.normalized_size(F.col("size"))
_family = lambda: n.product_key(_d(), _s())
_v = lambda: n.vintage_or_nv(n.vintage_of(_d()))


def p5_promo_types(spark, sf_dir):
    return _parsed(spark, sf_dir).filter("NOT miss").groupBy("promo_type").agg(F.count(F.lit(1)).alias("n"), F.count("sale_start").alias("dated"))


def p7_dates(spark, sf_dir):
    o = a.table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("d"))
    text = F.when((F.col("o_orderkey") % 2 == 0) & (F.year("d") >= 2000), F.date_format("d", "M/d/yy")).otherwise(F.date_format("d", "MM/dd/yyyy"))
    return o.select("o_orderkey", day(n.date_of(text)).alias("date"))


def p8_money(spark, sf_dir):
    return a.table(spark, sf_dir, "orders").select("o_orderkey", n.money(F.format_number("o_totalprice", 2)).cast("double").alias("amount"))


def p15_folded_names(spark, sf_dir):
    x = a.table(spark, sf_dir, "documents")
    return x.select("doc_id", F.md5(n.folded_any(F.col("text"))).alias("any"), F.md5(n.folded(F.col("text"))).alias("latin"), F.md5(n.folded(F.col("text"), "")).alias("joined"))


def p23_deal_flags(spark, sf_dir):
    d = descriptions(spark, sf_dir)
    return d.select("wine_id", n.deal_flag(F.lit(60.0), F.col("base") * 0.8, F.when(F.col("wine_id") % 7 != 0, F.col("base") * 1.2)).alias("flag"))


def p24_shelf_price(spark, sf_dir):
    return a.obs(spark, sf_dir).select("wine_id", day("date").alias("date"), n.shelf_price(F.col("price"), F.col("promo_price")).alias("shelf_price"))


def p25_labels(spark, sf_dir):
    d = a.lists(spark, sf_dir).select("t", n.quarter_label(F.col("date")).alias("label"))
    w = a.wines(spark, sf_dir).select(n.title(F.col("name"), F.col("vintage")).alias("title"), (F.col("wine_id") % 4).cast("int").alias("t"))
    return w.join(F.broadcast(d), "t").groupBy("title", "label").agg(F.count(F.lit(1)).alias("n"))


SCENARIOS = [(1, "keep", 0.0, None), (2, "none", 0.0, None), (3, "sale", 20.0, None), (4, "clearance", 35.0, None), (5, "keep", 0.0, 30.0), (6, "sale", 10.0, 50.0)]


def scenario_rows(latest, scenarios):
    """Latest listings under each scenario. scenarios: scenario_id, promo (keep, none, sale or clearance), discount_pct (0 to 80; over 0 for
    a sale or clearance, or the scenario is left out), list_price (null: as it is). A few scenarios by all listings."""
    ok = scenarios.filter("discount_pct BETWEEN 0 AND 80 AND (promo IN ('keep', 'none') OR discount_pct > 0) AND coalesce(list_price, 1) > 0")
    x = latest.join(F.broadcast(ok), F.lit(True))
    price = F.coalesce("list_price", "price")
    cut = F.col("promo").isin("sale", "clearance")
    promo = F.when(cut, a.cents(price * (1 - F.col("discount_pct") / 100))).when(F.col("promo") == "keep", F.col("promo_price"))
    kind = F.when(cut, F.col("promo")).when(F.col("promo") == "keep", F.col("promo_type"))
    return x.select("scenario_id", "wine_id", "date", price.alias("price"), promo.alias("promo_price"), kind.alias("promo_type"))


def p26_scenarios(spark, sf_dir):
    s = spark.createDataFrame(SCENARIOS, "scenario_id int, promo string, discount_pct double, list_price double")
    o = a.obs(spark, sf_dir)
    latest = o.groupBy("wine_id").agg(F.max_by(F.struct("date", "price", "promo_price", "promo_type"), "date").alias("x")).select("wine_id", "x.*")
    return scenario_rows(latest, s).withColumn("date", day("date"))


def p16_region_lookup(spark, sf_dir):
    """The regions of p16_region, from a keyword table that is joined to the n-grams of names."""
    table = spark.createDataFrame([(k, v, i) for i, (k, v) in enumerate(n.REGION_KEYWORDS.items())], "keyword string, value string, place int")
    rows = descriptions(spark, sf_dir).select("wine_id", _d().alias("description"))
    return keyword_lookup(rows, "description", table, "region").select("wine_id", "region")


def u3_stop_words(spark, sf_dir):
    """Words of part names that a stop list keeps and drops."""
    w = a.table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("word")).distinct()
    extra = F.array(F.lit("red"), F.lit("hot"), F.lit("green"))
    stop = F.array_except(F.array_union(F.array(*[F.lit(s) for s in n.stop_words()]), extra), F.array(F.lit("old")))
    return w.select("word", F.array_contains(stop, F.col("word")).alias("stop"))


QUERIES = {f.__name__: f for f in (
    p1_parsed_prices, p2_wrapped_names, p3_line_kinds, a17_ingest_audit, s1_read_lines, s2_report_dates, s3_written_prices, u1_all_lists,
    p5_promo_types, p7_dates, p8_money, p15_folded_names, p23_deal_flags, p24_shelf_price, p25_labels, p26_scenarios, p16_region_lookup, u3_stop_words,
)} | {
    "p4_vintage": _column(vintage=lambda: n.vintage_of(_d())),
    "p6_size": _column(size=_s),
    "p9_style": _column(style=lambda: n.style_of(_d())),
    "p10_is_wine": _column(is_wine=lambda: n.is_wine(_d(), _s())),
    "p11_tier": _column(tier=lambda: n.tier_of(F.col("base"))),
    "p12_product_key": _column(family=_family),
    "p13_display_name": _column(name=lambda: n.display_name(_d())),
    "p14_slug": _column(slug=lambda: n.slug(_family(), _v())),
    "p16_region": _column(region=lambda: n.region_of(_d())),
    "p17_grape": _column(grape=lambda: n.grape_of(_d())),
    "p18_classification": _column(classification=lambda: n.classification_of(_d())),
    "p19_brand": _column(brand=lambda: n.brand_of(_d(), ("napa", "mosel"))),
    "p20_name_text": _column(text=lambda: n.name_text(_d())),
}

_list = lambda w: "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in w) + "]"
_at = lambda w, k: f"({_list(w)})[CAST({k} AS BIGINT) % {len(w)} + 1]"
NAMES = PRELUDE + f""", descr AS (
    SELECT p_partkey AS wine_id, {_at(SIZES, 'p_partkey')} AS size, {_at(WHOLE_SIZES, 'p_partkey')} AS whole_size, p_retailprice / p_size AS base, p_name,
        CASE WHEN p_size % 10 = 0 THEN 'Nonvintage' ELSE CAST(p_size + 1950 AS VARCHAR) END AS vint,
        {_at(LEADS, 'p_partkey')} AS lead, upper(substr(p_name, 1, 1)) || substr(split_part(p_name, ' ', 1),
            2) || ' ' || upper(substr(split_part(p_name, ' ', 2), 1, 1)) || substr(split_part(p_name, ' ', 2), 2) AS own,
        {_at(GRAPES, 'floor(p_partkey / 3)')} AS grape_word, {_at(PLACES, 'floor(p_partkey / 7)')} AS place
    FROM part
), d AS (
    SELECT *, regexp_replace(concat_ws(' ', lead, own, grape_word, place, vint), ' +', ' ', 'g') AS description FROM descr
), f AS (
    -- folded: no accents, lower case, words apart
    SELECT *, strip_accents(description) AS plain, trim(regexp_replace(lower(strip_accents(description)), '[^a-z0-9]+', ' ', 'g')) AS name,
        trim(regexp_replace(replace(lower(strip_accents(description)), '''', ''), '[^a-z0-9]+', ' ', 'g')) AS joined FROM d
), lines AS (
    SELECT r.*, description, whole_size, (code + line) % 6 AS kind FROM obs_raw r JOIN d USING (wine_id)
)"""


def _ascii(pattern: str) -> str:
    return pattern.replace("'", "''").replace(r"\d", "[0-9]").replace(r"\b", r"\b").replace("(?!", "(?:")


def _style_case() -> str:
    has = lambda words: f"regexp_matches(plain, '(?i)\\b({_ascii(words)})\\b')"
    rules = " ".join(f"WHEN {has(w)} THEN '{s}'" for s, w in n.STYLES.items())
    return f"CASE WHEN {has(n.SPIRIT)} AND NOT regexp_matches(plain, '(?i){_ascii(n.BARREL_AGED)}') THEN NULL {rules} WHEN regexp_matches(plain, '{n.VINTAGE}') THEN 'red' END"


def _longest(table: dict, *names: str) -> str:
    rows = ", ".join(f"('{k}', '" + v.replace("'", "''") + f"', {i})" for i, (k, v) in enumerate(table.items()))
    hit = " OR ".join(f"contains(' ' || f.{x} || ' ', ' ' || k || ' ')" for x in names)
    return f"(SELECT v FROM (VALUES {rows}) AS kw(k, v, i) WHERE {hit} ORDER BY length(k) DESC, i LIMIT 1)"


_family_sql = r"""trim(regexp_replace(lower(regexp_replace(regexp_replace(description, '(?i)\bnonvintage\b', '', 'g'), '\b(19[5-9]\d|20[0-3]\d)\b',
    '', 'g')), '[^a-z0-9]+', '-', 'g'), '-') || '-' || regexp_replace(lower(whole_size), '[^a-z0-9]+', '', 'g')"""
_v_sql = "CASE vint WHEN 'Nonvintage' THEN 'NV' ELSE vint END"
# The letters of the given texts have no compatibility forms, so taking accents off and dropping what is not ASCII is the whole folding.
_ascii_sql = r"lower(regexp_replace(strip_accents(text), '[^\x00-\x7F]', '', 'g'))"
_clean_sql = lambda e: f"md5(trim(regexp_replace({e}, '[^a-z0-9]+', ' ', 'g')))"
_apart = lambda by: f"replace({_ascii_sql}, chr(39), '{by}')"
_usd_sql = lambda c: f"'$' || format('{{:,.2f}}', {c})"
_mdy_sql = lambda k: f"CASE WHEN year(date + {k}) < 2000 THEN strftime(date + {k}, '%m/%d/%Y') ELSE strftime(date + {k}, '%-m/%-d/%y') END"
_first_not = lambda words, of: f"coalesce(nullif(list_position(list_transform({words}, lambda w: NOT list_contains({_list(of)}, w)), true), 0), len({words}) + 1)"
SQL = {
    "p1_parsed_prices": NAMES + """ SELECT strftime(date, '%Y-%m-%d') AS report_date, lpad(CAST(code AS VARCHAR), 9, '0') AS code, description,
        CASE WHEN vint = 'Nonvintage' THEN 'NV' ELSE vint END AS vintage, whole_size AS size, price AS regular_price, promo_price, promo_type,
        CASE promo_type WHEN 'sale' THEN strftime(date + 5, '%Y-%m-%d') END AS sale_start, CASE promo_type
            WHEN 'sale' THEN strftime(date + 33, '%Y-%m-%d') END AS sale_end, count(*) AS n
        FROM lines JOIN (SELECT wine_id, vint FROM d) USING (wine_id) GROUP BY ALL""",
    "s1_read_lines": NAMES + f""", parts AS (
            SELECT kind, lpad(CAST(code AS VARCHAR), 9, '0') AS code, description, string_split(description, ' ') AS w,
                CAST(floor(len(string_split(description, ' ')) / 2) AS BIGINT) AS half,
                concat_ws(' ', size, CASE promo_type WHEN 'sale' THEN concat_ws(' ', {_mdy_sql(5)}, {_mdy_sql(33)}, {_usd_sql('promo_price')})
                    WHEN 'clearance' THEN {_usd_sql('promo_price')} ELSE '........' END, {_usd_sql('price')}) AS tail
            FROM lines JOIN (SELECT wine_id, size FROM d) USING (wine_id)
        ), pieces AS (
            SELECT kind, array_to_string(w[1:half], ' ') AS head, array_to_string(w[half + 1:], ' ') AS rest, code || ' ' || tail AS orphan,
                code || ' ' || description || ' ' || tail AS line, code || ' no size here $5.00' AS broken FROM parts
        ), texts AS (
            SELECT unnest(CASE kind WHEN 0 THEN ['  ' || head, rest, orphan] WHEN 1 THEN ['Code Size Retail prices', line]
                WHEN 2 THEN ['Old Name', head, broken, rest, orphan] WHEN 3 THEN [line, orphan] ELSE [line] END) AS text FROM pieces
        ) SELECT text, count(*) AS n FROM texts WHERE text <> '' GROUP BY text""",
    "p2_wrapped_names": NAMES + " SELECT lpad(CAST(code AS VARCHAR), 9, '0') AS code, description, count(*) AS n FROM lines WHERE kind IN (0, 2) GROUP BY ALL",
    "p3_line_kinds": NAMES + """ SELECT k AS kind, count(*) AS n FROM (SELECT unnest(CASE kind WHEN 0 THEN ['name', 'name', 'orphan'] WHEN 1 THEN ['noise', 'product']
        WHEN 2 THEN ['name', 'name', 'miss', 'name', 'orphan'] WHEN 3 THEN ['product', 'orphan'] ELSE ['product'] END) AS k FROM lines) GROUP BY k""",
    "a17_ingest_audit": NAMES + """ SELECT 'list_' || strftime(date, '%Y%m%d') || '.txt' AS file, count(*) AS rows, count(*) FILTER (kind IN (2,
        3)) AS misses FROM lines GROUP BY date""",
    "s2_report_dates": NAMES + """ SELECT 'list_' || strftime(date, '%Y%m%d') || '.txt' AS file, CAST(sum((([3, 2, 5, 2, 1,
        1])[kind + 1])) AS BIGINT) AS lines, strftime(date, '%Y-%m-%d') AS report_date FROM lines GROUP BY date""",
    "s3_written_prices": NAMES + """ SELECT strftime(date, '%Y-%m-%d') AS report_date, count(*) AS rows, CAST(sum(CAST(price AS DECIMAL(18,
        2))) AS DOUBLE) AS total FROM lines GROUP BY date""",
    "u1_all_lists": NAMES + """ SELECT false AS miss, count(*) AS n, count(DISTINCT code) AS codes FROM lines
        UNION ALL SELECT true, count(*), count(DISTINCT CASE kind WHEN 3 THEN code END) FROM lines WHERE kind IN (2, 3)""",
    "p5_promo_types": NAMES + " SELECT promo_type, count(*) AS n, count(*) FILTER (promo_type = 'sale') AS dated FROM lines GROUP BY promo_type",
    "p7_dates": "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS date FROM orders",
    "p8_money": "SELECT o_orderkey, o_totalprice AS amount FROM orders",
    "p15_folded_names": f"SELECT doc_id, {_clean_sql(_apart(' '))} AS any, {_clean_sql(_apart(' '))} AS latin, {_clean_sql(_apart(''))} AS joined FROM documents",
    "p23_deal_flags": NAMES + """ SELECT wine_id, CASE WHEN wine_id % 7 = 0 THEN NULL WHEN 60 < base * 0.8::DOUBLE THEN 'deal'
        WHEN 60 > base * 1.2::DOUBLE THEN 'premium' ELSE 'fair' END AS flag FROM d""",
    "p24_shelf_price": PRELUDE + " SELECT wine_id, strftime(date, '%Y-%m-%d') AS date, coalesce(promo_price, price) AS shelf_price FROM obs",
    "p25_labels": PRELUDE + """ SELECT CASE vintage WHEN 'NV' THEN name ELSE name || ' ' || vintage END AS title, 'Q' || quarter(date) || ' ' || year(date) AS label, count(*) AS n
        FROM wines JOIN periods ON t = wine_id % 4 GROUP BY ALL""",
    "p26_scenarios": PRELUDE + """, last AS (SELECT * FROM obs QUALIFY row_number() OVER (PARTITION BY wine_id ORDER BY date DESC) = 1),
        s(scenario_id, promo, pct, lp) AS (VALUES (1, 'keep', 0.0::DOUBLE, NULL::DOUBLE), (2, 'none', 0.0, NULL), (3, 'sale', 20.0, NULL), (4,
            'clearance', 35.0, NULL), (5, 'keep', 0.0, 30.0), (6, 'sale', 10.0, 50.0))
        SELECT CAST(scenario_id AS INTEGER) AS scenario_id, wine_id, strftime(date, '%Y-%m-%d') AS date, coalesce(lp, price) AS price,
            CASE WHEN promo IN ('sale', 'clearance') THEN floor(coalesce(lp, price) * (1 - pct / 100) * 100 + 0.5) / 100 WHEN promo = 'keep' THEN promo_price END AS promo_price,
            CASE WHEN promo IN ('sale', 'clearance') THEN promo WHEN promo = 'keep' THEN promo_type END AS promo_type FROM last CROSS JOIN s""",
    "u3_stop_words": "SELECT word, word IN (" + ", ".join(f"'{w}'" for w in [*n.stop_words(), "hot", "green"] if w != "old") + """) AS stop
        FROM (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS word FROM part)""",
    "p4_vintage": NAMES + f" SELECT wine_id, {_v_sql} AS vintage FROM d",
    "p6_size": NAMES + " SELECT wine_id, whole_size AS size FROM d",
    "p9_style": NAMES + f" SELECT wine_id, {_style_case()} AS style FROM f",
    "p10_is_wine": NAMES + f""" SELECT wine_id, coalesce(whole_size IN ('187 ML', '250 ML', '375 ML', '500 ML', '750 ML', '1000 ML', '1500 ML',
        '3000 ML', '5000 ML') AND ({_style_case()}) IS NOT NULL, false) AS is_wine FROM f""",
    "p11_tier": NAMES + " SELECT wine_id, CASE WHEN base < 25 THEN 'everyday' WHEN base < 75 THEN 'premium' ELSE 'luxury' END AS tier FROM d",
    "p12_product_key": NAMES + f" SELECT wine_id, {_family_sql} AS family FROM d",
    "p13_display_name": NAMES + """ SELECT wine_id, regexp_replace(concat_ws(' ', lead, own, grape_word, place), '( +| +$)', ' ', 'g') AS name
        FROM d""".replace("regexp_replace(concat_ws", "trim(regexp_replace(concat_ws").replace("'g') AS name", "'g')) AS name"),
    "p14_slug": NAMES + f" SELECT wine_id, {_family_sql} || '-' || lower({_v_sql}) AS slug FROM d",
    "p16_region": NAMES + f" SELECT wine_id, {_longest(n.REGION_KEYWORDS, 'name', 'joined')} AS region FROM f",
    "p17_grape": NAMES + f" SELECT wine_id, coalesce({_longest(n.GRAPES, 'name')}, {_longest(n.IMPLIED, 'name')}) AS grape FROM f",
    "p18_classification": NAMES + " SELECT wine_id, CASE " + " ".join(f"WHEN regexp_matches(name, '{p}') THEN '{c}'" for c,
    p in n.CLASSIFICATIONS) + " END AS classification FROM f",
    "p19_brand": NAMES + rf""", words AS (
            SELECT wine_id, string_split(trim(regexp_replace(regexp_replace(name, '\b(19|20)\d{{2}}\b', ' ', 'g'), ' +', ' ', 'g')), ' ') AS w FROM f
        ), led AS (
            SELECT wine_id, w, {_first_not('w', [*n.PREFIXES, *n.PARTICLES])} AS k FROM words
        ), tails AS (
            SELECT wine_id, w[1:k] AS lead, w[k + 1:] AS r, {_first_not('w[k + 1:]', n.PARTICLES)} AS j FROM led
        ), whole AS (
            SELECT wine_id, list_reverse(lead || r[1:j - 1] || CASE WHEN j > len(r)
                OR r[j] IN (SELECT unnest({_list(n.stop_words(('napa', 'mosel')))})) OR regexp_matches(r[j], '^[0-9]+$') THEN []
                ELSE [r[j]] END) AS b FROM tails
        ) SELECT wine_id, nullif(array_to_string(list_reverse(b[{_first_not('b', n.PARTICLES)}:]), ' '), '') AS brand FROM whole""",
    "p20_name_text": NAMES + r" SELECT wine_id, regexp_replace(lower(description), '\b(19|20)\d{2}\b', ' ', 'g') AS text FROM d",
}
SQL["p16_region_lookup"] = SQL["p16_region"]
