"""Column functions over product names, sizes, dates and prices."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The patterns of the price lists and of their names.
MONEY = r"\$([\d,]+\.\d{2})"
DATE = r"(\d{1,2}/\d{1,2}/\d{2,4})"
SIZE = r"([\d.,]+\s*(?:ML|mL|L|OZ|oz|LTR)|EACH|KIT)"
PRICES = rf"(?:{DATE}\s+{DATE}\s+)?(?:(?:{MONEY}|\.{{3,}})\s+)?{MONEY}\s*$"
LINE = rf"^\s*(\d{{3,}})\s+(.+?)\s+{SIZE}\s+{PRICES}"
ORPHAN = rf"^\s*(\d{{3,}})\s+{SIZE}\s+{PRICES}"
NOT_NAME = r"^(Code Size|Pennsylvania Liquor|Retail prices|Wholesale prices|due to limited|\d+/\d+/\d{4} )"
VINTAGE = r"\b(19[5-9]\d|20[0-3]\d)\b"
WINE_SIZE = r"^(187|250|375|500|750|1000|1500|3000|5000) ML$"
SPIRIT = (
    "vodka|tequila|mezcal|whiske?y|scotch|bourbon|rye|rum|gin|brandy|cognac|armagnac|liqueur|schnapps|cordial|absinthe|grappa|pisco|soju|sake|proof|"
    "cocktails?|seltzer|hard cider|moonshine|spirits?|vermouth|aperitivo|amaro|bitters|cream liqueur|margarita|mixer|cans?"
)
BARREL_AGED = r"\b(bourbon|whiske?y|rum)\s+barrel"
STYLES = {
    "sparkling": "champagne|prosecco|cava|cr[eé]mant|brut|sparkling|spumante|franciacorta|asti|sekt|p[eé]tillant|lambrusco",
    "rose": "ros[eé]|rosato|rosado|blush|white zinfandel",
    "dessert": "port|porto|sherry|madeira|marsala|sauternes|tokaji|ice ?wine|late harvest|vin santo|moscatel|dessert",
    "white": "chardonnay|sauvignon blanc|pinot grigio|pinot gris|riesling|moscato|muscat|albari[nñ]o|chenin|gr[uü]ner|viognier|chablis|sancerre|soave|"
    "vinho verde|gew[uü]rztraminer|white|blanc|verdejo|vermentino|torront[eé]s|pouilly|semillon|fiano|assyrtiko|trebbiano|pecorino|garganega|marsanne|"
    "roussanne|muscadet|bianco|branco|blanco",
    "red": "cabernet|merlot|pinot noir|syrah|shiraz|malbec|zinfandel|sangiovese|tempranillo|grenache|garnacha|nebbiolo|barolo|barbaresco|chianti|brunello|"
    "rioja|ribera|bordeaux|burgundy|bourgogne|c[oô]tes du rh[oô]ne|ch[aâ]teauneuf|beaujolais|red|rosso|tinto|rouge|primitivo|montepulciano|"
    "nero d'avola|carmen[eè]re|petite sirah|petit verdot|cabernet franc|gamay|amarone|valpolicella|barbera|dolcetto|aglianico|mourv[eè]dre|monastrell|"
    "pinotage|super tuscan|toscana|claret|meritage|m[eé]doc|margaux|pauillac|saint-?[eé]milion|pomerol|napa|saint-? ?julien|saint-? ?est[eè]phe|pessac|"
    "graves|haut-m[eé]doc|douro|mendoza|priorat|toro|bierzo|ch[aâ]teau|domaine|chateau",
}
# Words of names and the grape they stand for; longer ones win.
GRAPES = {
    "cabernet sauvignon": "Cabernet Sauvignon", "cabernet": "Cabernet Sauvignon", "cab sauv": "Cabernet Sauvignon",
    "cabernet franc": "Cabernet Franc", "merlot": "Merlot", "pinot noir": "Pinot Noir", "syrah": "Syrah", "shiraz": "Syrah", "zinfandel": "Zinfandel",
    "primitivo": "Zinfandel", "malbec": "Malbec", "sangiovese": "Sangiovese", "nebbiolo": "Nebbiolo", "tempranillo": "Tempranillo",
    "grenache": "Grenache", "garnacha": "Grenache", "petite sirah": "Petite Sirah", "carmenere": "Carmenere", "pinotage": "Pinotage",
    "barbera": "Barbera", "montepulciano d abruzzo": "Montepulciano", "nero d avola": "Nero d'Avola", "gamay": "Gamay", "mourvedre": "Mourvedre",
    "monastrell": "Mourvedre", "petit verdot": "Petit Verdot", "aglianico": "Aglianico", "corvina": "Corvina", "touriga": "Touriga Nacional",
    "chardonnay": "Chardonnay", "sauvignon blanc": "Sauvignon Blanc", "fume blanc": "Sauvignon Blanc", "pinot grigio": "Pinot Gris",
    "pinot gris": "Pinot Gris", "riesling": "Riesling", "moscato": "Muscat", "muscat": "Muscat", "chenin blanc": "Chenin Blanc",
    "gruner veltliner": "Gruner Veltliner", "albarino": "Albarino", "viognier": "Viognier", "gewurztraminer": "Gewurztraminer", "verdejo": "Verdejo",
    "vermentino": "Vermentino", "semillon": "Semillon", "torrontes": "Torrontes", "glera": "Glera", "red blend": "Red Blend",
    "white blend": "White Blend", "meritage": "Bordeaux Blend",
}
# Places and labels, and the grape that they imply.
IMPLIED = {
    "barolo": "Nebbiolo", "barbaresco": "Nebbiolo", "langhe nebbiolo": "Nebbiolo", "chianti": "Sangiovese", "brunello": "Sangiovese",
    "vino nobile": "Sangiovese", "rioja": "Tempranillo", "ribera del duero": "Tempranillo", "chablis": "Chardonnay", "pouilly fuisse": "Chardonnay",
    "meursault": "Chardonnay", "puligny": "Chardonnay", "chassagne": "Chardonnay", "sancerre": "Sauvignon Blanc", "pouilly fume": "Sauvignon Blanc",
    "vouvray": "Chenin Blanc", "beaujolais": "Gamay", "morgon": "Gamay", "fleurie": "Gamay", "chateauneuf": "Grenache", "cotes du rhone": "Grenache",
    "gigondas": "Grenache", "cote rotie": "Syrah", "hermitage": "Syrah", "prosecco": "Glera", "champagne": "Champagne Blend", "cava": "Cava Blend",
    "amarone": "Corvina", "valpolicella": "Corvina", "soave": "Garganega", "port": "Port Blend", "porto": "Port Blend", "sauternes": "Semillon",
    "bordeaux": "Bordeaux Blend", "medoc": "Bordeaux Blend", "margaux": "Bordeaux Blend", "pauillac": "Bordeaux Blend",
    "saint julien": "Bordeaux Blend", "saint estephe": "Bordeaux Blend", "pessac": "Bordeaux Blend", "graves": "Bordeaux Blend",
    "saint emilion": "Bordeaux Blend", "st emilion": "Bordeaux Blend", "pomerol": "Bordeaux Blend", "haut medoc": "Bordeaux Blend",
}
# Labels, the most prestigious first.
CLASSIFICATIONS = [
    ("Grand Cru Classe", r"\b(premier grand cru classe|1er grand cru classe|grand cru classe|cru classe|premier cru classe|1er cru classe|deuxieme cru|second growth|first growth)\b"),
    ("Grand Cru", r"\bgrand cru\b"),
    ("Premier Cru", r"\b(premier cru|1er cru)\b"),
    ("Gran Reserva", r"\bgran reserva\b"),
    ("Reserva / Riserva", r"\b(reserva|riserva)\b"),
    ("DOCG", r"\b(docg|barolo|barbaresco|brunello|chianti classico|amarone|vino nobile)\b"),
    ("Reserve", r"\b(reserve|private reserve|special selection|grand vin)\b"),
    ("Single Vineyard", r"\b(vineyard|vigna|clos|lieu dit)\b"),
]
# Words at the start of producers' names, particles, and words that end a name.
PREFIXES = "chateau domaine tenuta bodegas bodega castello weingut maison cantina cantine caves cave villa quinta casa vina vinedos poderi podere fattoria marchesi clos mas herdade familia famille".split()
PARTICLES = "the la le les el il lo de du des di del della dei d l san santa st saint ste von van".split()
STOP = (
    "by cellars cellar vineyards vineyard winery wines wine estate estates family company co red white rose brut sparkling reserve reserva riserva grand cru classe "
    "nonvintage blend extra dry sweet limited edition old vine vines single"
).split()
# Words of names and the growing region they stand for; longer ones win. These are the leading keywords of each of the 49
# regions; region_of() takes any table of this form, and read_regions() reads one of any size from a file.
REGION_KEYWORDS = {
    "napa": "Napa Valley", "oakville": "Napa Valley", "rutherford": "Napa Valley", "stags leap": "Napa Valley", "howell mountain": "Napa Valley",
    "carneros": "Napa Valley", "st helena": "Napa Valley", "calistoga": "Napa Valley", "mount veeder": "Napa Valley", "sonoma": "Sonoma",
    "russian river": "Sonoma", "alexander valley": "Sonoma", "dry creek": "Sonoma", "knights valley": "Sonoma", "north coast": "Sonoma",
    "lodi": "Lodi", "california": "California Central Valley", "paso robles": "Paso Robles", "santa barbara": "Santa Barbara",
    "santa rita hills": "Santa Barbara", "santa maria": "Santa Barbara", "santa ynez": "Santa Barbara", "monterey": "Monterey",
    "arroyo seco": "Monterey", "santa lucia highlands": "Monterey", "central coast": "Central Coast", "san luis obispo": "Central Coast",
    "edna valley": "Central Coast", "washington": "Washington", "columbia valley": "Washington", "walla walla": "Washington",
    "horse heaven": "Washington", "red mountain": "Washington", "yakima": "Washington", "oregon": "Oregon", "willamette": "Oregon",
    "dundee hills": "Oregon", "eola amity": "Oregon", "finger lakes": "Finger Lakes", "new york": "Finger Lakes", "seneca lake": "Finger Lakes",
    "lake erie": "Lake Erie", "pennsylvania": "Lake Erie", "marlborough": "Marlborough", "new zealand": "Marlborough", "hawkes bay": "Hawke's Bay",
    "barossa": "Barossa", "eden valley": "Barossa", "mclaren vale": "McLaren Vale", "south australia": "South Australia",
    "coonawarra": "South Australia", "clare valley": "South Australia", "adelaide hills": "South Australia",
    "south eastern australia": "Riverland (South Eastern Australia)", "southeastern australia": "Riverland (South Eastern Australia)",
    "australia": "Riverland (South Eastern Australia)", "riverland": "Riverland (South Eastern Australia)", "mendoza": "Mendoza",
    "uco valley": "Mendoza", "lujan de cuyo": "Mendoza", "argentina": "Mendoza", "chile": "Chile Central Valley", "maipo": "Chile Central Valley",
    "colchagua": "Chile Central Valley", "casablanca": "Chile Central Valley", "rapel": "Chile Central Valley", "curico": "Chile Central Valley",
    "maule": "Chile Central Valley", "stellenbosch": "Western Cape", "western cape": "Western Cape", "south africa": "Western Cape",
    "swartland": "Western Cape", "paarl": "Western Cape", "champagne": "Champagne", "bordeaux": "Bordeaux", "medoc": "Bordeaux",
    "haut medoc": "Bordeaux", "margaux": "Bordeaux", "pauillac": "Bordeaux", "saint julien": "Bordeaux", "saint estephe": "Bordeaux",
    "pessac": "Bordeaux", "graves": "Bordeaux", "sauternes": "Bordeaux", "saint emilion": "Bordeaux", "st emilion": "Bordeaux", "pomerol": "Bordeaux",
    "bourgogne": "Burgundy", "burgundy": "Burgundy", "chablis": "Burgundy", "cote de beaune": "Burgundy", "cote de nuits": "Burgundy",
    "meursault": "Burgundy", "puligny": "Burgundy", "chassagne": "Burgundy", "gevrey": "Burgundy", "pommard": "Burgundy", "volnay": "Burgundy",
    "macon": "Burgundy", "pouilly fuisse": "Burgundy", "vosne": "Burgundy", "beaujolais": "Beaujolais", "morgon": "Beaujolais",
    "fleurie": "Beaujolais", "moulin a vent": "Beaujolais", "brouilly": "Beaujolais", "cotes du rhone": "Rhone", "cote du rhone": "Rhone",
    "chateauneuf": "Rhone", "gigondas": "Rhone", "vacqueyras": "Rhone", "crozes hermitage": "Rhone", "hermitage": "Rhone", "cote rotie": "Rhone",
    "rhone": "Rhone", "condrieu": "Rhone", "provence": "Provence", "bandol": "Provence", "sancerre": "Loire", "vouvray": "Loire", "muscadet": "Loire",
    "pouilly fume": "Loire", "loire": "Loire", "chinon": "Loire", "anjou": "Loire", "alsace": "Alsace", "languedoc": "Languedoc-Roussillon",
    "minervois": "Languedoc-Roussillon", "corbieres": "Languedoc-Roussillon", "pays d oc": "Languedoc-Roussillon",
    "roussillon": "Languedoc-Roussillon", "toscana": "Tuscany", "tuscany": "Tuscany", "chianti": "Tuscany", "brunello": "Tuscany",
    "montalcino": "Tuscany", "bolgheri": "Tuscany", "maremma": "Tuscany", "vino nobile": "Tuscany", "montepulciano": "Tuscany",
    "piedmont": "Piedmont", "piemonte": "Piedmont", "barolo": "Piedmont", "barbaresco": "Piedmont", "langhe": "Piedmont", "asti": "Piedmont",
    "alba": "Piedmont", "gavi": "Piedmont", "veneto": "Veneto", "prosecco": "Veneto", "valpolicella": "Veneto", "amarone": "Veneto",
    "soave": "Veneto", "delle venezie": "Veneto", "alto adige": "Trentino-Alto Adige", "trentino": "Trentino-Alto Adige", "friuli": "Friuli",
    "collio": "Friuli", "abruzzo": "Abruzzo", "montepulciano d abruzzo": "Abruzzo", "puglia": "Puglia", "salento": "Puglia", "sicilia": "Sicily",
    "sicily": "Sicily", "etna": "Sicily", "terre siciliane": "Sicily", "rioja": "Rioja", "ribera del duero": "Ribera del Duero",
    "rueda": "Rueda / Toro", "toro": "Rueda / Toro", "castilla y leon": "Rueda / Toro", "priorat": "Priorat", "montsant": "Priorat",
    "penedes": "Penedes (Cava)", "cava": "Penedes (Cava)", "catalunya": "Penedes (Cava)", "rias baixas": "Rias Baixas", "albarino": "Rias Baixas",
    "douro": "Douro", "porto": "Douro", "port": "Douro", "vinho verde": "Vinho Verde", "mosel": "Mosel", "saar": "Mosel",
    "rheinhessen": "Rheinhessen / Pfalz", "pfalz": "Rheinhessen / Pfalz", "nahe": "Rheinhessen / Pfalz", "rheingau": "Rheingau",
}


def _plain() -> tuple[str, str]:
    """Accented Latin letters and their base letters, by Unicode's decompositions."""
    pairs = [(chr(c), unicodedata.normalize("NFKD", chr(c)).encode("ascii", "ignore").decode()) for c in range(0xC0, 0x250)]
    pairs = [(c, b) for c, b in pairs if len(b) == 1]
    return "".join(c for c, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, BASE = _plain()


def _clean(ascii_lower: Column, apostrophe: str) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(ascii_lower, "'", apostrophe), "[^a-z0-9]+", " "))


def _latin(text: Column) -> Column:
    return F.lower(F.regexp_replace(F.translate(text, ACCENTED, BASE), r"[^\x00-\x7F]", ""))


def folded(text: Column, apostrophe: str = " ") -> Column:
    """P15 by built-in functions: Latin letters without accents, lower case, one space between words. Other characters outside ASCII (a
    curly apostrophe among them) vanish before apostrophes are treated."""
    return _clean(_latin(text), apostrophe)


@F.pandas_udf(StringType())
def _nfkd(text: pd.Series) -> pd.Series:
    return text.map(lambda t: unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode().lower(), na_action="ignore")


def folded_any(text: Column, apostrophe: str = " ") -> Column:
    """P15 for every script, with compatibility forms taken apart (ligatures, fractions)."""
    return _clean(_nfkd(text), apostrophe)


def vintage_of(desc: Column) -> Column:
    """The last year named, else NV if it says nonvintage, else null."""
    last = F.try_element_at(F.regexp_extract_all(desc, F.lit(VINTAGE), 1), F.lit(-1))
    return F.coalesce(last, F.when(F.lower(desc).contains("nonvintage"), F.lit("NV")))


def vintage_or_nv(vintage: Column) -> Column:
    return F.when(vintage.rlike(r"^\d+$"), vintage).otherwise(F.lit("NV"))


def money(text: Column) -> Column:
    """P8."""
    return F.replace(F.nullif(text, F.lit("")), F.lit(","), F.lit("")).cast("decimal(10,2)")


def date_of(text: Column) -> Column:
    """m/d/yy or m/d/yyyy."""
    # The text is matched once and split; to match it for each part makes methods too long to be compiled.
    parts = F.split(F.when(text.rlike(r"^\d{1,2}/\d{1,2}/\d{2,4}$"), text), "/")
    part = lambda k: F.get(parts, F.lit(k)).cast("int")
    y = part(2)
    return F.make_date(F.when(y < 100, y + 2000).otherwise(y), part(0), part(1))


def normalized_size(size: Column) -> Column:
    """Whole millilitres, half to even; other sizes in upper case."""
    up = F.upper(F.trim(F.regexp_replace(size, r"\s+", " ")))
    form = r"^([\d.,]+)\s*(ML|L|LTR|OZ)$"
    qty = F.regexp_replace(F.regexp_extract(up, form, 1), ",", "").try_cast("double")
    unit = F.regexp_extract(up, form, 2)
    ml = qty * F.when(unit == "ML", 1.0).when(unit == "OZ", 29.5735).otherwise(1000.0)
    return F.when(qty.isNotNull(), F.concat(F.rint(ml).cast("bigint").cast("string"), F.lit(" ML"))).otherwise(up)


def promo_type(promo: Column, start: Column) -> Column:
    """P5."""
    return F.when(promo.isNull(), None).when(start.isNotNull(), "sale").otherwise("clearance")


def style_of(desc: Column) -> Column:
    """The first style whose words are in the name; spirits have none, unless barrel-aged; a dated name without words is red."""
    has = lambda words: desc.rlike(rf"(?iU)\b({words})\b")
    spirit = has(SPIRIT) & ~desc.rlike(f"(?iU){BARREL_AGED}")
    out = F.when(spirit, None)
    for style, words in STYLES.items():
        out = out.when(has(words), style)
    return out.when(desc.rlike(VINTAGE), "red")


def is_wine(desc: Column, size: Column) -> Column:
    """P10."""
    return F.coalesce(size.rlike(WINE_SIZE) & style_of(desc).isNotNull(), F.lit(False))


def tier_of(price: Column) -> Column:
    """P11."""
    return F.when(price < 25, "everyday").when(price < 75, "premium").when(price.isNotNull(), "luxury")


def product_key(desc: Column, size: Column) -> Column:
    """A name without year, and the size."""
    base = F.lower(F.regexp_replace(F.regexp_replace(desc, r"(?i)\bnonvintage\b", ""), VINTAGE, ""))
    base = F.regexp_replace(F.regexp_replace(base, "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.concat(base, F.lit("-"), F.regexp_replace(F.lower(size), "[^a-z0-9]+", ""))


def display_name(desc: Column) -> Column:
    """P13."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.replace(desc, F.lit("Nonvintage"), F.lit("")), VINTAGE, ""), r"\s+", " "))


def slug(family: Column, vintage: Column) -> Column:
    """P14."""
    return F.concat(family, F.lit("-"), F.lower(vintage))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once a row however often use refers to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def longest(names: Column, *tables: dict[str, str]) -> Column:
    """The value of the longest keyword of a table that stands in one of some folded names (an array) as whole words; ties in table order.
    Of several tables the first that has one counts."""

    def first_of(padded: Column, table: dict[str, str]) -> Column:
        rows = sorted(table.items(), key=lambda x: -len(x[0]))
        pairs = F.array(*[F.struct(F.lit(f" {k} ").alias("k"), F.lit(v).alias("v")) for k, v in rows])
        return F.get(F.filter(pairs, lambda p: F.contains(padded, p["k"])), F.lit(0))["v"]

    # One text of all names: no keyword holds the bar between them.
    joined = F.concat(F.lit(" "), F.array_join(names, " | "), F.lit(" "))
    return bound(joined, lambda padded: F.coalesce(*[first_of(padded, t) for t in tables]))


def region_of(desc: Column, table: dict[str, str] | None = None) -> Column:
    """Apostrophes are tried as a space and dropped."""
    return longest(bound(_latin(desc), lambda x: F.array(_clean(x, " "), _clean(x, ""))), table or REGION_KEYWORDS)


def read_regions(spark: SparkSession, path: str) -> dict[str, str]:
    """A table for region_of() from a CSV file with columns keyword and region (a dimension: a row for each keyword)."""
    return {r["keyword"]: r["region"] for r in spark.read.csv(path, header=True).select("keyword", "region").collect()}


def grape_of(desc: Column) -> Column:
    """P17."""
    return longest(F.array(folded(desc)), GRAPES, IMPLIED)


def classification_of(desc: Column) -> Column:
    """P18."""
    n, out = folded(desc), None
    for name, pattern in CLASSIFICATIONS:
        out = F.when(n.rlike(pattern), name) if out is None else out.when(n.rlike(pattern), name)
    return out


def stop_words(extra: tuple[str, ...] = ()) -> list[str]:
    """Words that end a producer's name: generic ones, those of grapes and those given."""
    grape = {w for table in (GRAPES, IMPLIED) for k in table for w in k.split()}
    return sorted({*STOP, *extra} | grape)


def brand_of(desc: Column, extra: tuple[str, ...] = ()) -> Column:
    """Leading prefixes and particles, the first other word, particles after it, and the next word unless it is a stop word or a
    number; particles at the end are dropped."""
    name = F.trim(F.regexp_replace(F.regexp_replace(folded(desc), r"\b(19|20)\d{2}\b", " "), " +", " "))
    lead, part = "|".join([*PREFIXES, *PARTICLES]), "|".join(PARTICLES)
    form = rf"^((?:(?:{lead})(?: |$))*+)(\S*)((?: (?:{part})(?= |$))*+)(?: (\S+))?"
    get = lambda k: F.regexp_extract(name, form, k)
    second = F.when(get(4).isin(stop_words(extra)) | get(4).rlike(r"^\d+$"), "").otherwise(get(4))
    whole = F.trim(F.concat_ws(" ", F.trim(get(1)), get(2), F.trim(get(3)), second))
    return F.nullif(F.trim(F.regexp_replace(F.regexp_replace(whole, " +", " "), rf"(?:(?:^| )(?:{part}))+$", "")), F.lit(""))


def name_text(name: Column) -> Column:
    """P20."""
    return F.regexp_replace(F.lower(name), r"\b(19|20)\d{2}\b", " ")


def deal_flag(price: Column, low: Column, high: Column) -> Column:
    """P23."""
    known = price.isNotNull() & low.isNotNull() & high.isNotNull()
    return F.when(known, F.when(price < low, "deal").when(price > high, "premium").otherwise("fair"))


def shelf_price(price: Column, promo: Column) -> Column:
    """P24."""
    return F.coalesce(promo, price)


def quarter_label(date: Column) -> Column:
    """P25."""
    return F.concat(F.lit("Q"), F.quarter(date).cast("string"), F.lit(" "), F.year(date).cast("string"))


def title(name: Column, vintage: Column) -> Column:
    return F.when(vintage == "NV", name).otherwise(F.concat_ws(" ", name, vintage))
