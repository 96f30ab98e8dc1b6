"""URL filters by dated lists, with DataFrame functions alone (operator 4).

A list's dated additions and removals become validity intervals (each addition lasts until the entry's next line). A capture
is looked up under its host and every parent domain, and counts as listed where an entry's interval holds its fetch time; of
several, the longest domain is reported.

Captures are reduced to different hosts and days before they meet the list, so a hot host is a row a day there. The list is broadcast
only up to BROADCAST_ROWS intervals, which is counted first; beyond that the join shuffles by domain and Spark splits hot domains at
run time. Captures take up their answer by host and day, those of hot ones by a broadcast of these few answers.

The host follows the last @ before the path, without its port and the dots at its end; a scheme may be missing before `//`, and an
address in brackets is one host. Defined results: null and malformed URLs have no host and are not listed, as are captures without a time; repeated lines of a
list count once; an addition and a removal at one time leave the entry off; captures of equal page_id, host and day are one row, any
others (such as one page fetched from two hosts) a row each; URLs of any length are looked up whole; empty tables give no rows, and an
empty list lists nothing; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricehist.functions.shared import spread_join
from pricehist.llm.common import stored

BROADCAST_ROWS = 100_000
HOST = r"^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#]*@)?(\[[^\]/?#@]*\]|[^/?#:@]*[^/?#:@.])\.*(?::[^/?#@]*)?(?:[/?#]|\z)"


def host_of(url: Column) -> Column:
    return F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), HOST, 1)


def intervals(lines: DataFrame) -> DataFrame:
    """domain, since, until (null: still listed). lines: domain, day, action ('add' or 'remove')."""
    state = lines.groupBy("domain", "day").agg(F.min(F.col("action") == "add").alias("on"))
    ahead = state.selectExpr("domain", "day AS since", "`on`", "lead(day) OVER (PARTITION BY domain ORDER BY day) AS until")
    return ahead.filter("`on`").select("domain", "since", "until")


def evaluate(captures: DataFrame, lines: DataFrame) -> DataFrame:
    """page_id, host, day, listed, domain, since of every different capture. captures: page_id, url, day."""
    active = stored(intervals(lines), "intervals")
    few = active.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    site = F.concat_ws("|", F.coalesce(F.col("day").cast("string"), F.lit("?")), "host")
    rows = stored(captures.select("page_id", host_of(F.col("url")).alias("host"), "day").distinct().withColumn("site", site), "captures")
    parts = F.split("host", r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "."))
    # Captures of one host and day ask the list once.
    sites = stored(rows.groupBy("site", "host", "day").agg(F.count(F.lit(1)).alias("n")), "sites")
    asked = sites.select("site", "day", F.explode(parents).alias("domain"))
    on = (asked["domain"] == active["domain"]) & (asked["day"] >= active["since"]) & (F.col("until").isNull() | (asked["day"] < active["until"]))
    found = asked.join(F.broadcast(active) if few else active, on).select("site", active["domain"].alias("domain"), "since")
    best = found.groupBy("site").agg(F.max(F.struct(F.length("domain").alias("size"), "domain", "since")).alias("best"))
    answers = stored(sites.select("site", "n").join(best, "site", "left"), "answers")
    return spread_join(rows, answers, "site").select(
        "page_id", "host", "day", F.col("best").isNotNull().alias("listed"), F.col("best.domain").alias("domain"), F.col("best.since").alias("since"))


def dated_captures(pages: DataFrame) -> DataFrame:
    """Captures of pages: the fetch day (days since 2024-01-01) follows from the page."""
    return pages.select("page_id", "url", (F.col("page_id") * 13 % 366).cast("int").alias("day"))


def dated_list(captures: DataFrame) -> DataFrame:
    """A list over the captured domains: two of three are added, removed and some added again, on days that follow from their first page."""
    host = captures.select("page_id", host_of(F.col("url")).alias("host")).filter("host <> ''")
    parts = F.split("host", r"\.")
    levels = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "."))
    first = host.groupBy("host").agg(F.min("page_id").alias("m")).select(F.explode(levels).alias("domain"), "m").groupBy("domain").agg(F.min("m").alias("m")).filter("m % 3 <> 0")
    line = lambda day, action: f"named_struct('day', int({day}), 'action', '{action}')"
    two = f"array({line('m * 37 % 200', 'add')}, {line('m * 37 % 200 + m * 11 % 90 + 5', 'remove')})"
    again = f"CASE WHEN m % 2 = 0 THEN array({line('m * 37 % 200 + 120', 'add')}) ELSE array() END"
    return first.selectExpr("domain", f"explode(concat({two}, {again})) AS x").select("domain", "x.day", "x.action")
