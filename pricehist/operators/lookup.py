"""Keyword tables of any size, looked up by word n-grams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricehist.functions import names as n

#: The most keywords that are broadcast (some megabytes).
SMALL = 50_000


def ngrams(text: Column, most: int) -> Column:
    """The different runs of 1 to `most` words of a folded text."""
    words = F.split(text, " ")

    def starting(i: Column) -> Column:
        # Runs that would reach past the last word end there too, as equal ones.
        return F.transform(F.sequence(F.lit(1), F.lit(most)), lambda k: F.array_join(F.slice(words, i, k), " "))

    return F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.size(words)), starting)))


def keyword_lookup(rows: DataFrame, name: str, table: DataFrame, value: str = "value") -> DataFrame:
    """rows with `value`, what the longest keyword stands for that is in their name as whole words, with apostrophes read as a space or dropped.

    table: keyword (folded), value; place (optional) says which of equally long keywords counts, the least, and then the least value. Every different
    name is folded and cut into n-grams once, and these meet the keywords in a hash join, so the cost of a name does not depend on the size of
    the table. A table of at most SMALL keywords is broadcast, and names and their n-grams never are: Spark takes them for as small as the compressed
    file that they come from. Null and empty names, and those without a keyword, have a null
    value; null and empty keywords are never found. A column of rows that is called as `value` is an error."""
    if value.lower() in (c.lower() for c in rows.columns):
        raise ValueError(f"rows have a column {value}")
    place = F.col("place") if "place" in table.columns else F.lit(0)
    keys = table.filter("keyword <> ''").select(F.col("keyword").alias("_gram"), F.struct((-F.length("keyword")).alias("l"), place.alias("p"), F.col("value").alias("v")).alias("_hit"))
    about = keys.agg(F.max(F.size(F.split("_gram", " "))).alias("most"), F.count(F.lit(1)).alias("n")).first()
    most = about["most"] or 1
    names = rows.select(F.col(name).alias("_name")).filter("_name IS NOT NULL").distinct()
    readings = n.bound(n._latin(F.col("_name")), lambda x: F.array(n._clean(x, " "), n._clean(x, "")))
    grams = names.withColumn("_read", readings).select("_name", F.explode(F.array_distinct(F.flatten(F.transform("_read", lambda t: ngrams(t, most))))).alias("_gram"))
    found = grams.join(F.broadcast(keys) if about["n"] <= SMALL else keys.hint("merge"), "_gram").groupBy("_name").agg(F.min("_hit").alias("_hit")).hint("merge")
    return rows.join(found, rows[name] == found["_name"], "left").select(*[rows[c] for c in rows.columns], F.col("_hit.v").alias(value))
