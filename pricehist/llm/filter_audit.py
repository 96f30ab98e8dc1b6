"""What five filters remove in every order in which they can be applied (operator 12).

Documents become flags, flags become counts of their 32 combinations for each part, and these counts, reshaped to 2x2x2x2x2 (pass or fail
along the axis of each filter), answer every question by a contraction: a filter before the present one is `pass`, a later one `all`.

Failures: A: under 50 words; B: 100 * different words < 65 * words; C: 100 * [A-Z] > 5 * code points; D: any of #$%&*|; E: the text of a
smaller doc_id anywhere in the table.

Defined results: null texts are empty (so they fail A, and E if an empty text has a smaller doc_id), null sources are the part ''; texts of
any length are looked at whole; rows of one doc_id all count, and a repeated row is not a copy of itself; rows with a null doc_id never
fail E and have no labels; of contradictory labels of one document 1 holds, null labels are 0; an empty table gives no rows; other
columns are ignored. Rows are counted by flags before any shuffle by part, so that a part may hold any share of them; a task gets at
most 32 counts of a part. Copies are joined by (text, smallest doc_id), which no more rows share than have one doc_id."""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricehist.llm.common import stored

FILTERS = "ABCDE"
WORDS, VARIETY, CAPITALS = 50, 65, 5
COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def failures(text: Column) -> dict[str, Column]:
    """The failures of a text that need no other text."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    n, different = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    return {"A": n < WORDS, "B": 100 * different < VARIETY * n, "C": 100 * capitals > CAPITALS * F.length(text), "D": text.rlike("[#$%&*|]")}


def flagged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, A to E, good, toxic of every row of docs (doc_id, text, source)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    part = F.coalesce(F.col("source").cast("string"), F.lit(""))
    rows = docs.select("doc_id", part.alias("part"), text.alias("text")).select("doc_id", "part", F.sha2("text", 256).alias("digest"), *[x.alias(k) for k, x in failures(F.col("text")).items()])
    rows = stored(rows, "flags")
    firsts = rows.filter("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    marks = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(*[F.max(F.coalesce(F.col(c) == 1, F.lit(False))).alias(k) for k, c in (("good", "quality"), ("toxic", "toxic"))])
    named = rows.filter("doc_id IS NOT NULL").join(firsts, ["digest", "doc_id"], "left").join(marks, "doc_id", "left")
    known = named.select("part", *FILTERS[:4], F.col("first").isNull().alias("E"), *[F.coalesce(k, F.lit(False)).alias(k) for k in ("good", "toxic")])
    no = F.lit(False)
    return known.unionByName(rows.filter("doc_id IS NULL").select("part", *FILTERS[:4], no.alias("E"), no.alias("good"), no.alias("toxic")))


def contract(counts: np.ndarray) -> list[tuple]:
    """filter_order, step and COUNTS for counts of shape (3, 2, 2, 2, 2, 2): all documents, good, toxic; 0 passes, 1 fails."""
    passes, fails, either = np.array([[1, 0], [0, 1], [1, 1]], np.int64)

    def total(chosen: dict[str, np.ndarray], rest: np.ndarray) -> np.ndarray:
        return np.einsum("nabcde,a,b,c,d,e->n", counts, *[chosen.get(f, rest) for f in FILTERS])

    out, shares = [], dict.fromkeys(FILTERS, 0)
    for order in permutations(FILTERS):
        before: dict[str, np.ndarray] = {}
        for step, f in enumerate(order, 1):
            removed, good, toxic = total(before | {f: fails}, either)
            failing = total({f: fails}, either)[0]
            kept = total(before | {f: passes}, either)[0]
            alone = total({f: fails}, passes)[0]
            shares[f] += int(removed)
            out.append(("".join(order), step, kept, removed, failing - removed, alone, good, toxic))
            before[f] = passes
    return [(*row, shares[row[0][row[1] - 1]]) for row in out]


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step and the counts of COUNTS: 600 rows a part."""
    counts = flagged(docs, labels).groupBy("part", *FILTERS).agg(F.count(F.lit(1)).alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic"))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        tensor = np.zeros((3, 2, 2, 2, 2, 2), np.int64)
        tensor[:, *[rows[f].to_numpy().astype(int) for f in FILTERS]] = rows[["n", "good", "toxic"]].to_numpy().T
        out = pd.DataFrame(contract(tensor), columns=["filter_order", "step", *COUNTS])
        return out.assign(part=rows["part"].iloc[0])

    return counts.groupBy("part").applyInPandas(run, f"part string, filter_order string, step int, {', '.join(f'{c} long' for c in COUNTS)}")
