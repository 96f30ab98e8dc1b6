"""MinHash near-dedup with SuperMinHash signatures (operator 6).

1. Every text becomes a set of hashed word shingles, a fingerprint of the whole set and a SuperMinHash signature: each
   shingle ranks all positions by a permutation of its own, and a position keeps its smallest rank plus fraction. Ranks are
   drawn one after another for all shingles at once, and a text stops when no later rank can lower a position.
2. Texts with equal sets become one class. Bands of the signature put classes into buckets; each class is linked to its
   bucket's smallest one, and the components of these links are families: all pairs that need a look lie within one.
3. Within a family links are decided on the full sets. Families of usual size are joined in a task with rarest-first
   prefixes, a union-find skipping pairs that already hang together. Larger families are spread out: shingles that a family
   has once rule out classes that can have no link, the others are compared with the head of each bucket, and classes that then
   are outside their family's largest component are joined with it by their rarest shingles.
4. Confirmed links are united into components.

Bands (30 of 5) miss a pair at a threshold of 0.85 with a probability of 2e-8, at 0.8 of 7e-6, unless both are in one family all the
same. Rows take up their class by a join that broadcasts the few classes with very many copies.

Memory: texts are hashed in slices of about 1 MB; a very long text takes some 30 times its bytes.

Defined results: null and empty texts, and texts without words, have an empty set and are linked with nothing; texts shorter
than a shingle have their whole word sequence as their one shingle; repeated rows and equal sets are one class; an id that repeats
with different texts has a row, and the links, of each; a group's representative is its smallest doc_id; a null doc_id represents
only groups in which all are null, whose texts are compared with no others; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pricehist.functions.shared import spread_join
from pricehist.llm.common import cut, hand_back, slices, stored, texts
from pricehist.operators.components import connected_components

BANDS, ROWS = 30, 5
#: A family up to this many classes and shingles is joined in one task.
FAMILY_CLASSES, FAMILY_SHINGLES = 4_000, 6_000_000
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(column: list[str], width: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text; A-Z is lower-cased and words end at ASCII white space."""
    parts = [t.encode("utf-8", "replace").lower().split() for t in column]
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for p in parts for w in p], np.int64)
    h = np.array([xxhash.xxh64_intdigest(w) for w in number], np.uint64)[ids] if number else np.zeros(0, np.uint64)
    factor = [_mix(np.array([k + 1], np.uint64) * _ODD)[0] | np.uint64(1) for k in range(width)]
    out, a = [], 0
    for p in parts:
        n, one = len(p), h[a : a + len(p)]
        a += n
        size = min(n, width)
        s = np.zeros(n - size + 1 if n else 0, np.uint64)
        for k in range(size):
            # The last step's mixing keeps sums of different orders apart.
            s = _mix(s + one[k : k + len(s)] * factor[k])
        out.append(np.unique(s if n >= width else s ^ _mix(np.array([n], np.uint64))))
    return out


def signatures(sets: list[np.ndarray], m: int, part: int = 1 << 17) -> np.ndarray:
    """SuperMinHash: one row of m values (rank << 32 | fraction) for each set; the largest number throughout for an empty one.

    Shingles go through `part` at a time, each with a permutation of m positions, so the permutations' memory is bounded; a later
    part of a long text starts from the minima of those before it."""
    out = np.full((len(sets), m), np.iinfo(np.uint64).max, np.uint64)
    flat = out.reshape(-1)
    all_items = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    owners = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    for a in range(0, len(all_items), part):
        items, owner = all_items[a : a + part], owners[a : a + part]
        order = np.broadcast_to(np.arange(m, dtype=np.uint8 if m <= 256 else np.uint16), (len(items), m)).copy()
        for rank in range(m):
            if not len(items):
                break
            drawn = _mix(items + np.array([2 * rank + 1], np.uint64) * _ODD)
            row = np.arange(len(items))
            pick = rank + ((drawn >> np.uint64(32)) % np.uint64(m - rank)).astype(np.int64)
            place = order[row, pick].astype(np.int64)
            order[row, pick] = order[row, rank]
            np.minimum.at(flat, owner * m + place, (np.uint64(rank) << np.uint64(32)) | (drawn & np.uint64(0xFFFFFFFF)))
            # All positions have a rank of at most this one: later ranks change nothing.
            more = (out.max(1) >= np.uint64((rank + 1) << 32))[owner]
            if not more.all():
                items, owner, order = items[more], owner[more], order[more]
    return out


def band_keys(sign: np.ndarray, bands: int, rows: int) -> np.ndarray:
    keys = np.zeros((len(sign), bands), np.uint64)
    for k in range(rows):
        keys = _mix(keys + sign[:, k::rows][:, :bands] * _ODD + np.uint64(k))
    return _mix(keys + np.arange(bands, dtype=np.uint64)).view(np.int64)


def fingerprint(shingles: np.ndarray) -> bytes | None:
    """128 bits that tell sets apart; null for an empty one."""
    return xxhash.xxh3_128_digest(shingles.tobytes()) if len(shingles) else None


def sketch(docs: DataFrame, width: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, fingerprint (null for an empty set) and band keys of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = texts(b.column(1).to_pylist())
            for lo, hi in slices(column, 128):
                sets = shingle_sets(column[lo:hi], width)
                keys = band_keys(signatures(sets, bands * rows), bands, rows)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).slice(lo, hi - lo), pa.array([len(s) for s in sets], pa.int64()), pa.array([fingerprint(s) for s in sets], pa.binary()),
                        pa.ListArray.from_arrays(np.arange(0, (hi - lo + 1) * bands, bands, dtype=np.int32), pa.array(keys.reshape(-1))),
                    ],
                    names=["doc_id", "n_shingles", "fingerprint", "bands"],
                )
        hand_back()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_shingles long, fingerprint binary, bands array<long>")


def join_family(n: int, sets: list[np.ndarray], least: int) -> np.ndarray:
    """Component number of each of n sets under links of 100 * intersection >= least * union."""
    _, tokens, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    sizes = np.array([len(s) for s in sets])
    ends = np.cumsum(sizes)
    own = [tokens[e - s : e] for e, s in zip(ends, sizes, strict=True)]
    component = np.arange(n)
    members = {i: [i] for i in range(n)}
    index: dict[int, list[int]] = {}
    here = np.zeros(len(counts), bool)
    for x in np.lexsort((np.arange(n), sizes)).tolist():
        s = int(sizes[x])
        # A partner of at most this size shares one of the rarest shingles, or is linked with nothing.
        head = own[x][np.lexsort((own[x], counts[own[x]]))][: s - -(-least * s // 100) + 1]
        found = [index[t] for t in head.tolist() if t in index]
        if found:
            near = np.unique(np.concatenate([np.array(f) for f in found]))
            near = near[(component[near] != component[x]) & (100 * sizes[near] >= least * s)]
            here[own[x]] = True
            while len(near):
                # The first of each component, then those that are left over.
                _, at = np.unique(component[near], return_index=True)
                some = near[at] if len(at) > 8 or len(near) < 64 else near[:256]
                common = np.add.reduceat(here[np.concatenate([own[y] for y in some])], np.cumsum(sizes[some]) - sizes[some], dtype=np.int64)
                for y in some[100 * common >= least * (s + sizes[some] - common)].tolist():
                    a, b = component[x], component[y]
                    if a != b:
                        a, b = (a, b) if len(members[a]) >= len(members[b]) else (b, a)
                        component[members[b]] = a
                        members[a] += members.pop(b)
                near = near[~np.isin(near, some)]
                near = near[component[near] != component[x]]
            here[own[x]] = False
        for t in head.tolist():
            if counts[t] > 1:
                index.setdefault(t, []).append(x)
    return component


def _families(classes: DataFrame) -> DataFrame:
    """class, family. classes: class, bands."""
    keys = classes.select("class", F.explode("bands").alias("key"))
    heads = keys.groupBy("key").agg(F.min("class").alias("head"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("key", "head")
    links = keys.join(heads, "key").filter("class <> head").select(F.col("class").alias("a"), F.col("head").alias("b"))
    return connected_components(links).select(F.col("node").alias("class"), F.col("component").alias("family"))


def _sets(docs: DataFrame, chosen: DataFrame, width: int) -> DataFrame:
    """class, doc_id, family, large and the shingle set of each row of chosen (with doc_id and fingerprint); where ids repeat with
    other texts, only the text of the fingerprint counts."""
    names = ["class", "doc_id", "family", "large"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            column = texts(b["text"])
            for lo, hi in slices(column):
                part, sets = b.iloc[lo:hi], shingle_sets(column[lo:hi], width)
                same = [fingerprint(s) == bytes(f) for s, f in zip(sets, part["fingerprint"], strict=True)]
                yield part[names].assign(shingles=[s.view(np.int64) for s in sets])[same]
        hand_back()

    found = docs.select("doc_id", "text").join(chosen, "doc_id").select(*names, "fingerprint", "text")
    return found.mapInPandas(run, "class long, doc_id long, family long, large boolean, shingles array<long>")


def _verified(pairs: DataFrame, sets: DataFrame, least: int) -> DataFrame:
    """a, b of pairs whose sets are as similar as least asks."""
    one = sets.select(F.col("class").alias("a"), F.col("shingles").alias("s"))
    two = sets.select(F.col("class").alias("b"), F.col("shingles").alias("t"))
    both = pairs.join(one, "a").join(two, "b").withColumn("common", F.size(F.array_intersect("s", "t")))
    return both.filter(100 * F.col("common") >= least * (F.size("s") + F.size("t") - F.col("common"))).select("a", "b")


def spread_links(sets: DataFrame, bands: DataFrame, least: int) -> DataFrame:
    """a, b: links that connect all classes of large families. sets: class, family, shingles; bands: class, bands.

    Every class is compared with the heads of its buckets first. Classes that then are outside their family's largest component look
    for partners in other components by their rarest shingles: a partner has one of a class's n - least% n + 1 rarest."""
    tokens = sets.select("class", "family", F.explode("shingles").alias("t"))
    counts = cut(tokens.groupBy("family", "t").agg(F.count(F.lit(1)).alias("c"), F.min("class").alias("class")))
    once = counts.filter("c = 1").groupBy("class").agg(F.count(F.lit(1)).alias("own"))
    # A partner has none of the shingles that only this class has.
    alive = sets.join(once, "class", "left").withColumn("own", F.coalesce("own", F.lit(0))).withColumn("n", F.size("shingles"))
    alive = cut(alive.filter(100 * (F.col("n") - F.col("own")) >= least * F.col("n")))
    keys = alive.select("class", "own", "n").join(bands, "class").select("class", "own", "n", F.explode("bands").alias("key"))
    keys = cut(keys)
    heads = keys.groupBy("key").agg(F.min(F.struct("own", "class")).alias("head")).select("key", F.col("head.class").alias("b"))
    first = keys.join(heads, "key").filter("class <> b").select(F.col("class").alias("a"), "b").distinct()
    links = cut(_verified(first, alive, least))
    at = connected_components(links).select(F.col("node").alias("class"), "component")
    placed = cut(alive.select("class", "family", "n").join(at, "class", "left").withColumn("component", F.coalesce("component", "class")))
    parts = placed.groupBy("family", "component").agg(F.count(F.lit(1)).alias("k"))
    main = parts.groupBy("family").agg(F.max(F.struct("k", F.col("component").alias("main"))).alias("x")).select("family", "x.main")
    strays = cut(placed.join(main, "family").filter("component <> main").select("class", "n", "component"))
    if not strays.take(1):
        return links
    theirs = alive.select("class", "family", F.explode("shingles").alias("t"))
    rarity = theirs.join(strays, "class").join(counts.select("family", "t", "c"), ["family", "t"])
    place = F.row_number().over(Window.partitionBy("class").orderBy("c", "t"))
    rare = rarity.withColumn("place", place).filter(F.col("c") > 1).filter(F.col("place") <= F.col("n") - F.ceil(least * F.col("n") / 100) + 1)
    one = rare.select("family", "t", F.col("class").alias("a"), F.col("n").alias("n1"), F.col("component").alias("c1"))
    two = theirs.join(placed.select("class", "n", "component"), "class").withColumnsRenamed({"class": "b", "n": "n2", "component": "c2"})
    pairs = one.join(two, ["family", "t"]).filter("c1 <> c2").filter(100 * F.least("n1", "n2") >= least * F.greatest("n1", "n2"))
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return links.unionByName(_verified(pairs, alive, least))


def near_duplicates(docs: DataFrame, width: int = 5, least: int = 80, family_classes: int = FAMILY_CLASSES, family_shingles: int = FAMILY_SHINGLES) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row. Links: 100 * intersection >= least * union of the shingle sets."""
    rows = stored(sketch(docs, width), "sketch")
    some = rows.filter("fingerprint IS NOT NULL")
    by_set = some.groupBy("fingerprint", "n_shingles").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n"))
    classes = cut(by_set.withColumn("class", F.monotonically_increasing_id()))
    bands = some.select("fingerprint", "doc_id", "bands").join(classes.select("fingerprint", "doc_id", "class", "n_shingles"), ["fingerprint", "doc_id"])
    bands = cut(bands.select("class", "n_shingles", "doc_id", "fingerprint", "bands").dropDuplicates(["class"]))
    families = cut(_families(bands).join(bands.drop("bands"), "class"))
    sizes = families.groupBy("family").agg(F.count(F.lit(1)).alias("k"), F.sum("n_shingles").alias("s"))
    large = cut(sizes.filter((F.col("k") > family_classes) | (F.col("s") > family_shingles)).select("family", F.lit(True).alias("large")))
    any_large = bool(large.take(1))
    chosen = families.join(large, "family", "left") if any_large else families.withColumn("large", F.lit(None).cast("boolean"))
    sets = _sets(docs, chosen.select("class", "doc_id", "fingerprint", "family", "large"), width)

    def run(b: pd.DataFrame) -> pd.DataFrame:
        b = b.drop_duplicates("class")
        c = join_family(len(b), list(b["shingles"]), least)
        return pd.DataFrame({"class": b["class"].to_numpy(), "component_id": b["doc_id"].groupby(c).transform("min").to_numpy()})

    found = sets.filter("large IS NULL").groupBy("family").applyInPandas(run, "class long, component_id long")
    if any_large:
        spread = cut(sets.filter("large").select("class", "family", "shingles").dropDuplicates(["class"]))
        links = spread_links(spread, bands.select("class", "bands"), least)
        at = cut(connected_components(links).select(F.col("node").alias("class"), "component").join(classes.select("class", "doc_id"), "class"))
        least_of = cut(at.groupBy("component").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("n")))
        found = found.unionByName(spread_join(at.select("class", "component"), least_of, "component").select("class", "component_id"))
    keyed = classes.join(found, "class", "left").select("fingerprint", "n", F.coalesce("component_id", "doc_id").alias("component_id"))
    linked = spread_join(some.select("doc_id", "n_shingles", "fingerprint"), cut(keyed), "fingerprint").select("doc_id", "n_shingles", "component_id")
    alone = rows.filter("fingerprint IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
