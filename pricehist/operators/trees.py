"""Boosted trees and forests of many models at the same time, from rows that are binned once.

Rows are kept as blocks of one byte for each feature, with thresholds from all rows (by a sketch where a number has many values). In each pass over the blocks every model that is being fitted gets
one level further: tasks count targets by node, feature and bin, counts are added up in a shuffle, and the best split of each node comes to the driver.
The fitted trees are handed over as Spark ML models, so scoring, saving and loading are Spark's.

Losses and steps are those of Spark's learners: a boosted model's first tree has weight 1 and the others 0.1, each on a share of the rows; trees of a
forest have Poisson weights, and draw features for each node. Thresholds come from all rows (Spark takes a sample of them)."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, RandomForestClassificationModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressionModel, RandomForestRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from pricehist.functions.shared import cut, shared_dir

#: Rows of a block, and points that a task keeps of a number's distribution.
BLOCK, POINTS = 1 << 17, 2048
STEP, SHARE = 0.1, 0.8


@dataclass
class Block:
    """codes: (features, rows), a byte each."""

    codes: np.ndarray
    y: np.ndarray
    g: np.ndarray
    key: tuple[int, int]


@dataclass
class Blocks:
    """table: a row for every block; cuts: a feature's thresholds, or None for a category; sizes: the bins of each feature."""

    table: DataFrame
    names: list[str]
    cuts: list[np.ndarray | None]
    sizes: np.ndarray

    def over(self, each: Callable[[Iterator[Block]], Iterator[dict]], schema: str) -> DataFrame:
        """What `each` makes of the blocks of a task, as columns of lists."""
        spark = self.table.sparkSession
        kinds = to_arrow_schema(StructType.fromDDL(schema))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for out in each(_blocks(batches)):
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in kinds], schema=kinds)

        tasks = 3 * spark.sparkContext.defaultParallelism
        return self.table.coalesce(tasks).mapInArrow(run, schema)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    for batch in batches:
        for r in batch.to_pylist():
            codes, y = np.frombuffer(r["codes"], np.uint8), np.frombuffer(r["y"])
            yield Block(codes.reshape(-1, len(y)), y, np.frombuffer(r["g"], np.int32), (r["part"], r["k"]))


def _merged(values: np.ndarray, counts: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Different values in order with their counts; over `most`, neighbours are put together under the last of them."""
    v, at = np.unique(values, return_inverse=True)
    n = np.bincount(at, counts, minlength=len(v))
    if len(v) > most:
        last = np.unique(np.searchsorted(cum := np.cumsum(n), cum[-1] * np.arange(1, most + 1) / most).clip(0, len(v) - 1))
        v, n = v[last], np.diff(cum[last], prepend=0.0)
    return v, n


def thresholds(values: np.ndarray, counts: np.ndarray, bins: int) -> np.ndarray:
    """Between which values a number is cut: between all of them if they are few, else about equally many rows apart."""
    v, n = _merged(values, counts, 1 << 62)
    middle = v[:-1] + np.diff(v) / 2
    if len(v) <= bins:
        return middle
    cum = np.cumsum(n)
    at = np.unique(np.searchsorted(cum, cum[-1] * np.arange(1, bins) / bins))
    # A value with more rows than a bin is cut off on both sides.
    at = np.unique(np.concatenate([at, at[n[at] > cum[-1] / bins] - 1]))
    at = at[(at >= 0) & (at < len(middle))]
    return middle[at]


def sketches(rows: DataFrame, parts: Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]], columns: list[int]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Values and counts of columns of the matrices that `parts` makes of the rows, from all rows (a rank is off by a 2,000th of a task's rows at most)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [(np.empty(0), np.empty(0))] * len(columns)
        for x in parts(batches):
            for k, c in enumerate(columns):
                v = np.sort(x[:, c])
                at = np.append(np.flatnonzero(v[1:] != v[:-1]), len(v) - 1)
                kept[k] = _merged(np.concatenate([kept[k][0], v[at]]), np.concatenate([kept[k][1], np.diff(at, prepend=-1)]), 8 * POINTS)
        out = [_merged(v, n, POINTS) for v, n in kept if len(v)]
        if out:
            yield pa.RecordBatch.from_pydict({"f": pa.array(columns, pa.int32()), "v": pa.array([v for v, _ in out], pa.list_(pa.float64())), "n": pa.array([n for _, n in out], pa.list_(pa.float64()))})

    def merge(parts: pd.DataFrame) -> pd.DataFrame:
        v, n = _merged(np.concatenate(list(parts["v"])), np.concatenate(list(parts["n"])), 4 * POINTS)
        return pd.DataFrame({"f": [parts["f"].iloc[0]], "v": [v], "n": [n]})

    schema = "f int, v array<double>, n array<double>"
    found = rows.mapInArrow(run, schema).groupBy("f").applyInPandas(merge, schema).collect()  # bounded by features and POINTS
    return {r["f"]: (np.array(r["v"]), np.array(r["n"])) for r in found}


def _rows(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[np.ndarray]:
    """Stretches of at most about BLOCK rows of an array column of one length."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += len(b)
        if n >= BLOCK:
            yield _matrix(pa.Table.from_batches(held), column)
            held, n = [], 0
    if n:
        yield _matrix(pa.Table.from_batches(held), column)


def _matrix(table: pa.Table, column: str) -> np.ndarray:
    x = table.column(column).combine_chunks()
    return x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)


def pack(rows: DataFrame, names: list[str], arity: dict[str, int], bins: int, group: str | None = "h", like: Blocks | None = None) -> Blocks:
    """The blocks of rows (features: a vector or an array of double, y; group: an int). arity: how many values a category has; like: blocks whose
    thresholds these get."""
    if dict(rows.dtypes)["features"] != "array<double>":
        rows = rows.withColumn("features", vector_to_array("features"))
    g = F.col(group).cast("int") if group and group in rows.columns else F.lit(0)
    rows = rows.filter("y IS NOT NULL").select("features", "y", g.alias("g"))
    found = {} if like else sketches(rows.select("features"), lambda batches: _rows(batches, "features"), [k for k, c in enumerate(names) if c not in arity])
    cuts = like.cuts if like else [None if c in arity else thresholds(*found[k], bins) if k in found else np.empty(0) for k, c in enumerate(names)]
    sizes = np.array([arity[c] if c in arity else len(cuts[k]) + 1 for k, c in enumerate(names)])
    if sizes.max(initial=0) > 256:
        raise ValueError("a category has more than 256 values")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, k, held, n = TaskContext.get().partitionId(), 0, [], 0

        def block() -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            x = _matrix(t, "features")
            codes = np.empty((len(names), len(x)), np.uint8)
            for f, c in enumerate(cuts):
                codes[f] = np.minimum(x[:, f], sizes[f] - 1) if c is None else np.searchsorted(c, x[:, f])
            y, g = t.column("y").to_numpy().astype(float), t.column("g").to_numpy().astype(np.int32)
            data = {"part": pa.array([part], pa.int32()), "k": pa.array([k], pa.int32())} | {c: pa.array([v.tobytes()], pa.binary()) for c, v in (("codes", codes), ("y", y), ("g", g))}
            return pa.RecordBatch.from_pydict(data)

        for b in batches:
            held.append(b)
            n += len(b)
            if n >= BLOCK:
                yield block()
                k, held, n = k + 1, [], 0
        if n:
            yield block()

    return Blocks(cut(rows.mapInArrow(run, "part int, k int, codes binary, y binary, g binary")), names, cuts, sizes)


@dataclass
class Tree:
    """Nodes as in a heap: the children of i are 2i + 1 and 2i + 2. right: whether a bin of the node's feature goes right; feature -1: a leaf."""

    feature: np.ndarray
    right: np.ndarray
    value: np.ndarray
    count: np.ndarray
    gain: np.ndarray

    @classmethod
    def of(cls, depth: int, width: int) -> Tree:
        n = 2 ** (depth + 1) - 1
        return cls(np.full(n, -1, np.int16), np.zeros((n, 256), bool), np.zeros((n, width)), np.zeros(n), np.zeros(n))

    def descend(self, codes: np.ndarray, rows: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """The leaves so far and the rows that are in them."""
        todo = [(0, rows)]
        while todo:
            node, at = todo.pop()
            f = self.feature[node]
            if f < 0:
                yield node, at
                continue
            right = self.right[node].take(codes[f].take(at))
            todo += [(2 * node + 1, at[~right]), (2 * node + 2, at[right])]

    def leaves(self) -> list[int]:
        """Nodes that are leaves, from left to right (as Spark numbers them)."""
        out, todo = [], [0]
        while todo:
            node = todo.pop()
            if self.feature[node] < 0:
                out.append(node)
            else:
                todo += [2 * node + 2, 2 * node + 1]
        return out


@dataclass
class Model:
    """A model that grow() fits. target: of a block, the rows that take part and their targets (class numbers for `classes`).

    loss: logistic (targets -1 and 1), absolute or squared for boosted models of `rounds` trees; mean or classes for forests of `trees`."""

    loss: str
    target: Callable[[Block], tuple[np.ndarray, np.ndarray]]
    depth: int
    rounds: int = 1
    trees: int = 1
    features: list[int] | None = None
    drawn: int | None = None
    least: float = 1
    seed: int = 42
    classes: int = 3
    made: list[Tree] = field(default_factory=list)
    known: dict = field(default_factory=dict)

    @property
    def boosted(self) -> bool:
        return self.loss in ("logistic", "absolute", "squared")

    @property
    def width(self) -> int:
        return self.classes if self.loss == "classes" else 1

    @property
    def passes(self) -> int:
        return self.rounds * self.depth

    def used(self, tree: int, node: int, n: int) -> np.ndarray:
        """The features that a node may be split by."""
        pool = np.arange(n) if self.features is None else np.array(self.features)
        if self.drawn is None or self.drawn >= len(pool):
            return pool
        if (tree, node) not in self.known:
            self.known[tree, node] = np.sort(np.random.default_rng([self.seed, 1, tree, node]).choice(pool, self.drawn, replace=False))
        return self.known[tree, node]

    def score(self, b: Block, rows: np.ndarray | None = None, trees: list[Tree] | None = None) -> np.ndarray:
        """The boosted model's value of a block's rows (0 for rows that are not asked for)."""
        out, rows = np.zeros(len(b.y)), np.arange(len(b.y)) if rows is None else rows
        for k, t in enumerate(self.made if trees is None else trees):
            for node, at in t.descend(b.codes, rows):
                out[at] += (STEP if k else 1.0) * t.value[node, 0]
        return out

    def part(self, k: int, codes, n: int) -> np.ndarray:
        """What the boosted model's tree k adds to the values of n rows with these codes of each feature."""
        out = np.zeros(n)
        for node, at in self.made[k].descend(codes, np.arange(n)):
            out[at] = (STEP if k else 1.0) * self.made[k].value[node, 0]
        return out

    def samples(self, b: Block, step: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray | None]]:
        """For each tree that is growing: its number, rows, targets of all rows and weights of all rows."""
        rows, y = self.target(b)
        if not len(rows):
            return
        if self.boosted:
            k = step // self.depth
            if k:
                f = self.score(b, rows, self.made[:k])
                y = {"logistic": lambda: 4 * y / (1 + np.exp(2 * y * f)), "absolute": lambda: np.where(y < f, -1.0, 1.0), "squared": lambda: 2 * (y - f)}[self.loss]()
            chosen = np.random.default_rng([self.seed, 2, k, *b.key]).integers(0, 1 << 16, len(b.y), np.uint16) < SHARE * (1 << 16)
            yield k, rows[chosen[rows]], y, None
            return
        for k in range(self.trees):
            w = POISSON.take(np.random.default_rng([self.seed, 3, k, *b.key]).integers(0, 1 << 16, len(b.y), np.uint16))
            yield k, rows[w[rows] > 0], y, w

    def counted(self, b: Block, step: int, found: dict, m: int, sizes: np.ndarray) -> None:
        """Adds the block's counts and sums of targets by node, feature and bin to found."""
        level, most = step % self.depth, int(sizes.max(initial=1))
        for k, rows, y, w in self.samples(b, step):
            for node, at in self.made[k].descend(b.codes, rows):
                if node < 2**level - 1 or not len(at):
                    continue
                used = self.used(k, node, len(sizes))
                if (h := found.get((m, k, node))) is None:
                    h = found[m, k, node] = np.zeros((len(used), most, 1 + self.width))
                v, c = y.take(at), None if w is None else w.take(at)
                if self.loss == "classes":
                    v = v.astype(np.intp)
                    for i, f in enumerate(used):
                        n = np.bincount(b.codes[f].take(at) * np.intp(self.classes) + v, c, minlength=most * self.classes).reshape(most, self.classes)
                        h[i, :, 1:] += n
                        h[i, :, 0] += n.sum(1)
                    continue
                s = v if c is None else v * c
                for i, f in enumerate(used):
                    x = b.codes[f].take(at).astype(np.intp)
                    h[i, :, 0] += np.bincount(x, c, minlength=most)
                    h[i, :, 1] += np.bincount(x, s, minlength=most)


#: The Poisson number of mean 1 for each of 2^16 equal chances.
POISSON = np.searchsorted(np.cumsum(np.exp(-1) / np.cumprod([1.0, *range(1, 12)])), (np.arange(1 << 16) + 0.5) / (1 << 16)).astype(float)


def best_split(h: np.ndarray, used: np.ndarray, sizes: np.ndarray, ordered: np.ndarray, least: float) -> tuple | None:
    """feature, bins that go left, gain, counts and sums of both sides: the split with the most between-group variance (for classes the least Gini
    impurity). h: (features, bins, 1 + width). Bins of a category are ordered by their mean target; ones without rows go right."""
    best, total = None, h[0].sum(0)
    for i, f in enumerate(used):
        x = h[i, : sizes[f]]
        order = np.arange(len(x))
        if not ordered[f]:
            order = np.flatnonzero(x[:, 0] > 0)
            s = x[order, 1:] @ np.arange(x.shape[1] - 1) if x.shape[1] > 2 else x[order, 1]
            order = order[np.argsort(s / x[order, 0], kind="stable")]
        left = np.cumsum(x[order], axis=0)[:-1]
        if not len(left):
            continue
        right = total - left
        ok = (left[:, 0] >= max(least, 1e-9)) & (right[:, 0] >= max(least, 1e-9))
        if not ok.any():
            continue
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = np.where(ok, (left[:, 1:] ** 2).sum(1) / left[:, 0] + (right[:, 1:] ** 2).sum(1) / right[:, 0], -np.inf) - (total[1:] ** 2).sum() / total[0]
        k = int(np.argmax(gain))
        if gain[k] > 1e-10 * total[0] and (best is None or gain[k] > best[2]):
            best = int(f), order[: k + 1], float(gain[k]), left[k], right[k]
    return best


def by_node(table: DataFrame, each: Callable[[tuple[int, int, int], pd.DataFrame], dict], schema: str) -> DataFrame:
    """A row for each m, tree and node of the table, from all its rows. A group has several nodes, as most are small."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(parts: pd.DataFrame) -> pd.DataFrame:
        rows = [each(tuple(int(k) for k in key), rest) for key, rest in parts.groupby(["m", "tree", "node"], sort=False)]
        return pd.DataFrame({c: [r[c] for r in rows] for c in names})

    groups = F.pmod(F.xxhash64("m", "tree", "node"), F.lit(4 * table.sparkSession.sparkContext.defaultParallelism))
    return table.groupBy(groups).applyInPandas(run, schema)


COUNTED = "m int, tree int, node int, part int, data binary"
SPLIT = "m int, tree int, node int, n double, value array<double>, feature int, gain double, lefts array<int>, ln double, lv array<double>, rn double, rv array<double>"


def grow(blocks: Blocks, models: list[Model]) -> list[Model]:
    """Fits the models; each pass over the blocks takes all of them one level further."""
    sizes, ordered = blocks.sizes, np.array([c is not None for c in blocks.cuts])
    for m in models:
        m.made = [Tree.of(m.depth, m.width) for _ in range(m.rounds if m.boosted else m.trees)]
    # What a node has as it is split: all its targets where a leaf needs no more than their mean.
    for step in range(max((m.passes for m in models), default=0)):
        now = [(k, m) for k, m in enumerate(models) if step < m.passes]

        def each(parts: Iterator[Block], now=now, step=step) -> Iterator[dict]:
            from pyspark import TaskContext

            found: dict = {}
            for b in parts:
                for k, m in now:
                    m.counted(b, step, found, k, sizes)
            part = TaskContext.get().partitionId()
            keys = sorted(found)
            for a in range(0, len(keys), 256):
                some = keys[a : a + 256]
                yield {"m": [k[0] for k in some], "tree": [k[1] for k in some], "node": [k[2] for k in some], "part": [part] * len(some), "data": [found[k].tobytes() for k in some]}

        def split(key: tuple[int, int, int], parts: pd.DataFrame) -> dict:
            m = models[key[0]]
            used = m.used(*key[1:], len(sizes))
            # In the order of tasks, so that sums do not depend on which came first.
            h = sum(np.frombuffer(d) for d in parts.sort_values("part")["data"]).reshape(len(used), -1, 1 + m.width)
            total, at = h[0].sum(0), best_split(h, used, sizes, ordered, m.least)
            out = {"m": key[0], "tree": key[1], "node": key[2], "n": total[0], "value": total[1:]}
            return out | dict(zip(("feature", "lefts", "gain", "ln", "lv", "rn", "rv"), (at[0], at[1], at[2], at[3][0], at[3][1:], at[4][0], at[4][1:]) if at else (-1, [], 0.0, 0.0, [], 0.0, []), strict=True))

        for r in by_node(blocks.over(each, COUNTED), split, SPLIT).collect():  # one row for each node of a level
            _put(models[r["m"]], r)
    return models


def _put(m: Model, r) -> None:
    t, node = m.made[r["tree"]], r["node"]
    mean = lambda v, n: np.array(v) if m.loss == "classes" else np.array(v) / n
    if node == 0:
        t.count[0], t.value[0] = r["n"], mean(r["value"], r["n"])
    if r["feature"] < 0:
        return
    t.feature[node], t.gain[node], t.right[node] = r["feature"], r["gain"], True
    t.right[node, r["lefts"]] = False
    for child, n, v in ((2 * node + 1, r["ln"], r["lv"]), (2 * node + 2, r["rn"], r["rv"])):
        t.count[child], t.value[child] = n, mean(v, n)


# ---- as models of Spark ML -------------------------------------------------------------------------------------------

KINDS = {
    "logistic": (GBTClassificationModel, "classification.GBTClassificationModel"), "absolute": (GBTRegressionModel, "regression.GBTRegressionModel"),
    "squared": (GBTRegressionModel, "regression.GBTRegressionModel"), "mean": (RandomForestRegressionModel, "regression.RandomForestRegressionModel"),
    "classes": (RandomForestClassificationModel, "classification.RandomForestClassificationModel"),
}
NODE = """struct<id: int, prediction: double, impurity: double, impurityStats: array<double>, rawCount: bigint, gain: double, leftChild: int, rightChild: int,
    split: struct<featureIndex: int, leftCategoriesOrThreshold: array<double>, numCategories: int>>"""


def _nodes(m: Model, tree: int, t: Tree, blocks: Blocks) -> list[tuple]:
    """The tree's nodes in Spark's order: each before its left, then its right part."""
    ids, todo = {}, [0]
    while todo:
        node = todo.pop()
        ids[node] = len(ids)
        if t.feature[node] >= 0:
            todo += [2 * node + 2, 2 * node + 1]
    out = []
    for node, k in ids.items():
        f, v, n = int(t.feature[node]), t.value[node], float(t.count[node])
        stats = [float(c) for c in v] if m.loss == "classes" else [n, float(v[0]) * n, 0.0]
        says = float(np.argmax(v)) if m.loss == "classes" else float(v[0])
        if f < 0:
            out.append((tree, (k, says, 0.0, stats, int(n), -1.0, -1, -1, (-1, [], -1))))
            continue
        left = np.flatnonzero(~t.right[node, : blocks.sizes[f]])
        at = (f, [float(c) for c in left], int(blocks.sizes[f])) if blocks.cuts[f] is None else (f, [float(blocks.cuts[f][left[-1]])], -1)
        out.append((tree, (k, says, 0.0, stats, int(n), float(t.gain[node]), ids[2 * node + 1], ids[2 * node + 2], at)))
    return out


def spark_model(blocks: Blocks, m: Model):
    """The model as one of Spark ML, by way of its folder."""
    spark = blocks.table.sparkSession
    kind, name = KINDS[m.loss]
    path = f"{shared_dir(spark)}/trees-{uuid.uuid4().hex}"

    def about(name: str, params: dict, **more) -> str:
        return json.dumps({"class": f"org.apache.spark.ml.{name}", "timestamp": int(time.time() * 1000), "sparkVersion": spark.version, "uid": f"{name.split('.')[1]}_{uuid.uuid4().hex[:12]}",
            "paramMap": {"featuresCol": "features", "maxDepth": m.depth, "impurity": "gini" if m.loss == "classes" else "variance"} | params, "defaultParamMap": {"predictionCol": "prediction", "leafCol": ""}} | more)

    several = {"numClasses": m.classes} if m.loss == "classes" else {}
    single = "classification.DecisionTreeClassificationModel" if m.loss == "classes" else "regression.DecisionTreeRegressionModel"
    whole = about(name, {} if m.boosted else {"numTrees": len(m.made)}, numFeatures=len(blocks.names), numTrees=len(m.made), **several)
    trees = [(k, about(single, {}, numFeatures=len(blocks.names), **several), STEP if m.boosted and k else 1.0) for k in range(len(m.made))]
    spark.createDataFrame([(whole,)], "value string").coalesce(1).write.text(f"{path}/metadata")
    spark.createDataFrame(trees, "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{path}/treesMetadata")
    nodes = [r for k, t in enumerate(m.made) for r in _nodes(m, k, t, blocks)]
    spark.createDataFrame(nodes, f"treeID int, nodeData {NODE}").coalesce(1).write.parquet(f"{path}/data")
    return kind.load(path)


# ---- what the rows of a forest's leaves have --------------------------------------------------------------------------

#: Stretches of the targets that leaves are counted by before values are looked at.
STRETCHES = 1024


def leaf_percentiles(blocks: Blocks, models: list[Model], grid: int) -> list[list[tuple[int, int, int, list[float]]]]:
    """For each forest its trees' leaves: tree, leaf (numbered as by Spark), n and the percentiles (k + 1/2) / grid of the targets of its rows: the least target with at
    least that share at or below it.

    Exact in two passes: leaves are counted by stretches of the targets' range; then only stretches that hold a percentile and more than one value
    are looked at value by value."""
    names = [{(k, node): i for k, t in enumerate(m.made) for i, node in enumerate(t.leaves())} for m in models]
    y = sketches(blocks.table, lambda batches: (b.y[:, None] for b in _blocks(batches)), [0])
    borders = thresholds(*y[0], STRETCHES) if y else np.empty(0)
    wide = len(borders) + 1

    def leaves(b: Block) -> Iterator[tuple[int, int, int, np.ndarray, np.ndarray]]:
        for i, m in enumerate(models):
            rows, target = m.target(b)
            for k, t in enumerate(m.made):
                for node, at in t.descend(b.codes, rows):
                    if len(at):
                        yield i, k, names[i][k, node], at, target

    def count(parts: Iterator[Block]) -> Iterator[dict]:
        found: dict = {}
        low, high = np.full(wide, np.inf), np.full(wide, -np.inf)
        for b in parts:
            code = np.searchsorted(borders, b.y)
            s = pd.Series(b.y).groupby(code).agg(["min", "max"])
            low[s.index], high[s.index] = np.minimum(low[s.index], s["min"]), np.maximum(high[s.index], s["max"])
            for i, k, leaf, at, _ in leaves(b):
                n = np.bincount(code.take(at), minlength=wide)
                found[i, k, leaf] = found[i, k, leaf] + n if (i, k, leaf) in found else n
        keys = sorted(found)
        for a in range(0, len(keys), 512):
            some = keys[a : a + 512]
            at = [np.flatnonzero(found[k]) for k in some]
            yield {"m": [k[0] for k in some], "tree": [k[1] for k in some], "node": [k[2] for k in some], "at": at, "n": [found[k][v] for k, v in zip(some, at, strict=True)], "low": [None] * len(some), "high": [None] * len(some)}
        yield {"m": [-1], "tree": [0], "node": [0], "at": [[]], "n": [[]], "low": [low], "high": [high]}

    def places(key: tuple[int, int, int], parts: pd.DataFrame) -> dict:
        """Where each percentile lies: its stretch, and how many rows of the stretch are at or below it."""
        row = dict(zip(("m", "tree", "node"), key, strict=True)) | {"rows": 0, "at": [], "rank": [], "low": None, "high": None}
        if key[0] < 0:
            row |= {"low": np.min(np.stack(list(parts["low"])), axis=0), "high": np.max(np.stack(list(parts["high"])), axis=0)}
        else:
            n = np.bincount(np.concatenate(list(parts["at"])), np.concatenate(list(parts["n"])), minlength=wide).astype(np.int64)
            cum = np.cumsum(n)
            want = _ranks(int(cum[-1]), grid)
            at = np.searchsorted(cum, want)
            row |= {"rows": int(cum[-1]), "at": at, "rank": want - (cum[at] - n[at])}
        return row

    counted = blocks.over(count, "m int, tree int, node int, at array<int>, n array<long>, low array<double>, high array<double>")
    found = by_node(counted, places, "m int, tree int, node int, rows long, at array<int>, rank array<long>, low array<double>, high array<double>").collect()
    ends = [r for r in found if r["m"] < 0]
    if not ends:
        return [[] for _ in models]
    low, high = np.array(ends[0]["low"]), np.array(ends[0]["high"])
    found = [r for r in found if r["m"] >= 0]  # at most leaves times grid numbers
    single = low == high
    asked = {(r["m"], r["tree"], r["node"]): np.unique([a for a in r["at"] if not single[a]]).astype(int) for r in found}

    def values(parts: Iterator[Block]) -> Iterator[dict]:
        held: dict = {}
        size = 0

        def flush() -> Iterator[dict]:
            keys = sorted(held)
            for a in range(0, len(keys), 512):
                some = keys[a : a + 512]
                made = [np.unique(np.concatenate(held[k]), return_counts=True) for k in some]
                yield {"m": [k[0] for k in some], "tree": [k[1] for k in some], "node": [k[2] for k in some], "v": [v.tobytes() for v, _ in made], "n": [n.astype(np.int64).tobytes() for _, n in made]}

        for b in parts:
            code = np.searchsorted(borders, b.y)
            for i, k, leaf, at, _ in leaves(b):
                if len(want := asked.get((i, k, leaf), ())):
                    mask = np.zeros(wide, bool)
                    mask[want] = True
                    some = b.y.take(at[mask.take(code.take(at))])
                    if len(some):
                        held.setdefault((i, k, leaf), []).append(some)
                        size += len(some)
            if size > 8_000_000:
                yield from flush()
                held, size = {}, 0
        yield from flush()

    ranked = {(r["m"], r["tree"], r["node"]): (r["at"], r["rank"]) for r in found}

    def resolve(key: tuple[int, int, int], parts: pd.DataFrame) -> dict:
        v, n = _merged(np.concatenate([np.frombuffer(d) for d in parts["v"]]), np.concatenate([np.frombuffer(d, np.int64) for d in parts["n"]]), 1 << 62)
        code, out = np.searchsorted(borders, v), []
        for a, rank in zip(*ranked[key], strict=True):
            if single[a]:
                out.append(low[a])
                continue
            mine = code == a
            out.append(v[mine][np.searchsorted(np.cumsum(n[mine]), rank)])
        return {"m": key[0], "tree": key[1], "node": key[2], "values": out}

    exact = by_node(blocks.over(values, "m int, tree int, node int, v binary, n binary"), resolve, "m int, tree int, node int, values array<double>").collect()
    exact = {(r["m"], r["tree"], r["node"]): list(r["values"]) for r in exact}
    tables: list[list] = [[] for _ in models]
    for r in found:
        key = r["m"], r["tree"], r["node"]
        tables[r["m"]].append((r["tree"], r["node"], r["rows"], exact[key] if key in exact else [float(low[a]) for a in r["at"]]))
    return tables


def _ranks(n: int, grid: int) -> np.ndarray:
    return np.ceil(n * ((np.arange(grid) + 0.5) / grid)).astype(np.int64).clip(1)
