"""Spark ML models of price changes, ranges, next vintages and fair prices.

Trees do not route missing values here: a null number becomes a sentinel and a flag of its own. Unknown categories have a bucket of
their own. The learners are gradient-boosted trees with Spark's losses, grown by `trees` over rows that are binned once; quantiles are the median model plus percentiles of its errors,
each divided by the error that a second model expects of its row."""

from __future__ import annotations

import functools
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from pricehist.functions.numbers import rounded
from pricehist.functions.shared import cut
from pricehist.operators import fair, metrics, trees
from pricehist.operators.panel import MOVE
from pricehist.operators.trees import SHARE, STEP

SENTINEL = -999.0
#: Bins of a feature in a tree.
BINS = 64


def prepared(rows: DataFrame, numbers: list[str], categories: list[str]) -> DataFrame:
    """rows with n_<c> (null as the sentinel), z_<c> (1 where it was null) and c_<c> (null as a text of its own)."""
    cols = {f"n_{c}": F.coalesce(F.col(c).cast("double"), F.lit(SENTINEL)) for c in numbers}
    cols |= {f"z_{c}": F.col(c).isNull().cast("double") for c in numbers}
    return rows.withColumns(cols | {f"c_{c}": F.coalesce(F.col(c).cast("string"), F.lit("?")) for c in categories})


def flagged(rows: DataFrame, numbers: list[str]) -> list[str]:
    """The numbers that are null in some of the rows (prepared). The flags of the others are 0 in all of them, so no tree of these rows can split on them."""
    if not numbers:
        return []
    most = rows.agg(*[F.max(f"z_{c}").alias(c) for c in numbers]).first()
    return [c for c in numbers if most[c]]


def encoder(numbers: list[str], categories: list[str], flags: list[str] | None = None) -> list:
    """flags: the numbers whose flag is a feature; all of them where it is None."""
    index = StringIndexer(inputCols=[f"c_{c}" for c in categories], outputCols=[f"i_{c}" for c in categories], handleInvalid="keep")
    whole = [f"{k}_{c}" for c in numbers for k in ("n", "z") if k == "n" or flags is None or c in flags] + [f"i_{c}" for c in categories]
    return [*([index] if categories else []), VectorAssembler(inputCols=whole, outputCol="features")]


def arrays(encode: PipelineModel, rows: DataFrame) -> DataFrame:
    """rows (prepared) with their features as an array."""
    *index, whole = encode.stages
    for stage in index:
        rows = stage.transform(rows)
    return rows.withColumn("features", F.array(*whole.getInputCols()))


def packed(encode: PipelineModel, rows: DataFrame, like: trees.Blocks | None = None) -> trees.Blocks:
    """The blocks of rows with the encoder's features (an array or a vector), y and maybe h."""
    arity = {c: len(labels) + 1 for stage in encode.stages[:-1] for c, labels in zip(stage.getOutputCols(), stage.labelsArray, strict=True)}
    return trees.pack(rows, encode.stages[-1].getInputCols(), arity, BINS, like=like)


class Encoded(tuple):
    """An encoder of fit rows, and their features (an array), y and h (if they have one). blocks: the rows binned, once for all models of these rows."""

    @functools.cached_property
    def blocks(self) -> trees.Blocks:
        return packed(*self)


def encoded(fit: DataFrame, numbers: list[str], categories: list[str]) -> Encoded:
    """fit should be a table or a checkpoint, as it is read more than once."""
    rows = prepared(fit, numbers, categories)
    encode = Pipeline(stages=encoder(numbers, categories, flagged(rows, numbers))).fit(rows)
    return Encoded((encode, arrays(encode, rows).select("features", "y", *[c for c in ("h",) if c in fit.columns])))


def logit(p: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(q / (1 - q))


@dataclass
class ChangeModel:
    """M2, M3: chances of a rise and a cut, calibrated by horizon, and the sizes of both."""

    encode: PipelineModel
    up: object
    down: object
    size_up: object
    size_down: object
    platt: dict[tuple[int, str], tuple[float, float]]
    numbers: list[str]
    categories: list[str]

    def raw(self, rows: DataFrame) -> DataFrame:
        x = self.encode.transform(prepared(rows, self.numbers, self.categories))
        for side, m in (("up", self.up), ("down", self.down)):
            x = m.setProbabilityCol(f"v_{side}").setRawPredictionCol(f"r_{side}").setPredictionCol(f"k_{side}").transform(x)
            x = x.withColumn(f"raw_{side}", vector_to_array(f"v_{side}")[1])
        return x

    def transform(self, rows: DataFrame) -> DataFrame:
        """rows with p_up, p_down, up_pct, down_pct."""
        x = self.raw(rows)
        for side, m in (("up", self.size_up), ("down", self.size_down)):
            x = m.setPredictionCol(f"s_{side}").transform(x)
            p = F.lit(None).cast("double")
            for (h, s), (w, b) in self.platt.items():
                if s == side:
                    p = F.when(F.col("h") == h, 1 / (1 + F.exp(-(w * logit(F.col(f"raw_{side}")) + b)))).otherwise(p)
            x = x.withColumn(f"q_{side}", F.coalesce(p, F.col(f"raw_{side}")))
        # A rise, a cut and no change are the three cases: where the two chances are more than certain together, they are scaled down.
        sure = F.greatest(F.lit(1.0), F.col("q_up") + F.col("q_down"))
        x = x.withColumns({"p_up": F.col("q_up") / sure, "p_down": F.col("q_down") / sure})
        sizes = {"up_pct": F.expm1(F.greatest("s_up", F.lit(MOVE))) * 100, "down_pct": F.expm1(F.least("s_down", F.lit(-MOVE))) * 100}
        return x.withColumns(sizes).select(*rows.columns, "p_up", "p_down", "up_pct", "down_pct")


def _trees(kind, label: str, depth: int, rounds: int, seed: int = 42, **more):
    """Spark's own learner, for queries of many fits on few rows each: a pass of `trees` takes longer than one of Spark's there."""
    return kind(featuresCol="features", labelCol=label, maxDepth=depth, maxIter=rounds, stepSize=STEP, maxBins=BINS, seed=seed, subsamplingRate=SHARE, **more)


@dataclass
class Constant:
    """A model that always gives one value."""

    value: float
    column: str = "prediction"

    def setPredictionCol(self, column: str) -> Constant:  # noqa: N802  as Spark's models have it
        self.column = column
        return self

    def transform(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn(self.column, F.lit(self.value))


def every(b: trees.Block) -> tuple[np.ndarray, np.ndarray]:
    return np.arange(len(b.y)), b.y


def _moved(side: str) -> Callable[[trees.Block], np.ndarray]:
    return (lambda b: b.y > MOVE) if side == "up" else (lambda b: b.y < -MOVE)


def _rises(side: str) -> Callable[[trees.Block], tuple[np.ndarray, np.ndarray]]:
    hit = _moved(side)
    return lambda b: (np.arange(len(b.y)), np.where(hit(b), 1.0, -1.0))


def _sizes(side: str) -> Callable[[trees.Block], tuple[np.ndarray, np.ndarray]]:
    hit = _moved(side)
    return lambda b: (np.flatnonzero(hit(b)), b.y)


SIDES = ("up", "down")


def grown_changes(made: Encoded, sets: dict[str, tuple[list[str], list[str]]], depth: int, rounds: int, also: tuple[trees.Model, ...] = ()) -> dict[str, tuple[ChangeModel, dict[str, trees.Model]]]:
    """M2 for several sets of features (numbers, categories) in the same passes: uncalibrated models, and the trees of their chances. made: of all features;
    also: other models that are grown in these passes."""
    encode, x = made
    names = made.blocks.names
    n = x.agg(*[F.count_if(hit).alias(side) for side, hit in (("up", F.col("y") > MOVE), ("down", F.col("y") < -MOVE))]).first()
    grown: dict[tuple[str, str, str], trees.Model] = {}
    for name, (numbers, categories) in sets.items():
        mine = {*numbers, *categories}
        features = [k for k, c in enumerate(names) if c[2:] in mine]
        for side in SIDES:
            grown[name, side, "chance"] = trees.Model("logistic", _rises(side), depth, rounds, features=features)
            if n[side] >= BINS:
                grown[name, side, "size"] = trees.Model("absolute", _sizes(side), depth, rounds, features=features)
    trees.grow(made.blocks, [*grown.values(), *also])
    with ThreadPoolExecutor(4) as pool:
        fitted = dict(zip(grown, pool.map(lambda m: trees.spark_model(made.blocks, m), grown.values()), strict=True))
    out, inputs = {}, [[c[2:] for c in names if c.startswith(kind)] for kind in ("n_", "i_")]
    for name in sets:
        # The median where there are fewer rows than a tree has bins.
        size = {side: fitted.get((name, side, "size")) or Constant(_median(x, side)) for side in SIDES}
        model = ChangeModel(encode, *[fitted[name, side, "chance"] for side in SIDES], *[size[side] for side in SIDES], {}, *inputs)
        out[name] = model, {side: grown[name, side, "chance"] for side in SIDES}
    return out


def _median(x: DataFrame, side: str) -> float:
    """Of fewer than BINS rows; the least move without any."""
    y = sorted(r["y"] for r in x.filter(F.col("y") > MOVE if side == "up" else F.col("y") < -MOVE).select("y").collect())
    return float(np.median(y)) if y else MOVE if side == "up" else -MOVE


def fit_change(fit: DataFrame, calibration: DataFrame | None, numbers: list[str], categories: list[str], depth: int = 4, rounds: int = 10,
    made: Encoded | None = None) -> ChangeModel:
    """M2 on the fit slice, M3 on the calibration slice: one small logistic fit for each horizon and side (L2 of weight 1 over the slice).
    Without a calibration slice the chances are the classifiers' own. made: what encoded() gave for the fit rows, if another model has it too."""
    model, _ = grown_changes(made or encoded(fit, numbers, categories), {"": (numbers, categories)}, depth, rounds)[""]
    return model if calibration is None else calibrate(model, calibration)


def fit_changes(fit: DataFrame, calibration: DataFrame, sets: dict[str, tuple[list[str], list[str]]], depth: int = 4, rounds: int = 10) -> dict[str, ChangeModel]:
    """fit_change for several sets of features, with one encoding of all of them and in the same passes."""
    numbers, categories = (list(dict.fromkeys(c for s in sets.values() for c in s[k])) for k in (0, 1))
    grown = grown_changes(encoded(fit, numbers, categories), sets, depth, rounds)
    with ThreadPoolExecutor(2) as pool:
        return dict(zip(grown, pool.map(lambda g: calibrate(g[0], calibration), grown.values()), strict=True))


def fit_both(fit: DataFrame, calibration: DataFrame | None, numbers: list[str], categories: list[str], depth: int = 4, rounds: int = 10) -> tuple[ChangeModel, RangeModel]:
    """fit_change and fit_range of the same rows, with one encoding and the median in the passes of the change model."""
    made, median = encoded(fit, numbers, categories), trees.Model("absolute", every, depth, rounds)
    model, _ = grown_changes(made, {"": (numbers, categories)}, depth, rounds, (median,))[""]
    band = fit_range(fit, calibration, numbers, categories, depth, rounds, made=made, median=median)
    return model if calibration is None else calibrate(model, calibration), band


def calibrate(model: ChangeModel, calibration: DataFrame) -> ChangeModel:
    model.platt = fit_platt(cut(model.raw(calibration).select("h", "y", "raw_up", "raw_down")))
    return model


def fit_platt(c: DataFrame, most: int = 25) -> dict[tuple[int, str], tuple[float, float]]:
    """M3: weight and intercept of each horizon and side (h, side) by Newton's method; a side that always or never comes has none. All take a step together:
    a job sums gradients and second derivatives. c: h, y, raw_up, raw_down; a checkpoint."""
    hits = {"up": F.col("y") > MOVE, "down": F.col("y") < -MOVE}
    n = c.groupBy("h").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(hit).alias(side) for side, hit in hits.items()]).collect()  # one row for each horizon
    platt = {(r["h"], side): np.array([0.0, np.log(r[side] / (r["n"] - r[side]))]) for r in n for side in hits if 0 < r[side] < r["n"]}
    for _ in range(most):
        sums = []
        for side, hit in hits.items():
            mine = [(h, w) for (h, s), w in platt.items() if s == side]
            if not mine:
                continue
            w, b = (functools.reduce(lambda e, v, k=k: e.when(F.col("h") == v[0], float(v[1][k])), mine, F.when(F.lit(False), 0.0)) for k in (0, 1))
            x = logit(F.col(f"raw_{side}"))
            p = 1 / (1 + F.exp(-(w * x + b)))
            miss, v = hit.cast("double") - p, p * (1 - p)
            sums += [F.sum(e).alias(f"{side}{k}") for k, e in enumerate((miss * x, miss, v * x * x, v * x, v))]
        if not sums:
            break
        far = 0.0
        for r in c.groupBy("h").agg(*sums).collect():
            for side in hits:
                if (at := platt.get((r["h"], side))) is None:
                    continue
                g0, g1, hxx, hx, h1 = (r[f"{side}{k}"] for k in range(5))
                step = np.linalg.solve(np.array([[hxx + 1.0, hx], [hx, h1 + 1e-9]]), np.array([g0 - at[0], g1]))
                # Far from the answer a whole step may go too far.
                step *= min(1.0, 2.0 / max(1e-12, np.abs(step).max()))
                platt[r["h"], side] = at + step
                far = max(far, float(np.abs(step).max()))
        if far < 1e-7:
            break
    return {k: (float(w[0]), float(w[1])) for k, w in platt.items()}


def moved_scores(model: ChangeModel, chances: dict[str, trees.Model], blocks: trees.Blocks, features: list[str], seed: int = 7) -> DataFrame:
    """_k, s, n, pos: the chances of a rise (each once) of all rows of the blocks, how many rows have it and how many of these rise: as they are (_k = 0),
    and where the values of feature _k have changed places within a block.

    A row is scored once by each tree, and again only by trees that split on the feature."""
    of = {k: [i for i, c in enumerate(blocks.names) if c[2:] == name] for k, name in enumerate(features, 1)}
    uses = {side: [set(t.feature[t.feature >= 0].tolist()) for t in m.made] for side, m in chances.items()}
    platt = model.platt

    def chance(side: str, value: np.ndarray, h: np.ndarray) -> np.ndarray:
        raw = 1 / (1 + np.exp(-2 * value))
        out, x = raw.copy(), np.clip(raw, 1e-6, 1 - 1e-6)
        for (at, s), (w, b) in platt.items():
            if s == side:
                mine = h == at
                out[mine] = 1 / (1 + np.exp(-(w * np.log(x[mine] / (1 - x[mine])) + b)))
        return out

    def each(parts):
        for b in parts:
            n = len(b.y)
            plain = {side: [m.part(k, b.codes, n) for k in range(len(m.made))] for side, m in chances.items()}
            for k in range(len(features) + 1):
                codes, h, moved = list(b.codes), b.g, set(of.get(k, ()))
                if k:
                    order = np.random.default_rng([seed, k, *b.key]).permutation(n)
                    for i in moved:
                        codes[i] = codes[i][order]
                    h = h[order] if features[k - 1] == "h" else h
                q = {side: chance(side, sum(m.part(i, codes, n) if moved & uses[side][i] else plain[side][i] for i in range(len(m.made))), h) for side, m in chances.items()}
                s, at = np.unique(q["up"] / np.maximum(1.0, q["up"] + q["down"]), return_inverse=True)
                yield {"_k": np.full(len(s), k), "s": s, "n": np.bincount(at, minlength=len(s)), "pos": np.bincount(at, b.y > MOVE, minlength=len(s)).astype(np.int64)}

    return blocks.over(each, "_k int, s double, n long, pos long").groupBy("_k", "s").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))


def importance(fit: DataFrame, calibration: DataFrame, rows: DataFrame, numbers: list[str], categories: list[str], depth: int, rounds: int) -> DataFrame:
    """M9: feature and auc_drop, largest first: how much the AUC of rises of the fitted change model falls on all rows when a feature's values change places.

    rows: with wine_id, t, h; they are dealt to blocks by a hash of these, so that a block is like any other."""
    made = encoded(fit, numbers, categories)
    model, chances = grown_changes(made, {"": (numbers, categories)}, depth, rounds)[""]
    calibrate(model, calibration)
    dealt = rows.repartition(rows.rdd.getNumPartitions(), F.xxhash64("wine_id", "t", "h"))
    blocks = packed(made[0], arrays(made[0], prepared(dealt, numbers, categories)), like=made.blocks)
    features = [*numbers, *categories]
    auc = cut(metrics.ranked(moved_scores(model, chances, blocks, features), ["_k"]).select("_k", "roc_auc"))
    base = auc.filter("_k = 0").select(F.col("roc_auc").alias("base"))
    name = F.element_at(F.array(*[F.lit(f) for f in features]), F.col("_k"))
    out = auc.filter("_k > 0").join(F.broadcast(base), F.lit(True)).select(name.alias("feature"), rounded(F.col("base") - F.col("roc_auc"), 4).alias("auc_drop"))
    return out.orderBy(F.desc("auc_drop"), "feature")


#: The least expected error that a band is scaled by.
LEAST_WIDTH = 1e-3


@dataclass
class WidthModel:
    """The expected absolute error of a row."""

    encode: PipelineModel
    trees: object
    numbers: list[str]
    categories: list[str]

    def transform(self, rows: DataFrame) -> DataFrame:
        """rows with w."""
        return self.of(self.encode.transform(prepared(rows, self.numbers, self.categories))).select(*rows.columns, "w")

    def of(self, encoded: DataFrame) -> DataFrame:
        return self.trees.setPredictionCol("w").transform(encoded).withColumn("w", F.greatest("w", F.lit(LEAST_WIDTH)))


def fit_width(encode: PipelineModel, errors: DataFrame, numbers: list[str], categories: list[str], depth: int, rounds: int, seed: int = 42) -> WidthModel:
    """errors: features (by encode) and e, the error of the median."""
    return WidthModel(encode, _trees(GBTRegressor, "a", depth, rounds, seed).fit(errors.withColumn("a", F.abs("e"))), numbers, categories)


def spread(errors: DataFrame, by: str) -> DataFrame:
    """by, lo, hi: percentiles of errors (e) divided by their expected size (w), on either side of 0."""
    part = lambda q: F.percentile_approx(F.col("e") / F.col("w"), q, 10_000)
    return errors.groupBy(by).agg(F.least(part(0.1), F.lit(0.0)).alias("lo"), F.greatest(part(0.9), F.lit(0.0)).alias("hi"))


def band(rows: DataFrame, spread: DataFrame, by: str) -> DataFrame:
    """rows (with p50, w) and p10, p90; without a spread for the row's key there is no width. spread has one row for each horizon or fold."""
    x = rows.join(F.broadcast(spread), by, "left")
    return x.withColumns({"p10": F.col("p50") + F.coalesce("lo", F.lit(0.0)) * F.col("w"), "p90": F.col("p50") + F.coalesce("hi", F.lit(0.0)) * F.col("w")}).drop("lo", "hi", "w")


@dataclass
class RangeModel:
    """M6: a median model, a width for each row, and the band's adjustment by horizon."""

    encode: PipelineModel
    median: object
    width: WidthModel | None
    spread: DataFrame | None
    adjust: DataFrame | None
    numbers: list[str]
    categories: list[str]

    def middle(self, rows: DataFrame) -> DataFrame:
        x = self.encode.transform(prepared(rows, self.numbers, self.categories))
        return self.median.setPredictionCol("p50").transform(x).select(*rows.columns, "p50")

    def raw(self, rows: DataFrame) -> DataFrame:
        return band(self.width.transform(self.middle(rows)), self.spread, "h")

    def transform(self, rows: DataFrame) -> DataFrame:
        x = self.raw(rows)
        return metrics.widen(x, self.adjust) if self.adjust is not None else x


def fit_range(
    fit: DataFrame, calibration: DataFrame | None, numbers: list[str], categories: list[str], depth: int = 4, rounds: int = 10, seed: int = 42, median_only: bool = False,
    made: Encoded | None = None, median: trees.Model | None = None, alone: bool = False,
) -> RangeModel:
    """median_only: only the median is fitted, for bands that come from errors of other rows (fit_width). made: what encoded() gave for the fit rows;
    median: the trees, if they are grown already. alone: one of many small fits, by Spark's own learner (also where median_only)."""
    made = made or encoded(fit, numbers, categories)
    if median_only or (alone and calibration is None):
        encode = made[0]
        x = cut(encode.transform(prepared(fit, numbers, categories)).select("features", "y", *[c for c in ("h",) if c in fit.columns]))
        median = _trees(GBTRegressor, "y", depth, rounds, seed, lossType="absolute").fit(x)
        model = RangeModel(encode, median, None, None, None, numbers, categories)
        if not median_only:
            errors = cut(median.setPredictionCol("p").transform(x).select("features", "h", (F.col("y") - F.col("p")).alias("e")))
            model.width = fit_width(encode, errors, numbers, categories, depth, rounds, seed)
            model.spread = cut(spread(model.width.of(errors), "h"))
        return model
    encode, blocks = made[0], made.blocks
    median = median or trees.grow(blocks, [trees.Model("absolute", every, depth, rounds, seed=seed)])[0]
    model = RangeModel(encode, trees.spark_model(blocks, median), None, None, None, numbers, categories)
    width = trees.Model("squared", lambda b: (np.arange(len(b.y)), np.abs(b.y - median.score(b))), depth, rounds, seed=seed)
    trees.grow(blocks, [width])
    model.width = WidthModel(encode, trees.spark_model(blocks, width), numbers, categories)
    errors = blocks.over(lambda parts: ({"h": b.g, "e": b.y - median.score(b), "w": np.maximum(width.score(b), LEAST_WIDTH)} for b in parts), "h int, e double, w double")
    model.spread = cut(spread(errors, "h"))
    if calibration is not None:
        # Scored once, as the adjustment reads it twice.
        model.adjust = cut(metrics.conformal_adjust(cut(model.raw(calibration).select("h", "y", "p10", "p90"))))
    return model


def rolling_predictions(t: DataFrame, sets: dict[str, tuple[list[str], list[str]]], seeds: tuple[int, ...], folds: int = 4, depth: int = 3, rounds: int = 8) -> DataFrame:
    """Fold, fold_end, set, seed, y, family_mean_change, p10, p50, p90, p_up: the transitions of each of the last `folds` years, scored by models of the
    transitions up to the year's start. A year without transitions, or without any before it, has no rows.

    t: date, y, h (1), family_mean_change and the features of all sets (numbers, categories)."""
    last = t.agg(F.max("date").alias("d")).first()["d"]
    end = F.add_months(F.lit(last), -12 * F.col("k"))
    years = t.sparkSession.range(folds).withColumnRenamed("id", "k").select("k", end.alias("end"),
        F.add_months(end, -12).alias("start")).orderBy("k").collect()  # one row for each fold
    jobs = []
    for k, to, since in years:
        train, test = t.filter(F.col("date") <= since), t.filter((F.col("date") > since) & (F.col("date") <= to))
        if train.take(1) and test.take(1):
            jobs += [functools.partial(_rolled, train, test, k, to, name, seed, *sets[name], depth, rounds) for name in sets for seed in seeds]
    if not jobs:
        raise ValueError("no year has transitions and others before it")
    return side_by_side(jobs)


def _rolled(train: DataFrame, test: DataFrame, fold: int, end, name: str, seed: int, numbers: list[str], categories: list[str], depth: int, rounds: int) -> DataFrame:
    made = encoded(train, numbers, categories)
    band = fit_range(train, None, numbers, categories, depth, rounds, seed, made=made, alone=True)
    x = made[0].transform(prepared(train, numbers, categories)).select("features", (F.col("y") > MOVE).cast("double").alias("up"))
    rise = _trees(GBTClassifier, "up", depth, rounds, seed).fit(cut(x))
    out = rise.setProbabilityCol("v").setRawPredictionCol("r").setPredictionCol("c").transform(band.encode.transform(prepared(band.transform(test), numbers, categories)))
    keys = [F.lit(v).alias(n) for n, v in (("fold", fold), ("fold_end", end), ("set", name), ("seed", seed))]
    return out.select(*keys, "y", "family_mean_change", "p10", "p50", "p90", vector_to_array("v")[1].alias("p_up"))


def rolling_scores(p: DataFrame) -> DataFrame:
    """For each fold, set and seed the transitions, their share of rises, the mean absolute errors of the model, of the same price and of the family's
    mean change (0 without one), the AUC of rises (null with one class) and the band's coverage. p: rolling_predictions."""
    by, y = ["fold", "fold_end", "set", "seed"], F.col("y")
    x = p.withColumn("hit", y > MOVE)
    g = x.groupBy(*by).agg(
        (F.avg(F.col("hit").cast("double")) * 100).alias("share_up_pct"), F.avg(F.abs(y - F.col("p50"))).alias("mae"), F.avg(F.abs(y)).alias("same_price_mae"),
        F.avg(F.abs(y - F.coalesce("family_mean_change", F.lit(0.0)))).alias("family_history_mae"),
        (F.avg(y.between(F.col("p10"), F.col("p90")).cast("double")) * 100).alias("coverage_80"),
    )
    return g.join(metrics.ranking(x, by, "p_up", "hit").select(*by, F.col("n").alias("transitions"), F.col("roc_auc").alias("auc")), by)


def forecast(latest: DataFrame, change: ChangeModel, band: RangeModel) -> DataFrame:
    """M4: wine_id, h, target_date, prices (to cents, in order), chances and sizes for rows of the latest list with h and target_date."""
    x = change.transform(band.transform(latest))
    price = lambda c: F.round(F.exp(F.col("log_price") + F.col(c)), 2).alias(c)
    return x.select("wine_id", "h", "target_date", price("p10"), price("p50"), price("p90"), F.round("p_up", 4).alias("p_up"),
        F.round("p_down", 4).alias("p_down"), F.round("up_pct", 1).alias("up_pct"), F.round("down_pct", 1).alias("down_pct"))


def side_by_side(jobs: list[Callable[[], DataFrame]], threads: int = 2) -> DataFrame:
    """The union of what the jobs return, each written as a table. They run on a few threads: small fits mostly wait for the scheduler."""
    with ThreadPoolExecutor(threads) as pool:
        return functools.reduce(DataFrame.unionByName, pool.map(lambda job: cut(job()), jobs))


def name_scores(train: DataFrame, target: DataFrame, weights: DataFrame, train_weights: DataFrame, buckets: int = 1 << 18) -> DataFrame:
    """Key, name_score: a ridge on hashed TF-IDF terms (weights: wine_id, term, w), fitted on train's y less its mean. A text without a known term
    takes part as a vector of zeros."""
    mean = train.agg(F.avg("y").alias("mean"), F.count(F.lit(1)).alias("n"), F.stddev("y").alias("sd")).first()
    x = _vectors(train.select("wine_id", (F.col("y") - mean["mean"]).alias("label")), train_weights, buckets)
    # Spark divides the penalty by the label's deviation: with it, the ridge has the weight 1.
    lr = LinearRegression(regParam=(mean["sd"] or 1.0) / max(1, mean["n"]), elasticNetParam=0.0, standardization=False, maxIter=30, solver="l-bfgs").fit(x)
    return lr.transform(_vectors(target.select("wine_id"), weights, buckets)).select("wine_id", F.col("prediction").alias("name_score"))


def held_out_scores(rows: DataFrame, groups: list[tuple[int, ...]]) -> DataFrame:
    """left_out, wine_id, fold, name_score: for each group of folds, the scores of their rows by a model of all other folds. rows: wine_id, text, y, fold."""

    def job(group: tuple[int, ...]) -> DataFrame:
        train, target = rows.filter(~F.col("fold").isin(*group)), rows.filter(F.col("fold").isin(*group))
        found = name_scores(train, target, fair.tfidf(train, target), fair.tfidf(train, train))
        return target.select("wine_id", "fold").join(found, "wine_id").withColumn("left_out", F.array(*[F.lit(k) for k in group]))

    return side_by_side([functools.partial(job, g) for g in groups])


def _vectors(rows: DataFrame, weights: DataFrame, buckets: int) -> DataFrame:
    """rows (with wine_id) and features: a sparse vector with one weight for each hashed term of the wine's name."""
    hashed = weights.groupBy("wine_id", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int").alias("b")).agg(F.sum("w").alias("w"))
    x = rows.join(hashed.groupBy("wine_id").agg(F.array_sort(F.collect_list(F.struct("b", "w"))).alias("m")), "wine_id", "left")
    x = x.withColumn("m", F.coalesce("m", F.array().cast("array<struct<b:int,w:double>>")))
    parts = F.struct(F.lit(0).alias("type"), F.lit(buckets).alias("size"), F.col("m.b").alias("indices"), F.col("m.w").alias("values"))
    # Spark has no function that makes a sparse vector of arrays; its JSON reader knows the vector's type (0: sparse) and keeps doubles exactly.
    made = F.from_json(F.to_json(F.struct(parts.alias("v"))), StructType([StructField("v", VectorUDT())]))
    return cut(x.withColumn("features", made["v"]).drop("m"))
