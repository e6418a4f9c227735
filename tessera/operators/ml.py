"""Learning: models, cross-validation, importance, projection and resampling over feature tables with gene and label."""

from __future__ import annotations

from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import TaskContext, inheritable_thread_target
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.durable import cut, release
from tessera.operators import binned, features, metrics
from tessera.operators.binned import NODE
from tessera.operators.binned import vote as _vote

#: Rows that the array-based models (extra trees, oversampling) take from a training table; a larger one is refused.
LOCAL_ROWS = 200_000
#: Training rows of a part in cross-validation, and of the folds that are worked on side by side.
PART_ROWS, TOGETHER = 20_000, 200_000
#: Folds worked on side by side, at most: each holds its jobs, forests and broadcasts on the driver.
FOLDS_TOGETHER = 1


def assemble(df: DataFrame, columns: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=columns, outputCol="features", handleInvalid="error").transform(df)


def with_weights(train: DataFrame) -> DataFrame:
    """Add the balanced class weight of each row."""
    w = features.class_weights(train).select("label", "weight")
    return train.join(F.broadcast(w), "label")


class Classifier:
    """fit(train, columns) -> model with score(df) -> gene, score (and label where there is one)."""

    def __init__(self, estimator, scaled: bool = False):
        self.estimator, self.scaled = estimator, scaled

    def fit(self, train: DataFrame, columns: list[str]) -> Model:
        parameters = None
        if self.scaled:
            parameters = features.robust_parameters(train, columns)
            train = features.scale(train, parameters, columns)
        estimator = self.estimator
        if isinstance(estimator, LogisticRegression):
            # an L2 penalty of C = 1 on the summed loss is 1 / (C * sum of weights) on the mean loss
            estimator = estimator.copy({estimator.regParam: 1.0 / max(train.count(), 1)})
        return Model(estimator.fit(assemble(with_weights(train), columns)), columns, parameters)


class Model:
    def __init__(self, fitted, columns: list[str], parameters: DataFrame | None):
        self.fitted, self.columns, self.parameters = fitted, columns, parameters

    def score(self, df: DataFrame) -> DataFrame:
        rows = features.scale(df, self.parameters, self.columns) if self.parameters is not None else df
        out = self.fitted.transform(assemble(rows, self.columns))
        keep = [c for c in ("gene", "label") if c in df.columns]
        if "probability" in out.columns:
            return out.select(*keep, vector_to_array("probability")[1].alias("score"))
        margin = out.select(*keep, vector_to_array("rawPrediction")[1].alias("margin"))
        return metrics.min_max(margin, "margin", "score").drop("margin")

    def importance(self) -> dict[str, float]:
        """Impurity decrease or absolute coefficient of each feature."""
        values = self.fitted.featureImportances if hasattr(self.fitted, "featureImportances") else self.fitted.coefficients
        return {c: abs(float(v)) for c, v in zip(self.columns, values.toArray(), strict=True)}


#: Bytes of trees that the driver holds and sends to the tasks at once.
SHARE = 32_000_000


def _grow(x: np.ndarray, y: np.ndarray, w: np.ndarray, rng: np.random.Generator, tries: int, most_depth: int) -> np.ndarray:
    """One extremely randomised tree as NODEs, all nodes of a level at once."""
    levels, rows, start, first, mine = [], np.arange(len(y)), np.zeros(1, np.int64), 0, w * y
    for depth in range(most_depth + 1):
        size = np.diff(np.append(start, len(rows)))
        positive, total = np.add.reduceat(mine[rows], start), np.add.reduceat(w[rows], start)
        level = np.zeros(len(size), NODE)
        level["feature"], level["value"] = -1, positive / total
        levels.append(level)
        live = np.flatnonzero((size > 1) & (positive > 0) & (positive < total)) if depth < most_depth else []
        if not len(live):
            break
        rows = rows[np.repeat(np.isin(np.arange(len(size)), live), size)]
        size, positive, total = size[live], positive[live], total[live]
        start = np.cumsum(size) - size
        ww, wy = w[rows], mine[rows]
        chosen = rng.random((len(live), x.shape[1])).argpartition(tries - 1, axis=1)[:, :tries]
        best, feature, cut_at, goes = np.full(len(live), np.inf), np.zeros(len(live), np.int64), np.zeros(len(live)), np.zeros(len(rows), bool)
        for f in chosen.T:
            v = x[rows, np.repeat(f, size)]
            low, high = np.minimum.reduceat(v, start), np.maximum.reduceat(v, start)
            at = rng.uniform(low, high)
            left = v <= np.repeat(at, size)
            n = np.add.reduceat(left, start, dtype=np.int64)
            a, p = np.add.reduceat(ww * left, start), np.add.reduceat(wy * left, start)
            b, q = total - a, positive - p
            with np.errstate(divide="ignore", invalid="ignore"):
                impurity = p * (1 - p / a) + q * (1 - q / b)
            better = (n > 0) & (n < size) & (impurity < best)
            best, feature, cut_at = np.where(better, impurity, best), np.where(better, f, feature), np.where(better, at, cut_at)
            goes = np.where(np.repeat(better, size), left, goes)
        split = np.isfinite(best)
        if not split.any():
            break
        first += len(level)
        at = live[split]
        level["feature"][at], level["value"][at], level["left"][at] = feature[split], cut_at[split], first + 2 * np.arange(len(at))
        kept = np.repeat(split, size)
        child = (np.repeat(2 * (np.cumsum(split) - 1), size) + ~goes)[kept]
        order = np.argsort(child, kind="stable")
        rows = rows[kept][order]
        sizes = np.bincount(child, minlength=2 * len(at))
        start = np.cumsum(sizes) - sizes
    return np.concatenate(levels)


def _votes(held):
    """Column form: the sum of the votes of the trees that are broadcast."""

    @F.pandas_udf("double")
    def votes(rows: pd.Series) -> pd.Series:
        x = np.array(rows.tolist(), float).reshape(len(rows), -1)
        return pd.Series(sum((_vote(np.frombuffer(t, NODE), x) for t in held.value), np.zeros(len(x))))

    return votes


def _table(train: DataFrame, columns: list[str]) -> np.ndarray:
    """label, weight and the columns of training rows, up to LOCAL_ROWS, in the order of genes."""

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for i, pdf in enumerate(batches):
            yield pd.DataFrame({"part": [TaskContext.get().partitionId()], "i": [i], "rows": [np.ascontiguousarray(pdf.to_numpy(float)).tobytes()]})

    sorted_rows = with_weights(train).orderBy("gene").select("label", "weight", *columns)
    parts = sorted(sorted_rows.mapInPandas(packed, "part int, i int, rows binary").collect(), key=lambda r: (r.part, r.i))
    return np.frombuffer(b"".join(r.rows for r in parts)).reshape(-1, len(columns) + 2)


class ExtraTrees:
    """Extremely randomised trees on balanced weights: one task grows each share of the trees from a broadcast table.

    The driver holds the training rows as packed arrays, never the trees, which may be larger than the rows by far.
    """

    def __init__(self, trees: int = 500, most_depth: int = 40, seed: int = 42):
        self.trees, self.most_depth, self.seed = trees, most_depth, seed

    def fit(self, train: DataFrame, columns: list[str]) -> ExtraTreesModel:
        if (n := train.count()) > LOCAL_ROWS:
            raise ValueError(f"extra trees take up to {LOCAL_ROWS} training rows, not {n}")
        spark, depth, seed = train.sparkSession, self.most_depth, self.seed
        table = _table(train, columns)
        shared = spark.sparkContext.broadcast(table)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            y, w, x = shared.value[:, 0].copy(), shared.value[:, 1].copy(), shared.value[:, 2:]
            tries = max(1, int(np.sqrt(x.shape[1])))
            for batch in batches:
                for tree in batch["id"]:
                    nodes = _grow(x, y, w, np.random.default_rng([seed, int(tree)]), tries, depth)
                    used = np.bincount(nodes["feature"][nodes["feature"] >= 0], minlength=x.shape[1])
                    yield pd.DataFrame({"tree": [tree], "size": [nodes.nbytes], "used": [used.tolist()], "nodes": [nodes.tobytes()]})

        grown = cut(spark.range(self.trees).repartition(min(self.trees, 64)).mapInPandas(run, "tree long, size long, used array<long>, nodes binary"))
        shared.destroy()
        return ExtraTreesModel(grown, columns)


class ExtraTreesModel:
    """trees: tree, size (bytes), used (splits by each feature), nodes (NODEs), written."""

    def __init__(self, trees: DataFrame, columns: list[str]):
        self.trees, self.columns = trees, columns

    def shares(self) -> list[tuple[int, int]]:
        """First and last tree of shares of up to SHARE bytes (a larger tree is one of its own)."""
        out, have = [], 0
        for r in self.trees.select("tree", "size").orderBy("tree").collect():  # two numbers a tree
            if out and have + r["size"] <= SHARE:
                out[-1], have = (out[-1][0], r.tree), have + r["size"]
            else:
                out, have = [*out, (r.tree, r.tree)], r["size"]
        return out

    def score(self, df: DataFrame) -> DataFrame:
        """The mean vote; one pass over the rows for each share of the trees, which are written between passes."""
        spark, keep, n = df.sparkSession, [c for c in ("gene", "label") if c in df.columns], self.trees.count()
        rows = df.select(*keep, F.array(*(F.col(c).cast("double") for c in self.columns)).alias("_x"), F.lit(0.0).alias("_total"))
        shares = self.shares()
        for k, (first, last) in enumerate(shares):
            held = spark.sparkContext.broadcast([bytes(r.nodes) for r in self.trees.filter(F.col("tree").between(first, last)).select("tree", "nodes").orderBy("tree").collect()])

            rows = rows.withColumn("_total", F.col("_total") + _votes(held)("_x"))
            if k + 1 < len(shares):
                rows = cut(rows)
                held.destroy()
        return rows.select(*keep, self._score(F.col("_total"), n).alias("score"))

    @staticmethod
    def _score(total, n: int):
        return total / n

    def importance(self) -> dict[str, float]:
        """Share of splits that use each feature."""
        used = self.trees.select(*(F.sum(F.col("used")[i]).alias(f"_{i}") for i in range(len(self.columns)))).first()
        return {c: (v or 0) / max(sum(x or 0 for x in used), 1) for c, v in zip(self.columns, used, strict=True)}


class BoostedModel(ExtraTreesModel):
    """Trees whose votes add up to half the log odds of class 1."""

    @staticmethod
    def _score(total, n: int):
        return 1 / (1 + F.exp(-2 * total))


def _summed(rows: DataFrame, part, size: int) -> np.ndarray:
    """The sum of part(x, y, w), arrays of `size` numbers, over all rows: inside the tasks, then in 16 groups of them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(size)
        for pdf in batches:
            if len(pdf):
                total += part(np.stack(pdf["x"]).astype(float), pdf["y"].to_numpy(float), pdf["w"].to_numpy(float))
        yield pd.DataFrame({"k": [TaskContext.get().partitionId() % 16], "sum": [total.tobytes()]})

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"sum": [sum(np.frombuffer(s) for s in pdf["sum"]).tobytes()]})

    found = rows.mapInPandas(run, "k int, sum binary").groupBy("k").applyInPandas(join, "sum binary").collect()
    return sum((np.frombuffer(r["sum"]) for r in found), np.zeros(size))


class RbfSvm:
    """Approximate RBF support vector machine: random Fourier features, a linear machine, and a fitted sigmoid.

    The machine has squared hinge loss on balanced weights and an L2 penalty. It and the sigmoid are fitted by Newton's
    method; a step is one pass over the written rows, in which tasks lift their batches and add up the gradient and the
    matrix of second derivatives. Ten or so passes do, and no lifted row is ever written.
    """

    def __init__(self, width: int = 200, seed: int = 42, penalty: float = 0.01, most_steps: int = 30):
        self.width, self.seed, self.penalty, self.most_steps = width, seed, penalty, most_steps

    def fit(self, train: DataFrame, columns: list[str]) -> RbfSvmModel:
        rows = cut(with_weights(train).select(F.array(*(F.col(c).cast("double") for c in columns)).alias("x"), (2.0 * F.col("label") - 1).alias("y"), F.col("weight").cast("double").alias("w")))
        first = features.standard_parameters(rows.select(*(F.col("x")[i].alias(c) for i, c in enumerate(columns))), columns).first()
        rng = np.random.default_rng(self.seed)
        model = RbfSvmModel(
            columns, np.array([first[f"_c_{c}"] or 0.0 for c in columns]), np.array([first[f"_s_{c}"] or 1.0 for c in columns]),
            rng.standard_normal((len(columns), self.width)) * np.sqrt(2 / len(columns)), rng.uniform(0, 2 * np.pi, self.width),
        )
        total = rows.agg(F.sum("w")).first()[0] or 1.0
        wide, penalty = self.width + 1, np.append(np.full(self.width, self.penalty), 0.0)

        def hinge(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
            z = model.lift(x)
            slack = 1 - y * (z @ beta)
            z, y, w, slack = z[slack > 0], y[slack > 0], w[slack > 0], slack[slack > 0]
            return np.concatenate([[w @ slack**2], -2 * z.T @ (w * y * slack), (2 * z.T @ (w[:, None] * z)).ravel()])

        def loss(sums: np.ndarray, at: np.ndarray) -> float:
            return sums[0] / total + penalty @ at**2 / 2

        beta = np.zeros(wide)
        sums = _summed(rows, hinge, 1 + wide + wide**2)
        for _ in range(self.most_steps):
            slope = sums[1 : 1 + wide] / total + penalty * beta
            step = np.linalg.solve(sums[1 + wide :].reshape(wide, wide) / total + np.diag(penalty + 1e-9), slope)
            before, old, size = loss(sums, beta), beta, 1.0
            while size > 1e-3:
                beta = old - size * step
                sums = _summed(rows, hinge, 1 + wide + wide**2)
                if loss(sums, beta) <= before:
                    break
                size /= 2
            if before - loss(sums, beta) <= 1e-9 * max(before, 1e-12):
                break
        model.beta = beta
        a, b = 1.0, 0.0
        for _ in range(self.most_steps):

            def sigmoid(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
                f = model.lift(x) @ beta
                p = 1 / (1 + np.exp(-np.clip(a * f + b, -500, 500)))
                miss, bend = w * (p - (y > 0)), w * p * (1 - p)
                return np.array([miss @ f, miss.sum(), bend @ f**2, bend @ f, bend.sum()])

            g0, g1, h00, h01, h11 = _summed(rows, sigmoid, 5) / total
            move = np.linalg.solve([[h00 + 1e-6, h01], [h01, h11 + 1e-6]], [g0 + 1e-6 * a, g1])
            move *= min(1.0, 5 / max(np.abs(move).max(), 1e-12))
            a, b = a - move[0], b - move[1]
            if np.abs(move).max() < 1e-6:
                break
        model.sigmoid = (a, b)
        return model


class RbfSvmModel:
    def __init__(self, columns, centre, spread, directions, phases):
        self.columns, self.centre, self.spread, self.directions, self.phases = columns, centre, spread, directions, phases

    def lift(self, x: np.ndarray) -> np.ndarray:
        """Random Fourier features of rows, and a column of ones."""
        waves = np.cos((x - self.centre) / self.spread @ self.directions + self.phases) * np.sqrt(2 / len(self.phases))
        return np.hstack([waves, np.ones((len(x), 1))])

    def score(self, df: DataFrame) -> DataFrame:
        shared = df.sparkSession.sparkContext.broadcast(self)

        @F.pandas_udf("double")
        def probability(rows: pd.Series) -> pd.Series:
            model = shared.value
            margin = model.lift(np.array(rows.tolist(), float).reshape(len(rows), -1)) @ model.beta
            return pd.Series(1 / (1 + np.exp(-np.clip(model.sigmoid[0] * margin + model.sigmoid[1], -500, 500))))

        keep = [c for c in ("gene", "label") if c in df.columns]
        return df.select(*keep, probability(F.array(*(F.col(c).cast("double") for c in self.columns))).alias("score"))


def models(seed: int = 42, trees: int = 500, rounds: int = 300) -> dict[str, object]:
    """The model set by name, balanced by weights: random forest, gradient boosting, logistic regression, extra trees."""
    weight = {"weightCol": "weight", "labelCol": "label"}
    return {
        "random_forest": Classifier(RandomForestClassifier(numTrees=trees, maxDepth=15, featureSubsetStrategy="sqrt", seed=seed, **weight)),
        "gradient_boosting": Classifier(GBTClassifier(maxIter=rounds, stepSize=0.05, maxDepth=4, subsamplingRate=0.8, featureSubsetStrategy="sqrt", seed=seed, **weight)),
        "logistic_regression": Classifier(LogisticRegression(maxIter=2000, elasticNetParam=0.0, standardization=False, **weight), scaled=True),
        "extra_trees": ExtraTrees(trees, seed=seed),
    }


def smote(train: DataFrame, columns: list[str], neighbours: int = 5, seed: int = 42) -> DataFrame:
    """Add synthetic rows of the minority class, between its rows and their nearest ones, until the classes are even."""
    counts = {r["label"]: r["count"] for r in train.groupBy("label").count().collect()}  # one row per class
    minor = min(counts, key=lambda c: (counts[c], c))
    lack = max(counts.values()) - counts[minor]
    if counts[minor] > LOCAL_ROWS or counts[minor] < 2 or not lack:
        if counts[minor] > LOCAL_ROWS:
            raise ValueError(f"oversampling takes up to {LOCAL_ROWS} minority rows")
        return train
    spark = train.sparkSession
    pdf = train.filter(F.col("label") == minor).select("gene", *columns).toPandas().sort_values("gene")
    shared = spark.sparkContext.broadcast(pdf[columns].to_numpy(float))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        x = shared.value
        k = min(neighbours, len(x) - 1)
        for pdf in batches:
            ids = pdf["id"].to_numpy()
            rng = np.random.default_rng([seed, *ids[:1].tolist()])
            own = ids % len(x)
            far = ((x[own][:, None] - x[None]) ** 2).sum(axis=2) if len(ids) * len(x) < 5_000_000 else np.stack([((x[o] - x) ** 2).sum(axis=1) for o in own])
            far[np.arange(len(ids)), own] = np.inf
            near = np.argpartition(far, k - 1, axis=1)[np.arange(len(ids)), rng.integers(0, k, len(ids))]
            made = x[own] + rng.random((len(ids), 1)) * (x[near] - x[own])
            yield pd.DataFrame(made, columns=columns).assign(gene=[f"synthetic_{i}" for i in ids], label=minor)

    shape = ", ".join(f"`{c}` double" for c in columns) + ", gene string, label int"
    made = spark.range(lack).mapInPandas(run, shape)
    base = train.select(F.col("gene").cast("string").alias("gene"), "label", *(F.col(c).cast("double").alias(c) for c in columns))
    return base.unionByName(made.select("gene", F.col("label").cast(train.schema["label"].dataType).alias("label"), *columns))


def _compact(train: DataFrame) -> tuple[DataFrame, int]:
    """Training rows, written, in parts of up to PART_ROWS rows, and their number. Fits make thousands of passes over them,
    each a task a part."""
    train = cut(train)
    n = train.count()
    return train.coalesce(max(1, -(-n // PART_ROWS))), n


def _arrays_do(estimator) -> bool:
    """Whether the estimator is a forest or boosting with settings that tessera.operators.binned has."""
    if not isinstance(estimator, RandomForestClassifier | GBTClassifier) or not estimator.isDefined("weightCol") or estimator.getWeightCol() != "weight":
        return False
    plain = estimator.getMinInstancesPerNode() == 1 and estimator.getMinInfoGain() == 0 and estimator.getMinWeightFractionPerNode() == 0
    drawn = estimator.getFeatureSubsetStrategy() in ("sqrt", "all")
    if isinstance(estimator, RandomForestClassifier):
        return plain and drawn and estimator.getImpurity() == "gini"
    return plain and drawn and not estimator.isDefined("validationIndicatorCol")


def fit_fold(model, train: DataFrame, n: int, columns: list[str]):
    """Fit a model for scoring only. Forests and boosting over up to LOCAL_ROWS rows are grown from arrays, in tasks, since Spark ML
    takes a job for each level of each round; the same definitions hold, so beyond Spark ML grows them."""
    e = getattr(model, "estimator", None)
    if n > LOCAL_ROWS or getattr(model, "scaled", False) or not _arrays_do(e) or train.filter(F.col("label") == 1).count() in (0, n):
        return model.fit(train, columns)
    spark, table = train.sparkSession, _table(train, columns)
    tries = int(np.ceil(np.sqrt(len(columns)))) if e.getFeatureSubsetStrategy() == "sqrt" else len(columns)
    depth, seed, bins, rate = e.getMaxDepth(), e.getSeed() % 2**63, e.getMaxBins(), e.getSubsamplingRate()
    shape = "tree long, size long, used array<long>, nodes binary"
    row = lambda k, t: {"tree": k, "size": t.nbytes, "used": np.bincount(t["feature"][t["feature"] >= 0], minlength=len(columns)).tolist(), "nodes": t.tobytes()}
    if isinstance(e, RandomForestClassifier):
        again, trees = e.getBootstrap(), e.getNumTrees()
        shared = spark.sparkContext.broadcast((binned.Table(table[:, 2:], table[:, 1], bins), table[:, 0].copy(), table[:, 1].copy()))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            cut_up, y, w = shared.value
            for batch in batches:
                for k in batch["id"].tolist():
                    yield pd.DataFrame([row(k, binned.forest_tree(cut_up, y, w, tries, depth, rate, again, np.random.default_rng([seed, k])))])

        grown = cut(spark.range(trees).repartition(min(trees, 64)).mapInPandas(run, shape))
        shared.destroy()
        return ExtraTreesModel(grown, columns)
    rounds, step = e.getMaxIter(), e.getStepSize()
    shared = spark.sparkContext.broadcast(table)

    def boost(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                y, w, x = shared.value[:, 0].copy(), shared.value[:, 1].copy(), shared.value[:, 2:]
                yield pd.DataFrame([row(k, t) for k, t in enumerate(binned.boosted(x, y, w, rounds, step, tries, depth, rate, bins, seed))])

    grown = cut(spark.range(0, 1, 1, 1).mapInPandas(boost, shape))
    shared.destroy()
    return BoostedModel(grown, columns)


def cross_validate(df: DataFrame, columns: list[str], chosen: dict[str, object], undersample: bool = True, oversample: bool = False, seed: int = 42) -> DataFrame:
    """model, cv_fold, auroc, auprc, f1, mcc of each model and fold; df has cv_fold. Resampling touches training folds only.

    Rows and training folds are written once for all models. Up to FOLDS_TOGETHER folds, if they have up to TOGETHER training rows, are worked
    on side by side, since a fit over few rows waits for its jobs most of the time.
    """
    df = cut(df)
    folds = [r[0] for r in df.select("cv_fold").distinct().orderBy("cv_fold").collect()]  # a handful
    trains = {}
    for fold in folds:
        train = df.filter(F.col("cv_fold") != fold)
        trains[fold] = _compact(smote(train, columns, seed=seed) if oversample else features.undersample(train, seed) if undersample else train)

    def one(fold: int) -> dict[str, tuple]:
        found = {}
        for name, model in chosen.items():
            scored = fit_fold(model, *trains[fold], columns).score(df.filter(F.col("cv_fold") == fold)).cache()
            half = metrics.ratios(metrics.confusion(scored)).select("f1", "mcc")
            row = metrics.areas(scored).withColumnRenamed("average_precision", "auprc").crossJoin(half)
            found[name] = row.select(F.lit(name).alias("model"), F.lit(fold).alias("cv_fold"), "auroc", "auprc", "f1", "mcc").first()
            scored.unpersist()
            release(df.sparkSession)
        return found

    most = max((n for _, n in trains.values()), default=1)
    with ThreadPoolExecutor(max(1, min(FOLDS_TOGETHER, TOGETHER // max(most, 1)))) as pool:
        found = list(pool.map(inheritable_thread_target(df.sparkSession)(one), folds))
    rows = [f[name] for name in chosen for f in found]
    return df.sparkSession.createDataFrame(rows, "model string, cv_fold int, auroc double, auprc double, f1 double, mcc double")


def cv_table(folds: DataFrame) -> DataFrame:
    """Mean and population deviation of each metric of each model, and a column for each fold, rounded to 6 places."""
    names = ["auroc", "auprc", "f1", "mcc"]
    out = folds.groupBy("model").agg(*(F.round(f(m), 6).alias(f"{p}_{m}") for m in names for p, f in (("mean", F.avg), ("std", F.stddev_pop))))
    long = folds.unpivot(["model", "cv_fold"], names, "metric", "value").withColumn("key", F.concat(F.lit("fold"), "cv_fold", F.lit("_"), "metric"))
    return out.join(long.groupBy("model").pivot("key").agg(F.round(F.first("value"), 6)), "model")


def best_model(table: DataFrame, metric: str = "auprc", order: list[str] | None = None) -> str:
    """The model of highest mean metric; the first of `order` on ties."""
    rows = table.select("model", f"mean_{metric}").collect()  # one row per model
    order = order or sorted(r["model"] for r in rows)
    return max(rows, key=lambda r: (r[f"mean_{metric}"] or 0.0, -order.index(r["model"])))["model"]


def soft_vote(scores: list[DataFrame], weights: list[float] | None = None) -> DataFrame:
    """gene, score: the (weighted) mean probability of several models."""
    weights = weights or [1.0] * len(scores)
    rows = reduce(DataFrame.union, [s.select("gene", "score", F.lit(w).alias("w")) for s, w in zip(scores, weights, strict=True)])
    return rows.groupBy("gene").agg((F.sum(F.col("score") * F.col("w")) / F.sum("w")).alias("score"))


def calibrate(scored: DataFrame, fitted_on: DataFrame) -> DataFrame:
    """Sigmoid calibration of scores by a holdout with labels."""
    lift = lambda d: d.withColumn("features", array_to_vector(F.array("score")))
    model = LogisticRegression().fit(lift(fitted_on))
    keep = [c for c in ("gene", "label") if c in scored.columns]
    return model.transform(lift(scored)).select(*keep, vector_to_array("probability")[1].alias("score"))


def permutation_importance(model, df: DataFrame, columns: list[str], repeats: int = 10, seed: int = 42) -> DataFrame:
    """feature, importance, deviation: mean drop of AUROC when a feature is dealt out anew among the rows.

    Each repeat pairs every row with another one in hash order; all features of a repeat are scored in one pass, over rows
    repeated for each feature, and one without a change.
    """
    tags, mark = ["", *columns], "\x01"
    rows = df.select(F.col("gene").cast("string").alias("gene"), "label", *columns)
    at = features._within_class(rows.select("gene", F.lit(0).alias("label")), seed, "label", "gene").select("gene", F.col("_k").alias("_at"))
    found = []
    for repeat in range(repeats):
        other = features._within_class(rows.withColumn("label", F.lit(0)), seed + 1 + repeat, "label", "gene")
        pairs = rows.join(at, "gene").join(other.select(F.col("_k").alias("_at"), *(F.col(c).alias(f"_p_{c}") for c in columns)), "_at")
        long = pairs.withColumn("_tag", F.explode(F.array(*map(F.lit, tags))))
        mixed = {c: F.when(F.col("_tag") == c, F.col(f"_p_{c}")).otherwise(F.col(c)) for c in columns}
        long = long.select(F.concat("_tag", F.lit(mark), "gene").alias("gene"), "label", *(v.alias(c) for c, v in mixed.items()))
        scored = model.score(long).select(F.substring_index("gene", mark, 1).alias("feature"), "label", "score")
        counts = scored.groupBy("feature", "score").agg(F.sum("label").alias("p"), F.count("*").alias("n")).withColumn("f", F.col("n") - F.col("p"))
        upto = F.sum("p").over(Window.partitionBy("feature").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0))  # over distinct scores
        areas = counts.withColumn("tp", upto).groupBy("feature").agg(F.try_divide(F.sum(F.col("f") * (F.col("tp") - F.col("p") / 2)), F.sum("p") * F.sum("f")).alias("area"))
        found += [(r["feature"], r["area"]) for r in areas.collect()]  # a row per feature
    base = next((a for f, a in found if f == ""), None) or 0.0
    drops = df.sparkSession.createDataFrame([(f, base - (a or 0.0)) for f, a in found if f], "feature string, drop double")
    return drops.groupBy("feature").agg(F.avg("drop").alias("importance"), F.stddev_pop("drop").alias("deviation"))


# Names of the feature groups and their members.
FEATURE_GROUPS = {
    "Tumor Expression Stats": ["tumor_mean", "tumor_median", "tumor_std", "tumor_iqr", "tumor_cv", "tumor_skewness", "tumor_kurtosis", "tumor_pct_expressed"],
    "Normal Expression Stats": ["normal_mean", "normal_median", "normal_std", "normal_iqr", "normal_cv", "normal_skewness", "normal_kurtosis", "normal_pct_expressed"],
    "Differential Expression": ["log2fc", "abs_log2fc", "neg_log10_padj", "cohens_d", "t_stat"],
    "Contrast Features": ["tumor_normal_mean_ratio", "std_ratio", "iqr_ratio"],
    "Rank Features": ["tumor_mean_rank", "abs_log2fc_rank", "neg_log10_padj_rank", "cohens_d_rank", "tumor_iqr_rank"],
    "Network Topology": ["degree", "weighted_degree", "avg_neighbor_degree", "betweenness_centrality", "closeness_centrality", "eigenvector_centrality", "clustering_coefficient"],
    "Network Edge Weights": ["mean_edge_weight", "max_edge_weight", "min_edge_weight", "std_edge_weight"],
    "Network Component": ["in_largest_component", "component_size"],
}
#: The contrasts of spread carry both cohorts in their names here.
_GROUP_OF = {f: g for g, members in FEATURE_GROUPS.items() for f in members} | dict.fromkeys(("tumor_normal_std_ratio", "tumor_normal_iqr_ratio"), "Contrast Features")


def feature_group(feature: str) -> str:
    return _GROUP_OF.get(feature, "Other")


def importance_table(spark, methods: dict[str, dict[str, float]]) -> DataFrame:
    """feature, rank, a scaled column for each method, mean_importance, std_importance, feature_group."""
    rows = [(m, f, max(v, 0.0), feature_group(f)) for m, values in methods.items() for f, v in values.items()]
    long = spark.createDataFrame(rows, "method string, feature string, value double, feature_group string")
    edges = long.groupBy("method").agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    scaled = long.join(F.broadcast(edges), "method").withColumn("value", (F.col("value") - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + 1e-12))
    wide = scaled.groupBy("feature", "feature_group").pivot("method", sorted(methods)).agg(F.first("value"))
    stats = scaled.groupBy("feature").agg(F.avg("value").alias("mean_importance"), F.stddev_samp("value").alias("std_importance"))
    out = wide.join(stats, "feature")  # one row per feature
    return out.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("mean_importance"), "feature")))


def project(df: DataFrame, columns: list[str], k: int = 2) -> DataFrame:
    """gene, pc1..pck of centred features; each component's largest loading is positive."""
    centred = features.scale(df, df.agg(*(F.avg(c).alias(f"_c_{c}") for c in columns), *(F.lit(1.0).alias(f"_s_{c}") for c in columns)), columns)
    rows = assemble(centred, columns)
    model = PCA(k=k, inputCol="features", outputCol="pcs").fit(rows)
    loadings = model.pc.toArray()
    signs = np.sign(loadings[np.abs(loadings).argmax(axis=0), np.arange(k)]).tolist()
    pcs = vector_to_array("pcs")
    return model.transform(rows).select("gene", *((pcs[i] * F.lit(signs[i])).alias(f"pc{i + 1}") for i in range(k)))
