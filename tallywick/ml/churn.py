"""Churn prediction on Spark ML."""

from __future__ import annotations

from dataclasses import dataclass, field
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml import Model, Transformer
from pyspark.ml.classification import GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import features as prep
from . import metrics
from .nested import prefix_scores

MODELS = ("rf", "gb", "stacking", "logistic", "calibrated")
#: Fits of folds that run side by side.
FITS_AT_ONCE = 6
#: Their fits make hundreds of short passes one after another.
SHORT_PASSES = (GBTClassifier, MultilayerPerceptronClassifier)


#: Rows that deep forests fitted side by side have between them: their nodes stand on the driver while they grow.
ROWS_AT_ONCE = 100_000


def features_of_node(strategy: str, columns: int) -> int:
    """How many of the columns a forest looks at in a node."""
    return {"sqrt": int(np.ceil(np.sqrt(columns))), "log2": max(1, int(np.ceil(np.log2(columns)))), "all": columns}[strategy]


def _probability(df: DataFrame, out: str) -> DataFrame:
    return df.withColumn(out, vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction")


@dataclass(frozen=True)
class Stack:
    """Base models and the logistic model over their scores."""

    bases: list[Model]
    top: Model

    def score(self, x: DataFrame, out: str = "score") -> DataFrame:
        names = []
        for k, m in enumerate(self.bases):
            x = _probability(m.transform(x), f"_b{k}")
            names.append(f"_b{k}")
        x = prep.vectors(x.withColumnRenamed("features", "_x"), names)
        return _probability(self.top.transform(x), out).drop("features", *names).withColumnRenamed("_x", "features")


@dataclass(frozen=True)
class Plain:
    model: Model

    def score(self, x: DataFrame, out: str = "score") -> DataFrame:
        return _probability(self.model.transform(x), out)


@dataclass(frozen=True)
class Calibrated:
    model: Model
    curve: Transformer

    def score(self, x: DataFrame, out: str = "score") -> DataFrame:
        scored = _probability(self.model.transform(x), "_raw")
        return self.curve.transform(scored.withColumn("_label", F.lit(0.0))).withColumnRenamed("prediction", out).drop("_raw", "_label")


@dataclass(frozen=True)
class ChurnResult:
    model: object
    kind: str
    features: list[str]
    categorical: list[str]
    medians: dict[str, float]
    scaling: dict[str, tuple[float, float]]
    test_scored: DataFrame  # label, score, predicted
    metrics: dict
    importance: list[tuple[str, float, float]] = field(default_factory=list)  # feature, importance, per cent

    def predict(self, df: DataFrame) -> DataFrame:
        """The rows with score, predicted and risk tier; imputed and scaled as in training."""
        full = prep.scale(prep.impute(prep.label_codes(df, self.categorical), self.medians), self.scaling)
        scored = self.model.score(prep.vectors(full, self.features)).drop("features")
        return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int")).withColumn("risk", metrics.risk_tier(F.col("score")))


@dataclass(frozen=True)
class ChurnPredictor:
    test_size: float = 0.2
    seed: int = 42
    folds: int = 5
    trees: int = 100

    def stratified(self, df: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Train and test with the label's share kept: the rows of a class whose
        hash is up to the quantile ``test_size`` of the class' hashes are tested.
        A row's hash is of its columns, so the split is the same on every run."""
        marked, cuts = self._hashed(df, [self.test_size], self.seed)
        marked = marked.withColumn("_test", F.coalesce(F.col("_h") <= cuts[0], F.lit(False)))
        return marked.where("not _test").drop("_h", "_test"), marked.where("_test").drop("_h", "_test")

    def _hashed(self, df: DataFrame, shares: list[float], seed: int) -> tuple[DataFrame, list]:
        """The rows with a hash of their columns, and its quantiles in the row's class."""
        marked = df.withColumn("_h", F.xxhash64(*[c for c, t in df.dtypes if t != "vector"], F.lit(seed)))
        found = {r.label: r.q for r in marked.groupBy("label").agg(F.percentile_approx("_h", shares, 100_000).alias("q")).collect()}

        def cut(k):
            out = F.lit(None).cast("long")
            for label, q in found.items():
                out = F.when(F.col("label") == label, F.lit(q[k])).otherwise(out)
            return out

        return marked, [cut(k) for k in range(len(shares))]

    def _forest(self, trees: int, depth: int) -> RandomForestClassifier:
        return RandomForestClassifier(numTrees=trees, maxDepth=depth, minInstancesPerNode=2, seed=self.seed, weightCol="weight")

    def _boosted(self, rounds: int, depth: int) -> GBTClassifier:
        return GBTClassifier(maxIter=rounds, maxDepth=depth, stepSize=0.1, seed=self.seed)

    def _folded(self, train: DataFrame) -> DataFrame:
        """The rows with a fold in which each class has its share."""
        marked, cuts = self._hashed(train, [k / self.folds for k in range(1, self.folds)], self.seed + 1)
        fold = F.lit(0)
        for c in cuts:
            fold = fold + F.coalesce(F.col("_h") > c, F.lit(False)).cast("int")
        return marked.withColumn("_fold", fold).drop("_h").cache()

    def _out_of_fold(self, train: DataFrame, estimators: list, rows: int) -> tuple[DataFrame, list]:
        """The rows with the scores of the estimators fitted on the other folds, and
        the estimators' models of all rows."""
        # one checkpoint serves all fits of many short passes; forests take the rows as they are dealt
        few = prep.fewer_tasks(train.select("features", "label", "_fold"), rows) if any(isinstance(e, SHORT_PASSES) for e in estimators) else None

        def fitted(task):
            k, e = task
            x = few if isinstance(e, SHORT_PASSES) else train
            return e.fit(x if k == self.folds else x.where(F.col("_fold") != k))

        # a fit leaves the cores idle while its driver grows the trees
        with ThreadPool(FITS_AT_ONCE) as pool:
            models = pool.map(inheritable_thread_target(train.sparkSession)(fitted), [(k, e) for k in range(self.folds + 1) for e in estimators], 1)
        parts = []
        for k in range(self.folds):
            rest = train.where(F.col("_fold") == k)
            for i in range(len(estimators)):
                rest = _probability(models[k * len(estimators) + i].transform(rest), f"_b{i}")
            parts.append(rest)
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out, models[self.folds * len(estimators) :]

    def fit_kind(self, train: DataFrame, kind: str):
        n = train.count()
        if kind == "rf":
            return Plain(self._forest(self.trees, 10).fit(train))
        if kind == "gb":
            return Plain(self._boosted(self.trees, 5).fit(prep.fewer_tasks(train.select("features", "label"), n)))
        if kind == "logistic":
            return Plain(LogisticRegression(maxIter=1000, regParam=1.0 / max(n, 1)).fit(train))
        if kind == "stacking":
            width = len(train.first()["features"])
            bases = [self._forest(max(2, self.trees // 2), 8), self._boosted(max(2, self.trees // 2), 4), MultilayerPerceptronClassifier(layers=[width, 50, 25, 2], maxIter=100, seed=self.seed)]
            folded = self._folded(train)
            held, whole = self._out_of_fold(folded, bases, n)
            held = prep.vectors(held.drop("features"), [f"_b{i}" for i in range(len(bases))])
            top = LogisticRegression(maxIter=1000, regParam=1.0 / max(n, 1)).fit(prep.fewer_tasks(held.select("features", "label"), n))
            return Stack(whole, top)
        if kind == "calibrated":
            forest = self._forest(self.trees, 10)
            held, whole = self._out_of_fold(self._folded(train), [forest], n)
            curve = IsotonicRegression(featuresCol="_raw", labelCol="_label", predictionCol="prediction").fit(held.select(F.col("_b0").alias("_raw"), F.col("label").cast("double").alias("_label")))
            return Calibrated(whole[0], curve)
        raise ValueError(f"unknown model {kind!r}; choose from {MODELS} or auto")

    def train(self, df: DataFrame, target: str, columns: list[str] | None = None, categorical: list[str] | None = None, kind: str = "auto") -> ChurnResult:
        """Split, then medians and scaling from the training part only, fit, and
        metrics on the test part."""
        if kind not in (*MODELS, "auto"):
            raise ValueError(f"unknown model {kind!r}; choose from {MODELS} or auto")
        categorical = categorical or []
        columns = (columns or prep.numeric_columns(df, (target,))) + [c for c in categorical if c not in (columns or [])]
        coded = prep.label_codes(df, categorical).withColumn("label", F.col(target).cast("int")).select(*columns, "label")
        coded = prep.dealt(coded)
        train, test = (x.cache() for x in self.stratified(coded))
        centre = prep.medians(train, columns)
        train = prep.impute(train, centre)
        by = prep.scaling(train, columns)
        share = {r.label: r.n for r in train.groupBy("label").agg(F.count("*").alias("n")).collect()}
        balanced = F.when(F.col("label") == 1, sum(share.values()) / (2.0 * max(share.get(1, 1), 1))).otherwise(sum(share.values()) / (2.0 * max(share.get(0, 1), 1)))
        ready = lambda x: prep.vectors(prep.scale(prep.impute(x, centre), by), columns)
        x_train = prep.vectors(prep.scale(train, by), columns).withColumn("weight", balanced).cache()
        x_test = ready(test).cache()
        best = None
        for name in (("rf", "gb", "stacking", "logistic") if kind == "auto" else (kind,)):
            model = self.fit_kind(x_train, name)
            scored = model.score(x_test).withColumn("predicted", (F.col("score") >= 0.5).cast("int")).cache()
            auc = metrics.roc_auc(scored).first()[0] or 0.0
            if best is None or auc > best[0]:
                best = (auc, name, model, scored)
        auc, name, model, scored = best
        rates = metrics.confusion(scored).first().asDict() | {"roc_auc": auc}
        return ChurnResult(model, name, columns, categorical, centre, by, scored.select("label", "score", "predicted"), rates, self.importance(model, x_test, columns, auc))

    def importance(self, model, x_test: DataFrame, columns: list[str], auc: float) -> list[tuple[str, float, float]]:
        """The model's own importances or coefficients; for stacks the loss of
        AUC when a feature is replaced by its mean (0 after scaling)."""
        inner = getattr(model, "model", None)
        if hasattr(inner, "featureImportances"):
            values = list(inner.featureImportances.toArray())
        elif hasattr(inner, "coefficients"):
            values = [abs(v) for v in inner.coefficients.toArray()]
        else:
            values = []
            for c in columns:
                neutral = prep.vectors(x_test.drop("features").withColumn(c, F.lit(0.0)), columns)
                values.append(max(0.0, auc - (metrics.roc_auc(model.score(neutral)).first()[0] or 0.0)))
        total = float(sum(values)) or 1.0
        return sorted(((c, float(v), round(float(v) / total * 100, 2)) for c, v in zip(columns, values, strict=True)), key=lambda r: (-r[1], r[0]))

    def grid_search(self, df: DataFrame, target: str, columns: list[str] | None = None, kind: str = "rf", small: bool = False, parallelism: int | None = None):
        """(best model, [(parameters, AUC)]) by cross-validation over the full grid.
        A fit answers for all points that it holds: smaller numbers of trees are its
        first trees, smaller depths of a forest its trees' first levels, and ways to
        choose features that come to the same number for a node are one fit.
        ``parallelism`` fits run at a time (where not given, as many as keep the cores
        busy and have ``ROWS_AT_ONCE`` rows between them)."""
        if kind == "rf":
            e = RandomForestClassifier(seed=self.seed)
            size, sizes = e.numTrees, [50, 100, 200]
            axes = {e.maxDepth: [5, 10, 15, 20], e.minInstancesPerNode: [1, 2, 4], e.featureSubsetStrategy: ["sqrt", "log2", "all"]}
        elif kind == "gb":
            e = GBTClassifier(seed=self.seed)
            size, sizes = e.maxIter, [50, 100, 200]
            axes = {e.maxDepth: [3, 5, 7], e.stepSize: [0.01, 0.1, 0.2], e.subsamplingRate: [0.8, 1.0]}
        else:
            raise ValueError(f"no grid for {kind!r}")
        if small:
            sizes, axes = sizes[:2], {p: values[:1] for p, values in axes.items()}
        columns = columns or prep.numeric_columns(df, (target,))
        df = prep.dealt(df)
        x = prep.vectors(prep.impute(df, prep.medians(df, columns)), columns).withColumn("label", F.col(target).cast("int"))
        x = self._folded(x).select("features", "label", "_fold")
        rows = x.count()
        # a deep forest has a table of statistics for each node, task and level
        x = prep.fewer_tasks(x, rows)
        grid = ParamGridBuilder()
        for p, values in axes.items():
            grid.addGrid(p, values)
        points = grid.build()
        depths = axes[e.maxDepth] if kind == "rf" else None

        def fit_of(point) -> dict:
            """What the fit that answers for a point has for parameters."""
            if kind != "rf":
                return point
            same = next(s for s in axes[e.featureSubsetStrategy] if features_of_node(s, len(columns)) == features_of_node(point[e.featureSubsetStrategy], len(columns)))
            return point | {e.maxDepth: max(depths), e.featureSubsetStrategy: same}

        fits = []
        for point in points:
            if fit_of(point) not in fits:
                fits.append(fit_of(point))
        names = [f"score_{n}" if depths is None else f"score_{n}_{d}" for n in sizes for d in depths or [None]]

        def judged(task):
            k, fold = task
            model = e.fit(x.where(F.col("_fold") != fold), {**fits[k], size: sizes[-1]})
            scored = prefix_scores(model, x.where(F.col("_fold") == fold), sizes, ["label"], depths).cache()
            areas = dict(zip(names, metrics.roc_auc_each(scored, names), strict=True))
            scored.unpersist()
            return areas

        tasks = [(k, fold) for k in range(len(fits)) for fold in range(self.folds)]
        if parallelism is None:
            parallelism = max(1, min(x.sparkSession.sparkContext.defaultParallelism // x.rdd.getNumPartitions(), ROWS_AT_ONCE // max(rows, 1)))
        with ThreadPool(parallelism) as pool:
            areas = pool.map(inheritable_thread_target(x.sparkSession)(judged), tasks, 1)

        def area(n, point) -> float:
            k = fits.index(fit_of(point))
            own = [a[f"score_{n}" if depths is None else f"score_{n}_{point[e.maxDepth]}"] or 0.0 for a in areas[k * self.folds : (k + 1) * self.folds]]
            return float(np.mean(own))

        table = [({size.name: n} | {p.name: v for p, v in m.items()}, area(n, m)) for n in sizes for m in points]
        j, i = divmod(int(np.argmax([a for _, a in table])), len(points))
        best = e.fit(x, {**points[i], size: sizes[j]})
        return best, table

    def compare(self, df: DataFrame, target: str, columns: list[str] | None = None) -> DataFrame:
        """(model, metric, value) of every kind on the same split."""
        rows = []
        for kind in ("rf", "gb", "stacking", "logistic"):
            r = self.train(df, target, columns, kind=kind)
            rows += [(kind, m, float(r.metrics[m])) for m in ("accuracy", "precision", "recall", "f1", "roc_auc")]
        return df.sparkSession.createDataFrame(rows, "model string, metric string, value double")


def predict_churn(df: DataFrame, target: str, columns: list[str] | None = None) -> ChurnResult:
    return ChurnPredictor().train(df, target, columns)
