"""Explanations of a scoring model, in long form (row_id, feature, value, shap_value)."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import GBTClassificationModel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import materialised
from ..plans.places import ranked, rotated
from . import features as prep
from .nested import saved_trees

Scorer = Callable[[DataFrame], DataFrame]  # adds ``score`` to rows with the feature columns


@dataclass(frozen=True)
class Explanation:
    values: DataFrame  # row_id, feature, value, shap_value
    base_value: float
    features: list[str]
    link: str = "identity"  # "logit": contributions add up to log odds

    @property
    def importance(self) -> DataFrame:
        """Per feature: mean absolute, mean and population deviation, largest first."""
        v = F.col("shap_value")
        return self.values.groupBy("feature").agg(F.avg(F.abs(v)).alias("importance"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std")).orderBy(F.desc("importance"), "feature")

    @property
    def summary(self) -> dict:
        n, variance = self.values.agg(F.countDistinct("row_id"), F.var_pop("shap_value")).first()
        return {"n_samples": n, "base_value": self.base_value, "variance": variance, "top": [r.feature for r in self.importance.limit(5).collect()]}

    def instance(self, row_id: int) -> DataFrame:
        """feature, value, shap_value, direction of one row, largest effect first,
        beside the row's class and the model's confidence in it."""
        one = self.values.where(F.col("row_id") == row_id)
        total = F.lit(self.base_value) + F.sum("shap_value").over(Window.partitionBy("row_id"))
        p = 1 / (1 + F.exp(-total)) if self.link == "logit" else total
        judged = one.withColumn("probability", p).withColumn("predicted", (F.col("probability") >= 0.5).cast("int")).withColumn("confidence", F.greatest("probability", 1 - F.col("probability")))
        return judged.select("feature", "value", "shap_value", F.when(F.col("shap_value") > 0, "positive").otherwise("negative").alias("direction"), "predicted", "confidence").orderBy(F.desc(F.abs("shap_value")), "feature")

    def waterfall(self, row_id: int, most: int = 15) -> DataFrame:
        """step, feature, shap_value, before, after of the largest contributions."""
        down = Window.orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
        top = self.instance(row_id).limit(most).withColumn("step", F.row_number().over(Window.orderBy(F.desc(F.abs("shap_value")), "feature")))
        after = F.lit(self.base_value) + F.sum("shap_value").over(down)
        return top.select("step", "feature", "shap_value", (after - F.col("shap_value")).alias("before"), after.alias("after"))

    def beeswarm(self) -> DataFrame:
        """values with their rank within the feature and the value scaled to 0..1."""
        spans = self.values.groupBy("feature").agg(F.min("value").alias("_low"), F.max("value").alias("_high"))
        placed = ranked(self.values, "feature", ["shap_value", "row_id"])
        scaled = F.try_divide(F.col("value") - F.col("_low"), F.col("_high") - F.col("_low"))
        return placed.join(F.broadcast(spans), "feature").select(*placed.columns, F.coalesce(scaled, F.lit(0.5)).alias("scaled"))

    def dependence(self, feature: str) -> tuple[DataFrame, str | None]:
        """(value, shap_value) of one feature and the other feature whose values
        correlate most with its contributions."""
        own = self.values.where(F.col("feature") == feature)
        other = self.values.where(F.col("feature") != feature).select("row_id", F.col("feature").alias("other"), F.col("value").alias("x"))
        best = own.select("row_id", "shap_value").join(other, "row_id").groupBy("other").agg(F.abs(F.corr("x", "shap_value")).alias("c")).where(F.col("c").isNotNull() & ~F.isnan("c")).orderBy(F.desc("c"), "other").first()
        return own.select("row_id", "value", "shap_value"), best.other if best else None

    def wide(self, rows: DataFrame, row_id: str = "row_id") -> DataFrame:
        """The explained rows with a column <feature>_shap for each feature."""
        per = self.values.groupBy("row_id").pivot("feature", self.features).agg(F.first("shap_value"))
        return rows.join(per.select(F.col("row_id").alias(row_id), *[F.col(f"`{f}`").alias(f"{f}_shap") for f in self.features]), row_id)

    def dashboard(self) -> dict:
        """Bounded extract: ten importances, a hundred values."""
        return {"importance": [r.asDict() for r in self.importance.limit(10).collect()], "values": [r.asDict() for r in self.values.orderBy("row_id", "feature").limit(100).collect()], "summary": self.summary}


def sampled(df: DataFrame, features: list[str], most: int | None, seed: int) -> DataFrame:
    """At most ``most`` rows of least hash, numbered 0.. (bounded, so one ordered
    window will do); without ``most`` all rows, with any numbers of their own."""
    if most is None:
        return materialised(df.withColumn("row_id", F.monotonically_increasing_id()))
    hashed = df.withColumn("_h", F.xxhash64(*features, F.lit(seed))).orderBy("_h", *features).limit(most)
    return materialised(hashed.withColumn("row_id", (F.row_number().over(Window.orderBy("_h", *features)) - 1).cast("long")).drop("_h"))


def _long(rows: DataFrame, features: list[str], effects: dict) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value"), effects[f].cast("double").alias("shap_value")) for f in features])
    return rows.select("row_id", F.explode(cells).alias("c")).select("row_id", "c.*")


def explain_linear(df: DataFrame, coefficients: dict[str, float], intercept: float = 0.0, most: int | None = 1000, seed: int = 42, link: str = "identity") -> Explanation:
    """Exact values of a linear model: coefficient times distance from the mean."""
    features = list(coefficients)
    means = df.agg(*[F.avg(f).alias(f) for f in features]).first()
    rows = sampled(df, features, most, seed)
    base = intercept + sum(coefficients[f] * means[f] for f in features)
    return Explanation(_long(rows, features, {f: F.lit(coefficients[f]) * (F.col(f) - F.lit(means[f])) for f in features}), float(base), features, link)


def explain_permutation(df: DataFrame, score: Scorer, features: list[str], most: int | None = 1000, seed: int = 42) -> Explanation:
    """Change of the score when a feature's value is exchanged with that of
    another row (a seeded rotation of a hash order); without ``most`` of all rows.
    Rows as they are and with each exchange are scored in one pass, so the scorer
    has to keep columns that it doesn't know.  No rows: no values, base 0."""
    rows = sampled(df, features, most, seed)
    given = rotated(rows, "row_id", features, [seed + k for k in range(len(features))], rows.count())
    kinds = dict(rows.dtypes)
    swapped = [F.when(F.col("k") == k, F.col("given").cast(kinds[f])).otherwise(F.col(f"`{f}`")).alias(f) for k, f in enumerate(features)]
    others = [c for c in rows.columns if c not in features]
    variants = rows.withColumn("k", F.lit(-1)).unionByName(rows.join(given, "row_id").select(*[F.col(f"`{c}`") for c in others], *swapped, "k"))
    scored = score(variants.withColumnRenamed("k", "_variant")).select("row_id", "_variant", *[F.col(f"`{f}`") for f in features], "score")
    own = F.col("_variant") == -1
    out = materialised(
        scored.groupBy("row_id").agg(
            *[F.first(F.when(own, F.col(f"`{f}`")), ignorenulls=True).alias(f) for f in features],
            F.max(F.when(own, F.col("score"))).alias("_base"),
            *[F.max(F.when(F.col("_variant") == k, F.col("score"))).alias(f"_after_{k}") for k in range(len(features))],
        )
    )
    base = out.agg(F.avg("_base")).first()[0]
    effects = {f: F.col("_base") - F.col(f"_after_{k}") for k, f in enumerate(features)}
    return Explanation(_long(out, features, effects), float(base or 0.0), features)


@dataclass(frozen=True)
class Leaf:
    """A leaf's value and, for each feature on its path, the bounds that lead to
    it and the share of training rows that take its branches."""

    value: float
    bounds: dict[int, tuple[float, float, float]]  # feature: above, up to, share


def leaves_of(model) -> list[Leaf]:
    """The leaves of a forest or of boosted trees, from the table of nodes that
    the model saves; values are what they add to the score (forest: probability)
    or to its log odds (boosted)."""
    boosted = isinstance(model, GBTClassificationModel)
    weights = list(model.treeWeights)
    out: list[Leaf] = []

    def walk(nodes: dict, i: int, bounds: dict, weight: float) -> None:
        node = nodes[i]
        if node.leftChild < 0:
            stats = node.impurityStats
            value = 2 * weight * node.prediction if boosted else weight / sum(weights) * stats[1] / max(sum(stats), 1e-300)
            out.append(Leaf(float(value), bounds))
            return
        f, at = node.split.featureIndex, node.split.leftCategoriesOrThreshold[0]
        covers = [sum(nodes[c].impurityStats[:2]) if not boosted else nodes[c].impurityStats[0] for c in (node.leftChild, node.rightChild)]
        for child, cover, low, high in ((node.leftChild, covers[0], -float("inf"), at), (node.rightChild, covers[1], at, float("inf"))):
            a, b, share = bounds.get(f, (-float("inf"), float("inf"), 1.0))
            walk(nodes, child, bounds | {f: (max(a, low), min(b, high), share * cover / max(sum(covers), 1e-300))}, weight)

    for k, nodes in enumerate(saved_trees(model)):
        walk(nodes, 0, {}, weights[k])
    return out


def pattern_effects(leaf: Leaf, kept: np.ndarray) -> np.ndarray:
    """(rows, features on the path) Shapley values of a leaf for rows that keep
    the bounds marked in ``kept`` (features on the path, rows).

    Of a leaf with d features on its path, feature i gets value * (o_i - z_i)
    times the sum over sets S of the others of |S|! (d - |S| - 1)! / d! times o_j
    inside and z_j outside S (o: the row keeps the bounds, z: share); the sums by
    |S| are the coefficients of the product of (z_j + o_j t)."""
    shares = [share for *_, share in leaf.bounds.values()]
    d, n = kept.shape
    parts = np.array([math.factorial(k) * math.factorial(d - k - 1) / math.factorial(d) for k in range(d)])
    out = np.zeros((n, d))
    for i in range(d):
        sums = np.zeros((d, n))
        sums[0] = 1.0
        for j in range(d):
            if j != i:
                sums[1:] = sums[1:] * shares[j] + sums[:-1] * kept[j]
                sums[0] *= shares[j]
        out[:, i] = leaf.value * (kept[i] - shares[i]) * (parts @ sums)
    return out


#: Features on a path up to which a leaf's values are tabled for all patterns of kept bounds.
TABLED = 10


def leaf_effects(leaves: list[Leaf], x: np.ndarray) -> np.ndarray:
    """(rows, features) Shapley values of the sum of the leaves, where a feature
    that isn't known takes a branch with its share of training rows.  A leaf's
    values depend on which of its bounds a row keeps alone, so they are worked
    out once for each such pattern and looked up for the rows."""
    columns = np.ascontiguousarray(x.T)
    out = np.zeros_like(columns)
    for leaf in leaves:
        d = len(leaf.bounds)
        kept = [(columns[f] > a) & (columns[f] <= b) for f, (a, b, _) in leaf.bounds.items()]
        if d > TABLED or 1 << d > len(x):
            values, pattern = pattern_effects(leaf, np.array(kept, float).reshape(d, len(x))).T, slice(None)
        else:
            values = pattern_effects(leaf, (np.arange(1 << d) >> np.arange(d)[:, None] & 1).astype(float)).T
            pattern = np.zeros(len(x), np.int16)
            for k, o in enumerate(kept):
                pattern += o.astype(np.int16) << k
        for f, v in zip(leaf.bounds, values, strict=True):
            out[f] += v[pattern]
    return out.T


def explain_trees(model, df: DataFrame, features: list[str], most: int | None = 1000, seed: int = 42) -> Explanation:
    """Exact values of a trained forest (of the probability) or of boosted trees
    (of the log odds); the tables of leaves go to the tasks."""
    inner = model.model.model
    leaves = leaves_of(inner)
    base = sum(leaf.value * math.prod(share for *_, share in leaf.bounds.values()) for leaf in leaves)
    rows = sampled(df, features, most, seed)
    seen = prep.scale(prep.impute(prep.label_codes(rows, model.categorical), model.medians), model.scaling)
    # the values as given, and as the trees see them
    both = seen.select("row_id", *[F.col(f).cast("double").alias(f"_t_{f}") for f in model.features]).join(rows.select("row_id", *[F.col(f).cast("double").alias(f) for f in features]), "row_id")
    shared = df.sparkSession.sparkContext.broadcast(leaves)  # the model's own size

    def run(batches):
        for pdf in batches:
            effects = leaf_effects(shared.value, pdf[[f"_t_{f}" for f in model_features]].to_numpy(float))
            yield pdf[["row_id", *features]].assign(**{f"_e_{f}": effects[:, model_features.index(f)] for f in features})

    model_features = list(model.features)
    schema = ", ".join(["row_id long", *[f"`{f}` double" for f in features], *[f"`_e_{f}` double" for f in features]])
    return Explanation(_long(both.mapInPandas(run, schema), features, {f: F.col(f"`_e_{f}`") for f in features}), float(base), features, "logit" if isinstance(inner, GBTClassificationModel) else "identity")


def explain_model(model, df: DataFrame, features: list[str], most: int | None = 1000, seed: int = 42) -> Explanation:
    """Linear models and trees exactly, anything else with ``predict`` by permutation."""
    inner = getattr(getattr(model, "model", None), "model", None)
    if hasattr(inner, "coefficients"):
        scale = {f: model.scaling[f] for f in features}
        raw = {f: float(c) / scale[f][1] for f, c in zip(features, inner.coefficients.toArray(), strict=True)}
        shift = float(inner.intercept) - sum(raw[f] * scale[f][0] for f in features)
        return explain_linear(df, raw, shift, most, seed, "logit")
    if hasattr(inner, "trees"):
        return explain_trees(model, df, features, most, seed)
    return explain_permutation(df, model.predict, features, most, seed)
