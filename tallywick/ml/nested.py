"""Scores of the first trees of a model and of their first levels: one fit answers for
every smaller number and depth."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.lineage import in_folder


def saved_trees(model, spark: SparkSession | None = None) -> list[dict]:
    """Per tree its nodes by number (from the root, left branches first), from the
    table that the model saves; that has the model's size."""
    spark = spark or SparkSession.getActiveSession()
    trees: dict[int, dict] = {}
    with in_folder(spark) as folder:
        model.write().save(f"{folder.path}/model")
        for r in spark.read.parquet(f"{folder.path}/model/data").collect():  # the model's nodes
            trees.setdefault(r.treeID, {})[r.nodeData.id] = r.nodeData
    return [nodes for _, nodes in sorted(trees.items())]


def leaf_values(model, spark: SparkSession | None = None, depths: list[int] | None = None) -> np.ndarray:
    """(depths, trees, most leaves): what each leaf adds, leaves from left to right, if
    the trees end at a depth.  A forest's tree is grown level by level, so one that ends
    earlier is the beginning of a deeper one; like Spark's, it has one leaf where two of
    the same class would be.  Without ``depths`` the trees are as they are.

    Tasks take a tree each; the driver gets the numbers of the leaves."""
    spark = spark or SparkSession.getActiveSession()
    boosted = isinstance(model, GBTClassificationModel)
    depths = [None] if depths is None else depths

    def ends(table: pa.Table) -> pa.Table:
        nodes = table.sort_by("id").combine_chunks()
        left, right = (nodes.column(c).to_numpy() for c in ("leftChild", "rightChild"))
        classes = nodes.column("prediction").to_numpy()
        if boosted:
            value = classes
        else:
            stats = np.stack(nodes.column("impurityStats").to_numpy())
            value, classes = stats[:, 1] / np.maximum(stats.sum(axis=1), 1e-300), stats.argmax(axis=1)
        levels = [np.zeros(1, np.int64)]
        while len(inner := levels[-1][left[levels[-1]] >= 0]):
            levels.append(np.concatenate([left[inner], right[inner]]))
        leaf = np.flatnonzero(left < 0)
        out = []
        for depth in depths:
            end, own = left < 0, value.copy()
            if depth is not None:
                if depth < len(levels):
                    end[levels[depth]] = True
                for level in reversed(levels[:depth]):
                    inner = level[~end[level]]
                    a, b = left[inner], right[inner]
                    end[inner[end[a] & end[b] & (classes[a] == classes[b])]] = True
            for level in levels:
                inner = level[left[level] >= 0]
                for child in (left[inner], right[inner]):
                    own[child] = np.where(end[inner], own[inner], own[child])
                    end[child] |= end[inner]
            out.append(own[leaf])
        return pa.table({"tree": nodes.column("treeID").slice(0, 1), "data": [np.stack(out).tobytes()]})

    with in_folder(spark) as folder:
        model.write().save(f"{folder.path}/model")
        nodes = spark.read.parquet(f"{folder.path}/model/data").select("treeID", *[f"nodeData.{c}" for c in ("id", "leftChild", "rightChild", "prediction", "impurityStats")])
        found = sorted(nodes.groupBy("treeID").applyInArrow(ends, "tree int, data binary").collect())
    per = [np.frombuffer(bytes(r.data)).reshape(len(depths), -1) for r in found]
    out = np.zeros((len(depths), len(per), max(x.shape[1] for x in per)))
    for k, (x, weight) in enumerate(zip(per, model.treeWeights, strict=True)):
        out[:, k, : x.shape[1]] = 2 * weight * x if boosted else x
    return out


def prefix_scores(model, x: DataFrame, sizes: list[int], keep: list[str], depths: list[int] | None = None) -> DataFrame:
    """``keep`` and score_<n>: the score that the first n trees of a forest (their
    mean) or of boosted trees (n rounds) give each row; with ``depths`` score_<n>_<d>,
    a forest's trees ending at depth d.  A boosted model's first n trees are the model
    of n rounds; a forest's are a forest of n trees, with draws of its own."""
    boosted = isinstance(model, GBTClassificationModel)
    if boosted and depths:
        raise ValueError("a boosted tree is fitted to what the trees before it, as deep as they are, leave over")
    values = x.sparkSession.sparkContext.broadcast(leaf_values(model, x.sparkSession, depths))  # the model's size
    leaves = model.transform(x, {model.leafCol: "_leaves"}).select(*keep, vector_to_array("_leaves").alias("_leaves"))
    kept = leaves.select(*keep)
    names = {(n, k): f"score_{n}" if depths is None else f"score_{n}_{depths[k]}" for n in sizes for k in range(1 if depths is None else len(depths))}

    def run(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            at, some = np.stack(pdf["_leaves"].to_numpy()).astype(np.int64), {}
            for k, table in enumerate(values.value):
                sums = np.cumsum(table[np.arange(len(table)), at], axis=1)
                for n in sizes:
                    s = sums[:, min(n, len(table)) - 1]
                    some[names[n, k]] = 1 / (1 + np.exp(-s)) if boosted else s / min(n, len(table))
            yield pdf[keep].assign(**{c: some[c] for c in names.values()})

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields], *[f"{c} double" for c in names.values()]])
    return leaves.mapInPandas(run, schema)
