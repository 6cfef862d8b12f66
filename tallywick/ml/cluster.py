"""Clustering of customers with Spark ML and SQL."""

from __future__ import annotations

from dataclasses import dataclass, field
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml.clustering import GaussianMixture, KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import Folder, in_folder, materialised
from . import features as prep
from . import metrics
from .neighbours import density_clusters, squares

#: Rows, or small clusters of rows, that are merged pairwise.
WARD_MOST = 3_000
#: Starts of k-means that run side by side.
STARTS_AT_ONCE = 3
ROW = "_row"


@dataclass(frozen=True)
class ClusteringResult:
    labelled: DataFrame  # the input with ``cluster``
    algorithm: str
    features: list[str]
    n_clusters: int
    centroids: list[list[float]] | None
    metrics: dict
    scaling: dict = field(default_factory=dict)

    @property
    def summary(self) -> DataFrame:
        return metrics.cluster_summary(self.labelled, self.features)

    def profile(self, cluster_id: int) -> DataFrame:
        """Empty where there is no such cluster."""
        return metrics.cluster_profile(self.labelled, self.features, cluster_id)


@dataclass(frozen=True)
class ClusteringEngine:
    k_range: tuple[int, int] = (2, 10)
    scaling: str = "standard"
    seed: int = 42
    n_init: int = 10
    silhouette_rows: int | None = None

    # preparation -----------------------------------------------------------
    def prepared(self, df: DataFrame, columns: list[str] | None) -> tuple[DataFrame, list[str], dict]:
        """The rows with imputed columns, a scaled vector ``features`` and a row number."""
        columns = columns or prep.numeric_columns(df)
        full = prep.impute(df, prep.medians(df, columns))
        by = prep.scaling(full, columns, self.scaling)
        scaled = {f"_s_{c}": (F.col(c) - F.lit(m)) / F.lit(w) for c, (m, w) in by.items()}
        out = prep.vectors(full.withColumns(scaled), list(scaled)).drop(*scaled).withColumn(ROW, F.monotonically_increasing_id())
        return materialised(out), columns, by

    # algorithms ------------------------------------------------------------
    def kmeans(self, x: DataFrame, k: int) -> tuple[DataFrame, list[list[float]], float]:
        """The best of ``n_init`` starts by training cost."""
        best = None
        x = x.cache()  # else each start reads and decodes the rows anew

        def fitted(s):
            return KMeans(k=k, seed=self.seed + s, maxIter=300, featuresCol="features", predictionCol="cluster").fit(x)

        # a start's passes are short and come one after another
        with ThreadPool(STARTS_AT_ONCE) as pool:
            models = pool.map(inheritable_thread_target(x.sparkSession)(fitted), range(self.n_init), 1)
        for model in models:
            if best is None or model.summary.trainingCost < best.summary.trainingCost:
                best = model
        return best.transform(x), [c.tolist() for c in best.clusterCenters()], best.summary.trainingCost

    def mixture(self, x: DataFrame, k: int) -> tuple[DataFrame, list[list[float]]]:
        """The likeliest of ``n_init`` starts."""
        best = None
        for s in range(self.n_init):
            model = GaussianMixture(k=k, seed=self.seed + s, featuresCol="features", predictionCol="cluster", probabilityCol="_p").fit(x)
            if best is None or model.summary.logLikelihood > best.summary.logLikelihood:
                best = model
        return best.transform(x).drop("_p"), [g.mean.toArray().tolist() for g in best.gaussians]

    def ward(self, x: DataFrame, k: int) -> DataFrame:
        """Agglomerative clusters.  Up to ``WARD_MOST`` rows each is merged by
        itself; more are first gathered in as many small clusters (count, sum,
        square sum), which Ward's distance then merges.  See :func:`gathered`."""
        if x.count() <= WARD_MOST:
            ids, points = self._bounded(x)
            labels = cut_tree(ward_merges(points), len(points), k)
            found = x.sparkSession.createDataFrame(pd.DataFrame({ROW: ids, "cluster": labels}), f"{ROW} long, cluster int")
            return x.join(found, ROW)
        pivots, small = gathered(x, WARD_MOST, self.seed)
        labels = cut_tree(ward_merges(small.mean, small.n), len(small.n), k)
        return assigned(x, pivots[small.pivot], np.array(labels, np.int32))

    def ward_loss(self, x: DataFrame) -> float:
        """The share of all square deviation that lies inside the small clusters:
        what :meth:`ward` can't see; 0 up to ``WARD_MOST`` rows."""
        if x.count() <= WARD_MOST:
            return 0.0
        _, small = gathered(x, WARD_MOST, self.seed)
        mean = small.n @ small.mean / small.n.sum()
        total = small.within.sum() + small.n @ ((small.mean - mean) ** 2).sum(1)
        return float(small.within.sum() / total) if total else 0.0

    def _bounded(self, x: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        n = x.count()
        if n > WARD_MOST:
            raise ValueError(f"{n} rows: agglomerative clustering takes at most {WARD_MOST}; sample first")
        rows = x.select(ROW, vector_to_array("features").alias("v")).orderBy(ROW).collect()
        return np.array([r[0] for r in rows], np.int64), np.array([r.v for r in rows])

    def dbscan(self, x: DataFrame, eps: float, min_samples: int) -> DataFrame:
        """Density clusters (-1: noise), numbered by their first row."""
        v = x.select(F.col(ROW).alias("id"), vector_to_array("features").alias("v"))
        with in_folder(x.sparkSession) as folder:
            found = folder.write(density_clusters(v, folder, eps, min_samples, "id", "v"))
            numbered = found.join(numbers(found.select("label").distinct(), folder), "label").select(F.col("id").alias(ROW), F.col("number").alias("_c"))
            return materialised(x.join(numbered, ROW, "left").withColumn("cluster", F.coalesce(F.col("_c").cast("int"), F.lit(-1))).drop("_c"))

    def auto_eps(self, x: DataFrame, k: int = 5) -> float:
        v = x.select(F.col(ROW).alias("id"), vector_to_array("features").alias("v"))
        return metrics.knn_distance_percentile(v, min(k, x.count()), row_id="id", vector="v").first()[0]

    # selection -------------------------------------------------------------
    def scores(self, labelled: DataFrame) -> dict:
        """Indices over the rows that aren't noise; 0, 0, inf for fewer than two
        clusters.  The silhouette is the Euclidean one, of all rows or estimated
        from ``silhouette_rows``; ``silhouette_error`` is its standard error."""
        n = labelled.count()
        rows = labelled.where("cluster <> -1")
        kept = rows.select(F.col(ROW).alias("id"), "cluster", vector_to_array("features").alias("v"))
        k, m = kept.agg(F.countDistinct("cluster"), F.count("*")).first()
        out = {"n_clusters": k, "noise_ratio": 1 - m / n if n else 0.0, "silhouette": 0.0, "calinski_harabasz": 0.0, "davies_bouldin": float("inf"), "silhouette_error": 0.0}
        if k < 2:
            return out
        by = {"row_id": "id", "vector": "v", "cluster": "cluster"}
        value, _, error = metrics.silhouette(kept, **by, rows=self.silhouette_rows).first()
        return out | {
            "silhouette": value,
            "silhouette_error": error,
            "calinski_harabasz": metrics.calinski_harabasz(kept, **by).first()[0],
            "davies_bouldin": metrics.davies_bouldin(kept, **by).first()[0],
        }

    def run(self, x: DataFrame, algorithm: str, k: int, eps: float = 0.5, min_samples: int = 5) -> tuple[DataFrame, list | None]:
        if algorithm == "kmeans":
            return self.kmeans(x, k)[:2]
        if algorithm == "gmm":
            return self.mixture(x, k)
        if algorithm == "hierarchical":
            return self.ward(x, k), None
        if algorithm == "dbscan":
            return self.dbscan(x, eps, min_samples), None
        raise ValueError(f"unknown algorithm {algorithm!r}")

    def best_k(self, x: DataFrame, algorithm: str) -> int:
        """The first k of the best silhouette."""
        top = min(self.k_range[1], x.count() - 2)
        if top < 2:
            return 2
        found = [(self.scores(self.run(x, algorithm, k)[0])["silhouette"], -k) for k in range(max(2, self.k_range[0]), top + 1)]
        return -max(found)[1] if found else 4

    def fit(self, df: DataFrame, columns: list[str] | None = None, algorithm: str = "auto", n_clusters: int | None = None, eps: float = 0.5, min_samples: int = 5) -> ClusteringResult:
        x, columns, by = self.prepared(df, columns)
        if algorithm == "auto":
            best = None
            for name in ("kmeans", "hierarchical", "gmm", "dbscan"):
                if name == "dbscan":
                    out, centres = self.dbscan(x, self.auto_eps(x, min_samples), min_samples), None
                else:
                    out, centres = self.run(x, name, n_clusters or self.best_k(x, name))
                got = self.scores(out)
                if best is None or got["silhouette"] > best[3]["silhouette"]:
                    best = (name, out, centres, got)
            algorithm, out, centres, got = best
        else:
            k = n_clusters or (0 if algorithm == "dbscan" else self.best_k(x, algorithm))
            out, centres = self.run(x, algorithm, k, eps, min_samples)
            got = self.scores(out)
        return ClusteringResult(out.drop("features", ROW), algorithm, columns, got["n_clusters"], centres, got, by)

    # chart data ------------------------------------------------------------
    def elbow_data(self, df: DataFrame, columns: list[str] | None = None, k_most: int = 10) -> DataFrame:
        """(k, inertia, silhouette, elbow) with the elbow at the largest second difference."""
        x, _, _ = self.prepared(df, columns)
        rows = []
        for k in range(1, k_most + 1):
            if k == 1:
                v = vector_to_array("features")
                mean = x.select(F.posexplode(v).alias("d", "v")).groupBy("d").agg((F.var_pop("v") * F.count("*")).alias("s")).agg(F.sum("s")).first()[0]
                rows.append((1, float(mean), None))
            else:
                out, _, cost = self.kmeans(x, k)
                rows.append((k, float(cost), self.scores(out)["silhouette"]))
        second = np.diff([r[1] for r in rows], 2)
        elbow = int(np.argmax(second)) + 2 if len(second) else 1
        return x.sparkSession.createDataFrame([(*r, r[0] == elbow) for r in rows], "k int, inertia double, silhouette double, elbow boolean")

    def projection(self, df: DataFrame, columns: list[str] | None = None, dimensions: int = 2) -> DataFrame:
        """The rows with their first principal components, pc1.. (signs are arbitrary)."""
        x, _, _ = self.prepared(df, columns)
        centred = PCA(k=dimensions, inputCol="features", outputCol="_pc").fit(x).transform(x)
        pc = vector_to_array("_pc")
        return centred.select(*df.columns, *[pc[k].alias(f"pc{k + 1}") for k in range(dimensions)])

    def dendrogram(self, df: DataFrame, columns: list[str] | None = None, sample: int = 100) -> DataFrame:
        """(step, a, b, height, size) merges of a seeded sample; a and b from n on are earlier merges."""
        x, _, _ = self.prepared(df, columns)
        _, points = self._bounded(x.orderBy(F.xxhash64(ROW, F.lit(self.seed))).limit(sample))
        return df.sparkSession.createDataFrame([(k, *m) for k, m in enumerate(ward_merges(points))], "step int, a int, b int, height double, size int")


@dataclass(frozen=True)
class SmallClusters:
    """In order of their first rows: pivot, rows, mean, square deviation inside."""

    pivot: np.ndarray
    n: np.ndarray
    mean: np.ndarray
    within: np.ndarray


def _vectors(x: DataFrame) -> DataFrame:
    return x.select(F.col(ROW).alias("id"), vector_to_array("features").alias("v"))


def _points(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1)


def _closest(points: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found = [squares(points[i : i + 1024], pivots) for i in range(0, len(points), 1024)]
    return np.concatenate([d.argmin(1) for d in found]), np.concatenate([d.min(1) for d in found])


def gathered(x: DataFrame, most: int, seed: int, rounds: int = 3) -> tuple[np.ndarray, SmallClusters]:
    """Up to ``most`` pivots and the small clusters of the rows closest to each.
    A third of the pivots are drawn by hash; in each further round rows are drawn
    with chances in proportion to their square distance from the pivots so far, so
    that what lies apart gets pivots of its own.  The driver gets these and one
    count, sum and square sum of each."""
    rows, share = _vectors(x), most // rounds
    uniform = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 52)) / F.lit(float(1 << 52))
    first = rows.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(share).toArrow().to_batches()
    pivots = np.concatenate([_points(b) for b in first])
    for _ in range(rounds - 1):
        sent = x.sparkSession.sparkContext.broadcast(pivots)

        def apart(batches, sent=sent):
            for batch in batches:
                if len(batch):
                    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(_closest(_points(batch), sent.value)[1])], ["id", "v", "d"])

        far = rows.mapInArrow(apart, "id long, v array<double>, d double")
        cost = far.agg(F.sum("d")).first()[0]
        if not cost:
            break
        # a draw's expected number is ``share``; its least keys are the same on every run
        drawn = far.where(uniform * F.lit(cost) < F.col("d") * share).orderBy(F.xxhash64("id"), "id").limit(share).select("id", "v").toArrow().to_batches()
        pivots = np.concatenate([pivots, *[_points(b) for b in drawn]])
    pivots = np.unique(pivots, axis=0)
    sent = x.sparkSession.sparkContext.broadcast(pivots)

    def sums(batches):
        for batch in batches:
            if not len(batch):
                continue
            points = _points(batch)
            at, d = _closest(points, sent.value)
            order = np.argsort(at, kind="stable")
            cut = np.flatnonzero(np.concatenate([[True], np.diff(at[order]) > 0]))
            near = points[order] - sent.value[at[order]]  # about the pivot: small numbers
            yield pa.RecordBatch.from_pydict({
                "pivot": at[order][cut], "first": np.minimum.reduceat(np.asarray(batch.column(0))[order], cut), "n": np.diff(np.append(cut, len(at))),
                "s": pa.array([r.tolist() for r in np.add.reduceat(near, cut, axis=0)], pa.list_(pa.float64())), "q": np.add.reduceat((near**2).sum(1), cut),
            })

    parts = rows.mapInArrow(sums, "pivot long, first long, n long, s array<double>, q double")
    dims = pivots.shape[1]
    one = parts.groupBy("pivot").agg(F.min("first").alias("first"), F.sum("n").alias("n"), F.sum("q").alias("q"), *[F.sum(F.element_at("s", k + 1)).alias(f"s{k}") for k in range(dims)]).toPandas().sort_values("first")
    n, s = one["n"].to_numpy(float), one[[f"s{k}" for k in range(dims)]].to_numpy()
    pivot = one["pivot"].to_numpy()
    return pivots, SmallClusters(pivot, n, pivots[pivot] + s / n[:, None], np.maximum(one["q"].to_numpy() - (s**2).sum(1) / n, 0.0))


def assigned(x: DataFrame, pivots: np.ndarray, labels: np.ndarray) -> DataFrame:
    """Adds the label of each row's closest pivot."""
    sent = x.sparkSession.sparkContext.broadcast((pivots, labels))

    def run(batches):
        for batch in batches:
            if len(batch):
                at = _closest(_points(batch), sent.value[0])[0]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sent.value[1][at])], [ROW, "cluster"])

    return x.join(_vectors(x).mapInArrow(run, f"{ROW} long, cluster int"), ROW)


def numbers(labels: DataFrame, folder: Folder) -> DataFrame:
    """(label, number from 0 in order of label): ranges of labels, each with the
    count of those before it."""
    width = int(labels.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    placed = folder.write(labels.repartitionByRange(width, "label").sortWithinPartitions("label").withColumn("_at", F.monotonically_increasing_id()))
    part, at = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    before, seen = [], 0
    for p, n in sorted(placed.groupBy(part.alias("p")).count().collect()):  # one row a range
        before.append((p, seen))
        seen += n
    start = F.element_at(F.create_map(*[F.lit(z).cast("long") for pair in before for z in pair]), part.cast("long")) if before else F.lit(0)
    return placed.select("label", (start + at).alias("number"))


def ward_merges(points: np.ndarray, sizes: np.ndarray | None = None) -> list[tuple[int, int, float, int]]:
    """Merges of Ward's linkage by the Lance-Williams update; ``sizes``: how many
    rows each point stands for."""
    n = len(points)
    if n < 2:
        return []
    size = np.ones(n) if sizes is None else np.array(sizes, float)
    d = np.stack([((points - p) ** 2).sum(1) for p in points])
    d *= 2 * size[:, None] * size[None] / (size[:, None] + size[None])
    np.fill_diagonal(d, np.inf)
    name, alive, out = np.arange(n), np.ones(n, bool), []
    for step in range(n - 1):
        i, j = divmod(int(np.argmin(d)), n)
        i, j = min(i, j), max(i, j)
        height, a, b = d[i, j], int(name[i]), int(name[j])
        total = size[i] + size[j] + size
        new = ((size[i] + size) * d[i] + (size[j] + size) * d[j] - size * height) / total
        alive[j] = False
        new[~alive] = np.inf
        new[i] = np.inf
        d[i], d[:, i], d[j], d[:, j] = new, new, np.inf, np.inf
        size[i] += size[j]
        name[i] = n + step
        out.append((min(a, b), max(a, b), float(np.sqrt(max(height, 0.0))), int(size[i])))
    return out


def cut_tree(merges: list[tuple[int, int, float, int]], n: int, k: int) -> list[int]:
    """Labels 0..k-1, in order of first row, after all but the last k - 1 merges."""
    members = {i: [i] for i in range(n)}
    for step, (a, b, *_) in enumerate(merges[: max(0, n - k)]):
        members[n + step] = members.pop(a) + members.pop(b)
    labels = [0] * n
    for label, own in enumerate(sorted(members.values(), key=min)):
        for i in own:
            labels[i] = label
    return labels


def cluster_customers(df: DataFrame, columns: list[str] | None = None, algorithm: str = "auto") -> ClusteringResult:
    return ClusteringEngine().fit(df, columns, algorithm)
