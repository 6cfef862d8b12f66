"""Classification and clustering metrics as aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import Folder, in_folder, materialised
from ..plans.selection import percentiles
from .neighbours import nearest, silhouette_sums


def confusion(scored: DataFrame, label: str = "label", predicted: str = "predicted") -> DataFrame:
    """One row: counts and rates of a binary prediction."""
    y, p = F.col(label) == 1, F.col(predicted) == 1
    n = scored.agg(F.count_if(~y & ~p).alias("tn"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"), F.count_if(y & p).alias("tp"))
    rate = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    precision, recall = rate(tp, tp + fp), rate(tp, tp + fn)
    return n.select(
        "tn", "fp", "fn", "tp", rate(tp + tn, tn + fp + fn + tp).alias("accuracy"), precision.alias("precision"), recall.alias("recall"),
        rate(tp * 2, tp * 2 + fp + fn).alias("f1"), rate(fp, fp + tn).alias("fpr"), rate(fn, fn + tp).alias("fnr"),
    )


def score_counts(scored: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """(score, pos, neg, tp, fp, all_pos, all_neg): counts per distinct score,
    running from the highest down, and in all.  Distinct scores are dealt out by
    range; each range runs by itself and starts from the sums of those above it,
    of which only two numbers a range reach the driver."""
    per = scored.groupBy(F.col(score).alias("score")).agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg"))
    parts = int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    placed = materialised(per.repartitionByRange(parts, F.desc("score")).withColumn("_part", F.spark_partition_id()))
    starts, pos, neg = {}, 0, 0
    for r in sorted(placed.groupBy("_part").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).collect()):
        starts[r["_part"]] = (pos, neg)
        pos, neg = pos + r.pos, neg + r.neg
    before = lambda k: F.element_at(F.create_map(*[F.lit(x).cast("long") for p, s in starts.items() for x in (p, s[k])]), F.col("_part").cast("long")) if starts else F.lit(0).cast("long")
    down = Window.partitionBy("_part").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    running = placed.withColumn("tp", F.sum("pos").over(down) + before(0)).withColumn("fp", F.sum("neg").over(down) + before(1))
    return running.withColumn("all_pos", F.lit(pos).cast("long")).withColumn("all_neg", F.lit(neg).cast("long")).drop("_part")


def roc_points(scored: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """(threshold, tpr, fpr) of every distinct score."""
    c = score_counts(scored, label, score)
    return c.select(F.col("score").alias("threshold"), F.try_divide("tp", "all_pos").alias("tpr"), F.try_divide("fp", "all_neg").alias("fpr"))


def pr_points(scored: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """(threshold, precision, recall) of every distinct score."""
    c = score_counts(scored, label, score)
    return c.select(F.col("score").alias("threshold"), (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"), F.try_divide("tp", "all_pos").alias("recall"))


def roc_auc(scored: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """One row: the exact area under the curve, ties counting half."""
    c = score_counts(scored, label, score)
    won = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") + F.col("pos") / 2))
    return c.agg(F.try_divide(won, F.sum("pos") * F.sum("neg")).alias("auc"))


def roc_auc_each(scored: DataFrame, scores: list[str], label: str = "label") -> list[float | None]:
    """The exact areas of several scores of the same rows, ties counting half, in one
    pass.  Distinct scores are dealt out by range, each range runs by itself, and three
    sums a range and score reach the driver."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"`{c}`").alias("score")) for k, c in enumerate(scores)]))
    per = scored.select(F.col(label).alias("label"), each.alias("e")).groupBy("e.k", "e.score").agg(F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") != 1).alias("neg"))
    parts = int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    placed = per.repartitionByRange(parts, "k", "score").withColumn("_part", F.spark_partition_id())
    below = F.sum("neg").over(Window.partitionBy("_part", "k").orderBy("score").rowsBetween(Window.unboundedPreceding, 0))
    won = placed.withColumn("won", F.col("pos") * (below - F.col("neg") / 2))
    sums = {}
    for r in sorted(won.groupBy("k", "_part").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.sum("won").alias("won")).collect()):
        pos, neg, total = sums.get(r.k, (0, 0, 0.0))
        sums[r.k] = (pos + r.pos, neg + r.neg, total + r.won + r.pos * neg)
    return [total / (pos * neg) if pos and neg else None for pos, neg, total in (sums.get(k, (0, 0, 0.0)) for k in range(len(scores)))]


def risk_tier(p: Column) -> Column:
    """Low below 0.3, Medium below 0.7, else High."""
    return F.when(p < 0.3, "Low").when(p < 0.7, "Medium").otherwise("High")


def cluster_summary(df: DataFrame, columns: list[str], cluster: str = "cluster") -> DataFrame:
    """Per cluster: size, percentage and mean, deviation, least, most of columns."""
    aggs = [f(c).alias(f"{c}_{n}") for c in columns for n, f in (("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max))]
    per = df.groupBy(cluster).agg(F.count("*").alias("size"), *aggs)
    return per.withColumn("percentage", F.rint(F.col("size") / F.sum("size").over(Window.partitionBy()) * 10000) / 100)


def cluster_profile(df: DataFrame, columns: list[str], cluster_id: int, cluster: str = "cluster") -> DataFrame:
    """One row per column: statistics of one cluster and its mean relative to
    the overall mean, from one pass over the table after the exact medians."""
    median = {c: q for c, (q,) in percentiles(df.where(F.col(cluster) == cluster_id), {c: [0.5] for c in columns}).items()}
    own = lambda c: F.when(F.col(cluster) == cluster_id, F.col(c))
    aggs = [F.count_if(F.col(cluster) == cluster_id).alias("size"), F.count("*").alias("every")]
    for c in columns:
        aggs += [F.avg(own(c)).alias(f"{c}|mean"), F.stddev_samp(own(c)).alias(f"{c}|std"), F.lit(median[c]).cast("double").alias(f"{c}|median"), F.min(own(c)).alias(f"{c}|min"), F.max(own(c)).alias(f"{c}|max"), F.avg(c).alias(f"{c}|all")]
    one = df.agg(*aggs)
    r4 = lambda x: F.rint(x * 10000) / 10000
    rows = F.array(*[
        F.struct(
            F.lit(c).alias("feature"), *[r4(F.col(f"`{c}|{s}`").cast("double")).alias(s) for s in ("mean", "std", "median", "min", "max")],
            r4(F.when(F.col(f"`{c}|all`") != 0, F.col(f"`{c}|mean`") / F.col(f"`{c}|all`") - 1).otherwise(0.0)).alias("relative"),
        )
        for c in columns
    ])
    return one.where("size > 0").select("size", (F.rint(F.col("size") / F.col("every") * 10000) / 100).alias("percentage"), F.explode(rows).alias("r")).select("size", "percentage", "r.*")


def long_form(df: DataFrame, row_id: str, vector: str, cluster: str) -> DataFrame:
    """(id, cluster, dim, x) of an array column."""
    return df.select(F.col(row_id).alias("id"), F.col(cluster).alias("cluster"), F.posexplode(vector).alias("dim", "x")).withColumn("x", F.col("x").cast("double"))


def scatter(df: DataFrame, row_id: str = "vec_id", vector: str = "embedding", cluster: str = "label") -> DataFrame:
    """(cluster, n, dim, mean, within, overall): what both indices below need;
    one row per cluster and dimension."""
    x = long_form(df, row_id, vector, cluster)
    per = x.groupBy("cluster", "dim").agg(F.count("*").alias("n"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"))
    dims = Window.partitionBy("dim")
    return per.select("cluster", "dim", "n", (F.col("s") / F.col("n")).alias("mean"), (F.col("q") - F.col("s") * F.col("s") / F.col("n")).alias("within"), (F.sum("s").over(dims) / F.sum("n").over(dims)).alias("overall"))


def calinski_harabasz(df: DataFrame, **columns) -> DataFrame:
    """One row: between to within dispersion."""
    s = scatter(df, **columns)
    per = s.groupBy("cluster").agg(F.first("n").alias("n"), F.sum("within").alias("w"), F.sum(F.col("n") * (F.col("mean") - F.col("overall")) * (F.col("mean") - F.col("overall"))).alias("b"))
    t = per.agg(F.sum("n").alias("n"), F.count("*").alias("k"), F.sum("w").alias("w"), F.sum("b").alias("b"))
    return t.select(F.when(F.col("k") < 2, 0.0).otherwise(F.coalesce(F.try_divide(F.col("b") * (F.col("n") - F.col("k")), F.col("w") * (F.col("k") - 1)), F.lit(1.0))).alias("calinski_harabasz"))


def davies_bouldin(df: DataFrame, row_id: str = "vec_id", vector: str = "embedding", cluster: str = "label") -> DataFrame:
    """One row: mean over clusters of the worst ratio of spreads to centre
    distance.  The pairs are of cluster centres, whose number is the model's."""
    x = long_form(df, row_id, vector, cluster)
    centre = x.groupBy("cluster", "dim").agg(F.avg("x").alias("c"))
    spread = x.join(F.broadcast(centre), ["cluster", "dim"]).groupBy("cluster", "id").agg(F.sqrt(F.sum((F.col("x") - F.col("c")) ** 2)).alias("d")).groupBy("cluster").agg(F.avg("d").alias("s"))
    a, b = centre.alias("a"), centre.alias("b")
    gap = a.join(b, F.col("a.dim") == F.col("b.dim")).where(F.col("a.cluster") != F.col("b.cluster")).groupBy(F.col("a.cluster").alias("i"), F.col("b.cluster").alias("j")).agg(F.sqrt(F.sum((F.col("a.c") - F.col("b.c")) ** 2)).alias("gap"))
    si, sj = spread.select(F.col("cluster").alias("i"), F.col("s").alias("si")), spread.select(F.col("cluster").alias("j"), F.col("s").alias("sj"))
    worst = gap.join(F.broadcast(si), "i").join(F.broadcast(sj), "j").groupBy("i").agg(F.max((F.col("si") + F.col("sj")) / F.col("gap")).alias("r"))
    return worst.agg(F.avg("r").alias("davies_bouldin"))


def knn(df: DataFrame, k: int = 5, row_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, rank, d): distances to the k nearest rows of each row, itself among
    them.  The blocks that it reads stay in the shared folder."""
    return nearest(df, Folder(df.sparkSession), k, row_id, vector)


def knn_distance_percentile(df: DataFrame, k: int = 5, share: float = 0.9, row_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row: the percentile of the distance to the k-th nearest row."""
    with in_folder(df.sparkSession) as folder:
        kth = nearest(df, folder, k, row_id, vector).where(F.col("rank") == k)
        (found,) = percentiles(kth, {"d": [share]})["d"]
    return df.sparkSession.createDataFrame([(found,)], "distance double")


def silhouette(df: DataFrame, row_id: str = "vec_id", vector: str = "embedding", cluster: str = "label", rows: int | None = None) -> DataFrame:
    """One row: the mean Euclidean silhouette (a cluster of one row counts 0), of
    how many rows and its standard error.  Of all rows, which takes every pair of
    rows; or with ``rows`` of about so many, chosen by hash, each against all: an
    estimate whose error is given (0 where all are taken)."""
    with in_folder(df.sparkSession) as folder:
        n, s, q = silhouette_sums(df, folder, row_id, vector, cluster, rows).agg(F.sum("n"), F.sum("s"), F.sum("q")).first()
    mean = s / n if n else None
    error = 0.0 if rows is None or not n else (max(q / n - mean * mean, 0.0) / n) ** 0.5
    return df.sparkSession.createDataFrame([(mean, n or 0, error)], "silhouette double, rows long, error double")
