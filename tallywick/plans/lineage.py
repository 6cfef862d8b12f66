"""Materialised cuts in the shared folder and the session they need."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The cluster's folder (``spark.checkpoint.dir``); a folder of our own only
    where none is named and the master is local."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder")
        named = tempfile.mkdtemp(prefix="tallywick-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return named


def materialised(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


class Folder:
    """Tables of one calculation in the shared folder."""

    def __init__(self, spark: SparkSession):
        self.spark, self.path, self.n = spark, f"{shared_dir(spark)}/tallywick/steps-{uuid.uuid4().hex}", 0

    def write(self, df: DataFrame) -> DataFrame:
        """The rows as Parquet, read back: lineage ends there."""
        self.n += 1
        path = f"{self.path}/{self.n}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, tables: int | None = None) -> None:
        """Deletes table number ``tables``, or all."""
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.path if tables is None else f"{self.path}/{tables}")
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def in_folder(spark: SparkSession) -> Iterator[Folder]:
    """A folder for steps whose result is computed inside; it goes at the end."""
    folder = Folder(spark)
    try:
        yield folder
    finally:
        folder.drop()


def _to_least(pairs: DataFrame, upward: bool) -> DataFrame:
    """Every neighbour v of u goes to the least of u and its neighbours
    (``upward``: the larger neighbours only)."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    linked = pairs.join(least, "u")
    moved = (linked.where("v > u") if upward else linked).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return (moved if upward else moved.unionByName(least.select("u", F.col("m").alias("v")))).where("u <> v").distinct()


def components(links: DataFrame, folder: Folder, most_rounds: int = 64) -> DataFrame:
    """(node, root) of the nodes that aren't the least of their component; links
    are two columns of longs.  Stars are contracted in turn to larger and smaller
    neighbours: the rounds grow with the logarithm of a component's size, not with
    its diameter.  Two numbers a round reach the driver."""
    a, b = links.columns[:2]
    now = folder.write(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    mark = None
    for _ in range(most_rounds):
        before, mark = mark, now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before or not mark[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        now = folder.write(_to_least(_to_least(both, True), False))
        folder.drop(folder.n - 1)  # its successor is written
    raise RuntimeError(f"components haven't settled in {most_rounds} rounds")
