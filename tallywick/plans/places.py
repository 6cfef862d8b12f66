"""Places of rows in an order, and the rows before them, without a task for all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import materialised

#: Rows that a block of a hash order holds in the mean, and how many blocks there
#: are at most (one row a block and column is broadcast).
BLOCK_ROWS = 50_000
BLOCKS_MOST = 1 << 16


def ranked(df: DataFrame, group: str, order: list[str], name: str = "rank") -> DataFrame:
    """The rows with their place (1..) in their group's ``order``, which must tell
    all rows of a group apart.  Rows are dealt out by ranges of (group, order), so a
    large group or many equal values spread over tasks; a row's place is its place
    in its task and the counts of the group in the tasks before.  Groups are few:
    a row for each, and one a task, are broadcast."""
    by = [group, *order]
    spread = df.repartitionByRange(*[F.col(f"`{c}`") for c in by]).sortWithinPartitions(*[F.col(f"`{c}`") for c in by])
    held = materialised(spread.withColumn("_at", F.monotonically_increasing_id()).withColumn("_task", F.shiftright("_at", 33)))
    counts = held.groupBy("_task", group).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(group).orderBy("_task")) - F.col("_n")
    starts = counts.select("_task", F.col(f"`{group}`").alias("_group"), "_first", before.alias("_before"))
    same = (held["_task"] == starts["_task"]) & held[group].eqNullSafe(starts["_group"])
    return held.join(F.broadcast(starts), same).select(*[held[c] for c in df.columns], (F.col("_before") + held["_at"] - F.col("_first") + 1).alias(name))


def rotated(rows: DataFrame, row_id: str, columns: list[str], seeds: list[int], n: int) -> DataFrame:
    """(row_id, k, given): for column number k the value, as text, of the row before
    in the order of a seeded hash of the row's id; the first row gets the last
    one's.  Each column's given values are its values in another order.

    Rows are windowed in blocks of the hash, of which the last row goes over to the
    next block: hashes are even, so no block grows beyond its share of ``n``."""
    blocks = min(max(n // BLOCK_ROWS, 1), BLOCKS_MOST)
    cells = F.array(*[F.struct(F.lit(k).alias("k"), F.xxhash64(row_id, F.lit(s)).alias("h"), F.struct(F.col(f"`{c}`").cast("string").alias("text")).alias("v")) for k, (c, s) in enumerate(zip(columns, seeds, strict=True))])
    block: Column = F.least(((F.col("h").cast("double") / 2.0**64 + 0.5) * blocks).cast("int"), F.lit(blocks - 1))
    long = rows.select(row_id, F.explode(cells).alias("c")).select(row_id, "c.*").withColumn("block", block)
    inside = Window.partitionBy("k", "block").orderBy("h", row_id)
    ends = long.groupBy("k", "block").agg(F.max_by("v", F.struct("h", row_id)).alias("end"))
    along = Window.partitionBy("k").orderBy("block")
    every = along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = ends.select("k", "block", F.coalesce(F.lag("end").over(along), F.last("end").over(every)).alias("end"))
    return long.withColumn("before", F.lag("v").over(inside)).join(F.broadcast(ends), ["k", "block"]).select(row_id, "k", F.coalesce("before", "end")["text"].alias("given"))
