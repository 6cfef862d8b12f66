"""Session helpers: the shared folder, lineage cuts and table readers."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``.

    Only where that is unset and the master is local (tests) is a folder of
    our own made; on a cluster an unset folder is an error.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="tallywick-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: rows go to the shared folder, lineage ends there.

    The files go when the frame is garbage (``cleanCheckpoints``)."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write to Parquet in the shared folder and read back: a compact lineage
    cut for tables that are read more than once."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tallywick/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: What this session has written and not yet dropped.
_WRITTEN: list[str] = []


def written_so_far() -> int:
    return len(_WRITTEN)


def drop_written(spark: SparkSession, since: int = 0, keep: int = 0) -> None:
    """Deletes what :func:`written` has left in the shared folder after its first
    ``since`` tables, but for the last ``keep``: for a caller who has written or
    collected all that was built on them."""
    gone = _WRITTEN[since : len(_WRITTEN) - keep]
    del _WRITTEN[since : len(_WRITTEN) - keep]
    for path in gone:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def shuffle_width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def block_count(spark: SparkSession, n_bytes: int, each: int) -> int:
    """Blocks of about ``each`` bytes; for small tables some smaller ones, so that
    all tasks have one.  Blocks answer to as many buckets, so their number follows
    the bytes and not the session's partitions."""
    return max(1, -(-n_bytes // each), min(2 * shuffle_width(spark), -(-n_bytes // (each // 4))))


def crc_mod(id_col, mod: int):
    """crc32 of the id as text, modulo ``mod`` (null id: as the empty text)."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % F.lit(mod)


def collapsed(rows: DataFrame) -> DataFrame:
    """``rows`` with wholly equal rows of a batch as one row and their number in
    ``_copies``, before they are dealt out by content: a large group of equal rows
    (copies without id, say) leaves a task once a batch.  Rows are told apart by
    128 bits of hash."""
    names = rows.columns
    row = [F.struct(*names), *(F.col(c).isNull() for c in names)]
    keyed = rows.withColumns({"_a": F.xxhash64(*row), "_b": F.xxhash64(F.lit(1), *row)})

    def run(batches):
        for batch in batches:
            a, b = (np.asarray(batch.column(batch.schema.get_field_index(c))) for c in ("_a", "_b"))
            order = np.lexsort((b, a))
            new = np.concatenate([[True], (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])])[: len(a)]
            at = np.flatnonzero(new)
            copies = np.diff(np.append(at, len(a)))
            kept = batch.drop_columns(["_a", "_b"]) if len(at) == len(a) else batch.drop_columns(["_a", "_b"]).take(pa.array(order[at]))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(copies if len(at) < len(a) else np.ones(len(a), np.int64), pa.int64())], [*names, "_copies"])

    return keyed.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("_copies", T.LongType())]))


def expanded(rows: DataFrame) -> DataFrame:
    """As many rows as ``_copies`` says, without that column."""
    return rows.withColumn("_copies", F.explode(F.sequence(F.lit(1).cast("long"), "_copies"))).drop("_copies")
