"""Feature preparation: numeric selection, exact medians, scaling, vectors."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.lineage import materialised
from ..plans.selection import percentiles

#: Rows that a task of many passes has about, at least and at most.
TASK_ROWS = (2_000, 100_000)
#: Rows of a task where hundreds of passes come one after another and each does little for a row.
PASS_ROWS = 25_000


def numeric_columns(df: DataFrame, exclude: tuple[str, ...] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in exclude]


def medians(df: DataFrame, columns: list[str]) -> dict[str, float]:
    """Exact interpolated medians of all columns (null, NaN: left out; 0 where
    nothing is left)."""
    return {c: q or 0.0 for c, (q,) in percentiles(df, {c: [0.5] for c in columns}).items()}


def impute(df: DataFrame, values: dict[str, float]) -> DataFrame:
    filled = {c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")), F.lit(v)) for c, v in values.items()}
    return df.withColumns(filled)


def scaling(df: DataFrame, columns: list[str], method: str = "standard") -> dict[str, tuple[float, float]]:
    """(centre, width) per column: mean and population deviation, minimum and
    range, or median and interquartile range; a width of 0 counts as 1."""
    if method == "minmax":
        pair = lambda c: (F.min(c), F.max(c) - F.min(c))
    elif method == "robust":
        found = percentiles(df, {c: [0.25, 0.5, 0.75] for c in columns})
        return {c: (m or 0.0, (high or 0.0) - (low or 0.0) or 1.0) for c, (low, m, high) in found.items()}
    elif method == "standard":
        pair = lambda c: (F.avg(c), F.stddev_pop(c))
    else:
        raise ValueError(f"unknown scaling {method!r}")
    row = df.agg(*[x.alias(f"{c}_{k}") for c in columns for k, x in enumerate(pair(F.col(c).cast("double")))]).first()
    return {c: (float(row[f"{c}_0"] or 0.0), float(row[f"{c}_1"] or 0.0) or 1.0) for c in columns}


def scale(df: DataFrame, by: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: (F.col(c) - F.lit(m)) / F.lit(w) for c, (m, w) in by.items()})


def vectors(df: DataFrame, columns: list[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=columns, outputCol=out).transform(df)


def label_codes(df: DataFrame, columns: list[str]) -> DataFrame:
    """Categories as their place in alphabetical order.  Categories are few by
    nature; each column's list is collected once."""
    for c in columns:
        names = [r[0] for r in df.select(F.col(c).cast("string")).distinct().orderBy(c).collect()]
        known = F.create_map(*[F.lit(x) for k, n in enumerate(x for x in names if x is not None) for x in (n, k)]) if any(n is not None for n in names) else None
        df = df.withColumn(c, F.try_element_at(known, F.col(c).cast("string")) if known is not None else F.lit(None).cast("int"))
    return df


def dealt(df: DataFrame) -> DataFrame:
    """The rows, cached, for passes that are made many times: dealt out by their
    hash over the cores, fewer where there are few rows and more only where a task
    would have too many.  Each task of a pass makes a whole table of a model's
    statistics, so that 200 partitions would make and shuffle 200 tables."""
    rows, (least, most) = df.count(), TASK_ROWS
    parts = max(min(df.sparkSession.sparkContext.defaultParallelism, -(-rows // least)), -(-rows // most), 1)
    return df.repartition(parts, F.xxhash64(*df.columns)).sortWithinPartitions(*df.columns).cache()


def fewer_tasks(df: DataFrame, rows: int) -> DataFrame:
    """The ``rows`` rows in tasks of ``PASS_ROWS`` and no more tasks than before,
    for fits that make hundreds of short passes one after another: with small tasks
    their starts take longer than the passes.  A checkpoint spares each pass the
    stages that made the rows."""
    return materialised(df.coalesce(max(1, -(-rows // PASS_ROWS))))
