"""Monthly retention cohorts in long form, with a wide view."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..contract import CUSTOMER, DATE, checked
from ..functions.exprs import month_number


def cohort_long(orders: DataFrame) -> DataFrame:
    """cohort (yyyy-MM), month_offset, active, size, retention.  A cohort has no
    row where it had no active customer.

    Order lines are reduced to one row per customer and month before anything
    else; the first month and the counts reuse that partitioning."""
    months = orders.select(CUSTOMER, month_number(F.col(DATE)).alias("_month")).groupBy(CUSTOMER, "_month").agg(F.lit(1).alias("_one"))
    first = F.min("_month").over(Window.partitionBy(CUSTOMER))
    cells = months.withColumn("_first", first).groupBy("_first", (F.col("_month") - F.col("_first")).alias("month_offset")).agg(F.count("*").alias("active"))
    size = F.max(F.when(F.col("month_offset") == 0, F.col("active"))).over(Window.partitionBy("_first"))
    label = F.format_string("%04d-%02d", F.floor((F.col("_first") - 1) / 12).cast("int"), ((F.col("_first") - 1) % 12 + 1).cast("int"))
    return cells.withColumn("size", size).select(label.alias("cohort"), F.col("month_offset").cast("int").alias("month_offset"), "active", "size", (F.col("active") / F.col("size")).alias("retention"))


def cohort_wide(long: DataFrame, value: str = "retention", last_offset: int | None = None) -> DataFrame:
    """One row per cohort, columns 0..last_offset; null where there is no cell."""
    last = long.agg(F.max("month_offset")).first()[0] if last_offset is None else last_offset
    return long.groupBy("cohort").pivot("month_offset", list(range((last or 0) + 1))).agg(F.first(value)).orderBy("cohort")


def retention_curve(long: DataFrame) -> DataFrame:
    """Size-weighted mean retention of the cohorts that have a cell."""
    return long.groupBy("month_offset").agg(F.sum("active").alias("active"), F.sum("size").alias("size")).select(
        "month_offset", F.try_divide(F.col("active").cast("double"), F.col("size").cast("double")).alias("retention")
    ).orderBy("month_offset")


@dataclass(frozen=True)
class CohortResult:
    long: DataFrame

    @cached_property
    def max_offset(self) -> int:
        return self.long.agg(F.max("month_offset")).first()[0]

    @cached_property
    def n_cohorts(self) -> int:
        return self.long.where("month_offset = 0").count()

    @property
    def counts(self) -> DataFrame:
        return cohort_wide(self.long, "active", self.max_offset)

    @property
    def retention(self) -> DataFrame:
        return cohort_wide(self.long, "retention", self.max_offset)

    @property
    def sizes(self) -> DataFrame:
        return self.long.where("month_offset = 0").select("cohort", "size").orderBy("cohort")

    @property
    def curve(self) -> DataFrame:
        return retention_curve(self.long)


def compute_cohorts(orders: DataFrame) -> CohortResult:
    return CohortResult(cohort_long(checked(orders)))
