"""The order contract as a stream: the rollup kept up to date.

Sums and counts per customer are ordinary streaming aggregates; with a watermark
on the order date, order days are counted in windows whose state is dropped once
the watermark has passed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..contract import AMOUNT, CUSTOMER, DATE


def rollup_stream(orders: DataFrame) -> DataFrame:
    """customer_id, first_order, last_order, frequency, monetary for the output
    modes update and complete."""
    return orders.groupBy(CUSTOMER).agg(F.min(DATE).alias("first_order"), F.max(DATE).alias("last_order"), F.count(AMOUNT).alias("frequency"), F.sum(AMOUNT).alias("monetary"))


def daily_revenue_stream(orders: DataFrame, lateness: str = "7 days") -> DataFrame:
    """day, orders, revenue; days older than the watermark are final."""
    timed = orders.withColumn(DATE, F.col(DATE).cast("timestamp")).withWatermark(DATE, lateness)
    return timed.groupBy(F.window(DATE, "1 day").alias("w")).agg(F.count("*").alias("orders"), F.sum(AMOUNT).alias("revenue")).select(F.col("w.start").alias("day"), "orders", "revenue")
