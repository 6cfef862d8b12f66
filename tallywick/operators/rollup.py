"""Customer grain: one aggregation of the order lines that all analyses share."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..contract import AMOUNT, CUSTOMER, DATE
from ..functions.exprs import elapsed_days


def total(amount: Column, scale: int | None) -> Column:
    """Sum of amounts; with a scale, exactly at so many decimals, so that the
    order of addition can't show."""
    return F.sum(amount) if scale is None else F.sum(amount.cast(f"decimal(18,{scale})")).cast("double")


def customer_rollup(orders: DataFrame, scale: int | None = None) -> DataFrame:
    """customer_id, first_order, last_order, frequency (non-null order lines),
    monetary, distinct_days."""
    return orders.groupBy(CUSTOMER).agg(
        F.min(DATE).alias("first_order"),
        F.max(DATE).alias("last_order"),
        F.count(AMOUNT).alias("frequency"),
        total(F.col(AMOUNT), scale).alias("monetary"),
        F.countDistinct(F.to_date(DATE)).alias("distinct_days"),
    )


def rfm_base(orders: DataFrame, reference: Column, scale: int | None = None) -> DataFrame:
    """The rollup with recency in whole elapsed days and mean order value."""
    base = orders.groupBy(CUSTOMER).agg(
        F.min(DATE).alias("first_order"), F.max(DATE).alias("last_order"), F.count(AMOUNT).alias("frequency"), total(F.col(AMOUNT), scale).alias("monetary")
    )
    return base.select(
        CUSTOMER,
        "first_order",
        "last_order",
        F.greatest(elapsed_days(F.col("last_order"), reference), F.lit(0)).cast("long").alias("recency_days"),
        "frequency",
        "monetary",
        F.try_divide("monetary", "frequency").alias("avg_order_value"),
    )


def latest_order(orders: DataFrame) -> datetime | None:
    return orders.agg(F.max(DATE)).first()[0]
