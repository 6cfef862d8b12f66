"""Customer lifetime value: a closed form and the BG/NBD + Gamma-Gamma model."""

from __future__ import annotations

import logging
from dataclasses import dataclass
from functools import cached_property

from numpy.linalg import LinAlgError
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..contract import AMOUNT, CUSTOMER, DATE, checked
from ..functions.exprs import round_even
from ..plans.selection import percentiles
from .rollup import total

MIN_REPEAT_BUYERS = 20
OUTPUT = ["customer_id", "predicted_clv", "avg_order_value", "total_revenue", "frequency", "n_orders", "recency_days", "T"]


def clv_inputs(orders: DataFrame, scale: int | None = None) -> DataFrame:
    """Per customer on midnight dates: frequency (repeat days), recency and T in
    days, monetary_value, total_revenue, n_orders, first_order, last_order.

    The observation end is one scalar job over the date column."""
    day = F.to_date(DATE)
    per = orders.groupBy(CUSTOMER).agg(
        F.min(day).alias("first_order"),
        F.max(day).alias("last_order"),
        F.countDistinct(day).alias("_days"),
        total(F.col(AMOUNT), scale).alias("total_revenue"),
        F.count(AMOUNT).alias("n_orders"),
    )
    end = orders.agg(F.max(day)).first()[0]
    return per.select(
        CUSTOMER,
        F.greatest(F.col("_days") - 1, F.lit(0)).cast("double").alias("frequency"),
        F.datediff("last_order", "first_order").cast("double").alias("recency"),
        F.datediff(F.lit(end).cast("date"), "first_order").cast("double").alias("T"),
        F.try_divide("total_revenue", "n_orders").alias("monetary_value"),
        "total_revenue",
        "n_orders",
        "first_order",
        "last_order",
    )


def discount_factor(horizon_months: int, rate: float) -> float:
    if rate <= 0:
        return float(horizon_months)
    d = 1.0 / (1.0 + rate)
    return (1 - d**horizon_months) / (1 - d)


def heuristic_clv(horizon_months: int, rate: float) -> Column:
    """Monthly revenue times the odds of still being active, discounted."""
    active = F.greatest(F.col("T"), F.lit(1.0))
    monthly = F.col("total_revenue") / F.greatest(active / 30.0, F.lit(1.0))
    since = F.greatest(F.col("T") - F.col("recency"), F.lit(0.0))
    gap = F.when(F.col("frequency") > 0, F.col("recency") / F.greatest(F.col("frequency"), F.lit(1.0))).otherwise(active)
    alive = F.exp(-(since / F.greatest(gap, F.lit(1.0))))
    return F.greatest(monthly * alive * F.lit(discount_factor(horizon_months, rate)), F.lit(0.0))


@dataclass(frozen=True)
class ClvResult:
    table: DataFrame
    method: str
    horizon_months: int

    @cached_property
    def summary(self) -> dict:
        row = summarise_clv(self.table).first().asDict()
        return row | {"method": self.method, "horizon_months": self.horizon_months}

    @property
    def total_clv(self) -> float:
        return float(self.table.agg(F.sum("predicted_clv")).first()[0] or 0.0)


def summarise_clv(table: DataFrame) -> DataFrame:
    """One row: total, mean, median, top-decile share of value in per cent.  The
    median is exact and found by jobs of this call."""
    (median,) = percentiles(table, {"predicted_clv": [0.5]})["predicted_clv"]
    stats = table.agg(F.sum("predicted_clv").alias("total"), F.avg("predicted_clv").alias("mean"), F.lit(median).cast("double").alias("median"), F.count("*").alias("customers"))
    share = top_decile_share(table)
    return stats.crossJoin(F.broadcast(share)).select(  # one row each
        round_even(F.col("total"), 2).alias("total_clv"), round_even(F.col("mean"), 2).alias("mean_clv"), round_even(F.col("median"), 2).alias("median_clv"), "customers", "top_decile_share"
    )


def top_decile_share(table: DataFrame) -> DataFrame:
    """One row: the share in per cent of the top tenth of customers (one at
    least)."""
    n = table.count()
    k = max(1, n // 10)
    top = table.orderBy(F.desc("predicted_clv"), "customer_id").limit(k).agg(F.sum("predicted_clv").alias("top"))
    every = table.agg(F.sum("predicted_clv").alias("every"))
    return top.crossJoin(every).select(F.when(F.col("every") > 0, round_even(F.col("top") / F.col("every") * 100, 1)).otherwise(0.0).alias("top_decile_share"))


def compute_clv(orders: DataFrame, horizon_months: int = 12, discount_rate: float = 0.01, method: str = "auto", scale: int | None = None) -> ClvResult:
    """``auto`` takes the model where there are ``MIN_REPEAT_BUYERS`` repeat
    buyers; a model that can't be fitted gives way to the closed form."""
    if method not in ("auto", "lifetimes", "heuristic"):
        raise ValueError(f"unknown method {method!r}")
    inputs = clv_inputs(checked(orders), scale)
    chosen, value = "heuristic", None
    if method != "heuristic":
        repeat = inputs.where("frequency > 0").count()
        if method == "lifetimes" or repeat >= MIN_REPEAT_BUYERS:
            from .bgnbd import fit_and_predict

            try:
                inputs = fit_and_predict(inputs, horizon_months, discount_rate)
                chosen, value = "bgnbd_gamma_gamma", F.col("_clv")
            except (ValueError, ArithmeticError, LinAlgError) as problem:  # the closed form always works
                logging.getLogger(__name__).warning("the model could not be fitted (%s); the closed form is used", problem)
    if value is None:
        value = heuristic_clv(horizon_months, discount_rate)
    table = inputs.select(
        "customer_id",
        round_even(value, 2).alias("predicted_clv"),
        round_even(F.col("monetary_value"), 2).alias("avg_order_value"),
        round_even(F.col("total_revenue"), 2).alias("total_revenue"),
        F.col("frequency").cast("int").alias("frequency"),
        "n_orders",
        F.col("recency").cast("int").alias("recency_days"),
        F.col("T").cast("int").alias("T"),
    ).orderBy(F.desc("predicted_clv"), "customer_id")
    return ClvResult(table, chosen, horizon_months)


def model_available() -> bool:
    """The model is part of this package."""
    return True


def clv_histogram(table: DataFrame, bins: int = 12) -> DataFrame:
    """bin (1..bins), low, high, customers of the positive values; equal widths,
    the last bin closed, one distinct value v spread over v - 0.5 .. v + 0.5."""
    positive = table.where("predicted_clv > 0")
    low, high = positive.agg(F.min("predicted_clv"), F.max("predicted_clv")).first()
    if low is None:
        return table.sparkSession.createDataFrame([], "bin int, low double, high double, customers long")
    if low == high:
        low, high = low - 0.5, high + 0.5
    width = (high - low) / bins
    counted = positive.groupBy(F.least(F.width_bucket("predicted_clv", F.lit(low), F.lit(high), F.lit(bins)), F.lit(bins)).cast("int").alias("bin")).agg(F.count("*").alias("customers"))
    every = table.sparkSession.range(1, bins + 1).select(F.col("id").cast("int").alias("bin"))
    return every.join(counted, "bin", "left").select(
        "bin", (F.lit(low) + (F.col("bin") - 1) * F.lit(width)).alias("low"), (F.lit(low) + F.col("bin") * F.lit(width)).alias("high"), F.coalesce("customers", F.lit(0)).alias("customers")
    ).orderBy("bin")
