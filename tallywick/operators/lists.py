"""Ranked win-back and best-customer lists."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import round_even
from .clv import ClvResult
from .segments import RfmResult, action_of

#: Fixed values.
CHURN_SEGMENTS = ["At Risk", "Cant Lose Them", "About To Sleep", "Hibernating", "Lost", "Need Attention"]
HIGH_VALUE_SEGMENTS = ["Champions", "Loyal Customers", "Potential Loyalists"]
LIST_COLUMNS = ["customer_id", "recency_days", "frequency", "monetary", "avg_order_value", "last_order", "r_score", "f_score", "m_score", "segment", "predicted_clv", "churn_score", "churn_risk", "recommended_action"]


def churn_score(r_score: Column, recency: Column, low: Column, high: Column, bins: int) -> Column:
    """0..1, mostly the inverted recency score and partly the recency itself."""
    rank = (F.lit(bins) - r_score) / F.lit(float(bins - 1))
    span = (high - low).cast("double")
    part = F.when(span > 0, (recency - low) / span).otherwise(0.0)
    return round_even(F.greatest(F.least(F.lit(0.7) * rank + F.lit(0.3) * part, F.lit(1.0)), F.lit(0.0)), 3)


@dataclass(frozen=True)
class CustomerLists:
    customers: DataFrame
    churn_risk: DataFrame
    high_value: DataFrame


def build_customer_lists(rfm: RfmResult, clv: ClvResult, churn_top: int | None = None, high_value_top: int | None = None) -> CustomerLists:
    """Both tables joined one to one (a missing value counts 0), with flags and
    actions, and the two ranked lists."""
    low, high = rfm.table.agg(F.min("recency_days"), F.max("recency_days")).first()
    joined = rfm.table.join(clv.table.select("customer_id", "predicted_clv"), "customer_id", "left").fillna(0.0, ["predicted_clv"])
    customers = joined.withColumns(
        {
            "churn_score": churn_score(F.col("r_score"), F.col("recency_days"), F.lit(low), F.lit(high), rfm.bins),
            "churn_risk": F.col("segment").isin(CHURN_SEGMENTS),
            "recommended_action": action_of(F.col("segment")),
        }
    ).select(*LIST_COLUMNS)
    churn = customers.where("churn_risk").orderBy(F.desc("predicted_clv"), F.desc("churn_score"), "customer_id")
    best = customers.where(F.col("segment").isin(HIGH_VALUE_SEGMENTS)).orderBy(F.desc("predicted_clv"), "customer_id")
    cap = lambda df, n: df if n is None else df.limit(n)
    return CustomerLists(customers, cap(churn, churn_top), cap(best, high_value_top))
