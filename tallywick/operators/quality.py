"""Data-quality findings on the order contract."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..contract import AMOUNT, CUSTOMER, DATE, checked
from ..functions.exprs import elapsed_days, month_number, round_even
from .rollup import total

ONE_TIME_SHARE, SHORT_MONTHS = 0.8, 2


@dataclass(frozen=True)
class Finding:
    level: str
    code: str
    message: str


@dataclass(frozen=True)
class QualityReport:
    n_rows: int
    n_customers: int
    date_min: datetime
    date_max: datetime
    total_revenue: float
    span_days: int
    findings: list[Finding] = field(default_factory=list)

    @property
    def warnings(self) -> list[Finding]:
        return [f for f in self.findings if f.level == "warning"]


def profile(orders: DataFrame, scale: int | None = None) -> DataFrame:
    """One row of counts, range, revenue and span."""
    return orders.agg(
        F.count("*").alias("n_rows"),
        F.countDistinct(CUSTOMER).alias("n_customers"),
        F.min(DATE).alias("date_min"),
        F.max(DATE).alias("date_max"),
        round_even(total(F.col(AMOUNT), scale), 2).alias("total_revenue"),
        elapsed_days(F.min(DATE), F.max(DATE)).alias("span_days"),
        (F.max(month_number(F.col(DATE))) - F.min(month_number(F.col(DATE)))).alias("months"),
    )


def duplicate_rows(orders: DataFrame) -> DataFrame:
    """One row: the number of rows beyond the first of equal ones."""
    return orders.groupBy(CUSTOMER, DATE, AMOUNT).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).cast("long").alias("n"))


def future_rows(orders: DataFrame, as_of: datetime | None = None) -> DataFrame:
    """One row: the number of rows after the midnight that begins ``as_of``."""
    midnight = F.date_trunc("day", F.lit(as_of).cast("timestamp_ntz") if as_of else F.localtimestamp()).cast("timestamp_ntz")
    return orders.agg(F.count_if(F.col(DATE) > midnight).alias("n"))


def one_time_share(orders: DataFrame) -> DataFrame:
    """One row: customers, those with one order line, and their share."""
    per = orders.groupBy(CUSTOMER).agg(F.count("*").alias("n"))
    return per.agg(F.count("*").alias("customers"), F.count_if(F.col("n") == 1).alias("one_time")).withColumn("share", F.try_divide("one_time", "customers"))


def check_orders(orders: DataFrame, as_of: datetime | None = None, scale: int | None = None) -> QualityReport:
    """Findings in the order duplicates, future dates, short history, one-time
    buyers."""
    rows = checked(orders, require_rows=False)
    p = profile(rows, scale).first()
    findings = []
    if (n := duplicate_rows(rows).first().n) > 0:
        findings.append(Finding("warning", "duplicate_rows", f"{n:,} exact duplicate order rows"))
    if (n := future_rows(rows, as_of).first().n) > 0:
        findings.append(Finding("warning", "future_dates", f"{n:,} orders are dated in the future"))
    if p.n_rows and p.months < SHORT_MONTHS:
        findings.append(Finding("warning", "short_history", "less than two months of history; cohorts say little"))
    share = one_time_share(rows).first().share
    if share is not None and share > ONE_TIME_SHARE:
        findings.append(Finding("info", "mostly_one_time", f"{share:.0%} of customers bought once"))
    return QualityReport(p.n_rows, p.n_customers, p.date_min, p.date_max, p.total_revenue or 0.0, p.span_days or 0, findings)
