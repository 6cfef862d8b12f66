"""The order contract: three columns, and the errors raised against it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CUSTOMER, DATE, AMOUNT = "customer_id", "order_date", "amount"
SCHEMA = f"{CUSTOMER} string, {DATE} timestamp_ntz, {AMOUNT} double"


class IngestError(ValueError):
    """An order table can't be brought under the contract."""


def checked(orders: DataFrame, require_rows: bool = True) -> DataFrame:
    """The contract columns with their types; KeyError where one is missing,
    ValueError where there is no row."""
    missing = [c for c in (CUSTOMER, DATE, AMOUNT) if c not in orders.columns]
    if missing:
        raise KeyError(f"missing column(s): {missing}")
    out = orders.select(F.col(CUSTOMER).cast("string"), F.col(DATE).cast("timestamp_ntz"), F.col(AMOUNT).cast("double"))
    if require_rows and out.isEmpty():
        raise ValueError("the order table is empty")
    return out
