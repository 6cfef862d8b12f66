"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_US = 86_400_000_000

#: Strings that count as missing in delimited files.
NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]


def round_even(x: Column, digits: int) -> Column:
    """Half-even on the scaled double, as numerical libraries round."""
    scale = float(10**digits)
    return F.rint(x * F.lit(scale)) / F.lit(scale)


def elapsed_days(start: Column, end: Column) -> Column:
    """Whole 24-hour periods between two timestamps, rounded down."""
    return F.floor(F.timestamp_diff("MICROSECOND", start, end) / F.lit(DAY_US)).cast("long")


def month_number(ts: Column) -> Column:
    return F.year(ts) * 12 + F.month(ts)


def stripped(text: Column) -> Column:
    return F.regexp_replace(text.cast("string"), r"^\s+|\s+$", "")


def nulled(text: Column) -> Column:
    """The text, null if it is one of the tokens for missing values."""
    return F.when(~text.isin(NA_TOKENS), text)


def parsed_amount(text: Column, numeric: Column | bool = False) -> Column:
    """A money text as a double: as it is if the whole column is numeric, else
    after everything but digits, point and minus has gone; null if that isn't a
    number."""
    plain = text.try_cast("double")
    cleaned = F.regexp_replace(text, r"[^\d.\-]", "").try_cast("double")
    return F.when(F.lit(numeric) if isinstance(numeric, bool) else numeric, plain).otherwise(cleaned)


#: Tried in this order after ISO forms; month first unless the caller says day first.
MONTH_FIRST = ["M/d/yyyy H:m:s", "M/d/yyyy H:m", "M/d/yyyy", "M-d-yyyy", "yyyy/M/d", "yyyyMMdd", "MMM d, yyyy", "d MMM yyyy"]
DAY_FIRST = ["d/M/yyyy H:m:s", "d/M/yyyy H:m", "d/M/yyyy", "d-M-yyyy", "yyyy/M/d", "yyyyMMdd", "MMM d, yyyy", "d MMM yyyy"]


def parsed_timestamp(text: Column, day_first: bool = False) -> Column:
    """Per row: ISO first (an offset is dropped, the wall clock stays), then the
    formats in order; null if none fits.  Bare numbers other than yyyyMMdd are
    no dates."""
    wall = F.regexp_replace(text, r"\s*(?:UTC|GMT)$", "")
    iso = F.when(~wall.rlike(r"^-?\d+(\.\d+)?$"), wall.try_cast("timestamp_ntz"))
    tries = [F.expr("NULL").cast("timestamp_ntz"), iso]
    for fmt in DAY_FIRST if day_first else MONTH_FIRST:
        guard = wall.rlike(r"^\d{8}$") if fmt == "yyyyMMdd" else ~wall.rlike(r"^-?\d+(\.\d+)?$")
        tries.append(F.when(guard, F.try_to_timestamp(wall, F.lit(fmt)).cast("timestamp_ntz")))
    return F.coalesce(*tries[1:])
