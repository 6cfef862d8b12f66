"""Order tables from delimited files or any DataFrame, under the contract."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.errors import AnalysisException

from ..contract import AMOUNT, CUSTOMER, DATE, IngestError
from ..functions.exprs import nulled, parsed_amount, parsed_timestamp, stripped
from .split_csv import read_csv

#: Column names of known exports.
PRESETS = {
    "shopify": {CUSTOMER: "Email", DATE: "Created at", AMOUNT: "Total"},
    "woocommerce": {CUSTOMER: "Customer ID", DATE: "Order Date", AMOUNT: "Order Total"},
    "stripe": {CUSTOMER: "Customer Email", DATE: "Created (UTC)", AMOUNT: "Amount"},
    "generic": {CUSTOMER: "customer_id", DATE: "order_date", AMOUNT: "amount"},
}
#: Header synonyms in order of preference, without case and punctuation.
SYNONYMS = {
    CUSTOMER: ["customerid", "customer", "customeremail", "email", "billingemail", "clientid", "userid", "buyer", "buyeremail", "customername"],
    DATE: ["orderdate", "createdat", "createdutc", "created", "date", "transactiondate", "purchasedate", "paidat", "processedat", "timestamp"],
    AMOUNT: ["amount", "total", "ordertotal", "totalprice", "grandtotal", "netamount", "revenue", "subtotal", "lineamount", "price", "paid"],
}
MAP_KEYS = {"customer": CUSTOMER, "customer_id": CUSTOMER, "date": DATE, "order_date": DATE, "amount": AMOUNT}
REASONS = ["blank_customer", "bad_date", "bad_amount", "nonpositive_amount"]


def normal_header(name: str) -> str:
    return "".join(filter(str.isalnum, str(name).lower()))


def detect_mapping(columns: list[str]) -> dict[str, str]:
    """Contract column -> header.  Synonyms decide in their order, the first of
    equal headers counts, and no header serves twice."""
    headers = {normal_header(c): c for c in reversed(columns)}
    found: dict[str, str] = {}
    for wanted, names in SYNONYMS.items():
        hit = next((headers[n] for n in names if n in headers and headers[n] not in found.values()), None)
        if hit is not None:
            found[wanted] = hit
    return found


def parse_map_arg(text: str) -> dict[str, str]:
    """``customer=Email,date=Created at,amount=Total`` as a mapping."""
    out = {}
    for entry in filter(None, (p.strip() for p in text.split(","))):
        key, equals, column = entry.partition("=")
        if not equals:
            raise IngestError(f"Bad --map entry {entry!r}; write key=column")
        if key.strip().lower() not in MAP_KEYS:
            raise IngestError(f"Unknown --map key {key.strip()!r}; use customer, date or amount")
        out[MAP_KEYS[key.strip().lower()]] = column.strip()
    return out


def _is_text(raw: DataFrame, mapping: dict[str, str]) -> bool:
    return not isinstance(raw.select(F.col(f"`{mapping[AMOUNT]}`")).schema[0].dataType, T.NumericType)


def _unreadable(raw: DataFrame, mapping: dict[str, str]) -> Column:
    """Is the amount a text that isn't a number as it stands?"""
    if not _is_text(raw, mapping):
        return F.lit(False)
    text = nulled(F.col(f"`{mapping[AMOUNT]}`").cast("string"))
    return text.isNotNull() & F.trim(text).try_cast("double").isNull()


def _reading(raw: DataFrame, mapping: dict[str, str], numeric: bool, drop_nonpositive: bool, day_first: bool) -> list[Column]:
    """The contract columns and ``reason``; ``numeric``: every amount is a number as it stands."""
    kinds = {f.name: f.dataType for f in raw.schema.fields}
    col = lambda name: F.col(f"`{mapping[name]}`")
    customer = stripped(nulled(col(CUSTOMER).cast("string")))
    if isinstance(kinds[mapping[DATE]], (T.TimestampType, T.TimestampNTZType, T.DateType)):
        date: Column = col(DATE).cast("timestamp_ntz")
    else:
        date = parsed_timestamp(stripped(nulled(col(DATE).cast("string"))), day_first)
    amount = parsed_amount(F.trim(nulled(col(AMOUNT).cast("string"))), numeric) if _is_text(raw, mapping) else col(AMOUNT).cast("double")
    reason = (
        F.when(customer.isNull() | customer.isin("", "nan", "None", "NaN"), REASONS[0])
        .when(date.isNull(), REASONS[1])
        .when(amount.isNull() | F.isnan(amount), REASONS[2])
    )
    if drop_nonpositive:
        reason = reason.when(amount <= 0, REASONS[3])
    return [customer.alias(CUSTOMER), date.alias(DATE), amount.alias(AMOUNT), reason.alias("reason")]


def classified(raw: DataFrame, mapping: dict[str, str], drop_nonpositive: bool = True, day_first: bool = False, numeric: bool | None = None) -> DataFrame:
    """The contract columns of every row and ``reason``: why it goes (the first
    that holds), null if it stays.  Whether the amounts are ``numeric`` takes a
    pass over a text column where it isn't known."""
    if numeric is None:
        numeric = not _is_text(raw, mapping) or raw.where(_unreadable(raw, mapping)).isEmpty()
    return raw.select(*_reading(raw, mapping, numeric, drop_nonpositive, day_first))


def normalize_orders(raw: DataFrame, mapping: dict[str, str], drop_nonpositive: bool = True, day_first: bool = False) -> tuple[DataFrame, DataFrame]:
    """(orders under the contract, (reason, n) of what was dropped)."""
    rows = classified(raw, mapping, drop_nonpositive, day_first)
    dropped = rows.where("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))
    return rows.where("reason is null").drop("reason"), dropped


@dataclass(frozen=True)
class IngestResult:
    orders: DataFrame
    column_mapping: dict[str, str]
    preset: str
    rows_in: int
    dropped: dict[str, int]

    @property
    def rows_out(self) -> int:
        return self.rows_in - sum(self.dropped.values())

    @cached_property
    def n_customers(self) -> int:
        return self.orders.agg(F.countDistinct(CUSTOMER)).first()[0]


def from_frame(raw: DataFrame, preset: str | None = None, mapping: dict[str, str] | None = None, drop_nonpositive: bool = True, day_first: bool = False) -> IngestResult:
    """Mapping, then preset, then detection decide the columns."""
    if mapping is not None:
        used, name = dict(mapping), "custom"
    elif preset is not None:
        name = preset.lower()
        if name not in PRESETS:
            raise IngestError(f"Unknown preset {preset!r}; choose from {', '.join(sorted(PRESETS))}")
        used = dict(PRESETS[name])
    else:
        used, name = detect_mapping(raw.columns), "auto"
    missing = [c for c in (CUSTOMER, DATE, AMOUNT) if c not in used]
    if missing:
        raise IngestError(f"Could not map required field(s) {missing} from columns {raw.columns}; give a preset or a map")
    absent = [c for c in used.values() if c not in raw.columns]
    if absent:
        raise IngestError(f"Mapped column(s) {absent} are not present (there are {raw.columns})")
    # one pass counts the reasons of both readings of the amounts and tells which holds
    readings = [_reading(raw, used, n, drop_nonpositive, day_first)[-1].alias(name) for n, name in ((True, "as_numbers"), (False, "as_text"))]
    seen = raw.select(*readings, _unreadable(raw, used).alias("text")).groupBy("as_numbers", "as_text").agg(F.count("*").alias("n"), F.max("text").alias("text")).collect()
    numeric = not any(r.text for r in seen)
    counts: dict[str | None, int] = {}
    for r in seen:
        reason = r.as_numbers if numeric else r.as_text
        counts[reason] = counts.get(reason, 0) + r.n
    rows = classified(raw, used, drop_nonpositive, day_first, numeric)
    dropped = {k: counts[k] for k in REASONS if k in counts}
    if not counts.get(None):
        raise IngestError(f"No valid order rows after cleaning; read {sum(counts.values())}, dropped {dropped}")
    return IngestResult(rows.where("reason is null").drop("reason"), used, name, sum(counts.values()), dropped)


def load_orders(spark: SparkSession, path: str, preset: str | None = None, mapping: dict[str, str] | None = None, drop_nonpositive: bool = True, reader_options: dict | None = None, day_first: bool = False) -> IngestResult:
    """A CSV file or folder as text columns, brought under the contract."""
    try:
        raw = read_csv(spark, path, reader_options)
    except AnalysisException as problem:
        if "PATH_NOT_FOUND" in str(problem):
            raise FileNotFoundError(2, "no such file", path) from problem
        raise
    return from_frame(raw, preset, mapping, drop_nonpositive, day_first)
