"""A synthetic order table, made where the tasks run."""

from __future__ import annotations

import os
import tempfile
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sinks import write_csv_file

HISTORY_DAYS = 540
#: Products of an invented garden shop and their base prices.
PRODUCTS = [("Trowel", 14.0), ("Seed box", 9.5), ("Watering can", 31.0), ("Pruning shears", 27.0), ("Potting soil 20 l", 12.0), ("Raised bed", 89.0), ("Herb starter", 21.0)]
#: Archetype, share of customers, mean orders, range of days since the last order, spend factor, range of days since the first order.
ARCHETYPES = [
    ("loyal", 0.18, 9.0, (1, 45), 1.3, (60, 540)),
    ("regular", 0.30, 4.0, (1, 90), 1.0, (60, 540)),
    ("one_time", 0.27, 1.0, (1, 400), 0.8, (60, 540)),
    ("lapsed_high", 0.10, 7.0, (200, 460), 1.6, (420, 540)),
    ("new", 0.15, 2.0, (1, 40), 1.0, (0, 60)),
]


def _uniform(seed: int, *keys):
    """0 <= u < 1 from a hash of the row's keys, so any row can be made again."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *keys), 11) / F.lit(float(1 << 53))


def _between(u, low: int, high: int):
    return F.floor(u * (high - low + 1)).cast("int") + low


def _poisson(u, mean: float, most: int = 40):
    """Inverse of the distribution function, as a chain of thresholds."""
    import math

    total, term, out = 0.0, math.exp(-mean), F.lit(0)
    for k in range(most):
        total += term
        term *= mean / (k + 1)
        out = out + (u >= F.lit(total)).cast("int")
    return out


def generate_orders(spark: SparkSession, n_customers: int = 900, seed: int = 42, end_date: date | datetime | None = None) -> DataFrame:
    """order_id, customer_id, order_date (text), amount, product, quantity."""
    end = F.lit((end_date or date(2024, 12, 31)).strftime("%Y-%m-%d")).cast("date")
    ends, kinds, at = [], [], 0
    for kind in ARCHETYPES:
        at += int(round(n_customers * kind[1]))
        ends.append(at)
        kinds.append(kind)
    c = F.col("id")

    def pick(value):
        out = None
        for stop, kind in zip(ends, kinds, strict=True):
            out = F.when(c < stop, value(kind)) if out is None else out.when(c < stop, value(kind))
        return out

    people = spark.range(at).select(
        c,
        F.greatest(pick(lambda k: _poisson(_uniform(seed, c, F.lit("n")), k[2])), F.lit(1)).alias("n"),
        pick(lambda k: _between(_uniform(seed, c, F.lit("last")), *k[3])).alias("_last"),
        pick(lambda k: _between(_uniform(seed, c, F.lit("first")), *k[5])).alias("_first"),
        pick(lambda k: F.lit(k[4])).alias("factor"),
    ).select("id", "n", "factor", F.greatest("_first", "_last").alias("first"), F.least("_first", "_last").alias("last"))
    lines = people.select("*", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("k"))
    u = lambda name: _uniform(seed, c, F.col("k"), F.lit(name))
    ago = F.when(F.col("n") == 1, F.col("last")).when(F.col("k") == 1, F.col("first")).when(F.col("k") == F.col("n"), F.col("last")).otherwise(F.col("last") + F.floor(u("day") * (F.col("first") - F.col("last") + 1)))
    product = F.element_at(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(p).alias("price")) for n, p in PRODUCTS]), _between(u("product"), 1, len(PRODUCTS)))
    quantity = F.least(F.lit(5), F.lit(1) + F.floor(F.log(F.lit(1.0) - u("quantity")) / F.log(F.lit(0.4))).cast("int"))
    noise = F.lit(1.0) + F.lit(0.12) * F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - u("r"))) * F.cos(F.lit(6.283185307179586) * u("a"))
    made = lines.select("id", "k", "factor", F.date_format(F.date_sub(end, ago.cast("int")), "yyyy-MM-dd").alias("order_date"), product.alias("p"), quantity.alias("quantity"), noise.alias("noise"))
    return made.select(
        F.format_string("ORD%06d-%02d", F.col("id") + 1, F.col("k")).alias("order_id"),
        F.format_string("customer%05d@example.com", F.col("id") + 1).alias("customer_id"),
        "order_date",
        F.round(F.col("p.price") * F.col("quantity") * F.col("factor") * F.greatest("noise", F.lit(0.4)), 2).alias("amount"),
        F.col("p.name").alias("product"),
        "quantity",
    ).orderBy("order_date", "order_id")


def write_sample(spark: SparkSession, path: str, **options) -> str:
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    return write_csv_file(generate_orders(spark, **options), path)


def sample_path(n_customers: int, seed: int) -> str:
    """Where the command line keeps a sample that no path was named for."""
    return os.path.join(tempfile.gettempdir(), "tallywick", f"sample_orders_{n_customers}_{seed}.csv")
