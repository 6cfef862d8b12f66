"""Quantile scores of row ranks.

The rank is 1..n with ties in order of id as text.  Bin edges are the linear
quantiles of 1..n, so they follow from (n, bins) alone: at most bins - 1 ranks of
each value.  The (value, id) pairs at these ranks are found by counting, for all
scores in the same passes, and a row's score follows from comparing it with them:
no row is sorted, numbered or dealt out again.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.selection import Selector, key_of, kept, nth_texts

#: Rows of a range that may reach the driver; larger ones are counted again.
PART_ROWS = 1 << 16


def interior_edges(n: int, bins: int) -> list[float]:
    """Linear quantile edges of the ranks 1..n between the bins."""
    out = []
    step = 1.0 / bins
    for k in range(1, bins):
        v = (n - 1) * (k * step * 100 / 100)
        low = math.floor(v)
        part, a, b = v - low, low + 1, min(low + 2, n)
        out.append(b - (b - a) * (1 - part) if part >= 0.5 else a + (b - a) * part)
    return out


def cut_ranks(n: int, bins: int) -> list[int]:
    """The least rank above each interior edge."""
    return [math.floor(edge) + 1 for edge in interior_edges(n, bins)]


def with_scores(df: DataFrame, wanted: list[tuple[str, str, bool]], bins: int = 5, tie: str = "customer_id") -> DataFrame:
    """Adds scores from 1 to ``bins`` for several (value, out, ascending);
    ``ascending``: more is better.  Too few rows or a constant column give everyone
    the middle score, never inverted.  Nulls rank first."""
    if bins < 2:
        raise ValueError("there must be two bins at least")
    values = [v for v, _, _ in wanted]
    keys = {v: f"_key{k}" for k, v in enumerate(values)}
    narrow = df.select(F.col(f"`{tie}`").cast("string").alias("_tie"), *[key_of(df, v).alias(keys[v]) for v in keys])
    with kept(narrow) as rows:
        n = rows.count()
        found = Selector(rows, list(keys.values()), PART_ROWS)
        ranks, cuts = [], []
        for v in values:
            nulls = n - found.count(keys[v])
            lo, hi = found.extent.get(list(keys).index(v), (0, 0, 0))[1:]
            if n < bins or nulls == n or (lo == hi and not nulls):
                continue
            for rank in cut_ranks(n, bins):
                cuts.append((v, rank - 1, nulls))
                if rank - 1 >= nulls:
                    ranks.append((keys[v], rank - 1 - nulls))
        places = iter(found.places(ranks)) if ranks else iter(())
        at = [(v, next(places), rank - nulls) if rank >= nulls else (v, None, rank) for v, rank, nulls in cuts]
        # rows of one value are told apart by the tie
        straddling = [(keys[v], p.value if p else None, rank - p.less if p else rank, p.equal if p else n - found.count(keys[v])) for v, p, rank in at]
        ties = nth_texts(rows, "_tie", list(keys.values()), straddling, PART_ROWS) if straddling else []
    for value, out, ascending in wanted:
        steps = [(p, t) for (v, p, _), t in zip(at, ties, strict=True) if v == value]
        if not steps:
            df = df.withColumn(out, F.lit((bins + 1) // 2))
            continue
        key, text, score = key_of(df, value), F.col(f"`{tie}`").cast("string"), F.lit(1)
        for p, t in steps:
            above = (key > F.lit(p.value)) | ((key == F.lit(p.value)) & (text >= F.lit(t))) if p else key.isNotNull() | (text >= F.lit(t))
            score = score + F.coalesce(above, F.lit(False)).cast("int")
        df = df.withColumn(out, score if ascending else F.lit(bins + 1) - score)
    return df


def with_score(df: DataFrame, value: str, out: str, bins: int = 5, ascending: bool = True, tie: str = "customer_id") -> DataFrame:
    """:func:`with_scores` for one value."""
    return with_scores(df, [(value, out, ascending)], bins, tie)
