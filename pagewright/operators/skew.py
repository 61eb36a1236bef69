"""Joins that survive hot keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most keys that may count as hot; bounds the broadcast of a hot join.
MOST_HOT = 2000


def hot_keys(counts: DataFrame, n: str = "n", share: int = MOST_HOT, least: int = 10_000) -> DataFrame:
    """Rows of counts whose n is above total/share and above least: at most share rows, whatever the data."""
    total = counts.agg(F.coalesce(F.sum(n), F.lit(0)).alias("_total"))
    return counts.where((F.col(n) > least) & (F.col(n) * share > total.scalar()))


def hot_join(big: DataFrame, small: DataFrame, on: str, how: str = "inner", counts: DataFrame | None = None, least: int = 10_000) -> DataFrame:
    """big join small on one column, small having each key once.

    Rows of the few keys that hold a large share of big (at most MOST_HOT of them) meet their partner by a
    broadcast of just those keys, all other rows by an ordinary join; no key gathers in one task.
    counts: (on, n) of big if the caller has it. Null keys match nothing (kept with how='left').
    """
    if counts is None:
        counts = big.where(F.col(on).isNotNull()).groupBy(on).agg(F.count("*").alias("n"))
    hot = hot_keys(counts, least=least).select(on, F.lit(True).alias("_hot"))
    marked = big.join(F.broadcast(hot), on, "left")
    few = small.join(F.broadcast(hot.select(on)), on, "left_semi")
    a = marked.where("_hot").drop("_hot").join(F.broadcast(few), on, how)
    b = marked.where("_hot is null").drop("_hot").join(small, on, how)
    return a.unionByName(b)
