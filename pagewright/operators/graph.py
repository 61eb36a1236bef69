"""Connected components of an undirected graph by contraction to local minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .skew import hot_join

#: A pointer table of at most so many rows (two longs each) is broadcast, a larger one shuffled.
BROADCAST_ROWS = 200_000


def _lookup(df: DataFrame, key: str, ptr: DataFrame, rows: int, out: str) -> DataFrame:
    """df[key] -> ptr.p as column out; key itself where ptr has no row.

    A large pointer table meets df by a join that takes hot keys apart: a giant component's root is pointed at by most rows.
    """
    right = ptr.select(F.col("v").alias("_v"), F.col("p").alias("_p"))
    if rows <= BROADCAST_ROWS:
        got = df.join(F.broadcast(right), df[key] == right["_v"], "left")
    else:
        got = hot_join(df.withColumn("_v", F.col(key)), right, "_v", "left")
    return got.withColumn(out, F.coalesce("_p", key)).drop("_v", "_p")


def tidy_edges(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Distinct undirected edges (a < b) without loops and nulls."""
    return (
        edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
        .where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
        .distinct()
    )


def roots(ptr: DataFrame) -> DataFrame:
    """Follow pointers (v -> p, p <= v or an order without cycles) to their ends by doubling."""
    ptr = cut(ptr, "ptr")
    rows = ptr.count()
    while True:
        nxt = cut(_lookup(ptr, "p", ptr, rows, "q").select("v", "p", "q"), "ptr")
        moved = not nxt.where("p <> q").isEmpty()
        ptr = nxt.select("v", F.col("q").alias("p"))
        if not moved:
            return ptr


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(v, label): each vertex of the edges with the smallest id of its component.

    Each round every vertex points to its smallest neighbour, chains of pointers are doubled to their ends,
    and the graph is contracted to those ends. Only local minima survive a round, so the rounds grow with the
    logarithm of the longest path, not with its length. Null ends and loops are dropped; no edges give no rows.
    """
    e = cut(tidy_edges(edges, a, b), "edges")
    label = None
    while not e.isEmpty():
        both = e.select(F.col("a").alias("v"), F.col("b").alias("u")).unionByName(e.select(F.col("b").alias("v"), F.col("a").alias("u")))
        ptr = roots(both.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("v", "m").alias("p")))
        rows = ptr.count()
        if label is None:
            label = ptr.select("v", F.col("p").alias("label"))
        else:
            label = cut(_lookup(label, "label", ptr, rows, "q").select("v", F.col("q").alias("label")), "label")
        e = _lookup(_lookup(e, "a", ptr, rows, "x"), "b", ptr, rows, "y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        e = cut(e.where("a <> b").distinct(), "edges")
    if label is None:
        return e.select(F.col("a").alias("v"), F.col("b").alias("label"))
    return label
