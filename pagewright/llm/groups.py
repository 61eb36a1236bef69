"""Problem 4: one group id for everything linked directly or through others."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import BROADCAST_ROWS, connected_components, tidy_edges
from ..session import cut

#: Score from which a pair links.
LINK = 0.8
#: Frontier rounds before what is reached is contracted and handed to the propagation.
ROUNDS = 6


def latest_links(pairs: DataFrame, least: float = LINK) -> DataFrame:
    """(a, b) with a < b whose latest score is at least `least`.

    Order of the two ids does not matter; loops and null ids are dropped; a null or NaN score never links but
    does replace an earlier one; a null scored_at is oldest; of equal times the lower score counts.
    """
    s = F.when(F.isnan("score"), None).otherwise(F.col("score"))
    key = F.struct("scored_at", F.coalesce(-s, F.lit(float("inf"))).alias("neg"))
    return (
        pairs.where("cluster_a is not null and cluster_b is not null and cluster_a <> cluster_b")
        .select(F.least("cluster_a", "cluster_b").alias("a"), F.greatest("cluster_a", "cluster_b").alias("b"), key.alias("k"))
        .groupBy("a", "b").agg(F.max("k").alias("k"))
        .where(-F.col("k.neg") >= least).select("a", "b")
    )


def _semi(df: DataFrame, key: str, ids: DataFrame, rows: int, how: str) -> DataFrame:
    """Semi or anti join on one key; the id table is broadcast only when it is counted to be small."""
    right = ids.select(F.col("v").alias(key))
    return df.join(F.broadcast(right) if rows <= BROADCAST_ROWS else right, key, how)


def group_ids(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = ROUNDS) -> DataFrame:
    """(v, label): every vertex of edges with the smallest id of its component.

    From the vertex of highest degree (smallest id of ties) frontier joins reach out breadth first. If they
    exhaust its component within `rounds` joins, it is anti-joined away whole. If not (a long chain hangs on
    it), what is reached is contracted into the start vertex, which again takes part in the edges that leave it.
    The remaining edges go to minimum propagation, which doubles its pointers, so chains take a logarithmic
    number of rounds. No edges: no rows.
    """
    e = cut(tidy_edges(edges, a, b), "edges")
    both = cut(e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).select(F.col("a").alias("v"), F.col("b").alias("u")), "both")
    top = both.groupBy("v").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "v").limit(1).select("v")
    seen = frontier = cut(top, "seen")
    rows = seen.count()
    if not rows:
        return both.select("v", F.col("u").alias("label"))
    for _ in range(rounds):
        reached = _semi(both, "v", frontier, rows, "left_semi").select(F.col("u").alias("v")).distinct()
        frontier = cut(reached.join(seen, "v", "left_anti"), "frontier")
        rows = frontier.count()
        if not rows:
            break
        seen = cut(seen.unionByName(frontier), "seen")
    n = seen.count()
    start = seen.agg(F.min("v").alias("start"))  # the smallest reached id stands for all that is reached
    rest = _semi(_semi(e, "a", seen, n, "left_anti"), "b", seen, n, "left_anti")
    if rows:
        out = both.join(F.broadcast(seen) if n <= BROADCAST_ROWS else seen, "v", "left_semi")
        out = out.withColumnRenamed("v", "w").withColumnRenamed("u", "v").join(F.broadcast(seen) if n <= BROADCAST_ROWS else seen, "v", "left_anti")
        rest = rest.unionByName(out.select("v").distinct().select(start.scalar().alias("a"), F.col("v").alias("b")))
    small = connected_components(rest)
    if not rows:
        return seen.select("v", start.scalar().alias("label")).unionByName(small)
    # the label of the contracted vertex holds for all that was reached
    up = small.where(F.col("v") == start.scalar()).select("label")
    giant = seen.select("v", F.coalesce(up.scalar(), start.scalar()).alias("label"))
    return giant.unionByName(small.join(seen, "v", "left_anti"))


def found(pairs: DataFrame) -> DataFrame:
    return group_ids(latest_links(pairs)).select(F.col("v").alias("cluster_id"), F.col("label").alias("group_id"))
