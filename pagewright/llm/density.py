"""Problem 3: clusters of alike fingerprints by density peaks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators.graph import roots
from ..operators.skew import hot_join
from ..session import cut
from .setjoin import classes, feature_sets, meet

#: Similarity from which two records are neighbours.
NEAR = (1, 2)
#: Typical members named for each cluster.
TYPICAL = 3


def densities(recs: DataFrame) -> DataFrame:
    """recs with rho, the local density: the records of similarity >= NEAR, the record itself and all copies counted.

    Neighbours come from the exact blocked join. A neighbour's copies are added up where the pair is met, so only sums
    are shuffled, not pairs.
    """
    pair = meet(recs, *NEAR, carry=("w",))
    each = F.explode(F.array(F.struct(F.col("class_id_a").alias("class_id"), F.col("w_b").alias("m")), F.struct(F.col("class_id_b").alias("class_id"), F.col("w_a").alias("m"))))
    mass = pair.select(each.alias("e")).groupBy("e.class_id").agg(F.sum("e.m").alias("m"))
    return cut(recs.join(mass, "class_id", "left").withColumn("rho", F.col("w") + F.coalesce("m", F.lit(0))).drop("m"), "densities")


def pointers(recs: DataFrame) -> DataFrame:
    """(class_id, p): the nearest denser neighbour of every record that has one; recs with rho.

    Density order is (rho, smaller class_id), so pointers never form a cycle. All records are targets for all others;
    of equally near ones the densest counts, then the smallest class_id. Each pair offers its denser record to the
    other where it is met, and only the best offer is shuffled.
    """
    pair = meet(recs, *NEAR, carry=("rho",))
    a_denser = (F.col("rho_a") > F.col("rho_b")) | ((F.col("rho_a") == F.col("rho_b")) & (F.col("class_id_a") < F.col("class_id_b")))
    pick = lambda c, yes, no: F.when(a_denser, F.col(f"{c}_{yes}")).otherwise(F.col(f"{c}_{no}"))
    sim = F.col("shared") / (F.col("k_a") + F.col("k_b") - F.col("shared"))
    offer = F.struct(sim.alias("sim"), pick("rho", "a", "b").alias("rho"), (-pick("class_id", "a", "b")).alias("minus"))
    best = pair.select(pick("class_id", "b", "a").alias("class_id"), offer.alias("o")).groupBy("class_id").agg(F.max("o").alias("o"))
    return best.select("class_id", (-F.col("o.minus")).alias("p"))


def cluster(features: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, group_id, rho) of every document with more than 5 features, and (group_id, size, typical).

    A record without a denser neighbour is a peak and starts a cluster; all others follow their pointers. group_id
    is the smallest doc_id of the cluster; typical are its densest documents, ties by doc_id; of a set of exact copies
    one speaks for all.
    Null features, ids and repeats don't count; an empty table gives no rows.
    """
    recs, members = classes(feature_sets(features))
    recs = densities(recs)
    ptr = roots(pointers(recs).select(F.col("class_id").alias("v"), "p"))
    label = recs.select("class_id", "w", "rho").join(ptr.select(F.col("v").alias("class_id"), F.col("p").alias("peak")), "class_id", "left")
    label = cut(label.withColumn("peak", F.coalesce("peak", "class_id")), "label")
    size = cut(label.groupBy("peak").agg(F.min("class_id").alias("group_id"), F.sum("w").alias("size"), F.count("*").alias("n")), "groups")
    label = cut(hot_join(label, size, "peak", counts=size.select("peak", "n")).select("class_id", "group_id", "size", "rho"), "label")
    # typical members: best of each salted part, then best of those
    order = [F.desc("rho"), F.asc("class_id")]
    salt = F.pmod(F.xxhash64("class_id"), F.ceil(F.col("size") / 10_000))
    part = label.withColumn("s", salt).withColumn("r", F.row_number().over(W.partitionBy("group_id", "s").orderBy(*order))).where(F.col("r") <= TYPICAL)
    top = part.withColumn("r", F.row_number().over(W.partitionBy("group_id").orderBy(*order))).where(F.col("r") <= TYPICAL)
    info = top.groupBy("group_id", "size").agg(F.array_sort(F.collect_list(F.struct("r", "class_id"))).alias("t"))
    info = info.select("group_id", "size", F.col("t.class_id").alias("typical"))
    docs = hot_join(members.select("id", "class_id"), label.select("class_id", "group_id", "rho"), "class_id")
    return docs.select(F.col("id").alias("doc_id"), "group_id", "rho"), info


def report(features: DataFrame) -> DataFrame:
    """(doc_id, group_id, size, typical) of every document; those with at most 5 features are in noise group 0."""
    docs, info = cluster(features)
    docs = cut(docs, "docs")
    ids = features.select("doc_id").where("doc_id is not null").distinct()
    noise = cut(ids.join(docs, "doc_id", "left_anti"), "noise")
    full = hot_join(docs.select("doc_id", "group_id"), cut(info, "info"), "group_id").select("doc_id", "group_id", "size", "typical")
    size = noise.agg(F.count("*").alias("size"))
    return full.unionByName(noise.select("doc_id", F.lit(0).cast("long").alias("group_id"), size.scalar().alias("size"), F.array().cast("array<bigint>").alias("typical")))


def found(features: DataFrame) -> DataFrame:
    """Documents in clusters of two or more."""
    docs, info = cluster(features)
    docs = cut(docs, "docs")
    return hot_join(docs.select("doc_id", "group_id"), cut(info.where("size > 1").select("group_id"), "info"), "group_id").select("doc_id", "group_id")
