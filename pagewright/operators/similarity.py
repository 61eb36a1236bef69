"""Weighted similarity of feature sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import cut, drop
from .skew import hot_join

BLOCK = 4_000


def totals(features: DataFrame) -> DataFrame:
    """(id, total, n): weight and number of features of each record."""
    return features.groupBy("id").agg(F.sum("weight").alias("total"), F.count("*").alias("n"))


def coded(features: DataFrame) -> DataFrame:
    """features (a table of their own) with whole numbers as features: equal ones for equal names, different ones for different names.

    The numbers are 64-bit hashes. A second hash tells whether two names share one; then all are hashed anew with
    another salt, until none do.
    """
    salt = 0
    while True:
        both = [F.xxhash64(F.lit(salt), "feature").alias("feature"), F.xxhash64("feature", F.lit(salt)).alias("check")]
        out = cut(features.select(*[c for c in features.columns if c != "feature"], *both), "coded")
        if out.groupBy("feature").agg(F.min("check").alias("x"), F.max("check").alias("y")).where("x <> y").isEmpty():
            return out
        drop(out)
        salt += 1


def code(features: DataFrame) -> Column:
    """Whole numbers for the features of a lazy plan, as coded gives to those of a table: different ones for different names."""
    salt = 0
    while True:
        number = F.xxhash64(F.lit(salt), "feature").alias("feature")
        both = features.select(number, F.xxhash64("feature", F.lit(salt)).alias("check"))
        shared = cut(both.groupBy("feature").agg(F.min("check").alias("x"), F.max("check").alias("y")).where("x <> y"), "shared")
        apart = shared.isEmpty()
        drop(shared)
        if apart:
            return number
        salt += 1


def pair_overlaps(
    features: DataFrame, num: int, den: int, block: int = BLOCK, across: str | None = None, either: str | None = None, low: str | None = None, least: str | None = None
) -> DataFrame:
    """(a, b, shared, total_a, total_b), a < b: pairs whose shared weight reaches num/den of their mean weight.

    across: a boolean column that divides the records; only pairs of a false one (a) and a true one (b) are formed.
    either: a boolean column that is true for at least one record of each pair formed.
    low, least: columns low <= weight and least <= low. Totals are then sums of low, and least is the smallest low that
    any record has for the feature.

    features: (id, feature, weight), one row for each feature of a record. Score 2 * shared / (total_a + total_b).
    A pair that reaches num/den shares at least num/(2 den - num) of either side's weight, so only the rarest features
    that leave less than this behind are join keys (weighted prefix filter); long lists of one feature are cut into
    blocks. A pair meets at the rarest feature it has in common, so the weights from there on must suffice (positional
    filter). All weights then count in the exact sum.
    """
    lows = [F.col(low or "weight").alias("low"), F.col(least or low or "weight").alias("least")]
    f0 = cut(features.select("id", "feature", "weight", *lows, (F.lit(False) if across is None else F.col(across)).alias("side"), (F.lit(True) if either is None else F.col(either)).alias("asks")), "weighted")
    counts = cut(f0.groupBy("feature").agg(F.count("*").alias("n")), "counts")
    w = W.partitionBy("id").orderBy(F.desc("df"), F.desc("feature"))
    all_of = W.partitionBy("id")
    f = hot_join(f0, counts.select("feature", F.col("n").alias("df")), "feature", counts=counts)
    f = f.withColumn("behind", F.sum("weight").over(w.rowsBetween(W.unboundedPreceding, 0))).withColumn("total", F.sum("low").over(all_of))
    # what the partner's low weights may lack of the shared weight is no more than what this record's least weights lack
    f = f.withColumn("need", F.col("total") - F.sum(F.col("weight") - F.col("least")).over(all_of))
    p0 = cut(f.where((F.col("df") > 1) & (F.col("behind") * (2 * den - num) >= F.col("need") * num)).select("id", "feature", "behind", "total", "side", "asks"), "ranked")
    # every list longer than a block is divided, whatever its share of all rows
    long = cut(p0.groupBy("feature").agg(F.count("*").alias("n")).where(F.col("n") > block), "lists")
    parts = long.select("feature", F.ceil(F.col("n") / block).cast("int").alias("nb"))
    p = hot_join(p0, parts, "feature", "left", counts=long).withColumn("nb", F.coalesce("nb", F.lit(1)))
    left, right = (p.where("asks"), p) if across is None else (p.where("not side"), p.where("side"))
    a = left.select("feature", F.pmod(F.xxhash64("id"), "nb").cast("int").alias("blk"), F.col("id").alias("a"), F.col("total").alias("ta"), F.col("behind").alias("behind_a"), F.col("asks").alias("asks_a"))
    b = right.withColumn("blk", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).select("feature", "blk", F.col("id").alias("b"), F.col("total").alias("tb"), F.col("behind").alias("behind_b"), F.col("asks").alias("asks_b"))
    once = (F.col("asks_a") | F.col("asks_b")) if across else (F.col("a") < F.col("b")) | (~F.col("asks_b") & (F.col("a") != F.col("b")))
    fits = (2 * den * F.least("behind_a", "behind_b") >= num * (F.col("ta") + F.col("tb"))) & once
    ends = [F.col("a"), F.col("b")] if across else [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]
    pairs = cut(a.join(b, ["feature", "blk"]).where(fits).select(*ends).distinct(), "candidates")
    drop(p0, long, counts)
    # only the sets of candidates are looked up
    ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    sets = f0.join(ids, "id", "left_semi").groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("feature", "weight"))).alias("m"), F.sum("low").alias("total"))
    sets = cut(sets, "sets")
    drop(f0)
    x = sets.select(F.col("id").alias("a"), F.col("m").alias("ma"), F.col("total").alias("total_a"))
    y = sets.select(F.col("id").alias("b"), F.map_keys("m").alias("kb"), F.col("total").alias("total_b"))
    shared = F.aggregate(F.array_intersect(F.map_keys("ma"), "kb"), F.lit(0).cast("long"), lambda s, k: s + F.element_at("ma", k))
    got = pairs.join(x, "a").join(y, "b").withColumn("shared", shared)
    got = cut(got.where(F.col("shared") * 2 * den >= (F.col("total_a") + F.col("total_b")) * num).select("a", "b", "shared", "total_a", "total_b"), "overlaps")
    drop(pairs, sets)
    return got


def similarity_pairs(features: DataFrame, num: int = 83, den: int = 100) -> DataFrame:
    """(a, b, score) of record pairs with score >= num/den; each record's own contributions are 1."""
    p = pair_overlaps(features, num, den)
    return p.select("a", "b", (2 * F.col("shared") / (F.col("total_a") + F.col("total_b"))).alias("score"))


def contributions(features: DataFrame, assigned: DataFrame) -> DataFrame:
    """(cluster_id, feature, weight, df, n): how many of a cluster's n documents hold each feature.

    assigned: (id, cluster_id). The contribution of a feature is df / n.
    """
    size = assigned.groupBy("cluster_id").agg(F.count_distinct("id").alias("n"))
    df = features.join(assigned.distinct(), "id").groupBy("cluster_id", "feature").agg(F.count_distinct("id").alias("df"), F.max("weight").alias("weight"))
    return df.join(size, "cluster_id").select("cluster_id", "feature", "weight", "df", "n")


def cluster_scores(features: DataFrame, clusters: DataFrame, num: int, den: int) -> DataFrame:
    """(id, cluster_id, score) >= num/den of documents against clusters with contributions df / n.

    clusters: (cluster_id, feature, weight, df, n). Contributions are at most 1, so the shared weight must reach the
    threshold alone: the weighted prefix filter finds every candidate. The compare is done in whole numbers.
    """
    tag = lambda df, c, t: df.select(F.concat(F.lit(t), F.col(c).cast("string")).alias("id"), "feature", "weight", F.lit(t == "d").alias("is_doc"))
    both = tag(features, "id", "d").unionByName(tag(clusters, "cluster_id", "c"))
    near = pair_overlaps(both, num, den, across="is_doc")
    near = near.select(F.expr("cast(substr(a, 2) as bigint)").alias("cluster_id"), F.expr("cast(substr(b, 2) as bigint)").alias("id"), F.col("total_a").alias("wc"), F.col("total_b").alias("wd"))
    s = near.join(features.select("id", "feature"), "id").join(clusters, ["cluster_id", "feature"])
    s = s.groupBy("id", "cluster_id", "wc", "wd", "n").agg(F.sum(F.col("weight") * F.col("df")).alias("s"))
    s = s.where(2 * den * F.col("s") >= num * F.col("n") * (F.col("wc") + F.col("wd")))
    return s.select("id", "cluster_id", (2 * F.col("s") / (F.col("n") * (F.col("wc") + F.col("wd")))).alias("score"))


def soft_matches(a: DataFrame, b: DataFrame, tolerance: float = 5.0) -> DataFrame:
    """(a, feature_a, b, feature_b): position and size features whose values lie within the tolerance.

    a, b: (id, feature, value). The name of b must hold the part of a's name before its first underscore. A band
    join on buckets of the tolerance's width: each row of a meets the buckets beside its own.
    """
    kind = lambda c: F.substring_index(c, "_", 1)
    x = a.where("value is not null").select(F.col("id").alias("a"), F.col("feature").alias("feature_a"), F.col("value").alias("va"), kind("feature").alias("kind"))
    x = x.withColumn("bucket", F.explode(F.array(*[F.floor(F.col("va") / tolerance) + i for i in (-1, 0, 1)])))
    y = b.where("value is not null").select(F.col("id").alias("b"), F.col("feature").alias("feature_b"), F.col("value").alias("vb"), F.floor(F.col("value") / tolerance).alias("bucket"))
    # the kinds of a are few; each name of b is told once which of them it holds, and the kind joins the key
    kinds = x.select("kind").distinct()
    names = y.select("feature_b").distinct().join(kinds, F.col("feature_b").contains(F.col("kind")))
    y = y.join(names, "feature_b")
    return x.join(y, ["kind", "bucket"]).where(F.abs(F.col("va") - F.col("vb")) <= tolerance).select("a", "feature_a", "b", "feature_b")


def soft_match_counts(features: DataFrame, tolerance: float = 5.0) -> DataFrame:
    """(a, others, matches): with how many others each record has soft matches (soft_matches), and how many; none without.

    features: (id, feature, value), each feature of a record once. Records with the same features and values are one
    class, and pairs of classes are only counted: no pair of records or classes is shuffled. A pair of classes counts
    once, at the first of their features that match.
    """
    p = features.where("value is not null").withColumn("kind", F.substring_index("feature", "_", 1)).where("value = value")
    by = cut(p.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("kind", "feature", "value"))).alias("fs")), "points")
    c = cut(by.groupBy("fs").agg(F.min("id").alias("c"), F.count("*").alias("n")), "classes")
    rows = lambda x: c.select("c", "n", "fs", F.posexplode("fs").alias("at", "x")).select(F.col("c").alias(x), F.col("n").alias(f"n_{x}"), F.col("fs").alias(f"fs_{x}"), F.col("at").alias(f"at_{x}"), F.col("x").alias(f"x_{x}"))
    x = rows("a").withColumn("kind", F.col("x_a.kind")).withColumn("bucket", F.explode(F.array(*[F.floor(F.col("x_a.value") / tolerance) + i for i in (-1, 0, 1)])))
    y = rows("b").withColumn("bucket", F.floor(F.col("x_b.value") / tolerance))
    # the kinds are few; each name is told once which of them it holds, and the kind joins the key
    names = y.select("x_b.feature").distinct().join(x.select("kind").distinct(), F.col("feature").contains(F.col("kind")))
    y = y.join(names, y["x_b.feature"] == names["feature"]).drop("feature")
    like = lambda v, w: (F.abs(v["value"] - w["value"]) <= tolerance) & w["feature"].contains(v["kind"])
    met = x.join(y, ["kind", "bucket"]).where(like(F.col("x_a"), F.col("x_b")))
    upto = lambda s: F.slice(f"fs_{s}", F.lit(1), F.col(f"at_{s}"))
    earlier = F.exists(upto("a"), lambda v: F.exists("fs_b", lambda w: like(v, w))) | F.exists(upto("b"), lambda w: like(F.col("x_a"), w))
    # a class meets its own members too: all but the record itself are others
    n = met.groupBy("a").agg(
        F.sum(F.when(~earlier, F.col("n_b")).otherwise(0)).alias("others"), F.sum("n_b").alias("matches"), F.sum(F.when(F.col("a") == F.col("b"), 1).otherwise(0)).alias("own")
    )
    n = n.select("a", (F.col("others") - F.when(F.col("own") > 0, 1).otherwise(0)).alias("others"), (F.col("matches") - F.col("own")).alias("matches")).where("others > 0")
    n = c.join(n, c["c"] == n["a"]).select("fs", "others", "matches")
    return by.join(n, "fs").select(F.col("id").alias("a"), "others", "matches")


def size_ratio_filter(pairs: DataFrame, sizes: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) whose feature counts have a ratio of at least num/den; sizes: (id, n). A lossy shortcut, off by default."""
    p = pairs.join(sizes.select(F.col("id").alias("a"), F.col("n").alias("na")), "a").join(sizes.select(F.col("id").alias("b"), F.col("n").alias("nb")), "b")
    return p.where(F.least("na", "nb") * den >= F.greatest("na", "nb") * num).select(*pairs.columns, "na", "nb")
