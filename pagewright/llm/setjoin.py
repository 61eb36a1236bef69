"""Problem 5: all similar pairs of set-valued records by a prefix-filtered join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.norm import feature_key
from ..operators.skew import hot_join
from ..session import cut

#: Rows of one token that one task compares with each other; longer lists are cut into blocks.
BLOCK = 4_000
#: Members of a class that one key expands; larger classes are divided.
EXPAND = 1_000
#: Similarity (shared / different features) of a pair, and the features a record must exceed.
SIMILAR, MORE_THAN = (3, 4), 5


def feature_sets(features: DataFrame, clusters: DataFrame | None = None, more_than: int = MORE_THAN) -> DataFrame:
    """(id, is_cluster, feats): sorted distinct features of each document (and cluster) that has more than more_than.

    Features are compared without letter case and outer white space; null features and ids don't count. Rows of
    one id are united.
    """
    one = features.select(F.col("doc_id").alias("id"), F.lit(False).alias("is_cluster"), feature_key("feature").alias("f"))
    if clusters is not None:
        c = clusters.select(F.col("cluster_id").alias("id"), F.explode("features").alias("feature"))
        one = one.unionByName(c.select("id", F.lit(True).alias("is_cluster"), feature_key("feature").alias("f")))
    return (
        one.where("id is not null and f is not null")
        .groupBy("id", "is_cluster").agg(F.array_sort(F.collect_set("f")).alias("feats"))
        .where(F.size("feats") > more_than)
    )


def classes(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records with the same set form a class. Returns (class_id, toks, k, lead, w) and (id, is_cluster, class_id).

    class_id is the smallest id of the class, w its number of members, k the size of its set. toks are the ranks of its
    features by rarity over all classes, ascending, so a prefix of toks is the rarest part of the set; the lead features
    that no other class has come first of all, can never be shared and are only counted. Copies are folded before
    anything is compared: a group of copies costs one record however large it is.
    """
    sets = cut(sets.withColumn("h", F.sha2(F.concat_ws("\x1f", "feats"), 256)), "sets")
    by = sets.groupBy("h").agg(F.min("id").alias("class_id"), F.count("*").alias("w"), F.first("feats").alias("feats"))
    by = cut(by, "classes")
    long = by.select("class_id", F.explode("feats").alias("f"))
    counts = cut(long.groupBy("f").agg(F.count("*").alias("n")).where("n > 1"), "counts")
    # a global sort numbers the features by rarity; the written table keeps the numbers if a task is lost
    ranks = cut(counts.orderBy("n", "f").withColumn("tok", F.monotonically_increasing_id()).select("f", "tok"), "ranks")
    toks = hot_join(long, ranks, "f", counts=counts).groupBy("class_id").agg(F.array_sort(F.collect_list("tok")).alias("toks"))
    recs = by.select("class_id", "w", F.size("feats").alias("k")).join(toks, "class_id", "left")
    recs = recs.withColumn("toks", F.coalesce("toks", F.array().cast("array<bigint>"))).withColumn("lead", F.col("k") - F.size("toks"))
    members = hot_join(sets.select("id", "is_cluster", "h"), by.select("h", "class_id"), "h").select("id", "is_cluster", "class_id")
    return cut(recs, "records"), cut(members, "members")


def prefixes(recs: DataFrame, num: int, den: int, carry: tuple[str, ...] = ()) -> DataFrame:
    """(tok, at, class_id, k, lead, toks, carried columns): the tokens, at place `at` of toks, under which a record can first meet a partner of similarity num/den."""
    keep = F.col("k") - F.ceil(F.col("k") * F.lit(num) / F.lit(den)).cast("int") + 1 - F.col("lead")
    rows = recs.where(F.size("toks") > 0)
    return rows.select("class_id", "k", "lead", "toks", *carry, F.posexplode(F.slice("toks", F.lit(1), F.greatest(keep, F.lit(0)))).alias("at", "tok"))


def meet(recs: DataFrame, num: int = SIMILAR[0], den: int = SIMILAR[1], block: int = BLOCK, carry: tuple[str, ...] = ()) -> DataFrame:
    """Every pair of classes with shared/(ka+kb-shared) >= num/den, once: class_id_a, class_id_b, k_a, k_b, shared, carried columns.

    Prefix filter: only the rarest tokens, as many as the threshold asks for, are join keys. Length filter: no
    partner shorter than num/den. Positional filter: the tokens still to come must suffice. A pair is verified
    once, at its first common token, by exact overlap. Every token list of more than `block` rows, whatever its share
    of all rows, is cut into blocks that meet pairwise in tasks of their own, so no token gathers in one task; no
    list is capped. The sets travel with their prefix rows: a pair is verified where it is met and never leaves its
    task unless the caller writes it, so aggregates over pairs combine before any shuffle.
    """
    p = prefixes(recs, num, den, carry)
    long = cut(p.groupBy("tok").agg(F.count("*").alias("n")).where(F.col("n") > block), "lists")
    parts = long.select("tok", F.ceil(F.col("n") / F.lit(block)).cast("int").alias("nb"))
    p = cut(hot_join(p, parts, "tok", "left", counts=long).withColumn("nb", F.coalesce("nb", F.lit(1))), "prefix")
    cols = ["class_id", "k", "lead", "at", "toks", *carry]
    mine = F.pmod(F.xxhash64("class_id"), F.col("nb")).cast("int")
    a = p.select("tok", mine.alias("blk"), *[F.col(c).alias(f"{c}_a") for c in cols])
    b = p.withColumn("blk", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    b = b.select("tok", "blk", *[F.col(c).alias(f"{c}_b") for c in cols])
    need = F.ceil((F.col("k_a") + F.col("k_b")) * F.lit(num) / F.lit(num + den)).cast("int")
    before = lambda s: F.slice(f"toks_{s}", F.lit(1), F.col(f"at_{s}"))
    left = lambda s: F.col(f"k_{s}") - F.col(f"lead_{s}") - F.col(f"at_{s}")
    # each unordered pair once: the shorter record (smaller id of ties) is a
    near = (
        ((F.col("k_a") < F.col("k_b")) | ((F.col("k_a") == F.col("k_b")) & (F.col("class_id_a") < F.col("class_id_b"))))
        & (F.col("k_a") * den >= F.col("k_b") * num)
        & (F.least(left("a"), left("b")) >= need)
    )
    return (
        a.join(b, (a["tok"] == b["tok"]) & (a["blk"] == b["blk"]) & near)
        .where((F.col("at_a") == 0) | (F.col("at_b") == 0) | ~F.arrays_overlap(before("a"), before("b")))
        .withColumn("shared", F.size(F.array_intersect("toks_a", "toks_b")))
        .where(F.col("shared") >= need)
        .select("class_id_a", "class_id_b", "k_a", "k_b", "shared", *[f"{c}_{s}" for c in carry for s in "ab"])
    )


def similar_classes(recs: DataFrame, num: int = SIMILAR[0], den: int = SIMILAR[1], block: int = BLOCK) -> DataFrame:
    """(a, b, shared, ka, kb), a < b: all pairs of classes of similarity num/den."""
    first = F.col("class_id_a") < F.col("class_id_b")
    return meet(recs, num, den, block).select(
        F.least("class_id_a", "class_id_b").alias("a"), F.greatest("class_id_a", "class_id_b").alias("b"), "shared",
        F.when(first, F.col("k_a")).otherwise(F.col("k_b")).alias("ka"), F.when(first, F.col("k_b")).otherwise(F.col("k_a")).alias("kb"),
    )


def links(features: DataFrame, clusters: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The whole join in compact form: similar class pairs (a, b, similarity), and membership (id, is_cluster, class_id)."""
    recs, members = classes(feature_sets(features, clusters))
    s = similar_classes(recs).select("a", "b", (F.col("shared") / (F.col("ka") + F.col("kb") - F.col("shared"))).alias("similarity"))
    return cut(s, "links"), members


def summary(features: DataFrame, clusters: DataFrame | None = None) -> DataFrame:
    """(id, class_id, copies, similar): per record its class, the other members of it and the similar records outside it."""
    s, members = links(features, clusters)
    size = cut(members.groupBy("class_id").agg(F.count("*").alias("w")), "sizes")
    both = s.select("a", "b").unionByName(s.select(F.col("b").alias("a"), F.col("a").alias("b")))
    n = hot_join(both, size.withColumnRenamed("class_id", "b"), "b").groupBy("a").agg(F.sum("w").alias("similar"))
    per = size.join(n, size["class_id"] == n["a"], "left").select("class_id", (F.col("w") - 1).alias("copies"), F.coalesce("similar", F.lit(0)).alias("similar"))
    return hot_join(members, per, "class_id").select("id", "class_id", "copies", "similar")


def parted(members: DataFrame, block: int = EXPAND) -> DataFrame:
    """members with nb, into how many parts of about `block` members its class is divided, and part."""
    size = cut(members.groupBy("class_id").agg(F.count("*").alias("n"), F.ceil(F.count("*") / F.lit(block)).cast("int").alias("nb")), "sizes")
    got = hot_join(members, size.select("class_id", "nb"), "class_id", counts=size)
    return cut(got.withColumn("part", F.pmod(F.xxhash64("id"), F.col("nb")).cast("int")), "parted")


def expand(pairs: DataFrame, members: DataFrame, block: int = EXPAND) -> DataFrame:
    """(x, xc, y, yc): members of the two classes of each pair (a, b); a = b asks for the pairs within a class, x < y.

    The parts of the two sides meet pairwise under keys of their own, so no key gives more than about block ** 2 rows.
    """
    m = parted(members, block)
    nb = m.groupBy("class_id").agg(F.first("nb").alias("nb"))
    parts = lambda c, to: nb.select(F.col("class_id").alias(c), F.sequence(F.lit(0), F.col("nb") - 1).alias(to))
    p = pairs.join(parts("a", "pa"), "a").join(parts("b", "pb"), "b").withColumn("part_a", F.explode("pa")).withColumn("part_b", F.explode("pb")).drop("pa", "pb")
    x = m.select(F.col("class_id").alias("a"), F.col("part").alias("part_a"), F.col("id").alias("x"), F.col("is_cluster").alias("xc"))
    y = m.select(F.col("class_id").alias("b"), F.col("part").alias("part_b"), F.col("id").alias("y"), F.col("is_cluster").alias("yc"))
    got = p.join(x, ["a", "part_a"]).join(y, ["b", "part_b"])
    return got.where((F.col("a") != F.col("b")) | (F.col("x") < F.col("y"))).select("x", "xc", "y", "yc")


def found(features: DataFrame, clusters: DataFrame) -> DataFrame:
    """All pairs (id_a < id_b) of similarity >= 3/4, two documents or a cluster and a document; copies expanded."""
    s, members = links(features, clusters)
    same = members.groupBy("class_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("class_id").alias("a"), F.col("class_id").alias("b"))
    return expand(s.select("a", "b").unionByName(same), members).where("not (xc and yc)").select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
