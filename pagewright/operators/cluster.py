"""Clusters of fingerprints: leader assignment, pruning, merging, sub-clusters."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, drop
from .graph import connected_components
from .similarity import cluster_scores, coded, contributions, pair_overlaps, totals
from .skew import hot_join

#: Features up to which a document is noise; documents of a block.
NOISE, BLOCK = 5, 2_000
#: Positions and sizes of layout features no further apart are the same.
TOLERANCE = 5


# ---- frozen clusters -------------------------------------------------------------------------------------------


def assign(features: DataFrame, clusters: DataFrame, num: int = 83, den: int = 100, best: bool = False) -> DataFrame:
    """(id, cluster_id, score) for every document that reaches a cluster: the first by id, or the best (ties: last id)."""
    s = cluster_scores(features, clusters, num, den)
    pick = F.max(F.struct("score", "cluster_id")) if best else F.min(F.struct("cluster_id", "score"))
    return s.groupBy("id").agg(pick.alias("p")).select("id", "p.cluster_id", "p.score")


def affinity(parts: DataFrame) -> DataFrame:
    """(cluster_id, n, features, affinity): mean contribution over a cluster's features."""
    return parts.groupBy("cluster_id").agg(F.max("n").alias("n"), F.count("*").alias("features"), (F.sum("df") / (F.max("n") * F.count("*"))).alias("affinity"))


def prune(parts: DataFrame) -> DataFrame:
    """Features held by more than two documents, in clusters of more than four; smaller clusters stay as they are."""
    return parts.where((F.col("n") <= 4) | (F.col("df") > 2))


def pruned_affinity(parts: DataFrame, features: DataFrame, assigned: DataFrame) -> DataFrame:
    """(cluster_id, features, covered, affinity) after pruning: sum of df over (features before * documents covered).

    Clusters that lose all features have affinity 0.
    """
    before = parts.groupBy("cluster_id").agg(F.count("*").alias("before"))
    kept = cut(prune(parts), "kept")
    held = features.select("id", "feature").join(assigned.select("id", "cluster_id"), "id").join(kept.select("cluster_id", "feature"), ["cluster_id", "feature"], "left_semi")
    covered = held.groupBy("cluster_id").agg(F.count_distinct("id").alias("covered"))
    k = kept.groupBy("cluster_id").agg(F.count("*").alias("features"), F.sum("df").alias("s"))
    out = before.join(k, "cluster_id", "left").join(covered, "cluster_id", "left").na.fill(0, ["features", "s", "covered"])
    return out.select("cluster_id", "features", "covered", F.when(F.col("covered") > 0, F.col("s") / (F.col("before") * F.col("covered"))).otherwise(0.0).alias("affinity"))


# ---- leader clustering -----------------------------------------------------------------------------------------


class Leader:
    """Sequential leader clustering with whole-number contributions; an inverted index finds the clusters that share a feature."""

    def __init__(self, num: int, den: int, best: bool = False):
        self.num, self.den, self.best = num, den, best
        self.n: list[int] = []
        self.total: list[int] = []
        self.df: list[dict[str, int]] = []
        self.index: dict[str, set[int]] = defaultdict(set)
        self.sum: list[int] = []
        #: of the last document: what its admission took from the cluster's affinity, and the features it met there
        self.delta, self.width = 0.0, 0

    def candidates(self, doc: dict[str, int]) -> Iterable[tuple[int, float, int, int]]:
        """(cluster, score, weighted df, denominator) of clusters that reach the threshold, by id."""
        s: dict[int, int] = defaultdict(int)
        for f, w in doc.items():
            for c in self.index.get(f, ()):
                s[c] += w * self.df[c][f]
        wd = sum(doc.values())
        for c in sorted(s):
            if 2 * s[c] * self.den >= self.num * self.n[c] * (self.total[c] + wd):
                yield c, 2 * s[c] / (self.n[c] * (self.total[c] + wd)), 2 * s[c], self.n[c] * (self.total[c] + wd)

    def add(self, doc: dict[str, int]) -> tuple[int, float]:
        """Admit a document; returns its cluster and the similarity at which it came in (1 for founders)."""
        hit = None
        for c, score, _, _ in self.candidates(doc):
            if hit is None or score >= hit[1]:
                hit = (c, score)
            if not self.best:
                break
        if hit is None:
            hit = (len(self.n), 1.0)
            self.n.append(0)
            self.total.append(0)
            self.df.append({})
            self.sum.append(0)
        c = hit[0]
        width = len(self.df[c])
        before = self.sum[c] / (self.n[c] * width) if width else 1.0
        self.n[c] += 1
        self.sum[c] += len(doc)
        for f, w in doc.items():
            if f not in self.df[c]:
                self.df[c][f] = 0
                self.total[c] += w
                self.index[f].add(c)
            self.df[c][f] += 1
        self.delta = before - self.sum[c] / (self.n[c] * len(self.df[c])) if width else 0.0
        self.width = width or len(self.df[c])
        return hit


def leader_blocks(features: DataFrame, num: int = 83, den: int = 100, best: bool = False, block: int = BLOCK) -> DataFrame:
    """(id, block, local, distance, delta, cluster_features): leader clustering within blocks of about `block` documents, in the order of ids.

    features: (id, feature, weight). Documents with at most NOISE features get local -1 and distance 0. Blocks are
    hash parts, so no task holds more than a block whatever the data; alike clusters of different blocks are left to
    merge_clusters, as they are in a parallel run of the sequential algorithm.
    """
    docs = _documents(features)
    n = docs.where(F.col("k") > NOISE).count()
    parts = max(1, -(-n // block))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        lead = Leader(num, den, best)
        pdf = pdf.sort_values("id")
        got = [(*lead.add({x["feature"]: int(x["weight"]) for x in fs}), lead.delta, lead.width) for fs in pdf["fs"]]
        return pd.DataFrame({"id": pdf["id"], "block": pdf["block"], **{c: [g[k] for g in got] for k, c in enumerate(("local", "distance", "delta", "cluster_features"))}})

    key = F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("block")
    big = docs.where(F.col("k") > NOISE).select("id", "fs", key).groupBy("block").applyInPandas(run, "id long, block int, local int, distance double, delta double, cluster_features int")
    noise = docs.where(F.col("k") <= NOISE).select("id", F.lit(-1).alias("block"), F.lit(-1).alias("local"), F.lit(0.0).alias("distance"), F.lit(0.0).alias("delta"), F.lit(0).alias("cluster_features"))
    return big.unionByName(noise)


def _documents(features: DataFrame) -> DataFrame:
    """(id, fs, k): the features of each document as numbers in one row, in one order for all; features that are whole numbers stay so."""
    f = features.select("id", "feature", "weight")
    named = dict(f.dtypes)["feature"] != "bigint"
    f = coded(f) if named else f
    docs = f.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("feature", "weight"))).alias("fs"))
    docs = cut(docs.withColumn("k", F.size("fs")), "docs")
    if named:
        drop(f)
    return docs


def leader_scopes(docs: DataFrame, num: int, den: int) -> DataFrame:
    """(id, fs, v, scope): documents in the scopes within which leader clustering is independent; null alone. v: the first of its copies.

    A document's similarity to a cluster is at most its mean similarity to the cluster's documents (contributions are
    their mean, and the cluster weighs no less than any of them), so it reaches the threshold only if it does with one
    of them: no cluster leaves a component of the graph of alike documents. Exact copies are one vertex. A feature may
    weigh differently in different documents: its largest weight of all counts as shared, and in totals its smallest
    weight in the document's component, as only a document of the same cluster can have brought it in. The first edges
    take no feature as lighter than elsewhere; documents whose totals fall by their component are compared again with
    all, until none do.
    """
    vertices = cut(docs.groupBy("fs").agg(F.min("id").alias("v")), "vertices")
    flat = vertices.select(F.col("v").alias("id"), F.explode("fs").alias("x")).select("id", "x.feature", F.col("x.weight").alias("own"))
    span = cut(flat.groupBy("feature").agg(F.min("own").alias("least"), F.max("own").alias("weight")).where("least < weight"), "span")
    flat = flat.join(span, "feature", "left").select("id", "feature", "own", F.coalesce("weight", "own").alias("weight"), F.coalesce("least", "own").alias("least"))
    flat = cut(flat, "flat")
    near = pair_overlaps(flat, num, den)
    scope = connected_components(near).select("v", F.col("label").alias("scope"))
    drop(near)
    # rows of features that weigh differently; lighter: what their records' components have made of them so far
    varied = cut(flat.where("least < weight").select("id", "feature", "own", "weight"), "varied")
    lighter = varied.select("id", "feature", F.col("weight").alias("low")).limit(0)
    while True:
        at = varied.join(scope, varied["id"] == scope["v"], "left").withColumn("at", F.coalesce("scope", "id"))
        low = at.groupBy("at", "feature").agg(F.min("own").alias("low"))
        now = cut(at.join(low, ["at", "feature"]).where("low < weight").select("id", "feature", "low"), "lighter")
        fell = now.join(lighter.withColumnRenamed("low", "was"), ["id", "feature"], "left").where("was is null or low < was")
        fell = cut(fell.select("id").distinct(), "fell")
        if fell.isEmpty():
            break
        asks = flat.join(now, ["id", "feature"], "left").join(fell.select("id", F.lit(True).alias("asks")), "id", "left")
        asks = asks.select("id", "feature", "weight", "least", F.coalesce("low", "weight").alias("low"), F.coalesce("asks", F.lit(False)).alias("asks"))
        more = pair_overlaps(asks, num, den, either="asks", low="low", least="least")
        # the components so far are the vertices that the new edges join
        end = lambda c: scope.select(F.col("v").alias(c), F.col("scope").alias(f"s{c}"))
        ends = more.join(end("a"), "a", "left").join(end("b"), "b", "left").select(F.coalesce("sa", "a").alias("a"), F.coalesce("sb", "b").alias("b"))
        to = connected_components(ends).select(F.col("v").alias("scope"), F.col("label").alias("to"))
        old = scope.join(to, "scope", "left").select("v", F.coalesce("to", "scope").alias("scope"))
        new = to.join(scope.select(F.col("v").alias("scope")), "scope", "left_anti").select(F.col("scope").alias("v"), F.col("to").alias("scope"))
        scope = cut(old.unionByName(new), "scope")
        drop(more, fell)
        lighter = now
    to = cut(vertices.join(scope, "v", "left").select("fs", "v", "scope"), "scopes")
    drop(vertices, flat)
    return docs.select("id", "fs").join(to, "fs")


def leader_clusters(features: DataFrame, num: int = 83, den: int = 100, best: bool = False, block: int | None = None) -> DataFrame:
    """(id, cluster_id, distance, delta, cluster_features): leader clustering of all documents in the order of ids, noise in cluster 0.

    delta is what the document's admission took from the affinity of its cluster, cluster_features the number of features
    it met there (its own for founders; both 0 for noise). cluster_id is the smallest id of the cluster's documents. The clusters are those of one sequential pass, whatever
    the number of documents: the pass runs scope by scope (leader_scopes), each a sorted stream of which a task holds
    only the clusters. With block, documents are clustered in hash parts instead, for merge_clusters to unite.
    """
    if block is not None:
        b = cut(leader_blocks(features, num, den, best, block), "leader")
        first = b.where("local >= 0").groupBy("block", "local").agg(F.min("id").alias("cluster_id"))
        return b.join(first, ["block", "local"], "left").select("id", F.coalesce("cluster_id", F.lit(0)).cast("long").alias("cluster_id"), "distance", "delta", "cluster_features")
    docs = _documents(features)
    scoped = cut(leader_scopes(docs.where(F.col("k") > NOISE), num, den), "scoped")

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, lead, first = None, Leader(num, den, best), []
        for pdf in batches:
            out = []
            for i, scope, fs in zip(pdf["id"], pdf["scope"], pdf["fs"]):
                if scope != at:
                    at, lead, first = scope, Leader(num, den, best), []
                c, distance = lead.add({x["feature"]: int(x["weight"]) for x in fs})
                if c == len(first):
                    first.append(i)
                out.append((i, first[c], distance, lead.delta, lead.width))
            yield pd.DataFrame(out, columns=["id", "cluster_id", "distance", "delta", "cluster_features"])

    many = scoped.where("scope is not null").repartition("scope").sortWithinPartitions("scope", "id").select("id", "scope", "fs")
    many = many.mapInPandas(run, "id long, cluster_id long, distance double, delta double, cluster_features int")
    # documents that are like none but their exact copies
    alone = scoped.where("scope is null").select("id", F.col("v").alias("cluster_id"), F.lit(1.0).alias("distance"), F.lit(0.0).alias("delta"), F.size("fs").alias("cluster_features"))
    noise = docs.where(F.col("k") <= NOISE).select("id", F.lit(0).cast("long").alias("cluster_id"), F.lit(0.0).alias("distance"), F.lit(0.0).alias("delta"), F.lit(0).alias("cluster_features"))
    return many.unionByName(alone).unionByName(noise)


# ---- merging ---------------------------------------------------------------------------------------------------


def merge_edges(parts: DataFrame, num: int = 80, den: int = 100, short_path: bool = False, changed: DataFrame | None = None) -> DataFrame:
    """(a, b, score), a > b: cluster pairs that are alike enough to merge, by the contributions of b, the smaller id.

    Every feature of the table counts, whatever its level; clusters hold cluster-level features, none of which has a
    value, so no soft terms arise. The threshold is 5 % higher if either has fewer than 10 features. Cluster 0 never
    merges. short_path leaves out pairs whose feature numbers have a ratio below the threshold. changed: (id) of the
    clusters that are new since their pairs were last compared; pairs of two others are left out.
    """
    p = cut(parts.where("cluster_id <> 0").select("cluster_id", "feature", "weight", "df", "n"), "clusters")
    as_sets = p.select(F.col("cluster_id").alias("id"), "feature", "weight")
    flag = None
    if changed is not None:
        flag = "changed"
        as_sets = as_sets.join(changed.select("id", F.lit(True).alias(flag)), "id", "left").withColumn(flag, F.coalesce(flag, F.lit(False)))
    near = pair_overlaps(as_sets, num, den, either=flag)
    near = near.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("total_b").alias("wa"), F.col("total_a").alias("wb"))
    n = totals(as_sets)
    near = near.join(n.select(F.col("id").alias("a"), F.col("n").alias("fa")), "a").join(n.select(F.col("id").alias("b"), F.col("n").alias("fb")), "b")
    if short_path:
        near = near.where(F.least("fa", "fb") * den >= F.greatest("fa", "fb") * num)
    x = p.select(F.col("cluster_id").alias("b"), "feature", "weight", "df", "n")
    y = p.select(F.col("cluster_id").alias("a"), "feature")
    s = near.join(x, "b").join(y, ["a", "feature"]).groupBy("a", "b", "wa", "wb", "fa", "fb").agg(F.sum(F.col("weight") * F.col("df")).alias("s"), F.max("n").alias("n"))
    # whole numbers on both sides: 2 s / (n (wa + wb)) >= num / den, times 1.05 for small ones
    least = F.when(F.least("fa", "fb") < 10, 105).otherwise(100)
    hit = s.where(200 * den * F.col("s") >= least * num * F.col("n") * (F.col("wa") + F.col("wb")))
    return hit.select("a", "b", (2 * F.col("s") / (F.col("n") * (F.col("wa") + F.col("wb")))).alias("score"))


def survivors(edges: DataFrame) -> DataFrame:
    """(cluster_id, survivor): the smallest id of each component that has a smaller neighbour takes the others in."""
    comp = connected_components(edges)
    has = edges.select(F.greatest("a", "b").alias("v")).distinct()
    s = comp.join(has, "v").groupBy("label").agg(F.min("v").alias("survivor"))
    return comp.join(s, "label").select(F.col("v").alias("cluster_id"), "survivor")


def merged(parts: DataFrame, mapping: DataFrame) -> DataFrame:
    """Contribution table after a merge: documents and their features added up under the surviving id."""
    m = mapping.select("cluster_id", "survivor")
    p = parts.join(m, "cluster_id", "left").withColumn("to", F.coalesce("survivor", "cluster_id"))
    size = p.select("to", "cluster_id", "n").distinct().groupBy("to").agg(F.sum("n").alias("n"))
    df = p.groupBy("to", "feature").agg(F.sum("df").alias("df"), F.max("weight").alias("weight"))
    return df.join(size, "to").select(F.col("to").alias("cluster_id"), "feature", "weight", "df", "n")


def merged_average(parts: DataFrame, mapping: DataFrame) -> DataFrame:
    """(cluster_id, n, average_features): document-weighted mean of the feature numbers of what was merged."""
    per = parts.groupBy("cluster_id").agg(F.max("n").alias("n"), F.count("*").alias("k")).join(mapping, "cluster_id", "left")
    per = per.withColumn("to", F.coalesce("survivor", "cluster_id")).groupBy("to").agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("k")) / F.sum("n")).alias("average_features"))
    return per.select(F.col("to").alias("cluster_id"), "n", "average_features")


def merge_clusters(features: DataFrame, assigned: DataFrame, num: int = 80, den: int = 100, rounds: int = 10, short_path: bool = False) -> DataFrame:
    """(id, cluster_id) after merging alike clusters until none is left or the rounds are used up.

    Clusters are pruned before the first round and not between rounds. All pairs are compared in the first round, later
    only pairs with a cluster that has taken others in: all other scores are as they were.
    """
    a = cut(assigned.select("id", "cluster_id"), "assigned")
    f = coded(features.select("id", "feature", "weight"))
    parts = cut(prune(contributions(f, a.where("cluster_id <> 0"))), "parts")
    drop(f)
    changed = None
    for _ in range(rounds):
        edges = cut(merge_edges(parts, num, den, short_path, changed), "edges")
        if edges.isEmpty():
            break
        to = cut(survivors(edges), "survivors")
        before = a, parts, edges
        a = cut(hot_join(a, to.select("cluster_id", "survivor"), "cluster_id", "left").select("id", F.coalesce("survivor", "cluster_id").alias("cluster_id")), "assigned")
        parts = cut(merged(parts, to), "parts")
        drop(*before)
        changed = cut(to.select(F.col("survivor").alias("id")).distinct(), "changed")
    drop(parts)
    return a


# ---- sub-clusters ----------------------------------------------------------------------------------------------


class SubLeader:
    """Leader clustering on layout features: exact matches and values within TOLERANCE; best match, first of ties.

    A feature of the sub-cluster counts once, with its contribution, if the document has it or a value near its own; each
    feature of the document that is near and not in the sub-cluster counts once more, with contribution 1. All that
    counts is shared, so a feature of the sub-cluster that is only near gains a document too. Whole numbers are compared.
    """

    def __init__(self, threshold: float):
        self.num, self.den = round(threshold * 1000), 1000
        self.clusters: list[dict] = []

    def score(self, c: dict, doc: dict[str, tuple[int, float | None]]) -> tuple[int, int, set[str]]:
        """(numerator, denominator, shared features) of the similarity."""
        mine, n = c["features"], c["n"]
        shared = mine.keys() & doc.keys()
        s = sum(mine[f][0] * mine[f][1] for f in shared)
        valued = [(g, v) for g, (_, v) in doc.items() if v is not None]
        reached = set(shared)
        for f in sorted(mine):
            df, w, v = mine[f]
            if v is None:
                continue
            kind = f.split("_", 1)[0]
            near = [g for g, x in valued if kind in g and abs(x - v) <= TOLERANCE]
            if near and f not in reached:
                reached.add(f)
                s += df * w
            for g in near:
                if g not in reached:
                    reached.add(g)
                    s += n * w
        total = sum(x[1] for x in mine.values()) + sum(x[0] for x in doc.values())
        return 2 * s, n * total, reached

    def add(self, doc: dict[str, tuple[int, float | None]]) -> tuple[int, float]:
        best, at, shared = 0.0, -1, set()
        for i, c in enumerate(self.clusters):
            s, total, reached = self.score(c, doc)
            if total and s * self.den >= self.num * total and s / total > best:
                best, at, shared = s / total, i, reached
        if at < 0:
            self.clusters.append({"n": 0, "features": {}})
            best, at = 1.0, len(self.clusters) - 1
        c = self.clusters[at]
        c["n"] += 1
        for f, x in c["features"].items():
            if f in shared:
                x[0] += 1
        for f, (w, v) in doc.items():
            if f not in c["features"]:
                c["features"][f] = [1, w, v]
        return at, best


def subclusters(features: DataFrame, assigned: DataFrame, threshold: float = 0.7) -> DataFrame:
    """(id, cluster_id, part, subcluster, distance): each cluster divided by layout features, in the order of ids.

    features: (id, feature, level, value, weight). A cluster of any size is one sorted stream, of which a task holds
    only the sub-clusters; subcluster counts from 0 in each cluster, and part is always 0.
    """
    f = features.where("level = 'subcluster'").groupBy("id").agg(F.collect_list(F.struct("feature", "weight", "value")).alias("fs"))
    docs = assigned.where("cluster_id <> 0").select("id", "cluster_id").join(f, "id", "left")

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, lead = None, SubLeader(threshold)
        for pdf in batches:
            out = []
            for i, c, fs in zip(pdf["id"], pdf["cluster_id"], pdf["fs"]):
                if c != at:
                    at, lead = c, SubLeader(threshold)
                out.append((i, c, 0, *lead.add({x["feature"]: (int(x["weight"]), x["value"]) for x in (fs if fs is not None else [])})))
            yield pd.DataFrame(out, columns=["id", "cluster_id", "part", "subcluster", "distance"])

    docs = docs.select("id", "cluster_id", "fs").repartition("cluster_id").sortWithinPartitions("cluster_id", "id")
    return docs.mapInPandas(run, "id long, cluster_id long, part int, subcluster int, distance double")
