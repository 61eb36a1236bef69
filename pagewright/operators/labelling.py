"""Few documents worth labelling: greedy cover of each cluster's headings."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .skew import hot_join


def headings(features: DataFrame, assigned: DataFrame, min_docs: int = 2) -> DataFrame:
    """(cluster_id, id, feature): titles and subtitles that at least two documents of the cluster hold.

    Only clusters above 0 with at least min_docs documents.
    """
    a = assigned.where("cluster_id > 0").select("id", "cluster_id").distinct()
    big = a.groupBy("cluster_id").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs).select("cluster_id")
    a = hot_join(a, big, "cluster_id")
    f = features.where(F.col("type").isin("title", "subtitle")).select("id", "feature").distinct().join(a, "id")
    often = f.groupBy("cluster_id", "feature").agg(F.count("*").alias("df")).where("df >= 2").select("cluster_id", "feature")
    return f.join(often, ["cluster_id", "feature"])


def greedy(pdf: pd.DataFrame, ratio: float, most: int) -> list[tuple[int, int, int, int]]:
    """(id, pick, new features, features left) of the documents picked from one cluster; ties go to the smaller id."""
    has: dict[int, set] = {i: set(g) for i, g in pdf.groupby("id")["feature"]}
    left = set(pdf["feature"])
    total, out = len(left), []
    while total and len(out) < most:
        best = max(sorted(has), key=lambda i: len(has[i] & left))
        new = has[best] & left
        left -= new
        out.append((best, len(out) + 1, len(new), len(left)))
        if not left or len(left) / total <= ratio:
            break
    return out


def candidates(features: DataFrame, assigned: DataFrame, ratio: float = 0.1, min_docs: int = 2, most: int = 10) -> DataFrame:
    """(cluster_id, id, pick, new_features, left_features): up to `most` documents of each cluster that cover its headings.

    Picks the document with most uncovered headings until the share left is at most `ratio`. Only documents that no
    other holds more than matter, so each distinct set of headings of a cluster travels once, under its smallest id; the
    picks are the same.
    """
    h = headings(features, assigned, min_docs)
    sets = h.groupBy("cluster_id", "id").agg(F.array_sort(F.collect_set("feature")).alias("fs"))
    one = sets.groupBy("cluster_id", "fs").agg(F.min("id").alias("id"))
    rows = one.select("cluster_id", "id", F.explode("fs").alias("feature"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        got = greedy(pdf, ratio, most)
        return pd.DataFrame([(pdf["cluster_id"].iloc[0], *g) for g in got], columns=["cluster_id", "id", "pick", "new_features", "left_features"])

    return rows.groupBy("cluster_id").applyInPandas(run, "cluster_id long, id long, pick int, new_features int, left_features int")


def sweep(features: DataFrame, assigned: DataFrame, ratios: tuple[float, ...] = (0.0, 0.1, 0.2, 0.25), min_docs: int = 3) -> DataFrame:
    """Candidates for several ratios, with the ratio as a column."""
    each = [candidates(features, assigned, r, min_docs).withColumn("ratio", F.lit(r)) for r in ratios]
    return reduce(DataFrame.unionByName, each)


def coverage(features: DataFrame, assigned: DataFrame, picked: DataFrame, min_docs: int = 2) -> DataFrame:
    """One row: selected and all documents, covered and all headings, and their ratios (null without any).

    ratio_features_all also counts the headings of low confidence; no threshold parts them from the others, so they are
    the same ones once more.
    """
    h = headings(features, assigned, min_docs)
    scope = h.select("cluster_id").distinct()
    docs = assigned.join(scope, "cluster_id", "left_semi").agg(F.count_distinct("id").alias("documents"))
    feats = h.select("cluster_id", "feature").distinct().agg(F.count("*").alias("headings"))
    got = picked.agg(F.count("*").alias("selected"), F.coalesce(F.sum("new_features"), F.lit(0)).cast("long").alias("covered"))
    return got.select(
        "selected", docs.scalar().alias("documents"), "covered", feats.scalar().alias("headings"),
        (F.col("selected") / F.nullif(docs.scalar(), F.lit(0))).alias("ratio_docs"), (F.col("covered") / F.nullif(feats.scalar(), F.lit(0))).alias("ratio_features"),
        (F.col("covered") / F.nullif(2 * feats.scalar(), F.lit(0))).alias("ratio_features_all"),
    )


def representation(features: DataFrame, assigned: DataFrame, picked: DataFrame) -> DataFrame:
    """(id, cluster_id, headings, labelled, share): how much of each document's headings the picked ones cover.

    share is null for documents without headings.
    """
    mine = features.where(F.col("type").isin("title", "subtitle")).select("id", "feature").distinct().join(assigned.where("cluster_id > 0"), "id")
    known = picked.select("cluster_id", "id").join(mine.select("cluster_id", "id", "feature"), ["cluster_id", "id"]).select("cluster_id", "feature").distinct()
    g = mine.join(known.withColumn("hit", F.lit(1)), ["cluster_id", "feature"], "left").groupBy("id", "cluster_id").agg(F.count("*").alias("headings"), F.count("hit").alias("labelled"))
    return g.select("*", F.when(F.col("headings") > 0, F.col("labelled") / F.col("headings")).alias("share"))


def mean_representation(features: DataFrame, assigned: DataFrame, picked: DataFrame) -> DataFrame:
    """One row: the mean share of a document's headings that the picked ones cover, over the documents of clusters of two
    or more (mean_dataset) and over those of clusters with a pick (mean_scope); documents without headings count as 0."""
    scope = picked.select("cluster_id").distinct()
    total = representation(features, assigned, picked).join(scope, "cluster_id", "left_semi").agg(F.coalesce(F.sum("share"), F.lit(0.0)).alias("s"))
    a = assigned.where("cluster_id > 0").select("id", "cluster_id").distinct()
    many = a.groupBy("cluster_id").agg(F.count("*").alias("n")).where("n >= 2").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    inside = a.join(scope, "cluster_id", "left_semi").agg(F.count("*").alias("n"))
    share = lambda n: F.col("s") / F.nullif(n.scalar(), F.lit(0))
    return total.select(share(many).alias("mean_dataset"), share(inside).alias("mean_scope"))


def label_report(features: DataFrame, assigned: DataFrame, picked: DataFrame, docs: DataFrame, min_docs: int = 2) -> DataFrame:
    """The picked documents with their metadata, the order of their choice and the number of headings of their cluster."""
    n = headings(features, assigned, min_docs).select("cluster_id", "feature").distinct().groupBy("cluster_id").agg(F.count("*").alias("low_confident_features"))
    rows = picked.select(F.col("id").alias("doc_id"), "cluster_id", "pick").join(n, "cluster_id", "left")
    return rows.join(docs, "doc_id", "left")


def cluster_ratio(assigned: DataFrame, picked: DataFrame) -> DataFrame:
    """Mean share of picked documents over the clusters with a pick."""
    n = assigned.groupBy("cluster_id").agg(F.count("*").alias("n"))
    p = picked.groupBy("cluster_id").agg(F.count("*").alias("k"))
    return p.join(n, "cluster_id").agg(F.avg(F.col("k") / F.col("n")).alias("ratio_clusters"))
