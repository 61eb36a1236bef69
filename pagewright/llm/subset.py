"""Problem 6: a varied subset of given size by determinantal greedy selection."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.norm import feature_key
from ..session import cut
from .setjoin import classes

#: Size of the subset; records one task holds at once (its kernel rows are made one at a time).
SIZE, PART = 200, 2_000
#: Added to the diagonal, so that the kernel stays positive definite.
RIDGE = 1e-3


def greedy_determinant(toks: Sequence[np.ndarray], k: int, sizes: Sequence[int] | None = None) -> list[int]:
    """Up to k positions that greedily maximise the determinant of the Jaccard kernel of the sets.

    sizes: how many elements each set has, if toks holds only those that others may share. Incremental Cholesky: one kernel row for each pick; the squared residual of an item is the factor by which it
    would grow the determinant. Ties go to the smallest position.
    """
    n = len(toks)
    k = min(k, n)
    many = np.array([len(t) for t in toks], dtype=np.int64)
    size = many if sizes is None else np.asarray(sizes, dtype=np.int64)
    flat = np.concatenate(toks) if n else np.empty(0, np.int64)
    _, code = np.unique(flat, return_inverse=True)
    row = np.repeat(np.arange(n), many)
    order = np.argsort(code, kind="stable")
    posting = row[order]
    start = np.searchsorted(code[order], np.arange((code.max() + 1 if len(code) else 0) + 1))
    first = np.concatenate([[0], np.cumsum(many)])
    left = np.full(n, 1.0 + RIDGE)
    c = np.zeros((k, n))
    out: list[int] = []
    for m in range(k):
        j = int(np.argmax(left))
        out.append(j)
        if m + 1 == k:
            break
        hits = [posting[start[t] : start[t + 1]] for t in code[first[j] : first[j + 1]]]
        shared = np.bincount(np.concatenate(hits), minlength=n) if hits else np.zeros(n)
        sim = shared / np.maximum(size + size[j] - shared, 1)
        sim[j] = 1.0 + RIDGE
        c[m] = (sim - c[:m].T @ c[:m, j]) / np.sqrt(max(left[j], 1e-12))
        left = left - c[m] ** 2
        left[out] = -np.inf
    return out


def item_sets(features: DataFrame, clusters: DataFrame) -> DataFrame:
    """(id, is_cluster, feats) of every document with a feature; membership in a cluster (0 aside) is a feature too."""
    f = features.select(F.col("doc_id").alias("id"), feature_key("feature").alias("f"))
    c = clusters.where("cluster_id <> 0").select(F.explode("documents").alias("id"), F.concat(F.lit("\x1emember "), "cluster_id").alias("f"))
    known = f.where("id is not null and f is not null").select("id").distinct()
    both = f.unionByName(c.join(known, "id", "left_semi")).where("id is not null and f is not null")
    return both.groupBy("id").agg(F.array_sort(F.collect_set("f")).alias("feats")).withColumn("is_cluster", F.lit(False))


def varied_subset(sets: DataFrame, size: int = SIZE, part: int = PART) -> DataFrame:
    """(doc_id, rank, stands_for): `size` records (all classes if there are fewer) in the order of their choice.

    Copies are folded to one record, named by its smallest id; stands_for is their number. Hash partitions of
    about `part` records each give a core-set of `size`, core-sets are partitioned and reduced again until one
    task holds the rest, and the final pass chooses from it. Core-sets compose: a partition's greedy choice spans
    nearly the volume of the partition, so the choice from their union nearly spans that of the whole.
    """
    if size <= 0:
        raise ValueError("size must be positive")
    part = max(part, 4 * size)
    recs, _ = classes(sets)
    left = recs.select("class_id", "toks", "k", "w")
    n = left.count()

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("class_id").reset_index(drop=True)
        at = greedy_determinant([np.asarray(t, dtype=np.int64) for t in pdf["toks"]], size, pdf["k"])
        return pdf.loc[at, ["class_id", "toks", "k", "w"]].assign(rank=range(1, len(at) + 1))

    schema = "class_id long, toks array<long>, k int, w long, rank int"
    level = 0
    while n > part:
        parts = -(-n // part)
        # another hash for each level, so that what met once is mixed anew
        left = left.groupBy(F.pmod(F.xxhash64("class_id", F.lit(level)), F.lit(parts)).alias("p")).applyInPandas(choose, schema)
        left = cut(left.select("class_id", "toks", "k", "w"), "coreset")
        n, level = left.count(), level + 1
    last = left.groupBy(F.lit(0).alias("p")).applyInPandas(choose, schema)
    return last.select(F.col("class_id").alias("doc_id"), "rank", F.col("w").alias("stands_for"))


def subset(features: DataFrame, clusters: DataFrame) -> DataFrame:
    return varied_subset(item_sets(features, clusters))
