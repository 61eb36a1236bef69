"""From the tables of a folder to clusters: load, fingerprint, assign, prune, merge, divide, report."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.cluster import leader_clusters, merge_clusters, prune, subclusters
from ..operators.evaluate import run_metrics
from ..operators.features import clean_features
from ..operators.similarity import contributions
from ..session import cut


def train(features: DataFrame, similarity: int = 83, merging: int = 80, dividing: float = 0.7) -> tuple[DataFrame, DataFrame, dict[str, float]]:
    """(assigned, contributions, seconds by phase) for raw doc_features rows; thresholds in per cent, dividing as a share.

    assigned: (id, cluster_id, part, subcluster, distance); noise is in cluster 0.
    """
    took: dict[str, float] = {}
    t = time.time()

    def lap(name: str) -> None:
        nonlocal t
        took[name] = time.time() - t
        t = time.time()

    f = cut(clean_features(features), "features")
    top = f.where("level = 'cluster'").select("id", "feature", "weight")
    first = cut(leader_clusters(top, similarity), "assigned")
    lap("clustering")
    merged = merge_clusters(top, first, merging)
    lap("merging")
    parts = cut(prune(contributions(top, merged.where("cluster_id <> 0"))), "parts")
    lap("pruning")
    sub = subclusters(f, merged, dividing)
    out = merged.join(sub.drop("cluster_id"), "id", "left").select("id", "cluster_id", F.coalesce("part", F.lit(0)).alias("part"), F.coalesce("subcluster", F.lit(0)).alias("subcluster"), F.coalesce("distance", F.lit(0.0)).alias("distance"))
    out = cut(out, "assigned")
    lap("dividing")
    return out, parts, took


def metrics(features: DataFrame) -> DataFrame:
    return run_metrics(train(features)[0])
