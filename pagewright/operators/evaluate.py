"""Quality and size figures of a clustering."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .skew import hot_join


def high_confidence(affinities: DataFrame, num: int = 83, den: int = 100, more_than: int = 1) -> DataFrame:
    """Clusters (cluster_id, n, affinity) above the affinity threshold with more than more_than documents."""
    return affinities.where((F.col("affinity") >= num / den) & (F.col("n") > more_than) & (F.col("cluster_id") > 0))


def company_accuracy(docs: DataFrame) -> DataFrame:
    """(company_id, documents, clusters, subclusters, per_cluster, per_subcluster); cluster 0 counts among documents only.

    docs: (company_id, cluster_id, subcluster). Ratios are null for companies with noise alone.
    """
    real = F.col("cluster_id") > 0
    g = docs.where("company_id is not null").groupBy("company_id").agg(
        F.count("*").alias("documents"),
        F.count_distinct(F.when(real, F.col("cluster_id"))).alias("clusters"),
        F.count_distinct(F.when(real, F.struct("cluster_id", "subcluster"))).alias("subclusters"),
    )
    ratio = lambda c: F.when(F.col(c) > 0, F.col("documents") / F.col(c))
    return g.select("*", ratio("clusters").alias("per_cluster"), ratio("subclusters").alias("per_subcluster"))


def pair_index(pred: DataFrame, true: DataFrame) -> DataFrame:
    """(id, index): share of the documents grouped with it in both partitions among those in either, itself included.

    pred, true: (id, cluster). Counts replace the pair matrix: n_pt / (n_p + n_t - n_pt); 0 if missing on a side.
    """
    both = pred.select("id", F.col("cluster").alias("p")).join(true.select("id", F.col("cluster").alias("t")), "id", "full")
    n_p = both.where("p is not null").groupBy("p").agg(F.count("*").alias("n_p"))
    n_t = both.where("t is not null").groupBy("t").agg(F.count("*").alias("n_t"))
    n_pt = both.where("p is not null and t is not null").groupBy("p", "t").agg(F.count("*").alias("n_pt"))
    cell = n_pt.join(n_p, "p").join(n_t, "t").withColumn("index", F.col("n_pt") / (F.col("n_p") + F.col("n_t") - F.col("n_pt")))
    key = F.struct("p", "t")
    inside = hot_join(both.where("p is not null and t is not null").select("id", key.alias("k")), cell.select(key.alias("k"), "index"), "k").select("id", "index")
    return inside.unionByName(both.where("p is null or t is null").select("id", F.lit(0.0).alias("index")))


def mean_pair_index(pred: DataFrame, true: DataFrame) -> DataFrame:
    return pair_index(pred, true).agg(F.avg("index").alias("pair_index"))


def run_metrics(assigned: DataFrame) -> DataFrame:
    """One row: documents, noise, clusters, clusters of two or more, their documents, single ones, clustered share."""
    per = assigned.groupBy("cluster_id").agg(F.count("*").alias("n"))
    real, many = F.col("cluster_id") > 0, (F.col("cluster_id") > 0) & (F.col("n") > 1)
    total = lambda cond, c: F.coalesce(F.sum(F.when(cond, c)), F.lit(0)).cast("long")
    m = per.agg(
        total(F.lit(True), F.col("n")).alias("documents"), total(~real, F.col("n")).alias("noise"), total(real, F.lit(1)).alias("clusters"),
        total(many, F.lit(1)).alias("clusters_many"), total(many, F.col("n")).alias("documents_many"), total(real & (F.col("n") == 1), F.lit(1)).alias("singles"),
    )
    return m.withColumn("share", F.when(F.col("documents") > 0, F.col("documents_many") / F.col("documents")).otherwise(0.0))


def size_report(assigned: DataFrame) -> DataFrame:
    """(cluster_id, n, percent): sizes of the clusters of two or more with their share of all documents, cut to whole per cent."""
    per = assigned.groupBy("cluster_id").agg(F.count("*").alias("n"))
    total = assigned.agg(F.count("*").alias("t"))
    return per.where("cluster_id > 0 and n > 1").select("cluster_id", "n", F.floor(100 * F.col("n") / total.scalar()).cast("int").alias("percent"))


def members(assigned: DataFrame, docs: DataFrame) -> DataFrame:
    """Documents of clusters with id > 0 with their metadata."""
    return assigned.where("cluster_id > 0").join(docs, "doc_id")


def labelled_evaluation(assigned: DataFrame, truth: DataFrame, by_subcluster: bool = False) -> DataFrame:
    """One row with the mean pair index of (id, cluster_id, subcluster) against truth (id, cluster, subcluster).

    by_subcluster compares cluster * 1000 + subcluster on both sides.
    """
    key = (lambda c: F.col(c) * 1000 + F.coalesce("subcluster", F.lit(0))) if by_subcluster else F.col
    return mean_pair_index(assigned.select("id", key("cluster_id").alias("cluster")), truth.select("id", key("cluster").alias("cluster")))


def high_confidence_detail(affinities: DataFrame, assigned: DataFrame, docs: DataFrame, num: int = 83, den: int = 100) -> DataFrame:
    """The documents of the high-confidence clusters with the figures of their cluster and their metadata.

    affinities: (cluster_id, n, features, affinity); assigned: (id, cluster_id); docs: one row for each doc_id.
    """
    top = high_confidence(affinities, num, den).select("cluster_id", F.col("n").alias("number_documents"), F.col("features").alias("total_features_cluster"), "affinity")
    inside = hot_join(assigned.select("id", "cluster_id"), top, "cluster_id")
    return inside.withColumnRenamed("id", "doc_id").join(docs, "doc_id", "left")


def prune_report(parts: DataFrame) -> DataFrame:
    """One row: clusters of more than four documents, their features, those that pruning takes away, and their share."""
    big = parts.where("n > 4")
    m = big.agg(F.count_distinct("cluster_id").alias("clusters"), F.count("*").alias("features"), F.count(F.when(F.col("df") <= 2, 1)).alias("cleaned"))
    return m.withColumn("ratio", F.when(F.col("features") > 0, F.col("cleaned") / F.col("features")).otherwise(0.0))


def working_data(docs: DataFrame) -> DataFrame:
    """One row: different documents and different companies among them; null ids and companies don't count."""
    return docs.agg(F.count_distinct("doc_id").alias("documents"), F.count_distinct("company_id").alias("companies"))


def document_records(assigned: DataFrame, sizes: DataFrame, docs: DataFrame, companies: DataFrame, languages: DataFrame) -> DataFrame:
    """The report row of every document: cluster, how it came in, feature numbers and metadata, marked as used in training.

    assigned: (id, cluster_id, distance, delta, cluster_features) of leader_clusters; sizes: (id, total_features); docs and
    companies: one row for each key; languages: (file_name, language). What isn't known is null.
    """
    d = assigned.withColumnRenamed("id", "doc_id").join(sizes.withColumnRenamed("id", "doc_id"), "doc_id", "left").join(docs, "doc_id", "left")
    d = hot_join(d, companies.select("company_id", "company_name", "company_industry"), "company_id", "left")
    d = d.join(languages, "file_name", "left")
    return d.select(
        "doc_id", "cluster_id", F.col("distance").alias("admission_distance"), F.col("delta").alias("affinity_ratio_delta"), "total_features", F.col("cluster_features").alias("total_features_cluster"),
        "company_id", "company_name", "company_industry", "language", F.col("document_year").alias("year"), "document_link", "document_type", "file_name", F.lit(True).alias("train"),
    )
