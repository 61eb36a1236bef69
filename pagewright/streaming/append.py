"""New documents against a saved clustering, as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.cluster import NOISE, assign
from ..operators.features import clean_features


def append_documents(features: DataFrame, clusters: DataFrame, num: int = 83, den: int = 100, best: bool = True) -> DataFrame:
    """(id, cluster_id, score) for every document: 0 for noise, its own negative id where no cluster is near enough.

    features: raw doc_features rows of the new documents; clusters: (cluster_id, feature, weight, df, n).
    """
    f = clean_features(features).where("level = 'cluster'")
    size = f.groupBy("id").agg(F.count("*").alias("k"))
    hit = assign(f.select("id", "feature", "weight"), clusters, num, den, best)
    noise = F.col("k") <= NOISE
    out = size.join(hit, "id", "left")
    return out.select("id", F.when(noise, 0).otherwise(F.coalesce("cluster_id", -F.col("id"))).cast("long").alias("cluster_id"), F.when(noise, 0.0).otherwise(F.coalesce("score", F.lit(1.0))).alias("score"))


def stream_append(spark: SparkSession, source: str, schema: str, clusters: DataFrame, sink: str, checkpoint: str, files_per_batch: int = 16) -> StreamingQuery:
    """Assign the documents of every new file below source and append them to sink; a document's rows come in one file."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)

    def one(batch: DataFrame, n: int) -> None:
        append_documents(batch, clusters).write.mode("overwrite").parquet(f"{sink}/batch={n}")  # the same batch again replaces itself

    return rows.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
