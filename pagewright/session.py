"""Session, shared scratch folder and lineage cuts."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_ROOTS: dict[str, str] = {}


def get_spark(app: str = "pagewright", cpus: int | str = "*", memory: str = "8g", shuffle: int = 8) -> SparkSession:
    """A local session for tests and the benchmark; on a cluster the session comes from spark-submit."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def scratch(spark: SparkSession) -> str:
    """This application's folder below spark.checkpoint.dir, which all executors share.

    Where the setting is missing, a local master gets a temporary folder; a cluster is told to set it,
    because a machine-local folder would be lost with the machine.
    """
    app = spark.sparkContext.applicationId
    if app not in _ROOTS:
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
        if not base:
            if not spark.sparkContext.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="pagewright-")
        _ROOTS[app] = f"{base.rstrip('/')}/pagewright-{app}"
        atexit.register(_remove, spark, _ROOTS[app])
    return _ROOTS[app]


def _remove(spark: SparkSession, root: str) -> None:
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # noqa: BLE001 - the JVM may be gone already
        pass


#: Spark deletes the shuffle files of a written table as soon as it is written, not when the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame, name: str = "t") -> DataFrame:
    """Write df as a table in the shared scratch folder and read it back.

    Cuts the lineage: a lost executor costs at most a re-read. The plan after it knows the real size.
    """
    spark = df.sparkSession
    path = f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before) if before is not None else spark.conf.unset(CLEANUP)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables that cut returned and that no plan reads any more."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t._cut)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
