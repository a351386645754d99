"""Session defaults and the shared folder for staged tables."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings the operators rely on. Nothing here is sized to one machine: AQE picks the number and
# the size of shuffle partitions from what the map side really wrote.
RECOMMENDED = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # Methods above 8000 bytecodes are never compiled by the JVM. Wide feature rows exceed that; with
    # this limit Spark splits them by operator instead (measured 12 times faster on pace text).
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the code generation limit to a session built elsewhere."""
    name = "spark.sql.codegen.hugeMethodLimit"
    spark.conf.set(name, RECOMMENDED[name])
    return spark


PARTITION_BYTES = 512 * 1024**2


def shuffle_partitions(input_bytes: int, least: int = 200) -> int:
    """Shuffle partitions for an input size. AQE merges small partitions but never adds any, so a
    large job has to start with enough of them."""
    return max(least, -(-input_bytes // PARTITION_BYTES))


def build_session(
    app: str = "paceforge", master: str | None = None, input_bytes: int | None = None, **extra: str
) -> SparkSession:
    """Session with the settings above; ``input_bytes`` sizes the shuffles of a large job."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    if input_bytes is not None:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions(input_bytes)))
    for key, value in {**RECOMMENDED, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def staging_root(spark: SparkSession) -> str:
    """Folder all executors can reach: ``spark.checkpoint.dir`` of the session.

    A folder set with ``sparkContext.setCheckpointDir`` counts as well. Where neither is set a
    temporary folder is only acceptable in local mode, as in tests.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    configured = configured or context.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if re.fullmatch(r"local(\[.*\])?", context.master):
        folder = tempfile.mkdtemp(prefix="paceforge-")
        spark.conf.set("spark.checkpoint.dir", folder)
        return folder
    raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")


def staging_path(spark: SparkSession, label: str) -> str:
    return f"{staging_root(spark)}/paceforge/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Write ``df`` once to the shared folder and continue from the written table.

    This cuts the lineage and pins values a recomputation could change (partition numbers). Unlike
    a checkpoint the table stays columnar, so later steps still prune columns. ``options`` go to the
    Parquet writer.
    """
    path = staging_path(df.sparkSession, label)
    df.write.mode("errorifexists").options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Remove the staged table that ``df`` reads, once nothing needs it any more.

    Only folders below the staging folder are touched.
    """
    spark = df.sparkSession
    root = f"{staging_root(spark)}/paceforge/"
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if root.split(":", 1)[-1].lstrip("/") in path:
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
