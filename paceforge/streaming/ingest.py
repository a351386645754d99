"""File-arrival ingest: every new export runs through the activity flow once.

The stream carries file names, not rows: exports differ in their headers, so each file is read with
its own. A micro-batch holds at most ``files_per_batch`` files. Outputs and log rows are written to
paths derived from the file and the batch, so a replayed batch overwrites its own results.
"""

from __future__ import annotations

import hashlib
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timezone
from functools import reduce

from pyspark.errors import AnalysisException, IllegalArgumentException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paceforge.operators.skew import DEFAULT_POLICY, SplitPolicy
from paceforge.plans import flow
from paceforge.sources import activities
from paceforge.streaming.history import History, canonical

LOG_SCHEMA = (
    "source string, upload_id string, status string, error_message string, rows_in long, "
    "rows_cleaned long, rows_tabular long, started_at timestamp_ntz, ended_at timestamp_ntz, "
    "runtime_seconds double"
)


def upload_id(path: str) -> str:
    """Stable folder name of an upload."""
    return hashlib.sha1(path.encode()).hexdigest()


def _now() -> datetime:
    return datetime.now(timezone.utc).replace(tzinfo=None)


def process_file(spark: SparkSession, path: str, out: str, policy: SplitPolicy = DEFAULT_POLICY) -> tuple:
    """Run one file through the flow.

    What is wrong with the file becomes a log row. Failed Spark jobs are not caught: the batch
    fails and is replayed, so a lost executor cannot turn a good file into an error.
    """
    started, name = _now(), upload_id(path)
    counts: dict[str, int] = {}
    status, message = "success", None
    try:
        if not path.lower().endswith(".csv"):
            raise ValueError("file must be a CSV")
        raw = activities.read_activities(spark, path)
        counts = flow.write_stages(raw, f"{out}/{name}", policy=policy)
    except (ValueError, AnalysisException, IllegalArgumentException) as error:
        status, message = "error", str(error)
    ended = _now()
    return (
        path, name, status, message, counts.get("raw"), counts.get("cleaned"), counts.get("tabular"),
        started, ended, (ended - started).total_seconds(),
    )


def ingest(
    spark: SparkSession,
    inbox: str,
    out: str,
    checkpoint: str,
    files_per_batch: int = 8,
    policy: SplitPolicy = DEFAULT_POLICY,
    history: History | None = None,
    parallelism: int = 4,
) -> DataFrame:
    """Process all files that arrived in ``inbox`` since the last call and return the run log.

    ``parallelism`` files of a batch run side by side. With a ``history`` the cleaned rows of a batch are
    added to it under the batch's number before the log is written.
    """

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        arrived = [r["path"] for r in batch.select("path").collect()]  # at most files_per_batch
        with ThreadPoolExecutor(parallelism) as pool:
            rows = list(pool.map(lambda path: process_file(session, path, f"{out}/uploads", policy), arrived))
        good = [name for _, name, status, *_ in rows if status == "success"]
        if history is not None and good:
            cleaned = [canonical(session.read.parquet(f"{out}/uploads/{name}/cleaned")) for name in good]
            history.update(reduce(DataFrame.unionByName, cleaned), batch_id)
        session.createDataFrame(rows, LOG_SCHEMA).coalesce(1).write.mode("overwrite").parquet(
            f"{out}/log/batch_id={batch_id}"
        )

    arrivals = (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length long, content binary")
        .option("maxFilesPerTrigger", files_per_batch)
        .option("recursiveFileLookup", True)
        .load(inbox)
        .select("path", "length")  # the content column is never read
    )
    (
        arrivals.writeStream.foreachBatch(on_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
    return read_log(spark, out)


def read_log(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(f"{LOG_SCHEMA}, batch_id long").parquet(f"{out}/log")


def log_summary(log: DataFrame) -> DataFrame:
    return log.groupBy("status").agg(
        F.coalesce(F.sum("rows_in"), F.lit(0)).alias("rows_in"),
        F.coalesce(F.sum("rows_cleaned"), F.lit(0)).alias("rows_cleaned"),
        F.coalesce(F.sum("rows_tabular"), F.lit(0)).alias("rows_tabular"),
    )
