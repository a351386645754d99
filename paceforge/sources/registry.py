"""Saved models: versions of a family, newest picked by name.

Every save goes to a folder of its own. A record that names the folder is written last, and readers follow the
newest record of a version: a save that dies leaves the version as it was, and a model that is being replaced
stays in place for those who read it.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Mapping, Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def latest_versions(models: DataFrame) -> DataFrame:
    """Newest version per family of a table (family, version, path)."""
    return models.groupBy("family").agg(
        F.max("version").alias("version"),
        F.max_by("path", "version").alias("path"),
        F.count(F.lit(1)).alias("versions"),
    )


def save_model(
    model: PipelineModel,
    root: str,
    family: str,
    version: str,
    features: Sequence[str],
    metrics: Mapping[str, float] | None = None,
    params: Mapping[str, object] | None = None,
    description: str = "",
) -> str:
    """Write model, metrics, parameters and metadata; a version that exists is replaced as a whole."""
    spark = SparkSession.getActiveSession()
    home, name = f"{root.rstrip('/')}/{family}/{version}", uuid.uuid4().hex
    path = f"{home}/{name}"
    model.write().save(f"{path}/model")
    record = {
        "saved_at": time.time_ns(),
        "family": family,
        "version": version,
        "path": path,
        "features": list(features),
        "metrics": {k: float(v) for k, v in (metrics or {}).items()},
        "params": {k: str(v) for k, v in (params or {}).items()},
        "description": description,
    }
    spark.createDataFrame([(json.dumps(record),)], "value string").coalesce(1).write.text(f"{home}/registry/{name}")
    return path


_RECORD = (
    "saved_at long, family string, version string, path string, features array<string>, "
    "metrics map<string,double>, params map<string,string>, description string"
)


def registered(spark: SparkSession, root: str) -> DataFrame:
    """All registered versions under a root folder, each as it was saved last."""
    records = spark.read.schema(_RECORD).json(f"{root.rstrip('/')}/*/*/registry/*")
    whole = F.struct(*[F.col(c) for c in records.columns])
    newest = records.groupBy("family", "version").agg(F.max_by(whole, F.struct("saved_at", "path")).alias("r"))
    return newest.select("r.*").drop("saved_at")


def load_latest(spark: SparkSession, root: str, prefix: str = "") -> tuple[PipelineModel, list[str], str]:
    """Newest registered version whose family starts with ``prefix``: model, features, path."""
    found = registered(spark, root).filter(F.col("family").startswith(prefix))
    row = found.agg(F.max_by(F.struct("path", "features"), "version").alias("m")).select("m.*").first()
    if row is None or row["path"] is None:
        raise FileNotFoundError(f"no model under {root} with prefix {prefix!r}")
    return PipelineModel.load(f"{row['path']}/model"), list(row["features"]), row["path"]
