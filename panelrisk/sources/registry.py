"""Model persistence and the run registry.

Models use Spark ML persistence; metadata is one row per run appended to a Parquet
registry table, so "latest model" is an aggregate, not a directory listing.

A registry is a folder with ``rows/append=<id>``, the rows of each append, and ``commits/<version>``, a file per
version that names the append whose row counts.  Only rows with such a file are visible.
"""

from __future__ import annotations

import json
import uuid
from datetime import datetime, timezone
from urllib.parse import quote

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelrisk.session import path_exists
from panelrisk.sources.commits import put_if_absent

REGISTRY_SCHEMA = T.StructType([
    T.StructField("version", T.StringType()),
    T.StructField("trained_at", T.TimestampType()),
    T.StructField("algorithm", T.StringType()),
    T.StructField("features", T.ArrayType(T.StringType())),
    T.StructField("cv_scores", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("test_metrics", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("reliable", T.BooleanType()),
    T.StructField("model_path", T.StringType()),
])
DEFAULT_METADATA = {"version": "desconhecida", "features": []}


def save_model(model: PipelineModel, path: str) -> None:
    """Overwrite-save a fitted pipeline (directories are created by the writer)."""
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    """Load; a missing model raises FileNotFoundError."""
    if not path_exists(SparkSession.active(), path):
        raise FileNotFoundError(path)
    return PipelineModel.load(path)


class VersionExists(ValueError):
    """A version that the registry has already."""


def append_runs(runs: DataFrame, registry_path: str) -> None:
    """Append run metadata rows, one for each version.

    The rows are written first; then a file for each version, put only where there is none, makes its row
    visible.  An append that is killed before shows nothing, and of two trainers that write one version the second gets
    ``VersionExists``; its other versions are appended.  A null or repeated version is an error, and nothing is committed.
    """
    spark, append = runs.sparkSession, f"a{uuid.uuid4().hex}"
    own = runs.select(*[F.col(f.name).cast(f.dataType) for f in REGISTRY_SCHEMA])
    own.write.parquet(f"{registry_path}/rows/append={append}")
    versions = [r.version for r in spark.read.schema(REGISTRY_SCHEMA).parquet(f"{registry_path}/rows/append={append}")
                .select("version").collect()]  # a row for each training run
    if None in versions or len(set(versions)) < len(versions):
        raise ValueError("every run needs a version of its own")
    taken = [v for v in versions if not put_if_absent(
        spark, f"{registry_path}/commits/v-{quote(v, safe='')}", json.dumps({"version": v, "append": append}) + "\n")]
    if taken:
        raise VersionExists(f"in the registry already: {', '.join(sorted(taken))}")


def run_record(spark: SparkSession, version: str, algorithm: str, features: list[str],
               cv_scores: dict, test_metrics: dict, reliable: bool, model_path: str,
               trained_at: datetime | None = None) -> DataFrame:
    ts = trained_at or datetime.now(timezone.utc).replace(tzinfo=None)
    return spark.createDataFrame([(version, ts, algorithm, features, cv_scores, test_metrics, reliable,
                                   model_path)], REGISTRY_SCHEMA)


def read_registry(spark: SparkSession, registry_path: str) -> DataFrame:
    """The registry's committed rows, in any store; none where nothing has been committed yet."""
    if not path_exists(spark, f"{registry_path}/commits"):
        return spark.createDataFrame([], REGISTRY_SCHEMA)
    commits = spark.read.schema("version string, append string").json(f"{registry_path}/commits")
    rows = spark.read.schema(T.StructType([*REGISTRY_SCHEMA, T.StructField("append", T.StringType())])).parquet(f"{registry_path}/rows")
    return rows.join(commits, ["version", "append"], "left_semi").select(*REGISTRY_SCHEMA.names)


def latest(registry: DataFrame, ts: str = "trained_at") -> DataFrame:
    """The newest entry (none if empty) - one aggregate, no sort of the table."""
    cols = registry.columns
    return (registry.agg(F.max_by(F.struct(*cols), F.col(ts)).alias("_r"))
            .where(F.col("_r").isNotNull()).select("_r.*"))


def model_metadata(registry: DataFrame, model_path: str | None = None) -> DataFrame:
    """Metadata of the newest run (of ``model_path`` when given); when the registry
    has none, the reference's default (version 'desconhecida', no features)."""
    runs = registry if model_path is None else registry.where(F.col("model_path") == model_path)
    spark = registry.sparkSession
    default = spark.createDataFrame([(DEFAULT_METADATA["version"], None, None, DEFAULT_METADATA["features"],
                                      None, None, None, model_path)], REGISTRY_SCHEMA)
    found = latest(runs).withColumn("_pick", F.lit(0))
    both = found.unionByName(default.withColumn("_pick", F.lit(1)))
    # at most two rows: the newest run if there is one, else the default
    return both.orderBy("_pick").limit(1).drop("_pick")
