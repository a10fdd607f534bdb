"""Session helpers: a local session for tests/bench and the shared scratch folder.

Scratch data (round-trip files, stream sources, checkpoints) always goes under the
folder the cluster names in ``spark.checkpoint.dir``.  Only when that setting is
absent (unit tests on a laptop) do we create one ourselves.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_OWN_ROOTS: dict[str, str] = {}
_SHIPPED: set[str] = set()


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "panelrisk") -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for lineage cuts and scratch tables.

    Read from the session.  Only a local session without the setting gets a folder of its own;
    on a cluster that is an error, because executors would write to their own disks.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        # the setting is fixed once a context runs, so the session's own folder is remembered here
        root = _OWN_ROOTS.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="panelrisk-ckpt-"))
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root


def ship(spark: SparkSession) -> None:
    """Gives the executors this package through Spark's own file server, once for each application."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    path = f"{tempfile.mkdtemp(prefix='panelrisk-core-')}/panelrisk_core.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    context.addPyFile(path)
    _SHIPPED.add(context.applicationId)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path under the shared checkpoint folder."""
    root = checkpoint_root(spark)
    if root.startswith("file:"):
        root = root[len("file:"):]
    return os.path.join(root, "panelrisk", f"{name}-{uuid.uuid4().hex[:12]}")


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists, in any store that Spark can reach."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def materialize(df, name: str = "stage"):
    """Cut lineage: write ``df`` as a Parquet table in the shared checkpoint folder and
    read it back.

    Used at stage boundaries whose output feeds several branches (and the sampling
    jobs of the bucketed scans): upstream work runs once (an uncached ``checkpoint()``
    would compute it twice), later stages scan a columnar table with real size
    statistics for AQE, and a lost executor re-reads the files instead of recomputing
    the chain.  Never a machine-local folder on a cluster: the path comes from
    ``spark.checkpoint.dir``.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)  # the schema is known: no job looks for it


def recommended_conf(input_bytes: int, executors: int = 1000, cores_per_executor: int = 4,
                     target_partition_bytes: int = 256 << 20) -> dict[str, str]:
    """Session settings sized to the input volume (e.g. 100 TB on 1,000 executors).

    Shuffle partitions are chosen so that one partition of the largest shuffle holds
    about ``target_partition_bytes`` (and at least two waves of tasks), AQE coalesces
    small partitions and splits skewed join partitions at runtime, and scan splits match
    the same target.  The ordered scans take their bucket count from the shuffle
    partitions.
    """
    slots = max(1, executors * cores_per_executor)
    parts = max(2 * slots, -(-input_bytes // target_partition_bytes))
    return {
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.files.maxPartitionBytes": str(target_partition_bytes),
        "spark.sql.autoBroadcastJoinThreshold": str(64 << 20),
    }
