"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelrisk.session import checkpoint_root

#: ASCII white space that separates words: blank, and tab to carriage return.
SPACE_BYTES = b" \t\n\x0b\x0c\r"


_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 8 << 20
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives the executors this package through Spark's own file server, once for each application.

    It also bounds the bytes of a batch that goes to a Python worker, where the session sets no bound:
    10,000 rows, the usual limit, can be any number of bytes when texts are long.
    """
    context = spark.sparkContext
    if spark.conf.get(_BATCH_CONF, None) is None:
        spark.conf.set(_BATCH_CONF, str(BATCH_BYTES))
    if context.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[1]
    path = f"{tempfile.mkdtemp(prefix='panelrisk-')}/panelrisk.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    context.addPyFile(path)
    _SHIPPED.add(context.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path under the cluster's shared checkpoint folder."""
    return f"{checkpoint_root(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back.

    Cuts the lineage at a place where several branches start: the work above runs once, and a
    lost executor costs a re-read of files, not a recomputation.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, df: DataFrame) -> None:
    """Deletes the files of a table made by ``written`` that nothing will read again."""
    jvm, files = spark.sparkContext._jvm, df.inputFiles()
    for folder in {f.rsplit("/", 1)[0] for f in files}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Internal column names that no column of ``df`` has, whatever its columns are called."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def give_back() -> None:
    """Hands a Python worker's freed memory back to the system: idle workers stay alive beside the next stages."""
    import ctypes

    import pyarrow

    pyarrow.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def col(name: str) -> Column:
    """A column by its exact name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def row_key(id_col: str, text_col: str) -> list[Column]:
    """What tells one document from another: its id, and its text where ids repeat."""
    return [col(id_col), F.xxhash64(col(text_col))]
