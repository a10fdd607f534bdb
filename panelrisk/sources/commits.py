"""Small files that appear whole and once, in any store that Hadoop's file systems reach."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def put_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Creates ``path`` with ``text``; False, and nothing changed, where it is there already.

    The text is written to a hidden file beside it, which is then renamed without overwriting: of two writers one
    wins, and one killed on the way leaves nothing that readers see.  HDFS renames atomically; a store that does not
    (most object stores) needs one writer at a time.
    """
    jvm = spark.sparkContext._jvm
    target, fs = _at(spark, path)
    if fs.exists(target):
        return False
    hidden = jvm.org.apache.hadoop.fs.Path(target.getParent(), f".put-{uuid.uuid4().hex}")
    out = fs.create(hidden, False)
    out.write(bytearray(text.encode()))
    out.close()
    kinds = jvm.org.apache.hadoop.fs.Options.Rename
    plain = spark.sparkContext._gateway.new_array(kinds, 1)
    plain[0] = kinds.NONE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    try:
        context.rename(fs.makeQualified(hidden), fs.makeQualified(target), plain)
    except Py4JJavaError:
        fs.delete(hidden, False)
        if fs.exists(target):
            return False
        raise
    return True


def names(spark: SparkSession, folder: str) -> list[str]:
    """The names in a folder, sorted, without hidden ones; none where the folder is absent."""
    p, fs = _at(spark, folder)
    if not fs.exists(p):
        return []
    found = [s.getPath().getName() for s in fs.listStatus(p)]
    return sorted(n for n in found if n[0] not in "._")


def read_text(spark: SparkSession, path: str) -> str:
    """The text of a small file."""
    p, fs = _at(spark, path)
    source = fs.open(p)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")
    finally:
        source.close()


def delete(spark: SparkSession, path: str) -> None:
    p, fs = _at(spark, path)
    fs.delete(p, True)
