"""The growth of tree shares on the JVM (``TreeShares.java``), compiled by the compiler that Spark brings along."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import types as T

SOURCE = Path(__file__).with_name("TreeShares.java")
_LOADERS: dict[str, object] = {}


def _loader(spark):
    """The class loader that has the compiled classes; executors get them as a jar, once for each application."""
    context = spark.sparkContext
    if context.applicationId not in _LOADERS:
        jvm = context._jvm
        compiler = jvm.org.codehaus.janino.SimpleCompiler()
        compiler.setParentClassLoader(jvm.java.lang.Thread.currentThread().getContextClassLoader())
        compiler.cook(SOURCE.read_text())
        path = os.path.join(tempfile.mkdtemp(prefix="panelrisk-jar-"), "panelrisk-trees.jar")
        with zipfile.ZipFile(path, "w") as z:
            for name, code in compiler.getBytecodes().items():
                z.writestr(name.replace(".", "/") + ".class", bytes(code))
        context._jsc.addJar(path)
        _LOADERS[context.applicationId] = compiler.getClassLoader()
    return _LOADERS[context.applicationId]


def grow_shares(rows: DataFrame, shares: list[str], steps) -> DataFrame:
    """(task, block, folds, ys, sums) of rows (share, block, keys, folds, ys, bins), where a partition is one share.

    ``shares``: the numbers that a share is told, see ``TreeShare``; ``steps``: the hashes at which a draw grows by one.
    """
    spark = rows.sparkSession
    kernel = _loader(spark).loadClass("panelrisk.TreeShares").getDeclaredConstructor(
        spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.java.lang.Class, 0)).newInstance(
        spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.java.lang.Object, 0))
    kernel.set("\n".join(shares), " ".join(str(int(s)) for s in steps))
    schema = T._parse_datatype_string("task int, block long, folds binary, ys binary, sums binary")
    encoder = spark.sparkContext._jvm.org.apache.spark.sql.Encoders.row(spark._jsparkSession.parseDataType(schema.json()))
    return DataFrame(rows._jdf.mapPartitions(kernel, encoder), spark)
