"""Report tables: evaluation and drift reports as partitioned tables.

The reference renders text / HTML files; here each run appends rows to a Parquet table
partitioned by ``run_id``, so reports are queryable and a run's rows are replaced
atomically per partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelrisk.operators.metrics import metrics_long

REPORT_COLUMNS = ("section", "name", "value", "detail")


def _rows(df: DataFrame, section: str, name, value, detail) -> DataFrame:
    return df.select(F.lit(section).alias("section"), name.cast("string").alias("name"),
                     value.cast("double").alias("value"), detail.cast("string").alias("detail"))


def evaluation_report(metrics: DataFrame, gates: DataFrame, report: DataFrame, confusion: DataFrame) -> DataFrame:
    """Main metrics, gate lines, confusion cells and per-class rows in one long table."""
    m = metrics_long(metrics)
    parts = [
        _rows(m, "metrics", F.col("metric"), F.col("value"), F.lit(None)),
        _rows(gates, "gates", F.col("metric"), F.col("value"),
              F.when(F.col("passed"), "OK").otherwise("REPROVADO")),
        _rows(confusion, "confusion", F.concat_ws("->", F.col("actual").cast("string"),
                                                  F.col("predicted").cast("string")),
              F.col("n"), F.lit(None)),
    ]
    for c in ("precision", "recall", "f1", "support"):
        parts.append(_rows(report, f"class_{c}", F.col("cls"), F.col(c), F.lit(None)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def drift_report(per_column: DataFrame, summary: DataFrame) -> DataFrame:
    """Per-column drift rows plus the summary row, long form."""
    cols = [c for c in per_column.columns if c not in ("column", "drifted")]
    parts = [_rows(per_column, f"column_{c}", F.col("column"), F.col(c), F.col("drifted")) for c in cols]
    parts.append(_rows(summary, "summary", F.lit("drift_score"), F.col("drift_score"),
                       F.array_join("drifted_features", ",")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def write_report(report: DataFrame, path: str, run_id: str) -> None:
    """Append one run's report under ``run_id=<id>`` (dynamic partition overwrite)."""
    (report.withColumn("run_id", F.lit(run_id)).write
     .option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("run_id").parquet(path))
