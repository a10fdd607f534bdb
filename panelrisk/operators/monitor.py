"""Prediction-log monitoring: one aggregate per question."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HIGH = "alto"


def log_summary(log: DataFrame, level: str = "nivel_risco", ts: str = "timestamp") -> DataFrame:
    """Total, high ('alto'), everything else (missing level included), latest ISO
    timestamp text (null/empty skipped).  An empty log gives zeros and null."""
    return log.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col(level).eqNullSafe(HIGH)).alias("alto"),
        F.count_if(~F.col(level).eqNullSafe(HIGH)).alias("baixo_medio"),
        F.max(F.nullif(F.col(ts), F.lit(""))).alias("ultima"))


def kpis(summary: DataFrame) -> DataFrame:
    """Total, high-risk count, rate (null when total is 0), last prediction."""
    return summary.select(
        F.col("total").alias("total_predicoes"), F.col("alto").alias("predicoes_alto_risco"),
        (F.col("alto") / F.nullif(F.col("total"), F.lit(0))).alias("taxa_risco"),
        F.col("ultima").alias("ultima_predicao"))


def recent_predictions(log: DataFrame, n: int = 50, ts: str = "timestamp", tie: str | None = None) -> DataFrame:
    """U4: newest n rows (a top-k: per-task heaps, never a full sort)."""
    order = [F.col(ts).desc_nulls_last()] + ([F.col(tie).desc()] if tie else [])
    return log.orderBy(*order).limit(n)
