"""Streaming scoring and counters on Structured Streaming.

Both run the same DataFrame plan as the batch operators on a file source with
``trigger(availableNow=True)`` and a checkpoint under the shared checkpoint folder, so
a restarted job resumes exactly where it stopped.  No sockets, no ports.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelrisk.functions.columns import risk_tier
from panelrisk.operators.monitor import HIGH
from panelrisk.operators.scoring import EDUCATION_CONTRACT, Rule, score_batch, validate_requests
from panelrisk.session import materialize
from panelrisk.sources.commits import delete, names, put_if_absent, read_text
from panelrisk.sources.files import parse_json_lines

COUNTERS_SCHEMA = T.StructType([T.StructField("nivel_risco", T.StringType()), T.StructField("n", T.LongType()),
                                T.StructField("ultima", T.StringType())])
KEPT_STATES = 2


def json_stream(spark: SparkSession, source_dir: str, schema: T.StructType, keep_corrupt: bool = False) -> DataFrame:
    """JSON lines of the files that arrive, parsed as the batch source parses them."""
    return parse_json_lines(spark.readStream.text(source_dir), schema, keep_corrupt)


def _append(stream: DataFrame, sink_dir: str, checkpoint_dir: str) -> None:
    q = (stream.writeStream.format("parquet").option("path", sink_dir)
         .option("checkpointLocation", checkpoint_dir).outputMode("append")
         .trigger(availableNow=True).start())
    q.awaitTermination()


def score_stream(spark: SparkSession, source_dir: str, schema: T.StructType, rules: tuple[Rule, ...],
                 prob_expr, sink_dir: str, checkpoint_dir: str) -> None:
    """C7 with a probability expression: validate + score every request file that arrives.

    Invalid requests are written with ``valid`` false and neither probability nor tier.
    """
    prob = F.when(F.col("valid"), prob_expr)
    _append(validate_requests(json_stream(spark, source_dir, schema), rules).select(
        "event_id", "valid", F.round(prob, 4).alias("probabilidade"), risk_tier(prob).alias("nivel_risco")),
        sink_dir, checkpoint_dir)


def score_requests_stream(spark: SparkSession, source_dir: str, schema: T.StructType, model, sink_dir: str,
                          quarantine_dir: str, checkpoint_dir: str, rules=EDUCATION_CONTRACT, version: str = "1.0.0",
                          features=None, mode: str = "request", history: DataFrame | None = None,
                          now=None) -> None:
    """C7 with a fitted model: each micro-batch goes through ``score_batch``, the plan of batch scoring.

    Records are written under ``sink_dir/batch=N``, rejected requests with their errors under
    ``quarantine_dir/batch=N``; a batch that is run again after a failure overwrites its own folders.
    """

    def score(batch: DataFrame, epoch: int) -> None:
        batch = materialize(batch, "request-batch")  # read by the records and by the quarantine
        records, rejected = score_batch(batch, model, rules, version, now, features, mode, history)
        records.write.mode("overwrite").parquet(f"{sink_dir}/batch={epoch}")
        rejected.write.mode("overwrite").parquet(f"{quarantine_dir}/batch={epoch}")

    q = (json_stream(spark, source_dir, schema).writeStream.foreachBatch(score)
         .option("checkpointLocation", checkpoint_dir).trigger(availableNow=True).start())
    q.awaitTermination()


def counters_stream(spark: SparkSession, log_dir: str, schema: T.StructType, table_dir: str,
                    checkpoint_dir: str) -> None:
    """Running counters per risk level + latest timestamp, a new state each batch (``read_counters``).

    Global counters: state is one row per level (fixed size), no watermark needed.  Broken lines are
    not counted, as in the batch source.

    A state is written whole to ``table_dir/states``, then a numbered file in ``table_dir/current`` names it.  Readers
    follow the highest number: during a batch, after a crash in it and when a batch is run again they see one whole state.
    The last two states are kept for readers that are still at them.
    """
    src = json_stream(spark, log_dir, schema)
    counts = src.groupBy(F.coalesce(F.col("nivel_risco"), F.lit("(none)")).alias("nivel_risco")).agg(
        F.count(F.lit(1)).alias("n"), F.max(F.nullif(F.col("timestamp"), F.lit(""))).alias("ultima"))

    def publish(batch: DataFrame, _epoch: int) -> None:
        state = uuid.uuid4().hex
        batch.write.parquet(f"{table_dir}/states/{state}")
        number = int((names(spark, f"{table_dir}/current") or ["0"])[-1]) + 1
        while not put_if_absent(spark, f"{table_dir}/current/{number:020d}", state):
            number += 1
        current = names(spark, f"{table_dir}/current")
        kept = {read_text(spark, f"{table_dir}/current/{n}") for n in current[-KEPT_STATES:]}
        for n in current[:-KEPT_STATES]:
            delete(spark, f"{table_dir}/current/{n}")
        for n in names(spark, f"{table_dir}/states"):
            if n not in kept:
                delete(spark, f"{table_dir}/states/{n}")

    q = (counts.writeStream.outputMode("complete").foreachBatch(publish)
         .option("checkpointLocation", checkpoint_dir).trigger(availableNow=True).start())
    q.awaitTermination()


def read_counters(spark: SparkSession, table_dir: str) -> DataFrame:
    """The newest whole state of ``counters_stream``; no rows before its first batch."""
    current = names(spark, f"{table_dir}/current")
    if not current:
        return spark.createDataFrame([], COUNTERS_SCHEMA)
    return spark.read.schema(COUNTERS_SCHEMA).parquet(f"{table_dir}/states/{read_text(spark, f'{table_dir}/current/{current[-1]}')}")


def counters_view(table: DataFrame) -> DataFrame:
    """U2 read side: total, high-risk, others, last - from the per-level table."""
    return table.agg(F.sum("n").alias("total"),
                     F.coalesce(F.sum(F.when(F.col("nivel_risco") == HIGH, F.col("n"))), F.lit(0)).alias("alto"),
                     F.max("ultima").alias("ultima"))
