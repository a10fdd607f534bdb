"""File sources and sinks: CSV with encoding fallback, lenient JSONL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelrisk.session import path_exists

CORRUPT = "_corrupt_record"


def _has_invalid_utf8(spark: SparkSession, path: str) -> bool:
    # raw bytes are kept by the text source; one offending line is enough (limit 1)
    return spark.read.text(path).where(~F.is_valid_utf8("value")).limit(1).count() > 0


def load_csv(spark: SparkSession, path: str, sep: str = ";", schema: T.StructType | str | None = None,
             encoding: str | None = None) -> DataFrame:
    """Header CSV; UTF-8 unless the bytes are not valid UTF-8, then Latin-1.

    Missing path -> FileNotFoundError; no data rows -> ValueError (the reference's
    contract).  The emptiness check reads one row, not the file.
    """
    if not path_exists(spark, path):
        raise FileNotFoundError(path)
    enc = encoding or ("ISO-8859-1" if _has_invalid_utf8(spark, path) else "UTF-8")
    reader = spark.read.option("header", True).option("sep", sep).option("encoding", enc)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    df = reader.csv(path)
    if df.isEmpty():
        raise ValueError(f"empty file: {path}")
    return df


def write_csv(df: DataFrame, path: str, sep: str = ";", encoding: str = "UTF-8") -> None:
    df.write.mode("overwrite").option("header", True).option("sep", sep).option("encoding", encoding).csv(path)


def parse_json_lines(lines: DataFrame, schema: T.StructType, keep_corrupt: bool = False) -> DataFrame:
    """Text lines (``value``) as records of ``schema``, in batch and in streams alike.

    Blank lines are ignored; unparsable ones are dropped, or with ``keep_corrupt`` kept as null
    records with their text in ``_corrupt_record``.
    """
    full = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    out = (lines.where(F.trim("value") != "").select(F.from_json("value", full, options).alias("r")).select("r.*"))
    return out if keep_corrupt else out.where(F.col(CORRUPT).isNull()).drop(CORRUPT)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType, keep_corrupt: bool = False) -> DataFrame:
    """JSON lines with a fixed schema (see ``parse_json_lines``); missing path -> empty frame."""
    if not path_exists(spark, path):
        full = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
        return spark.createDataFrame([], full if keep_corrupt else schema)
    return parse_json_lines(spark.read.text(path), schema, keep_corrupt)


def append_jsonl(df: DataFrame, path: str) -> None:
    """Append records as JSON lines (one file per task; readers see a directory)."""
    df.write.mode("append").json(path)


PREDICTION_LOG_SCHEMA = T.StructType([
    T.StructField("timestamp", T.StringType()), T.StructField("student_id", T.StringType()),
    T.StructField("event_id", T.LongType()), T.StructField("risco_defasagem", T.IntegerType()),
    T.StructField("probabilidade", T.DoubleType()), T.StructField("nivel_risco", T.StringType()),
])
