"""The corpus pipeline: five stages over ``documents``, each written as Parquet and reread.

language ID (rejected documents go) -> line dedup (repeated lines go) -> SimHash near-dedup (one
document of each group stays) -> benchmark decontamination (leaking documents go) -> byte-level BPE
(the digests of the token ids and of the decoded bytes).

Every stage takes (spark, docs, sf_dir) and sees all that its predecessor kept.  A stage that drops
documents leaves the others as they are; line dedup changes the text, and ``n_chars`` with it.  Null and
empty texts: language ID rejects them, and a text that line dedup empties stays until near-dedup, where
all empty texts are one group.  Empty tables, repeated rows, ties and further columns: as the operators
define.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelrisk.llm import bpe, decontam, language, line_dedup, simhash
from panelrisk.llm.common import col, fresh, ship, table, written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with a sufficient margin."""
    ship(spark)
    model = language.fit(docs.filter(~language.held_out()))
    (text,) = fresh(docs, "_text")
    found = language.identify(docs.select(F.struct(*map(col, docs.columns)).alias("doc"), F.col("text").alias(text)), model, text)
    return found.filter(~F.col("rejected")).select("doc.*")


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the later occurrences of three-line windows."""
    out = line_dedup.line_dedup(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of near-duplicates."""
    ship(spark)
    return simhash.near_dedup(docs, shingle=simhash.SHINGLE, max_bits=simhash.MAX_BITS)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no item of the benchmark."""
    ship(spark)
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every document left."""
    ship(spark)
    return bpe.digests(docs)


STAGES = [("language_id", language_id), ("line_dedup", repeated_lines), ("simhash_near_dedup", near_duplicates),
          ("benchmark_decontamination", benchmark_leaks), ("byte_level_bpe", token_ids)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: Compression, SimHash, tilings and BPE are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None
