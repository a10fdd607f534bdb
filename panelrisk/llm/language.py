"""Language identification by compression.

One raw-content zstandard dictionary per language is filled with a bounded sample of labelled
texts.  A text is encoded with each dictionary, in blocks that start afresh, so that a long text
cannot learn from itself; the dictionary with the smallest total wins.  The margin is
1 - smallest / second smallest; a narrow one rejects the document.

Texts are compared as lower-case letters with single blanks between words.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelrisk.llm.common import col, fresh, table

#: Bounds of what a model learns from, and so of what travels to the tasks.
DICT_BYTES = 196_608
SAMPLE_DOCS = 400
SAMPLE_TEXT_CHARS = 16_384
MAX_LANGUAGES = 1_000
LEVEL = 6
BLOCK_BYTES = 16_384
MIN_MARGIN = 0.004

_LETTER = regex.compile(r"\p{L}")
_OTHER = re.compile(r"[\W\d_]+")
_RESULT = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
                        T.StructField("rejected", T.BooleanType())])


@dataclass(frozen=True)
class LanguageModel:
    """Dictionaries by language, in order of their names; at most MAX_LANGUAGES x DICT_BYTES."""

    dictionaries: tuple[tuple[str, bytes], ...]
    level: int = LEVEL
    block: int = BLOCK_BYTES
    min_margin: float = MIN_MARGIN


def plain(text: str) -> bytes:
    return _OTHER.sub(" ", text.lower()).encode("utf-8", "replace")


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", sample_docs: int = SAMPLE_DOCS,
        dict_bytes: int = DICT_BYTES, **settings) -> LanguageModel:
    """A model of all languages of the labelled rows of ``docs``.

    Rows without text or language teach nothing.  Per language about ``sample_docs`` different texts are drawn
    by their hashes, or all where there are no more; copies count once.  Of a longer text a piece of
    SAMPLE_TEXT_CHARS characters is taken, at a place that its hash names, so a language of long texts alone
    is learnt too.  The pieces fill the dictionary in hash order while there is room.  The driver gets
    these samples only: their size does not depend on the table's.  More than MAX_LANGUAGES languages
    raise an error.
    """
    rows = (docs.select(col(text_col).alias("text"), col(lang_col).alias("lang"))
            .filter("text is not null and text <> '' and lang is not null")
            .withColumn("h", F.xxhash64(F.lit("sample"), F.col("text"))))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.approx_count_distinct("h", 0.02).alias("n"))
             .limit(MAX_LANGUAGES + 1).collect()}
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not sizes:
        return LanguageModel((), **settings)
    span = 1 << 30
    # the count of different texts is within a few per cent: where it is near sample_docs, all are taken
    part = lambda n: span if n < 1.1 * sample_docs else -(-span * sample_docs // n)
    share = F.create_map(*[F.lit(x) for k, n in sorted(sizes.items()) for x in (k, part(n))])
    at = F.pmod(F.xxhash64(F.lit("place"), "h"), F.greatest(F.length("text") - SAMPLE_TEXT_CHARS + 1, F.lit(1))).cast("int")
    drawn = (rows.filter(F.pmod("h", F.lit(span)) < share[F.col("lang")])
             .select("lang", "h", F.substring("text", at + 1, F.lit(SAMPLE_TEXT_CHARS)).alias("text"))
             .groupBy("lang", "h").agg(F.min("text").alias("text")))
    texts: dict[str, list] = {}
    for r in drawn.collect():
        texts.setdefault(r["lang"], []).append((r["h"], r["text"]))
    out = []
    for lang in sorted(texts):
        parts, room = [], dict_bytes
        for _, text in sorted(texts[lang]):
            raw = plain(text) + b"\n"
            if len(raw) <= room:
                parts.append(raw)
                room -= len(raw)
        out.append((lang, b"".join(parts)))
    return LanguageModel(tuple(out), **settings)


class _Compressors:
    """The model's compressors, made once in each Python worker."""

    def __init__(self, model: LanguageModel):
        import zstandard

        self.model, self.each = model, []
        for lang, raw in model.dictionaries:
            if len(raw) < 8:  # too short for a dictionary
                self.each.append((lang, zstandard.ZstdCompressor(level=model.level, write_content_size=False)))
                continue
            known = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            known.precompute_compress(level=model.level)
            self.each.append((lang, zstandard.ZstdCompressor(level=model.level, dict_data=known, write_dict_id=False,
                                                             write_checksum=False, write_content_size=False)))

    def classify(self, text: str | None) -> dict:
        if text is None or not self.each or not _LETTER.search(text):
            return {"lang_pred": "und", "score": 0.0, "rejected": True}
        raw, step = plain(text), self.model.block
        blocks = [raw[i:i + step] for i in range(0, len(raw), step)]
        sizes = sorted((sum(len(c.compress(b)) for b in blocks), lang) for lang, c in self.each)
        if len(sizes) == 1:
            return {"lang_pred": sizes[0][1], "score": 1.0, "rejected": False}
        margin = 1 - sizes[0][0] / sizes[1][0]
        return {"lang_pred": sizes[0][1], "score": margin, "rejected": margin < self.model.min_margin}


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` (the margin, 0 to 1) and ``rejected``, in one narrow pass.

    A null text, one without a letter, and every text under a model without languages get ``und``,
    0.0 and true.  Equal sizes go to the language whose name sorts first, with score 0.0, and are
    rejected.  Equal texts get equal results.  Columns with these names are replaced.
    """
    held: list = []

    @F.arrow_udf(_RESULT)
    def predict(texts: pa.Array) -> pa.Array:
        if not held:
            held.append(_Compressors(model))
        return pa.array([held[0].classify(x.as_py()) for x in texts],
                        pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())]))

    (made,) = fresh(docs, "_language")
    out = ("lang_pred", "score", "rejected")
    return (docs.withColumn(made, predict(col(text_col)))
            .select(*[col(c) for c in docs.columns if c.lower() not in out], f"{made}.*"))


def held_out(id_col: str = "doc_id"):
    """True for the fifth of the ids that no model learns from; a null id is not among them."""
    return F.coalesce(F.pmod(F.crc32(col(id_col).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs.filter(~held_out()))
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")


ORACLE: dict[str, str] = {}
QUERIES = {"op2_language": op2_language}
