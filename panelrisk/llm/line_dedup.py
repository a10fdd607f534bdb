"""Line deduplication by overlapping three-line windows (built-in functions only).

Every run of three consecutive lines is hashed (128 bits).  A window that occurs more than
once anywhere keeps its first occurrence, in order of (document id, text hash, line number);
each later occurrence covers its three lines.  The covered positions of a document are merged
into intervals, and the lines between the intervals are what is left.

The plan has three shuffles: the windows for the first occurrences (partial aggregation, so a
window that a third of all documents hold costs one row a task), the windows for the join with
the repeated ones (sort-merge, which AQE splits at hot hashes), and the documents for the join
with their covered positions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelrisk.llm.common import col, fresh, table

WINDOW = 3


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def covered_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    window: int = WINDOW) -> DataFrame:
    """(id, text_hash, starts): the line numbers, from 0, at which later occurrences start."""
    base = docs.select(col(id_col).alias("id"), F.xxhash64(col(text_col)).alias("th"),
                       lines_of(col(text_col)).alias("lines"))
    last = F.size("lines") - window
    starts = F.expr(f"transform(sequence(0, size(lines) - {window}), i -> "
                    f"array_join(slice(lines, i + 1, {window}), '\\n'))")
    windows = (base.filter(last >= 0)
               .select("id", "th", F.posexplode(starts).alias("pos", "w"))
               .filter(F.col("w").rlike("[^ \\t\\n\\r]"))
               .select("id", "th", "pos", F.unhex(F.md5("w")).alias("h")))
    at = F.struct("id", "th", "pos")
    first = (windows.groupBy("h").agg(F.min(at).alias("first"), F.count(F.lit(1)).alias("n"))
             .filter("n > 1").select("h", "first"))
    later = windows.join(first, "h").filter(~at.eqNullSafe(F.col("first")))
    return later.groupBy("id", "th").agg(F.sort_array(F.collect_set("pos")).alias("starts"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               window: int = WINDOW) -> DataFrame:
    """``docs`` with the repeated lines taken out of the text, plus ``n_lines`` and ``n_removed``.

    Every row stays.  Lines are what stands between line feeds, an empty text being one empty
    line; a null text stays null with 0 lines.  A text of fewer lines than the window is left as
    it is.  Windows of blank lines alone are not compared.  Windows are judged on the input, not
    on what is left.  A null id sorts first.  Rows equal in id and text are one document: each
    gets the same result, and none counts as the other's repetition; rows of one id and
    different texts are different documents.  Columns called ``n_lines`` or ``n_removed`` are
    replaced.  An empty table gives an empty table.
    """
    th, lines, kept, b_id, b_th, starts = fresh(docs, "_th", "_lines", "_kept", "_b_id", "_b_th", "_starts")
    found = covered_windows(docs, id_col, text_col, window).toDF(b_id, b_th, starts)
    joined = (docs.withColumn(th, F.xxhash64(col(text_col)))
              .join(found, col(id_col).eqNullSafe(col(b_id)) & (col(th) == col(b_th)), "left"))
    ends = F.concat(F.array(F.lit(0)), F.transform(col(starts), lambda p: p + window))
    begins = F.concat(col(starts), F.array(F.size(lines)))
    gaps = F.filter(F.arrays_zip(ends.alias("a"), begins.alias("b")), lambda g: g["a"] < g["b"])
    out = (joined.withColumn(lines, lines_of(col(text_col)))
           .withColumn(kept, F.when(col(starts).isNull(), col(lines)).otherwise(
               F.flatten(F.transform(gaps, lambda g: F.slice(col(lines), g["a"] + 1, g["b"] - g["a"]))))))
    n, left = F.coalesce(F.size(lines), F.lit(0)), F.coalesce(F.size(kept), F.lit(0))
    n, left = F.greatest(n, F.lit(0)), F.greatest(left, F.lit(0))
    keep = [c for c in docs.columns if c.lower() not in ("n_lines", "n_removed")]
    text = F.when(col(text_col).isNotNull(), F.array_join(col(kept), "\n")).alias(text_col)
    return out.select(*[text if c == text_col else col(c) for c in keep],
                      n.cast("long").alias("n_lines"), (n - left).cast("long").alias("n_removed"))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


#: The same rule over the lines themselves, without hashes.
LINES_SQL = """
line_docs AS (SELECT *, CASE WHEN text IS NULL THEN NULL ELSE string_split(text, chr(10)) END AS a FROM {source}),
line_windows AS (SELECT doc_id, unnest(range(1, len(a) - 1)) AS p, a FROM line_docs WHERE len(a) >= 3),
line_texts AS (SELECT doc_id, p, a[p] || chr(10) || a[p + 1] || chr(10) || a[p + 2] AS w FROM line_windows),
line_order AS (SELECT doc_id, p, row_number() OVER (PARTITION BY w ORDER BY doc_id, p) AS k
               FROM line_texts WHERE regexp_matches(w, '[^ \\t\\n\\r]')),
line_cover AS (SELECT DISTINCT doc_id, p + unnest([0, 1, 2]) AS p FROM line_order WHERE k > 1),
line_all AS (SELECT doc_id, unnest(a) AS line, unnest(range(1, len(a) + 1)) AS p FROM line_docs WHERE a IS NOT NULL),
line_kept AS (SELECT l.doc_id, count(*) AS n_lines, count(c.p) AS n_removed,
                     coalesce(string_agg(line, chr(10) ORDER BY l.p) FILTER (c.p IS NULL), '') AS text
              FROM line_all l LEFT JOIN line_cover c ON c.doc_id = l.doc_id AND c.p = l.p GROUP BY l.doc_id)
"""

ORACLE = {"op1_line_dedup": "WITH " + LINES_SQL.format(source="documents").strip() + """
SELECT d.doc_id, coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_removed, 0) AS n_removed, sha256(k.text) AS kept_sha256
FROM documents d LEFT JOIN line_kept k USING (doc_id)
"""}

QUERIES = {"op1_line_dedup": op1_line_dedup}
