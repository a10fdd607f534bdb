"""A Merkle manifest of a dataset: hash trees over the rows of each group and over the groups.

Rows get their place in their group from one range shuffle.  An aligned block holds ``ARITY ** DEPTH``
consecutive nodes and keeps each of its levels as one hex string: parents are hashes of fixed-width
substrings, and what stands left and right of a node in its run of ``ARITY`` are the segments of its
proof.  The roots of the blocks are the nodes of the next, smaller pass, until every group is one node;
then the groups' roots go through the same passes.  So a group of any size is spread over its blocks,
a task holds one block of 81 nodes, and only built-in functions touch the digests.

Defined results.  A null field hashes as ``-``, an empty one as ``0:``.  Null groups are one group, which
comes first; null ids come first in their group.  Rows of equal id are ordered by their leaf, so repeated
rows stand side by side, each with its own place and proof.  A group of one row has the leaf as its
root, a table of one group the group's root as the root, and a node without siblings adds nothing to
a proof.  An empty table gives an empty table.  Long texts are hashed whole; columns that aren't named
are ignored, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelrisk.llm.common import col, shuffle_partitions, table, written

ARITY = 3
#: Levels of the tree in one block.
DEPTH = 4
#: Hex digits of a digest.
WIDTH = 64
_BLOCK = ARITY ** DEPTH
_PATH = "array<struct<left: string, right: string>>"


def leaf_digest(fields: Sequence[Column]) -> Column:
    """SHA-256 (hex) of the fields, each as ``<bytes>:<value>``, or ``-`` where it is null."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-"))
                             for t in texts]), 256)


def _parents(level: Column) -> Column:
    """The next level's digests as one string, from the digests of a level in one string."""
    run = ARITY * WIDTH
    return F.array_join(F.transform(F.sequence(F.lit(0), F.floor((F.length(level) - 1) / run).cast("int")),
                                    lambda i: F.sha2(F.substring(level, i * run + 1, F.lit(run)), 256)), "")


def _segments(level: Column, node: Column) -> Column:
    """What stands left and right of a node in its run, as a struct of two strings."""
    first = node - node % ARITY
    return F.struct(F.substring(level, first * WIDTH + 1, (node - first) * WIDTH).alias("left"),
                    F.substring(level, (node + 1) * WIDTH + 1, (first + ARITY - 1 - node) * WIDTH).alias("right"))


def _ranked(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """``rows`` with ``pos``, the place in its key's order from 0, and ``n``, the key's rows.

    A range shuffle puts the rows in order; a row's place is its place in its partition plus the rows of
    its key in the partitions before.  The windows see one row for a partition and key.
    """
    spread = written(rows.repartitionByRange(shuffle_partitions(rows.sparkSession), *key, *order)
                     .sortWithinPartitions(*key, *order).withColumn("at", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("at", 33).alias("part")  # the partition's number stands above the row's
    runs = spread.groupBy(part, *key).agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("size"))
    w = Window.partitionBy(*key).orderBy("part")
    runs = runs.select("part", *[F.col(k).alias(f"_{k}") for k in key], "first",
                       F.coalesce(F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
                       F.sum("size").over(Window.partitionBy(*key)).alias("n"))
    same = F.shiftright(spread["at"], 33) == runs["part"]
    for k in key:
        same &= spread[k].eqNullSafe(runs[f"_{k}"])
    return spread.join(runs, same).select(*rows.columns, (F.col("at") - F.col("first") + F.col("before")).alias("pos"), "n")


def _proofs(nodes: DataFrame, most: int, above: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(g, pos, node, item, path, roots) of nodes (g, pos, n, node, item): the nodes of group ``g`` in order.

    ``most`` is the size of the largest group; ``above`` gives (g, path, roots) for the groups' roots (g, node).
    """
    held = (nodes.groupBy("g", "n", F.floor(F.col("pos") / _BLOCK).alias("block"))
            .agg(F.array_sort(F.collect_list(F.struct("pos", "node", "item"))).alias("kids")))
    held = held.withColumn("l0", F.array_join(F.transform("kids", lambda x: x["node"]), ""))
    for j in range(DEPTH):
        held = held.withColumn(f"l{j + 1}", F.when(F.col("n") > ARITY ** j, _parents(F.col(f"l{j}"))).otherwise(F.col(f"l{j}")))
    blocks = written(held, "blocks")
    ends = blocks.select("g", F.col("block").alias("pos"), F.ceil(F.col("n") / _BLOCK).alias("n"),
                         F.col(f"l{DEPTH}").alias("node"), F.lit(None).cast("string").alias("item"))
    if most > _BLOCK:
        upper = _proofs(ends, -(-most // _BLOCK), above).select("g", F.col("pos").alias("block"), "path", "roots")
    else:
        upper = above(ends.select("g", "node")).select("g", F.lit(0).cast("long").alias("block"), "path", "roots")
    rows = blocks.join(upper, ["g", "block"]).select("*", F.posexplode("kids").alias("i", "kid"))
    own = F.filter(F.array(*[F.when(F.col("n") > ARITY ** j,
                                    _segments(F.col(f"l{j}"), F.floor(F.col("i") / ARITY ** j).cast("int")))
                             for j in range(DEPTH)]), lambda x: x.isNotNull())
    return rows.select("g", "kid.pos", "kid.node", "kid.item", F.concat(own, F.col("path")).alias("path"), "roots")


def manifest(docs: DataFrame, columns: Sequence[str], group_col: str = "source", id_col: str = "doc_id",
             carried: dict[str, Column] | None = None) -> DataFrame:
    """(id_col, the carried columns, leaf, subroot, root, path) of every row of ``docs``.

    ``leaf`` is the digest of ``columns``; ``subroot`` is its group's root, ``root`` the dataset's.  ``path`` has,
    from the leaf up to the root, the digests left and right of the row's node, one pair a level.
    """
    spark = docs.sparkSession
    carried = carried or {}
    item = F.struct(col(id_col).alias("id"), *[c.alias(f"c{k}") for k, c in enumerate(carried.values())])
    leaves = written(docs.select(col(group_col).alias("source"), item.alias("item"), leaf_digest([col(c) for c in columns]).alias("node"),
                                 F.monotonically_increasing_id().alias("serial")), "leaves")
    placed = _ranked(leaves.withColumn("id", F.col("item.id")), ["source"], ["id", "node", "serial"])
    groups = _ranked(leaves.select("source").distinct(), [], ["source"])
    groups = written(groups.select(F.col("source").alias("_source"), F.col("pos").alias("g"), F.col("n").alias("groups")), "groups")
    nodes = written(placed.join(groups, F.col("source").eqNullSafe(F.col("_source"))).select("g", "pos", "n", "node", "item"), "nodes")
    most, n_groups = nodes.agg(F.max("n"), F.max("g")).first()  # two numbers

    def top(ends: DataFrame) -> DataFrame:
        return ends.select("g", F.array().cast(_PATH).alias("path"), F.array("node").alias("roots"))

    def forest(ends: DataFrame) -> DataFrame:
        one = ends.select(F.lit(0).cast("long").alias("g"), F.col("g").alias("pos"), F.lit((n_groups or 0) + 1).cast("long").alias("n"),
                          "node", F.lit(None).cast("string").alias("item"))
        return _proofs(one, (n_groups or 0) + 1, top).select(F.col("pos").alias("g"), "path",
                                                             F.concat(F.array("node"), F.col("roots")).alias("roots"))

    out = _proofs(nodes, most or 0, forest)
    return out.select(F.col("item.id").alias(id_col), *[F.col(f"item.c{k}").alias(c) for k, c in enumerate(carried)],
                      F.col("node").alias("leaf"), F.col("roots")[0].alias("subroot"), F.col("roots")[1].alias("root"), "path")


def proof_digest(path: Column) -> Column:
    """SHA-256 (hex) of all siblings in a path, from left to right, level by level."""
    return F.sha2(F.array_join(F.transform(path, lambda x: F.concat(x["left"], x["right"])), ""), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings in its path give."""
    return F.aggregate(path, leaf, lambda node, x: F.sha2(F.concat(x["left"], node, x["right"]), 256))


FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*FIELDS)
    text = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    changed = leaf_digest([text if c == "text" else F.col(c) for c in FIELDS])
    rows = manifest(docs, FIELDS, carried={"changed": changed}).withColumn("folded_root", folded(F.col("changed"), F.col("path")))
    return rows.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), "folded_root",
                       (F.col("folded_root") == F.col("root")).alias("verified"))


def _sql_field(c: str) -> str:
    return f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || {c}, '-')"


_SQL_LEAF = " || ".join(map(_sql_field, FIELDS))
ORACLE = {"op11_merkle": f"""
WITH RECURSIVE hashed AS (
  SELECT doc_id, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS g, sha256({_SQL_LEAF}) AS leaf,
         sha256({_SQL_LEAF.replace('text', "replace(text, chr(10), '')")}) AS torn,
         list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
           lambda a, c: list_reduce(list_concat([xor(a, c)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
                                    lambda x, y: xor(x >> 1, (x & 1) * 3988292384))) AS crc
  FROM documents),
leaves AS (
  SELECT g, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n,
         doc_id, leaf, CASE WHEN xor(crc, 4294967295) % 2 = 0 THEN torn ELSE leaf END AS changed FROM hashed),
tree AS (
  SELECT g, 0 AS level, pos, leaf AS h, n FROM leaves
  UNION ALL
  SELECT g, any_value(level) + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (any_value(n) + 2) // 3
  FROM tree WHERE n > 1 GROUP BY g, pos // 3),
top AS (
  SELECT 0 AS level, g AS pos, h, count(*) OVER () AS n FROM tree WHERE n = 1
  UNION ALL
  SELECT any_value(level) + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (any_value(n) + 2) // 3
  FROM top WHERE n > 1 GROUP BY pos // 3),
levels AS (SELECT DISTINCT g, level FROM tree WHERE n > 1),
tops AS (SELECT DISTINCT level FROM top WHERE n > 1),
places AS (
  SELECT l.g, l.pos, v.level AS seq, l.pos // CAST(pow(3, v.level) AS BIGINT) AS node, l.g AS tg, v.level AS lv
  FROM leaves l JOIN levels v ON v.g = l.g
  UNION ALL
  SELECT l.g, l.pos, 1000 + v.level, l.g // CAST(pow(3, v.level) AS BIGINT), NULL, v.level FROM leaves l CROSS JOIN tops v),
kin AS (
  SELECT g AS tg, level, pos, h FROM tree WHERE n > 1 UNION ALL SELECT NULL, level, pos, h FROM top WHERE n > 1),
steps AS (
  SELECT a.g, a.pos, row_number() OVER (PARTITION BY a.g, a.pos ORDER BY a.seq) AS step,
         coalesce(string_agg(k.h, '' ORDER BY k.pos) FILTER (WHERE k.pos < a.node), '') AS l,
         coalesce(string_agg(k.h, '' ORDER BY k.pos) FILTER (WHERE k.pos > a.node), '') AS r
  FROM places a JOIN kin k ON k.tg IS NOT DISTINCT FROM a.tg AND k.level = a.lv AND k.pos // 3 = a.node // 3
  GROUP BY a.g, a.pos, a.seq),
proof AS (SELECT g, pos, sha256(string_agg(l || r, '' ORDER BY step)) AS p, max(step) AS n_steps FROM steps GROUP BY g, pos),
fold AS (
  SELECT g, pos, 0 AS step, changed AS h FROM leaves
  UNION ALL
  SELECT f.g, f.pos, f.step + 1, sha256(s.l || f.h || s.r) FROM fold f JOIN steps s ON s.g = f.g AND s.pos = f.pos AND s.step = f.step + 1)
SELECT l.doc_id, l.leaf, t.h AS subroot, o.h AS root, coalesce(p.p, sha256('')) AS proof_sha256, f.h AS folded_root, f.h = o.h AS verified
FROM leaves l JOIN (SELECT g, h FROM tree WHERE n = 1) t ON t.g = l.g CROSS JOIN (SELECT h FROM top WHERE n = 1) o
LEFT JOIN proof p ON p.g = l.g AND p.pos = l.pos
JOIN fold f ON f.g = l.g AND f.pos = l.pos AND f.step = coalesce(p.n_steps, 0)
"""}
QUERIES = {"op11_merkle": op11_merkle}
