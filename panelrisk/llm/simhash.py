"""SimHash near-duplicates with a Gray-order hierarchical index.

Fingerprints are computed in one pass over the texts.  Distinct fingerprints are then dealt into
groups such that any two within ``max_bits`` differing bits meet: the 64 bits are cut into
max_bits + 1 blocks, of which such a pair must have one in common, and every fingerprint goes to
the group of each of its blocks.  A group above ``split_above`` is dealt once more by
max_bits + 1 blocks of its other bits, which keeps the same promise.

Inside a group the fingerprints stand in Gray-code order, so that neighbours share most bits.
Leaves of a few neighbours, and nodes of a few children, keep the bits their members share, as a
mask and a value; a child keeps only what its parent has not already.  A query walks down with
the differences counted so far and drops a whole node when they exceed the limit.

What leaves a group is a star for each of its components, so a group of n copies makes fewer than
n links and not n squared; ``components`` joins the stars.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelrisk.llm.common import col, fresh, shuffle_partitions, table, written
from panelrisk.llm.components import components

SHINGLE = 4
MAX_BITS = 4
SEED = 42
FANOUT = 8
SPLIT_ABOVE = 20_000
_CHUNK = 1 << 16
_FRONTIER = 1 << 21


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of a text as an unsigned number; zero without words."""
    words = text.encode("utf-8", "replace").lower().split() if text else []
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    joined = memoryview(b" ".join(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    stops = ends[min(shingle, len(words)) - 1:]
    digest, ones = xxhash.xxh64_digest, np.zeros(64, np.int64)
    for a in range(0, n, _CHUNK):
        spans = zip(starts[a:min(a + _CHUNK, n)].tolist(), stops[a:a + _CHUNK].tolist())
        raw = np.frombuffer(b"".join([digest(joined[s:e], SEED) for s, e in spans]), np.uint8)
        ones += np.unpackbits(raw.reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, text_col: str = "text", shingle: int = SHINGLE) -> Column:
    """The fingerprint as a signed long."""

    @F.arrow_udf("long")
    def computed(texts: pa.Array) -> pa.Array:
        values = np.fromiter((fingerprint(x.as_py(), shingle) for x in texts), np.uint64, len(texts))
        return pa.array(values.view(np.int64))

    return computed(col(text_col))


def gray_rank(fp: Column) -> Column:
    """The place of a bit pattern in Gray-code order."""
    for k in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, k))
    return fp


def _cuts(bits: int, parts: int) -> list[tuple[int, int]]:
    """(start, width) of ``parts`` near equal blocks of ``bits`` bits."""
    at = [bits * i // parts for i in range(parts + 1)]
    return [(a, b - a) for a, b in zip(at, at[1:])]


def _block(fp: Column, start: int, width: int) -> Column:
    return F.shiftrightunsigned(F.shiftleft(fp, start), 64 - width)


def _keys(fp: Column, cuts: list[tuple[int, int]], names: tuple[str, str]) -> Column:
    return F.array(*[F.struct(F.lit(i).alias(names[0]), _block(fp, s, w).alias(names[1])) for i, (s, w) in enumerate(cuts)])


def _dealt(distinct: DataFrame, max_bits: int, split_above: int) -> DataFrame:
    """(b, v, c, u, fp): the groups (b, v, c, u) of each fingerprint; c is -1 in groups dealt once."""
    fp, first = F.col("fp"), _cuts(64, max_bits + 1)
    once = distinct.select("fp", F.explode(_keys(fp, first, ("b", "v"))).alias("k")).select("k.*", "fp")
    large = once.groupBy("b", "v").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > split_above).select("b", "v")
    marked = once.join(large.withColumn("again", F.lit(True)), ["b", "v"], "left")
    keys = F.when(F.col("again").isNull(), F.array(F.struct(F.lit(-1).alias("c"), F.lit(0).cast("long").alias("u"))))
    for i, (s, w) in enumerate(first):
        rest = F.lit(0).cast("long")  # the other bits, turned to the front
        if s + w < 64:
            rest = rest.bitwiseOR(F.shiftleft(fp, s + w))
        if s:
            rest = rest.bitwiseOR(F.shiftleft(_block(fp, 0, s), w))
        keys = keys.when(F.col("b") == i, _keys(rest, _cuts(64 - w, max_bits + 1), ("c", "u")))
    return marked.select("b", "v", F.explode(keys).alias("k"), "fp").select("b", "v", "k.*", "fp")


class GrayIndex:
    """A hierarchical index of distinct fingerprints that are in Gray order."""

    def __init__(self, fps: np.ndarray, fanout: int = FANOUT):
        self.fps, self.fanout, self.levels = fps, fanout, []
        both, either = fps, fps
        while True:
            cut = np.arange(0, len(both), fanout)
            both, either = np.bitwise_and.reduceat(both, cut), np.bitwise_or.reduceat(either, cut)
            self.levels.append([~(both ^ either), both])
            if len(cut) <= fanout:
                break
        self.levels.reverse()  # from the top
        for upper, lower in reversed(list(zip(self.levels, self.levels[1:]))):
            lower[0] = lower[0] & ~np.repeat(upper[0], fanout)[:len(lower[0])]
        known = None  # by entry, the bits that the nodes above it cover
        for mask, _ in self.levels:
            known = mask if known is None else np.repeat(known, fanout)[:len(mask)] | mask
        self.rest = ~np.repeat(known, fanout)[:len(fps)]

    def settled(self, root: np.ndarray) -> list[np.ndarray]:
        """For every node of each level the component that all its members are in, else -1."""
        out, low, high = [], root, root
        for _ in self.levels:
            cut = np.arange(0, len(low), self.fanout)
            low, high = np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut)
            out.append(np.where(low == high, low, -1))
        return out[::-1]

    def near(self, queries: np.ndarray, limit: int, after: np.ndarray, root: np.ndarray | None = None):
        """Pairs (query number, entry number) within ``limit`` bits whose entry number exceeds ``after``.

        With ``root``, the component of each entry, a query leaves out nodes whose members are all in the component
        of entry ``after``, itself.
        """
        settled = None if root is None else self.settled(root)
        f, depth = self.fanout, len(self.levels)
        q = np.repeat(np.arange(len(queries)), len(self.levels[0][0]))
        node = np.tile(np.arange(len(self.levels[0][0])), len(queries))
        gone = np.zeros(len(q), np.uint8)
        for k, (mask, value) in enumerate(self.levels):
            gone = gone + np.bitwise_count((queries[q] ^ value[node]) & mask[node])
            keep = (gone <= limit) & ((node + 1) * f ** (depth - k) - 1 > after[q])
            if settled is not None:
                keep &= settled[k][node] != root[after[q]]
            q, node, gone = q[keep], node[keep], gone[keep]
            below = len(self.levels[k + 1][0]) if k + 1 < depth else len(self.fps)
            q, gone = np.repeat(q, f), np.repeat(gone, f)
            node = (node[:, None] * f + np.arange(f)).ravel()
            inside = node < below
            q, node, gone = q[inside], node[inside], gone[inside]
        gone = gone + np.bitwise_count((queries[q] ^ self.fps[node]) & self.rest[node])
        keep = (gone <= limit) & (node > after[q])
        return q[keep], node[keep]


def linked(fps: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """The component of each of the distinct, Gray-ordered fingerprints: the first number in it.

    Queries run in blocks whose frontier fits a fixed room, and each block's pairs are merged into
    the components before the next block starts, which searches no node that is in the query's component already:
    a dense group becomes one component early, and little is left to search.
    """
    n = len(fps)
    root = np.arange(n)
    if n < 2:
        return root
    index, step = GrayIndex(fps), max(1, _FRONTIER // n)
    for a in range(0, n, step):
        rows = np.arange(a, min(a + step, n))
        q, b = index.near(fps[rows], limit, rows, root if a else None)
        p = rows[q]
        while True:
            x, y = root[p], root[b]
            odd = x != y
            if not odd.any():
                break
            np.minimum.at(root, np.maximum(x, y)[odd], np.minimum(x, y)[odd])
            while (root[root] != root).any():
                root = root[root]
    return root


def links(distinct: DataFrame, max_bits: int = MAX_BITS, split_above: int = SPLIT_ABOVE) -> DataFrame:
    """(u, v): links between distinct fingerprints ``fp`` that span the groups' components.

    Every pair within ``max_bits`` differing bits is in one component of these links, and every link
    joins fingerprints that a chain of such pairs joins.
    """

    def stars(batches):
        key, held = None, []

        def flush():
            fps = np.concatenate(held)
            root = linked(fps, max_bits)
            far = np.flatnonzero(root != np.arange(len(fps)))
            return fps[far].view(np.int64), fps[root[far]].view(np.int64)

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            fps = batch.column(4).to_numpy(zero_copy_only=False).view(np.uint64)
            new = np.zeros(len(fps), bool)
            for k in keys:
                new[1:] |= k[1:] != k[:-1]
            cut = [0, *np.flatnonzero(new).tolist(), len(fps)]
            out = []
            for a, b in zip(cut, cut[1:]):
                here = tuple(int(k[a]) for k in keys)
                if here != key:
                    if held:
                        out.append(flush())
                    key, held = here, []
                held.append(fps[a:b])
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], ["u", "v"])
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in flush()], ["u", "v"])

    return (_dealt(distinct, max_bits, split_above)
            .repartition(shuffle_partitions(distinct.sparkSession), "b", "v", "c", "u")
            .sortWithinPartitions("b", "v", "c", "u", gray_rank(F.col("fp")))
            .mapInArrow(stars, "u long, v long"))


def _grouped(docs: DataFrame, id_col: str, text_col: str, shingle: int, max_bits: int,
             split_above: int) -> tuple[DataFrame, DataFrame]:
    """((id, text_hash, fp) of every row, (fp, component) of every distinct fingerprint)."""
    rows = written(docs.select(col(id_col).alias("id"), F.xxhash64(col(text_col)).alias("text_hash"),
                               fingerprints(docs, text_col, shingle).alias("fp")), "simhash")
    distinct = rows.select("fp").distinct()
    found = components(links(distinct, max_bits, split_above))
    return rows, (distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left")
                  .select("fp", F.coalesce("root", "fp").alias("component")))


def simhash(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
            max_bits: int = MAX_BITS, split_above: int = SPLIT_ABOVE) -> DataFrame:
    """(id_col, text_hash, fingerprint, component_id, component), one row per row of ``docs``.

    A text of fewer words than a shingle is one shingle; a null, empty or blank text has fingerprint
    zero and is linked like any other.  Rows with equal fingerprints are linked.  ``component_id`` is
    the smallest id that is not null in the component, and null if all are; ``component`` is the
    smallest fingerprint in it, as a signed long.  Other columns are ignored.  An empty table gives
    an empty table.
    """
    rows, groups = _grouped(docs, id_col, text_col, shingle, max_bits, split_above)
    # rows meet one row a fingerprint, once; hot components meet in fingerprints only
    least = rows.groupBy("fp").agg(F.min("id").alias("least"))
    ids = groups.join(least, "fp").groupBy("component").agg(F.min("least").alias("component_id"))
    return rows.join(groups.join(ids, "component"), "fp").select(
        F.col("id").alias(id_col), "text_hash", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        "component_id", "component")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
               max_bits: int = MAX_BITS, split_above: int = SPLIT_ABOVE) -> DataFrame:
    """``docs`` with one document of each component: that with the smallest id.

    Of rows with one id the smallest text hash stays, of rows equal in id and text any one.  A null id
    stays only where the component has no other.
    """
    rows, groups = _grouped(docs, id_col, text_col, shingle, max_bits, split_above)
    first = F.struct(F.col("id").isNull().alias("none"), "id", "text_hash")
    none, known, th = fresh(docs, "_none", "_id", "_text_hash")
    least = rows.groupBy("fp").agg(F.min(first).alias("least"))
    stay = (groups.join(least, "fp").groupBy("component").agg(F.min("least").alias("s"))
            .select(F.col("s.none").alias(none), F.coalesce("s.id", F.lit(0)).alias(known),
                    F.col("s.text_hash").alias(th)))
    keyed = (docs.withColumn(none, col(id_col).isNull()).withColumn(known, F.coalesce(col(id_col), F.lit(0)))
             .withColumn(th, F.xxhash64(col(text_col))))
    return (keyed.join(stay, [none, known, th], "left_semi").dropDuplicates([none, known, th])
            .select(*[col(c) for c in docs.columns]))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "fingerprint", "component_id")


ORACLE: dict[str, str] = {}
QUERIES = {"op6_simhash": op6_simhash}
