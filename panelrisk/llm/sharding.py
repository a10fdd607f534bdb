"""Sharding by a minimax contiguous partition.

Documents stand in the order of their texts' hashes, so that equal texts are neighbours: each such
group is one atom.  Of all ways to cut this order into ``n_shards`` runs of whole groups, the one
whose largest run has the fewest bytes is found by a binary search for the smallest capacity that a
greedy filling can meet.

The greedy check needs the places where groups end, as running sums of bytes.  There can be billions,
so the driver sees a bounded number of them at a time: the range is laid out in cells, each cell tells
its first and last group end, and the check runs twice, once on the safe side and once on the hopeful
side.  That brackets the capacity and every cut; the next round lays the cells over the brackets only.
It ends when both checks agree, with the exact answer.

The capacity bounds the largest run only; filling every run up to it would leave the last ones empty
where one group is large.  So each run is cut at the group end nearest to its even share of what is left,
within the capacity and where the rest still fits the runs left.

Running sums and places come from one range shuffle of narrow rows (no texts), in which a hot group is
split over partitions because the document id is part of the range key.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelrisk.llm.common import col, shuffle_partitions, table, written

N_SHARDS = 40
OVERHEAD = 16
#: Cells that the driver sees in one round.
CELLS = 20_000


def _placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` in the given total order, with ``place`` (from 1) and ``ends`` (running sum of ``size``)."""
    spark = rows.sparkSession

    def count(stream):
        place = total = 0
        for batch in stream:
            size = batch.column(batch.schema.get_field_index("size")).to_numpy(zero_copy_only=False)
            sums = total + np.cumsum(size)
            at = place + np.arange(1, len(size) + 1)
            if len(size):
                place, total = int(at[-1]), int(sums[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at, pa.int64()), pa.array(sums, pa.int64())],
                                             [*batch.schema.names, "place", "ends"])

    schema = T.StructType([*rows.schema.fields, T.StructField("place", T.LongType()), T.StructField("ends", T.LongType())])
    local = (rows.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order)
             .mapInArrow(count, schema).withColumn("part", F.spark_partition_id()))
    local = written(local, "placed")
    before, place, total = [], 0, 0
    for r in local.groupBy("part").agg(F.max("place").alias("n"), F.max("ends").alias("s")).orderBy("part").collect():
        before.append((r["part"], place, total))  # a row for each partition
        place, total = place + r["n"], total + r["s"]
    offsets = spark.createDataFrame(before, "part int, place_ long, ends_ long")
    return (local.join(F.broadcast(offsets), "part")
            .withColumns({"place": F.col("place") + F.col("place_"), "ends": F.col("ends") + F.col("ends_")})
            .select(*rows.columns, "place", "ends"))


class _Ends:
    """What is known of the group ends: some of them, and the intervals that may hide more."""

    def __init__(self, total: int):
        self.total, self.known, self.hidden = total, [total], [(0, total)]

    def learn(self, ranges: list[tuple[int, int]], cells: list[tuple[int, int]]) -> None:
        """``cells``: the first and last end in each cell of the ranges, which were looked into anew."""
        self.known = sorted({*self.known, *(x for c in cells for x in c)})
        left = [h for h in self.hidden if not any(a <= h[0] and h[1] <= b for a, b in ranges)]
        self.hidden = sorted([*left, *(c for c in cells if c[1] - c[0] > 1)])

    def reach(self, up: int, hopeful: bool) -> int:
        """The last known end up to ``up``; hopeful: the last place where an end could be."""
        k = bisect_right(self.known, up)
        out = self.known[k - 1] if k else 0
        if hopeful:
            k = bisect_right(self.hidden, (up, 0)) - 1
            if k >= 0 and self.hidden[k][0] < up < self.hidden[k][1]:
                return up
        return out

    def fill(self, capacity: int, shards: int, hopeful: bool) -> list[int] | None:
        """The cuts of a greedy filling, or None if it takes more than ``shards``."""
        at, cuts = 0, []
        while at < self.total:
            nxt = self.reach(min(at + capacity, self.total), hopeful)
            if nxt <= at or len(cuts) == shards:
                return None
            cuts.append(nxt)
            at = nxt
        return cuts

    def least(self, low: int, high: int, shards: int, hopeful: bool) -> int:
        """The smallest capacity above ``low`` that the check meets, by binary search; ``high`` meets it."""
        while high - low > 1:
            mid = (low + high) // 2
            low, high = (low, mid) if self.fill(mid, shards, hopeful) else (mid, high)
        return high

    def unsure(self, low: int, high: int, shards: int) -> list[tuple[int, int]]:
        """Ranges around the hidden intervals that fillings of capacities from ``low`` to ``high`` meet."""
        out: list[tuple[int, int]] = []
        at_low = at_high = 0
        for _ in range(shards):
            a, b = min(at_low + low, self.total), min(at_high + high, self.total)
            met = [h for h in self.hidden if h[0] < b and h[1] > a]
            if met:
                if out and met[0][0] <= out[-1][1]:
                    met[0] = (min(out[-1][0], met[0][0]), 0)
                    met.append((0, max(out.pop()[1], met[-1][1])))
                out.append((met[0][0], met[-1][1]))
            at_low, at_high = max(at_low, self.reach(a, False)), max(at_high, self.reach(b, True))
        return out

    def large(self, shards: int) -> list[tuple[int, int]]:
        """(start, end) of the groups above the even share of what lies outside such groups; fewer than ``shards``."""
        groups = []
        for a, b in zip([0, *self.known], self.known):
            k = bisect_right(self.hidden, (a, self.total)) - 1
            if k < 0 or self.hidden[k][1] < b:  # no end is hidden between
                groups.append((a, b))
        out, rest = [], self.total
        for a, b in sorted(groups, key=lambda g: g[0] - g[1]):
            if (b - a) * (shards - len(out)) <= rest:
                break
            out.append((a, b))
            rest -= b - a
        return out

    def even(self, capacity: int, shards: int) -> tuple[list[int], list[tuple[int, int]]]:
        """(cuts, hidden intervals at which a nearer end may lie) of runs of nearly even size.

        A run ends at the known end nearest to its share of the bytes left: groups that are larger than
        a share have a run each, the stretches between them are shared by the other runs.  No run is above ``capacity``, which known
        ends can meet; none is empty if there are as many groups.  The last ``shards`` ends must be known.
        """
        known, runs = self.known, min(shards, len(self.known))
        large = self.large(runs)
        need = [self.total]  # the first place from which so many runs hold the rest
        for _ in range(runs):
            need.append(known[bisect_left(known, need[-1] - capacity)] if need[-1] > capacity else 0)
        at, cuts, unsure = 0, [], []
        for left in reversed(range(runs)):
            ahead = [g for g in large if g[0] >= at]
            rest, over = self.total - at - sum(b - a for a, b in ahead), left + 1 - len(ahead)
            stretch = min((a for a, _ in ahead), default=self.total) - at  # up to the next large group
            if over > 0 and stretch:
                aim = at + stretch // max(1, round(stretch * over / rest))
            else:
                aim = at + (self.total - at) // (left + 1)
            first = max(bisect_right(known, at), bisect_left(known, need[left]))
            last = min(bisect_right(known, at + capacity), len(known) - left) - 1
            k = bisect_left(known, aim, first, last)
            if k > first and aim - known[k - 1] <= known[k] - aim:
                k -= 1
            h = bisect_right(self.hidden, (aim, 0)) - 1
            if left and h >= 0 and self.hidden[h][0] < aim < self.hidden[h][1]:
                unsure.append(self.hidden[h])
            at = known[k]
            cuts.append(at)
        return cuts, sorted(set(unsure))


def minimax_cuts(ends: DataFrame, shards: int, cells: int = CELLS) -> tuple[int, list[int]]:
    """(capacity, cuts) of the smallest largest run; ``ends`` has a row ``ends`` for each group end.

    The cuts are the running sums at which the runs end: one for each of the ``shards``, or for each
    group where there are fewer.
    """
    total = ends.agg(F.max("ends")).first()[0]
    if not total:
        return 0, []
    low, high = -(-total // shards) - 1, total  # low can't be met, high can
    known, ranges = _Ends(total), [(0, total)]

    def look() -> None:
        each = max(2, cells // len(ranges))
        cell = None
        for i, (a, b) in enumerate(ranges):
            number = F.lit(i * each) + F.floor((F.col("ends") - (a + 1)) / F.lit(-(-(b - a) // each)))
            inside = (F.col("ends") > a) & (F.col("ends") <= b)
            cell = F.when(inside, number) if cell is None else cell.when(inside, number)
        seen = (ends.withColumn("cell", cell).filter("cell is not null").groupBy("cell")
                .agg(F.min("ends").alias("a"), F.max("ends").alias("b")).collect())
        known.learn(ranges, [(r["a"], r["b"]) for r in seen])

    while high - low > 1:
        look()
        high = known.least(low, high, shards, False)
        low = known.least(low, high, shards, True) - 1
        ranges = known.unsure(low + 1, high, shards)
    known.learn([], [(r["ends"],) * 2 for r in ends.orderBy(F.desc("ends")).limit(shards).collect()])
    while True:
        cuts, ranges = known.even(high, shards)
        if not ranges:
            return high, cuts
        look()


def shard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_shards: int = N_SHARDS,
          overhead: int = OVERHEAD, cells: int = CELLS) -> DataFrame:
    """(id_col, size, text_crc32, shard, slot), one row per row of ``docs``.

    ``size`` is the text's UTF-8 bytes (null: none) plus ``overhead``.  Equal texts are in one shard; all
    nulls are equal, and differ from the empty text.  The largest shard is as small as whole groups in
    hash order allow, and the others share the rest nearly evenly.  ``slot`` counts from 0 without gaps
    in each shard, in the order (text hash, id); ties of repeated rows in file order.  Fewer groups than shards leave the last shards empty; an empty table
    gives an empty table.  Ids may be null; other columns are ignored.
    """
    text = col(text_col)
    rows = written(docs.select(
        col(id_col).alias("id"), (F.coalesce(F.octet_length(text), F.lit(0)) + overhead).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text, text.isNull()).alias("h1"),
        F.xxhash64(F.lit(1), text).alias("h2"), F.monotonically_increasing_id().alias("row")), "sizes")
    placed = written(_placed(rows, ["h1", "h2", "id", "row"]), "places")
    ends = written(placed.groupBy("h1", "h2").agg(F.max("ends").alias("ends")).select("ends"), "ends")
    _, cuts = minimax_cuts(ends, n_shards, cells)
    number = F.lit(0)
    for c in cuts[:-1]:
        number = number + (F.col("ends") > c).cast("int")
    dealt = placed.withColumn("shard", number)
    start = dealt.groupBy("shard").agg(F.min("place").alias("start"))  # n_shards rows
    return (dealt.join(F.broadcast(start), "shard")
            .select(F.col("id").alias(id_col), "size", "text_crc32", "shard",
                    (F.col("place") - F.col("start")).alias("slot")))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))


ORACLE: dict[str, str] = {}
QUERIES = {"op7_sharding": op7_sharding}
