"""Packing of token ids into fixed-length sequences by best-fit-decreasing.

Texts are encoded once; a document longer than a sequence is cut into whole sequences and a rest,
so that no token is lost.  The pieces are dealt at random over packing groups, whose number follows the
bytes of the corpus, and every group is packed on its own: pieces in decreasing length go to the sequence
with the least room that still holds them, which a segment tree over the possible rooms finds in
log2(length) steps.

A row of the result is one row of the id matrix, with the cumulative lengths of its segments, and
position ids that start again at 0 with each segment.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelrisk.llm.bpe import default_pattern, default_ranks, read_ranks
from panelrisk.llm.common import col, table

LENGTH = 2_048
#: Fills the rest of a sequence: the id that the rank file leaves free.
PAD_ID = 50_256
#: UTF-8 bytes of text for each packing group.
GROUP_BYTES = 8 << 20


class RoomTree:
    """A segment tree over the rooms 0..length; finds the least room, of those present, from a size up."""

    def __init__(self, length: int):
        self.size = 1 << length.bit_length()
        self.count = [0] * (2 * self.size)

    def add(self, room: int, n: int = 1) -> None:
        k = room + self.size
        while k:
            self.count[k] += n
            k >>= 1

    def least(self, need: int) -> int | None:
        count, k = self.count, need + self.size
        if count[k]:
            return need
        while k > 1:  # up, until a right neighbour has something
            if not k & 1 and count[k + 1]:
                k += 1
                break
            k >>= 1
        else:
            return None
        while k < self.size:  # down, to its leftmost leaf
            k = 2 * k if count[2 * k] else 2 * k + 1
        return k - self.size


def best_fit(lengths: list[int], length: int) -> list[list[int]]:
    """The pieces of each sequence; ``lengths`` are decreasing and at most ``length``."""
    tree, rooms, out = RoomTree(length), {}, []
    for piece, n in enumerate(lengths):
        room = tree.least(n)
        if room is None:
            at, room = len(out), length
            out.append([])
        else:
            at = rooms[room].pop()
            tree.add(room, -1)
        out[at].append(piece)
        if room > n:
            rooms.setdefault(room - n, []).append(at)
            tree.add(room - n)
    return out


def pieces(docs: DataFrame, groups: int, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
           ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    """(pack, doc, start, ids): the tokens of each text in pieces of at most ``length``, ids as "<u4"."""
    pattern = pattern or default_pattern()
    with open(ranks or default_ranks(), "rb") as f:
        ranks_file = docs.sparkSession.sparkContext.broadcast(f.read())  # its size does not depend on the corpus

    def cut(stream):
        import tiktoken

        own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=read_ranks(ranks_file.value), special_tokens={})
        rng = np.random.default_rng(TaskContext.get().partitionId())
        for batch in stream:
            for a in range(0, batch.num_rows, 500):
                doc, start, raw = [], [], []
                for d, t in zip(batch.column(0).slice(a, 500).to_pylist(), batch.column(1).slice(a, 500)):
                    ids = np.array(own.encode_ordinary(t.as_py() or ""), "<u4")
                    for s in range(0, len(ids), length):
                        doc.append(d)
                        start.append(s)
                        raw.append(ids[s:s + length].tobytes())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rng.integers(0, groups, len(doc)), pa.int64()), pa.array(doc, batch.schema.field(0).type),
                     pa.array(start, pa.int64()), pa.array(raw, pa.binary())], ["pack", "doc", "start", "ids"])

    rows = docs.select(col(id_col).alias("doc"), col(text_col).alias("text"))
    return rows.mapInArrow(cut, f"pack long, doc {rows.schema['doc'].dataType.simpleString()}, start long, ids binary")


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, pad_id: int = PAD_ID,
         group_bytes: int = GROUP_BYTES, **encoding) -> DataFrame:
    """(pack, sequence, n_tokens, ids, cu_seqlens, positions, docs, starts), one row per packed sequence.

    ``ids`` and ``positions`` are ``length`` little-endian unsigned 32-bit numbers, padded with ``pad_id`` and
    0; segment k holds the tokens from cu_seqlens[k] to cu_seqlens[k + 1], which are those of document
    docs[k] from token starts[k] on.  Texts without tokens (null or empty) take no place.  Repeated rows are
    packed as often as they occur; ids may be null; other columns are ignored; an empty table gives an empty
    table.  The same files give the same packing.
    """
    total = docs.agg(F.sum(F.octet_length(col(text_col)))).first()[0] or 0
    groups = -(-total // group_bytes) or 1
    cut = pieces(docs, groups, id_col, text_col, length, **encoding)

    def packed(part: pa.Table) -> pa.Table:
        raw = part.column("ids").to_pylist()
        size = np.fromiter(map(len, raw), np.int64, len(raw)) // 4
        doc, start = part.column("doc").to_pylist(), part.column("start").to_pylist()
        order = sorted(range(len(raw)), key=lambda i: (-size[i], doc[i] is None, doc[i], start[i], raw[i]))
        rows: dict[str, list] = {c: [] for c in ("n_tokens", "ids", "cu_seqlens", "positions", "docs", "starts")}
        for members in best_fit([int(size[i]) for i in order], length):
            own = [order[k] for k in members]
            ends = np.cumsum(size[own])
            n = int(ends[-1])
            ids, positions = np.full(length, pad_id, "<u4"), np.zeros(length, "<u4")
            ids[:n] = np.frombuffer(b"".join(raw[i] for i in own), "<u4")
            positions[:n] = np.arange(n) - np.repeat(ends - size[own], size[own])
            for c, x in zip(rows, (n, ids.tobytes(), [0, *ends.tolist()], positions.tobytes(),
                                   [doc[i] for i in own], [start[i] for i in own])):
                rows[c].append(x)
        k = len(rows["ids"])
        kinds = (pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.binary(), pa.list_(part.schema.field("doc").type),
                 pa.list_(pa.int64()))
        return pa.table({"pack": pa.array([part.column("pack")[0].as_py()] * k, pa.int64()),
                         "sequence": pa.array(range(k), pa.int32()),
                         **{c: pa.array(x, t) for (c, x), t in zip(rows.items(), kinds)}})

    kind = cut.schema["doc"].dataType.simpleString()
    return cut.groupBy("pack").applyInArrow(
        packed, "pack long, sequence int, n_tokens int, ids binary, cu_seqlens array<int>, positions binary, "
                f"docs array<{kind}>, starts array<long>")


def write_packed(packed: DataFrame, path: str) -> None:
    """Writes the id matrix, segment lengths, positions and origins as Parquet, whole packing groups to a file."""
    packed.repartition("pack").sortWithinPartitions("pack", "sequence").write.parquet(path)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return packed.select("pack", "sequence", "n_tokens", F.col("docs").alias("doc_ids"), "starts", "cu_seqlens",
                         F.sha2("ids", 256).alias("ids_sha256"), F.sha2("positions", 256).alias("positions_sha256"))


ORACLE: dict[str, str] = {}
QUERIES = {"op3_packing": op3_packing}
