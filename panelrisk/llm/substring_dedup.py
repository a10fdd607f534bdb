"""Substring deduplication over a compacted de Bruijn graph of word k-mers.

Nodes are runs of k - 1 words, and every window of k words is an edge from its first k - 1 words to its last.
Edges that occur in more than one document make the graph of repeated text; where it does not branch,
its edges join to paths.  A window goes when the same words also start in a document with a smaller id.

1. *Blocks.*  The minimizer of a window is the least hash among its runs of ``SEED`` words.  Consecutive
   windows of a document with one minimizer are a block: a path by construction.  Equal windows have equal
   minimizers, so only windows whose minimizer occurs in two documents can be repeated.  Each batch of
   documents sends its distinct minimizers, dealt by hash, and gets back those that repeat.
2. *Edges.*  The blocks with repeated minimizers are sent by minimizer, once for each content and batch, with
   their windows' hashes.  There every edge gets the coordinate of its first source: the least (document id,
   word number).  Consecutive edges whose sources are consecutive too do not branch and are compacted to one
   path piece; a node where occurrences part shows as a jump of the source coordinate and ends the piece.
3. *Paths.*  Pieces are joined back to their batches, and pieces of one document that continue each other, in
   the document and at the source, are glued to long spans across block ends.
4. *Verification.*  Every distinct source coordinate is joined with the document it lies in; a span counts only
   where a digest of its words equals that of the words at its source.
5. The verified spans are joined with the texts; the positions they cover are merged and removed.

A minimizer, window or passage that a third of all documents hold is one entry of each batch.  The texts are
shuffled once, compressed by batches; every later join of the plan uses that exchange again.  Batches are formed
in file order, so ``docs`` has to come from files by narrow operations only; write it first where it doesn't.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelrisk.llm.common import col, give_back, shuffle_partitions, table
from panelrisk.llm.words import Words, mix, split

WINDOW = 13
SEED = 5
BATCH_BYTES = 4 << 20
BATCH_DOCS = 4_096
#: A source is told as (batch number << PLACE_BITS) + place in the batch.
PLACE_BITS = 13
#: Stands for a null id: never smaller than another.
NO_ID = np.iinfo(np.int64).max
_SHORT = np.uint64((1 << 48) - 1)


def _bytes(x: np.ndarray, kind: str) -> bytes:
    return np.ascontiguousarray(x, kind).tobytes()


def _planes(m: np.ndarray) -> bytes:
    """48-bit numbers, six bytes each."""
    return _bytes(m & np.uint64(0xFFFFFFFF), "<u4") + _bytes(m >> np.uint64(32), "<u2")


def _unplanes(raw: bytes) -> np.ndarray:
    n = len(raw) // 6
    return np.frombuffer(raw, "<u4", n).astype(np.uint64) | np.frombuffer(raw, "<u2", n, 4 * n).astype(np.uint64) << np.uint64(32)


class Blocks:
    """The blocks of a batch: first window's word number, windows, minimizer, document and content hash."""

    def __init__(self, words: Words, window: int, seed: int, keep: np.ndarray | None = None):
        grams, at = words.grams(seed)
        self.words, self.window = words, window
        full = np.full(len(words.hashes) + window, np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64)
        full[at] = grams
        span = window - seed + 1
        doc_end = np.repeat(words.first[1:], words.counts)
        starts = np.flatnonzero(np.arange(len(words.hashes)) + window <= doc_end)
        least, place = full[starts], np.zeros(len(starts), np.int8)
        for k in range(1, span):
            other = full[starts + k]
            less = other < least
            least, place = np.where(less, other, least), np.where(less, np.int8(k), place)
        spot = starts + place
        new = np.ones(len(starts), bool)
        new[1:] = (spot[1:] != spot[:-1]) | (starts[1:] != starts[:-1] + 1)
        first = np.flatnonzero(new)
        self.start = starts[first]
        self.n = np.diff(np.append(first, len(starts))).astype(np.int64)
        self.minimizer = least[first] & _SHORT
        if keep is not None:
            known = np.isin(self.minimizer, keep)
            self.start, self.n, self.minimizer = self.start[known], self.n[known], self.minimizer[known]
        self.doc = np.searchsorted(words.first, self.start, "right") - 1

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """(hashes of the windows of all blocks, each block's first among them)."""
        at = np.repeat(self.start, self.n) + _steps(self.n)
        h = np.zeros(len(at), np.uint64)
        for k in range(self.window):
            h = h * np.uint64(0x9E3779B97F4A7C15) + self.words.hashes[at + k]
        return mix(h), np.concatenate(([0], np.cumsum(self.n)))

    def content(self, h: np.ndarray, first: np.ndarray) -> np.ndarray:
        if not len(self.start):
            return np.zeros(0, np.uint64)
        return mix(h[first[:-1]] * np.uint64(3) + h[first[1:] - 1] * np.uint64(5) + self.n.astype(np.uint64))


def _steps(n: np.ndarray) -> np.ndarray:
    """0 .. n[0] - 1, 0 .. n[1] - 1, ..."""
    return np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)


class Batch:
    """A batch of documents, out of its row."""

    def __init__(self, part: pa.Table):
        self.number = part.column("batch")[0].as_py()
        self.ids = np.frombuffer(part.column("ids")[0].as_py(), "<i8")
        sizes = np.frombuffer(part.column("sizes")[0].as_py(), "<u4")
        self.raw = zstandard.ZstdDecompressor().decompress(part.column("texts")[0].as_py()) if sizes.sum() else b""
        ends = np.cumsum(sizes, dtype=np.int64).tolist()
        self.words = split([self.raw[a:b].decode() for a, b in zip([0, *ends], ends)])

    def refs(self, docs: np.ndarray) -> np.ndarray:
        return (self.number << PLACE_BITS) + docs.astype(np.int64)

    def word_bytes(self, a: int, b: int) -> list[bytes]:
        raw = self.words.raw
        return [raw[s:e].tobytes() for s, e in zip(self.words.starts[a:b].tolist(), self.words.ends[a:b].tolist())]

    def digest(self, a: int, n_words: int) -> bytes:
        return hashlib.blake2b(b" ".join(self.word_bytes(a, a + n_words)), digest_size=16).digest()


def _representatives(batch: Batch, blocks: Blocks, content: np.ndarray):
    """(distinct contents, the block that stands for each: the first by (id, place, word); number of each block)."""
    order = np.lexsort((blocks.start, batch.ids[blocks.doc], content)) if len(content) else np.zeros(0, np.int64)
    sorted_content = content[order]
    new = np.ones(len(order), bool)
    new[1:] = sorted_content[1:] != sorted_content[:-1]
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    return sorted_content[new], order[new], number


def _tidy(work):
    """A function of two tables that leaves its worker small."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = work(left, right)
        give_back()
        return out

    return run


def _batched(batch_docs: int, batch_bytes: int):
    def form(stream):
        part, serial = TaskContext.get().partitionId(), 0
        ids, texts, size = [], [], 0
        press = zstandard.ZstdCompressor(level=3)

        def row():
            return pa.RecordBatch.from_arrays(
                [pa.array([(part << 24) + serial], pa.int64()), pa.array([_bytes(np.array(ids, np.int64), "<i8")], pa.binary()),
                 pa.array([_bytes(np.array([len(t) for t in texts], np.int64), "<u4")], pa.binary()),
                 pa.array([press.compress(b"".join(texts))], pa.binary())], ["batch", "ids", "sizes", "texts"])

        for rows in stream:
            for i, t in zip(rows.column(0).to_pylist(), rows.column(1)):
                ids.append(NO_ID if i is None else i)
                texts.append((t.as_py() or "").encode("utf-8", "replace"))
                size += len(texts[-1])
                if size >= batch_bytes or len(ids) >= batch_docs:
                    yield row()
                    serial, ids, texts, size = serial + 1, [], [], 0
        if ids:
            yield row()

    return form


def spans(batches: DataFrame, window: int, seed: int, buckets: int) -> DataFrame:
    """(batch, doc, start, n, source, source_start, digest): repeated paths with an earlier source.

    ``doc`` numbers the documents of the batch; a span covers n words from word ``start`` on, which are
    also found in the document ``source`` from its word ``source_start`` on.
    """

    def minimizers(stream):
        for rows in stream:
            for k in range(rows.num_rows):
                batch = Batch(pa.Table.from_batches([rows.slice(k, 1)]))
                b = Blocks(batch.words, window, seed)
                pairs = np.unique(np.stack([b.minimizer, batch.ids[b.doc].view(np.uint64)]), axis=1) if len(b.doc) else np.zeros((2, 0), np.uint64)
                m, n = np.unique(pairs[0], return_counts=True)
                bucket = (m % np.uint64(buckets)).astype(np.int64)
                order = np.lexsort((m, bucket))
                cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
                full = np.flatnonzero(cut[1:] > cut[:-1])
                own = [order[cut[x]:cut[x + 1]] for x in full.tolist()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(full.astype(np.int32)), pa.array([batch.number] * len(full), pa.int64()),
                     pa.array([_planes(m[o]) for o in own], pa.binary()),
                     pa.array([np.packbits(n[o] > 1).tobytes() for o in own], pa.binary())],
                    ["bucket", "batch", "m", "twice"])
        give_back()

    def repeated(part: pa.Table) -> pa.Table:
        """Minimizers of two documents, by batch."""
        ms = [_unplanes(r) for r in part.column("m").to_pylist()]
        m = np.concatenate(ms)
        twice = np.concatenate([np.unpackbits(np.frombuffer(r, np.uint8), count=len(x)) for r, x in
                                zip(part.column("twice").to_pylist(), ms)]).astype(np.int64)
        values, back = np.unique(m, return_inverse=True)
        keep = np.bincount(back, weights=1 + twice, minlength=len(values))[back] > 1
        cut = np.cumsum([0, *map(len, ms)])
        return pa.table({"batch": part.column("batch"),
                         "m": pa.array([_planes(m[a:b][keep[a:b]]) for a, b in zip(cut, cut[1:])], pa.binary())})

    def edges(left: pa.Table, right: pa.Table) -> pa.Table:
        """The distinct blocks of a batch that may be repeated, with the hashes of their windows."""
        names = ("bucket", "batch", "content", "n", "h", "id", "source", "at")
        kinds = (pa.int32(), pa.int64(), *[pa.binary()] * 6)
        rows: list[list] = [[] for _ in names]
        if left.num_rows and right.num_rows:
            batch = Batch(left)
            keep = np.concatenate([_unplanes(r) for r in right.column("m").to_pylist()])
            b = Blocks(batch.words, window, seed, keep)
            h, first = b.windows()
            content, stand, _ = _representatives(batch, b, b.content(h, first))
            bucket = (b.minimizer[stand] % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
            for x in np.flatnonzero(cut[1:] > cut[:-1]).tolist():
                o = order[cut[x]:cut[x + 1]]
                s = stand[o]
                which = np.repeat(first[s], b.n[s]) + _steps(b.n[s])
                for out, v in zip(rows, (x, batch.number, _bytes(content[o], "<u8"), _bytes(b.n[s], "u1"), _bytes(h[which], "<u8"),
                                         _bytes(batch.ids[b.doc[s]], "<i8"), _bytes(batch.refs(b.doc[s]), "<i8"),
                                         _bytes(b.start[s] - batch.words.first[b.doc[s]], "<i8"))):
                    out.append(v)
        return pa.table({c: pa.array(x, t) for c, x, t in zip(names, rows, kinds)})

    def sources(part: pa.Table) -> pa.Table:
        """Path pieces: consecutive edges of a block whose first sources are consecutive, and in a smaller document."""
        get = lambda c, t: [np.frombuffer(r, t) for r in part.column(c).to_pylist()]
        contents, ns = get("content", "<u8"), get("n", "u1")
        content, n = np.concatenate(contents), np.concatenate(ns).astype(np.int64)
        h, own, ref, at = (np.concatenate(get(c, t)) for c, t in (("h", "<u8"), ("id", "<i8"), ("source", "<i8"), ("at", "<i8")))
        block = np.repeat(np.arange(len(n)), n)
        off = _steps(n)
        doc, ref, pos = own[block], ref[block], at[block] + off
        order = np.lexsort((pos, ref, doc, h))
        new = np.ones(len(h), bool)
        new[1:] = h[order][1:] != h[order][:-1]
        lead = order[new][np.cumsum(new) - 1]
        sdoc, sref, spos = (np.empty(len(h), np.int64) for _ in range(3))
        sdoc[order], sref[order], spos[order] = doc[lead], ref[lead], pos[lead]
        earlier = sdoc < doc
        begins = np.ones(len(h), bool)
        begins[1:] = ((block[1:] != block[:-1]) | ~earlier[:-1] | (sref[1:] != sref[:-1]) | (spos[1:] != spos[:-1] + 1))
        first = np.flatnonzero(begins)
        size = np.diff(np.append(first, len(h)))
        good = earlier[first]
        first, size = first[good], size[good]
        row = np.repeat(np.arange(len(ns)), [len(x) for x in ns])[block[first]]  # pieces stay in order of their rows
        cut = np.searchsorted(row, np.arange(len(ns) + 1))
        out = [(content[block[first]], "<u8"), (off[first], "u1"), (size, "u1"), (sdoc[first], "<i8"), (sref[first], "<i8"), (spos[first], "<i8")]
        return pa.table({"batch": part.column("batch"), **{
            c: pa.array([_bytes(x[a:b], t) for a, b in zip(cut, cut[1:])], pa.binary())
            for c, (x, t) in zip(("content", "off", "size", "id", "source", "at"), out)}})

    def glued(left: pa.Table, right_m: pa.Table) -> pa.Table:
        """The spans of a batch: its pieces, and blocks repeated inside the batch, glued where they continue."""
        names = ("batch", "doc", "start", "n", "source", "source_start", "digest")
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        empty = pa.table({c: pa.array([], t) for c, t in zip(names, kinds)})
        if not left.num_rows or not right_m.num_rows:
            return empty
        batch = Batch(left)
        get = lambda c, t: np.concatenate([np.frombuffer(r or b"", t) for r in right_m.column(c).to_pylist()])
        keep = np.concatenate([_unplanes(r or b"") for r in right_m.column("m").to_pylist()])
        b = Blocks(batch.words, window, seed, keep)
        h, first = b.windows()
        content, stand, number = _representatives(batch, b, b.content(h, first))
        # by distinct content: sources of its windows, those of the representative unless a piece tells an earlier one
        n = b.n[stand]
        base = np.concatenate(([0], np.cumsum(n)))
        sdoc, sref = np.repeat(batch.ids[b.doc[stand]], n), np.repeat(batch.refs(b.doc[stand]), n)
        spos = np.repeat(b.start[stand] - batch.words.first[b.doc[stand]], n) + _steps(n)
        size = get("size", "u1").astype(np.int64)
        where = np.searchsorted(content, get("content", "<u8"))
        to = np.repeat(base[where] + get("off", "u1"), size) + _steps(size)
        sdoc[to], sref[to] = np.repeat(get("id", "<i8"), size), np.repeat(get("source", "<i8"), size)
        spos[to] = np.repeat(get("at", "<i8"), size) + _steps(size)
        # by window of every block
        src = np.repeat(base[number], b.n) + _steps(b.n)
        at = np.repeat(b.start, b.n) + _steps(b.n)
        doc = np.repeat(b.doc, b.n)
        gone = sdoc[src] < batch.ids[doc]
        at, doc, sref, spos = at[gone], doc[gone], sref[src][gone], spos[src][gone]
        if not len(at):
            return empty
        new = np.ones(len(at), bool)
        new[1:] = ((at[1:] != at[:-1] + 1) | (doc[1:] != doc[:-1]) | (sref[1:] != sref[:-1]) | (spos[1:] != spos[:-1] + 1))
        f = np.flatnonzero(new)
        n_words = np.diff(np.append(f, len(at))) + window - 1
        return pa.table({
            "batch": pa.array([batch.number] * len(f), pa.int64()), "doc": pa.array(doc[f], pa.int32()),
            "start": pa.array(at[f] - batch.words.first[doc[f]], pa.int64()), "n": pa.array(n_words, pa.int64()),
            "source": pa.array(sref[f]), "source_start": pa.array(spos[f]),
            "digest": pa.array([batch.digest(a, k) for a, k in zip(at[f].tolist(), n_words.tolist())], pa.binary())})

    found = (batches.mapInArrow(minimizers, "bucket int, batch long, m binary, twice binary")
             .groupBy("bucket").applyInArrow(repeated, "batch long, m binary").filter("length(m) > 0"))
    per_batch = batches.groupBy("batch")
    pieces = (per_batch.cogroup(found.groupBy("batch"))
              .applyInArrow(_tidy(edges), "bucket int, batch long, content binary, n binary, h binary, id binary, source binary, at binary")
              .groupBy("bucket").applyInArrow(sources, "batch long, content binary, off binary, size binary, "
                                                       "id binary, source binary, at binary"))
    none = [F.lit(None).cast("binary").alias(c) for c in ("content", "off", "size", "id", "source", "at")]
    told = (found.select("batch", "m", *none)
            .unionByName(pieces.select("batch", F.lit(None).cast("binary").alias("m"), "content", "off", "size", "id", "source", "at")))
    return per_batch.cogroup(told.groupBy("batch")).applyInArrow(
        _tidy(glued), "batch long, doc int, start long, n long, source long, source_start long, digest binary")


def verified(batches: DataFrame, found: DataFrame) -> DataFrame:
    """The spans whose words are those at their source."""
    asked = (found.select("source", "source_start", "n").distinct()
             .withColumn("holder", F.shiftright("source", PLACE_BITS)))

    def told(left: pa.Table, right: pa.Table) -> pa.Table:
        digests: list = []
        if left.num_rows and right.num_rows:
            batch = Batch(left)
            first, counts = batch.words.first, batch.words.counts
            for p, a, n in zip(*(right.column(c).to_pylist() for c in ("source", "source_start", "n"))):
                p &= (1 << PLACE_BITS) - 1
                digests.append(batch.digest(int(first[p]) + a, n) if a + n <= counts[p] else None)
        return pa.table({"source": pa.array(right.column("source") if digests else [], pa.int64()),
                         "source_start": pa.array(right.column("source_start") if digests else [], pa.int64()),
                         "n": pa.array(right.column("n") if digests else [], pa.int64()),
                         "digest": pa.array(digests, pa.binary())})

    truth = (batches.groupBy("batch").cogroup(asked.groupBy("holder"))
             .applyInArrow(told, "source long, source_start long, n long, digest binary"))
    return found.join(truth, ["source", "source_start", "n", "digest"], "left_semi")


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                    seed: int = SEED, batch_bytes: int = BATCH_BYTES, batch_docs: int = BATCH_DOCS) -> DataFrame:
    """(id_col, n_words, n_removed, kept), one row per row of ``docs``; ``kept`` joins the words left by a blank.

    Words are runs without ASCII white space.  A word goes if a window of ``window`` words that covers it also
    starts in a document with a smaller id.  Windows are judged on the input.  Null and empty texts have no
    words.  Rows of equal ids (integers) take nothing from each other, nor do null ids, which count as larger
    than all others.  Other columns are ignored; an empty table gives an empty table.
    """
    if batch_docs > 1 << PLACE_BITS:
        raise ValueError("too many documents in a batch")
    n = shuffle_partitions(docs.sparkSession)
    rows = docs.select(col(id_col).cast("long").alias("id"), col(text_col).alias("text"))
    batches = rows.mapInArrow(_batched(batch_docs, batch_bytes), "batch long, ids binary, sizes binary, texts binary")
    good = verified(batches, spans(batches, window, seed, 4 * n))

    def kept(left: pa.Table, right: pa.Table) -> pa.Table:
        batch = Batch(left)
        words, depth = batch.words, np.zeros(len(batch.words.hashes) + 1, np.int64)
        if right.num_rows:
            a = words.first[right.column("doc").to_numpy()] + right.column("start").to_numpy()
            np.add.at(depth, a, 1)
            np.add.at(depth, a + right.column("n").to_numpy(), -1)
        stays = np.cumsum(depth)[:-1] == 0
        total = np.concatenate(([0], np.cumsum(stays)))
        left_words = total[words.first[1:]] - total[words.first[:-1]]
        out = []
        for a, b in zip(words.first.tolist(), words.first[1:].tolist()):
            own = np.flatnonzero(stays[a:b]) + a
            raw = words.raw
            out.append(b" ".join([raw[s:e].tobytes() for s, e in zip(words.starts[own].tolist(), words.ends[own].tolist())]).decode())
        return pa.table({"id": pa.array([None if i == NO_ID else i for i in batch.ids.tolist()], pa.int64()),
                         "n_words": pa.array(words.counts), "n_removed": pa.array(words.counts - left_words),
                         "kept": pa.array(out, pa.string())})

    return (batches.groupBy("batch").cogroup(good.groupBy("batch"))
            .applyInArrow(_tidy(kept), "id long, n_words long, n_removed long, kept string").withColumnRenamed("id", id_col))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = {"op5_substring_dedup": """
WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS a FROM documents),
p AS (SELECT doc_id, a, unnest(range(1, len(a) - 11)) AS i FROM w WHERE len(a) >= 13),
g AS (SELECT doc_id, i, list_aggregate(a[i:i + 12], 'string_agg', ' ') AS s FROM p),
f AS (SELECT s, min(doc_id) AS first FROM g GROUP BY s),
c AS (SELECT DISTINCT doc_id, i + unnest(range(13)) AS i FROM g JOIN f USING (s) WHERE first < doc_id),
u AS (SELECT doc_id, unnest(a) AS word, unnest(range(1, len(a) + 1)) AS i FROM w),
k AS (SELECT u.doc_id, count(*) AS n_words, count(c.i) AS n_removed,
             string_agg(word, ' ' ORDER BY u.i) FILTER (c.i IS NULL) AS kept
      FROM u LEFT JOIN c ON c.doc_id = u.doc_id AND c.i = u.i GROUP BY u.doc_id)
SELECT w.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k ON k.doc_id = w.doc_id
"""}
QUERIES = {"op5_substring_dedup": op5_substring_dedup}
