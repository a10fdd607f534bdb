"""Byte-level BPE by one global encoding of every distinct word.

The pre-tokens of the texts are numbered in batches of documents: a batch holds its distinct
pre-tokens, most frequent first, and each document the sequence of their numbers, position by
position.  The distinct pre-tokens are dealt out by their hash over the cluster, where each is
encoded once; the ids go back to their batches, and there the documents are reassembled by position.
So the shuffles carry one or three bytes for a pre-token's position, and each spelling once a batch.
Decoding looks the ids up in the token-byte table, which the rank file fixes (50,256 rows).

A batch ends at ``BATCH_BYTES`` of text, which bounds what a task holds; only a single document can exceed
it.  (Numbers take four bytes each in a batch of over half a million distinct words.)  Its texts are
numbered ``SLICE_CHARS`` at a time, since the arrays over their pieces take many times a text's size.

Both passes over the texts must see the same rows in the same order, so ``docs`` has to come from
files by narrow operations only; write it first where it doesn't.
"""

from __future__ import annotations

import base64
import zlib

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelrisk.llm.common import col, give_back, shuffle_partitions, table
from panelrisk.llm.words import mix, span_hashes, split_bytes

#: Characters of text in a batch.
BATCH_BYTES = 8 << 20
#: Characters of a batch whose pieces are in arrays at a time.
SLICE_CHARS = 1 << 20
#: A position takes one byte for the FEW most frequent words, else three.
FEW = 248
_LIMIT = FEW + (256 - FEW) * 65_536
_STREAM_ROWS = 2_000


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def read_ranks(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line)}


#: Bytes of Unicode's white space: those of one byte, and the others by their first two.
_SPACES = np.isin(np.arange(256), [*range(9, 14), 32])
_WIDE = ((0xC2, (0x85, 0xA0)), (0xE1, (0x9A,)), (0xE2, (0x80, 0x81)), (0xE3, (0x80,)))
_GAPS = np.isin(np.arange(256), [10, 32])
_OTHER_VALUES = np.random.default_rng(20_240_602).integers(1, 1 << 63, 256, np.uint64)


def _simple(data: list[bytes]) -> np.ndarray:
    """The texts in which no white space stands at an end or beside another, and none is beyond ASCII.

    There a blank always starts a pre-token, and a line feed is one.  (Some texts with other characters
    that start with the same bytes as wide white space are left out too.)
    """
    raw = np.frombuffer(b"\n".join([b"", *data, b""]), np.uint8)
    ends = np.cumsum([len(d) + 1 for d in data])
    space = _SPACES[raw]
    bad = [np.flatnonzero(space[1:] & space[:-1])]
    for lead, second in _WIDE:
        at = np.flatnonzero(raw == lead)
        bad.append(at[np.isin(raw[at + 1], second)])
    out = np.ones(len(data), bool)
    at = np.concatenate(bad)
    out[np.searchsorted(ends, at, "right")] = False
    return out


class _Codes(dict):
    """The number of each word, as four bytes; ``words`` in the order of their numbers."""

    def __init__(self):
        super().__init__()
        self.words: list[str] = []

    def __missing__(self, word: str) -> bytes:
        out = self[word] = len(self.words).to_bytes(4, "little")
        self.words.append(word)
        return out


def _slices(texts: list[str | None], size: int):
    """The texts in their order, in runs that end where they reach ``size`` characters."""
    first = held = 0
    for k, t in enumerate(texts):
        held += len(t or "")
        if held >= size:
            yield texts[first:k + 1]
            first, held = k + 1, 0
    if first < len(texts):
        yield texts[first:]


def _coded(texts: list[str | None], matches, code) -> list[np.ndarray]:
    """By text, the numbers that ``code`` gives its pre-tokens.

    In simple texts every distinct piece between blanks and line feeds is matched once.  Pieces are told
    apart by a 64-bit hash, and a second one must agree, or else all texts are matched whole.
    """
    coded = lambda found: np.frombuffer(b"".join(map(code, found)), "<u4")
    docs = [np.zeros(0, np.uint32)] * len(texts)
    full = [k for k, t in enumerate(texts) if t]
    data = [texts[k].encode("utf-8", "replace") for k in full]
    simple = _simple(data) if data else np.zeros(0, bool)
    easy = [k for k, s in zip(full, simple.tolist()) if s]
    w = split_bytes([d for d, s in zip(data, simple.tolist()) if s], _GAPS)
    lead = np.where(w.raw[w.starts - 1] == 32, 1, 2).astype(np.uint64)  # after a blank, after a line feed
    lead[w.first[:-1]] = 0
    _, one, of = np.unique(mix(w.hashes + lead), return_index=True, return_inverse=True)
    other = span_hashes(w.raw, w.starts, w.ends, _OTHER_VALUES) + lead
    if (other[one][of] != other).any():
        easy = []
    else:
        size, kind, line = np.zeros(len(one), np.int64), lead[one], int.from_bytes(code("\n"), "little")
        parts = []
        for k, (first, sep) in enumerate((("", "\n"), (" ", "\n "), ("\n", "\n"))):
            own = np.flatnonzero(kind == k)
            if len(own):
                pieces = [w.raw[s:e].tobytes() for s, e in zip(w.starts[one[own]].tolist(), w.ends[one[own]].tolist())]
                flat = coded(matches(first + sep.join(map(bytes.decode, pieces))))
                cut = flat == line
                # a line feed parts two pieces, and belongs to those that come after one
                size[own] = np.bincount(np.cumsum(cut) - (k == 2), minlength=len(own)) - (np.arange(len(own)) > 0) * (k < 2)
                parts.append((own, flat if k == 2 else flat[~cut]))
        start = np.zeros(len(one), np.int64)
        base = 0
        for own, flat in parts:
            start[own] = base + np.cumsum(size[own]) - size[own]
            base += len(flat)
        flat = np.concatenate([f for _, f in parts]) if parts else np.zeros(0, np.uint32)
        n = size[of]
        total = np.concatenate(([0], np.cumsum(n)))
        out = flat[np.repeat(start[of] - total[:-1], n) + np.arange(total[-1])]
        for k, (a, b) in zip(easy, zip(total[w.first].tolist(), total[w.first[1:]].tolist())):
            docs[k] = out[a:b]
    for k in set(full) - set(easy):
        docs[k] = coded(matches(texts[k]))
    return docs


def number(texts: list[str | None], matches, slice_chars: int = SLICE_CHARS) -> tuple[list[str], list[np.ndarray]]:
    """(the distinct pre-tokens, most frequent first; by text, the numbers of its pre-tokens).

    About ``slice_chars`` characters are taken at a time, as the arrays over pieces take many times a text's size.
    """
    codes = _Codes()
    docs = [d for part in _slices(texts, slice_chars) for d in _coded(part, matches, codes.__getitem__)]
    words = codes.words
    del codes
    counts = np.zeros(len(words), np.int64)
    for part in range(0, len(docs), _STREAM_ROWS):
        counts += np.bincount(np.concatenate(docs[part:part + _STREAM_ROWS]), minlength=len(words))
    order = np.argsort(-counts, kind="stable")
    order = order[counts[order] > 0]
    new = np.zeros(len(words), np.uint32)
    new[order] = np.arange(len(order), dtype=np.uint32)
    for k, d in enumerate(docs):
        docs[k] = new[d]
    return [words[i] for i in order.tolist()], docs


def pack(codes: np.ndarray, n_words: int) -> bytes:
    """Word numbers as bytes: one byte each, and two more for those of FEW and above."""
    if n_words > _LIMIT:
        return codes.astype("<u4").tobytes()
    rest = codes[codes >= FEW] - FEW
    lead = codes.astype(np.uint8)
    lead[codes >= FEW] = FEW + (rest >> 16)
    return lead.tobytes() + (rest & 0xFFFF).astype("<u2").tobytes()


def unpack(raw: bytes, n: int, n_words: int) -> np.ndarray:
    if n_words > _LIMIT:
        return np.frombuffer(raw, "<u4")
    lead = np.frombuffer(raw, np.uint8, n)
    out = lead.astype(np.uint32)
    high = np.flatnonzero(lead >= FEW)
    out[high] = FEW + ((out[high] - FEW) << 16) + np.frombuffer(raw, "<u2", len(high), n)
    return out


def _batches(stream, pattern: str, batch_bytes: int):
    """(batch number, its rows' ids, its words, the numbers of each row's words) over rows (id, text)."""
    matches = regex.compile(pattern).findall
    part, serial = TaskContext.get().partitionId(), 0
    ids, texts, size = [], [], 0
    for rows in stream:
        for i, text in zip(rows.column(0), rows.column(1)):
            ids.append(i)
            texts.append(text.as_py())
            size += len(texts[-1] or "")
            if size >= batch_bytes:
                yield ((part << 24) + serial, pa.array([x.as_py() for x in ids], rows.column(0).type), *number(texts, matches))
                serial, ids, texts, size = serial + 1, [], [], 0
    if ids:
        yield ((part << 24) + serial, pa.array([x.as_py() for x in ids], ids[0].type), *number(texts, matches))


_PRESS, _UNPRESS = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def _pressed(numbers: np.ndarray, parts: list[bytes]) -> bytes:
    """Ascending numbers and a byte string for each, compressed."""
    sizes = np.fromiter(map(len, parts), np.uint32, len(parts))
    steps = np.diff(numbers.astype(np.uint32), prepend=np.uint32(0))
    raw = b"".join([len(parts).to_bytes(4, "little"), steps.astype("<u4").tobytes(), sizes.astype("<u4").tobytes(), *parts])
    return _PRESS.compress(raw)


def _unpressed(raw: bytes) -> tuple[np.ndarray, list[bytes]]:
    raw = _UNPRESS.decompress(raw)
    n = int.from_bytes(raw[:4], "little")
    numbers = np.cumsum(np.frombuffer(raw, "<u4", n, 4), dtype=np.uint32)
    ends = np.cumsum(np.frombuffer(raw, "<u4", n, 4 + 4 * n), dtype=np.int64) + 4 + 8 * n
    ends = ends.tolist()
    return numbers, [raw[a:b] for a, b in zip([4 + 8 * n, *ends], ends)]


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str | None = None,
           pattern: str | None = None, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """(id_col, ids): the token ids of every row's text as little-endian unsigned 32-bit numbers.

    Each match of ``pattern`` is encoded on its own by the ranks in the file ``ranks``, without
    special tokens.  A null or empty text has no ids.  Repeated rows each get theirs; ids may be null
    or repeat; other columns are ignored.  An empty table gives an empty table.
    """
    spark = docs.sparkSession
    n = shuffle_partitions(spark)
    pattern = pattern or default_pattern()
    with open(ranks or default_ranks(), "rb") as f:
        ranks_file = spark.sparkContext.broadcast(f.read())  # 0.8 MB, whatever the corpus
    buckets = max(256, 2 * n)  # a few for each task, so that tasks get about as many words
    rows = docs.select(col(id_col).alias("id"), col(text_col).alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()

    def numbered(stream):
        """Rows of two kinds: a batch's documents, for the batch, and its words, for -1 - bucket."""
        names = ["target", "batch", "id", "n", "n_words", "data"]
        for serial, ids, words, docs in _batches(stream, pattern, batch_bytes):
            for a in range(0, len(ids), _STREAM_ROWS):
                part = docs[a:a + _STREAM_ROWS]
                k = len(part)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([serial] * k, pa.int64()), pa.array([serial] * k, pa.int64()), ids.slice(a, _STREAM_ROWS),
                     pa.array([len(d) for d in part], pa.int64()), pa.array([len(words)] * k, pa.int64()),
                     pa.array([pack(d, len(words)) for d in part], pa.binary())], names)
            raw = [w.encode("utf-8", "replace") for w in words]
            bucket = np.fromiter((zlib.crc32(w) % buckets for w in raw), np.int64, len(raw))
            order = np.argsort(bucket, kind="stable")
            cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
            out = [(-1 - b, order[x:y]) for b, (x, y) in enumerate(zip(cut, cut[1:])) if y > x]
            k = len(out)
            yield pa.RecordBatch.from_arrays(
                [pa.array([b for b, _ in out], pa.int64()), pa.array([serial] * k, pa.int64()), pa.nulls(k, ids.type),
                 pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()),
                 pa.array([_pressed(at, [raw[i] for i in at.tolist()]) for _, at in out], pa.binary())], names)
            ids = words = docs = part = raw = bucket = order = out = None  # before the next batch is numbered
            give_back()

    def encoded(stream):
        """Each distinct word of the partition is encoded once."""
        import tiktoken

        own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=read_ranks(ranks_file.value), special_tokens={})
        known: dict[bytes, bytes] = {}

        def ids(word: bytes) -> bytes:
            out = known.get(word)
            if out is None:
                out = known[word] = np.array(own.encode_ordinary(word.decode()), "<u4").tobytes()
            return out

        for rows in stream:
            words = np.flatnonzero(rows.column(0).to_numpy() < 0)
            both = [_unpressed(rows.column(5)[k].as_py()) for k in words.tolist()]
            yield pa.RecordBatch.from_arrays(
                [rows.column(1).take(pa.array(words)), pa.array([_pressed(at, list(map(ids, w))) for at, w in both], pa.binary())],
                ["batch", "ids"])
        own = known = rows = words = both = None
        give_back()

    def reassembled(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or left.column("target")[0].as_py() < 0:
            return pa.table({"id": pa.array([], left.schema.field("id").type), "ids": pa.array([], pa.binary())})
        n_words = left.column("n_words")[0].as_py()
        ids = [b""] * n_words
        for raw in right.column("ids").to_pylist() if right.num_rows else []:
            for k, w in zip(*(x if isinstance(x, list) else x.tolist() for x in _unpressed(raw))):
                ids[k] = w
        out = [b"".join(map(ids.__getitem__, unpack(c, n, n_words).tolist()))
               for c, n in zip(left.column("data").to_pylist(), left.column("n").to_pylist())]
        ids = None
        give_back()
        return pa.table({"id": left.column("id"), "ids": pa.array(out, pa.binary())})

    # one exchange, which both branches read
    dealt = (rows.mapInArrow(numbered, f"target long, batch long, id {id_type}, n long, n_words long, data binary")
             .repartition(n, "target"))
    known = dealt.mapInArrow(encoded, "batch long, ids binary")
    return (dealt.groupBy("target").cogroup(known.groupBy("batch"))
            .applyInArrow(reassembled, f"id {id_type}, ids binary").withColumnRenamed("id", id_col))


def decode(encoded: DataFrame, ids_col: str = "ids", out_col: str = "decoded", ranks: str | None = None) -> DataFrame:
    """``encoded`` with the bytes of the ids in ``out_col``: each id is looked up in the broadcast rank file.

    Null ids give null.  An id outside the table raises an error.  A column called ``out_col`` is replaced.
    """
    with open(ranks or default_ranks(), "rb") as f:
        ranks_file = encoded.sparkSession.sparkContext.broadcast(f.read())
    held: list = []

    @F.arrow_udf("binary")
    def decoded(ids: pa.Array) -> pa.Array:
        if not held:
            known = read_ranks(ranks_file.value)
            held.append([None] * (max(known.values()) + 1))
            for word, k in known.items():
                held[0][k] = word
        word = held[0].__getitem__
        return pa.array([None if not x.is_valid else b"".join(map(word, np.frombuffer(x.as_buffer(), "<u4").tolist()))
                         for x in ids], pa.binary())

    return encoded.withColumn(out_col, decoded(col(ids_col)))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_tokens, ids_sha256, decoded_sha256) of every row of ``docs``."""
    both = decode(encode(docs, id_col, text_col))
    return both.select(col(id_col), (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                       F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents").select("doc_id", "text"))


ORACLE: dict[str, str] = {}
QUERIES = {"op10_bpe": op10_bpe}
