"""Byte-level BPE by a queue of merges over a linked list of symbols.

A pre-token's bytes are symbols in a doubly linked list.  A heap holds the merges that its neighbours
allow, by rank and then by position; the first one is taken out again and again, and is skipped where
its symbols have been merged into others meanwhile.  So a pre-token of n bytes takes O(n log n) steps, however long
it is.  The vocabulary, the merges and the added tokens come from a tokenizer file of the
tokenizers library (JSON).

Documents are encoded where they are read, batch by batch, without a shuffle: a batch numbers its distinct
pre-tokens, each is merged once, and a worker keeps what it has merged (at most ``KEPT`` pre-tokens) for its
next batches.  A batch ends at ``BATCH_BYTES`` of text, which bounds what a task holds; only a
single document can exceed it.
"""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelrisk.llm.bpe import default_pattern, number
from panelrisk.llm.common import col, give_back, table

BATCH_BYTES = 6 << 20
KEPT = 300_000


def default_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(1)
def alphabet() -> list[str]:
    """The character of each byte: printing Latin-1 characters stand for themselves, the others follow from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class Tokenizer:
    """The model, the merges and the added tokens of a tokenizer file.

    Files with settings that byte-level BPE of this kind has no use for raise a ValueError.
    """

    def __init__(self, raw: bytes):
        data = json.loads(raw)
        model = data["model"]
        split = data.get("pre_tokenizer") or {}
        unusual = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback",
                               "fuse_unk", "ignore_merges") if model.get(k)]
        if model.get("type") != "BPE" or unusual or data.get("normalizer") or split.get("type") != "ByteLevel" \
                or split.get("add_prefix_space") or not split.get("use_regex", True):
            raise ValueError(f"not a plain byte-level BPE file: {unusual or split or model.get('type')}")
        ids = model["vocab"]
        self.first = [ids.get(c) for c in alphabet()]
        self.merges: list[dict[int, int]] = [{}] * (max(ids.values(), default=-1) + 1)  # by left symbol: ranks by right symbol
        self.made = []  # the id that the merge of each rank makes
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            if not self.merges[ids[left]]:
                self.merges[ids[left]] = {}
            self.merges[ids[left]][ids[right]] = rank
            self.made.append(ids[left + right])
        added = [t for t in data.get("added_tokens") or []]
        if any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in added):
            raise ValueError("added tokens that take in what is beside them aren't supported")
        self.added = {t["content"]: t["id"] for t in added if t["content"]}
        longest = sorted(self.added, key=len, reverse=True)
        self.parts = regex.compile("(" + "|".join(map(regex.escape, longest)) + ")").split if longest else lambda t: [t]
        letters = set(alphabet())
        spelt = {**{k: w for w, k in ids.items()}, **{k: w for w, k in self.added.items()}}
        self.strings = [""] * (max(spelt, default=-1) + 1)  # ids of no token give nothing
        for k, w in spelt.items():
            self.strings[k] = w if letters.issuperset(w) else "".join(alphabet()[b] for b in w.encode())
        self.bytes = np.zeros(512, np.uint8)
        self.bytes[[ord(c) for c in alphabet()]] = np.arange(256)
        self.known: dict[str, tuple[int, ...]] = {}
        self.older = self.known

    def merge(self, word: bytes) -> list[int]:
        """The ids of one pre-token."""
        symbols = [s for s in map(self.first.__getitem__, word) if s is not None]
        n, merges, made = len(symbols), self.merges, self.made
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        # a merge in the queue is its rank and, in the last 32 bits, its left symbol's position
        queue = [rank << 32 | k for k, (left, right) in enumerate(zip(symbols, symbols[1:]))
                 if (rank := merges[left].get(right)) is not None]
        heapify(queue)
        while queue:
            entry = heappop(queue)
            at = entry & 0xFFFFFFFF
            right = after[at]
            if symbols[at] < 0 or right == n:
                continue  # merged into the symbol before it, or now the last
            new, now = made[entry >> 32], merges[symbols[at]].get(symbols[right])
            if now is None or made[now] != new:
                continue  # one of the two has become another symbol
            symbols[at], symbols[right] = new, -1
            after[at] = right = after[right]
            left = before[at]
            if right < n:
                before[right] = at
                if (rank := merges[new].get(symbols[right])) is not None:
                    heappush(queue, rank << 32 | at)
            if left >= 0 and (rank := merges[symbols[left]].get(new)) is not None:
                heappush(queue, rank << 32 | left)
        return [s for s in symbols if s >= 0]

    def word(self, word: str) -> tuple[int, ...]:
        """The ids of one pre-token, kept for the next time in the younger of two halves."""
        out = self.known.get(word)
        if out is None:
            out = self.older.get(word)
            if out is None:
                out = tuple(self.merge(word.encode("utf-8", "replace")))
            if len(self.known) >= KEPT // 2:
                self.known, self.older = {}, self.known
            self.known[word] = out
        return out

    def decode(self, ids: list[list[int]]) -> list[str]:
        """The texts of several id lists: vocabulary strings joined, their characters turned into bytes."""
        strings, last = self.strings, len(self.strings)
        joined = ["".join([strings[k] for k in x if 0 <= k < last]) for x in ids]
        raw = self.bytes[np.frombuffer("".join(joined).encode("utf-16-le"), "<u2")].tobytes()
        ends = np.cumsum([0, *map(len, joined)]).tolist()
        return [raw[a:b].decode("utf-8", "replace") for a, b in zip(ends, ends[1:])]


@lru_cache(2)
def _tokenizer(raw: bytes) -> Tokenizer:
    return Tokenizer(raw)


def _unknown(word: str) -> bool:
    """Whether a pre-token has characters that Unicode tables of different age class differently."""
    return not word.isascii() and any(unicodedata.category(c) == "Cn" for c in word)


def _library_matches(text: str) -> list[str]:
    from tokenizers.pre_tokenizers import ByteLevel

    return [text[a:b] for _, (a, b) in ByteLevel(add_prefix_space=False).pre_tokenize_str(text)]


def encode_batch(own: Tokenizer, texts: list[str | None], matches) -> tuple[np.ndarray, np.ndarray]:
    """(the ids of all texts, one after another; where each text's ids begin, and the end)."""
    parts, owner, special = [], [], []
    for k, text in enumerate(texts):
        if not text:
            continue
        for part in own.parts(text) if any(a in text for a in own.added) else [text]:
            if part:
                parts.append(part)
                owner.append(k)
                special.append(own.added.get(part, -1))
    plain = [p if s < 0 else None for p, s in zip(parts, special)]
    words, coded = number(plain, matches)
    odd = np.fromiter(map(_unknown, words), bool, len(words))
    if odd.any():  # characters newer than the pattern's Unicode table: the library's own table decides
        again = [k for k, c in enumerate(coded) if odd[c].any()]
        more, recoded = number([plain[k] for k in again], _library_matches)
        for k, c in zip(again, recoded):
            coded[k] = c + np.uint32(len(words))
        words = words + more
    for k, s in enumerate(special):
        if s >= 0:
            coded[k] = np.array([len(words)], np.uint32)
            words.append(s)
    known = [own.word(w) if isinstance(w, str) else (w,) for w in words]
    sizes = np.fromiter(map(len, known), np.int64, len(known))
    flat = np.fromiter((i for ids in known for i in ids), np.int32, int(sizes.sum()))
    codes = np.concatenate([np.zeros(0, np.uint32), *coded])
    n = sizes[codes]
    ends = np.concatenate(([0], np.cumsum(n)))
    first = np.cumsum(sizes) - sizes
    out = flat[np.repeat(first[codes] - ends[:-1], n) + np.arange(ends[-1])]
    at = np.concatenate(([0], np.cumsum([len(c) for c in coded]))).astype(np.int64)
    of_part = np.diff(ends[at])
    of_text = np.bincount(np.array(owner, np.int64), of_part, len(texts)).astype(np.int64) if owner else np.zeros(len(texts), np.int64)
    return out, np.concatenate(([0], np.cumsum(of_text)))


def _read(path: str | None) -> bytes:
    with open(path or default_file(), "rb") as f:
        return f.read()


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None,
           batch_bytes: int = BATCH_BYTES, decoded_col: str | None = None) -> DataFrame:
    """(id_col, ids): the token ids of every row's text, without special tokens around it.

    With ``decoded_col`` the ids are also decoded again in the same task, into a column of that name.

    A text that contains an added token (``<|endoftext|>``) gets that token's id there, as in the library.  A null
    or empty text has an empty list.  Repeated rows each get theirs; ids may be null or repeat; other columns
    are ignored.  An empty table gives an empty table.
    """
    rows = docs.select(col(id_col).alias("id"), col(text_col).alias("text"))
    file = docs.sparkSession.sparkContext.broadcast(_read(path))  # 1.6 MB, whatever the corpus
    pattern = default_pattern()

    def encoded(stream):
        own, matches = _tokenizer(file.value), regex.compile(pattern).findall
        for b in stream:
            texts = b.column(1)
            sizes = np.cumsum([len(t.as_buffer()) if t.is_valid else 0 for t in texts])
            cuts = sorted({0, *(np.flatnonzero(np.diff(sizes // batch_bytes)) + 1).tolist(), b.num_rows})
            for a, z in zip(cuts, cuts[1:]):
                ids, ends = encode_batch(own, texts.slice(a, z - a).to_pylist(), matches)
                out = {"id": b.column(0).slice(a, z - a), "ids": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids))}
                if decoded_col:
                    out["decoded"] = pa.array(own.decode([ids[x:y].tolist() for x, y in zip(ends, ends[1:])]), pa.string())
                yield pa.RecordBatch.from_pydict(out)
                out = ids = None
                give_back()

    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(encoded, f"id {kind}, ids array<int>" + (", decoded string" if decoded_col else ""))
    return out.toDF(*[id_col, "ids", *([decoded_col] if decoded_col else [])])


def decode(encoded: DataFrame, ids_col: str = "ids", out_col: str = "decoded", path: str | None = None) -> DataFrame:
    """``encoded`` with the text of the ids in ``out_col``, added tokens included.

    Null ids give null, and ids of no token are skipped, as in the library; bytes that are no UTF-8 become U+FFFD.
    A column called ``out_col`` is replaced.
    """
    file = encoded.sparkSession.sparkContext.broadcast(_read(path))

    @F.arrow_udf("string")
    def decoded(ids: pa.Array) -> pa.Array:
        own = _tokenizer(file.value)
        texts = iter(own.decode([s.values.drop_null().to_numpy().tolist() for s in ids if s.is_valid]))
        return pa.array([next(texts) if s.is_valid else None for s in ids], pa.string())

    return encoded.withColumn(out_col, decoded(col(ids_col)))


def op13_merge_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), decoded_col="decoded")
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                       F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


ORACLE: dict[str, str] = {}
QUERIES = {"op13_merge_bpe": op13_merge_bpe}
