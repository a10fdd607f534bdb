"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items that share a seed of ``min_match`` consecutive tokens are joined on
the seed's hash.  Each pair found is tiled: the longest common runs of unmarked tokens, found by
running Karp-Rabin hashes, are marked again and again down to ``min_match`` tokens, so that a
passage whose parts were put in another order is covered all the same.  A document leaks an item
when its tiles cover at least ``min_coverage`` of the item's tokens.

Tiles lie within windows that both sides have, so only a few seeds of an item need a join: those that are
left when its most frequent ones, as counted over the documents, have been taken away as long as
they cover too little of the item.  A phrase that all items and many documents share joins nothing by itself.

An item of fewer than ``min_match`` tokens has no seed.  A document leaks it when it has exactly these tokens as a
line or a sentence of its own: word for word, and not in passing.  Scripts without blanks have a token for
each character.

The benchmark is small beside the documents, but that is checked and not assumed: up to
``max_seeds`` distinct seeds (8 bytes each) travel to the tasks and let only documents with one of
them into the join; beyond that every document's seeds go through the shuffled join, with the same
result.  A document carries its text once, however many seeds it shares.
"""

from __future__ import annotations

import heapq
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelrisk.llm.common import col, fresh, table, written
from panelrisk.llm.words import Words, mix, split

MIN_MATCH = 5
MIN_COVERAGE = 0.8
MAX_SEEDS = 250_000
_FILTER_BITS = 22
_TILED = T.StructType([T.StructField("coverage", T.DoubleType()),
                       T.StructField("tiles", T.ArrayType(T.ArrayType(T.IntegerType())))])
_WIDE = re.compile("[\u0800-\U0010ffff]")
_UNSPACED = regex.compile(r"([\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}\p{Tibetan}])")
_WIDE_MARK = regex.compile(r"[[\u0800-\U0010ffff]&&[\p{P}\p{Z}]]", regex.V1)
_SENTENCE = re.compile(r"[\r\n.!?\u3002\uff01\uff1f]+")
_LINE = re.compile(r"[\r\n]+")


def tokenized(texts: list[str | None]) -> Words:
    """The tokens of each text: lower-case runs of letters, digits and ``_``, and each character of scripts without blanks."""
    return split([_UNSPACED.sub(r" \1 ", _WIDE_MARK.sub(" ", t)) if t and _WIDE.search(t) else t for t in texts], tokens=True)


def _whole(words: Words, below: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the texts of 1 to ``below`` - 1 tokens, their numbers)."""
    out, of = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for n in range(1, below):
        own = np.flatnonzero(words.counts == n)
        grams, at = words.grams(n)
        out.append(mix(grams[np.searchsorted(at, words.first[own])] + np.uint64(n)))
        of.append(own)
    return np.concatenate(out), np.concatenate(of)


def _runs(item: np.ndarray, doc: np.ndarray, free_i: np.ndarray, free_d: np.ndarray, s: int):
    """Maximal common runs of at least ``s`` unmarked tokens: (length, item start, document start)."""

    def windows(x, free):
        n = len(x) - s + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        h = np.zeros(n, np.uint64)
        for j in range(s):  # the running hash of all windows at once
            h = h * np.uint64(0x100000001B3) + x[j:j + n]
        taken = np.concatenate(([0], np.cumsum(~free)))
        at = np.flatnonzero(taken[s:] == taken[:-s])
        return h[at], at

    hi, ai = windows(item, free_i)
    hd, ad = windows(doc, free_d)
    order = np.argsort(hi, kind="stable")
    lo, up = np.searchsorted(hi[order], hd, "left"), np.searchsorted(hi[order], hd, "right")
    hit = np.flatnonzero(up > lo)
    out, each = [], (up - lo)[hit]
    ends = np.concatenate(([0], np.cumsum(each)))
    a = 0
    while a < len(hit):  # portions of about a million pairs
        b = max(a + 1, int(np.searchsorted(ends, ends[a] + (1 << 20), "right")) - 1)
        d = np.repeat(ad[hit[a:b]], each[a:b])
        i = ai[order[np.repeat(lo[hit[a:b]] - (ends[a:b] - ends[a]), each[a:b]) + np.arange(len(d))]]
        # a pair whose left neighbours are equal and free too isn't the start of a maximal run
        inner = (i > 0) & (d > 0)
        inner[inner] = free_i[i[inner] - 1] & free_d[d[inner] - 1] & (item[i[inner] - 1] == doc[d[inner] - 1])
        for i0, d0 in zip(i[~inner].tolist(), d[~inner].tolist()):
            n = min(len(item) - i0, len(doc) - d0)
            bad = ~(free_i[i0:i0 + n] & free_d[d0:d0 + n] & (item[i0:i0 + n] == doc[d0:d0 + n]))
            k = int(bad.argmax()) if bad.any() else n
            if k >= s:
                out.append((k, i0, d0))
        a = b
    return out


def _shortened(item: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """The places of ``doc`` without the middle of runs of one token that are longer than two items.

    A tile uses at most an item's length of such a run, from its start or up to its end.
    """
    n = len(item)
    edge = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1]))) if len(doc) else np.zeros(0, np.int64)
    size = np.diff(np.concatenate((edge, [len(doc)])))
    if not (size > 2 * n).any():
        return np.arange(len(doc))
    within = np.arange(len(doc)) - np.repeat(edge, size)
    return np.flatnonzero((within < n) | (within >= np.repeat(size, size) - n))


def greedy_tiles(item: np.ndarray, doc: np.ndarray, min_match: int = MIN_MATCH) -> list[list[int]]:
    """[item start, document start, length] of the tiles, longest first; ties to the earlier start.

    Tokens are 64-bit numbers.  Every tile is at least ``min_match`` long, and no token is in two.
    """
    place = _shortened(item, doc)
    doc = doc[place]
    near = np.isin(doc, item)  # runs lie within document tokens that the item has
    free_i, free_d = np.ones(len(item), bool), near
    tiles, s = [], max(min_match, min(20, len(item)))
    while True:
        runs = _runs(item, doc, free_i, free_d, s)
        longest = max((r[0] for r in runs), default=0)
        if longest > 2 * s:
            s = longest
            continue
        queue = [(-k, i, d) for k, i, d in runs]
        heapq.heapify(queue)
        while queue:
            k, i, d = heapq.heappop(queue)
            free = free_i[i:i - k] & free_d[d:d - k]
            if free.all():
                tiles.append([i, int(place[d]), -k])
                free_i[i:i - k] = free_d[d:d - k] = False
                continue
            # what is left of a run that a longer tile has cut into
            edge = np.flatnonzero(np.diff(np.concatenate(([0], free.view(np.int8), [0]))))
            for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
                if b - a >= s:
                    heapq.heappush(queue, (a - b, i + a, d + a))
        if s <= min_match:
            return tiles
        s = max(min_match, s // 2)


_ITEM = T.StructType([T.StructField("n", T.IntegerType()), T.StructField("short", T.LongType()),
                      T.StructField("seeds", T.ArrayType(T.StructType([T.StructField("seed", T.LongType()), T.StructField("at", T.IntegerType())])))])


def _item_udf(k: int):
    """By item: its tokens, its hash if it has fewer than ``k``, and its seeds with their places."""

    @F.arrow_udf(_ITEM)
    def parts(texts: pa.Array) -> pa.Array:
        out = []
        for x in texts:
            words = tokenized([x.as_py()])
            grams, at = words.grams(k)
            short = _whole(words, k)[0].view(np.int64).tolist()
            out.append({"n": int(words.counts[0]), "short": short[0] if short else None,
                        "seeds": [{"seed": g, "at": a} for g, a in zip(grams.view(np.int64).tolist(), at.tolist())]})
        return pa.array(out, pa.struct([("n", pa.int32()), ("short", pa.int64()),
                                        ("seeds", pa.list_(pa.struct([("seed", pa.int64()), ("at", pa.int32())])))]))

    return parts


def _seed_udf(k: int, wanted: np.ndarray | None):
    """Distinct seeds of each text; only the wanted ones if these are given, sorted."""
    filt: list = []

    @F.arrow_udf("array<long>")
    def seeds(texts: pa.Array) -> pa.Array:
        if wanted is not None and not filt:
            bits = np.zeros(1 << _FILTER_BITS, bool)
            bits[(wanted >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True
            filt.append(bits)
        out: list = []
        for a in range(0, len(texts), 256):
            words = tokenized([x.as_py() for x in texts.slice(a, 256)])
            grams, at = words.grams(k)
            if wanted is not None:
                keep = np.flatnonzero(filt[0][(grams >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
                keep = keep[np.isin(grams[keep], wanted)]
                grams, at = grams[keep], at[keep]
            cut = np.searchsorted(at, words.first)
            out += [np.unique(grams[x:y]).view(np.int64) if y > x else [] for x, y in zip(cut, cut[1:])]
        return pa.array(out, pa.list_(pa.int64()))

    return seeds


def _short_udf(k: int):
    """By text: its lines and sentences of fewer than ``k`` tokens, as (hash, first token)."""
    kind = pa.list_(pa.struct([("hash", pa.int64()), ("at", pa.int32())]))

    @F.arrow_udf("array<struct<hash: long, at: int>>")
    def found(texts: pa.Array) -> pa.Array:
        out = []
        for x in texts:
            first: dict[int, int] = {}
            for cut in (_SENTENCE, _LINE):
                words = tokenized(cut.split(x.as_py() or ""))
                for h, p in zip(*_whole(words, k)):
                    first.setdefault(int(h.view(np.int64)), int(words.first[p]))
            out.append([{"hash": h, "at": at} for h, at in first.items()])
        return pa.array(out, kind)

    return found


def _chosen_udf(k: int, min_coverage: float):
    """The seeds of an item that a leaking document must have one of, from (documents, seed, place) of its seeds."""

    @F.arrow_udf("array<long>")
    def chosen(seeds: pa.Array, sizes: pa.Array) -> pa.Array:
        out = []
        for own, n in zip(seeds.to_pylist(), sizes.to_pylist()):
            by_seed: dict[tuple[int, int], list[int]] = {}
            for s in own:
                by_seed.setdefault((s["docs"], s["seed"]), []).append(s["at"])
            covered, left = np.zeros(n, bool), sorted(by_seed, reverse=True)  # the most frequent first
            while left:
                for at in by_seed[left[0]]:
                    covered[at:at + k] = True
                if covered.sum() >= min_coverage * n - 1e-9:
                    break  # without this one and the rarer ones, too little is covered
                left.pop(0)
            out.append([seed for _, seed in left])
        return pa.array(out, pa.list_(pa.int64()))

    return chosen


def _tile_udf(min_match: int):
    @F.arrow_udf(_TILED)
    def tile(docs: pa.Array, items: pa.Array) -> pa.Array:
        out = []
        for d, i in zip(docs, items):
            item = tokenized([i.as_py()]).hashes
            tiles = greedy_tiles(item, tokenized([d.as_py()]).hashes, min_match)
            out.append({"coverage": sum(t[2] for t in tiles) / len(item), "tiles": tiles})
        return pa.array(out, pa.struct([("coverage", pa.float64()), ("tiles", pa.list_(pa.list_(pa.int32())))]))

    return tile


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          item_id: str = "item_id", item_text: str = "text", min_match: int = MIN_MATCH,
          min_coverage: float = MIN_COVERAGE, max_seeds: int = MAX_SEEDS) -> DataFrame:
    """(id, text_hash, item, coverage, tiles): the benchmark items that documents leak.

    Null texts and texts without tokens leak nothing and are leaked by none.  Rows equal in id and text are one
    document, items equal in id and text one item; ids may be null.  Other columns are ignored.  Empty tables
    give an empty table.  Tiles are (start in the item, start in the document, length), in tokens.
    """
    bench = (items.select(col(item_id).alias("item"), col(item_text).alias("item_text")).filter("item_text is not null").distinct()
             .withColumn("no", F.monotonically_increasing_id()))
    bench = written(bench.select("*", _item_udf(min_match)("item_text").alias("p")).select("no", "item", "item_text", "p.*"), "benchmark")
    seeds = bench.select("no", "n", F.inline("seeds"))
    few = seeds.select("seed").distinct().limit(max_seeds + 1)
    wanted = None
    if few.count() <= max_seeds:
        wanted = np.sort(np.array([r["seed"] for r in few.collect()], np.int64).view(np.uint64))
    rows = docs.select(col(id_col).alias("id"), F.xxhash64(col(text_col)).alias("text_hash"),
                       col(text_col).alias("doc_text")).filter("doc_text is not null")
    rows = written(rows.withColumn("seeds", _seed_udf(min_match, wanted)("doc_text")).filter("size(seeds) > 0")
                   .withColumn("row", F.monotonically_increasing_id()), "seeded")
    met = rows.select("row", F.explode("seeds").alias("seed"))
    counted = seeds.join(met.groupBy("seed").agg(F.count(F.lit(1)).alias("docs")), "seed")
    needed = (counted.groupBy("no", "n").agg(F.collect_list(F.struct("docs", "seed", "at")).alias("own"))  # at most an item's tokens
              .select("no", F.explode(_chosen_udf(min_match, min_coverage)("own", "n")).alias("seed")))
    pairs = met.join(needed, "seed").select("row", "no").distinct()
    both = pairs.join(bench.select("no", "item", "item_text"), "no").join(rows.drop("seeds"), "row")
    tiled = (both.select("id", "text_hash", "item", _tile_udf(min_match)("doc_text", "item_text").alias("t"))
             .select("id", "text_hash", "item", "t.*").filter(F.col("coverage") >= min_coverage))
    short = bench.filter("short is not null").select("item", "n", "short")
    if not short.isEmpty():
        lines = (docs.select(col(id_col).alias("id"), col(text_col).alias("doc_text")).filter("doc_text is not null")
                 .select("id", F.xxhash64("doc_text").alias("text_hash"), F.explode(_short_udf(min_match)("doc_text")).alias("line")))
        exact = lines.join(short, F.col("line.hash") == F.col("short")).select(
            "id", "text_hash", "item", F.lit(1.0).alias("coverage"), F.array(F.array(F.lit(0), F.col("line.at"), F.col("n"))).alias("tiles"))
        tiled = tiled.unionByName(exact)
    return tiled.dropDuplicates(["id", "text_hash", "item"])


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  **settings) -> DataFrame:
    """``docs`` without the rows that leak an item; everything else stays, null texts and ids too."""
    found = leaks(docs, items, id_col, text_col, **settings)
    k, th = fresh(docs, "_id", "_text_hash")
    bad = found.select(F.col("id").alias(k), F.col("text_hash").alias(th)).distinct()
    return docs.join(bad, col(id_col).eqNullSafe(col(k)) & (F.xxhash64(col(text_col)) == col(th)), "left_anti")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), "coverage",
                        F.size("tiles").alias("n_tiles"))


ORACLE: dict[str, str] = {}
QUERIES = {"op4_decontamination": op4_decontamination}
