"""Edge cases and brute force for line dedup, language ID and decontamination."""

import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from panelrisk.llm import decontam as C
from panelrisk.llm import language as L
from panelrisk.llm import line_dedup as D
from panelrisk.llm.words import split


# line dedup

def brute_lines(rows, k=3):
    docs = sorted({(i is not None, i if i is not None else 0, t) for i, t in rows if t is not None},
                  key=lambda r: (r[0], r[1]))
    seen, gone = {}, {}
    for d in docs:
        lines = d[2].split("\n")
        gone[d] = set()
        for p in range(len(lines) - k + 1):
            w = tuple(lines[p:p + k])
            if not "".join(w).strip(" \t\r"):
                continue
            if w in seen:
                gone[d] |= set(range(p, p + k))
            seen.setdefault(w, 1)
    out = []
    for i, t in rows:
        if t is None:
            out.append((i, None, 0, 0))
            continue
        lines, g = t.split("\n"), gone[(i is not None, i if i is not None else 0, t)]
        out.append((i, "\n".join(x for p, x in enumerate(lines) if p not in g), len(lines), len(g)))
    return out


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(2)
    rows = [(0, None), (1, ""), (2, "\n\n\n\n"), (3, "a\nb"), (4, "a\na\na\na\na"), (None, "a\nb\nc\nd")]
    for i in range(5, 60):
        rows.append((i, "\n".join(rng.choice("abcd ") for _ in range(rng.randint(1, 14)))))
    rows += [rows[10], rows[10]]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n_lines", "2 as _th", "3 as starts")
    got = [(r["doc_id"], r["text"], r["n_lines"], r["n_removed"]) for r in D.line_dedup(docs).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, brute_lines(rows)))
    assert D.line_dedup(docs).columns == ["doc_id", "text", "_th", "starts", "n_lines", "n_removed"]
    assert D.line_dedup(docs.filter("false")).collect() == []


# language ID

WORDS = {"aa": "the cat sat upon a mat with thee".split(), "bb": "der hund lief über die straße zum haus".split(),
         "cc": "le chien mange très bien chez nous été".split()}


def prose(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang]) for _ in range(n))


def test_language_id_learns_and_rejects(spark):
    rng = random.Random(4)
    rows = [(i, prose(rng, lang, rng.randint(20, 90)), lang) for i, lang in enumerate(list(WORDS) * 40)]
    train = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = L.fit(train)
    assert [k for k, _ in model.dictionaries] == sorted(WORDS)
    asked = [(None, "THE CAT; sat 12"), (1, None), (2, ""), (3, "12 34 -- ½"), (4, prose(rng, "cc", 60_000)), (5, "der hund lief zum haus über die straße"), (5, "der hund lief zum haus über die straße")]
    docs = spark.createDataFrame(asked, "doc_id long, text string").selectExpr("*", "1 as score", "2 as lang", "3 as Rejected")
    out = L.identify(docs, model).collect()
    assert [r["lang_pred"] for r in out] == ["aa", "und", "und", "und", "cc", "bb", "bb"]
    assert all(0 <= r["score"] <= 1 for r in out) and [r["rejected"] for r in out][1:4] == [True] * 3
    assert out[0].__fields__ == ["doc_id", "text", "lang", "lang_pred", "score", "rejected"]
    wide = L.identify(docs, L.LanguageModel(model.dictionaries, min_margin=1.1)).collect()
    assert all(r["rejected"] for r in wide)
    none = L.fit(train.filter("false"))
    assert {r["lang_pred"] for r in L.identify(docs, none).collect()} == {"und"}
    assert L.identify(docs.filter("false"), model).collect() == []
    again = L.fit(train.repartition(5))
    assert again == model


def test_one_common_text_does_not_fill_the_sample(spark):
    rows = [(i, "same words", "aa") for i in range(500)] + [(500 + i, f"other text {i}", "aa") for i in range(100)]
    model = L.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample_docs=600)
    assert model.dictionaries[0][1].count(b"same words") == 1


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = L.fit(docs.filter(~L.held_out()))
    out = L.identify(docs.filter(L.held_out()).withColumnRenamed("lang", "truth"), model).collect()
    assert sum(r["lang_pred"] == r["truth"] for r in out) / len(out) > 0.97
    assert sum(r["rejected"] for r in out) / len(out) < 0.03


def test_no_language_is_lost(spark):
    rng = random.Random(3)
    french = [prose(rng, "cc", 40) for _ in range(10)]
    rows = [(i, french[i % 10], "cc") for i in range(20_000)] + [(i, prose(rng, "aa", 30), "aa") for i in range(600)]
    rows += [(i, prose(rng, "bb", 9_000), "bb") for i in range(3)]  # one language has long texts alone
    model = L.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert [k for k, _ in model.dictionaries] == ["aa", "bb", "cc"]
    asked = spark.createDataFrame([(k, prose(rng, lang, 50)) for k, lang in enumerate(WORDS)], "doc_id long, text string")
    assert [r["lang_pred"] for r in L.identify(asked, model).orderBy("doc_id").collect()] == list(WORDS)


def test_predictions_equal_plain_compression(spark):
    """The whole classifier once more: dictionaries from the rows, and zstandard called for each text and language."""
    import re

    import zstandard

    rng = random.Random(11)
    rows = [(i, prose(rng, lang, rng.randint(5, 60)), lang) for i, lang in enumerate(list(WORDS) * 20)]
    hashed = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("text", "lang", "xxhash64('sample', text) h").distinct()
    letters = lambda t: re.sub(r"[\W\d_]+", " ", t.lower()).encode()
    books = {}
    for r in hashed.orderBy("h").collect():
        books[r["lang"]] = books.get(r["lang"], b"") + letters(r["text"]) + b"\n"
    size = lambda t, lang: sum(len(zstandard.ZstdCompressor(level=L.LEVEL, write_content_size=False, write_dict_id=False,
                                    dict_data=zstandard.ZstdCompressionDict(books[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT))
                                   .compress(letters(t)[i:i + L.BLOCK_BYTES])) for i in range(0, len(letters(t)), L.BLOCK_BYTES))
    texts = [prose(rng, rng.choice(list(WORDS)), n) for n in (1, 2, 3, 8, 30, 5000)] + [prose(rng, "aa", 9) + " " + prose(rng, "cc", 9)]
    model = L.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    got = L.identify(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).orderBy("doc_id").collect()
    for t, r in zip(texts, got):
        best, second = sorted((size(t, lang), lang) for lang in books)[:2]
        assert r["lang_pred"] == best[1] and r["score"] == 1 - best[0] / second[0] and r["rejected"] == (r["score"] < L.MIN_MARGIN)


# decontamination

def slow_tiles(a, b, m):
    """Greedy string tiling, straight from its definition."""
    fa, fb, tiles = [True] * len(a), [True] * len(b), 0
    while True:
        best = m - 1, 0, 0
        for i in range(len(a)):
            for j in range(len(b)):
                k = 0
                while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k] and fa[i + k] and fb[j + k]:
                    k += 1
                if k > best[0]:
                    best = k, i, j
        if best[0] < m:
            return tiles
        k, i, j = best
        fa[i:i + k] = [False] * k
        fb[j:j + k] = [False] * k
        tiles += k


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=24), st.lists(st.integers(0, 3), max_size=30), st.integers(2, 4))
def test_tiles_are_common_disjoint_and_maximal(a, b, m):
    x, y = np.array(a, np.uint64), np.array(b, np.uint64)
    tiles = C.greedy_tiles(x, y, m)
    used_a, used_b = [], []
    for i, d, k in tiles:
        assert k >= m and a[i:i + k] == b[d:d + k]
        used_a += range(i, i + k)
        used_b += range(d, d + k)
    assert len(set(used_a)) == len(used_a) and len(set(used_b)) == len(used_b)
    rest = {tuple(a[i:i + m]) for i in range(len(a) - m + 1) if not set(range(i, i + m)) & set(used_a)}
    assert not any(tuple(b[j:j + m]) in rest for j in range(len(b) - m + 1) if not set(range(j, j + m)) & set(used_b))


def test_tiles_of_distinct_words_equal_the_definition():
    rng = random.Random(9)
    for _ in range(60):
        item = list(range(30))
        cut = sorted(rng.sample(range(1, 30), 5))
        parts = [item[a:b] for a, b in zip([0, *cut], [*cut, 30])]
        rng.shuffle(parts)
        doc = [w for p in parts for w in [*p, *[100 + rng.randint(0, 50) for _ in range(rng.randint(0, 3))]]]
        got = sum(t[2] for t in C.greedy_tiles(np.array(item, np.uint64), np.array(doc, np.uint64), 4))
        assert got == slow_tiles(item, doc, 4)


def test_leaks_and_clean_documents(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    items = [(i, " ".join(word() for _ in range(24))) for i in range(6)] + [(7, "too short"), (8, None), (9, "")]
    filler = lambda n: " ".join(word() for _ in range(n))
    w = items[0][1].split()
    rows = [(1, f"{filler(50)} {items[0][1].upper()}! {filler(9)}"),
            (2, f"{filler(5)} {' '.join(w[16:])} {filler(3)}, {' '.join(w[8:16])} {filler(2)} {' '.join(w[:8])}"),
            (3, f"{filler(5)} {' '.join(w[:12])} {filler(30)}"), (4, None), (5, ""), (6, "too short"),
            (7, f"{items[1][1]} {filler(30_000)} {items[2][1]}"), (None, items[3][1]), (1, filler(20)), (7, "x"),
            (9, items[4][1]), (9, items[4][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as seeds", "2 as item", "3 as id")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for limit in (10, 1_000_000):
        got = C.leaks(docs, bench, max_seeds=limit).collect()
        assert sorted((str(r["id"]), r["item"]) for r in got) == [("1", 0), ("2", 0), ("6", 7), ("7", 1), ("7", 2), ("9", 4), ("None", 3)]
        kept = C.decontaminate(docs, bench, max_seeds=limit).collect()
        assert sorted((str(r["doc_id"]), len(r["text"] or "")) for r in kept) == sorted(
            (str(i), len(t or "")) for k, (i, t) in enumerate(rows) if k in (2, 3, 4, 8, 9))
        assert kept[0].__fields__ == docs.columns
    assert C.leaks(docs.filter("false"), bench).collect() == [] and C.leaks(docs, bench.filter("false")).collect() == []
    assert split(["a"], tokens=True).counts.tolist() == [1]


def test_short_items_and_scripts_without_blanks(spark):
    chinese, thai = "中国的首都是哪个城市？", "เมืองหลวงของไทยคือ"
    bench = spark.createDataFrame([(1, "What is love?"), (2, chinese), (3, "yes"), (4, thai), (5, "Yes. No.")], "item_id long, text string")
    docs = spark.createDataFrame([
        (1, "what is love"), (2, "Intro here.\nWhat is LOVE?\nMore."), (3, "nobody knows what is love in this long line"),
        (4, "前言" + chinese + "后记"), (5, "yes we can, yes"), (6, "Sure! Yes. Fine"), (7, thai), (8, "中国"), (9, "yes. no.")], "doc_id long, text string")
    for limit in (0, 1000):
        got = sorted((r["id"], r["item"]) for r in C.leaks(docs, bench, max_seeds=limit).collect())
        assert got == [(1, 1), (2, 1), (4, 2), (6, 3), (7, 4), (9, 3), (9, 5)]
    assert [r["tiles"] for r in C.leaks(docs.filter("doc_id = 2"), bench).collect()] == [[[0, 2, 3]]]


def test_a_common_phrase_joins_no_pairs(spark, monkeypatch):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    phrase = "which one of the following answers is right"
    items = [(k, f"{phrase} {' '.join(word() for _ in range(16))}") for k in range(40)]
    rows = [(k, f"{word()} {phrase} {' '.join(word() for _ in range(30))}") for k in range(200)] + [(500, items[7][1]), (501, items[9][1][::1] + " end")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    held = {}
    monkeypatch.setattr(C, "_tile_udf", lambda m: held.setdefault("udf", C.F.udf(lambda d, i: {"coverage": 0.9, "tiles": [[0, 0, m]]}, C._TILED)))
    pairs = sorted((r["id"], r["item"]) for r in C.leaks(docs, bench).collect())
    assert pairs == [(500, 7), (501, 9)]


def test_repeated_tokens_stay_cheap():
    import time

    item, doc = np.zeros(1000, np.uint64), np.zeros(100_000, np.uint64)
    doc[50_000] = 7
    begun = time.time()
    tiles = C.greedy_tiles(item, doc)
    assert tiles == [[0, 0, 1000]] and time.time() - begun < 20
    rng = random.Random(2)
    for _ in range(40):
        a = [rng.randint(0, 1) for _ in range(6)]
        b = [x for _ in range(4) for x in [rng.randint(0, 2)] * rng.choice([1, 2, 20])]
        x, y = np.array(a, np.uint64), np.array(b, np.uint64)
        got = C.greedy_tiles(x, y, 2)
        assert all(a[i:i + k] == b[d:d + k] for i, d, k in got)
        used = [p for _, d, k in got for p in range(d, d + k)]
        assert len(set(used)) == len(used) and sum(t[2] for t in got) == slow_tiles(a, b, 2)
