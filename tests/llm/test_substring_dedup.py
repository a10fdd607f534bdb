import random
import re

import numpy as np
import pytest

from panelrisk.llm import substring_dedup as D
from panelrisk.llm.words import split


def brute(rows, k):
    words = [re.findall("[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    first = {}
    for (i, _), w in zip(rows, words):
        for a in range(len(w) - k + 1):
            key = tuple(w[a:a + k])
            first[key] = min(first.get(key, 10 ** 9), 10 ** 9 if i is None else i)
    out = []
    for (i, _), w in zip(rows, words):
        gone = set()
        for a in range(len(w) - k + 1):
            if first[tuple(w[a:a + k])] < (10 ** 9 if i is None else i):
                gone |= set(range(a, a + k))
        out.append((i, len(w), len(gone), " ".join(x for a, x in enumerate(w) if a not in gone)))
    return out


def key(r):
    return (r[0] is None, r[0] or 0, *r[1:])


@pytest.mark.parametrize("seed", range(4))
def test_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    word = lambda: rng.choice("ab") if seed % 2 else f"w{rng.randint(0, 400)}"
    base = [" ".join(word() for _ in range(rng.randint(30, 300))) for _ in range(12)]
    rows = [(None, base[0]), (7, None), (8, ""), (9, " \n\t "), (10, "few words"), (11, base[1]), (11, base[1]), (11, base[2])]
    for i in range(60):
        parts = [rng.choice(base).split() for _ in range(rng.randint(1, 3))]
        cut = [p[rng.randint(0, 20):len(p) - rng.randint(0, 20)] for p in parts]
        text = rng.choice([" ", "\n", "  "]).join(w for p in cut for w in [*p, *[word() for _ in range(rng.randint(0, 6))]])
        rows.append((100 + rng.randint(0, 200), text))
    rows = list({(i, t): (i, t) for i, t in rows}.values()) + [(11, base[1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as batch", "2 as n", "3 as id")
    for size, per_batch in ((13, 4096), (13, 5), (7, 16)):
        got = D.substring_dedup(docs, window=size, batch_docs=per_batch).collect()
        assert sorted(map(key, map(tuple, got))) == sorted(map(key, brute(rows, size)))


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert D.substring_dedup(docs).collect() == []


def test_false_sources_are_not_believed(spark, monkeypatch):
    """A span whose words differ from those at its source stays."""
    rows = [(1, " ".join(f"a{i}" for i in range(40))), (2, " ".join(f"b{i}" for i in range(40)))]
    docs = spark.createDataFrame(rows, "id long, text string").coalesce(1)
    batches = docs.mapInArrow(D._batched(10, 1 << 20), "batch long, ids binary, sizes binary, texts binary")
    number = batches.first()["batch"]
    claim = [(number, 1, 0, 40, number << D.PLACE_BITS, 0, bytearray(b"x" * 16))]
    found = spark.createDataFrame(claim, "batch long, doc int, start long, n long, source long, source_start long, digest binary")
    assert D.verified(batches, found).collect() == []


def test_words_and_hashes():
    texts = ["a b", None, "", " a\tbb\r\nccc \x0b\x0c d", "é ü " + "x" * (1 << 21) + " a", "a"]
    w = split(texts)
    spelt = [w.raw[a:b].tobytes().decode() for a, b in zip(w.starts, w.ends)]
    assert spelt == [x for t in texts for x in re.findall("[^\x20\x09-\x0D]+", t or "")]
    assert w.counts.tolist() == [2, 0, 0, 4, 4, 1]
    assert len({h for h in w.hashes.tolist()}) == len(set(spelt))
    assert len({(h, s) for h, s in zip(w.hashes.tolist(), spelt)}) == len(set(spelt))
    g, at = w.grams(2)
    assert at.tolist() == [0, 2, 3, 4, 6, 7, 8] and len(np.unique(g)) == 7
    assert split(["A-B c_1 É"], tokens=True).counts.tolist() == [4]
