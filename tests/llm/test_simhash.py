import random

import numpy as np
import pytest
import xxhash

from panelrisk.llm import simhash as S


def brute_fingerprint(text, k=4):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        lower = lower.replace(c, " ")
    w = [x for x in lower.split(" ") if x]
    if not w:
        return 0
    grams = [" ".join(w[i:i + k]) for i in range(max(1, len(w) - k + 1))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, limit):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in fps:
        for b in fps:
            if a < b and (a ^ b).bit_count() <= limit:
                root[find(a)] = find(b)
    return {f: find(f) for f in fps}


TEXTS = [None, "", "  \n", "one", "one TWO three", "a b c d e f g h", "A b\tc d  e f\ng h", "É b c d", "é b c d",
         "x " * 70_000, "a b c d e"]


def test_fingerprint_is_the_definition():
    for t in TEXTS:
        assert S.fingerprint(t) == brute_fingerprint(t), t


@pytest.mark.parametrize("n,flips", [(1, 0), (2, 3), (40, 4), (700, 5), (3000, 6)])
def test_index_finds_every_pair(n, flips):
    rng = random.Random(n)
    base = [rng.getrandbits(64) for _ in range(max(1, n // 8))]
    fps = set()
    while len(fps) < n:
        x = rng.choice(base)
        for _ in range(rng.randint(0, flips)):
            x ^= 1 << rng.randrange(64)
        fps.add(x)

    def rank(x):
        for k in (1, 2, 4, 8, 16, 32):
            x ^= x >> k
        return x

    a = np.array(sorted(fps, key=rank), np.uint64)
    q, b = S.GrayIndex(a).near(a, 4, np.arange(n))
    got = set(zip(q.tolist(), b.tolist()))
    want = {(i, j) for i in range(n) for j in np.flatnonzero(np.bitwise_count(a[i + 1:] ^ a[i]) <= 4) + i + 1}
    assert got == {(i, int(j)) for i, j in want}
    root = S.linked(a, 4)
    for i, j in got:
        assert root[i] == root[j]


@pytest.mark.parametrize("split_above", [20_000, 3])
def test_components_equal_brute_force(spark, split_above):
    rng = random.Random(5)
    fps = set()
    for _ in range(60):
        x = rng.getrandbits(64)
        for _ in range(rng.randint(1, 8)):
            fps.add(x)
            for _ in range(rng.randint(1, 5)):
                x ^= 1 << rng.randrange(64)
    fps |= {0, 1, 2 ** 64 - 1, 2 ** 64 - 2}
    signed = [(f - 2 ** 64 if f >= 2 ** 63 else f,) for f in fps]
    found = S.components(S.links(spark.createDataFrame(signed, "fp long"), 4, split_above)).collect()
    root = {r["node"] % 2 ** 64: r["root"] % 2 ** 64 for r in found}
    want = brute_components(fps, 4)
    same = {}
    for f in fps:
        same.setdefault(want[f], set()).add(root.get(f, f))
    assert all(len(v) == 1 for v in same.values()) and len(set.union(*same.values())) == len(same)


def test_operator_and_edge_cases(spark):
    base = " ".join(f"w{i}" for i in range(400))
    near = base + " more"
    rows = [(7, base), (3, near), (9, None), (4, ""), (4, ""), (None, "single words only here now"), (11, base), (None, base),
            (5, "other text that is alone in the table")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as fp", "2 as component_id", "3 as id")
    out = S.simhash(docs).collect()
    assert len(out) == len(rows)
    by = {}
    for r in out:
        by.setdefault((r["doc_id"], r["fingerprint"]), set()).add(r["component_id"])
    for (i, t) in rows:
        assert f"{brute_fingerprint(t):016x}" in {f for d, f in by if d == i}
    comp = {r["doc_id"]: r["component_id"] for r in out if r["doc_id"] is not None}
    assert comp == {7: 3, 3: 3, 11: 3, 9: 4, 4: 4, 5: 5}
    kept = S.near_dedup(docs).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in kept if r["doc_id"] is not None) == [(False, 3), (False, 4), (False, 5)]
    assert [r["text"] for r in kept if r["doc_id"] is None] == ["single words only here now"]
    assert kept[0].__fields__ == docs.columns
    assert S.simhash(docs.filter("false")).collect() == [] and S.near_dedup(docs.filter("false")).collect() == []


def test_a_dense_group_is_searched_only_until_it_is_joined():
    rng = np.random.default_rng(5)
    # 6,000 fingerprints in a ball, each near many others, and 600 far from it in pairs
    ball = np.uint64(0x0123456789ABCDEF) ^ np.bitwise_or.reduce(
        np.uint64(1) << rng.integers(0, 30, (6000, 5)).astype(np.uint64), axis=1)
    far = rng.integers(0, 1 << 63, 300, np.uint64)
    fps = np.unique(np.concatenate((ball, far, far ^ np.uint64(0b1011))))
    rank = fps.copy()
    for k in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(k)
    fps = fps[np.argsort(rank)]
    visited = []
    whole = S.GrayIndex.near

    def counted(self, *args):
        q, b = whole(self, *args)
        visited.append(len(q))
        return q, b

    S.GrayIndex.near = counted
    try:
        got = S.linked(fps)
    finally:
        S.GrayIndex.near = whole
    root = np.arange(len(fps))
    pairs = 0
    for i in range(len(fps)):
        j = np.flatnonzero(np.bitwise_count(fps[i] ^ fps[i + 1:]) <= 4) + i + 1
        pairs += len(j)
        same = np.unique(np.append(root[j], root[i]))
        root[np.isin(root, same)] = same[0]
    assert (got == root).all()
    assert sum(visited) < pairs / 4, (sum(visited), pairs)
