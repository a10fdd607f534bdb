import random
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from panelrisk.llm import sharding as S


def brute(sizes, shards):
    """The smallest capacity for runs of whole groups, by trying all that can matter."""
    def runs(c):
        n, left = 1, c
        for x in sizes:
            if x > c:
                return 10 ** 9
            if x > left:
                n, left = n + 1, c
            left -= x
        return n
    low, high = max(sizes), sum(sizes)
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if runs(mid) <= shards else (mid + 1, high)
    return low


@pytest.mark.parametrize("seed", range(6))
def test_capacity_is_the_smallest(spark, seed):
    rng = random.Random(seed)
    sizes = [rng.choice([1, 2, 17, 300, 20_000]) * rng.randint(1, 9) for _ in range(rng.choice([1, 3, 50, 400]))]
    sums = [sum(sizes[:i + 1]) for i in range(len(sizes))]
    for shards, cells in ((1, 8), (4, 8), (7, 40), (40, 200)):
        got, cuts = S.minimax_cuts(spark.createDataFrame([(x,) for x in sums], "ends long").coalesce(1), shards, cells)
        assert got == brute(sizes, shards)
        assert set(cuts) <= set(sums) and cuts[-1] == sums[-1] and len(cuts) <= shards
        assert max(b - a for a, b in zip([0, *cuts], cuts)) == got


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 50), min_size=1, max_size=30), st.integers(1, 8), st.integers(0, 2 ** 30))
def test_checks_bracket_the_answer(sizes, shards, seed):
    """With some ends hidden, the hopeful answer is never above the true one, nor the safe one below."""
    rng = random.Random(seed)
    sums = [sum(sizes[:i + 1]) for i in range(len(sizes))]
    known = S._Ends(sums[-1])
    cells, i = [], 0
    while i < len(sums):
        j = min(len(sums) - 1, i + rng.randint(0, 4))
        cells.append((sums[i], sums[j]))
        i = j + 1
    known.learn([(0, sums[-1])], cells)
    true = brute(sizes, shards)
    low = -(-sums[-1] // shards) - 1
    assert known.least(low, sums[-1], shards, True) <= true <= known.least(low, sums[-1], shards, False)


def test_rows(spark):
    rng = random.Random(1)
    texts = [None, "", "é"] + ["w" * rng.randint(1, 400) for _ in range(200)] + ["copy " * 30] * 150
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "copy " * 30), (5, "x"), (5, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as size", "2 as place", "3 as part")
    out = S.shard(docs, n_shards=8).collect()
    assert len(out) == len(rows)
    by_text, loads = {}, {}
    crc = {(i, zlib.crc32((t or "").encode()) if t is not None else None): t for i, t in rows}
    for r in out:
        t = crc[(r["doc_id"], r["text_crc32"])]
        assert r["size"] == len((t or "").encode()) + 16
        by_text.setdefault(t, set()).add(r["shard"])
        loads.setdefault(r["shard"], []).append((r["slot"], r["size"]))
    assert all(len(v) == 1 for v in by_text.values()) and max(loads) < 8
    for v in loads.values():
        assert sorted(s for s, _ in v) == list(range(len(v)))
    assert S.shard(docs.filter("false"), n_shards=8).collect() == []
    few = S.shard(docs.limit(2), n_shards=40).collect()
    assert len(few) == 2


@pytest.mark.parametrize("place,share", [(0, 0), (0, 1 / 3), (0.5, 1 / 3), (1, 0.9)])
def test_a_large_group_empties_no_shard(spark, place, share):
    rng = random.Random(3)
    sizes = [rng.randint(100, 900) for _ in range(4_000)]
    sizes.insert(int(place * len(sizes)), big := int(sum(sizes) * share / (1 - share)) + 1)
    sums = [sum(sizes[:i + 1]) for i in range(len(sizes))]
    got, cuts = S.minimax_cuts(spark.createDataFrame([(x,) for x in sums], "ends long").coalesce(1), 40, 2_000)
    runs = sorted(b - a for a, b in zip([0, *cuts], cuts))
    assert len(cuts) == 40 and runs[0] > 0 and set(cuts) <= set(sums) and cuts[-1] == sums[-1]
    assert runs[-1] == got == brute(sizes, 40)
    if share:
        even = (sum(sizes) - big) / 39
        assert got == big and runs[-2] < 1.2 * even and sum(r < 0.8 * even for r in runs) <= 2


def test_as_many_groups_as_shards(spark):
    for sizes in ([10 ** 9] + [1] * 39, [7, 1, 10 ** 6]):
        sums = [sum(sizes[:i + 1]) for i in range(len(sizes))]
        assert S.minimax_cuts(spark.createDataFrame([(x,) for x in sums], "ends long"), 40, 200) == (max(sizes), sums)


def test_rows_with_a_third_in_one_group(spark):
    docs = spark.createDataFrame([(i, "copy " * 20 if i % 3 == 0 else f"text number {i} " * 6) for i in range(3_000)],
                                 "doc_id long, text string")
    loads = {}
    for r in S.shard(docs).collect():
        loads[r["shard"]] = loads.get(r["shard"], 0) + r["size"]
    assert sorted(loads) == list(range(40)) and max(loads.values()) == 1_000 * 116
