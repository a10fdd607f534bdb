import numpy as np
import pytest

from panelrisk.llm import topk as M


def brute(ids, x, query_rows, k):
    out = {}
    for r in query_rows:
        s = x @ x[r]
        rest = [(-int(s[j]), int(ids[j])) for j in range(len(ids)) if ids[j] != ids[r]]
        out[int(ids[r])] = [(i, -n) for n, i in sorted(rest)[:k]]
    return out


@pytest.mark.parametrize("n,seed", [(1, 0), (5, 1), (300, 2), (2000, 3)])
def test_tree_equals_brute_force(n, seed):
    rng = np.random.default_rng(seed)
    x = rng.integers(-64, 65, (n, 8))
    x[n // 3:] += 100 * rng.integers(0, 3, (n - n // 3, 1))
    ids = rng.permutation(n)
    tree = M.MTree(ids, x, float((x * x).sum(1).max()), page=8, fanout=4)
    assert sorted(i for lv in tree.levels[:1] for g in lv["members"] for i in g.tolist()) == list(range(n))
    want = brute(ids, x, range(min(n, 40)), 7)
    for r in range(min(n, 40)):
        got = [(i, s) for s, i in tree.search(x[r], int(ids[r]), 7)]
        assert got == want[int(ids[r])]
        if len(got) == 7:
            again = tree.search(x[r], int(ids[r]), 7, tree.kth_distance(x[r], got[-1][1]))
            assert [(i, s) for s, i in again] == got


def test_bounds_avoid_work():
    rng = np.random.default_rng(0)
    x = rng.integers(-3, 4, (4000, 6)) + 60 * rng.integers(-5, 6, (400, 6)).repeat(10, 0)
    tree = M.MTree(np.arange(4000), x, float((x * x).sum(1).max()), page=16, fanout=8)
    seen = []
    raw = tree.raw

    class Counted:
        def __getitem__(self, k):
            seen.append(len(k))
            return raw[k]

    tree.raw = Counted()
    tree.search(x[5], 5, 5)
    assert sum(seen) < 2000


def test_operator(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(600, 5)).round(2)
    x[100:350] = x[100]  # a very common vector
    rows = [(int(i), [float(v) for v in x[i]]) for i in range(600)]
    odd = [(620, None), (640, []), (660, [1.0, None, 0.0, 0.0, 0.0]), (680, [float("nan")] + [0.0] * 4),
           (None, [9.0] * 5), (700, [float("inf")] + [0.0] * 4), (20, rows[20][1])]
    t = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").selectExpr("*", "1 as tree", "2 as score", "3 as id")
    y = np.floor(64 * np.vstack([x, x[20:21]])).astype(int)
    ids = np.array([*range(600), 20])
    want = brute(ids, y, [r for r in range(600) if r % 20 == 0], 20)
    for trees, block in ((4096, 4096), (40, 7)):
        got = {}
        for r in M.top_k(t, pivots=4, tree_rows=trees, block=block).orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
            assert r["rank"] == len(got[r["query_id"]])
        assert got == want
    assert M.top_k(t.filter("false")).collect() == []
    assert M.top_k(t.filter("vec_id = 40")).collect() == []


def test_large_values_and_lengths(spark):
    import pytest
    rows = [(0, [1e9, 1.0]), (20, [1e300, -2.0]), (40, [-1e300, 3.0]), (3, [2e9, 0.5]), (4, [0.25, 0.5]), (5, [3e7, -3e7])]
    t = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = {i: [max(-2 ** 62, min(2 ** 62, int(np.floor(64 * c)) if abs(c) < 1e17 else int(np.sign(c)) * 2 ** 63)) for c in v] for i, v in rows}
    want = []
    for q in (0, 20, 40):
        found = sorted((-max(1 - 2 ** 63, min(2 ** 63 - 1, sum(a * b for a, b in zip(whole[q], v)))), i) for i, v in whole.items() if i != q)
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(found[:20])]
    for trees in (4096, 2):
        got = [tuple(r) for r in M.top_k(t, pivots=2, tree_rows=trees).orderBy("query_id", "rank").collect()]
        assert got == want
    with pytest.raises(ValueError, match="2 to 3 components"):
        M.top_k(t.union(spark.createDataFrame([(9, [1.0, 2.0, 3.0])], t.schema)))
