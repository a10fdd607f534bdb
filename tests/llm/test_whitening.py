import math
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from panelrisk.llm import whitening

SCHEMA = "vec_id long, embedding array<double>"


def whole(c):
    return max(-2 ** 62, min(math.floor(1024.0 * c) if abs(c) < 1e300 else math.copysign(2 ** 63, c), 2 ** 62 - 2 ** 53)) + 100_000


def check(spark, rows, k=8):
    """Rows by their own definition, in whole numbers and fractions."""
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as n", "2 as whitened", "3 as v", "4 as _v")
    got = whitening.whiten(docs).collect()
    good = [(i, [whole(c) for c in v]) for i, v in rows
            if v and all(c is not None and math.isfinite(c) for c in v)]
    assert sorted(str(r["vec_id"]) for r in got) == sorted(str(i) for i, _ in good)
    n, dims = len(good), len(good[0][1])
    sums = [sum(x[d] for _, x in good) for d in range(dims)]
    mean = [Fraction(s, n) for s in sums]
    cov = np.array([[float(sum((x[a] - mean[a]) * (x[b] - mean[b]) for _, x in good) / n) for b in range(dims)] for a in range(dims)])
    values = np.sort(np.linalg.eigvalsh(cov))[::-1]
    dev = sorted(sum((n * x - s) ** 2 for x, s in zip(xs, sums)) for _, xs in good)
    assert sorted(int(r["deviation_exact"]) for r in got) == dev
    known = whitening.fit(docs)
    assert np.array_equal(known.covariance, cov) and known.sums == sums and known.n == n
    shares = np.clip(values / np.trace(cov), 0, None)[:k] if np.trace(cov) > 0 else [None] * min(k, dims)
    for r in got:
        assert r["n"] == n and len(r["whitened"]) == min(k, dims)
        assert r["explained"] == list(shares) or np.allclose(r["explained"], shares, rtol=1e-9, atol=1e-12)
    return got, known, cov, good


def test_random_vectors(spark):
    rng = np.random.default_rng(1)
    mixed = rng.normal(size=(300, 12)) @ rng.normal(size=(12, 12)) * 0.1
    rows = [(int(i), v.tolist()) for i, v in enumerate(mixed)]
    rows += [(None, rows[0][1]), (3, rows[3][1]), (900, None), (901, []), (902, [None] * 12), (903, [math.nan] * 12),
             (904, [0.0] * 11 + [math.inf])]
    got, known, cov, good = check(spark, rows)
    assert got[0]["identity_error"] < 1e-9
    by_id = {r["vec_id"]: np.array(r["whitened"]) for r in got}
    for i, x in good[:40]:
        d = np.array([float(a - Fraction(s, known.n)) for a, s in zip(x, known.sums)])
        for c in range(8):
            e, v = known.eigenvalues[c], known.components[:, c]
            assert np.allclose(cov @ v, e * v, rtol=1e-9, atol=1e-9 * known.eigenvalues[0]) and abs(v @ v - 1) < 1e-12
            assert by_id[i][c] == pytest.approx(d @ v / math.sqrt(e), rel=1e-9, abs=1e-9)


def test_large_values_stay_exact(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(rng.normal()), 1e9 * float(rng.normal()), 1e-3]) for i in range(50)]
    rows += [(50, [1e300, 0.5, 2.0]), (51, [-1e300, 1.0, -1e15])]
    check(spark, rows)


def test_without_variance(spark):
    got, known, _, _ = check(spark, [(1, [0.5, 0.25]), (2, [0.5, 0.25])])
    assert [r["whitened"] for r in got] == [[None, None]] * 2 and got[0]["identity_error"] is None
    got, _, _, _ = check(spark, [(i, [0.1 * i, 7.0, 0.2 * i]) for i in range(5)])
    assert all(r["whitened"][0] is not None and r["whitened"][2] is None for r in got)
    check(spark, [(1, [0.3] * 3)])


def test_empty_and_lengths(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert whitening.whiten(empty).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, None), (2, [])], SCHEMA)).collect() == []
    with pytest.raises(ValueError, match=r"\[1, 2\]"):
        whitening.whiten(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], SCHEMA))


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 200), st.lists(st.integers(1, 63), min_size=1, max_size=4), st.integers(0, 10 ** 6))
def test_scatter_equals_products(n, bits, seed):
    rng = np.random.default_rng(seed)
    bits = np.array(bits)
    x = np.stack([rng.integers(0, 1 << int(b), n, np.uint64, endpoint=False) if b < 63 else
                  rng.integers(0, (1 << 63) - 1, n, np.uint64) for b in bits], 1)
    got = whitening.scatter(x, bits)
    for i in range(len(bits)):
        for j in range(i, len(bits)):
            want = sum(int(a) * int(b) for a, b in zip(x[:, i], x[:, j]))
            assert sum(int(g) << (24 * k) for k, g in enumerate(got[:, i, j])) == want


def test_query(spark):
    rows = whitening.op12_whitening(spark, "/root/testdata/sf0.001")
    assert rows.columns[:7] == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    got = rows.collect()
    base = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").count()
    assert len(got) == 8 * base and {r["component"] for r in got} == set(range(1, 9))
    assert max(r["identity_error"] for r in got) < 1e-4 and all(r["deviation"] == int(r["deviation_exact"]) for r in got)
