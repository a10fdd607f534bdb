"""Whitening of vectors by an exact, bit-sliced scatter matrix.

Components become integers, x = floor(scale * c) + shift.  Each task packs the bit planes of every dimension,
less its smallest value, over its rows into 64-bit words; the product sum of two dimensions is the sum
over their planes of 2 ** (a + b) times the number of rows with both bits set: an AND and a population
count.  These counts are whole numbers, added up by one grouped aggregate with a row for each pair of
dimensions.  The driver centres them as integers and only then divides, so the covariance is correctly
rounded whatever the order of the rows, and solves the eigenproblem of D x D numbers.

Defined results.  Vectors that are null or empty or hold null or non-finite entries take no part; null and
repeated ids are kept as they are.  All other vectors must have one length, or a ValueError names the
lengths before the work begins.  Components beyond +-2**62 / scale are held there, as a long
has no more room.  A component without variance (its eigenvalue is zero to double precision: constant
dimensions, fewer rows than dimensions) has null as its whitened value.  ``deviation`` is null where the
number doesn't fit a long; ``deviation_exact`` always has its digits.  An empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelrisk.llm.common import col, table, written

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
#: Rows whose bit planes are packed at once.
SLICE = 8_192
#: Exponents summed in one long: 24 bits, at most 63 pairs of planes for each, and 2**32 rows stay below 2**62.
_LIMB = 24
_EDGE = 1 << 62


def _usable(vec_col: str):
    v = col(vec_col)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return v.isNotNull() & (F.size(v) > 0) & finite


def _integers(vectors: pa.Array, scale: int, shift: int) -> np.ndarray:
    """The rows' x as a matrix of longs."""
    n = len(vectors)
    raw = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)
    with np.errstate(over="ignore"):
        return np.clip(np.floor(raw * scale), -_EDGE, _EDGE - (1 << 53)).astype(np.int64) + shift


def _planes(x: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Bit planes (by dimension, then bit) of unsigned numbers, packed over the rows into words."""
    n = len(x)
    out = np.zeros((int(bits.sum()), -(-n // 64) * 8), np.uint8)
    for d, first in enumerate(np.cumsum(bits) - bits):
        for b in range(bits[d]):
            packed = np.packbits((x[:, d] >> np.uint64(b)) & np.uint64(1) != 0)
            out[first + b, :len(packed)] = packed
    return out.view(np.uint64)


def scatter(x: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """(limbs, D, D): product sums of all pairs of columns; limb k counts 2 ** (24 k)."""
    dims, owner = len(bits), np.repeat(np.arange(len(bits)), bits)
    power = np.concatenate([np.arange(b) for b in bits]) if dims else np.zeros(0, int)
    limbs = max(1, -(-(2 * int(bits.max(initial=1)) - 1) // _LIMB))
    out = np.zeros((limbs, dims, dims), np.int64)
    for at in range(0, len(x), SLICE):
        planes = _planes(x[at:at + SLICE], bits)
        for p in range(len(planes)):
            both = np.bitwise_count(planes[p:] & planes[p]).sum(1, dtype=np.int64)
            exponent = power[p:] + power[p]
            both[1:] *= np.where(owner[p + 1:] == owner[p], 2, 1)  # of one dimension, both orders count
            for limb in range(limbs):
                own = exponent // _LIMB == limb
                np.add.at(out[limb, owner[p]], owner[p:][own], both[own] << (exponent[own] - _LIMB * limb))
    return out


@dataclass
class Fit:
    """Statistics of the x-vectors: ``n`` rows, per-dimension sums, covariance, eigenvalues and unit components."""

    n: int
    sums: list[int]
    covariance: np.ndarray
    eigenvalues: np.ndarray
    components: np.ndarray  # by column, by falling eigenvalue

    @property
    def live(self) -> np.ndarray:
        """The components with variance."""
        top = max(float(self.eigenvalues.max(initial=0)), 0.0)
        return self.eigenvalues > top * len(self.sums) * np.finfo(float).eps


def _x(vectors: DataFrame, vec_col: str) -> DataFrame:
    return vectors.filter(_usable(vec_col)).select(F.transform(col(vec_col), lambda c: c.cast("double")).alias("v"))


def fit(vectors: DataFrame, vec_col: str = "embedding", scale: int = SCALE, shift: int = SHIFT) -> Fit | None:
    """Exact statistics of all usable vectors (None without any): two passes, each one grouped aggregate."""
    rows = _x(vectors, vec_col)
    lengths = [r[0] for r in rows.groupBy(F.size("v")).agg(F.count(F.lit(1))).limit(3).collect()]
    if not lengths:
        return None
    if len(lengths) > 1:
        raise ValueError(f"vectors of different lengths can't be whitened together: {sorted(lengths)}")
    dims = lengths[0]

    def extremes(stream):
        """Per dimension: rows, smallest and largest x, and the sum in two parts."""
        n, low, high, parts = 0, None, None, np.zeros((2, dims), np.int64)
        for b in stream:
            if b.num_rows:
                x = _integers(b.column(0), scale, shift)
                n += len(x)
                low = x.min(0) if low is None else np.minimum(low, x.min(0))
                high = x.max(0) if high is None else np.maximum(high, x.max(0))
                parts += np.stack([(x >> 32).sum(0), (x & 0xFFFFFFFF).sum(0)])
        if n:
            yield pa.RecordBatch.from_pydict({"d": np.arange(dims, dtype=np.int32), "n": np.full(dims, n), "low": low,
                                              "high": high, "s1": parts[0], "s0": parts[1]})

    total = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    stats = (rows.mapInArrow(extremes, "d int, n long, low long, high long, s1 long, s0 long").groupBy("d")
             .agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), total("s1"), total("s0"))
             .orderBy("d").collect())  # a row for each dimension
    n = stats[0]["n"]
    low = np.array([r["low"] for r in stats], np.int64)
    bits = np.array([max(1, (r["high"] - r["low"]).bit_length()) for r in stats])

    def products(stream):
        out, held, size = 0, [], 0

        def packed():
            return scatter(np.concatenate(held).astype(np.uint64) - low.astype(np.uint64), bits)

        for b in stream:
            if b.num_rows:
                held.append(_integers(b.column(0), scale, shift))
                size += b.num_rows
                if size >= SLICE:
                    out, held, size = out + packed(), [], 0
        if size:
            out = out + packed()
        if not isinstance(out, int):
            i, j = np.triu_indices(dims)
            for limb in range(len(out)):
                yield pa.RecordBatch.from_pydict({"limb": np.full(len(i), limb, np.int32), "i": i.astype(np.int32),
                                                  "j": j.astype(np.int32), "count": out[limb][i, j]})

    pairs = (rows.mapInArrow(products, "limb int, i int, j int, count long").groupBy("limb", "i", "j")
             .agg(total("count")).collect())  # D * (D + 1) / 2 rows for each 24 bits
    moments = [[0] * dims for _ in range(dims)]
    for r in pairs:
        moments[r["i"]][r["j"]] += int(r["count"]) << (_LIMB * r["limb"])
    base = [int(v) for v in low]
    sums = [(int(r["s1"]) << 32) + int(r["s0"]) for r in stats]
    above = [s - n * b for s, b in zip(sums, base)]  # sums of x less the smallest
    cov = np.zeros((dims, dims))
    for i in range(dims):
        for j in range(i, dims):
            cov[i, j] = cov[j, i] = (n * moments[i][j] - above[i] * above[j]) / (n * n)  # whole numbers, rounded once
    values, vectors_ = np.linalg.eigh(cov)
    order = np.argsort(-values, kind="stable")
    parts = vectors_[:, order]
    parts = parts * np.where(parts[np.abs(parts).argmax(0), np.arange(dims)] < 0, -1.0, 1.0)
    return Fit(n, sums, cov, values[order], parts)


def _deviations(u: np.ndarray, rest: list[int], n: int) -> list[int]:
    """sum over dimensions of (n * u - rest) ** 2, exactly: u is x less the floor of its mean."""
    r = np.array(rest, object)
    big = max(int(np.abs(u).max(initial=0)), 1)
    if len(rest) * big * big < 1 << 62 and len(rest) * big * max([1, *rest]) < 1 << 62:
        squares, cross = (u * u).sum(1).tolist(), (u @ r.astype(np.int64)).tolist()
    else:
        squares, cross = (u.astype(object) ** 2).sum(1).tolist(), u.astype(object).dot(r).tolist()
    own = sum(x * x for x in rest)
    return [n * n * a - 2 * n * b + own for a, b in zip(squares, cross)]


def whiten(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = COMPONENTS,
           scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """(id_col, deviation_exact, whitened, n, explained, identity_error), a row for each usable vector.

    ``whitened`` is an array with the projections on the first components, each over the root of its
    eigenvalue; ``explained`` the components' shares of the variance.  ``identity_error`` is measured on
    the whitened rows: the largest absolute entry of their covariance minus the identity.
    """
    shape = f"`{id_col}` {vectors.schema[id_col].dataType.simpleString()}, deviation_exact string, whitened array<double>"
    known = fit(vectors, vec_col, scale, shift)
    if known is None:
        return vectors.sparkSession.createDataFrame([], f"{shape}, n long, explained array<double>, identity_error double")
    k = min(components, len(known.sums))
    n, live = known.n, known.live[:k]
    floors = [s // n for s in known.sums]
    rest = [s - n * m for s, m in zip(known.sums, floors)]
    middle, part = np.array(floors, np.int64), np.array([r / n for r in rest])
    down = known.components[:, :k] / np.sqrt(np.where(live, known.eigenvalues[:k], 1.0))

    def projected(stream):
        for b in stream:
            if b.num_rows:
                u = _integers(b.column(1), scale, shift) - middle
                w = (u.astype(np.float64) - part) @ down
                flat = pa.array(w.ravel(), mask=np.tile(~live, len(w)))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array([str(d) for d in _deviations(u, rest, n)]),
                     pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1, dtype=np.int32) * k), flat)],
                    [id_col, "deviation_exact", "whitened"])

    rows = vectors.filter(_usable(vec_col)).select(col(id_col), F.transform(col(vec_col), lambda c: c.cast("double")).alias("_v"))
    out = written(rows.mapInArrow(projected, shape), "whitened")
    on = [i for i in range(k) if live[i]]
    pairs = [(i, j) for i in on for j in on if i <= j]
    w = F.col("whitened")
    error = None
    if pairs:
        got = out.agg(*[F.covar_pop(w[i], w[j]) for i, j in pairs]).first()  # one row
        error = float(max(abs(c - (i == j)) for c, (i, j) in zip(got, pairs)))
    trace = float(np.trace(known.covariance))
    shares = [float(max(e, 0.0) / trace) if trace > 0 else None for e in known.eigenvalues[:k]]
    return out.select("*", F.lit(n).cast("long").alias("n"), F.array(*map(F.lit, shares)).cast("array<double>").alias("explained"),
                      F.lit(error).cast("double").alias("identity_error"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return (rows.select("*", F.posexplode("whitened").alias("at", "value"))
            .select("vec_id", (F.col("at") + 1).alias("component"), "n", F.expr("try_cast(deviation_exact AS long)").alias("deviation"),
                    F.col("value").alias("whitened"), F.get("explained", F.col("at")).alias("explained"), "identity_error",
                    "deviation_exact"))


ORACLE: dict[str, str] = {}
QUERIES = {"op12_whitening": op12_whitening}
