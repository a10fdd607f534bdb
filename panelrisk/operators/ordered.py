"""Ordered scans that stay distributed when one segment is huge.

A plain ``Window.partitionBy(seg).orderBy(...)`` puts a whole segment in one task; with
a 2-class label, one score column or a hot entity that is a third of the data in one
task.  Instead the ordered key space is cut into buckets:

* ``range_bucket``  - literal cut points on the order tuple, taken from quantile sketches
  and applied with the JVM ``Bucketizer``; a hot segment, and a hot value of the leading
  order column in it, spans many buckets.  The bucket id is a pure function of the key, so every branch of
  a plan agrees on it (partition ids after a range exchange would not: each branch
  samples its own bounds).  Buckets only need to be monotone along the order inside a
  segment, so the segment itself is not part of the cut.
* ``hash_bucket`` - when the order key is a uniform hash (md5 hex), equal-width
  buckets on its leading bits are already balanced; no pass for cut points is needed.

Within a bucket a window does the local work; the cross-bucket part is a small table
(one row per bucket, or per bucket x segment) whose size is bounded by the number of
buckets, combined with a window over that small table and joined back.
"""

from __future__ import annotations

import math
import sys
from bisect import bisect_right
from collections import Counter
from collections.abc import Mapping, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelrisk.operators.stats import with_code

BUCKET = "_bucket"
_HUGE = sys.float_info.max
_LARGE = 1e308   # infinities and everything beyond count as this, nulls and NaN as _HUGE
_DIGIT = 31      # bits of an order column that one round of cut points looks at
_CHUNK, _CHUNKS = 6, 4
_EXACT = 1 << 51


def default_buckets(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))


def _cols(names: Sequence[str | Column]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in names]


def _chunk(c: Column, k: int) -> Column:
    """Bytes 6k to 6k + 5 of a text and how many there are, as a whole number: ordered like the bytes."""
    part = F.substring(c.cast("binary"), _CHUNK * k + 1, _CHUNK)
    return F.conv(F.rpad(F.hex(part), 2 * _CHUNK, "0"), 16, 10).cast("long") * 8 + F.octet_length(part)


def _whole(c: Column, dt: T.DataType) -> Column | None:
    """A long of the same order and without ties, for types that have one."""
    if isinstance(dt, T.BooleanType):
        return c.cast("int").cast("long")
    if isinstance(dt, T.IntegralType):
        return c.cast("long")
    if isinstance(dt, T.DateType):
        return F.unix_date(c).cast("long")
    if isinstance(dt, T.TimestampType):
        return F.unix_micros(c)
    if isinstance(dt, T.TimestampNTZType):
        # wall-clock fields only: a cast through the session time zone is not monotone
        # across daylight-saving gaps
        second = (F.date_part(F.lit("SECOND"), c) * 1_000_000).cast("long")
        return F.unix_date(c.cast("date")).cast("long") * 86_400_000_000 + (F.hour(c) * 60 + F.minute(c)).cast("long") * 60_000_000 + second
    if isinstance(dt, T.DecimalType) and dt.precision <= 18:
        return (c * F.lit(10 ** dt.scale).cast(f"decimal({dt.scale + 1},0)")).cast("long")
    return None


def _as_double(c: Column, dt: T.DataType) -> Column | None:
    """A double that never decreases along numeric, boolean, date, timestamp and text keys (else None)."""
    if isinstance(dt, T.StringType):
        return _chunk(c, 0).cast("double")  # text is ordered by its bytes
    if isinstance(dt, T.NumericType):
        return c.cast("double") + F.lit(0.0)  # -0.0 is 0.0
    whole = _whole(c, dt)
    return None if whole is None else whole.cast("double")


def _finite(x: Column) -> Column:
    """``x`` without nulls (first), NaN (last) and infinities, in the order in which Spark sorts them."""
    return (F.when(x.isNull(), -_HUGE).when(F.isnan(x), _HUGE)
            .otherwise(F.greatest(F.least(x, F.lit(_LARGE)), F.lit(-_LARGE))))


def _codes(df: DataFrame, order: Sequence[Column], names: str) -> tuple[DataFrame, list[tuple[str, Column | None]]]:
    """Longs in the order of the tuple behind the leading column's double: their names, each with the text
    length from which a text goes on behind them, or null.  A column whose type has no such long ends the list.
    """
    out: list[tuple[str, Column | None]] = []
    for i, c in enumerate(order):
        dt = df.select(c).schema.fields[0].dataType
        if isinstance(dt, (T.DoubleType, T.FloatType)):
            if i:
                name = f"{names}{len(out)}"
                value = F.when(~F.isnan(c), c.cast("double"))
                df = with_code(df.withColumn(f"{name}v", value), f"{name}v", name)
                df = df.withColumn(name, F.when(F.isnan(c), F.lit((2047 << 52) + 1)).otherwise(F.col(name))).drop(f"{name}v")
                out.append((name, None))
            continue
        if isinstance(dt, T.StringType):
            for k in range(0 if i else 1, _CHUNKS):
                out.append((f"{names}{len(out)}", F.octet_length(c) if k + 1 == _CHUNKS else None))
                df = df.withColumn(out[-1][0], _chunk(c, k))
            continue
        whole = _whole(c, dt)
        if whole is None:
            break
        if not i:  # a double may have lost its last bits
            whole = F.when((whole > _EXACT) | (whole < -_EXACT), whole)
        out.append((f"{names}{len(out)}", None))
        df = df.withColumn(out[-1][0], whole)
    return df, out


def _digits(code: Column, low: int, high: int) -> list[Column]:
    """A long between ``low`` and ``high``, or null, as numbers below 2**31 from the front; nulls are smallest."""
    s = 0
    while (high >> s) - (low >> s) + 2 >= 1 << _DIGIT:
        s += 1
    out = [F.shiftright(code, s) - F.lit(low >> s) + 1]
    while s:
        t = max(0, s - _DIGIT)
        out.append(F.shiftright(code, t).bitwiseAND(F.lit((1 << (s - t)) - 1)))
        s = t
    return [F.coalesce(d, F.lit(0)) for d in out]


def _quantiles(x: Column, n: int) -> Column:
    return F.percentile_approx(x, [b / n for b in range(1, n)], max(10_000, 20 * n))


def _repeated(cuts: Sequence[float]) -> dict[float, int]:
    """Values that fill more than a bucket, with the number of cuts that fell on each."""
    return {v: k for v, k in Counter(cuts).items() if k > 1}


def range_bucket(df: DataFrame, order: Sequence[str | Column], n_buckets: int | None = None,
                 name: str = BUCKET) -> DataFrame:
    """Attach a bucket id that never decreases along ``order`` (inside any segment).

    There are about as many buckets as shuffle partitions.  The cut points are row quantiles of
    the leading order column from ``percentile_approx``: a mergeable sketch, combined before the
    shuffle, so a value that fills many rows counts with all of them and the driver sees the cut
    points only.  They become literals of the JVM ``Bucketizer``, so every branch of a plan - and
    every retried task - agrees on a row's bucket.  A hot segment is spread over many buckets.

    A value on which several cuts fall gets a bucket of its own, and the rows in such buckets are
    cut again, at the quantiles of (bucket, next 31 bits of the order tuple), until no value repeats or the
    tuple ends: so rows that share one leading value, a hot (entity, period) say, are spread by
    their tie columns.  Each round is one more sketch over the rows of those buckets.  Only rows equal
    in all of ``order`` stay together, and those that differ only behind 24 equal bytes of a text or in a column
    of another type than number, boolean, date, timestamp and text (or a decimal of over 18 digits).
    Nulls come first and NaN last; an empty table has one bucket.
    """
    n = n_buckets or default_buckets(df)
    cols = _cols(order)
    x = _as_double(cols[0], df.select(cols[0]).schema.fields[0].dataType)
    if x is None:
        raise TypeError("the leading order column must be a number, boolean, date, timestamp or text")
    tmp_in, tmp_out, tmp_code = f"{name}__x", f"{name}__b", f"{name}__c"

    def cut(staged: DataFrame, at: Sequence[float]) -> DataFrame:
        bz = Bucketizer(splits=[float("-inf"), *at, float("inf")], inputCol=tmp_in, outputCol=tmp_out)
        return bz.transform(staged)

    if n < 2:
        return df.withColumn(name, F.lit(0))
    staged, codes = _codes(df.withColumn(tmp_in, _finite(x)), cols, tmp_code)
    ends = [e for i, (c, _) in enumerate(codes)
            for e in (F.min(c).alias(f"min{i}"), F.max(c).alias(f"max{i}"), F.count(c).alias(f"count{i}"))]
    longest = [F.max(size).alias(f"size{i}") for i, (_, size) in enumerate(codes) if size is not None]
    found = staged.agg(_quantiles(F.col(tmp_in), n).alias("cuts"), F.count(F.lit(1)).alias("rows"), *ends, *longest).first()
    if not found["cuts"]:
        return df.withColumn(name, F.lit(0))
    digits: list[Column] = []
    for i, (c, size) in enumerate(codes):
        low, high = found[f"min{i}"], found[f"max{i}"]
        if low is not None and (low != high or found[f"count{i}"] != found["rows"]):
            digits += _digits(F.col(c), low, high)
        if size is not None and (found[f"size{i}"] or 0) > _CHUNK * _CHUNKS:
            break
    hot = {v: k for v, k in _repeated(found["cuts"]).items() if abs(v) != _LARGE} if digits else {}
    at = sorted({*found["cuts"], *(math.nextafter(v, math.inf) for v in hot if v < _HUGE)})
    out = cut(staged, at).withColumn(name, F.col(tmp_out).cast("long")).drop(tmp_out)
    hot = {bisect_right(at, v): k for v, k in hot.items()}
    top = len(at)
    for digit in digits:
        if not hot or top >= 1 << 53 - _DIGIT:
            break
        out = out.withColumn(tmp_in, (F.col(name) * (1 << _DIGIT) + digit).cast("double"))
        inside = F.expr(f"`{name}` IN ({','.join(map(str, hot))})")
        cuts = out.where(inside).agg(_quantiles(F.col(tmp_in), sum(hot.values()) + 1)).first()[0]
        again = _repeated(cuts)
        at = sorted({*cuts, *(v + 1 for v in again)})
        # buckets without a cut keep their rows together, whatever their digits
        out = cut(out, at).withColumn(name, F.col(name) + F.col(tmp_out).cast("long")).drop(tmp_out)
        hot = {(int(v) >> _DIGIT) + bisect_right(at, v): k for v, k in again.items()}
        top += len(at)
    return out.select(*[F.col(f"`{c}`") for c in df.columns if c != name], F.col(name).cast("int").alias(name))


def hash_bucket(hash_hex: Column, n_buckets: int) -> Column:
    """Equal-width bucket, 0 to n_buckets - 1, of a uniform md5 hex string (its first 32 bits)."""
    return F.shiftright(F.conv(F.substring(hash_hex, 1, 8), 16, 10).cast("long") * n_buckets, 32).cast("int")


SEGKEY = "_segkey"


def _with_segkey(df: DataFrame, segment: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Pack the segment into one struct column.

    Struct equality treats null fields as equal, so one plain equi-join key gives
    null-safe segment matching, and a window partitioned by (bucket, key) leaves the
    data hash-partitioned exactly as the later join needs it (no second shuffle).
    """
    if not segment:
        return df, []
    return df.withColumn(SEGKEY, F.struct(*[F.col(c) for c in segment])), [SEGKEY]


def running_sums(df: DataFrame, segment: Sequence[str], order: Sequence[str | Column],
                 sums: Mapping[str, Column], bucket: str = BUCKET,
                 exclusive: bool = False, totals: bool = False) -> DataFrame:
    """Running sums within ``segment`` ordered by ``order`` (must be unique in segment).

    ``df`` must carry a ``bucket`` column (see ``range_bucket`` / ``hash_bucket``)
    that never decreases along ``order`` inside a segment.  Inclusive by default;
    ``exclusive=True`` gives the sum over strictly earlier rows.  ``totals=True`` also
    adds ``<name>_total``, the whole-segment sum, taken from the same small table.
    """
    base, sk = _with_segkey(df, segment)
    frame_end = -1 if exclusive else Window.currentRow
    w_local = Window.partitionBy(bucket, *sk).orderBy(*_cols(order)).rowsBetween(
        Window.unboundedPreceding, frame_end)
    local = base.select("*", *[F.coalesce(F.sum(c).over(w_local), F.lit(0)).alias(f"_loc_{n}")
                               for n, c in sums.items()])
    # one row per (bucket, segment) present: bounded by buckets x segments-per-bucket
    per_bucket = base.groupBy(bucket, *sk).agg(*[F.sum(c).alias(f"_tot_{n}") for n, c in sums.items()])
    w_prev = Window.partitionBy(*sk).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    w_all = Window.partitionBy(*sk)
    offsets = per_bucket.select(
        bucket, *sk,
        *[F.coalesce(F.sum(f"_tot_{n}").over(w_prev), F.lit(0)).alias(f"_off_{n}") for n in sums],
        *[F.sum(f"_tot_{n}").over(w_all).alias(f"_all_{n}") for n in sums])
    joined = local.join(offsets, [bucket, *sk], "inner")
    return joined.select(
        *[F.col(c) for c in df.columns],
        *[(F.col(f"_off_{n}") + F.col(f"_loc_{n}")).alias(n) for n in sums],
        *([F.col(f"_all_{n}").alias(f"{n}_total") for n in sums] if totals else []))


def segmented_lag(df: DataFrame, segment: Sequence[str], order: Sequence[str | Column],
                  values: Mapping[str, str], n_buckets: int | None = None, written: bool = False) -> DataFrame:
    """``lag(value)`` over (partition by segment order by order), skew-safe.

    ``order`` must make rows unique within a segment.  Rows are bucketed along the
    order key; a window per (bucket, segment) gives the local lag, and the first row of
    each (bucket, segment) takes the last row of the same segment in its nearest earlier
    bucket (a table with one row per (bucket, segment), never one task per segment).
    Adds one column per ``values`` entry (out name -> source column).
    """
    from panelrisk.session import materialize
    ordc = _cols(order)
    # the input feeds the cut points, the local window and the last-row table: it is written
    # once so the upstream plan runs a single time (``written``: by the caller)
    staged = df if written else materialize(df, "lag-input")
    b, sk = _with_segkey(range_bucket(staged, ordc, n_buckets), segment)
    w = Window.partitionBy(BUCKET, *sk).orderBy(*ordc)
    local = b.select("*", F.row_number().over(w).alias("_rn"),
                     *[F.lag(src).over(w).alias(f"_lag_{out}") for out, src in values.items()])
    last = b.groupBy(BUCKET, *sk).agg(
        F.max_by(F.struct(*[F.col(src).alias(f"_v_{out}") for out, src in values.items()]),
                 F.struct(*ordc)).alias("_last"))
    carry = last.select(BUCKET, *sk, F.lag("_last").over(Window.partitionBy(*sk).orderBy(BUCKET)).alias("_carry"))
    joined = local.join(carry, [BUCKET, *sk], "left")
    outs = [F.when(F.col("_rn") == 1, F.col(f"_carry._v_{out}")).otherwise(F.col(f"_lag_{out}")).alias(out)
            for out in values]
    return joined.select(*[F.col(c) for c in df.columns], *outs)


def plain_lag(df: DataFrame, segment: Sequence[str], order: Sequence[str | Column],
              values: Mapping[str, str]) -> DataFrame:
    """Single-window lag; one task per segment.  Use when segments are known small."""
    w = Window.partitionBy(*segment).orderBy(*_cols(order))
    return df.select("*", *[F.lag(src).over(w).alias(out) for out, src in values.items()])


def hash_rank(df: DataFrame, segment: Sequence[str], hash_hex: Column, key: Sequence[str],
              name: str = "_rank", n_buckets: int | None = None, totals: bool = False) -> DataFrame:
    """1-based rank within segment ordered by (hash_hex, key), via equal-width hash buckets,
    by default as many as shuffle partitions.  ``hash_hex`` must not be null.

    Equivalent to ``row_number() over (partition by segment order by hash_hex, key)``
    but no segment is processed by one task.  ``totals`` adds ``<name>_total``, the
    segment size.
    """
    h = "_h"
    with_h = df.withColumn(h, hash_hex).withColumn(BUCKET, hash_bucket(F.col(h), n_buckets or default_buckets(df)))
    ranked = running_sums(with_h, segment, [F.col(h), *_cols(key)], {name: F.lit(1)}, totals=totals)
    return ranked.drop(h, BUCKET)
