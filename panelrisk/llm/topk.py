"""Exact top-k inner products by best-first search in M-trees.

Inner products become distances by one more dimension: with M the largest norm, the candidate
(x, sqrt(M^2 - |x|^2)) and the query (q, 0) are sqrt(|q|^2 + M^2 - 2 q.x) apart, so the largest products
are the nearest neighbours in a metric space.

Candidates are dealt to the nearest of ``PIVOTS`` pivots (a bounded sample, for locality only) and, within a
pivot, by the hash of their id into trees of about ``TREE_ROWS`` rows, so that one very common vector is
spread over many trees.  Each tree is an M-tree: pages of ``PAGE`` rows with a routing object, a covering
radius and the rows' distances to it, under nodes built in the same way.  A query takes the pages in the
order of their lower bounds and ends when the next bound exceeds its k-th distance; stored parent
distances rule out entries by the triangle inequality before their own distance is computed.

Queries go through their home tree first.  Its k-th distance is the bound with which they enter all
other trees, in blocks of about ``BLOCK`` queries, so that a task holds one tree and one block.  Scores are
exact integers, the distances only prune (with a margin for rounding).
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelrisk.llm.common import col, shuffle_partitions, table, written

K = 20
SCALE = 64
PIVOTS = 32
TREE_ROWS = 4_096
PAGE = 256
FANOUT = 16
BLOCK = 4_096
#: Where components end, so that they are longs.
EDGE = 2.0 ** 62
#: Rounding of distances, beside which every product is exact.
SLACK = 1e-6


class MTree:
    """A bulk-loaded M-tree of integer vectors under the metric of the augmented space."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, top: float, page: int = PAGE, fanout: int = FANOUT):
        """``top``: M squared, at least the largest squared norm."""
        self.ids, self.whole, self.raw, self.top = ids, vectors, vectors.astype(np.float64), top
        self.most = float(np.abs(self.raw).max(initial=0)) * vectors.shape[1]
        norms = np.einsum("ij,ij->i", self.raw, self.raw)
        points = np.hstack([self.raw, np.sqrt(np.maximum(top - norms, 0))[:, None]])
        self.order = np.arange(len(ids))
        self.levels: list[dict] = []  # from the pages upwards
        groups = self._pages(points, page)
        centres, radii, members, away = self._level(points, np.zeros(len(points)), groups)
        self.levels.append({"centre": centres, "radius": radii, "members": members, "away": away})
        while len(centres) > fanout:
            groups = self._pages(centres, fanout)
            centres, radii, members, away = self._level(centres, radii, groups)
            self.levels.append({"centre": centres, "radius": radii, "members": members, "away": away})

    @staticmethod
    def _pages(points: np.ndarray, size: int) -> list[np.ndarray]:
        """Groups of at most ``size`` near points: halved along the line between two far ones."""
        out, todo = [], [np.arange(len(points))]
        while todo:
            rows = todo.pop()
            if len(rows) <= size:
                out.append(rows)
                continue
            p = points[rows]
            a = p[np.argmax(((p - p[0]) ** 2).sum(1))]
            b = p[np.argmax(((p - a) ** 2).sum(1))]
            order = np.argsort(p @ (b - a), kind="stable")
            half = max(size, (len(rows) // 2 + size - 1) // size * size) if len(rows) > size else len(rows)
            half = min(half, len(rows) - 1)
            todo += [rows[order[half:]], rows[order[:half]]]
        return out

    @staticmethod
    def _level(points, below, groups):
        """Routing objects, covering radii, members and their distances to the object."""
        centres, radii, away = [], [], []
        for g in groups:
            p = points[g]
            c = p[np.argmin(((p - p.mean(0)) ** 2).sum(1))]
            d = np.sqrt(((p - c) ** 2).sum(1))
            centres.append(c)
            away.append(d)
            radii.append(float((d + below[g]).max()))
        return np.array(centres), np.array(radii), groups, away

    def search(self, query: np.ndarray, own, k: int, bound: float = np.inf, least: int | None = None) -> list[tuple[int, int]]:
        """Up to ``k`` (score, id) of other ids, best first, ties to the smaller id.

        Entries farther than ``bound`` may be left out, those with scores below ``least`` are.
        """
        q = query.astype(np.float64)
        qq = float(q @ q)
        aug = np.append(q, 0.0)
        best: list[tuple[int, int]] = []  # a heap, worst first: (score, -id)
        heap: list[tuple[float, int, int, float]] = []  # (lower bound, level, node, distance to its object)
        slack = SLACK * (1 + np.sqrt(qq + self.top))
        exact = self.most * float(np.abs(q).max(initial=0)) < 2 ** 53

        def push(level: int, nodes: np.ndarray) -> None:
            here = self.levels[level]
            d = np.sqrt(((here["centre"][nodes] - aug) ** 2).sum(1))
            for x, n in zip(d.tolist(), nodes.tolist()):
                low = max(0.0, x - here["radius"][n] - slack)
                if low <= bound:
                    heapq.heappush(heap, (low, level, n, x))

        push(len(self.levels) - 1, np.arange(len(self.levels[-1]["centre"])))
        while heap and heap[0][0] <= bound:
            _, level, node, d = heapq.heappop(heap)
            here = self.levels[level]
            members, away = here["members"][node], here["away"][node]
            if level:
                reach = self.levels[level - 1]["radius"][members]
                near = members[np.abs(d - away) - reach <= bound + slack]
                if len(near):
                    push(level - 1, near)
                continue
            near = members[np.abs(d - away) <= bound + slack]  # the triangle inequality, nothing computed
            if exact:
                scores = self.raw[near] @ q
            else:  # whole numbers of any size, held at the ends of a long
                scores = np.clip(self.whole[near].astype(object) @ query.astype(object), 1 - (1 << 63), (1 << 63) - 1).astype(np.int64)
            # of a page, only what can still be among the k best goes to the heap
            low = best[0][0] if len(best) == k else least
            good = self.ids[near] != own
            if low is not None:
                good &= scores >= low
            scores, near = scores[good], near[good]
            if len(scores) > k:
                good = scores >= np.partition(scores, -k)[-k]
                scores, near = scores[good], near[good]
            for s, i in zip(scores.tolist(), self.ids[near].tolist()):
                item = (int(s), -i)
                if len(best) < k:
                    heapq.heappush(best, item)
                elif item > best[0]:
                    heapq.heapreplace(best, item)
            if len(best) == k:
                bound = min(bound, float(np.sqrt(max(0.0, qq + self.top - 2 * best[0][0]))) + slack)
        return [(s, -i) for s, i in sorted(best, reverse=True)]

    def kth_distance(self, query: np.ndarray, score: int) -> float:
        """The distance beyond which no score reaches ``score``."""
        q = query.astype(np.float64)
        qq = float(q @ q)
        return float(np.sqrt(max(0.0, qq + self.top - 2 * score)) + SLACK * (1 + np.sqrt(qq + self.top)))


def _vector(vectors: DataFrame, vec_col: str, scale: int):
    """Integer components, null unless all are finite numbers; an empty vector is null too."""
    v = F.transform(col(vec_col), lambda x: x.cast("double"))
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & (F.size(v) > 0)
    held = lambda x: F.least(F.greatest(x * scale, F.lit(-EDGE)), F.lit(EDGE))
    return F.when(good, F.transform(v, lambda x: F.floor(held(x)).cast("long")))


def _matrix(raw: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(raw), "<i8").reshape(len(raw), -1)


def top_k(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", is_query=None, k: int = K,
          scale: int = SCALE, pivots: int = PIVOTS, tree_rows: int = TREE_ROWS, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, id_col, score): for each query row its ``k`` largest products with other rows.

    ``is_query`` is a boolean column; by default ids divisible by 20.  Components become
    floor(scale * x), held at +-2**62; vectors that are null, empty, or hold null or infinite or NaN components
    take no part, nor do null ids; all others must have one length, or a ValueError says so before the search.
    Scores are exact, and those beyond +-(2**63 - 1) are held there (ties to the smaller id).  Rows of the query's own id are no
    candidates of it.  Ties go to the smaller id.  A repeated row is a candidate as often as it is there, and
    a query once for each id and vector.  Fewer than k candidates give fewer rows; an empty table gives an
    empty table.  Other columns are ignored.
    """
    spark = vectors.sparkSession
    if is_query is None:
        is_query = F.pmod(col(id_col), F.lit(20)) == 0

    def packed(stream):
        for b in stream:
            raw = [np.array(x, "<i8").tobytes() for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(raw, pa.binary()), b.column(2), b.column(3)],
                                             ["id", "v", "norm", "is_query"])

    base = (vectors.select(col(id_col).cast("long").alias("id"), _vector(vectors, vec_col, scale).alias("v"),
                           F.coalesce(is_query, F.lit(False)).alias("is_query")).filter("id is not null and v is not null")
            .withColumn("norm", F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x))
            .select("id", "v", "norm", "is_query"))
    rows = written(base.mapInArrow(packed, "id long, v binary, norm double, is_query boolean"), "vectors")
    size = rows.agg(F.max("norm").alias("top"), F.count(F.lit(1)).alias("n"),
                    F.count_if("is_query").alias("asked"), F.min(F.octet_length("v")).alias("short"),
                    F.max(F.octet_length("v")).alias("long")).first()
    shape = f"query_id long, rank int, `{id_col}` long, score long"
    if not size["n"]:
        return spark.createDataFrame([], shape)
    if size["short"] != size["long"]:
        raise ValueError(f"vectors of {size['short'] // 8} to {size['long'] // 8} components can't be searched together")
    top = float(size["top"])
    chosen = [r["v"] for r in rows.select("v").distinct().orderBy(F.xxhash64("v"), "v").limit(pivots).collect()]

    @F.arrow_udf("int")
    def home(v: pa.Array) -> pa.Array:
        x, p = _matrix(v.to_pylist()).astype(np.float64), _matrix(chosen).astype(np.float64)
        d = (p * p).sum(1)[None, :] - 2 * x @ p.T
        return pa.array(d.argmin(1).astype(np.int32))

    dealt = written(rows.withColumn("pivot", home("v")), "dealt")
    counts = {r["pivot"]: r["n"] for r in dealt.groupBy("pivot").agg(F.count(F.lit(1)).alias("n")).collect()}
    first, parts, trees = {}, {}, 0  # pivots and numbers only
    for p in sorted(counts):
        first[p], parts[p] = trees, -(-counts[p] // tree_rows)
        trees += parts[p]
    look = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])[F.col("pivot")]
    placed = dealt.withColumn("tree", (look(first) + F.pmod(F.xxhash64("id", "v"), look(parts))).cast("int"))

    def answers(tree: MTree, ids, matrix, bounds, lows):
        """Per query the tree's k best that reach the k-th score at home."""
        out = [[], [], [], []]
        for own, q, bound, low in zip(ids, matrix, bounds, lows):
            found = tree.search(q, own, k, bound, low)
            out[0] += [own] * len(found)
            out[1] += [q.tobytes()] * len(found)
            out[2] += [i for _, i in found]
            out[3] += [s for s, _ in found]
        return out

    def at_home(part: pa.Table) -> pa.Table:
        """Builds the tree, and searches it for the queries that live in it."""
        ids = part.column("id").to_numpy()
        matrix = _matrix(part.column("v").to_pylist())
        tree = MTree(ids, matrix, top)
        asks = np.flatnonzero(part.column("is_query").to_numpy(zero_copy_only=False)).tolist()
        asks = list({(int(ids[a]), matrix[a].tobytes()): a for a in asks}.values())  # repeated rows ask once
        out = answers(tree, ids[asks].tolist(), matrix[asks], [np.inf] * len(asks), [None] * len(asks))
        return pa.table(dict(zip(("query_id", "q", "id", "score"),
                                 (pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.binary(), pa.int64(), pa.int64()))))))

    found_schema = "query_id long, q binary, id long, score long"
    local = written(placed.groupBy("tree").applyInArrow(at_home, found_schema), "home")
    asked = (dealt.filter("is_query").select(F.col("id").alias("query_id"), F.col("v").alias("q"), "norm",
                                             F.pmod(F.xxhash64("id", "v"), look(parts)).alias("m"), "pivot").distinct())
    asked = asked.withColumn("tree", (look(first) + F.col("m")).cast("int"))
    worst = local.groupBy("query_id", "q").agg(F.min("score").alias("low"), F.count(F.lit(1)).alias("found"))
    bounds = (asked.join(worst, ["query_id", "q"], "left")
              .select("query_id", "q", "tree", F.when(F.col("found") >= k, F.col("low")).alias("low")))
    n_blocks = max(1, -(-size["asked"] // block))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asks = (bounds.withColumn("block", F.pmod(F.xxhash64(F.lit("block"), F.col("query_id"), F.col("q")), F.lit(n_blocks)).cast("int"))
            .select("query_id", "q", "low", "block", F.col("tree").alias("home"), every(trees).alias("tree"))
            .filter("tree <> home"))
    held = placed.select("tree", every(n_blocks).alias("block"), "id", "v")

    def elsewhere(part: pa.Table, asks: pa.Table) -> pa.Table:
        out = [[], [], [], []]
        if part.num_rows and asks.num_rows:
            tree = MTree(part.column("id").to_numpy(), _matrix(part.column("v").to_pylist()), top)
            matrix = _matrix(asks.column("q").to_pylist())
            limit = [np.inf if low is None else tree.kth_distance(q, low)
                     for low, q in zip(asks.column("low").to_pylist(), matrix)]
            out = answers(tree, asks.column("query_id").to_pylist(), matrix, limit, asks.column("low").to_pylist())
        return pa.table(dict(zip(("query_id", "q", "id", "score"),
                                 (pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.binary(), pa.int64(), pa.int64()))))))

    far = held.groupBy("tree", "block").cogroup(asks.groupBy("tree", "block")).applyInArrow(elsewhere, found_schema)
    better = local.unionByName(far)

    def merged(part: pa.Table) -> pa.Table:
        """The k best of one query's answers, at most k from each tree."""
        s, i = part.column("score").to_numpy(), part.column("id").to_numpy()
        keep = np.lexsort((i, -s))[:k]
        n = len(keep)
        return pa.table({"query_id": pa.array([part.column("query_id")[0].as_py()] * n, pa.int64()),
                         "rank": pa.array(range(1, n + 1), pa.int32()), id_col: pa.array(i[keep]),
                         "score": pa.array(s[keep])})

    return better.repartition(shuffle_partitions(spark), "query_id", "q").groupBy("query_id", "q").applyInArrow(merged, shape)


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


ORACLE = {"op9_topk": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND len(embedding) > 0
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
      FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""}
QUERIES = {"op9_topk": op9_topk}
