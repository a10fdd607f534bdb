"""Histogram trees against plain Python: splits, growth, both settings, and stages."""

import itertools
import math

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from panelrisk.operators import model as ML
from panelrisk.operators import trees as T
from panelrisk.operators.tree_stages import TreeClassifier
from panelrisk.plans import queries as Q

SF = "/root/testdata/sf0.001"


def sample(n, seed=0, missing=0.2):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, 4)), 2)
    x[:, 3] = rng.integers(0, 3, n)
    y = ((x[:, 0] + x[:, 1] * x[:, 3] + 0.5 * rng.normal(size=n)) > 0.3).astype(float)
    x[rng.random((n, 4)) < missing] = np.nan
    return x, y


def edges_of(x):
    return [np.unique(x[~np.isnan(x[:, f]), f])[:-1] for f in range(x.shape[1])]


def best_by_definition(x, g, h, spec):
    """The gain of every threshold, feature and side for the missing values, one after another."""
    l2, out = spec.l2, []
    score = lambda rows: sum(g[r] for r in rows) ** 2 / (sum(h[r] for r in rows) + l2) if rows else 0.0
    everything = range(len(x))
    for f in range(x.shape[1]):
        gone = [r for r in everything if math.isnan(x[r, f])]
        for t in sorted({v for v in x[:, f] if not math.isnan(v)}):
            for missing_left in (False, True):
                left = [r for r in everything if x[r, f] <= t] + (gone if missing_left else [])
                right = [r for r in everything if r not in set(left)]
                if min(len(left), len(right)) >= max(1, spec.min_leaf) and min(sum(h[r] for r in left), sum(h[r] for r in right)) >= spec.min_hessian:
                    out.append((score(left) + score(right) - score(list(everything))) / 2)
    return max(out, default=-math.inf)


@pytest.mark.parametrize("spec", [T.Boosting(rounds=1, depth=1), T.leaf_wise(rounds=1, depth=1, min_leaf=5, weights=None)])
def test_first_split_has_the_best_gain(spec):
    for seed in range(5):
        x, y = sample(100, seed)
        edges = edges_of(x)
        weights = T._class_weights(spec, (y == 0).sum(), (y > 0).sum())
        w = np.where(y > 0, weights[1], weights[0])
        g, h = w * (0.5 - y), w * 0.25
        nodes = T._fit_here(spec, T._binned(x, edges), y, np.arange(100), weights, max(map(len, edges)) + 2)[0]
        assert nodes["gain"][0] == pytest.approx(best_by_definition(x, g, h, spec), rel=1e-5)
        for k in (int(nodes["left"][0]), int(nodes["right"][0])):
            rows = T._leaves(nodes, T._binned(x, edges), 0) == k
            assert nodes["value"][k] == pytest.approx(-spec.step * g[rows].sum() / (h[rows].sum() + spec.l2), rel=1e-5)
            assert nodes["count"][k] == rows.sum()


def best_first(bins, g, h, spec, width):
    """Leaf-wise growth as it is told: one leaf at a time, the one whose best split gains most."""
    def split_of(rows):
        sums = T.histograms(bins, rows, np.zeros(len(rows), int), [g[rows], h[rows], None], np.arange(bins.shape[1])[None], width)
        gain, f, miss, last, _, _ = (a[0] for a in T.best_splits(sums, spec))
        return gain, f, miss, last

    leaves = [(np.arange(len(bins)), 0, split_of(np.arange(len(bins))))]
    while len(leaves) < spec.leaves:
        able = [k for k, (rows, depth, s) in enumerate(leaves) if s[0] > spec.min_gain and depth < spec.depth and len(rows) >= 2 * spec.min_leaf]
        if not able:
            break
        rows, depth, (_, f, miss, last) = leaves.pop(max(able, key=lambda k: leaves[k][2][0]))
        b = bins[rows, f]
        left = np.where(b == 0, miss, b <= last)
        leaves += [(part, depth + 1, split_of(part)) for part in (rows[left], rows[~left])]
    return {frozenset(rows.tolist()) for rows, _, _ in leaves}


@pytest.mark.parametrize("leaves,depth", [(2, 6), (7, 6), (31, 6), (12, 30)])
def test_leaf_wise_growth(leaves, depth):
    spec = T.leaf_wise(rounds=1, leaves=leaves, depth=depth, min_leaf=3)
    x, y = sample(400, 3)
    edges = edges_of(x)
    bins, width = T._binned(x, edges), max(map(len, edges)) + 2
    g, h = T._gradients(np.zeros(400), y, np.ones(400))
    nodes = T._grow_here(spec, bins, width, np.arange(400), np.zeros(400, int), [g, h, None], np.array([0]))
    at = T._leaves(nodes, bins, 0)
    assert {frozenset(np.flatnonzero(at == k).tolist()) for k in set(at.tolist())} == best_first(bins, g, h, spec, width)


def test_minimum_split_and_small_leaves():
    x, y = sample(500, 4)
    edges = edges_of(x)
    spec = T.Forest(trees=20, min_split=5, depth=None)
    counts, inner = [], []
    for nodes in T._fit_here(spec, T._binned(x, edges), y, np.arange(500), (1.0, 1.0), max(map(len, edges)) + 2):
        inner += nodes["count"][nodes["feature"] >= 0].tolist()
        counts += nodes["count"][nodes["feature"] < 0].tolist()
    assert min(inner) == 5 and min(counts) == 1
    assert ML.random_forest("y").getMinSplit() == 5 and ML.random_forest("y").getMinInstancesPerNode() == 1


def test_bootstrap_draws():
    drawn = T._draws(np.arange(20_000), np.arange(20), 42)
    share = np.bincount(drawn.ravel(), minlength=8)[:4] / drawn.size
    assert np.allclose(share, [math.exp(-1), math.exp(-1), math.exp(-1) / 2, math.exp(-1) / 6], atol=0.004)
    assert abs(np.corrcoef(drawn[0], drawn[1])[0, 1]) < 0.03


TASKS = [T.Task(T.Forest(trees=6, depth=4)), T.Task(T.Boosting(rounds=4, depth=3), 0), T.Task(T.Boosting(rounds=4, depth=3), 1),
         T.Task(T.leaf_wise(rounds=3, depth=5, leaves=6, min_leaf=5), 1)]


def table(spark, n=300):
    x, y = sample(n, 5)
    rows = [(k, k % 3, float(v), [float(c) for c in r]) for k, (r, v) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "key long, fold int, y double, x array<double>").repartition(5, "key")


def test_both_settings_and_separate_fits_agree(spark, monkeypatch):
    rows, (x, _) = table(spark), sample(300, 5)
    here = T.fit_all(rows, TASKS)
    for chunk in (T.CELLS, 3000):  # in one portion a level, and in several
        monkeypatch.setattr(T, "CELLS", chunk)
        monkeypatch.setattr(T, "MARGIN_ROUNDS", 2)
        for a, b in zip(here, T.fit_all(rows, TASKS, in_task_rows=0)):
            assert np.array_equal(a.probability(x), b.probability(x))
    for a, t in zip(here, TASKS):
        alone = T.fit_all(rows.repartition(2), [t])[0]
        assert np.array_equal(a.probability(x), alone.probability(x)) and len(set(a.probability(x).tolist())) > 3


def test_scores_of_both_settings(spark):
    rows = table(spark)
    key = lambda r: (r["task"], r["fold"], r["y"], r["unseen"], r["probability"])
    a, b = (sorted(map(key, T.cross_scores(rows, TASKS, n).collect())) for n in (None, 0))
    assert a == b and len(a) == 300 * len(TASKS)
    assert sum(r[3] for r in a) == 300 and not any(r[3] for r in a if r[0] == 0)


def test_shares_on_the_jvm_grow_the_same_trees(spark):
    """Scores of the JVM's shares are those of trees grown in numpy: many nodes, odd labels, wide rows, missing values."""
    x, y = sample(400, 11, missing=0.35)
    x = np.hstack([x, np.random.default_rng(1).integers(0, 2, (400, 7)).astype(float)])  # codes of several features
    x[::9, 5] = np.nan
    rows = spark.createDataFrame([(k * 7919, k % 3, float(v), [float(c) for c in r]) for k, (r, v) in enumerate(zip(x, y))],
                                 "key long, fold int, y double, x array<double>")
    specs = [T.Forest(trees=5, depth=None, min_split=2), T.Forest(trees=3, depth=9, min_leaf=4, features="all", balanced=False),
             T.Forest(trees=4, depth=None, bins=200), T.Boosting(rounds=12, depth=6), T.Boosting(rounds=3, depth=None, weights=None),
             T.leaf_wise(rounds=8, min_leaf=3), T.leaf_wise(rounds=3, leaves=60, depth=None, min_leaf=1)]
    tasks = [T.Task(s, f) for s in specs for f in (1, None)]
    keys = lambda got: sorted((r["task"], r["fold"], r["y"], r["unseen"], r["probability"]) for r in got.collect())
    got, models = keys(T.cross_scores(rows, tasks)), T.fit_all(rows, tasks)
    for k, m in enumerate(models):
        assert sorted(m.probability(x).tolist()) == sorted(r[4] for r in got if r[0] == k), tasks[k]
    unseen = [r for r in got if r[3]]
    assert len(unseen) == 133 * len(specs)
    assert keys(T.cross_scores(rows, tasks, None, False)) == keys(T.cross_scores(rows, tasks[:2], 0, False)) + [r for r in unseen if r[0] > 1] == unseen
    doubled = rows.withColumn("y", 2 * F.col("y"))
    for k, m in enumerate(T.fit_all(doubled, tasks[6:8])):
        assert sorted(m.probability(x).tolist()) == sorted(r[4] for r in keys(T.cross_scores(doubled, tasks[6:8])) if r[0] == k)


def test_scores_of_14_million_rows_do_not_go_by_levels():
    known = T._Known(14_430_000, 11, [], [], {}, {})
    assert known.in_task(None, T.SHARE_BYTES) and not known.in_task(None)


def test_binnings_of_a_fold_are_read_off_one_sketch(spark):
    rows = table(spark)
    both = T._edges(rows, 4, [(None, 63), (None, 255), (1, 63), (1, 255)])
    for (out, bins), got in both.items():
        by_itself = rows.where("true" if out is None else "fold <> 1 and not isnan(x[0])").where("not isnan(x[0])").agg(
            F.percentile_approx(F.col("x")[0], [k / bins for k in range(1, bins + 1)], 20_000)).first()[0]
        assert np.array_equal(got[0], np.unique(by_itself)[:-1]) and len(got[0]) > 50
    for b in both:
        assert all(np.array_equal(p, q) for p, q in zip(both[b], T._edges(rows, 4, [b])[b]))


def test_a_level_is_one_job_for_all_models(spark):
    rows, sc = table(spark, 120), spark.sparkContext
    jobs = []
    for tasks in ([TASKS[1]], [T.Task(T.Boosting(rounds=4, depth=3, l2=l2), f) for l2, f in itertools.product((1.0, 2.0, 3.0), (0, 1))]):
        group = f"trees-{len(tasks)}"
        sc.setJobGroup(group, group)
        T.fit_all(rows, tasks, in_task_rows=0)
        jobs.append(len(sc.statusTracker().getJobIdsForGroup(group)))
    sc.setJobGroup("", "")
    assert jobs[1] <= jobs[0] + 6


def test_a_larger_panel_grows_in_shares(spark):
    """Beyond 100,000 rows a level of each tree was a job, and a node a group."""
    sc = spark.sparkContext
    x = [((F.col("id") * p) % 1009).cast("double") for p in (7, 13, 31, 57)]
    rows = spark.range(120_000).select(F.col("id").alias("key"), (F.col("id") % 3).cast("int").alias("fold"),
                                       (x[0] + x[1] > 1000).cast("double").alias("y"), F.array(*x).alias("x"))
    sc.setJobGroup("shares", "shares")
    scored = T.cross_scores(rows, TASKS).groupBy("task").agg(F.count("*"), F.avg((F.col("probability") > 0.5).cast("double") - F.col("y"))).collect()
    jobs = len(sc.statusTracker().getJobIdsForGroup("shares"))
    sc.setJobGroup("", "")
    assert jobs <= 12 and [r[1] for r in scored] == [120_000] * len(TASKS) and all(abs(r[2]) < 0.2 for r in scored)


def test_shares_hold_every_tree_once(spark):
    tasks = [T.Task(T.Forest(trees=n, depth=d), f) for n, d in ((500, None), (7, 3)) for f in (0, 1)] + [T.Task(T.Boosting(rounds=9))]
    shares = T._shares(spark, tasks)
    assert shares[0] == (4, 0, 9)  # what can't be shared out comes first
    for k, t in enumerate(tasks):
        assert [i for s, a, b in sorted(shares) if s == k for i in range(a, b)] == list(range(t.spec.trees if k < 4 else 9))


def test_task_size_is_bounded_by_bytes():
    known = lambda n, m: T._Known(n, m, [], [], {}, {})
    assert known(240_000, 12).in_task(None) and not known(14_400_000, 12).in_task(None) and not known(240_000, 1000).in_task(None)


def test_draws_and_packed_sums_by_definition():
    rng = np.random.default_rng(1)
    keys, trees = rng.integers(-2 ** 63, 2 ** 63, 300_000), np.array([0, 3])
    h = T._mix(T._mix(trees.astype(np.uint64)[:, None] + np.uint64(42 << 32)) ^ T._mix(keys.view(np.uint64))[None, :])
    chance = np.exp(-1.0) / np.cumprod([1, *range(1, 16)])
    drawn = T._draws(keys, trees, 42)
    assert np.array_equal(drawn, np.searchsorted(np.cumsum(chance), (h >> np.uint64(11)) / 2.0 ** 53, "right"))
    x, y = sample(2000, 2)
    bins = T._binned(x, edges_of(x))
    row, node, d = np.arange(2000), rng.integers(0, 5, 2000), drawn[0, :2000]
    features, width, unit = rng.integers(0, 4, (5, 2)), int(bins.max()) + 1, (3.0, 11.0)
    w = d * np.where(y > 0, unit[1], unit[0])
    three = T.histograms(bins, row, node, [w * y, w, None], features, width)
    assert np.array_equal(three, T.histograms(bins, row, node, [T._packed(d, y), None], features, width, unit))


def test_empty_one_class_and_all_missing(spark):
    rows = table(spark)
    for m in T.fit_all(rows.filter("false"), TASKS):
        assert len(m.probability(np.zeros((2, 4)))) == 2
    for m, t in zip(T.fit_all(rows.withColumn("y", F.lit(1.0)), TASKS), TASKS):
        p = m.probability(np.zeros((2, 4)))
        # without negatives, "positive" weighs the positives with zero
        assert (p == 0.5).all() if getattr(t.spec, "weights", None) == "positive" else (p > 0.5).all()
    nothing = rows.withColumn("x", F.array(*[F.lit(float("nan"))] * 4))
    for n in (None, 0):
        for m in T.fit_all(nothing, TASKS, n):
            assert len(set(m.probability(np.array([[0.0] * 4, [math.nan] * 4])).tolist())) == 1


def test_stage_saves_and_loads(spark, tmp_path):
    x, y = sample(200, 6)
    df = spark.createDataFrame([(float(a), None if math.isnan(b) else float(b), "uvw"[k % 3], int(v)) for k, ((a, b, _, _), v) in enumerate(zip(x, y))],
                               "a double, b double, c string, label int")
    for make in (ML.random_forest("label", num_trees=5), ML.boosted_trees("label", max_iter=5), ML.leaf_boosted_trees("label", max_iter=5)):
        model = ML.train(df, "label", ["a", "b"], ["c"], make)
        path = f"{tmp_path}/{make.uid}"
        model.write().overwrite().save(path)
        again = PipelineModel.load(path)
        first, second = ([tuple(r) for r in ML.with_probability(m.transform(df)).select("a", "b", ML.PROB1, "prediction").collect()] for m in (model, again))
        assert repr(first) == repr(second) and len(first) == 200
        assert ML.feature_importance(again, spark).first()["importance"] > 0
        stage = Pipeline(stages=[make])
        stage.write().overwrite().save(path + "-unfitted")
        back = Pipeline.load(path + "-unfitted").getStages()[0]
        assert isinstance(back, TreeClassifier) and back.spec == make.spec


def test_compare_and_tune_train_to_the_end(spark):
    """The registered queries with all their trees, rounds and draws."""
    board = Q.QUERIES["model_compare"](spark, SF).collect()
    assert [r["algorithm"] for r in board] == ["RandomForestClassifier", "LevelWiseBoosting", "LeafWiseBoosting"]
    assert all(r["error"] is None and r["f1_macro_mean"] > 0.5 and r["roc_auc_mean"] > 0.6 for r in board)
    assert [r["selected"] for r in board].count(True) == 1
    searched = Q.QUERIES["tune"](spark, SF).collect()
    assert len(searched) == 10 and min(r["f1_macro_mean"] for r in searched) > 0.5


def test_candidates_share_the_trees_that_differ_only_in_their_ends(spark):
    """A search of forests grew each candidate's trees anew; the scores are those of separate fits."""
    specs = [T.Forest(trees=9, depth=6, min_split=2), T.Forest(trees=4, depth=2, min_split=30), T.Forest(trees=6, depth=None, min_split=12),
             T.Forest(trees=9, depth=6, min_leaf=4), T.Boosting(rounds=2, depth=2)]
    tasks, rows = [T.Task(s, f) for s in specs for f in (0, 1, None)], table(spark)
    families = T._families(tasks, 4)
    wanted = sorted((k, i) for k, t in enumerate(tasks) for i in range(getattr(t.spec, "trees", 1)))
    assert sorted((k, i) for f in families for k in f.members for i in range(f.first, f.first + getattr(f.spec, "trees", 1))) == wanted
    assert sum(f.spec.trees for f in families if isinstance(f.spec, T.Forest)) == 3 * (9 + 9)
    scores = lambda got: sorted((r["task"], r["fold"], r["y"], r["unseen"], r["probability"]) for r in got.collect())
    together = scores(T.cross_scores(rows, tasks))
    for k in (0, 4, 8, 9):  # each candidate of forests by itself
        alone = scores(T.cross_scores(rows, [tasks[k]]))
        assert alone == [(0, *r[1:]) for r in together if r[0] == k]
    models = T.fit_all(rows, tasks)  # no tree in common
    x, _ = sample(300, 5)
    for k, m in enumerate(models):
        assert sorted(m.probability(x).tolist()) == sorted(r[4] for r in together if r[0] == k)


def test_leaves_of_own_rows_are_known_from_growth(monkeypatch):
    x, y = sample(700, 8)
    edges = edges_of(x)
    bins, width = T._binned(x, edges), max(map(len, edges)) + 2
    for part, cells in ((T.PART, T.CELLS), (64, 4000)):
        monkeypatch.setattr(T, "PART", part)
        monkeypatch.setattr(T, "CELLS", cells)
        for nodes, ends in T._grown(T.Forest(trees=5, depth=None, min_split=2), bins, y, np.arange(700), (1.0, 1.0), width, (0, 5)):
            for root, end in zip(np.flatnonzero(nodes["depth"] == 0), ends):
                own = np.flatnonzero(end >= 0)
                assert 300 < len(own) < 600 and np.array_equal(T._leaves(nodes, bins, int(root), rows=own), end[own])
    # by the table of children and without it
    nodes = T._fit_here(T.Boosting(rounds=1), bins, y, np.arange(700), (1.0, 1.0), width)[0]
    by_table = T._leaves(nodes, bins, 0)
    monkeypatch.setattr(T, "TABLE", 0)
    assert T._Steps(nodes).table() is None and np.array_equal(by_table, T._leaves(nodes, bins, 0))


@pytest.mark.parametrize("spec", [T.Forest(trees=7, depth=None), T.Boosting(rounds=7), T.leaf_wise(rounds=7, min_leaf=3)])
def test_probabilities_by_bins_are_those_by_thresholds(spec):
    x, y = sample(500, 9)
    edges = edges_of(x)
    tables = T._fit_here(spec, T._binned(x, edges), y, np.arange(500), (1.0, 1.0), max(map(len, edges)) + 2)
    model, probes = T.Ensemble.of(spec, tables, edges), np.vstack([x, sample(300, 10)[0] * 3, [[np.inf] * 4, [-np.inf] * 4]])
    assert np.array_equal(model.probability(probes), model._by_thresholds(probes))
    assert set(model.__getstate__()) == {f for f in T.Ensemble.__dataclass_fields__}
