"""Registry versions and counter states that appear whole or not at all."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from panelrisk.session import scratch_path
from panelrisk.sources import commits
from panelrisk.sources.files import PREDICTION_LOG_SCHEMA
from panelrisk.sources.registry import VersionExists, append_runs, latest, read_registry, run_record
from panelrisk.streaming import score_stream as S


def _run(spark, version, day, score=0.5):
    return run_record(spark, version, "forest", ["a"], {"f1": score}, {}, True, "", datetime(2024, 1, day))


def test_put_if_absent(spark):
    path = f"{scratch_path(spark, 'put')}/one"
    assert commits.put_if_absent(spark, path, "first") and not commits.put_if_absent(spark, path, "second")
    assert commits.read_text(spark, path) == "first"
    folder = path.rsplit("/", 1)[0]
    assert commits.names(spark, folder) == ["one"] and commits.names(spark, folder + "-none") == []


def test_the_loser_of_a_race_changes_nothing(spark, monkeypatch):
    """The other writer's file appears after the look and before the rename."""
    path = f"{scratch_path(spark, 'race')}/one"
    real, seen = commits._at, []

    def at(spark_, p):
        target, fs = real(spark_, p)

        class Late:
            def __getattr__(self, name):
                return getattr(fs, name)

            def exists(self, q):
                seen.append(q)
                return len(seen) > 1 and fs.exists(q)
        return target, Late()

    commits.put_if_absent(spark, path, "winner")
    monkeypatch.setattr(commits, "_at", at)
    assert not commits.put_if_absent(spark, path, "loser")
    monkeypatch.undo()
    assert commits.read_text(spark, path) == "winner"
    assert commits.names(spark, path.rsplit("/", 1)[0]) == ["one"]


def test_registry_versions_are_written_once(spark):
    path = scratch_path(spark, "reg")
    assert read_registry(spark, path).count() == 0
    append_runs(_run(spark, "v/1 ç", 1), path)
    with pytest.raises(VersionExists):
        append_runs(_run(spark, "v/1 ç", 2, 0.9).unionByName(_run(spark, "v2", 3)), path)
    rows = {r.version: r.cv_scores["f1"] for r in read_registry(spark, path).collect()}
    assert rows == {"v/1 ç": 0.5, "v2": 0.5}
    assert latest(read_registry(spark, path)).first().version == "v2"


def test_a_killed_append_is_invisible(spark, monkeypatch):
    path = scratch_path(spark, "reg-killed")
    append_runs(_run(spark, "v1", 1), path)

    def killed(*_):
        raise KeyboardInterrupt

    monkeypatch.setattr("panelrisk.sources.registry.put_if_absent", killed)
    with pytest.raises(KeyboardInterrupt):
        append_runs(_run(spark, "v2", 2), path)
    monkeypatch.undo()
    assert [r.version for r in read_registry(spark, path).collect()] == ["v1"]
    append_runs(_run(spark, "v2", 3), path)
    assert latest(read_registry(spark, path)).first().trained_at == datetime(2024, 1, 3)


def test_runs_need_versions_of_their_own(spark):
    path = scratch_path(spark, "reg-none")
    for runs in (_run(spark, None, 1), _run(spark, "v", 1).unionByName(_run(spark, "v", 2))):
        with pytest.raises(ValueError):
            append_runs(runs, path)
    assert read_registry(spark, path).count() == 0


def test_counters_are_whole_during_a_batch_and_after_a_crash(spark, monkeypatch):
    src, table, ck = (scratch_path(spark, n) for n in ("c-log", "c-table", "c-ck"))
    assert S.read_counters(spark, table).count() == 0
    log = spark.createDataFrame([("2024-01-01", str(i), i, 1, 0.9, "alto") for i in range(4)], PREDICTION_LOG_SCHEMA)
    total = lambda: S.read_counters(spark, table).agg(F.sum("n")).first()[0]
    log.write.json(src)
    S.counters_stream(spark, src, PREDICTION_LOG_SCHEMA, table, ck)
    assert total() == 4
    reader, put, seen = S.read_counters(spark, table), commits.put_if_absent, []

    def crash(*_):
        seen.append(total())  # the new state is written, not yet named
        raise RuntimeError("lost")

    log.write.mode("append").json(src)
    monkeypatch.setattr(S, "put_if_absent", crash)
    with pytest.raises(Exception):
        S.counters_stream(spark, src, PREDICTION_LOG_SCHEMA, table, ck)
    assert seen == [4] and total() == 4
    monkeypatch.setattr(S, "put_if_absent", put)
    S.counters_stream(spark, src, PREDICTION_LOG_SCHEMA, table, ck)  # the batch is run again
    assert total() == 8 and reader.agg(F.sum("n")).first()[0] == 4
    for i in range(2):
        log.write.mode("append").json(src)
        S.counters_stream(spark, src, PREDICTION_LOG_SCHEMA, table, ck)
    assert total() == 16
    assert len(commits.names(spark, f"{table}/states")) == len(commits.names(spark, f"{table}/current")) == S.KEPT_STATES
