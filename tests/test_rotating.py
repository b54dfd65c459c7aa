"""Rotating logs: cut off and replayed at every step."""

import os

import pytest

from lodestrata.sources import rotating
from lodestrata.sources.rotating import RotatingLog

SCHEMA = "ts long, name string"
DAY = 86_400_000


def _batch(spark, k, n=40, day=0):
    return spark.createDataFrame([(day * DAY + i, f"b{k}-{i}-é") for i in range(n)], SCHEMA)


def _names(log, spark):
    return sorted(r.name for r in log.read(spark, SCHEMA).collect())


def _files(path):
    return [os.path.join(d, f) for d, _, fs in os.walk(path) for f in fs if f.startswith("part-")]


def test_rotation_keeps_files_below_the_limit(spark, tmp_path):
    log = RotatingLog(str(tmp_path), "ev", 3000)
    assert log.read(spark, SCHEMA).count() == 0
    want = []
    for k in range(6):
        log(_batch(spark, k), k)
        want += [f"b{k}-{i}-é" for i in range(40)]
        assert _names(log, spark) == sorted(want)
    archives = [n for n in os.listdir(tmp_path) if n.startswith("ev.") and n[3].isdigit()]
    assert archives and all(os.path.getsize(f) <= 3000 for f in _files(tmp_path))
    log(spark.createDataFrame([], SCHEMA), 6)
    assert _names(log, spark) == sorted(want)
    long = RotatingLog(str(tmp_path / "long"), "ev", 100)
    long(spark.createDataFrame([(1, "x" * 500), (2, "y"), (3, "z")], SCHEMA), 0)
    assert sorted(len(n) for n in _names(long, spark)) == [1, 1, 500]


@pytest.mark.parametrize("step", ["write", "rotating", "rename", "sweep", "prune"])
def test_a_batch_may_come_again(spark, tmp_path, monkeypatch, step):
    log = RotatingLog(str(tmp_path), "ev", 3000)
    for k in range(2):
        log(_batch(spark, k), k)
    broken = {"on": True}

    def breaks(f, before=True):
        def g(*a, **b):
            if not before:
                f(*a, **b)
            if broken["on"]:
                raise InterruptedError
            return f(*a, **b) if before else None
        return g

    where = {"write": (RotatingLog, "_live", True), "rotating": (rotating._Folder, "rename", True), "rename": (rotating._Folder, "rename", False), "sweep": (RotatingLog, "_sweep", True), "prune": (RotatingLog, "prune", True)}[step]
    monkeypatch.setattr(where[0], where[1], breaks(getattr(where[0], where[1]), where[2]))
    with pytest.raises(InterruptedError):
        log(_batch(spark, 2), 2)
    broken["on"] = False
    monkeypatch.undo()
    log(_batch(spark, 2), 2)
    log(_batch(spark, 2), 2)
    log(_batch(spark, 3), 3)
    assert _names(log, spark) == sorted(f"b{k}-{i}-é" for k in range(4) for i in range(40))


def test_archives_age_by_their_names(spark, tmp_path):
    log = RotatingLog(str(tmp_path), "hook-errors", 1000, 30 * DAY)
    for k, day in enumerate([0, 10, 35, 36]):
        log(_batch(spark, k, day=day), k)
    assert sorted({n.split("-")[0] for n in _names(log, spark)}) == ["b1", "b2", "b3"]
    log(_batch(spark, 0), 0)  # a batch of an archive that is gone does not come back
    assert sorted({n.split("-")[0] for n in _names(log, spark)}) == ["b1", "b2", "b3"]
    log.prune(spark, now_ms=66 * DAY)
    assert sorted({n.split("-")[0] for n in _names(log, spark)}) == ["b3"]
    assert rotating.error_log("x").rotate_bytes == 5 << 20


def test_stream(spark, tmp_path):
    log = RotatingLog(str(tmp_path / "log"), "ev", 2000)
    for k in range(3):
        _batch(spark, k).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        src = spark.readStream.schema(SCHEMA).json(str(tmp_path / "in"))
        src.writeStream.foreachBatch(log).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert _names(log, spark) == sorted(f"b{k}-{i}-é" for k in range(3) for i in range(40))
