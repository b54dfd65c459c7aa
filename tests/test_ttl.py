"""State with a time to live: streams restarted from their checkpoints against plain versions."""

import datetime as dt
import random

from pyspark.sql import Row
from pyspark.sql import functions as F

from lodestrata.streaming import ttl

START = dt.datetime(2025, 1, 1)
EDITS = "project string, path string, at timestamp, is_mark boolean, event_id long"


def _at(minutes):
    return START + dt.timedelta(minutes=minutes)


def _plain(rows, ttl_ms):
    out, last, seen = {}, {}, set()
    for project, path, at, is_mark, i in sorted(rows, key=lambda r: (r[2], not r[3], r[4])):
        k = (project, path)
        if is_mark:
            last[k] = at
        elif (k, i) not in seen:
            seen.add((k, i))
            out[i] = k in last and (at - last[k]).total_seconds() * 1000 < ttl_ms
    return out


def test_edits_across_restarts(spark, tmp_path):
    rng = random.Random(4)
    rows = [(f"p{rng.randint(0, 1)}", f"f{rng.randint(0, 4)}", _at(rng.randint(0, 400)), rng.random() < 0.5, i) for i in range(160)]
    rows += [("p0", "f0", _at(100), True, 900), ("p0", "f0", _at(100), False, 901), ("p0", "f0", _at(129.99), False, 902), ("p0", "f9", _at(50), True, 903), ("p0", "f9", _at(80), False, 904)]
    rows += [r for r in rows if r[4] % 10 == 0]  # repeated events
    d = spark.createDataFrame(rows, EDITS)
    got = ttl.by_slices(d, "at", 3, str(tmp_path), lambda s: ttl.edits_prepared(s), partitions=2).collect()
    assert len(got) == len({r.event_id for r in got})
    assert {r.event_id: r.prepared for r in got} == _plain(rows, ttl.TTL_MS)


def test_late_events_and_initial_marks(spark, tmp_path):
    def slice_(rows):
        spark.createDataFrame(rows, EDITS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        src = spark.readStream.schema(EDITS).parquet(str(tmp_path / "in"))
        marks = spark.createDataFrame([("p", "old", int(_at(0).timestamp() * 1000)), ("p", "old", 5)], "project string, path string, ts long")
        ttl.run_to_end(ttl.edits_prepared(src, marks=marks), str(tmp_path / "out"), str(tmp_path / "cp"), 2)

    slice_([("p", "old", _at(20), False, 1), ("p", "old", _at(31), False, 2), ("p", "x", _at(60), True, 3)])
    slice_([("p", "x", _at(61), False, 4), ("p", "x", _at(45), False, 5), ("p", "old", _at(55), False, 6)])
    slice_([("p", "x", _at(89), False, 7), ("p", "x", _at(61), False, 4)])
    got = {r.event_id: r.prepared for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    # 5 is older than the watermark and dropped; 4 came twice and is answered once
    assert got == {1: True, 2: False, 4: True, 6: False, 7: True}
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5
    assert spark.conf.get("spark.sql.shuffle.partitions") == "4"


def test_registry(spark, tmp_path):
    loads = [("s", "a", _at(0), "full", None, 10, 1), ("s", "a", _at(1), "symbol", "f", 3, 2), ("s", "a", _at(2), "range", "x", 4, 3), ("s", "a", _at(3), "range", "y", 5, 4), ("s", "a", _at(4), "symbol", "f", 7, 5), ("s", "b", _at(5), "full", None, 1, 6), ("t", "a", _at(6), "full", None, 2, 7), ("s", "a", _at(4), "symbol", "f", 7, 5)]
    d = spark.createDataFrame(loads, "session_id string, path string, at timestamp, kind string, symbol string, tokens long, event_id long")
    got = {r.event_id: (r.n_slots, r.token_estimate) for r in ttl.by_slices(d, "at", 2, str(tmp_path / "x"), ttl.registry_log, 2).collect()}
    assert got == {1: (1, 10), 2: (2, 13), 3: (3, 17), 4: (3, 18), 5: (3, 22), 6: (1, 1), 7: (1, 2)}
    assert ttl.by_slices(d.limit(0), "at", 1, str(tmp_path / "none"), ttl.registry_log, 2).count() == 0


def test_state_ends(spark, tmp_path):
    loads = [("s", "a", _at(0), "full", None, 10, 1), ("s", "b", _at(60), "full", None, 1, 2), ("s", "b", _at(90), "full", None, 1, 3), ("s", "a", _at(100), "symbol", "f", 3, 4)]
    d = spark.createDataFrame(loads, "session_id string, path string, at timestamp, kind string, symbol string, tokens long, event_id long")
    got = {r.event_id: (r.n_slots, r.token_estimate) for r in ttl.by_slices(d, "at", 4, str(tmp_path), lambda s: ttl.registry_log(s, 30 * 60 * 1000), 2).collect()}
    assert got[4] == (1, 3)  # the load of an hour and a half before is gone
    assert spark.range(1).select(F.lit(1)).count() == 1


def test_a_switch_of_branches_empties_what_differs(spark, tmp_path):
    heads = spark.createDataFrame([("p", _at(0), "main"), ("p", _at(5), "main"), ("p", _at(10), "work"), ("q", _at(11), "main"), ("p", _at(20), "main")], "project string, at timestamp, head string")
    switches = ttl.branch_switches(heads)
    assert sorted((r.project, r.was, r.now) for r in switches.collect()) == [("p", "main", "work"), ("p", "work", "main")]
    changed = spark.createDataFrame([("p", "main", "work", "a")], "project string, was string, now string, path string")
    gone = ttl.invalidations(switches, changed, spark.createDataFrame([("p", "s", "a"), ("p", "s", "a"), ("p", "s", "b"), ("q", "t", "a")], "project string, session_id string, path string"))
    loads = [("s", "a", _at(1), "full", None, 10, 1), ("s", "b", _at(2), "full", None, 5, 2), ("t", "a", _at(3), "full", None, 7, 3), ("s", "a", _at(11), "symbol", "f", 3, 4), ("s", "b", _at(12), "symbol", "f", 2, 5), ("t", "a", _at(13), "symbol", "f", 2, 6), ("s", "a", _at(21), "full", None, 1, 7)]
    d = spark.createDataFrame(loads, "session_id string, path string, at timestamp, kind string, symbol string, tokens long, event_id long").unionByName(gone)
    for cuts in (1, 3):
        got = {r.event_id: (r.n_slots, r.token_estimate) for r in ttl.by_slices(d, "at", cuts, str(tmp_path / str(cuts)), ttl.registry_log, 2).collect()}
        assert got == {1: (1, 10), 2: (1, 5), 3: (1, 7), 4: (1, 3), 5: (2, 7), 6: (2, 9), 7: (2, 4)}


class _Store:
    """A store that counts what it is asked."""

    def __init__(self):
        self.calls, self.value, self.rows, self.timers = 0, None, [], []

    def _count(self):
        self.calls += 1
        return self

    def getValueState(self, *_):
        return self

    def getListState(self, *_):
        return self

    def update(self, v):
        self._count().value = v

    def appendList(self, new):
        self._count().rows += new

    def registerTimer(self, t):
        self._count().timers.append(t)

    def get(self):
        self._count()
        return self.value


def test_a_batch_asks_the_store_few_times():
    rows = [Row(session_id="s", path="a", at=_at(i), kind="symbol", symbol=f"y{i % 5}", tokens=i, event_id=i) for i in range(200)]
    store, p = _Store(), ttl.Registry()
    p.init(store)
    assert [(r.n_slots, r.token_estimate) for r in p.handleInputRows(("s", "a"), iter(rows), None)][-1] == (5, 195 + 196 + 197 + 198 + 199)
    assert store.calls <= 3
    store, p = _Store(), ttl.EditPrep()
    p.init(store)
    edits = [Row(project="p", path="f", at=_at(i), is_mark=i == 0, event_id=i) for i in range(200)]
    assert sum(r.prepared for r in p.handleInputRows(("p", "f"), iter(edits), None)) == 29
    assert store.calls <= 4


class _Clock:
    def __init__(self, now):
        self.now = now

    def getCurrentWatermarkInMs(self):
        return self.now

    def getExpiryTimeInMs(self):
        return self.now


def test_paths_of_a_bucket_share_a_state():
    """The store is asked once for many sessions' paths; each holds its own slots, and ends by itself."""
    rows = [Row(session_id=f"s{i % 50}", path=p, at=_at(i), kind="symbol", symbol=f"y{i // 50}", tokens=1, event_id=i) for i in range(100) for p in ("a", "b")]
    ms = [ttl._ms(_at(i)) for i in range(101)]
    store, p = _Store(), ttl.Registry(60_000)
    store.clear = lambda: store.update(None)
    p.init(store)
    assert [(r.n_slots, r.token_estimate) for r in p.handleInputRows((0,), iter(rows), None)] == [(1 + i // 100,) * 2 for i in range(200)]
    assert store.calls <= 3 and store.timers == [ms[50] + 60_000]
    # all but the last session's paths are over, of which "a" is loaded again
    frame = ttl.pd.DataFrame({"at": [ms[100] * 1000], "event_id": [200], "session_id": ["s49"], "path": ["a"], "kind": ["symbol"], "symbol": ["z"], "tokens": [5]})
    p.__class__ = ttl.RegistryFrames
    (out,) = p.handleInputRows((0,), iter([frame]), _Clock(ms[99]))
    assert out.to_numpy().tolist() == [[200, 3, 7]]
    assert list(p.handleExpiredTimer((0,), _Clock(ms[100] + 1), _Clock(ms[100] + 1))) == []
    assert list(p._held(None)) == [("s49", "a")]
    assert list(p.handleExpiredTimer((0,), _Clock(ms[100] + 60_001), _Clock(ms[100] + 60_001))) == [] and store.value is None
