"""Keyed state with a time to live, on streams: prepared edits and the registry of what was loaded.

Time is event time. A key's events are taken batch by batch, inside a batch by time, marks before edits of the same
time; what is older than the watermark is dropped. An event id is answered once while its key lives. A timer
at the end of a key's life clears its state once the watermark has passed, so state holds live keys alone.
"""

from __future__ import annotations

import datetime as dt
import json
import sys
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window

from lodestrata.plans.scratch import saved
from lodestrata.runtime import ship

#: Fixed value: how long a mark prepares a file's edits.
TTL_MS = 30 * 60 * 1000
#: How long a session's registry of a path lives without a load, and how late an event may come.
REGISTRY_MS, LATE = 24 * 3600 * 1000, "10 minutes"
#: Buckets of sessions' paths, and loads of one where their number is known before.
BUCKETS, PER_BUCKET = 1 << 12, 1 << 10
#: The kind of an event that says that a path's content is another now.
CHANGED = "changed"
#: Where state is kept: the operator needs a store with several states for each key.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


# the process that Spark starts beside the driver for streams has no shipped files: processors travel whole
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _ms(t: dt.datetime) -> int:
    return round(t.timestamp() * 1000)


class _Living(StatefulProcessor):
    """A key's life ends so long after its newest event. Each call to the store is a message to the JVM: a batch reads and writes a
    key's state once, and a timer that rings too early is set anew then, not at each batch."""

    def __init__(self, ttl_ms: int):
        self.ttl = ttl_ms

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held = self.state.get()
        if held is not None:
            until = held[0] + self.ttl
            if until > expiredTimerInfo.getExpiryTimeInMs():
                self.handle.registerTimer(until)
            else:
                self._clear()
        return iter(())

    def close(self) -> None:
        pass


class EditPrep(_Living):
    """For each edit whether its file was marked less than the time to live before."""

    def __init__(self, ttl_ms: int = TTL_MS):
        super().__init__(ttl_ms)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "newest long, mark long")
        self.answered = handle.getListState("answered", "event_id long")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self.state.update((initialState.ts, initialState.ts))
        self.handle.registerTimer(initialState.ts + self.ttl)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held = self.state.get()
        newest, last = held or (None, None)
        seen = {e[0] for e in self.answered.get()} if held else set()
        new = []
        for r in sorted(rows, key=lambda r: (r.at, not r.is_mark, r.event_id)):
            ts = _ms(r.at)
            newest = ts if newest is None else max(newest, ts)
            if r.is_mark:
                last = ts if last is None else max(last, ts)
            elif r.event_id not in seen:
                seen.add(r.event_id)
                new.append((r.event_id,))
                yield Row(event_id=r.event_id, prepared=last is not None and 0 <= ts - last < self.ttl)
        if new:
            self.answered.appendList(new)
        if newest is not None:
            self.state.update((newest, last))
            if held is None:
                self.handle.registerTimer(newest + self.ttl)

    def _clear(self) -> None:
        self.state.clear()
        self.answered.clear()


class Registry(_Living):
    """What each load makes of a session's path: slots held and their tokens. A load replaces that of its kind and symbol; ranges share one slot.

    An event of the kind CHANGED, which a switch of branches brings for each file that differs, empties the path's slots. Sessions' paths are
    many and their events few, so those of a bucket share one state: each path lives and ends by itself, but the store is asked once for all of them.
    """

    def __init__(self, ttl_ms: int = REGISTRY_MS):
        super().__init__(ttl_ms)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "paths string")  # JSON: [session, path, newest, [[slot, tokens, at, event id], ...]] of each

    def _held(self, timerValues) -> dict | None:
        """(session, path) -> (newest, slots) of those that live; what ends before the watermark is gone, whether its timer has rung or not."""
        held = self.state.get()
        if held is None:
            return None
        now = 0 if timerValues is None else timerValues.getCurrentWatermarkInMs()
        return {(s, p): (newest, {v[0]: tuple(v[1:]) for v in slots}) for s, p, newest, slots in json.loads(held[0]) if newest + self.ttl >= now}

    def _hold(self, paths: dict) -> None:
        self.state.update((json.dumps([(*k, newest, [(s, *v) for s, v in slots.items()]) for k, (newest, slots) in paths.items()]),))

    def _end(self, paths: dict) -> int:
        return min(newest for newest, _ in paths.values()) + self.ttl

    def _answers(self, rows: Iterable[tuple], timerValues) -> list[tuple]:
        """(event id, slots, tokens) of the loads (at, event id, session, path, kind, symbol, tokens, at in milliseconds)."""
        held = self._held(timerValues)
        paths, out = held or {}, []
        totals = {k: sum(v[0] for v in slots.values()) for k, (_, slots) in paths.items()}
        for _, event_id, session, p, kind, symbol, tokens, ts in sorted(rows, key=lambda r: r[:2]):
            path, slot = (session, p), f"{kind}:{'' if kind == 'range' or symbol is None else symbol}"
            newest, slots = paths.get(path, (ts, {}))
            paths[path] = (max(newest, ts), slots)
            if kind == CHANGED:
                for k in [k for k, v in slots.items() if (v[1], v[2]) < (ts, event_id)]:
                    del slots[k]
                totals[path] = sum(v[0] for v in slots.values())
                continue
            was = slots.get(slot)
            if was is not None and (was[1], was[2]) >= (ts, event_id):
                continue  # a repeated event, or one that a later batch brings after its successor
            totals[path] = totals.get(path, 0) + tokens - (was[0] if was else 0)
            slots[slot] = (tokens, ts, event_id)
            out.append((event_id, len(slots), totals[path]))
        if paths:
            self._hold(paths)
            if held is None:
                self.handle.registerTimer(self._end(paths))
        return out

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        for event_id, n, total in self._answers([(r.at, r.event_id, r.session_id, r.path, r.kind, r.symbol, r.tokens, _ms(r.at)) for r in rows], timerValues):
            yield Row(event_id=event_id, n_slots=n, token_estimate=total)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        paths = self._held(timerValues)
        if paths:
            self._hold(paths)
            # the clock may stand at the end of a path that is not over yet
            self.handle.registerTimer(max(self._end(paths), expiredTimerInfo.getExpiryTimeInMs() + 1))
        elif paths is not None:
            self.state.clear()
        return iter(())


class RegistryFrames(Registry):
    """The same over frames, which cost less than rows; `at` in microseconds."""

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        loads = [r for f in rows for r in zip(*(f[c].tolist() for c in ("at", "event_id", "session_id", "path", "kind", "symbol", "tokens")), strict=True)]
        out = self._answers([(*r, round(r[0] / 1000)) for r in loads], timerValues)
        yield pd.DataFrame(out, columns=["event_id", "n_slots", "token_estimate"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        return super().handleExpiredTimer(key, timerValues, expiredTimerInfo)


def branch_switches(heads: DataFrame) -> DataFrame:
    """(project, at, was, now) where the head of a project is another than when it was read before; reads are (project, at, head)."""
    w = Window.partitionBy("project").orderBy("at", "head")
    return heads.withColumn("was", F.lag("head").over(w)).where("was <> head").select("project", "at", "was", F.col("head").alias("now"))


def invalidations(switches: DataFrame, changed: DataFrame, held: DataFrame) -> DataFrame:
    """Events of the kind CHANGED for registry_log: for each path (project, was, now, path) that differs between two heads, one to each session that ever held it (project, session_id, path)."""
    d = switches.join(changed, ["project", "was", "now"]).join(held.select("project", "session_id", "path").distinct(), ["project", "path"])
    return d.select("session_id", "path", "at", F.lit(CHANGED).alias("kind"), F.lit(None).cast("string").alias("symbol"), F.lit(0).cast("long").alias("tokens"), F.lit(-1).cast("long").alias("event_id"))


def edits_prepared(events: DataFrame, ttl_ms: int = TTL_MS, late: str = LATE, marks: DataFrame | None = None) -> DataFrame:
    """(event_id, prepared) of the edits in a stream of marks and edits (project, path, at, is_mark, event_id). marks: (project, path, ts) from a batch, to begin with."""
    ship(events.sparkSession)
    e = events.withWatermark("at", late).select("project", "path", "at", "is_mark", "event_id")
    first = None if marks is None else marks.groupBy("project", "path").agg(F.max("ts").alias("ts")).groupBy("project", "path")
    return e.groupBy("project", "path").transformWithState(EditPrep(ttl_ms), "event_id long, prepared boolean", "Append", "EventTime", first)


def registry_log(loads: DataFrame, ttl_ms: int = REGISTRY_MS, late: str = LATE, buckets: int = BUCKETS) -> DataFrame:
    """(event_id, n_slots, token_estimate) of the loads in a stream (session_id, path, at, kind, symbol, tokens, event_id). buckets: in which sessions' paths share a state; as many for all of a checkpoint's life."""
    ship(loads.sparkSession)
    e = loads.withWatermark("at", late).select(F.pmod(F.xxhash64("session_id", "path"), F.lit(buckets)).alias("bucket"), "session_id", "path", F.unix_micros("at").alias("at"), "kind", "symbol", "tokens", "event_id")
    return e.groupBy("bucket").transformWithStateInPandas(RegistryFrames(ttl_ms), "event_id long, n_slots int, token_estimate long", "Append", "EventTime")


@contextmanager
def _settings(spark: SparkSession, **conf: str):
    """Session settings while a stream starts; they are put back."""
    conf = {k.replace("__", "."): v for k, v in conf.items()}
    was = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in was.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def run_to_end(out: DataFrame, path: str, checkpoint: str, partitions: int) -> None:
    """Run a stream over what its source has now, into a folder of Parquet files, from where its checkpoint stands. partitions: of the state, when the checkpoint is new."""
    spark = out.sparkSession
    with _settings(spark, spark__sql__streaming__stateStore__providerClass=ROCKS, spark__sql__shuffle__partitions=str(partitions)):
        out.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()


def by_slices(events: DataFrame, at: str, cuts: int, folder: str, operator: Callable[[DataFrame], DataFrame], partitions: int | None = None) -> DataFrame:
    """The rows of a streaming operator over a table that arrives in slices of time: a new run from the checkpoint for each slice. partitions: of the state; as many as there are cores, if none are given."""
    spark = events.sparkSession
    partitions = partitions or max(8, spark.sparkContext.defaultParallelism)
    events = saved(events, "events")  # what they are made of is made once, not for each slice
    lo, hi = events.agg(F.min(at), F.max(at)).first()
    if lo is None:  # one empty run
        lo = hi = dt.datetime(1970, 1, 1)
    edges = [lo + (hi - lo) * i / cuts for i in range(cuts)] + [hi + dt.timedelta(seconds=1)]
    for i in range(cuts):
        c: Column = F.col(at)
        events.where((c >= F.lit(edges[i])) & (c < F.lit(edges[i + 1]))).write.mode("append").parquet(f"{folder}/in")
        run_to_end(operator(spark.readStream.schema(events.schema).parquet(f"{folder}/in")), f"{folder}/out", f"{folder}/checkpoint", partitions)
    return spark.read.parquet(f"{folder}/out")

