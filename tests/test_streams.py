"""Streams at their end, and state carried between batches."""

import pandas as pd
from pyspark.sql import functions as F

from flightframe.catalog import QUERIES, load_all
from flightframe.policies import CalibrationPolicy, NavigationPolicy
from flightframe.streaming import feeds
from flightframe.streaming import joins as J
from flightframe.streaming import sessions as SS

load_all()


def test_last_frames_without_results_are_answered(spark, sf, tmp_path):
    """No frame has a result, so all wait for the limit, also those after which nothing comes."""
    events = spark.read.parquet(f"{sf}/events.parquet").where("event_id < 40").withColumn("props", F.lit('{"k": 0}'))
    events.write.parquet(f"{tmp_path}/events.parquet")
    rows = QUERIES["combine_tasks_stream"](spark, str(tmp_path)).collect()
    assert len(rows) == 40 and all(r.detected is None and r.position is None and r.found is None for r in rows)


class _Store:
    """Keeps state of one session, counts calls, and timers as the store keeps them."""

    def __init__(self):
        self.calls, self.timers, self.values = 0, set(), {}

    def getValueState(self, name, schema, ttl=None):
        return _Cell(self, name)

    getListState = getValueState

    def listTimers(self):
        self.calls += 1
        return iter(sorted(self.timers))

    def deleteTimer(self, at):
        self.calls += 1
        self.timers.discard(at)

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)


class _Cell:
    def __init__(self, store, name):
        self.store, self.name = store, name

    def _count(self):
        self.store.calls += 1
        return self.store.values

    exists = lambda self: self.name in self._count()
    get = lambda self: self._count().get(self.name)
    clear = lambda self: self._count().pop(self.name, None)

    def update(self, value):
        self._count()[self.name] = value

    put = update


def _frames(first, n):
    seqs = range(first, first + n)
    same = dict(session=1, video="v", width=500, height=400, modality="rgb", health=1, gps_z=1.0, dx=4.0, dy=1.0, yaw=0.0, inlier_ratio=0.9, valid=True)
    return pd.DataFrame([same | dict(seq=s, frame_id=f"f{s}", frame_index=s, fingerprint=f"h{s}", gps_x=4.0 * s, gps_y=1.0 * s, ts=pd.Timestamp(s, unit="s")) for s in seqs])


def test_a_known_session_asks_the_store_a_few_times():
    store, session = _Store(), SS._Session(NavigationPolicy(), CalibrationPolicy(), 300, "ts")
    session.init(store)
    whole, _ = SS.advanced(_frames(0, 40), SS.fresh(), NavigationPolicy(), CalibrationPolicy())
    parts, calls = [], []
    for at in range(0, 40, 10):
        parts += session.handleInputRows((1,), iter([_frames(at, 10)]), None)
        calls.append(store.calls)
    pd.testing.assert_frame_equal(pd.concat(parts, ignore_index=True), whole, check_dtype=False)
    assert max(b - a for a, b in zip(calls, calls[1:])) <= 4 and len(store.timers) == 1


def test_a_timer_that_fires_early_goes_on():
    store, session = _Store(), SS._Session(NavigationPolicy(), CalibrationPolicy(), 300, "ts")
    session.init(store)
    fired = lambda at: type("Fired", (), {"getExpiryTimeInMs": lambda self: at})()
    for at in (0, 100):
        list(session.handleInputRows((1,), iter([_frames(at, 1)]), None))
    (first,) = store.timers
    store.timers.clear()
    assert list(session.handleExpiredTimer((1,), None, fired(first))) == [] and "held" in store.values
    (second,) = store.timers
    assert (first, second) == (300_001, 400_001)
    assert list(session.handleExpiredTimer((1,), None, fired(second))) == [] and not store.values


def test_arriving_rows_are_worked_out_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def through(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    frames = spark.range(500).withColumnRenamed("id", "seq").mapInPandas(through, "seq long")
    feeds.arriving(frames, "once", rows=100)
    assert seen.value == 500


def test_live_frames_meet_windows_without_a_broadcast(spark, tmp_path):
    """Open windows make many ranges of few rows; the index of a live join is not sent whole through the driver either."""
    windows = spark.range(3000).select(
        (F.col("id") % 5).alias("session"), F.col("id").alias("object_id"), (F.col("id") % 3).alias("generation"),
        F.when(F.col("id") % 5 > 0, F.col("id") % 50).alias("active_from"), F.when(F.col("id") % 7 > 0, F.col("id") % 50 + 8).alias("active_until"))
    frames = spark.range(-3, 70).select(F.explode(F.expr("sequence(0L, 4L)")).alias("session"), F.when(F.col("id") < 69, F.col("id")).alias("frame_index"))
    live = J.active_references_stream(feeds.arrived(frames, "met"), windows).select("session", "frame_index", "object_id", "generation")
    query = live.writeStream.format("parquet").option("path", f"{tmp_path}/rows").option("checkpointLocation", f"{tmp_path}/log").trigger(availableNow=True).start()
    query.awaitTermination()
    plan = query._jsq.explainInternal(False)
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    holds = F.expr("(active_from is null and active_until is null) or (frame_index is not null and frame_index >= coalesce(active_from, -99) and frame_index <= coalesce(active_until, 99))")
    wanted = frames.join(windows.where("generation = 2"), "session").where(holds).select("session", "frame_index", "object_id", "generation")
    found = spark.read.schema(live.schema).parquet(f"{tmp_path}/rows")
    assert found.count() == wanted.count() > 1000 and found.exceptAll(wanted).isEmpty()


class _Part(_Store):
    """Keeps the entries of a part's sessions as the store does, and counts calls."""

    def getMapState(self, name, key, value, ttl=None):
        return self

    def getValue(self, key):
        self.calls += 1
        return self.values.get(key)

    def updateValue(self, key, value):
        self.calls += 1
        self.values[key] = value

    def removeKey(self, key):
        self.calls += 1
        self.values.pop(key)

    def iterator(self):
        self.calls += 1
        return iter(list(self.values.items()))

    def clear(self):
        self.calls += 1
        self.values.clear()


def _zigzag(first, n, session):
    """Steps of two directions, some of them after GPS is lost."""
    frames = _frames(first, n)
    side, lost = 3.0 * (frames.seq % 2), frames.seq % 90 >= 60 + session
    return frames.assign(gps_x=4.0 * frames.seq + session, gps_y=side, dy=2 * side - 3, health=1 - lost.astype(int))


def test_sessions_of_a_part_come_in_one_call():
    """Ten sessions, one without a name: two calls to the store each, and the answers each gets by itself."""
    store, part = _Part(), SS._Sessions(SS._Session(NavigationPolicy(), CalibrationPolicy(), 300, "ts"))
    store.getValueState = lambda *_: _Cell(_Store(), "timer")
    part.init(store)
    parts, calls = [], []
    for at in range(0, 120, 40):
        frames = pd.concat([_zigzag(at, 40, n).assign(session=str(n) if n else None) for n in range(10)])
        parts += part.handleInputRows((1,), iter([frames.sample(frac=1, random_state=at)]), None)
        calls.append(store.calls)
    assert max(b - a for a, b in zip([0, *calls], calls)) <= 2 * 10 + 1
    got = pd.concat(parts, ignore_index=True)
    assert len(got) == 1200 and (got.status == "gps_loss_prediction").sum() > 100
    for n in range(10):
        want, _ = SS.advanced(_zigzag(0, 120, n), SS.fresh(), NavigationPolicy(), CalibrationPolicy())
        mine = got[got.session == n] if n else got[got.session.isna()]
        pd.testing.assert_frame_equal(mine.drop(columns="session").reset_index(drop=True), want.drop(columns="session"), check_dtype=False)


def test_a_part_forgets_its_idle_sessions():
    store, part = _Part(), SS._Sessions(SS._Session(NavigationPolicy(), CalibrationPolicy(), 300, "ts"))
    store.getValueState = lambda *_: _Cell(kept, "timer")
    kept = _Store()
    part.init(store)
    clock = lambda at: type("Clock", (), {"getCurrentWatermarkInMs": lambda self: at})()
    for at, name in ((0, "1"), (100, "2"), (200, "1")):
        list(part.handleInputRows((1,), iter([_frames(at, 1).assign(session=name)]), None))
    assert store.timers == {300_001}
    store.timers.clear()
    assert list(part.handleExpiredTimer((1,), clock(400_001), None)) == [] and [*store.values] == [("1",)]
    assert store.timers == {550_001} and kept.values["timer"] == (550_001,)
    assert list(part.handleExpiredTimer((1,), clock(550_001), None)) == [] and not store.values and not kept.values


def test_a_session_without_a_name_is_one_of_its_own(spark):
    rows = [(s, f"{s}-{n}", float(n), n * 3 + (s or 0)) for s in (None, 1, 2**60 + 1) for n in range(30)]
    frames = spark.createDataFrame(rows, "session long, frame_id string, frame_index double, seq long").selectExpr(
        "*", "'v' as video", "500d as width", "400d as height", "'rgb' as modality", "cast(seq as string) as fingerprint", "1 as health",
        *[f"cast(frame_index * 4 as double) as {n}" for n in ("gps_x", "gps_y", "gps_z", "dx", "dy", "yaw", "inlier_ratio")], "true as valid")
    got = feeds.run_in_slices(frames, "unnamed", SS.continuity_stream, rows=20).groupBy("session").agg(
        F.count("*").alias("n"), F.count_if(F.col("event") == "first_frame").alias("firsts"), F.max("segment").alias("segment")).collect()
    assert {r.session: (r.n, r.firsts, r.segment) for r in got} == {s: (30, 1, 1) for s in (None, 1, 2**60 + 1)}
