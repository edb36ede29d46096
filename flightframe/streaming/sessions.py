"""Live sessions: typed state per session, arriving frames gone through in order.

What a frame changes is stated once, in ``advanced``, which goes from frame to frame as the state does: what is
carried from one call to the next is one value and two bounded lists in the state store. Frames are taken
``AT_ONCE`` at a time. On the same frames the batch operators give the same, wherever batches or calls are cut.

A call has a fixed cost of many times that of a frame, so a call brings the frames of a whole part of the sessions;
each session's state is still an entry of its own, read and written once a batch, and only when it has frames.
"""

from __future__ import annotations

import cmath
import math
import pickle
from collections.abc import Iterable, Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from flightframe.operators.calibration import heading
from flightframe.operators.sequences import CONTINUITY
from flightframe.policies import CalibrationPolicy, NavigationPolicy

OUTPUT = (
    "session long, seq long, action string, event string, segment long, pose_x double, pose_y double, "
    "x double, y double, z double, status string"
)
SAID = [column.split()[0] for column in OUTPUT.split(", ")][1:]
#: One value: the frame that the next one is compared with; counts; pose; last GPS fix with its frame index; whether
#: samples are held fast, and how many of either list; where estimates start; the last position given; when the session was
#: seen last, in seconds.
HELD = (
    "last struct<frame_id: string, video: string, width: double, height: double, modality: string, frame_index: double, fingerprint: string>, "
    "health double, segment long, steps long, recovery long, pose array<double>, fix array<double>, lost boolean, anchor array<double>, "
    "given array<double>, seen double, sampled long, held_fast long"
)
SEEN = 10
#: Two lists: samples for calibration now, and as they were when GPS was lost.
SAMPLE = "cam_x double, cam_y double, gps_x double, gps_y double"
NAMES = ("last", "health", "segment", "steps", "recovery", "pose", "fix", "samples", "frozen", "anchor", "given")
FRAME = ("frame_id", "video", "width", "height", "modality", "frame_index", "fingerprint")
NUMBERS = ("health", "gps_x", "gps_y", "gps_z", "dx", "dy", "yaw", "inlier_ratio")
_UNPLACED = (math.nan,) * 5
IDLE_SECONDS = 1800  # fixed value: a session without frames for longer is forgotten
AT_ONCE = 1024
PARTS = 128  # fixed value: a session's part must stay the same as long as a stream goes on
ROWS_OUT = 10_000


def fresh() -> dict:
    """The state of a session not seen yet."""
    return dict.fromkeys(NAMES) | {"segment": 0, "steps": 0, "recovery": 0, "pose": [0.0, 0.0, 0.0], "samples": []}


class _Pair:
    """A frame and the one before it, as the rules of ``CONTINUITY`` ask for them."""

    __slots__ = ("first", "max_gap", "gap", "unnumbered", "_now", "_before")

    def __init__(self, now: dict, before: dict | None, max_gap: int):
        self.first, self.max_gap, self._now, self._before = before is None, max_gap, now, before
        index, earlier = now["frame_index"], None if before is None else before["frame_index"]
        self.unnumbered = index is None or earlier is None
        self.gap = math.nan if self.unnumbered else index - earlier

    def differs(self, name: str) -> bool:
        return self._now[name] != self._before[name]

    def repeats(self, name: str) -> bool:
        return self._now[name] is not None and self._now[name] == self._before[name]


def _numbers(values: pd.Series) -> list[float]:
    """Numbers one by one, as most calls have a few; none is not a number."""
    return [math.nan if v is None or v is pd.NA else float(v) for v in values.tolist()]


def _plain(frames: pd.DataFrame, name: str) -> list:
    """A column's values, None where there is none; numbers as such, all else as text."""
    if name in ("width", "height", "frame_index"):
        return [_or_none(v) for v in _numbers(frames[name])]
    return [None if v is None or v is pd.NA or v != v else str(v) for v in frames[name].tolist()]


def _or_none(value: float) -> float | None:
    return None if math.isnan(value) else value


class _Models:
    """Headings by the list of samples they come from; a list is replaced, never changed, so it is its own key."""

    def __init__(self, calibration: CalibrationPolicy) -> None:
        self.calibration, self._of, self._model = calibration, None, None

    def of(self, samples: list) -> tuple[complex, bool] | None:
        if self._of is not samples:
            listed = np.array(samples, float).reshape(-1, 4)
            self._of, self._model = samples, heading(listed[:, 0] + 1j * listed[:, 1], listed[:, 2] + 1j * listed[:, 3], self.calibration)
        return self._model


def _rows(frames: pd.DataFrame) -> Iterator[tuple]:
    """Frames as plain values, a bounded number taken apart at once."""
    for low in range(0, len(frames), 8 * AT_ONCE):
        part = frames.iloc[low : low + 8 * AT_ONCE]
        named, numbers = zip(*[_plain(part, name) for name in FRAME]), zip(*[_numbers(part[name]) for name in NUMBERS])
        yield from zip(part["seq"].tolist(), part["valid"].eq(True).tolist(), named, numbers)


def _table(sessions: list, said: list[tuple]) -> pd.DataFrame:
    told = dict(zip(SAID, zip(*said))) if said else dict.fromkeys(SAID, ())
    return pd.DataFrame({"session": sessions} | {name: list(values) for name, values in told.items()})


def advanced(
    frames: pd.DataFrame, held: dict, policy: NavigationPolicy, calibration: CalibrationPolicy,
) -> tuple[pd.DataFrame, dict]:
    """The output rows of frames in arrival order, and the state after them."""
    said, state = _advanced(_rows(frames), held, policy, calibration)
    return _table(frames["session"].tolist(), said), state


def _advanced(rows: Iterable[tuple], held: dict, policy: NavigationPolicy, calibration: CalibrationPolicy) -> tuple[list[tuple], dict]:
    """Most sessions have a few frames in a batch, so the frames are gone through one by one: array expressions cost as
    much for one frame as for hundreds."""
    state, models, said = dict(held), _Models(calibration), []
    for seq, valid, texts, (health, x, y, z, dx, dy, turn, ratio) in rows:
        now, last = dict(zip(FRAME, texts)), state["last"]
        if now["modality"] is not None and now["modality"] != "rgb":
            state = fresh() | {"segment": state["segment"], "health": _or_none(health)}
            said.append((seq, "wipe", "unsupported_modality", state["segment"], *_UNPLACED, "skipped"))
            continue
        if last is not None and now["frame_id"] is not None and now["frame_id"] == last["frame_id"]:
            said.append((seq, "duplicate", "duplicate_frame", state["segment"], *_UNPLACED, "skipped"))
            continue
        pair = _Pair(now, last, policy.max_frame_gap)
        event, action = next(((event, action) for event, action, test in CONTINUITY if test(pair)), ("continue", "continue"))
        new = action in ("first", "reset")
        moved = action == "continue" and valid
        health_before = state["health"]

        # Pose: a turn, then a step in the turned direction, both since the segment began.
        way, yaw = complex(*state["pose"][:2]), state["pose"][2]
        way_before = 0j if action == "first" else way
        steps = 0 if new else state["steps"] + 1
        if new:
            way, yaw = 0j, 0.0
        elif moved and steps >= policy.warmup_frames:
            yaw += turn
            way += cmath.rect(1.0, -yaw) * complex(dx, dy)

        # GPS: the fix in force before the frame, and whether it is of a neighbouring frame.
        healthy = health == 1 and math.isfinite(x) and math.isfinite(y) and math.isfinite(z)
        lost = health == 0
        fix_before = None if action == "first" else state["fix"]
        index = now["frame_index"]
        adjacent = fix_before is not None and index is not None and fix_before[3] is not None and 0 < index - fix_before[3] <= policy.max_frame_gap
        fix = [x, y, z, index] if healthy else None if new or health == 1 else state["fix"]

        # Recovery: healthy frames since GPS came back; nothing counts before that.
        back = healthy and health_before == 0
        recovery = 1 if back else 0 if lost or new else state["recovery"] + healthy if state["recovery"] else 0

        # A calibration sample: camera step and GPS step of neighbouring healthy frames.
        samples = [] if new else state["samples"]
        if healthy and moved and health_before == 1 and adjacent and math.isfinite(ratio):
            camera, travel = way - way_before, complex(x - fix_before[0], y - fix_before[1])
            if abs(camera) >= calibration.min_camera_step_px and abs(travel) >= calibration.min_gps_step:
                samples = [*samples, [camera.real, camera.imag, travel.real, travel.imag]][-calibration.max_samples :]

        # Loss: where it began the samples are held fast, until enough healthy frames or a reset end it.
        frozen, anchor = state["frozen"], state["anchor"]
        begins = lost and health_before == 1 and adjacent
        if begins:
            frozen, anchor = state["samples"], [*fix_before[:3], way_before.real, way_before.imag]
        else:
            if new or (healthy and recovery >= policy.recovery_min_healthy_frames):
                frozen = None
            if back:
                anchor = [x, y, z, way.real, way.imag]
            elif new:
                anchor = None

        given, answer = None if new else state["given"], (math.nan,) * 3
        if healthy:
            answer = x, y, z
            given = list(answer)
        elif lost and moved and anchor is not None and policy.z_policy != "return_none_if_schema_allows":
            model = models.of(samples if frozen is None else frozen)
            if model is not None:
                factor, mirrored = model
                gone = way - complex(*anchor[3:])
                place = complex(*anchor[:2]) + factor * (gone.conjugate() if mirrored else gone)
                if given is not None and policy.max_delta_per_frame > 0:
                    jump = place - complex(*given[:2])
                    if abs(jump) > policy.max_delta_per_frame:
                        place = complex(*given[:2]) + policy.max_delta_per_frame * jump / abs(jump)
                answer = place.real, place.imag, anchor[2]
                given = list(answer)

        answered = not any(map(math.isnan, answer))
        status = "gps_ground_truth" if healthy else "ground_truth_unavailable" if not lost else "gps_loss_prediction" if answered else "gps_loss_unavailable"
        said.append((seq, action, event, state["segment"] + new, way.real, way.imag, *answer, status))
        state = dict(
            last=now, health=_or_none(health), segment=state["segment"] + new, steps=steps, recovery=int(recovery), pose=[way.real, way.imag, yaw],
            fix=fix, samples=samples, frozen=frozen, anchor=anchor, given=given)
    return said, state


class _Session(StatefulProcessor):
    """One session's frames as they arrive. ``at`` names the column of their time; without it, time is that of processing."""

    def __init__(self, policy: NavigationPolicy, calibration: CalibrationPolicy, idle_seconds: float, at: str | None) -> None:
        self.policy, self.calibration, self.idle, self.at = policy, calibration, idle_seconds, at

    def init(self, handle: StatefulProcessorHandle) -> None:
        # Time to live only exists beside processing time; with times of their own, timers clear the state.
        ttl = None if self.at else int(self.idle * 1000)
        self.handle = handle
        self.held = handle.getValueState("held", HELD, ttl)
        self.samples, self.frozen = (handle.getListState(name, SAMPLE, ttl) for name in ("samples", "frozen"))

    def _read(self) -> tuple[dict, float | None]:
        """Every call to the store is a round trip, so the lists are only asked for where the value says they hold something."""
        value = self.held.get()
        if value is None:
            return fresh(), None
        last, health, segment, steps, recovery, pose, fix, lost, anchor, given, seen, sampled, held_fast = value
        listed = lambda state, n: [list(row) for row in state.get()] if n else []
        return dict(
            last=None if last is None else dict(zip(FRAME, last)), health=health, segment=segment, steps=steps, recovery=recovery, pose=_listed(pose),
            fix=_listed(fix), samples=listed(self.samples, sampled), frozen=listed(self.frozen, held_fast) if lost else None, anchor=_listed(anchor),
            given=_listed(given)), seen

    def _write(self, state: dict, seen: float, before: dict, known: bool) -> None:
        last = None if state["last"] is None else tuple(state["last"][name] for name in FRAME)
        samples, frozen = state["samples"], state["frozen"]
        self.held.update((
            last, state["health"], state["segment"], state["steps"], state["recovery"], state["pose"], state["fix"], frozen is not None,
            state["anchor"], state["given"], seen, len(samples), len(frozen or ())))
        # A list is replaced, never changed; what the value says is empty is not read, so it may stay. With time to live
        # a list is written again, as its rows would be gone before the value.
        for kept, rows, old in ((self.samples, samples, before["samples"]), (self.frozen, frozen, before["frozen"])):
            if rows and (rows is not old or not self.at):
                kept.put([tuple(row) for row in rows])
        # One timer is out as long as the value is there; it goes on when it fires too early.
        if not known:
            self._remind(seen)

    def _remind(self, seen: float) -> None:
        self.handle.registerTimer(self._due(seen))

    def _due(self, seen: float) -> int:
        return int((seen + self.idle) * 1000) + 1

    def moments(self, frames: pd.DataFrame, timerValues) -> tuple[list[float], list[bool]]:
        """When frames were seen, in seconds, and which rows are resets."""
        if self.at:
            times = (pd.to_datetime(frames[self.at], utc=True).to_numpy("datetime64[us]").astype("int64") / 1e6).tolist()
        else:
            times = [timerValues.getCurrentProcessingTimeInMs() / 1000] * len(frames)
        return times, (frames["control"] == "reset").tolist() if "control" in frames else [False] * len(frames)

    def answers(self, arrived: Iterable[tuple[float, bool, tuple]]) -> Iterator[list[tuple]]:
        """What is said about a session's rows, given with time and whether each is a reset."""
        before, seen = self._read()
        state, at, part = before, seen, []
        for time, reset, row in arrived:
            ends = reset or (at is not None and time - at > self.idle)
            if part and (ends or len(part) >= AT_ONCE):
                said, state = _advanced(part, state, self.policy, self.calibration)
                yield said
                part = []
            if ends:
                state = fresh()
            at = time
            if not reset:
                part.append(row)
        if part:
            said, state = _advanced(part, state, self.policy, self.calibration)
            yield said
        self._write(state, float(at), before, seen is not None)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frames = pd.concat(list(rows)).sort_values("seq", kind="stable", ignore_index=True)
        for said in self.answers(zip(*self.moments(frames, timerValues), _rows(frames))):
            yield _table([frames["session"][0]] * len(said), said)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        value = None if expiredTimerInfo is None else self.held.get()
        if value is not None and self._due(value[SEEN]) > expiredTimerInfo.getExpiryTimeInMs():
            self._remind(value[SEEN])
            return iter(())
        for state in (self.held, self.samples, self.frozen):
            state.clear()
        return iter(())

    def close(self) -> None:
        pass


class _Entry:
    """What ``_Session`` takes for its store: one session's value and lists, which are one entry among those of its part."""

    def __init__(self, entries) -> None:
        self.entries, self.values = entries, {}

    def getValueState(self, name: str, schema: str, ttl: int | None = None) -> _Field:
        return _Field(self, name)

    def getListState(self, name: str, schema: str, ttl: int | None = None) -> _Points:
        return _Points(self, name)

    def registerTimer(self, at: int) -> None:
        """A part has one timer for all its sessions."""

    def read(self, key: str) -> None:
        found = self.entries.getValue((key,))
        self.values = {} if found is None else pickle.loads(found[1])

    def write(self, key: str) -> None:
        held = self.values["held"]
        # A list that the value says is empty is not read.
        kept = {"held": held} | {name: self.values[name] for name, n in zip(("samples", "frozen"), held[-2:]) if n}
        self.entries.updateValue((key,), (held[SEEN], pickle.dumps(kept)))


class _Field:
    def __init__(self, entry: _Entry, name: str) -> None:
        self.entry, self.name = entry, name

    def get(self):
        return self.entry.values.get(self.name)

    def update(self, value) -> None:
        self.entry.values[self.name] = value


class _Points(_Field):
    """A list of samples, eight bytes a number."""

    def get(self) -> list[list[float]]:
        return np.frombuffer(self.entry.values[self.name]).reshape(-1, 4).tolist()

    def put(self, rows: list[tuple]) -> None:
        self.entry.values[self.name] = np.array(rows, float).tobytes()


class _Sessions(StatefulProcessor):
    """The sessions of a part: a map of their entries, and one timer that goes through them."""

    def __init__(self, session: _Session) -> None:
        self.session = session

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # Columns of an entry are taken apart one by one on their way to and from the store, which for some twenty costs more than all else.
        self.entries = handle.getMapState("entries", "session string", "seen double, rest binary")
        self.timer = handle.getValueState("timer", "due long")
        self.entry = _Entry(self.entries)
        self.session.init(self.entry)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frames = pd.concat(list(rows), ignore_index=True)
        codes, _ = pd.factorize(frames["session"], use_na_sentinel=False)
        frames = frames.iloc[np.lexsort((frames["seq"], codes))]
        times, resets = self.session.moments(frames, timerValues)
        named = (name if isinstance(name, str) else "" for name in frames["session"].tolist())
        sessions, out = [], []
        for name, arrived in groupby(zip(named, times, resets, _rows(frames)), key=itemgetter(0)):
            self.entry.read(name)
            for said in self.session.answers(row[1:] for row in arrived):
                sessions += [int(name) if name else None] * len(said)
                out += said
                if len(out) >= ROWS_OUT:
                    yield _table(sessions, out)
                    sessions, out = [], []
            self.entry.write(name)
        if out:
            yield _table(sessions, out)
        if self.timer.get() is None:
            self._remind(self.session._due(min(times)))

    def _remind(self, at: int) -> None:
        self.handle.registerTimer(at)
        self.timer.update((at,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Idle sessions go; the others are looked at again when the next is due, at most twice in ``idle`` seconds."""
        now = timerValues.getCurrentWatermarkInMs() if self.session.at else timerValues.getCurrentProcessingTimeInMs()
        due = [(self.session._due(value[0]), name) for (name,), value in self.entries.iterator()]
        stay = [at for at, _ in due if at > now]
        if stay:
            for at, name in due:
                if at <= now:
                    self.entries.removeKey((name,))
            self._remind(max(min(stay), int(now + 500 * self.session.idle)))
        else:
            self.entries.clear()
            self.timer.clear()
        return iter(())

    def close(self) -> None:
        pass


def _listed(values) -> list[float] | None:
    return None if values is None else [None if v is None else float(v) for v in values]


def sessions_stream(
    frames: DataFrame, policy: NavigationPolicy = NavigationPolicy(), calibration: CalibrationPolicy = CalibrationPolicy(),
    idle_seconds: float = IDLE_SECONDS, at: str | None = None, delay: str = "1 minute",
) -> DataFrame:
    """Continuity, pose and position of every frame as it arrives. A row whose ``control`` is ``reset`` forgets
    its session and is not answered; so does a pause of more than ``idle_seconds``, by the times in ``at`` (frames
    later than ``delay`` are dropped) or by those of processing. Timers clear the state of idle sessions.

    Needs the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``). A micro-batch bounds how
    many frames of a session are sorted at once; the state holds at most ``max_samples`` samples twice.
    """
    timed = frames if at is None else frames.withWatermark(at, delay)
    # Parts know sessions by their names, as a column of whole numbers with gaps would come as fractions.
    asked = [name for name in (*FRAME, *NUMBERS, "seq", "valid", "control", at) if name in timed.columns]
    parts = timed.select(F.pmod(F.xxhash64("session"), F.lit(PARTS)).alias("part"), F.col("session").cast("string").alias("session"), *asked)
    return parts.groupBy("part").transformWithStateInPandas(
        _Sessions(_Session(policy, calibration, idle_seconds, at)), OUTPUT, "append", "processingTime" if at is None else "eventTime")


def continuity_stream(frames: DataFrame, policy: NavigationPolicy = NavigationPolicy()) -> DataFrame:
    """Only the continuity part: a late index is a reset, never a reordering."""
    return sessions_stream(frames, policy).select("session", "seq", "action", "event", "segment")
