"""Keeping a reference object in view: strong evidence starts a track, weak evidence near it may
only go on for a bounded number of frames."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from flightframe.plans.scans import CHUNK, axis_of, scan

BOX_FIELDS = ("x1", "y1", "x2", "y2", "conf")
OUTPUT = "session long, object_id long, seq long, x1 double, y1 double, x2 double, y2 double, conf double, evidence string"
HELD = "x double, y double, area double, until long, frames long"
_SAID = "array<struct<seq:bigint,x1:double,y1:double,x2:double,y2:double,conf:double,evidence:string>>"


@dataclass(frozen=True)
class TrackPolicy:
    """Fixed values of the gate: peak that starts a track, frames it may go on, reach in pixels,
    and the smallest share of the last strong area a box may have (0 for none)."""

    strong_peak: float = 1.85
    ttl: int = 20
    radius: float = 250.0
    min_area_share: float = 0.0


def _best(boxes: Column) -> Column:
    """The box of the highest confidence, the first of equal ones; null without boxes."""
    return F.array_max(F.transform(boxes, lambda b, i: F.struct(b["conf"], -i, b.alias("box"))))["box"]


def _middle(b: Column, axis: str) -> Column:
    return (b[f"{axis}1"] + b[f"{axis}2"]) / 2


def _size(b: Column) -> Column:
    return (b["x2"] - b["x1"]) * (b["y2"] - b["y1"])


def track_gate(frames: DataFrame, policy: TrackPolicy = TrackPolicy(), keys: Sequence[str] = ("session", "object_id")) -> DataFrame:
    """Batch form over rows (keys, seq, boxes: array of structs).

    A strong frame sets the track whatever was before, and only the ``ttl`` frames after it can go on; so a track
    is a group of at most ``ttl + 1`` frames, however long the session is. Its first frame is reported with all
    strong boxes, the others are gone through from place to place by an aggregate over their boxes.
    """
    keys = list(keys)
    strong = F.exists("boxes", lambda b: b["peak"] >= policy.strong_peak)
    cut, axis = axis_of(frames, keys, "seq")
    counted = scan(cut.withColumn("_strong", strong), axis, sums={"_nth": F.lit(1), "_track": F.col("_strong").cast("int")})
    counted = scan(counted, axis, upto={"_from": F.when(F.col("_strong"), F.col("_nth"))}).drop(CHUNK)
    alive = counted.where((F.col("_track") > 0) & (F.col("_nth") - F.col("_from") <= policy.ttl))
    groups = alive.groupBy(*keys, "_track").agg(F.array_sort(F.collect_list(F.struct("seq", "boxes"))).alias("_f"))
    first = F.filter(F.col("_f")[0]["boxes"], lambda b: b["peak"] >= policy.strong_peak)
    led = groups.select(*keys, "_f", first.alias("_first"), _best(first).alias("_lead"))
    row = lambda seq, b, evidence: F.struct(seq.alias("seq"), *[b[c].alias(c) for c in BOX_FIELDS], F.lit(evidence).alias("evidence"))
    begun = F.transform("_first", lambda b: row(F.col("_f")[0]["seq"], b, "strong")).cast(_SAID)
    start = F.struct(_middle(F.col("_lead"), "x").alias("x"), _middle(F.col("_lead"), "y").alias("y"), begun.alias("said"))

    def follow(track: Column, frame: Column) -> Column:
        away = lambda b, axis: F.abs(_middle(b, axis) - track[axis])
        near = _best(F.filter(frame["boxes"], lambda b: (away(b, "x") <= policy.radius) & (away(b, "y") <= policy.radius)))
        # An array of none or one, so that the box is worked out once.
        taken = F.filter(F.array(near), lambda b: b.isNotNull() & (_size(b) >= policy.min_area_share * _size(F.col("_lead"))))
        moved = F.transform(taken, lambda b: F.struct(
            _middle(b, "x").alias("x"), _middle(b, "y").alias("y"), F.concat(track["said"], F.array(row(frame["seq"], b, "track")).cast(_SAID)).alias("said")))
        return F.coalesce(F.get(moved, F.lit(0)), track)

    told = F.aggregate(F.slice("_f", 2, policy.ttl), start, follow, lambda track: track["said"])
    return led.select(*keys, F.inline(told))


class _Track(StatefulProcessor):
    """Place, area and end of one object's track. Frames are numbered as they come, so a track ends at a number."""

    def __init__(self, policy: TrackPolicy) -> None:
        self.policy = policy

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("track", HELD)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frames = pd.concat(list(rows))
        arrived = sorted(zip(frames["seq"].tolist(), frames["boxes"].tolist()), key=lambda frame: frame[0])
        x, y, area, until, number = self.held.get() or (0.0, 0.0, 0.0, 0, 0)
        out, reach = [], self.policy.radius
        middle = lambda b: ((b["x1"] + b["x2"]) / 2, (b["y1"] + b["y2"]) / 2)
        size = lambda b: (b["x2"] - b["x1"]) * (b["y2"] - b["y1"])
        near = lambda p: abs(p[0] - x) <= reach and abs(p[1] - y) <= reach
        # As in the batch form, no confidence is the lowest, and one that is not a number the highest.
        sure = lambda b: -math.inf if b["conf"] is None else math.inf if b["conf"] != b["conf"] else b["conf"]
        whole = lambda b: all(b[c] is not None for c in ("x1", "y1", "x2", "y2"))
        for seq, boxes in arrived:
            number += 1
            taken, evidence = [b for b in boxes if b["peak"] is not None and b["peak"] >= self.policy.strong_peak], "strong"
            # The first box of the highest confidence leads.
            if not taken and number <= until:
                lead = max((b for b in boxes if whole(b) and near(middle(b))), key=sure, default=None)
                taken, evidence = [] if lead is None or size(lead) < self.policy.min_area_share * area else [lead], "track"
            if taken:
                lead = max(taken, key=sure)
                x, y = map(float, middle(lead)) if whole(lead) else (math.nan, math.nan)
                if evidence == "strong":
                    area, until = float(size(lead)) if whole(lead) else math.nan, number + self.policy.ttl
                out += [(*key, seq, *[b[c] for c in BOX_FIELDS], evidence) for b in taken]
        self.held.update((x, y, area, until, number))
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in OUTPUT.split(", ")])

    def close(self) -> None:
        pass


def track_gate_stream(frames: DataFrame, policy: TrackPolicy = TrackPolicy()) -> DataFrame:
    """Live form, with the track's place and end as state per session and object. Needs the RocksDB state store."""
    return frames.groupBy("session", "object_id").transformWithStateInPandas(_Track(policy), OUTPUT, "append", "none")
