"""Order within a session: pairs, repeats, continuity, warm-up and pose.

Frames carry ``seq``, their unique arrival number; "previous" always means by arrival.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flightframe.functions.numbers import count_if
from flightframe.plans.scans import CHUNK, Axis, axis_of, ranged_axis, scan
from flightframe.policies import CameraModel, DetectionPolicy, NavigationPolicy


def consecutive_pairs(frames: DataFrame, sequence: str = "sequence", number: str = "number", tie: str = "seq") -> DataFrame:
    """Each frame with its predecessor in the sequence, kept when the numbers differ by one."""
    paired = _with_previous(frames, sequence, number, tie)
    return paired.where(F.col(number) == F.col("previous")[number] + 1)


def skipped_pairs(frames: DataFrame, sequence: str = "sequence", number: str = "number", tie: str = "seq") -> DataFrame:
    paired = _with_previous(frames, sequence, number, tie)
    gap = F.col(number) - F.col("previous")[number]
    return paired.where(gap != 1).withColumn("frame_gap", gap)


def pairing_diagnostics(frames: DataFrame, sequence: str = "sequence", number: str = "number", tie: str = "seq") -> DataFrame:
    paired = _with_previous(frames, sequence, number, tie)
    return paired.groupBy(sequence).agg(
        F.count(F.lit(1)).alias("frames"),
        count_if(F.col(number) == F.col("previous")[number] + 1).alias("valid_pairs"),
        F.min(number).alias("first_number"),
        F.max(number).alias("last_number"),
    )


def _with_previous(frames: DataFrame, sequence: str, number: str, tie: str) -> DataFrame:
    ordered, axis = ranged_axis(frames, [sequence], [number, tie])
    everything = F.struct(*[c for c in frames.columns if c != sequence])
    return scan(ordered, axis, before={"previous": everything}).drop("_order", CHUNK)


def drop_repeats(frames: DataFrame, keys: Sequence[str] = ("session",), order: str = "seq") -> DataFrame:
    """Drop a frame whose id equals that of the frame before it (a run keeps its first)."""
    cut, axis = axis_of(frames, keys, order)
    marked = scan(cut, axis, before={"previous_id": F.struct("frame_id")})
    changed = F.col("previous_id").isNull() | (F.col("frame_id") != F.col("previous_id.frame_id"))
    return marked.where(changed).drop("previous_id", CHUNK)


# Event and action of a committed frame: the first test that holds. A test sees how the frame compares with the
# committed frame before it, as columns here and as arrays in the live form.
CONTINUITY = (
    ("first_frame", "first", lambda pair: pair.first),
    ("video_changed", "reset", lambda pair: pair.differs("video")),
    ("shape_changed", "reset", lambda pair: pair.differs("width") | pair.differs("height")),
    ("modality_changed", "reset", lambda pair: pair.differs("modality")),
    ("frame_index_missing", "reset", lambda pair: pair.unnumbered),
    ("out_of_order", "reset", lambda pair: pair.gap <= 0),
    ("frame_gap", "reset", lambda pair: pair.gap > pair.max_gap),
    ("freeze_detected", "repeated_image", lambda pair: pair.repeats("fingerprint")),
)


class _ColumnPair:
    """A frame and the struct of the one before it, as columns."""

    def __init__(self, first: Column, before: str, max_gap: int):
        self.first, self.max_gap, self._before = first, max_gap, before
        self.gap = F.col("frame_index") - F.col(f"{before}.frame_index")
        self.unnumbered = self.gap.isNull()

    def differs(self, name: str) -> Column:
        return ~F.col(name).eqNullSafe(F.col(f"{self._before}.{name}"))

    def repeats(self, name: str) -> Column:
        return F.coalesce(F.col(name) == F.col(f"{self._before}.{name}"), F.lit(False))


def _rules(rules: list[tuple[Column, str]], last: Column) -> Column:
    chain = F.when(rules[0][0], F.lit(rules[0][1]))
    for condition, name in rules[1:]:
        chain = chain.when(condition, F.lit(name))
    return chain.otherwise(last)


def continuity_on(frames: DataFrame, axis: Axis, max_gap: int = 1, camera: CameraModel | None = None) -> DataFrame:
    """``continuity`` on a prepared axis (keeps the chunk column for further scans)."""
    usable = F.col("modality").isNull() | (F.col("modality") == "rgb")
    if camera is not None:
        frames = frames.where(~usable | ((F.col("width") == camera.width) & (F.col("height") == camera.height)))
    # A frame of another modality wipes the state: what lies before it is not "previous".
    staged = scan(
        frames.withColumn("_usable", usable), axis,
        sums={"_era": F.when(~usable, 1).otherwise(0)},
        before={"_last": F.when(usable, F.struct("frame_id"))},
    )
    # The era of the previous usable frame equals the running era unless a wipe came between.
    staged = scan(staged, axis, before={"_last_era": F.when(F.col("_usable"), F.col("_era"))})
    repeat = F.col("_usable") & (F.col("_last_era") == F.col("_era")) & (F.col("_last.frame_id") == F.col("frame_id"))
    staged = staged.withColumn("_repeat", F.coalesce(repeat, F.lit(False)))
    state = F.struct("_era", "video", "width", "height", "modality", "frame_index", "fingerprint")
    staged = scan(
        staged, axis, before={"_p": F.when(F.col("_usable") & ~F.col("_repeat"), state)}
    )
    p = lambda name: F.col(f"_p.{name}")
    pair = _ColumnPair(F.col("_p").isNull() | (p("_era") != F.col("_era")), "_p", max_gap)
    event = F.when(~F.col("_usable"), "unsupported_modality").when(F.col("_repeat"), "duplicate_frame")
    action = F.when(~F.col("_usable"), "wipe").when(F.col("_repeat"), "duplicate")
    for name, then, test in CONTINUITY:
        event, action = event.when(test(pair), name), action.when(test(pair), then)
    event, action = event.otherwise("continue"), action.otherwise("continue")
    staged = staged.withColumn("event", event).withColumn("action", action)
    starts = F.when(F.col("action").isin("first", "reset"), 1).otherwise(0)
    staged = scan(staged, axis, sums={"segment": starts})
    return staged.drop("_usable", "_era", "_last", "_last_era", "_repeat", "_p")


def continuity(
    frames: DataFrame,
    max_gap: int = 1,
    camera: CameraModel | None = None,
    keys: Sequence[str] = ("session",),
    order: str = "seq",
) -> DataFrame:
    """Add ``event``, ``action`` and the ``segment`` number between resets.

    Rules in order: other modality (wipes), repeat of the frame before, first, changed video,
    shape or modality, missing index, out of order, gap, same picture, continue.
    """
    cut, axis = axis_of(frames, keys, order)
    return continuity_on(cut, axis, max_gap, camera).drop(CHUNK)


def motion_baseline(
    frames: DataFrame,
    policy: DetectionPolicy = DetectionPolicy(),
    keys: Sequence[str] = ("session",),
    order: str = "seq",
) -> DataFrame:
    """The detector's variant, on frames without repeats: is the frame comparable with the one
    before it, how far is warm-up, may its motion be trusted."""
    cut, axis = axis_of(drop_repeats(frames, keys, order), keys, order)
    staged = scan(cut, axis, before={"_p": F.struct("video", "width", "height", "frame_index")})
    p = lambda name: F.col(f"_p.{name}")
    gap = F.col("frame_index") - p("frame_index")
    reason = _rules(
        [
            (F.col("_p").isNull(), "first_frame"),
            (F.col("video") != p("video"), "video_changed"),
            ((F.col("width") != p("width")) | (F.col("height") != p("height")), "shape_changed"),
            (p("frame_index").isNull() | F.col("frame_index").isNull(), "frame_index_missing"),
            (gap <= 0, "out_of_order"),
            (gap > policy.max_frame_gap, "frame_gap"),
        ],
        F.lit("comparable"),
    )
    staged = staged.withColumn("baseline", reason).withColumn("comparable", F.col("baseline") == "comparable")
    restart = ~F.col("baseline").isin("comparable", "first_frame")
    staged = scan(staged, axis, sums={"_restarts": F.when(restart, 1).otherwise(0)})
    staged = scan(staged, axis.within("_restarts"), sums={"warmup": F.lit(1)})
    confident = F.col("comparable") & ~F.col("frozen") & (F.col("warmup") > policy.warmup_frames)
    return staged.withColumn("confident", confident).drop("_p", "_restarts", CHUNK)


def trajectory_on(frames: DataFrame, axis: Axis, policy: NavigationPolicy) -> DataFrame:
    """Add pose columns to frames with ``action`` and ``segment``: yaw is summed first, then each
    step is turned by minus the yaw reached after it."""
    inner = axis.within("segment")
    # A repeated picture is a step without motion; every step counts for warm-up.
    moving = F.col("action").isin("continue", "repeated_image")
    staged = scan(frames, inner, sums={"_step": F.when(moving, 1).otherwise(0)})
    used = (F.col("action") == "continue") & F.col("valid") & (F.col("_step") >= policy.warmup_frames)
    staged = staged.withColumn("motion_used", F.coalesce(used, F.lit(False)))
    amount = lambda c: F.when(F.col("motion_used"), c).otherwise(F.lit(0.0))
    staged = scan(staged, inner, sums={"pose_yaw": amount(F.col("yaw"))})
    cos, sin = F.cos(-F.col("pose_yaw")), F.sin(-F.col("pose_yaw"))
    return scan(
        staged, inner,
        sums={
            "pose_x": amount(cos * F.col("dx") - sin * F.col("dy")),
            "pose_y": amount(sin * F.col("dx") + cos * F.col("dy")),
        },
    ).drop("_step")


def integrate_trajectory(
    frames: DataFrame,
    policy: NavigationPolicy = NavigationPolicy(),
    camera: CameraModel | None = None,
    keys: Sequence[str] = ("session",),
    order: str = "seq",
) -> DataFrame:
    """Continuity, then the pose of every committed frame (wiping frames and repeats drop out)."""
    cut, axis = axis_of(frames, keys, order)
    committed = continuity_on(cut, axis, policy.max_frame_gap, camera).where(
        ~F.col("action").isin("wipe", "duplicate")
    )
    return trajectory_on(committed, axis, policy).drop(CHUNK)
