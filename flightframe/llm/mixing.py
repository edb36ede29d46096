"""Mixing annotated frames of several videos to target weights."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flightframe.llm.store import column, written
from flightframe.llm.text import word_count


@dataclass(frozen=True)
class MixPolicy:
    """``weights`` go round over the videos in the order of their names, null last; the mix has
    ``percent`` of all words, a video at most ``most`` times its own."""

    weights: tuple[int, ...] = (3, 1, 2)
    percent: int = 150
    most: int = 2
    seed: str = "mix-1"

    def __post_init__(self) -> None:
        if not self.weights or min(self.weights) < 1 or not 0 <= self.percent <= 100 * self.most:
            raise ValueError("weights must be positive, and the mix must fit below the bound")


MIX = MixPolicy()


def video_targets(sizes: DataFrame, policy: MixPolicy = MIX) -> DataFrame:
    """(``video``, ``video_size``, ``target``) from (``video``, ``size``).

    Sharing by weight with a bound levels out at one rate per weight: the videos whose bound is
    lowest for their weight take it, all others get the same rate on what remains. One row per
    video is left after the combined sum, and running sums over these give that rate.
    """
    totals = sizes.groupBy("video").agg(F.sum("size").alias("video_size"))
    named = Window.orderBy(F.col("video").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in policy.weights]), ((F.row_number().over(named) - 1) % len(policy.weights) + 1).cast("int"))
    bound = F.col("video_size") * policy.most
    by_bound = Window.orderBy(bound / F.col("weight"), F.col("video").asc_nulls_last())
    before = by_bound.rowsBetween(Window.unboundedPreceding, -1)
    from_here = by_bound.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("video_size").over(everything) * policy.percent - F.coalesce(F.sum("video_size").over(before), F.lit(0)) * policy.most * 100
    staged = totals.withColumn("weight", weight).select(
        "video", "video_size", "weight", bound.alias("bound"), F.row_number().over(by_bound).alias("place"),
        left.alias("left"), (F.sum("weight").over(from_here) * 100).alias("share"))
    fits = F.col("weight") * F.col("left") <= F.col("bound") * F.col("share")
    level = F.min(F.when(fits, F.struct("place", "left", "share"))).over(everything)
    return staged.withColumn("level", level).select(
        "video", "video_size",
        F.when(F.col("place") < F.col("level.place"), F.col("bound").cast("double"))
        .otherwise((F.col("weight") * F.col("level.left")).cast("double") / F.col("level.share")).alias("target"))


def chance(key: Column, seed: str) -> Column:
    """A number in [0, 1) that depends on the key and the seed only."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def mix_copies(frames: DataFrame, frame: str = "frame_id", video: str = "video", xml: str = "xml", policy: MixPolicy = MIX) -> DataFrame:
    """How often each annotated frame enters the mix.

    A video's words are summed, its target divided by them is its repetition rate; each frame is
    taken floor(rate) times, and once more with a chance of the rate's fraction, drawn from a hash
    of its id. Returns ``frame_id``, ``video``, ``size`` (words of the annotation), ``video_size``, ``target``, ``copies``, ``taken``.

    A null or blank annotation has size 0; frames without video form one; a video without words has
    target and rate 0. Rows with the same id are drawn alike and each counts; rows with a
    null id are drawn as the empty id. Other columns are ignored. An empty table gives an empty result.
    """
    sized = written(frames.select(
        column(frame).alias("frame_id"), column(video).alias("video"), word_count(column(xml).cast("string")).alias("size")))
    targets = video_targets(sized, policy).withColumnRenamed("video", "named")
    rate = F.when(F.col("video_size") > 0, F.col("target") / F.col("video_size")).otherwise(F.lit(0.0))
    copies = F.floor("rate") + F.when(chance(F.col("frame_id"), policy.seed) < F.col("rate") - F.floor("rate"), 1).otherwise(0)
    return (
        sized.join(targets, F.col("video").eqNullSafe(F.col("named"))).withColumn("rate", rate)
        .withColumn("copies", copies.cast("long"))
        .select("frame_id", "video", "size", "video_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))
    )


def mixed_frames(frames: DataFrame, frame: str = "frame_id", video: str = "video", xml: str = "xml", policy: MixPolicy = MIX) -> DataFrame:
    """The mix itself: each row of ``frames`` as often as its copies, with ``mix_copy`` counting from 1."""
    size = word_count(column(xml).cast("string")).alias("size")
    sized = written(frames.select(column(video).alias("video"), size).groupBy("video").agg(F.sum("size").alias("size")))
    targets = video_targets(sized, policy).select(
        F.struct(F.col("video")).alias("_named"),
        F.when(F.col("video_size") > 0, F.col("target") / F.col("video_size")).otherwise(F.lit(0.0)).alias("_rate"))
    copies = F.floor("_rate") + F.when(chance(column(frame), policy.seed) < F.col("_rate") - F.floor("_rate"), 1).otherwise(0)
    joined = frames.join(targets, column(video).eqNullSafe(F.col("_named.video"))).withColumn("_copies", copies.cast("int")).where("_copies > 0")
    return joined.select(*[column(c) for c in frames.columns], F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("mix_copy"))
