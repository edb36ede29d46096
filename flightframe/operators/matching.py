"""Reference matching: descriptor correspondences, their spread, validated boxes, confidence."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flightframe.functions.boxes import Box, area, clip
from flightframe.functions.numbers import clamp
from flightframe.operators.greedy import keep_best
from flightframe.operators.overlap import join_meeting_boxes
from flightframe.plans.committed import CommittedTable
from flightframe.plans.settle import settle
from flightframe.policies import MatchingPolicy

_BLOCK, _SLACK = 1024, 1e-9
#: Products of whole blocks differ in their last digits with the block's shape; within this they count as equal.
_TIE = 1e-12


def descriptor_faults(left: DataFrame, right: DataFrame, keys: Sequence[str], vector: str = "embedding") -> DataFrame:
    """Groups whose descriptors cannot be compared, with the first reason in order."""
    keys = list(keys)
    bad = F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    norm = F.aggregate(vector, F.lit(0.0), lambda acc, v: acc + v.cast("double") * v)
    rows = left.select(*keys, vector).unionByName(right.select(*keys, vector))
    folded = rows.groupBy(*keys).agg(
        (F.min(F.size(vector)) != F.max(F.size(vector))).alias("_sizes"),
        F.bool_or(bad).alias("_bad"), F.bool_or(F.sqrt(norm) <= 1e-12).alias("_zero"),
    )
    reason = (
        F.when(F.col("_sizes"), "descriptor_dimension_mismatch").when(F.col("_bad"), "descriptor_non_finite")
        .when(F.col("_zero"), "descriptor_zero_norm")
    )
    return folded.select(*keys, reason.alias("reason")).where(F.col("reason").isNotNull())


def _signs(vector: Column, bits: Column) -> Column:
    """Which side of ``bits`` fixed hyperplanes a vector lies on, as one number: like directions share it more often."""
    spread = lambda j: F.aggregate(
        F.transform(vector, lambda v, i: F.when(F.pmod(F.xxhash64(i, j), F.lit(2)) == 0, v).otherwise(-v).cast("double")), F.lit(0.0), lambda total, x: total + x)
    return F.aggregate(
        F.sequence(F.lit(1), bits), F.lit(0), lambda found, j: F.when(bits == 0, 0).otherwise(found * 2 + F.when(spread(j) > 0, 1).otherwise(0)))


def _blocks(df: DataFrame, keys: list[str], index: str, vector: str, side: str, block: int) -> DataFrame:
    """Rows packed into blocks of at most ``block`` descriptors of like direction, with the block's centre and the
    angle of the descriptor farthest from it (indexes are unique in a group)."""
    sizes = df.groupBy(*keys).agg(F.least(F.lit(12), F.greatest(F.lit(0), F.ceil(F.log2(F.count(F.lit(1)) / F.lit(block))))).cast("int").alias("_bits"))
    dealt = df.join(sizes, keys).withColumn("_side", _signs(F.col(vector), F.col("_bits")))
    counts = dealt.groupBy(*keys, "_side").agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).alias("_pieces"))
    number = F.col("_side").cast("long") * (1 << 32) + F.pmod(F.xxhash64(F.col(index)), F.col("_pieces"))
    entry = F.struct(F.col(index).cast("long").alias("i"), F.col(vector).alias("v"))
    packed = dealt.join(counts, [*keys, "_side"]).groupBy(*keys, number.alias(f"{side}_block")).agg(F.array_sort(F.collect_list(entry)).alias("_r"))
    return packed.select(
        *keys, f"{side}_block", F.transform("_r", lambda r: r["i"]).alias(f"{side}_ids"),
        F.flatten(F.transform("_r", lambda r: r["v"])).cast("array<double>").alias(f"{side}_values"))


def _balls(packed: DataFrame, keys: list[str], side: str) -> DataFrame:
    """Centre (a unit vector) and widest angle of each block."""
    @F.pandas_udf("struct<centre:array<double>,radius:double>")
    def ball(values: pd.Series, sizes: pd.Series) -> pd.DataFrame:
        out = []
        for flat, n in zip(values, sizes):
            rows = np.asarray(flat, float).reshape(n, -1)
            rows = rows / np.linalg.norm(rows, axis=1, keepdims=True)
            centre = rows.mean(axis=0)
            length = np.linalg.norm(centre)
            centre = centre / length if length > 1e-9 else rows[0]
            out.append((centre.tolist(), float(np.arccos(np.clip(rows @ centre, -1, 1)).max())))
        return pd.DataFrame(out, columns=["centre", "radius"])

    told = packed.select(*keys, f"{side}_block", ball(f"{side}_values", F.size(f"{side}_ids")).alias("_b"))
    return told.select(*keys, f"{side}_block", F.col("_b.centre").alias(f"{side}_centre"), F.col("_b.radius").alias(f"{side}_radius"))


def facing_blocks(a: DataFrame, b: DataFrame, keys: Sequence[str], min_similarity: float) -> DataFrame:
    """Pairs of a left and a right block (``l_block``, ``r_block``) and whether they have to meet.

    No pair of descriptors is more alike than the angle between the centres less both radii allows, and none less than with both
    added. So blocks need not meet if that is below the asked similarity, or below what each of the two surely
    finds elsewhere. The bounds are taken a little wider than they are, for rounding.
    """
    keys = list(keys)
    pairs = _balls(a, keys, "l").join(_balls(b, keys, "r"), keys)
    cosine = F.aggregate(F.zip_with("l_centre", "r_centre", lambda x, y: x * y), F.lit(0.0), lambda total, x: total + x)
    angle = F.acos(F.least(F.greatest(cosine, F.lit(-1.0)), F.lit(1.0)))
    both = F.col("l_radius") + F.col("r_radius")
    bounded = pairs.select(*keys, "l_block", "r_block", F.cos(F.greatest(F.lit(0.0), angle - both - _SLACK)).alias("_most"),
                           F.cos(F.least(F.lit(float(np.pi)), angle + both + _SLACK)).alias("_least"))
    bounded = settle(bounded)
    sure = lambda side: bounded.groupBy(*keys, f"{side}_block").agg(F.max("_least").alias(f"_{side}"))
    judged = bounded.join(sure("l"), [*keys, "l_block"]).join(sure("r"), [*keys, "r_block"])
    meets = (F.col("_most") >= min_similarity - _SLACK) & ((F.col("_most") >= F.col("_l")) | (F.col("_most") >= F.col("_r")))
    return judged.select(*keys, "l_block", "r_block", meets.alias("meets"))


def mutual_nearest(
    left: DataFrame, right: DataFrame, keys: Sequence[str], min_similarity: float = 0.45,
    index: str = "patch", vector: str = "embedding", block: int = _BLOCK,
) -> DataFrame:
    """Pairs that are each other's most similar descriptor (cosine) within their group.

    Descriptors are packed into blocks of like direction. Blocks that may hold each other's nearest ones meet once; each
    meeting reports only its best partner per row, so what leaves a task grows with the rows, not with their
    pairs. Equal similarity goes to the lower index. Groups with faulty descriptors give nothing.
    """
    keys = list(keys)
    faults = descriptor_faults(left, right, keys, vector).select(*keys)
    a = settle(_blocks(left.join(faults, keys, "left_anti"), keys, index, vector, "l", block))
    b = settle(_blocks(right.join(faults, keys, "left_anti"), keys, index, vector, "r", block))
    # Block ids pair up first and the packed rows join by block, so no task holds a whole group.
    pairs = facing_blocks(a, b, keys, min_similarity).where("meets").drop("meets")
    met = pairs.join(a, [*keys, "l_block"]).join(b, [*keys, "r_block"])
    fields = [f for f in left.schema.fields if f.name in keys]
    schema = T.StructType(
        [*sorted(fields, key=lambda f: keys.index(f.name)), T.StructField("own_left", T.BooleanType()),
         T.StructField("own", T.LongType()), T.StructField("other", T.LongType()), T.StructField("similarity", T.DoubleType())]
    )

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                group = [getattr(row, k) for k in keys]
                yield _best_partners(group, row.l_ids, row.l_values, row.r_ids, row.r_values, schema.names)

    partners = met.select(*keys, "l_ids", "l_values", "r_ids", "r_values").mapInPandas(best, schema)
    order = F.struct("similarity", (-F.col("other")).alias("o"))
    tops = partners.groupBy(*keys, "own_left", "own").agg(
        F.max_by("other", order).alias("other"), F.max("similarity").alias("similarity")
    )
    tops = settle(tops)
    lefts = tops.where("own_left").select(*keys, F.col("own").alias("l"), F.col("other").alias("r"), "similarity")
    rights = tops.where(~F.col("own_left")).select(*keys, F.col("own").alias("r"), F.col("other").alias("l"))
    return lefts.join(rights, [*keys, "l", "r"]).where(F.col("similarity") >= min_similarity)


def _best_partners(group, left_ids, left_values, right_ids, right_values, names) -> pd.DataFrame:
    left_ids, right_ids = np.asarray(left_ids), np.asarray(right_ids)
    a = np.asarray(left_values, dtype=np.float64).reshape(len(left_ids), -1)
    b = np.asarray(right_values, dtype=np.float64).reshape(len(right_ids), -1)
    a = a / np.linalg.norm(a, axis=1, keepdims=True)
    b = b / np.linalg.norm(b, axis=1, keepdims=True)
    similarity = a @ b.T
    to_right = (similarity >= similarity.max(axis=1, keepdims=True) - _TIE).argmax(axis=1)
    to_left = (similarity >= similarity.max(axis=0) - _TIE).argmax(axis=0)
    n, m = len(left_ids), len(right_ids)
    # Summed pair by pair, so that equal descriptors are equally similar in whatever blocks they lie.
    alike = lambda i, j: (a[i] * b[j]).sum(axis=1)
    columns = {name: [value] * (n + m) for name, value in zip(names, group)}
    columns["own_left"] = np.r_[np.ones(n, bool), np.zeros(m, bool)]
    columns["own"] = np.r_[left_ids, right_ids]
    columns["other"] = np.r_[right_ids[to_right], left_ids[to_left]]
    columns["similarity"] = np.r_[alike(np.arange(n), to_right), alike(to_left, np.arange(m))]
    return pd.DataFrame(columns, columns=list(names))


def patch_to_pixel(index: Column, grid_width: Column, patch: Column, scale_x: Column, scale_y: Column) -> tuple[Column, Column]:
    """Pixel centre of a patch in the unscaled picture."""
    row, column = F.floor(index / grid_width), index % grid_width
    return (column + 0.5) * patch / scale_x, (row + 0.5) * patch / scale_y


def spatial_dedup(
    points: DataFrame, keys: Sequence[str], policy: MatchingPolicy = MatchingPolicy(), rows: int | None = None
) -> DataFrame:
    """Correspondences ``(l, lx, ly, rx, ry, similarity)`` by falling similarity, without those
    nearer than the radius to a kept one on either side; then at most ``max_correspondences``."""
    keys, radius = list(keys), policy.dedup_radius_px
    squared = radius * radius
    near = lambda a, b, x, y: (a[x] - b[x]) * (a[x] - b[x]) + (a[y] - b[y]) * (a[y] - b[y]) < squared
    clash = lambda a, b: near(a, b, "lx", "ly") | near(a, b, "rx", "ry")

    def clashes(large: DataFrame) -> DataFrame:
        found = None
        for x, y in (("lx", "ly"), ("rx", "ry")):
            one = large.select(*keys, F.col("l").alias("a"), F.col(x).alias("ax"), F.col(y).alias("ay"))
            two = large.select(*keys, F.col("l").alias("b"), F.col(x).alias("bx"), F.col(y).alias("by"))
            square = Box(F.col("ax") - radius, F.col("ay") - radius, F.col("ax") + radius, F.col("ay") + radius)
            point = Box(F.col("bx"), F.col("by"), F.col("bx"), F.col("by"))
            apart = (F.col("ax") - F.col("bx")) * (F.col("ax") - F.col("bx")) + (F.col("ay") - F.col("by")) * (F.col("ay") - F.col("by"))
            pairs = join_meeting_boxes(one, two, keys, square, point, salt_by=["a"], cell_px=max(4 * radius, 16.0))
            pairs = pairs.where((F.col("a") != F.col("b")) & (apart < squared)).select(*keys, "a", "b")
            found = pairs if found is None else found.unionByName(pairs)
        return found.distinct()

    if radius > 0:
        kept = keep_best(points, keys, "l", -F.col("similarity"), clash, ["lx", "ly", "rx", "ry"], clashes, rows)
        points = points.join(kept, [*keys, "l"], "left_semi")
    first = Window.partitionBy(*keys).orderBy(F.desc("similarity"), F.asc("l"))
    return points.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= policy.max_correspondences).drop("_n")


def correspondence_stats(points: DataFrame, keys: Sequence[str], policy: MatchingPolicy = MatchingPolicy()) -> DataFrame:
    """Similarity statistics per group (at most ``max_correspondences`` rows each)."""
    s = F.col("similarity")
    return points.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("correspondence_count"), F.avg(s).alias("mean_similarity"),
        F.percentile(s, F.lit(0.5)).alias("median_similarity"),
        F.min(s).alias("min_similarity"), F.max(s).alias("max_similarity"),
    ).withColumn(
        "reason", F.when(F.col("correspondence_count") < policy.min_correspondences, "below_minimum_correspondences")
    )


def _hull(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Corner points of the convex hull, as an (n, 2) array."""
    points = np.unique(np.column_stack([x, y]), axis=0)
    if len(points) < 3:
        return points

    def chain(ordered: list[list[float]]) -> list[list[float]]:
        kept: list[list[float]] = []
        for p in ordered:
            while len(kept) > 1 and (kept[-1][0] - kept[-2][0]) * (p[1] - kept[-1][1]) <= (kept[-1][1] - kept[-2][1]) * (p[0] - kept[-1][0]):
                kept.pop()
            kept.append(p)
        return kept[:-1]

    listed = points.tolist()
    return np.array(chain(listed) + chain(listed[::-1]))


def hull_area(points: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Area of the convex hull of each group's points.

    Hulls merge: every batch keeps only its own corners before the shuffle, salted parts of a
    group are merged next, and the last step sees a few corners per group.
    """
    keys = list(keys)
    fields = [f for f in points.schema.fields if f.name in keys]
    corner = T.StructType([*fields, T.StructField("_x", T.DoubleType()), T.StructField("_y", T.DoubleType()), T.StructField("_salt", T.IntegerType())])

    def corners(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for number, batch in enumerate(batches):
            if len(batch) == 0:
                continue
            parts = []
            for group, part in batch.groupby([f.name for f in fields], sort=False):
                hull = _hull(part["_x"].to_numpy(), part["_y"].to_numpy())
                values = {f.name: [v] * len(hull) for f, v in zip(fields, group)}
                parts.append(pd.DataFrame({**values, "_x": hull[:, 0], "_y": hull[:, 1], "_salt": number % 256}))
            yield pd.concat(parts)[corner.names]

    known = points.select(*[f.name for f in fields], F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")).dropna(subset=["_x", "_y"])
    local = known.mapInPandas(corners, corner).withColumn("_salt", F.pmod(F.col("_salt") + F.spark_partition_id(), F.lit(256)))

    @F.pandas_udf("array<struct<x:double,y:double>>")
    def merged(xs: pd.Series, ys: pd.Series) -> pd.Series:
        return pd.Series([[{"x": float(a), "y": float(b)} for a, b in _hull(p, q)] for p, q in zip(xs, ys)])

    @F.pandas_udf("double")
    def covered(xs: pd.Series, ys: pd.Series) -> pd.Series:
        out = []
        for p, q in zip(xs, ys):
            hull = _hull(p, q)
            a, b = hull[:, 0], hull[:, 1]
            out.append(abs(a @ np.roll(b, -1) - b @ np.roll(a, -1)) / 2 if len(hull) > 2 else 0.0)
        return pd.Series(out, dtype=float)

    lists = lambda df, by: df.groupBy(*by).agg(F.collect_list(F.struct("_x", "_y")).alias("_l"))
    part = lists(local, [*keys, "_salt"]).select(*keys, F.inline(merged("_l._x", "_l._y"))).withColumnsRenamed({"x": "_x", "y": "_y"})
    return lists(part, keys).select(*keys, covered("_l._x", "_l._y").alias("hull_area"))


def hull_coverage(
    points: DataFrame, keys: Sequence[str], left: tuple[str, str], right: tuple[str, str],
    left_area: float, right_area: float, few: float | None = 0.0,
) -> DataFrame:
    """Smaller of the two hull shares; groups under three points get ``few`` (0 or null)."""
    keys = list(keys)
    points = settle(points)
    sizes = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("points"))
    a = hull_area(points, keys, *left).withColumnRenamed("hull_area", "left_hull")
    b = hull_area(points, keys, *right).withColumnRenamed("hull_area", "right_hull")
    share = F.least(F.col("left_hull") / left_area, F.col("right_hull") / right_area)
    value = F.when(F.col("points") < 3, F.lit(few).cast("double")).otherwise(clamp(share, 0.0, 1.0))
    return sizes.join(a, keys, "left").join(b, keys, "left").withColumn("coverage", value)


def validate_projected_box(b: Box, width: Column, height: Column, policy: MatchingPolicy = MatchingPolicy()) -> tuple[Box, Column]:
    """Clipped box of a projected polygon and why it fails, or null."""
    inside = clip(b, width, height)
    size = inside.width * inside.height
    reason = (
        F.when(
            (inside.width < policy.box_min_width) | (inside.height < policy.box_min_height) | (size < policy.box_min_area),
            "bbox_too_small",
        )
        .when((inside.x2 <= inside.x1) | (inside.y2 <= inside.y1), "bbox_empty")
        .when(size > width * height * policy.box_max_frame_ratio, "bbox_too_large")
    )
    return inside, reason


def validate_scored_box(b: Box, width: Column, height: Column, conf: Column, policy: MatchingPolicy = MatchingPolicy()) -> tuple[Box, Column]:
    inside = clip(b, width, height)
    size = area(inside)
    good = (
        conf.between(policy.min_confidence, 1.0) & (inside.x2 > inside.x1) & (inside.y2 > inside.y1)
        & (size >= policy.box_min_area) & (size <= width * height * policy.box_max_frame_ratio)
    )
    return inside, F.coalesce(good, F.lit(False))


def clip_best_box(b: Box, width: Column, height: Column, conf: Column) -> tuple[Box, Column, Column]:
    """Clipped box with at least one pixel each way, and a confidence held to [0, 1]."""
    inside = clip(b, width, height)
    good = (inside.width >= 1.0) & (inside.height >= 1.0)
    return inside, F.coalesce(good, F.lit(False)), clamp(conf, 0.0, 1.0)


def match_confidence(
    inlier_ratio: Column, mean_similarity: Column, median_similarity: Column, rms: Column, visible: Column,
    coverage: Column, policy: MatchingPolicy = MatchingPolicy(),
) -> Column:
    """Weighted mean of five scores in [0, 1]; null below the minimum."""
    middle = (mean_similarity + median_similarity) / 2.0
    parts = (
        (policy.weight_inlier, inlier_ratio),
        (policy.weight_similarity, clamp((middle - policy.min_similarity) / max(1e-9, 1.0 - policy.min_similarity), 0.0, 1.0)),
        (policy.weight_reprojection, clamp(1.0 - rms / policy.max_rms, 0.0, 1.0)),
        (policy.weight_visibility, clamp(visible, 0.0, 1.0)),
        (policy.weight_coverage, clamp(F.sqrt(coverage / 0.25), 0.0, 1.0)),
    )
    total = F.lit(0.0)
    for weight, value in parts:
        total = total + weight * value
    score = clamp(total / sum(weight for weight, _ in parts), 0.0, 1.0)
    return F.when(score >= policy.min_confidence, score)


def best_per_object(matches: DataFrame, keys: Sequence[str], tie: str) -> DataFrame:
    """The most confident match per key; a missing confidence counts as zero and the first of
    equal ones stays."""
    rest = [c for c in matches.columns if c not in keys]
    order = F.struct(F.coalesce("confidence", F.lit(0.0)), -F.col(tie))
    return matches.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_b")).select(*keys, "_b.*")


def inlier_box(points: DataFrame, keys: Sequence[str], angle: str, width: float, height: float, min_inliers: int = 8, rows: int | None = None) -> DataFrame:
    """Box of the middle 90 % of the inliers of the best rotation, grown by 20 px."""
    from flightframe.plans.percentiles import grouped_percentiles

    keys = list(keys)
    counts = points.groupBy(*keys, angle).agg(
        F.sum(F.col("inlier").cast("long")).alias("inliers"), F.count(F.lit(1)).alias("matches")
    ).where(F.col("inliers") >= min_inliers)
    best = counts.groupBy(*keys).agg(
        F.max_by(F.struct(angle, "inliers", "matches"), F.struct("inliers", -F.col(angle))).alias("b")
    ).select(*keys, "b.*")
    chosen = settle(points.where("inlier").join(best, [*keys, angle]))
    tails = grouped_percentiles(chosen, keys, {"_x": F.col("x"), "_y": F.col("y")}, [0.05, 0.95], rows)
    at = lambda c, i: F.get(c, F.lit(i))
    return best.join(tails, keys).select(
        *keys, angle, "inliers",
        F.greatest(F.lit(0.0), at("_x", 0) - 20).alias("x1"), F.greatest(F.lit(0.0), at("_y", 0) - 20).alias("y1"),
        F.least(F.lit(width), at("_x", 1) + 20).alias("x2"), F.least(F.lit(height), at("_y", 1) + 20).alias("y2"),
        F.least(F.lit(1.0), F.col("inliers") / 30.0).alias("confidence"),
        (F.col("inliers") / F.greatest(F.col("matches"), F.lit(1))).alias("inlier_ratio"),
    )


def threshold_observations(rows: DataFrame, key: Sequence[str], policy: MatchingPolicy = MatchingPolicy()) -> DataFrame:
    """Measured value, threshold, operator and outcome of each gate, one row per gate."""
    specs = (
        ("minimum_similarity", "similarity_min", policy.min_similarity, ">="),
        ("correspondence_count", "correspondence_count", policy.min_correspondences, ">="),
        ("inlier_count", "inlier_count", policy.min_inliers, ">="),
        ("inlier_ratio", "inlier_ratio", policy.min_inlier_ratio, ">="),
        ("rms_reprojection_error", "rms", policy.max_rms, "<="),
        ("visible_ratio", "visible_ratio", policy.min_visible_ratio, ">="),
        ("confidence", "confidence", policy.min_confidence, ">="),
    )
    entries = [
        F.struct(
            F.lit(name).alias("gate"), F.col(column).cast("double").alias("measured"),
            F.lit(float(threshold)).alias("threshold"), F.lit(op).alias("operator"),
        )
        for name, column, threshold, op in specs
    ]
    long = rows.select(*key, F.explode(F.array(*entries)).alias("_e")).select(*key, "_e.*")
    passed = F.when(F.col("operator") == ">=", F.col("measured") >= F.col("threshold")).otherwise(
        F.col("measured") <= F.col("threshold")
    )
    return long.withColumn("passed", F.coalesce(passed, F.lit(False)))


def missing_descriptors(catalog: DataFrame, stored: DataFrame) -> DataFrame:
    """Pictures whose (content, model) descriptors are not there yet, each content once."""
    keys = ["content_hash", "model_hash"]
    wanted = catalog.groupBy(*keys).agg(F.min("object_id").alias("object_id"), F.count(F.lit(1)).alias("copies"))
    return wanted.join(stored.select(*keys), keys, "left_anti")


class DescriptorStore:
    """Descriptors by content and model, appended in parts and never computed twice.

    ``schema`` are the columns of a descriptor's rows, with ``content_hash`` and ``model_hash``. An append that is
    interrupted leaves nothing that readers see, and is made anew by the next one.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: T.StructType) -> None:
        self.table, self.schema = CommittedTable(spark, folder), schema

    def stored(self) -> DataFrame:
        return self.table.rows(self.schema)

    def add(self, catalog: DataFrame, compute: Callable[[DataFrame], DataFrame]) -> int:
        """Append what ``compute`` makes of the pictures not stored yet (``content_hash``, ``model_hash``, ``object_id``,
        ``copies``), and how many these were. ``compute`` is not called without any."""
        known = self.stored().select("content_hash", "model_hash").distinct()
        missing = settle(missing_descriptors(catalog, known))
        count = missing.count()
        if count:
            part = max(self.table.parts(), default=-1) + 1
            self.table.write(compute(missing).select(*[f.name for f in self.schema.fields]), part)
            self.table.commit(part)
        return count
