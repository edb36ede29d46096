"""Reference matching, candidate boxes and their merging."""

from __future__ import annotations

from pyspark.sql import functions as F

from flightframe.catalog import folds, query
from flightframe.catalog.motion import detections
from flightframe.catalog.shared import DET, FRAME_H, FRAME_W, ctes, rounded, size, view
from flightframe.functions.boxes import box
from flightframe.operators import matching as M
from flightframe.operators import references as R
from flightframe.operators import regions as G
from flightframe.policies import MatchingPolicy
from flightframe.streaming.tracks import track_gate

SIMILARITY = 0.2
POLICY = MatchingPolicy(min_correspondences=3, dedup_radius_px=20.0)


def windows(spark, sf_dir):
    return view(spark, sf_dir, "v_windows").where("active_until is null or active_from is null or active_until >= active_from")


_ACTIVE = """(active_from is null and active_until is null) or (frame_index is not null and (active_from is null or frame_index >= active_from) and (active_until is null or frame_index <= active_until))"""


@query("active_references", ctes("v_frames", "v_windows") + f" select f.session, f.seq, w.object_id from v_frames f join v_windows w on f.session = w.session where {_ACTIVE}")
def active_references(spark, sf_dir):
    frames = view(spark, sf_dir, "v_frames").select("session", "seq", "frame_index")
    return R.active_references(frames, view(spark, sf_dir, "v_windows")).select("session", "seq", "object_id")


def _named_matches(spark, sf_dir):
    known = spark.range(20).select(F.col("id").alias("object_id"), F.concat(F.lit("http://host/references/"), F.col("id").cast("string"), F.lit("/")).alias("official_url"))
    return R.reference_urls(view(spark, sf_dir, "v_matches").select("doc_id", (F.col("doc_id") % 23).alias("object_id")), known)


@query("reference_urls", ctes("v_matches") + " select doc_id, 'http://host/references/' || (doc_id % 23) || '/' as official_url from v_matches where doc_id % 23 < 20")
def reference_urls(spark, sf_dir):
    return _named_matches(spark, sf_dir)[0].select("doc_id", "official_url")


@query("reference_urls_unknown", ctes("v_matches") + " select doc_id, doc_id % 23 as object_id from v_matches where doc_id % 23 >= 20")
def reference_urls_unknown(spark, sf_dir):
    return _named_matches(spark, sf_dir)[1].select("doc_id", "object_id")


@query(
    "evaluation_pairs",
    ctes("v_matches") + ", r as (select distinct reference_id from v_matches), p as (select r.reference_id, m.frame_name, t.expected from v_matches m cross join r left join v_matches t on t.reference_id = r.reference_id and t.frame_name = m.frame_name) select reference_id, count(*) as pairs, count(expected) as with_truth, count(*) filter (where expected = '1') as positives from p group by reference_id",
)
def evaluation_pairs(spark, sf_dir):
    m = view(spark, sf_dir, "v_matches").select("reference_id", "frame_name", "expected")
    pairs = R.evaluation_pairs(m, m.select("frame_name"), m)
    return pairs.groupBy("reference_id").agg(F.count(F.lit(1)).alias("pairs"), F.count("expected").alias("with_truth"), F.count(F.when(F.col("expected") == "1", 1)).alias("positives"))


@query(
    "truth_resolution",
    ctes("v_matches") + " select reference_id, frame_name, expected, doc_id % 23 < 15 as reference_resolved, doc_id % 3 <> 0 as frame_resolved, doc_id % 2 = 0 as frame_changed from v_matches",
)
def truth_resolution(spark, sf_dir):
    m = view(spark, sf_dir, "v_matches")
    spaced = F.when(F.col("doc_id") % 2 == 0, F.concat(F.col("frame_name"), F.lit(" "))).otherwise(F.col("frame_name"))
    found = R.truth_resolution(
        m.select("reference_id", spaced.alias("frame_name"), "expected"), m.where("doc_id % 23 < 15").select("reference_id"),
        m.where("doc_id % 3 <> 0").select("frame_name"), F.trim,
    )
    return found.select("reference_id", F.col("frame").alias("frame_name"), "expected", "reference_resolved", "frame_resolved", "frame_changed")


def correspondences(spark, sf_dir):
    p = view(spark, sf_dir, "v_patches")
    return M.mutual_nearest(p.where("side = 0"), p.where("side = 1"), ["pair"], SIMILARITY, block=16)


_NEAR = ctes("v_patches") + f""", d as (select pair, side, patch, embedding::double[] as e from v_patches), s as (select a.pair, a.patch as l, b.patch as r, list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) as similarity from d a join d b on a.pair = b.pair and a.side = 0 and b.side = 1),
x as (select *, row_number() over (partition by pair, l order by similarity desc, r) as nl, row_number() over (partition by pair, r order by similarity desc, l) as nr from s), mn as (select pair, l, r, similarity from x where nl = 1 and nr = 1 and similarity >= {SIMILARITY})"""


@query("mutual_nearest", f"{_NEAR} select pair, l, r, round(similarity, 6) as similarity from mn")
def mutual_nearest(spark, sf_dir):
    return rounded(correspondences(spark, sf_dir))


@query("correspondence_stats", f"{_NEAR} select pair, count(*) as correspondence_count, round(avg(similarity), 6) as mean_similarity, round(median(similarity), 6) as median_similarity, round(min(similarity), 6) as min_similarity, round(max(similarity), 6) as max_similarity, case when count(*) < 3 then 'below_minimum_correspondences' end as reason from mn group by pair")
def correspondence_stats(spark, sf_dir):
    return rounded(M.correspondence_stats(correspondences(spark, sf_dir), ["pair"], POLICY))


def placed(spark, sf_dir):
    """Correspondences at their pixel centres in 8 x 8 grids of 14 px patches."""
    c = correspondences(spark, sf_dir)
    one = lambda i: M.patch_to_pixel(F.col(i), F.lit(8), F.lit(14), F.lit(1.0), F.lit(0.5))
    (lx, ly), (rx, ry) = one("l"), one("r")
    return c.select("pair", "l", "r", "similarity", lx.alias("lx"), ly.alias("ly"), rx.alias("rx"), ry.alias("ry"))


@query("patch_pixels", f"{_NEAR} select pair, l, r, (l % 8 + 0.5e0) * 14 as lx, (floor(l / 8e0) + 0.5e0) * 14 / 0.5e0 as ly, (r % 8 + 0.5e0) * 14 as rx, (floor(r / 8e0) + 0.5e0) * 14 / 0.5e0 as ry from mn")
def patch_pixels(spark, sf_dir):
    return placed(spark, sf_dir).drop("similarity")


_PLACED = f"{_NEAR}, placed as (select pair, l, r, similarity, (l % 8 + 0.5e0) * 14 as lx, (floor(l / 8e0) + 0.5e0) * 14 / 0.5e0 as ly, (r % 8 + 0.5e0) * 14 as rx, (floor(r / 8e0) + 0.5e0) * 14 / 0.5e0 as ry from mn)"


@query("spatial_dedup", folds.deduplicated(_PLACED, POLICY.dedup_radius_px))
def spatial_dedup(spark, sf_dir):
    return rounded(M.spatial_dedup(placed(spark, sf_dir), ["pair"], POLICY))


@query("hull_coverage", folds.hulls(_PLACED, (112.0 * 224.0, 112.0 * 224.0)))
def hull_coverage(spark, sf_dir):
    return rounded(M.hull_coverage(placed(spark, sf_dir), ["pair"], ("lx", "ly"), ("rx", "ry"), 112.0 * 224.0, 112.0 * 224.0).select("pair", "points", "coverage"))


@query(
    "projected_boxes_validated",
    f"""{DET} select frame, det_index, case when cx2 - cx1 < 12 or cy2 - cy1 < 12 or (cx2 - cx1) * (cy2 - cy1) < 300 then 'bbox_too_small' when (cx2 - cx1) * (cy2 - cy1) > {FRAME_W * FRAME_H} * 0.05 then 'bbox_too_large' end as reason from det""",
)
def projected_boxes_validated(spark, sf_dir):
    _, reason = M.validate_projected_box(box(), *size(), MatchingPolicy(box_min_width=12.0, box_min_height=12.0, box_min_area=300.0, box_max_frame_ratio=0.05))
    return detections(spark, sf_dir).select("frame", "det_index", reason.alias("reason"))


@query(
    "scored_boxes_validated",
    f"""{DET} select frame, det_index, (conf >= 0.35 and (cx2 - cx1) * (cy2 - cy1) >= 64 and (cx2 - cx1) * (cy2 - cy1) <= {FRAME_W * FRAME_H} * 0.05) as scored_ok, (cx2 - cx1 >= 1 and cy2 - cy1 >= 1) as best_ok, least(1, conf * 2) as best_conf from det""",
)
def scored_boxes_validated(spark, sf_dir):
    _, good = M.validate_scored_box(box(), *size(), F.col("conf"), MatchingPolicy(box_max_frame_ratio=0.05))
    _, best, conf = M.clip_best_box(box(), *size(), F.col("conf") * 2)
    return detections(spark, sf_dir).select("frame", "det_index", good.alias("scored_ok"), best.alias("best_ok"), conf.alias("best_conf"))


@query(
    "match_confidences",
    ctes("v_matches") + """, c as (select doc_id, 0.3 * inlier_ratio + 0.25 * least(1, greatest(0, (similarity_mean - 0.45) / 0.55)) + 0.15 * least(1, greatest(0, 1 - rms / 8)) + 0.15 * visible_ratio + 0.15 * least(1, sqrt(correspondence_count / 1e2 / 0.25)) as s
  from v_matches where inlier_ratio is not null and similarity_mean is not null and rms is not null and visible_ratio is not null) select doc_id, case when s >= 0.35 then round(s, 6) end as confidence from c""",
)
def match_confidences(spark, sf_dir):
    m = view(spark, sf_dir, "v_matches").dropna(subset=["inlier_ratio", "similarity_mean", "rms", "visible_ratio"])
    score = M.match_confidence(F.col("inlier_ratio"), F.col("similarity_mean"), F.col("similarity_mean"), F.col("rms"), F.col("visible_ratio"), F.col("correspondence_count") / 100)
    return rounded(m.select("doc_id", score.alias("confidence")))


@query(
    "best_per_object",
    ctes("v_matches") + " select reference_id, stage, doc_id, confidence from (select *, row_number() over (partition by reference_id, stage order by coalesce(confidence, 0) desc, doc_id) as n from v_matches) z where n = 1",
)
def best_per_object(spark, sf_dir):
    m = view(spark, sf_dir, "v_matches").select("reference_id", "stage", "doc_id", "confidence")
    return M.best_per_object(m, ["reference_id", "stage"], "doc_id")


_OBS = (("minimum_similarity", "similarity_mean", 0.45, ">="), ("correspondence_count", "correspondence_count", 6.0, ">="), ("inlier_count", "inl", 6.0, ">="), ("inlier_ratio", "inlier_ratio", 0.35, ">="),
        ("rms_reprojection_error", "rms", 8.0, "<="), ("visible_ratio", "visible_ratio", 0.25, ">="), ("confidence", "confidence", 0.35, ">="))


@query(
    "threshold_observations",
    ctes("v_matches") + ", i as (select *, doc_id % 13 as inl from v_matches) " + " union all ".join(
        f"select doc_id, '{n}' as gate, cast({c} as double) as measured, cast({t} as double) as threshold, '{o}' as operator, coalesce({c} {o} {t}, false) as passed from i" for n, c, t, o in _OBS
    ),
)
def threshold_observations(spark, sf_dir):
    m = view(spark, sf_dir, "v_matches").withColumn("inlier_count", F.col("doc_id") % 13).withColumnRenamed("similarity_mean", "similarity_min")
    return M.threshold_observations(m, ["doc_id"])


_INLIERS = f"""{DET}, p as (select frame % 50 as pair, det_index, (det_index % 8) * 45 as angle, cx1 as x, cy1 as y, conf >= 0.5 as inlier from det), c as (select pair, angle, count(*) filter (where inlier) as inliers, count(*) as matches from p group by pair, angle having count(*) filter (where inlier) >= 8),
b as (select * from (select *, row_number() over (partition by pair order by inliers desc, angle) as n from c) z where n = 1)"""


@query(
    "inlier_boxes",
    f"""{_INLIERS} select b.pair, b.angle, any_value(inliers) as inliers, round(greatest(0, quantile_cont(x, 0.05) - 20), 6) as x1, round(greatest(0, quantile_cont(y, 0.05) - 20), 6) as y1, round(least({FRAME_W}, quantile_cont(x, 0.95) + 20), 6) as x2, round(least({FRAME_H}, quantile_cont(y, 0.95) + 20), 6) as y2,
  round(least(1, any_value(inliers) / 30e0), 6) as confidence, round(any_value(inliers) * 1e0 / any_value(matches), 6) as inlier_ratio from b join p on b.pair = p.pair and b.angle = p.angle where inlier group by b.pair, b.angle""",
)
def inlier_boxes(spark, sf_dir):
    p = detections(spark, sf_dir).select((F.col("frame") % 50).alias("pair"), ((F.col("det_index") % 8) * 45).alias("angle"), F.col("cx1").alias("x"), F.col("cy1").alias("y"), (F.col("conf") >= 0.5).alias("inlier"))
    return rounded(M.inlier_box(p, ["pair"], "angle", float(FRAME_W), float(FRAME_H)))


def candidates(spark, sf_dir):
    d = detections(spark, sf_dir)
    return d.select("frame", F.col("det_index").alias("box_id"), F.col("cx1").alias("x1"), F.col("cy1").alias("y1"), F.col("cx2").alias("x2"), F.col("cy2").alias("y2"), "conf", (F.col("conf") * 2.2).alias("peak"))


@query("boxes_kept", folds.suppressed(False))
def boxes_kept(spark, sf_dir):
    return rounded(G.nms(candidates(spark, sf_dir), ["frame"]))


@query("boxes_kept_uncontained", folds.suppressed(True))
def boxes_kept_uncontained(spark, sf_dir):
    return rounded(G.nms(candidates(spark, sf_dir), ["frame"], contain_above=0.70))


@query("boxes_chained", folds.chained(90.0))
def boxes_chained(spark, sf_dir):
    return rounded(G.chain_merge(candidates(spark, sf_dir).select("frame", "box_id", "x1", "y1", "x2", "y2", "conf"), ["frame"]))


@query("boxes_agreed", folds.agreed())
def boxes_agreed(spark, sf_dir):
    second = view(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("frame"), (F.col("o_custkey") % 300).cast("double").alias("x1"), (F.col("o_custkey") % 200).cast("double").alias("y1"),
        (F.col("o_custkey") % 300 + 150).cast("double").alias("x2"), (F.col("o_custkey") % 200 + 150).cast("double").alias("y2"),
    )
    return rounded(G.agree_and_merge(candidates(spark, sf_dir), second, ["frame"]))


def _dot(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda total, x: total + x)


def _cosine(a, b):
    length = lambda v: F.greatest(F.sqrt(_dot(v, v)), F.lit(1e-12))
    return _dot(a, b) / (length(a) * length(b))


def similarity_grids(spark, sf_dir):
    """Similarities of 8 x 8 patches to their picture's first patch (``sim``) and to the mean direction of all its patches
    (``sim_grad``), cosines over all components."""
    e = view(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 64).alias("picture"), (F.col("vec_id") % 64).alias("patch"), "embedding")
    first = e.groupBy("picture").agg(F.min(F.struct("patch", "embedding")).embedding.alias("first"))
    means = e.select("picture", F.posexplode("embedding").alias("i", "x")).groupBy("picture", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    mean = means.groupBy("picture").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda c: c.x).alias("mean"))
    return e.join(first, "picture").join(mean, "picture", "left").select(
        "picture", "patch", _cosine(F.col("embedding"), F.col("first")).alias("sim"), _cosine(F.col("embedding"), F.col("mean")).alias("sim_grad"))


@query("patches_marked", folds.marked(1.5))
def patches_marked(spark, sf_dir):
    return rounded(G.marked_patches(similarity_grids(spark, sf_dir), ["picture"], 1.5))


@query("patch_regions", folds.regions(1.0))
def patch_regions(spark, sf_dir):
    return rounded(G.patch_regions(similarity_grids(spark, sf_dir), ["picture"], 8, 8, FRAME_W, FRAME_H, sigma=1.0))


@query("ensemble_regions", folds.ensemble())
def ensemble_regions(spark, sf_dir):
    found = G.ensemble_regions(similarity_grids(spark, sf_dir), ["picture"], 8, 8, FRAME_W, FRAME_H)
    return rounded(G.strong_regions(G.nms(found, ["picture"], contain_above=0.70), ["picture"]))


def box_frames(spark, sf_dir):
    """Frames of a session with the candidate boxes of one reference object."""
    entry = F.struct("x1", "y1", "x2", "y2", "conf", "peak")
    boxes = candidates(spark, sf_dir).groupBy("frame").agg(F.sort_array(F.collect_list(entry)).alias("boxes"))
    frames = view(spark, sf_dir, "orders").select((F.col("o_custkey") % 97).cast("long").alias("session"), (F.col("o_orderkey") % 2).cast("long").alias("object_id"), F.col("o_orderkey").alias("seq"))
    joined = frames.join(boxes.withColumnRenamed("frame", "seq"), "seq", "left")
    return joined.select("session", "object_id", "seq", F.coalesce("boxes", F.array().cast(boxes.schema["boxes"].dataType)).alias("boxes"))


GATED = folds.gated(1.85, 20, 250.0)


@query("track_gate", GATED)
def tracks_gated(spark, sf_dir):
    return rounded(track_gate(box_frames(spark, sf_dir)))
