"""Detections, landing pads and box association."""

from __future__ import annotations

from pyspark.sql import functions as F

from flightframe.catalog import folds, query
from flightframe.catalog.shared import DET, FRAME_H, FRAME_W, ctes, iou_sql, rounded, size, view
from flightframe.functions import boxes as B
from flightframe.functions.polygons import MATRIX, corners, matrix, project, with_condition_number, with_matrix_fault, with_polygon_check, with_projected_box
from flightframe.operators import association as A
from flightframe.operators.detections import clipped_box, normalize_detections
from flightframe.operators.flow import final_motion, hybrid_decision, homography_gate
from flightframe.operators.landing import landing_diagnostics, landing_pairs, landing_status
from flightframe.policies import BoxMotionPolicy, HomographyGate, HybridPolicy, MatchingPolicy


def detections(spark, sf_dir):
    return normalize_detections(view(spark, sf_dir, "v_boxes"), *size())


@query("detections_normalized", f"{DET} select frame, det_index, cls, conf, cx1, cy1, cx2, cy2 from det")
def detections_normalized(spark, sf_dir):
    return detections(spark, sf_dir).select("frame", "det_index", "cls", "conf", "cx1", "cy1", "cx2", "cy2")


_SHARED = """greatest(0, least(p.cx2, o.cx2) - greatest(p.cx1, o.cx1)) * greatest(0, least(p.cy2, o.cy2) - greatest(p.cy1, o.cy1))"""
_AREA = "((p.cx2 - p.cx1) * (p.cy2 - p.cy1))"
_MID = "((o.cx1 + o.cx2) / 2)"
_INSIDE = f"({_MID} between p.cx1 and p.cx2 and (o.cy1 + o.cy2) / 2 between p.cy1 and p.cy2)"
_BOTTOM = f"({_MID} between p.cx1 and p.cx2 and o.cy2 between p.cy1 and p.cy2)"
_OCCUPIED = f"({_SHARED} >= 16 and ({_SHARED} / {_AREA} >= 0.01 or {_INSIDE} or {_BOTTOM}))"
_OUTSIDE = f"(p.x1 < -2 or p.y1 < -2 or p.x2 > {FRAME_W} + 2 or p.y2 > {FRAME_H} + 2)"
_PADS = f"""{DET}, p as (select * from det where cls in ('uap', 'uai')), o as (select * from det where cls in ('tasit', 'insan'))"""


@query(
    "landing_status",
    f"""{_PADS}, hit as (select distinct p.frame, p.det_index from p join o on p.frame = o.frame where {_OCCUPIED})
select p.frame, p.det_index, p.cls, case when {_OUTSIDE} then 'unsuitable' when {_AREA} < 64 then 'not_applicable'
  when hit.frame is not null then 'unsuitable' else 'suitable' end as landing_status
from p left join hit on p.frame = hit.frame and p.det_index = hit.det_index""",
)
def landing(spark, sf_dir):
    return landing_status(detections(spark, sf_dir), *size()).select("frame", "det_index", "cls", "landing_status")


@query(
    "landing_summary",
    f"""{_PADS}, hit as (select distinct p.frame, p.det_index from p join o on p.frame = o.frame where {_OCCUPIED}), s as (
select p.cls, case when {_OUTSIDE} then 'unsuitable' when {_AREA} < 64 then 'not_applicable'
  when hit.frame is not null then 'unsuitable' else 'suitable' end as landing_status
from p left join hit on p.frame = hit.frame and p.det_index = hit.det_index)
select cls, landing_status, count(*) as pads from s group by cls, landing_status""",
)
def landing_summary(spark, sf_dir):
    return landing(spark, sf_dir).groupBy("cls", "landing_status").agg(F.count(F.lit(1)).alias("pads"))


@query(
    "landing_pairs",
    f"""{_PADS} select p.frame, p.det_index, o.det_index as o_index, o.cls as o_cls, round({_SHARED}, 6) as intersection_area,
  round({_SHARED} / {_AREA}, 6) as intersection_over_landing, {_INSIDE} as center_inside, {_BOTTOM} as bottom_center_inside, {_OCCUPIED} as occupied
from p join o on p.frame = o.frame and p.cx1 <= o.cx2 and o.cx1 <= p.cx2 and p.cy1 <= o.cy2 and o.cy1 <= p.cy2""",
)
def pairs(spark, sf_dir):
    return rounded(landing_pairs(detections(spark, sf_dir)))


@query(
    "landing_diagnostics",
    f"""{_PADS}, hit as (select p.frame, p.det_index, count(*) as occupying, arg_min(o.cls, o.det_index) as occupied_by
  from p join o on p.frame = o.frame where {_OCCUPIED} group by p.frame, p.det_index)
select p.frame, p.det_index, p.cls, (p.x2 - p.x1) * (p.y2 - p.y1) as bbox_area, {_AREA} as visible_area,
  round({_AREA} / ((p.x2 - p.x1) * (p.y2 - p.y1)), 6) as visible_ratio,
  (p.x1 < 0 or p.y1 < 0 or p.x2 > {FRAME_W} or p.y2 > {FRAME_H} or p.cx1 <= 1 or p.cy1 <= 1 or p.cx2 >= {FRAME_W} - 1 or p.cy2 >= {FRAME_H} - 1) as frame_edge,
  true as bbox_valid, 2e0 as edge_margin_px, coalesce(occupying, 0) as occupying, occupied_by,
  case when {_OUTSIDE} then 'outside_frame_tolerance' when {_AREA} < 64 then 'bbox_too_small' when occupied_by = 'tasit' then 'occupied_by_vehicle'
    when occupied_by = 'insan' then 'occupied_by_person' else 'clear_landing_area' end as decision_reason
from p left join hit on p.frame = hit.frame and p.det_index = hit.det_index""",
)
def diagnostics(spark, sf_dir):
    return rounded(landing_diagnostics(detections(spark, sf_dir), *size()))


@query(
    "box_geometry",
    f"""{DET} select frame, det_index, (x2 - x1) * (y2 - y1) as area, round(sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)), 6) as diagonal,
  round(greatest(0, cx2 - cx1) * greatest(0, cy2 - cy1) / ((x2 - x1) * (y2 - y1)), 6) as visible_ratio,
  (x1 <= 1 or y1 <= 1 or x2 >= {FRAME_W} - 1 or y2 >= {FRAME_H} - 1) as frame_edge,
  round({iou_sql('det', 'det', '', 'c')}, 6) as clip_iou,
  round(sqrt(power((x1 + x2) / 2 - {FRAME_W // 2}, 2) + power((y1 + y2) / 2 - {FRAME_H // 2}, 2)), 6) as center_distance,
  concat('[', printf('%.6f', x1), ',', printf('%.6f', y1), ',', printf('%.6f', x2), ',', printf('%.6f', y2), ']') as box_text from det""",
)
def box_geometry(spark, sf_dir):
    b = B.box()
    return rounded(
        detections(spark, sf_dir).select(
            "frame", "det_index", B.area(b).alias("area"), B.diagonal(b).alias("diagonal"),
            B.visible_ratio(b, *size()).alias("visible_ratio"), B.touches_edge(b, *size()).alias("frame_edge"),
            B.iou(b, clipped_box()).alias("clip_iou"),
            B.center_distance(F.lit(FRAME_W / 2), F.lit(FRAME_H / 2), b).alias("center_distance"), B.box_text(b).alias("box_text"),
        )
    )


_ALL_IOU = f"""{DET}, {ctes('v_gt')[5:]}, pairs as (select g.frame, g.gt_index, d.det_index, {iou_sql('g', 'd')} as score
  from v_gt g join det d on g.frame = d.frame and g.x1 <= d.x2 and d.x1 <= g.x2 and g.y1 <= d.y2 and d.y1 <= g.y2)"""


@query("iou_candidates", f"{_ALL_IOU} select frame, gt_index, det_index, round(score, 6) as score from pairs")
def iou_candidates(spark, sf_dir):
    return rounded(A.iou_candidates(view(spark, sf_dir, "v_gt"), detections(spark, sf_dir)))


# Greedy pairs: the list of a frame's pairs, best first, folded one per step.
_GREEDY = f"""{_ALL_IOU.replace('with ', 'with recursive ', 1)}, best_g as (select frame, gt_index, max(score) as best_iou from pairs group by all), best_d as (select frame, det_index, max(score) as best_iou from pairs group by all),
listed as materialized (select frame, gt_index as g, det_index as d, score, row_number() over (partition by frame order by score desc, gt_index, det_index) as n from pairs where score >= 0.3),
fold as (select distinct frame, cast(0 as bigint) as n, cast([] as bigint[]) as gs, cast([] as bigint[]) as ds, cast(null as bigint) as g, cast(null as bigint) as d, cast(null as double) as score from listed
union all select frame, n + 1, case when free then list_append(gs, g) else gs end, case when free then list_append(ds, d) else ds end, case when free then g end, case when free then d end, score
  from (select f.frame, f.n, f.gs, f.ds, o.g, o.d, o.score, not (list_contains(f.gs, o.g) or list_contains(f.ds, o.d)) as free from fold f join listed o on o.frame = f.frame and o.n = f.n + 1) t),
picked as (select frame, g, d, score from fold where g is not null),
judged as (select t.frame, t.gt_index, t.motion, e.det_index, round(k.score, 6) as match_iou, round(coalesce(b.best_iou, 0), 6) as best_iou from v_gt t
  left join best_g b on b.frame = t.frame and b.gt_index = t.gt_index left join picked k on k.frame = t.frame and k.g = t.gt_index left join det e on e.frame = k.frame and e.det_index = k.d)"""


@query("truth_associated", f"{_GREEDY} select * from judged")
def truth_associated(spark, sf_dir):
    matched = A.associate_ground_truth(view(spark, sf_dir, "v_gt"), detections(spark, sf_dir), 0.3)
    return rounded(matched.select("frame", "gt_index", "motion", "det_index", "match_iou", "best_iou"))


@query(
    "truth_best_overlap",
    f"""{_ALL_IOU} select g.frame, g.gt_index, round(coalesce(max(score), 0), 6) as best_iou
from v_gt g left join pairs p on g.frame = p.frame and g.gt_index = p.gt_index group by g.frame, g.gt_index""",
)
def truth_best_overlap(spark, sf_dir):
    matched = A.associate_ground_truth(view(spark, sf_dir, "v_gt"), detections(spark, sf_dir), 0.3)
    return rounded(matched.select("frame", "gt_index", "best_iou"))


@query("unmatched_truth", f"{_GREEDY} select frame, gt_index, motion, best_iou from judged where det_index is null")
def unmatched_truth(spark, sf_dir):
    matched = A.associate_ground_truth(view(spark, sf_dir, "v_gt"), detections(spark, sf_dir), 0.3)
    return rounded(A.unmatched_truth(matched).select("frame", "gt_index", "motion", "best_iou"))


@query(
    "unmatched_detections",
    f"""{_GREEDY} select e.frame, e.det_index, e.cls, round(coalesce(b.best_iou, 0), 6) as best_iou from det e
left join best_d b on b.frame = e.frame and b.det_index = e.det_index where not exists (select 1 from picked k where k.frame = e.frame and k.d = e.det_index)""",
)
def unmatched_detections(spark, sf_dir):
    truth, found = view(spark, sf_dir, "v_gt"), detections(spark, sf_dir)
    matched = A.associate_ground_truth(truth, found, 0.3)
    return rounded(A.unmatched_detections(found, truth, matched).select("frame", "det_index", "cls", "best_iou"))


def frame_sides(spark, sf_dir):
    """Boxes of a frame pair: the truth boxes with a matrix are the previous frame."""
    size = {"width": F.lit(FRAME_W), "height": F.lit(FRAME_H)}
    h = view(spark, sf_dir, "v_matrices").withColumnRenamed("box_id", "det_index")
    previous = h.where("h33 <> 0").withColumn("cls", F.lit("tasit")).withColumns(size)
    current = detections(spark, sf_dir).withColumnRenamed("frame", "pair").withColumns(size)
    return previous, current


def _px(x: str, y: str) -> tuple[str, str]:
    w = f"(h31 * {x} + h32 * {y} + h33)"
    return f"((h11 * {x} + h12 * {y} + h13) / {w})", f"((h21 * {x} + h22 * {y} + h23) / {w})"


_CORNERS = [_px(x, y) for x, y in (("x1", "y1"), ("x2", "y1"), ("x2", "y2"), ("x1", "y2"))]
_P = ", ".join(f"{c} as p{axis}{i}" for i, pt in enumerate(_CORNERS) for axis, c in zip("xy", pt))
_TURNS = [
    f"((px{(i + 1) % 4} - px{i}) * (py{(i + 2) % 4} - py{(i + 1) % 4}) - (py{(i + 1) % 4} - py{i}) * (px{(i + 2) % 4} - px{(i + 1) % 4}))"
    for i in range(4)
]
_SHOELACE = "abs(" + " + ".join(f"(px{i} * py{(i + 1) % 4} - px{(i + 1) % 4} * py{i})" for i in range(4)) + ") / 2"
_PROJECTED = f"""{ctes('v_matrices')}, pts as (select *, {_P}, {_px('((x1 + x2) / 2)', '((y1 + y2) / 2)')[0]} as mx, {_px('((x1 + x2) / 2)', '((y1 + y2) / 2)')[1]} as my from v_matrices where h33 <> 0),
q as (select *, least(px0, px1, px2, px3) as bx1, least(py0, py1, py2, py3) as by1, greatest(px0, px1, px2, px3) as bx2, greatest(py0, py1, py2, py3) as by2,
  {_SHOELACE} as poly, (least({', '.join(_TURNS)}) > 0 or greatest({', '.join(_TURNS)}) < 0) as convex from pts),
c as (select *, least(greatest(bx1, 0), {FRAME_W}) as qx1, least(greatest(by1, 0), {FRAME_H}) as qy1, least(greatest(bx2, 0), {FRAME_W}) as qx2, least(greatest(by2, 0), {FRAME_H}) as qy2 from q)"""
_QA = "(greatest(0, qx2 - qx1) * greatest(0, qy2 - qy1))"


TRACK_PAIRS, TRACKED = folds.tracked(_PROJECTED)


@query("track_candidates", TRACK_PAIRS)
def track_candidates(spark, sf_dir):
    previous, current = frame_sides(spark, sf_dir)
    return rounded(A.track_candidates(previous, current))


@query("tracks_associated", TRACKED)
def tracks_associated(spark, sf_dir):
    previous, current = frame_sides(spark, sf_dir)
    found = A.associate_tracks(previous, current)
    return rounded(found.select("pair", "det_index", "p_index", "iou", "center_residual", "size_ratio", "reason", "motion"))


@query(
    "boxes_projected",
    f"""{_PROJECTED} select pair, box_id, round(qx1, 6) as x1, round(qy1, 6) as y1, round(qx2, 6) as x2, round(qy2, 6) as y2,
  round(mx, 6) as center_x, round(my, 6) as center_y, round({_QA} / greatest((bx2 - bx1) * (by2 - by1), 1e-12), 6) as visible_ratio,
  {_QA} / greatest((bx2 - bx1) * (by2 - by1), 1e-12) >= 0.75 as edge_reliable
from c where convex and poly > 1e-6 and {_QA} > 0""",
)
def boxes_projected(spark, sf_dir):
    m = view(spark, sf_dir, "v_matrices").where("h33 <> 0")
    image = lambda n, name=None: F.col(f"image_{n}").alias(name or n)
    return rounded(
        with_projected_box(m, matrix(), B.box(), *size()).where("image_valid").select(
            "pair", "box_id", *map(image, ("x1", "y1", "x2", "y2")), image("cx", "center_x"), image("cy", "center_y"),
            image("visible_ratio"), image("edge_reliable"),
        )
    )


_E = [f"sqrt(power(px{(i + 1) % 4} - px{i}, 2) + power(py{(i + 1) % 4} - py{i}, 2))" for i in range(4)]
_RATIO = lambda a, b: f"(greatest({a}, {b}) / greatest(least({a}, {b}), 1e-9))"


@query(
    "polygon_gates",
    f"""{_PROJECTED}, e as (select *, {', '.join(f'{x} as e{i}' for i, x in enumerate(_E))} from q)
select pair, box_id, round(poly, 6) as raw_area, case when not convex then 'polygon_not_convex' when poly < 200 then 'polygon_area_too_small'
  when poly > {FRAME_W * FRAME_H} * 0.75 then 'polygon_area_too_large' when least(e0, e1, e2, e3) < 12 then 'polygon_edge_too_short'
  when least(bx2 - bx1, by2 - by1) <= 0 or greatest((bx2 - bx1) / (by2 - by1), (by2 - by1) / (bx2 - bx1)) > 8 then 'polygon_aspect_ratio'
  when greatest({_RATIO('e0', 'e2')}, {_RATIO('e1', 'e3')}) > 1.02 then 'polygon_perspective_distortion' else 'passed_or_visibility' end as gate
from e""",
)
def polygon_gates(spark, sf_dir):
    m = view(spark, sf_dir, "v_matrices").where("h33 <> 0")
    points = [project(matrix(), x, y) for x, y in corners(B.box())]
    policy = MatchingPolicy(min_polygon_area=200.0, min_edge_px=12.0, max_aspect=8.0, max_distortion=1.02)
    reason = F.col("check_reason")
    gate = F.when(reason.isNull() | (reason == "polygon_visibility"), "passed_or_visibility").otherwise(reason)
    return rounded(with_polygon_check(m, points, *size(), policy).select("pair", "box_id", F.col("check_raw_area").alias("raw_area"), gate.alias("gate")))


@query("polygons_validated", folds.clipped(_PROJECTED, 200))
def polygons_validated(spark, sf_dir):
    m = view(spark, sf_dir, "v_matrices").where("h33 <> 0")
    points = [project(matrix(), x, y) for x, y in corners(B.box())]
    checked = with_polygon_check(m, points, *size(), MatchingPolicy(min_polygon_area=200.0))
    return rounded(checked.select("pair", "box_id", *[F.col(f"check_{n}").alias(n) for n in ("raw_area", "visible_area", "visible_ratio", "reason")]))


_DET = "(h11 * (h22 * h33 - h23 * h32) - h12 * (h21 * h33 - h23 * h31) + h13 * (h21 * h32 - h22 * h31))"


@query("matrix_determinants", f"{ctes('v_matrices')} select pair, box_id, abs(h33) < 1e-12 as singular_normalization, round({_DET}, 10) as determinant from v_matrices")
def matrix_determinants(spark, sf_dir):
    from flightframe.functions.polygons import determinant

    m = view(spark, sf_dir, "v_matrices")
    return rounded(m.select("pair", "box_id", (F.abs("h33") < 1e-12).alias("singular_normalization"), determinant(matrix()).alias("determinant")), 10)


def _unit_matrices(spark, sf_dir):
    """Matrices with ``u``, the one divided by its last entry, as finished values."""
    safe = F.when(F.col("h33") != 0, F.col("h33"))
    unit = F.struct(*[(v / safe).alias(n) for v, n in zip(matrix(), MATRIX)])
    return view(spark, sf_dir, "v_matrices").select("*", F.explode(F.array(unit)).alias("u"))


@query("matrices_plausible", folds.plausible())
def matrices_plausible(spark, sf_dir):
    judged = with_matrix_fault(with_condition_number(_unit_matrices(spark, sf_dir), matrix("u."), "own_"), matrix(), *size(), prefix="its_")
    return judged.select("pair", "box_id", F.round("own_condition_number", 2).alias("condition_number"), F.col("its_fault").alias("fault"))


GATES = (
    HomographyGate(name="fixed_050", fixed_min_inlier_ratio=0.50), HomographyGate(name="fixed_045", fixed_min_inlier_ratio=0.45),
    HomographyGate(name="fixed_040", fixed_min_inlier_ratio=0.40), HomographyGate(name="adaptive", mode="adaptive"),
)


def gate_decisions(spark, sf_dir):
    return homography_gate(view(spark, sf_dir, "v_gates"), GATES)


GATES_SQL = ctes("v_gates") + """, g as (select * from (values ('fixed_050', 'fixed', 0.50), ('fixed_045', 'fixed', 0.45), ('fixed_040', 'fixed', 0.40), ('adaptive', 'adaptive', 0.50)) t(gate, mode, fixed_ratio)),
r as (select *, inliers * 1e0 / matches as inlier_ratio from v_gates),
l as (select r.*, g.*, case when inlier_ratio >= 0.50 then 'high' when inlier_ratio >= 0.35 then 'intermediate' else 'low' end as level from r cross join g),
decided as (select *, case when condition_number > 1e5 then 'excessive_condition_number' when fault is not null then fault
  when matches < 40 then 'insufficient_matches' when inliers < 20 then 'insufficient_inliers'
  when mode = 'fixed' and inlier_ratio >= fixed_ratio then 'fixed_accepted' when mode = 'fixed' then 'low_inlier_ratio'
  when level = 'high' then 'adaptive_high_accepted' when level = 'low' then 'low_inlier_ratio'
  when reprojection_error > 3 then 'high_reprojection_error' when spatial_coverage < 0.08 then 'low_spatial_coverage'
  when projected_overlap < 0.5 then 'low_projected_overlap' else 'adaptive_intermediate_accepted' end as reason from l)"""


@query("homography_gates", f"{GATES_SQL} select pair, gate_id, gate, level, reason, reason like '%accepted' as accepted from decided")
def homography_gates(spark, sf_dir):
    return gate_decisions(spark, sf_dir).select("pair", "gate_id", "gate", "level", "reason", "accepted")


_HYBRID = ctes("v_scenes", "v_samples") + """, e as (select s.frame, s.sample_id, s.homography_valid, s.quality_level as level, s.homography_result as flow_motion, s.homography_bbox_result as bbox_motion,
  b.residual as flow_residual, b.iou as bbox_iou, b.score as bbox_score, b.iou is not null as bbox_matched, case when b.frame_edge then 'edge_unreliable' else 'other' end as bbox_reason
  from v_scenes s join v_samples b on s.sample_id = b.sample_id and s.frame % 97 + 1000 = cast(substr(b.pair_id, 6) as bigint)),
k as (select *, coalesce(bbox_matched and bbox_score >= 0.35 and bbox_iou >= 0.2, false) as reliable from e),
v as (select *, case when reliable then bbox_motion else 'unknown' end as says from k),
r as (select *, case when not homography_valid then 'invalid_homography' when bbox_reason = 'edge_unreliable' then 'frame_edge'
  when says <> 'unknown' and flow_motion = says then 'bbox_and_flow_agree' when says <> 'unknown' and flow_motion <> 'unknown' then 'bbox_flow_conflict'
  when says <> 'unknown' then 'reliable_bbox_flow_unknown' when flow_motion = 'moving' and flow_residual >= 8 and level = 'high' then 'strong_flow_with_high_quality_homography'
  when not reliable then 'bbox_association_unreliable' else 'insufficient_consistent_evidence' end as reason from v)
select frame, sample_id, reason, case when reason in ('bbox_and_flow_agree', 'reliable_bbox_flow_unknown') then says when reason like 'strong%' then 'moving' else 'unknown' end as motion from r"""


@query("hybrid_decisions", _HYBRID)
def hybrid_decisions(spark, sf_dir):
    s = view(spark, sf_dir, "v_scenes").withColumn("pair_id", F.concat(F.lit("pair-"), (F.col("frame") % 97 + 1000).cast("string")))
    b = view(spark, sf_dir, "v_samples").select("pair_id", "sample_id", "residual", "iou", "score", "frame_edge")
    e = s.join(b, ["pair_id", "sample_id"]).select(
        "frame", "sample_id", "homography_valid", F.col("quality_level").alias("level"), F.col("homography_result").alias("flow_motion"),
        F.col("homography_bbox_result").alias("bbox_motion"), F.col("residual").alias("flow_residual"), F.col("iou").alias("bbox_iou"),
        F.col("score").alias("bbox_score"), F.col("iou").isNotNull().alias("bbox_matched"),
        F.when(F.col("frame_edge"), "edge_unreliable").otherwise("other").alias("bbox_reason"),
    )
    motion, reason = hybrid_decision(HybridPolicy())
    return e.select("frame", "sample_id", reason.alias("reason"), motion.alias("motion"))


@query(
    "published_motion",
    f"""{DET} select frame, det_index, cls, case when cls <> 'tasit' then 'unknown' when conf >= 0.6 then
  case when det_index % 3 = 0 then 'moving' when det_index % 3 = 1 then 'unknown' else 'stationary' end else 'stationary' end as motion_status from det""",
)
def published_motion(spark, sf_dir):
    measured = F.when(F.col("det_index") % 3 == 0, "moving").when(F.col("det_index") % 3 == 1, "unknown")
    found = final_motion(detections(spark, sf_dir), F.col("conf") >= 0.6, measured)
    return found.select("frame", "det_index", "cls", "motion_status")
