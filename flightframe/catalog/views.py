"""Boxes, frames, steps, samples and descriptors derived from the test tables.

Each view is written once, in expressions that Spark SQL and the checking engine read alike,
from integer residues and one division. ``{table}`` marks an input table or another view.
Nearly all are plain projections, so their work grows with their table.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flightframe.plans.scans import axis_of, scan

FRAME_W, FRAME_H = 500, 400
FLOW_W, FLOW_H, FLOW_SCALE = 250, 200, 0.5

_D = "cast(floor(l_discount * 100 + 5e-1) as bigint)"
_T = "cast(floor(l_tax * 100 + 5e-1) as bigint)"
_Q = "cast(l_quantity as bigint)"
_ROW = "((l_partkey * 10 + l_linenumber) * 10000000 + l_suppkey)"
_BOX = f"""l_quantity * 10 - 20 as x1, {_D} * 40e0 as y1,
  l_quantity * 10 - 10 + {_T} * 20 as x2, {_D} * 40e0 + 10 + l_partkey % 60 as y2"""

VIEWS: dict[str, str] = {
    "v_boxes": f"""
select l_orderkey as frame, {_ROW} as det_index, cast(l_suppkey % 6 as double) as class_id,
  (100 - 8 * {_D}) / 1e2 as conf, {_BOX}
from {{lineitem}}""",
    "v_gt": f"""
select frame, gt_index, motion, x1 + shift as x1, y1 + shift as y1, x2 + shift as x2, y2 + shift as y2
from (select l_orderkey as frame, {_ROW} as gt_index, l_partkey % 7 - 3 as shift,
  case when l_partkey % 17 = 0 then 'ignore' when l_linestatus = 'O' then 'moving' else 'stationary' end as motion, {_BOX}
from {{lineitem}} where l_suppkey % 4 <> 3) b""",
    "v_evals": f"""
select l_orderkey as frame, {_ROW} as gt_index,
  case when l_linestatus = 'O' then 'moving' else 'stationary' end as gt_motion,
  l_partkey % 5 <> 0 as matched, l_partkey % 17 = 0 as ignored,
  case l_returnflag when 'A' then 'moving' when 'N' then 'stationary' else 'unknown' end as global_median_prediction,
  case l_partkey % 3 when 0 then 'moving' when 1 then 'stationary' else 'unknown' end as homography_prediction,
  case l_suppkey % 4 when 0 then 'unknown' when 1 then 'moving' else 'stationary' end as homography_bbox_prediction,
  case when {_Q} % 5 < 2 then 'stationary' when {_Q} % 5 < 4 then 'moving' else 'unknown' end as homography_hybrid_prediction,
  case {_D} % 3 when 0 then 'moving' when 1 then 'stationary' else 'unknown' end as homography_local_prediction,
  case {_T} % 2 when 0 then 'moving' else 'stationary' end as homography_adaptive_prediction,
  case when l_partkey % 23 = 0 then null else (l_partkey % 250) / 1e1 end as bbox_center_residual,
  case when l_partkey % 29 = 0 then null else ((l_suppkey * 7 + l_partkey) % 300) / 1e1 end as flow_residual,
  case when l_partkey % 31 = 0 then null when l_suppkey % 13 = 0 then 0e0 else ((l_suppkey * 3 + {_Q}) % 120) / 1e1 end as local_corrected_residual,
  case when l_suppkey % 19 = 0 then null else {_D} / 1e1 end as bbox_iou,
  {_T} * 12 / 1e2 as association_score, {_Q} % 13 = 0 as frame_edge
from {{lineitem}}""",
    "v_samples": f"""
select concat('pair-', cast(1000 + l_orderkey % 97 as varchar(10))) as pair_id, {_ROW} as sample_id,
  case when l_linestatus = 'O' then 'moving' else 'stationary' end as gt,
  case when l_partkey % 23 = 0 then null else (l_partkey % 250) / 1e1 end as residual,
  case when l_suppkey % 19 = 0 then null else {_D} / 1e1 end as iou,
  {_T} * 12 / 1e2 as score,
  (30 + {_Q} * 4) / 1e2 as size_ratio,
  l_suppkey % 11 <> 0 as homography_valid, {_Q} % 13 = 0 as frame_edge, {_Q} % 17 = 0 as projected_edge
from {{lineitem}}""",
    "v_scenes": f"""
select l_orderkey as frame, {_ROW} as sample_id,
  case when l_linestatus = 'O' then 'moving' else 'stationary' end as gt,
  l_suppkey % 11 <> 0 as homography_valid,
  case {_D} % 5 when 4 then 'low' when 3 then 'intermediate' else 'high' end as quality_level,
  {_T} / 1e1 as background_ratio, (l_partkey % 160) / 1e1 as background_median,
  (l_partkey % 320) / 1e1 as background_p90, (l_suppkey % 100) / 5e0 as grid_spread,
  case l_partkey % 3 when 0 then 'moving' when 1 then 'stationary' else 'unknown' end as homography_result,
  case l_suppkey % 4 when 0 then 'unknown' when 1 then 'moving' else 'stationary' end as homography_bbox_result
from {{lineitem}}""",
    "v_gates": f"""
select l_orderkey as pair, {_ROW} as gate_id, 20 + l_partkey % 100 as matches,
  cast(floor((20 + l_partkey % 100) * (20 + {_Q}) / 1e2) as bigint) as inliers,
  10e0 + l_suppkey as condition_number, (l_partkey % 60) / 1e1 as reprojection_error,
  (l_suppkey % 40) / 1e2 as spatial_coverage, (30 + l_partkey % 71) / 1e2 as projected_overlap,
  case when l_suppkey % 37 = 5 then 'invalid_corner_projection' else null end as fault
from {{lineitem}}""",
    "v_matrices": f"""
select l_orderkey as pair, {_ROW} as box_id, {_BOX},
  1e0 + {_D} / 1e2 as h11, {_T} / 1e2 as h12, l_partkey % 50 - 25e0 as h13,
  0e0 - {_T} / 1e2 as h21, 1e0 - {_D} / 2e2 as h22, l_suppkey % 40 - 20e0 as h23,
  (l_partkey % 5) / 1e5 as h31, (l_suppkey % 5) / 1e5 as h32,
  case when l_suppkey % 41 = 0 then 0e0 else 1e0 end as h33
from {{lineitem}}""",
    "v_events": """
select event_id as seq, user_id as session, event_type, value, ts, cast(regexp_extract(props, '([0-9]+)', 1) as bigint) as k
from {events}""",
    "v_frames": """
select session, seq, ts, k,
  concat('f', cast(m as varchar(20))) as frame_id,
  concat('v', cast(cast(floor((n - 1) / 45e0) as bigint) as varchar(20))) as video,
  case when k = 98 then null when k = 99 then m + 3 when k = 50 then m - 2 else m end as frame_index,
  500 + case when k = 7 then 100 else 0 end as width, 400 as height,
  case when k = 33 then 'thermal' else 'rgb' end as modality,
  case when k % 10 = 4 then 'same' else concat('h', cast(seq as varchar(20))) end as fingerprint,
  case when event_type = 'signup' and k < 20 then null when event_type = 'error' then 0 else 1 end as health,
  case when k = 60 then null else gps_e / 5e1 end as gps_x, gps_n / 5e1 as gps_y, 100e0 + n % 3 as gps_z,
  (k % 11) - 5e0 as dx, (k % 7) - 3e0 as dy, (k % 5 - 2) / 1e3 as yaw,
  20 + k as tracked, 10 + k as inliers, (60 + k % 40) / 1e2 as inlier_ratio, (k % 20) / 1e1 as rms,
  k % 10 <> 0 as valid,
  case when k % 10 <> 0 then null when k = 0 then 'insufficient_features' when k = 10 then 'tracking_failed' when k = 20 then 'freeze' else 'low_quality' end as reason
from (select *, cast(floor(n * 9 / 1e1) as bigint) as m from {v_travel}) t""",
    "v_names": """
select event_id as seq, concat(case when user_id % 2 = 0 then 'Seq' else 'clip_' end, cast(user_id as varchar(20)), '_',
  lpad(cast(cast(floor(event_id / 7e0) as bigint) as varchar(20)), 6, '0'),
  case event_id % 4 when 0 then '.JPG' when 1 then '.png' when 2 then '.webp' else '.txt' end) as name
from {events}""",
    "v_numbers": """
select concat('s', cast(user_id as varchar(20))) as sequence, event_id as seq, concat('f', cast(event_id as varchar(20))) as name,
  cast(floor(event_id / 1e2) as bigint) as number
from {events}""",
    "v_references": """
select p_partkey as position, case when p_partkey % 50 = 7 then p_partkey - 1 else p_partkey end as order_no,
  concat('http://host/references/', cast(case when p_partkey % 60 = 9 then p_partkey - 1 else p_partkey end as varchar(20)), '/') as url,
  case when p_partkey % 70 = 3 then ' ' else concat('/media/ref_', cast(p_partkey as varchar(20)), '.webp') end as image_url,
  case p_partkey % 4 when 0 then cast(p_size as varchar(20)) when 1 then concat('/frames/', cast(p_size as varchar(20)), '/')
    when 2 then concat('/media/frame_', lpad(cast(p_size as varchar(20)), 6, '0'), '.webp') else 'none' end as frame_start,
  case when p_partkey % 4 = 3 then concat('http://host/frames/', cast(p_size as varchar(20)), '/?x=1') else null end as frame_start_image_url,
  cast(p_size + p_partkey % 9 - 1 as varchar(20)) as frame_end, cast(null as varchar(20)) as frame_end_image_url,
  p_size as expected_start, p_size + p_partkey % 9 - 1 as expected_end
from {part}""",
    "v_windows": """
select p_partkey as object_id, p_partkey % 150 as session,
  case when p_partkey % 5 = 0 then null else p_size end as active_from,
  case when p_partkey % 7 = 0 then null else p_size + p_partkey % 9 end as active_until
from {part}""",
    "v_matches": """
select d.doc_id, concat('ref-', cast(d.doc_id % 23 as varchar(10)), case d.doc_id % 4 when 0 then '-Tight' when 1 then '-medium' when 2 then '-WIDER' else '' end) as reference_id,
  concat('frame_', cast(d.doc_id as varchar(20)), '.jpg') as frame_name,
  coalesce(cast(l.quality as varchar(10)), 'IGNORE') as expected,
  d.n_chars % 3 <> 0 as produced, d.n_chars % 4 <> 0 as accepted, d.n_chars % 5 <> 0 as local_accepted, d.n_chars % 6 <> 0 as hybrid_accepted,
  d.n_chars % 7 <> 0 as reference_active, d.n_chars % 11 = 0 as timed_out,
  case when d.n_chars % 11 = 0 then 'timeout' when d.n_chars % 3 <> 0 then 'matched' else 'rejected' end as outcome,
  case d.doc_id % 3 when 0 then 'dinov2' when 1 then 'aliked_lightglue' else 'hybrid' end as stage,
  cast(d.n_chars % 60 as bigint) as correspondence_count,
  case when d.n_chars % 13 = 0 then null else (d.n_chars % 100) / 1e2 end as similarity_mean,
  case when d.n_chars % 17 = 0 then null else (d.n_chars % 90) / 1e2 end as inlier_ratio,
  case when d.n_chars % 19 = 0 then null else (d.n_chars % 160) / 1e1 end as rms,
  case when d.n_chars % 23 = 0 then null else (d.n_chars % 95) / 1e2 end as visible_ratio,
  case when d.n_chars % 29 = 0 then null else (d.n_chars % 97) / 1e2 end as confidence,
  (d.n_chars % 70) / 1e1 as elapsed, case when d.doc_id % 2 = 0 then 5e0 else 3e0 end as time_limit
from {documents} d left join {labels} l on d.doc_id = l.doc_id""",
    "v_patches": """
select cast(floor(vec_id / 128e0) as bigint) as pair, vec_id % 2 as side, cast(floor((vec_id % 128) / 2e0) as bigint) as patch, vec_id, label, embedding
from {embeddings}""",
    "v_flow": f"""
select cast(floor(l_orderkey / 5e1) as bigint) as pair, {_ROW} as sample_id,
  (l_partkey * 7 + l_linenumber) % {FLOW_W} as px, (l_suppkey * 3 + {_Q}) % {FLOW_H} as py,
  ((l_partkey % 21) - 10) / 4e0 as dx, ((l_suppkey % 15) - 7) / 4e0 as dy, l_partkey % 50 <> 0 as valid
from {{lineitem}}""",
    "v_flow_boxes": """
select cast(floor(o_orderkey / 5e1) as bigint) as pair, o_orderkey as box_index,
  case when o_orderkey % 3 = 0 then 'insan' else 'tasit' end as cls,
  (o_custkey * 13) % 380 + 0e0 as x1, (o_custkey * 7) % 280 + 0e0 as y1,
  (o_custkey * 13) % 380 + 60e0 + o_custkey % 50 as x2, (o_custkey * 7) % 280 + 50e0 + o_custkey % 60 as y2
from {orders}""",
    "v_tracks": f"""
select cast(floor(l_orderkey / 2e1) as bigint) as pair, {_ROW} as track_id,
  l_quantity * 9 + {_T} as px, {_D} * 38e0 + l_suppkey % 20 as py,
  l_partkey % 10 = 0 as outlier, l_suppkey % 25 <> 0 as ok, (l_partkey % 8) / 5e0 as fb
from {{lineitem}}""",
}

# Session totals along the arrival order: frame number and distance travelled.
_TRAVEL_SQL = """
select *, row_number() over w as n,
  sum(8 * ((k % 11) - 5) - 6 * ((k % 7) - 3)) over (w rows unbounded preceding) as gps_e,
  sum(6 * ((k % 11) - 5) + 8 * ((k % 7) - 3)) over (w rows unbounded preceding) as gps_n
from {v_events} window w as (partition by session order by seq)"""

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _inputs(sql: str) -> list[str]:
    return sorted(set(re.findall(r"\{(\w+)\}", sql)))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name in TABLES:
        return table(spark, sf_dir, name)
    if name == "v_travel":
        return _travel(view(spark, sf_dir, "v_events"))
    sql = VIEWS[name]
    return spark.sql(sql, **{needed: view(spark, sf_dir, needed) for needed in _inputs(sql)})


def _travel(events: DataFrame) -> DataFrame:
    cut, axis = axis_of(events, ["session"], "seq")
    a, b = F.col("k") % 11 - 5, F.col("k") % 7 - 3
    return scan(cut, axis, sums={"n": F.lit(1), "gps_e": 8 * a - 6 * b, "gps_n": 6 * a + 8 * b})


def ctes(*names: str) -> str:
    """``with`` clause that defines views (and what they read) for the checking engine."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in TABLES or name in ordered:
            return
        sql = _TRAVEL_SQL if name == "v_travel" else VIEWS[name]
        for needed in _inputs(sql):
            visit(needed)
        ordered.append(name)

    for name in names:
        visit(name)
    bodies = []
    for name in ordered:
        sql = _TRAVEL_SQL if name == "v_travel" else VIEWS[name]
        bodies.append(f"{name} as ({re.sub(r'[{](\w+)[}]', r'\1', sql)})")
    return "with " + ",\n".join(bodies)
