"""Motion and scene quality from sampled flow."""

from __future__ import annotations

from pyspark.sql import functions as F

from flightframe.catalog import query
from flightframe.catalog.shared import ctes, rounded, view
from flightframe.catalog.views import FLOW_H, FLOW_SCALE, FLOW_W
from flightframe.functions.boxes import box
from flightframe.operators import flow as O
from flightframe.policies import FlowPolicy, ScenePolicy

GRID = O.FlowGrid(FLOW_W, FLOW_H, FLOW_SCALE, FLOW_SCALE)
# Few samples lie in each box here, so the pixel minimums are lower than the defaults.
POLICY = FlowPolicy(min_valid_pixels=3, min_background_pixels=4, min_valid_ratio=0.001, local_stationary_px=1.0, local_moving_px=3.0)
SCENE = ScenePolicy(background_median_max=4.0, background_p90_max=8.0, grid_spread_max=3.0)

_reach = lambda p, x1, y1, x2, y2: (
    f"greatest(0, least({FLOW_W}, floor(({x1}) * {FLOW_SCALE}))) as {p}l, greatest(0, least({FLOW_H}, floor(({y1}) * {FLOW_SCALE}))) as {p}t, "
    f"greatest(0, least({FLOW_W}, ceil(({x2}) * {FLOW_SCALE}))) as {p}r, greatest(0, least({FLOW_H}, ceil(({y2}) * {FLOW_SCALE}))) as {p}b"
)
_IN = lambda p: f"s.px >= b.{p}l and s.px < b.{p}r and s.py >= b.{p}t and s.py < b.{p}b"
_W, _H = "(x2 - x1)", "(y2 - y1)"
_FLOW = f"""{ctes('v_flow', 'v_flow_boxes')}, bx as (select *, {_reach('o', 'x1', 'y1', 'x2', 'y2')}, {_reach('i', f'x1 + {_W} * 0.15', f'y1 + {_H} * 0.15', f'x2 - {_W} * 0.15', f'y2 - {_H} * 0.15')},
  {_reach('e', f'x1 - {_W} * 0.5', f'y1 - {_H} * 0.5', f'x2 + {_W} * 0.5', f'y2 + {_H} * 0.5')} from v_flow_boxes),
ok as (select * from v_flow where valid), fr as (select * from ok s where not exists (select 1 from bx b where b.pair = s.pair and {_IN('o')}))"""


def flow(spark, sf_dir):
    return view(spark, sf_dir, "v_flow"), view(spark, sf_dir, "v_flow_boxes")


@query("flow_outside_boxes", f"{_FLOW} select pair, sample_id from fr")
def flow_outside_boxes(spark, sf_dir):
    samples, boxes = flow(spark, sf_dir)
    return O.outside_regions(samples.where("valid"), O.regions(boxes, ["pair"], box(), GRID), ["pair"]).select("pair", "sample_id")


@query("flow_inside_boxes", f"{_FLOW} select s.pair, s.sample_id, b.box_index from ok s join bx b on b.pair = s.pair and {_IN('i')}")
def flow_inside_boxes(spark, sf_dir):
    from flightframe.functions.boxes import inner_crop

    samples, boxes = flow(spark, sf_dir)
    areas = O.regions(boxes, ["pair"], inner_crop(box(), 0.15), GRID, ["box_index"])
    return O.inside_regions(samples.where("valid"), areas, ["pair"]).select("pair", "sample_id", "box_index")


_GLOBAL = f"{_FLOW}, gm as (select pair, count(*) as pixels, median(dx) as gx, median(dy) as gy from fr group by pair having count(*) >= 3)"


@query("global_motion", f"{_GLOBAL} select pair, pixels, round(gx, 6) as global_x, round(gy, 6) as global_y from gm")
def global_motion(spark, sf_dir):
    return rounded(O.global_motion(*flow(spark, sf_dir), GRID, policy=POLICY))


_VEH = f"""{_GLOBAL}, vm as (select b.pair, b.box_index, count(*) as pixels, median(dx) as mx, median(dy) as my from ok s join bx b on b.pair = s.pair and {_IN('i')} where b.cls = 'tasit' group by b.pair, b.box_index),
v as (select b.*, coalesce(vm.pixels, 0) as pixels, mx, my, gx, gy from bx b left join vm on b.pair = vm.pair and b.box_index = vm.box_index left join gm on b.pair = gm.pair where b.cls = 'tasit')"""


@query(
    "vehicle_motion_global",
    f"""{_VEH}, r as (select *, case when pixels >= 3 and gx is not null then sqrt(power((mx - gx) / {FLOW_SCALE}, 2) + power((my - gy) / {FLOW_SCALE}, 2)) end as residual from v)
select pair, box_index, pixels, round(residual, 6) as residual, case when residual is null then 'unknown' when residual > 2 then 'moving' else 'stationary' end as motion from r""",
)
def vehicle_motion_global(spark, sf_dir):
    return rounded(O.vehicle_motion("global_median", *flow(spark, sf_dir), GRID, policy=POLICY).select("pair", "box_index", "pixels", "residual", "motion"))


@query(
    "vehicle_motion_residual",
    f"""{_VEH}, r as (select *, case when pixels >= 3 then sqrt(power(mx / {FLOW_SCALE}, 2) + power(my / {FLOW_SCALE}, 2)) end as residual, 2 + case when greatest({_W}, {_H}) > 10 then 0.25 * sqrt(greatest({_W}, {_H})) else 0 end as threshold from v)
select pair, box_index, pixels, round(residual, 6) as residual, round(threshold, 6) as threshold, case when residual > threshold then 'moving' else 'stationary' end as motion from r""",
)
def vehicle_motion_residual(spark, sf_dir):
    return rounded(O.vehicle_motion("homography", *flow(spark, sf_dir), GRID, policy=POLICY).select("pair", "box_index", "pixels", "residual", "threshold", "motion"))


@query(
    "vehicle_motion_local",
    f"""{_VEH}, vs as (select b.pair, b.box_index, count(*) as vp, median(dx / 0.5) as vx, median(dy / 0.5) as vy, quantile_cont(sqrt(dx * dx + dy * dy) / 0.5, 0.9) as v90 from ok s join bx b on b.pair = s.pair and {_IN('i')} where b.cls = 'tasit' group by b.pair, b.box_index),
rs as (select b.pair, b.box_index, count(*) as bp, median(dx / 0.5) as bgx, median(dy / 0.5) as bgy from fr s join bx b on b.pair = s.pair and {_IN('e')} where b.cls = 'tasit' group by b.pair, b.box_index),
j as (select v.*, vp, vx, vy, v90, bp, bgx, bgy, sqrt(power(vx - bgx, 2) + power(vy - bgy, 2)) as c, coalesce(least(1e0, bp * 1e0 / greatest(greatest(0, ceil({_W} * 2 * 0.5)) * greatest(0, ceil({_H} * 2 * 0.5)) - greatest(0, ceil({_W} * 0.5)) * greatest(0, ceil({_H} * 0.5)), 1)) * case when bp is null then 0 else 1 end, 0) as ratio
  from v left join vs on v.pair = vs.pair and v.box_index = vs.box_index left join rs on v.pair = rs.pair and v.box_index = rs.box_index),
k as (select *, case when coalesce(vp, 0) < 3 then 'insufficient_vehicle_pixels' when coalesce(bp, 0) < 4 then 'insufficient_background_pixels' when ratio < 0.001 then 'insufficient_background_ratio' when c <= 1 then 'corrected_stationary' when c >= 3 then 'corrected_moving' else 'corrected_hysteresis' end as reason from j)
select pair, box_index, vp as vehicle_pixels, bp as background_pixels, round(v90, 6) as vehicle_p90, round(ratio, 6) as valid_ratio, case when reason like 'corrected%' then round(c, 6) end as corrected, reason,
  case reason when 'corrected_stationary' then 'stationary' when 'corrected_moving' then 'moving' else 'unknown' end as motion from k""",
)
def vehicle_motion_local(spark, sf_dir):
    found = O.vehicle_motion("homography_local", *flow(spark, sf_dir), GRID, policy=POLICY)
    return rounded(found.select("pair", "box_index", "vehicle_pixels", "background_pixels", "vehicle_p90", "valid_ratio", "corrected", "reason", "motion"))


def _scene_gates(spark, sf_dir):
    pairs = view(spark, sf_dir, "v_flow").select("pair").distinct()
    return pairs.select(
        "pair", (F.col("pair") % 11 != 0).alias("gate_valid"), (F.col("pair") % 7 != 0).alias("accepted"),
        F.when(F.col("pair") % 5 == 0, "low").when(F.col("pair") % 5 == 1, "intermediate").otherwise("high").alias("level"),
        F.when(F.col("pair") % 3 == 1, "insufficient_matches").when(F.col("pair") % 3 == 2, "estimation_failed").alias("cause"),
    )


# Fixed values of an even split of the grid into four parts, longer parts first.
_COL, _ROW = "case when s.px < 63 then 0 when s.px < 126 then 1 when s.px < 188 then 2 else 3 end", "cast(floor(s.py / 5e1) as integer)"


@query(
    "scene_quality",
    f"""{_FLOW}, vb as (select * from bx where cls = 'tasit'), dom as (select *, sqrt(dx * dx + dy * dy) / 0.5 as m, {_ROW} as gr, {_COL} as gc from v_flow s where not exists (select 1 from vb b where b.pair = s.pair and {_IN('o')})),
a as (select pair, count(*) as dn, count(*) filter (where valid) as bp, quantile_cont(m, 0.5) filter (where valid) as md, quantile_cont(m, 0.9) filter (where valid) as q9, var_pop(m) filter (where valid) as vr from dom group by pair),
cl as (select pair, gr, gc, median(m) as c from dom where valid group by pair, gr, gc), sp as (select pair, count(*) as cells, max(c) - min(c) as spread from cl group by pair),
gx as (select a.pair, median(abs(b.c - a.c)) as g from cl a join cl b on a.pair = b.pair and a.gr = b.gr and b.gc = a.gc + 1 group by a.pair), gy as (select a.pair, median(abs(b.c - a.c)) as g from cl a join cl b on a.pair = b.pair and a.gc = b.gc and b.gr = a.gr + 1 group by a.pair),
pr as (select distinct pair from v_flow), j as (select pr.pair, coalesce(bp, 0) as bp, case when coalesce(dn, 0) > 0 then coalesce(bp, 0) * 1e0 / dn else 0 end as share, md, q9, vr, coalesce(cells, 0) as cells, spread, gx.g as g1, gy.g as g2 from pr left join a on pr.pair = a.pair left join sp on pr.pair = sp.pair left join gx on pr.pair = gx.pair left join gy on pr.pair = gy.pair),
f as (select *, case when pair % 11 = 0 then case pair % 3 when 0 then 'homography_invalid' when 1 then 'homography_insufficient_matches' else 'homography_estimation_failed' end when pair % 7 = 0 or pair % 5 = 0 then 'homography_quality_low' when share < 0.2 or bp < 4 then 'insufficient_background' when cells < 4 then 'insufficient_background_grid' end as fault, (md <= 4 and q9 <= 8 and spread <= 3) as calm from j)
select pair, bp as background_pixels, round(share, 6) as valid_background_ratio, round(md, 6) as background_median, round(q9, 6) as background_p90, round(vr, 6) as background_variance, case when fault is null then round(spread, 6) end as grid_spread,
  case when fault is null then round(coalesce(g1, 0), 6) end as gradient_x, case when fault is null then round(coalesce(g2, 0), 6) end as gradient_y, case when fault is not null then 'unknown' when calm then 'homography' else 'homography_bbox' end as method,
  coalesce(fault, case when calm then 'background_residual_low_and_homogeneous' else 'background_residual_high_or_spatially_nonuniform' end) as reason from f""",
)
def scene_quality(spark, sf_dir):
    found = O.scene_quality(*flow(spark, sf_dir), _scene_gates(spark, sf_dir), GRID, policy=SCENE)
    return rounded(
        found.select("pair", "background_pixels", "valid_background_ratio", "background_median", "background_p90", "background_variance", "grid_spread", "gradient_x", "gradient_y", "method", "reason")
    )
