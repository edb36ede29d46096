"""SQL statements of operators that go through a frame's boxes one after the other, as recursive tables."""

from __future__ import annotations

from flightframe.catalog.shared import DET, FRAME_H, FRAME_W, ctes, iou_sql

RECURSIVE_DET = DET.replace("with ", "with recursive ", 1)
CANDIDATES = f"""{RECURSIVE_DET}, cand as (select frame, det_index as box_id, cx1 as x1, cy1 as y1, cx2 as x2, cy2 as y2, conf, conf * 2.2e0 as peak from det)"""


def kept_sql(ranked: str, key: str, clash: str) -> str:
    """Tables ``fold`` and ``kept_ids`` (key, i): by rank ``n``, a struct ``b`` is kept unless it clashes with a kept ``k``."""
    return f"""ranked as materialized ({ranked}),
fold as (select {key}, n, [b] as kept from ranked where n = 1
  union all select f.{key}, r.n, case when len(list_filter(f.kept, lambda k: {clash})) = 0 then list_append(f.kept, r.b) else f.kept end from fold f join ranked r on r.{key} = f.{key} and r.n = f.n + 1),
kept_ids as (select {key}, unnest(kept).i as i from (select {key}, arg_max(kept, n) as kept from fold group by {key}))"""


_W, _H = "(least(k.x2, r.b.x2) - greatest(k.x1, r.b.x1))", "(least(k.y2, r.b.y2) - greatest(k.y1, r.b.y1))"
_AREA = lambda p: f"(({p}.x2 - {p}.x1) * ({p}.y2 - {p}.y1))"
_INTER = f"({_W} * {_H})"
_IOU_CLASH = f"{_INTER} / ({_AREA('k')} + {_AREA('r.b')} - {_INTER}) > 0.3e0"
_BOXED = "struct_pack(i := box_id, x1 := x1, y1 := y1, x2 := x2, y2 := y2)"


def suppressed(contained: bool) -> str:
    clash = f"({_IOU_CLASH} or {_INTER} / least({_AREA('k')}, {_AREA('r.b')}) > 0.7e0)" if contained else f"({_IOU_CLASH})"
    ranked = f"select frame, row_number() over (partition by frame order by conf desc, box_id) as n, {_BOXED} as b from cand"
    rounds = ", ".join(f"round({c}, 6) as {c}" for c in ("x1", "y1", "x2", "y2", "conf", "peak"))
    return f"""{CANDIDATES}, {kept_sql(ranked, 'frame', f'{_W} > 0 and {_H} > 0 and {clash}')}
select c.frame, box_id, {rounds} from cand c join kept_ids k on k.frame = c.frame and k.i = c.box_id"""


def deduplicated(near: str, radius: float) -> str:
    """``near`` defines ``placed`` (pair, l, r, similarity, lx, ly, rx, ry)."""
    close = lambda x, y: f"(k.{x} - r.b.{x}) * (k.{x} - r.b.{x}) + (k.{y} - r.b.{y}) * (k.{y} - r.b.{y}) < {radius * radius}e0"
    ranked = "select pair, row_number() over (partition by pair order by similarity desc, l) as n, struct_pack(i := l, lx := lx, ly := ly, rx := rx, ry := ry) as b from placed"
    return f"""{near.replace('with ', 'with recursive ', 1)}, {kept_sql(ranked, 'pair', f"{close('lx', 'ly')} or {close('rx', 'ry')}")}
select p.pair, l, r, round(similarity, 6) as similarity, lx, ly, rx, ry from placed p join kept_ids k on k.pair = p.pair and k.i = p.l"""


_SPOT = "struct_pack(i := box_id, x1 := x1, y1 := y1, x2 := x2, y2 := y2, conf := conf)"
_HULL = lambda one, many: ", ".join(
    f"{c} := {pick}({one}.{c}, list_{low}(list_transform({many}, lambda k: k.{c})))"
    for c, pick, low in (("i", "least", "min"), ("x1", "least", "min"), ("y1", "least", "min"), ("x2", "greatest", "max"), ("y2", "greatest", "max"), ("conf", "greatest", "max")))


def chained(gap: float) -> str:
    """A box takes in the finished ones near it, and again as it grows; with none near it is finished and the next one starts."""
    near = f"(k.x1 - {gap}e0 <= c.cur.x2 and c.cur.x1 <= k.x2 + {gap}e0 and k.y1 - {gap}e0 <= c.cur.y2 and c.cur.y1 <= k.y2 + {gap}e0)"
    return f"""{CANDIDATES}, listed as materialized (select frame, row_number() over (partition by frame order by box_id) as n, {_SPOT} as b from cand),
chain as (select frame, 2::bigint as n, b as cur, list_filter([b], lambda k: false) as done from listed where n = 1
  union all select frame, case when len(hit) > 0 then n else n + 1 end, case when len(hit) > 0 then struct_pack({_HULL('cur', 'hit')}) else b end,
    case when len(hit) > 0 then rest else list_append(done, cur) end
  from (select c.frame, c.n, c.cur, c.done, r.b, list_filter(c.done, lambda k: {near}) as hit, list_filter(c.done, lambda k: not {near}) as rest
    from chain c left join listed r on r.frame = c.frame and r.n = c.n where c.cur is not null) s)
select frame, b.i as box_id, {', '.join(f'round(b.{c}, 6) as {c}' for c in ('x1', 'y1', 'x2', 'y2', 'conf'))} from (select frame, unnest(done) as b from chain where cur is null)"""


def agreed() -> str:
    """A region takes in all boxes it covers by three tenths, as long as there are any."""
    second = "(select o_orderkey as frame, o_custkey % 300 + 0e0 as x1, o_custkey % 200 + 0e0 as y1, o_custkey % 300 + 150e0 as x2, o_custkey % 200 + 150e0 as y2 from orders)"
    inside = lambda p, q: f"(({p}.x1 + {p}.x2) / 2 between {q}.x1 and {q}.x2 and ({p}.y1 + {p}.y2) / 2 between {q}.y1 and {q}.y2)"
    w, h = "(least(k.x2, a.s.x2) - greatest(k.x1, a.s.x1))", "(least(k.y2, a.s.y2) - greatest(k.y1, a.s.y1))"
    covered = f"({w} > 0 and {h} > 0 and {w} * {h} / {_AREA('k')} >= 0.3e0)"
    sides = (("x1", "least", "min"), ("y1", "least", "min"), ("x2", "greatest", "max"), ("y2", "greatest", "max"))
    grow = lambda one, more="": f"struct_pack({', '.join(f'{c} := {pick}({one}.{c}, list_{low}(list_transform(hit, lambda k: k.{c})))' for c, pick, low in sides)}{more})"
    return f"""{CANDIDATES}, judged as (select c.*, s.x1 as sx1, s.y1 as sy1, s.x2 as sx2, s.y2 as sy2, coalesce({inside('c', 's')} or {inside('s', 'c')}, false) as agrees from cand c left join {second} s using (frame)),
started as (select frame, min(box_id) as box_id, struct_pack(x1 := min(x1), y1 := min(y1), x2 := max(x2), y2 := max(y2), conf := max(conf)) as b, max(peak) as peak,
  struct_pack(x1 := least(min(sx1), min(x1)), y1 := least(min(sy1), min(y1)), x2 := greatest(max(sx2), max(x2)), y2 := greatest(max(sy2), max(y2))) as s from judged where agrees group by frame),
others as (select frame, list({_SPOT}) as rest from judged where not agrees group by frame),
grown as (select frame, box_id, b, peak, s, coalesce(rest, []) as rest, 0::bigint as n from started left join others using (frame)
  union all select frame, box_id, {grow('b', ', conf := greatest(b.conf, list_max(list_transform(hit, lambda k: k.conf)))')}, peak, {grow('s')}, left_over, n + 1
  from (select a.*, list_filter(a.rest, lambda k: {covered}) as hit, list_filter(a.rest, lambda k: not {covered}) as left_over from grown a) t where len(hit) > 0),
last as (select frame, max_by(struct_pack(box_id := box_id, b := b, peak := peak, rest := rest), n) as r from grown group by frame),
out as (select frame, r.box_id as box_id, r.b.x1 as x1, r.b.y1 as y1, r.b.x2 as x2, r.b.y2 as y2, r.b.conf as conf, r.peak as peak, true as merged from last
  union all select c.frame, c.box_id, c.x1, c.y1, c.x2, c.y2, c.conf, c.peak, false from cand c left join last using (frame) where last.frame is null or list_contains(list_transform(last.r.rest, lambda k: k.i), c.box_id))
select frame, box_id, {', '.join(f'round({c}, 6) as {c}' for c in ('x1', 'y1', 'x2', 'y2', 'conf', 'peak'))}, merged from out"""


def gated(strong: float, ttl: int, radius: float) -> str:
    """Frames of a session and object in order; ``spot`` is where the object was last, ``ttl`` how long weak boxes may go on."""
    box = "struct_pack(x1 := x1, y1 := y1, x2 := x2, y2 := y2, conf := conf, peak := peak)"
    centre = lambda p: f"struct_pack(x := ({p}.x1 + {p}.x2) / 2, y := ({p}.y1 + {p}.y2) / 2)"
    # Boxes come by falling confidence, so the first of a filtered list is the best.
    return f"""{CANDIDATES}, boxes as (select frame, list({box} order by conf desc, x1, y1, x2, y2) as boxes from cand group by frame),
framed as materialized (select o_custkey % 97 as session, o_orderkey % 2 as object_id, o_orderkey as seq, coalesce(boxes, []) as boxes, row_number() over (partition by o_custkey % 97, o_orderkey % 2 order by o_orderkey) as n
  from orders left join boxes on boxes.frame = o_orderkey),
told as (select *, list_filter(boxes, lambda k: k.peak >= {strong}e0) as strong from framed),
walk as (select session, object_id, 0::bigint as n, struct_pack(x := 0e0, y := 0e0) as spot, 0 as ttl, list_filter((select boxes from framed limit 1), lambda k: false) as said, null::bigint as seq, '' as evidence from (select distinct session, object_id from framed)
  union all select session, object_id, n, case when len(strong) > 0 then {centre('strong[1]')} when len(near) > 0 then {centre('near[1]')} else spot end,
    case when len(strong) > 0 then {ttl} when ttl > 0 then ttl - 1 else ttl end, case when len(strong) > 0 then strong else near[1:1] end, seq, case when len(strong) > 0 then 'strong' else 'track' end
  from (select t.session, t.object_id, t.n, t.seq, w.spot, w.ttl, t.strong, case when w.ttl > 0 then list_filter(t.boxes, lambda k: abs((k.x1 + k.x2) / 2 - w.spot.x) <= {radius}e0 and abs((k.y1 + k.y2) / 2 - w.spot.y) <= {radius}e0) else t.boxes[1:0] end as near
    from walk w join told t on t.session = w.session and t.object_id = w.object_id and t.n = w.n + 1) s)
select session::bigint as session, object_id::bigint as object_id, seq, {', '.join(f'round(b.{c}, 6) as {c}' for c in ('x1', 'y1', 'x2', 'y2', 'conf'))}, evidence from (select session, object_id, seq, evidence, unnest(said) as b from walk where seq is not null)"""


def tracked(projected: str) -> tuple[str, str]:
    """Statements of the scored pairs of projected and found vehicles, and of the motion of each found one."""
    qa, whole = "(greatest(0, qx2 - qx1) * greatest(0, qy2 - qy1))", "greatest((bx2 - bx1) * (by2 - by1), 1e-12)"
    edge = f"(d.x1 <= 1 or d.y1 <= 1 or d.x2 >= {FRAME_W - 1} or d.y2 >= {FRAME_H - 1})"
    diagonal = lambda x1, y1, x2, y2: f"sqrt(power({x2} - {x1}, 2) + power({y2} - {y1}, 2))"
    base = f"""{projected.replace('with ', 'with recursive ', 1)}, {DET[5:]},
im as (select pair, box_id, qx1 as x1, qy1 as y1, qx2 as x2, qy2 as y2, mx, my, {qa} / {whole} >= 0.75 as reliable from c where convex and poly > 1e-6 and {qa} > 0),
fd as (select frame as pair, det_index, x1, y1, x2, y2, (x2 - x1) * (y2 - y1) as size, {edge} as edge from det d where cls = 'tasit'),
met as (select p.pair, p.box_id as p_index, d.det_index, {iou_sql('p', 'd')} as iou, sqrt(power(p.mx - (d.x1 + d.x2) / 2, 2) + power(p.my - (d.y1 + d.y2) / 2, 2)) as center_residual,
  greatest({diagonal('p.x1', 'p.y1', 'p.x2', 'p.y2')}, {diagonal('d.x1', 'd.y1', 'd.x2', 'd.y2')}, 1) as reach, d.size / greatest((p.x2 - p.x1) * (p.y2 - p.y1), 1e-12) as size_ratio, p.reliable and not d.edge as edge_reliable
  from im p join fd d on p.pair = d.pair and p.x1 <= d.x2 and d.x1 <= p.x2 and p.y1 <= d.y2 and d.y1 <= p.y2),
sc as (select *, center_residual / reach as center_ratio, 0.6e0 * iou + 0.3e0 * greatest(0, 1 - center_residual / reach / 1.5e0) + 0.1e0 * least(size_ratio, 1 / size_ratio) as score from met
  where iou >= 0.1e0 and center_residual / reach <= 1.5e0 and size_ratio between 0.5e0 and 2e0),
tc as (select * from sc where score >= 0.25e0)"""
    pairs = f"{base} select pair, p_index, det_index, {', '.join(f'round({c}, 6) as {c}' for c in ('iou', 'center_residual', 'center_ratio', 'size_ratio'))}, edge_reliable, round(score, 6) as score from tc"
    chosen = f"""{base}, listed as materialized (select pair, p_index, det_index, row_number() over (partition by pair order by score desc, p_index, det_index) as n from tc),
taken as (select distinct pair, 0::bigint as n, []::bigint[] as ps, []::bigint[] as ds, null::bigint as p, null::bigint as d from listed
  union all select pair, n, case when free then list_append(ps, p_index) else ps end, case when free then list_append(ds, det_index) else ds end, case when free then p_index end, case when free then det_index end
  from (select l.*, t.ps, t.ds, not (list_contains(t.ps, l.p_index) or list_contains(t.ds, l.det_index)) as free from taken t join listed l on l.pair = t.pair and l.n = t.n + 1) s),
best as (select tc.* from tc join taken t on t.pair = tc.pair and t.p = tc.p_index and t.d = tc.det_index),
told as (select f.pair, f.det_index, b.p_index, b.iou, b.center_residual, b.size_ratio, case when b.p_index is null then 'unmatched' when not edge_reliable then 'edge_unreliable'
  when center_residual <= 3 and iou >= 0.1e0 then 'stationary' when center_residual >= 8 then 'moving' else 'hysteresis' end as reason from fd f left join best b on b.pair = f.pair and b.det_index = f.det_index)
select pair, det_index, p_index, round(iou, 6) as iou, round(center_residual, 6) as center_residual, round(size_ratio, 6) as size_ratio, reason, case when reason in ('moving', 'stationary') then reason else 'unknown' end as motion from told"""
    return pairs, chosen


def hulls(near: str, areas: tuple[float, float]) -> str:
    """The convex hull's area from its edges: directed pairs of points with every other point on one side, or between them."""
    def area(x: str, y: str) -> str:
        turn = f"((q.{x} - p.{x}) * (o.{y} - p.{y}) - (q.{y} - p.{y}) * (o.{x} - p.{x}))"
        along = f"((o.{x} - p.{x}) * (q.{x} - p.{x}) + (o.{y} - p.{y}) * (q.{y} - p.{y}))"
        length = f"((q.{x} - p.{x}) * (q.{x} - p.{x}) + (q.{y} - p.{y}) * (q.{y} - p.{y}))"
        return f"""(select pair, sum(e) / 2 as a from (select p.pair, p.{x} * q.{y} - q.{x} * p.{y} as e from (select distinct pair, {x}, {y} from placed) p join (select distinct pair, {x}, {y} from placed) q
  on p.pair = q.pair and (p.{x} <> q.{x} or p.{y} <> q.{y}) where not exists (select 1 from placed o where o.pair = p.pair and ({turn} < 0 or ({turn} = 0 and not {along} between 0 and {length})))) t group by pair)"""
    return f"""{near} select s.pair, s.points, round(case when s.points < 3 then 0 else least(1, greatest(0, least(coalesce(a.a, 0) / {areas[0]}, coalesce(b.a, 0) / {areas[1]}))) end, 6) as coverage
from (select pair, count(*) as points from placed group by pair) s left join {area('lx', 'ly')} a using (pair) left join {area('rx', 'ry')} b using (pair)"""


def _cut(points: str, axis: str, bound: float, keep: str) -> str:
    """A ring cut by a line: points inside stay, and each side that crosses the line gives the point where it does."""
    inside = lambda p: f"{p}.{axis} {keep} {bound}e0"
    other = "y" if axis == "x" else "x"
    following = f"{points}[i % len({points}) + 1]"
    cross = f"{{'{axis}': {bound}e0, '{other}': {points}[i].{other} + ({following}.{other} - {points}[i].{other}) * ({bound}e0 - {points}[i].{axis}) / ({following}.{axis} - {points}[i].{axis})}}"
    point = lambda p: f"{{'x': {p}.x, 'y': {p}.y}}"
    fixed = cross if axis == "x" else "{'x': " + cross.split(f"'{other}': ")[1][:-1] + f", 'y': {bound}e0}}"
    return f"""flatten(list_transform(range(1, len({points}) + 1), lambda i: case when ({inside(f'{points}[i]')}) and ({inside(following)}) then [{point(following)}] when {inside(f'{points}[i]')} then [{fixed}]
    when {inside(following)} then [{fixed}, {point(following)}] else [] end))"""


def clipped(projected: str, least_area: float) -> str:
    """Visible areas of projected boxes: a ring cut by the four sides of the frame, one after the other."""
    e = [f"sqrt(power(px{(i + 1) % 4} - px{i}, 2) + power(py{(i + 1) % 4} - py{i}, 2))" for i in range(4)]
    spread = lambda a, b: f"(greatest({e[a]}, {e[b]}) / greatest(least({e[a]}, {e[b]}), 1e-9))"
    ring = "[" + ", ".join(f"{{'x': px{i}, 'y': py{i}}}" for i in range(4)) + "]"
    area = "abs(coalesce(list_sum(list_transform(range(1, len(r4) + 1), lambda i: r4[i].x * r4[i % len(r4) + 1].y - r4[i % len(r4) + 1].x * r4[i].y)), 0)) / 2"
    return f"""{projected}, r0 as (select *, {ring} as r0 from q), r1 as (select *, {_cut('r0', 'x', 0, '>=')} as r1 from r0), r2 as (select *, {_cut('r1', 'x', FRAME_W, '<=')} as r2 from r1),
r3 as (select *, {_cut('r2', 'y', 0, '>=')} as r3 from r2), r4 as (select *, {_cut('r3', 'y', FRAME_H, '<=')} as r4 from r3), v as (select *, {area} as visible from r4)
select pair, box_id, round(poly, 6) as raw_area, round(visible, 6) as visible_area, round(visible / nullif(poly, 0), 6) as visible_ratio, case when not convex then 'polygon_not_convex' when poly < {least_area} then 'polygon_area_too_small'
  when poly > {FRAME_W * FRAME_H} * 0.75e0 then 'polygon_area_too_large' when least({', '.join(e)}) < 4 then 'polygon_edge_too_short'
  when least(bx2 - bx1, by2 - by1) <= 0 or greatest((bx2 - bx1) / (by2 - by1), (by2 - by1) / (bx2 - bx1)) > 10 then 'polygon_aspect_ratio'
  when greatest({spread(0, 2)}, {spread(1, 3)}) > 8 then 'polygon_perspective_distortion' when visible <= 0 or visible / poly < 0.25e0 then 'polygon_visibility' end as reason from v"""


def plausible() -> str:
    """Singular values from the eigenvalues of the symmetric product in trigonometric form, then the rules in order."""
    u = [f"u{i}" for i in range(9)]
    names = ("h11", "h12", "h13", "h21", "h22", "h23", "h31", "h32", "h33")
    dot = lambda i, j: " + ".join(f"u{i + k} * u{j + k}" for k in (0, 3, 6))
    corners = [(x, y) for x, y in ((0, 0), (FRAME_W - 1, 0), (FRAME_W - 1, FRAME_H - 1), (0, FRAME_H - 1))]
    image = ", ".join(
        f"(u0 * {x} + u1 * {y} + u2) / nullif(u6 * {x} + u7 * {y} + u8, 0) as px{i}, (u3 * {x} + u4 * {y} + u5) / nullif(u6 * {x} + u7 * {y} + u8, 0) as py{i}" for i, (x, y) in enumerate(corners))
    step = lambda i, axis: f"(p{axis}{(i + 1) % 4} - p{axis}{i % 4})"
    turns = [f"({step(i, 'x')} * {step(i + 1, 'y')} - {step(i, 'y')} * {step(i + 1, 'x')})" for i in range(4)]
    whole = "abs(" + " + ".join(f"(px{i} * py{(i + 1) % 4} - px{(i + 1) % 4} * py{i})" for i in range(4)) + f") / 2 / {(FRAME_W - 1) * (FRAME_H - 1)}e0"
    shift = "greatest(" + ", ".join(f"sqrt(power(px{i} - {x}, 2) + power(py{i} - {y}, 2))" for i, (x, y) in enumerate(corners)) + ")"
    return f"""{ctes('v_matrices')}, un as (select pair, box_id, h33, {', '.join(f'{n} / nullif(h33, 0) as {c}' for n, c in zip(names, u))} from v_matrices),
ds as (select *, {dot(0, 0)} as a, {dot(1, 1)} as b, {dot(2, 2)} as c, {dot(0, 1)} as d, {dot(0, 2)} as e, {dot(1, 2)} as f, u0 * (u4 * u8 - u5 * u7) - u1 * (u3 * u8 - u5 * u6) + u2 * (u3 * u7 - u4 * u6) as det, {image} from un),
ms as (select *, (a + b + c) / 3 as m from ds),
ks as (select *, sqrt((power(a - m, 2) + power(b - m, 2) + power(c - m, 2) + 2 * (d * d + e * e + f * f)) / 6) as k from ms),
cs as (select *, greatest(-1, least(1, ((a - m) * ((b - m) * (c - m) - f * f) - d * (d * (c - m) - f * e) + e * (d * f - (b - m) * e)) / nullif(2 * k * k * k, 0))) as half from ks),
es as (select *, m + 2 * k * cos(acos(half) / 3) as large, m + 2 * k * cos(acos(half) / 3 + 2.0943951023931953e0) as small from cs),
cond as (select *, case when k = 0 then 1 else large * sqrt(3 * m - large - small) / nullif(abs(det), 0) end as condition_number from es)
select pair, box_id, round(condition_number, 2) as condition_number, case when abs(h33) < 1e-12 then 'singular_normalization' when abs(det) < 1e-8 or abs(det) > 1e8 then 'implausible_determinant'
  when condition_number is null or isnan(condition_number) or condition_number > 1e5 then 'excessive_condition_number'
  when not coalesce(least({', '.join(turns)}) > 0 or greatest({', '.join(turns)}) < 0, false) then 'invalid_corner_projection'
  when not ({whole} between 0.1e0 and 10e0) then 'implausible_projected_area' when {shift} > 2 * sqrt({FRAME_W * FRAME_W + FRAME_H * FRAME_H}) then 'excessive_corner_displacement' end as fault from cond"""


GRIDS = """with recursive em as (select cast(floor(vec_id / 64e0) as bigint) as picture, vec_id % 64 as patch, embedding::double[] as e from embeddings),
fi as (select picture, arg_min(e, patch) as e from em group by picture), un as (select picture, unnest(e) as v, unnest(range(1, len(e) + 1)) as i from em),
mv as (select picture, list(v order by i) as e from (select picture, i, avg(v) as v from un group by picture, i) t group by picture),
grid as (select em.picture, em.patch, {cos_first} as sim, {cos_mean} as sim_grad from em join fi using (picture) join mv using (picture))""".format(**{
    f"cos_{name}": f"list_dot_product(em.e, {t}.e) / (greatest(sqrt(list_dot_product(em.e, em.e)), 1e-12) * greatest(sqrt(list_dot_product({t}.e, {t}.e)), 1e-12))"
    for name, t in (("first", "fi"), ("mean", "mv"))})


def marked(sigma: float) -> str:
    return f"""{GRIDS}, st as (select picture, avg(sim) as sim_mean, stddev_pop(sim) as sim_std from grid group by picture)
select picture, patch, round(sim, 6) as sim, round(sim_grad, 6) as sim_grad, round(sim_mean, 6) as sim_mean, round(sim_std, 6) as sim_std, sim >= sim_mean + {sigma}e0 * sim_std as marked from grid join st using (picture)"""


def _areas(pad: int) -> str:
    """Areas of neighbouring ``hit`` patches (picture, patch, score) under the greatest patch of each, as boxes."""
    return f"""reach as (select picture, patch, patch as other from hit union select r.picture, r.patch, h.patch from reach r join hit h on h.picture = r.picture
  and abs(h.patch % 8 - r.other % 8) <= 1 and abs(floor(h.patch / 8e0) - floor(r.other / 8e0)) <= 1),
lb as (select picture, patch, max(other) as area from reach group by picture, patch),
ar as (select h.picture, area, floor(min(h.patch % 8) * {FRAME_W} / 8e0) as x1, floor(min(floor(h.patch / 8e0)) * {FRAME_H} / 8e0) as y1, floor((max(h.patch % 8) + 1) * {FRAME_W} / 8e0) as x2,
  floor((max(floor(h.patch / 8e0)) + 1) * {FRAME_H} / 8e0) as y2, sum(score) as energy, max(score) as peak from hit h join lb using (picture, patch) group by h.picture, area),
az as (select *, (x2 - x1) * (y2 - y1) as size from ar)""", f"greatest(0, x1 - {pad}) as x1, greatest(0, y1 - {pad}) as y1, least({FRAME_W}, x2 + {pad}) as x2, least({FRAME_H}, y2 + {pad}) as y2"


def regions(sigma: float) -> str:
    areas, padded = _areas(10)
    return f"""{GRIDS}, st as (select picture, avg(sim) as m, stddev_pop(sim) as d from grid group by picture), hit as (select picture, patch, sim as score from grid join st using (picture) where sim >= m + {sigma}e0 * d), {areas},
ok as (select *, peak as conf from az where size >= 0.0005e0 * {FRAME_W * FRAME_H} and size <= 0.35e0 * {FRAME_W * FRAME_H} and peak >= 0.35e0 and least(x2 - x1, y2 - y1) >= 8)
select picture, (row_number() over (partition by picture order by conf desc, area) - 1)::bigint as box_id, {padded}, round(conf, 6) as conf, round(peak, 6) as peak from ok"""


def ensemble() -> str:
    areas, padded = _areas(25)
    unit = lambda c: f"({c} - avg({c}) over g) / (stddev_pop({c}) over g + 1e-6)"
    ranked = "select picture, row_number() over (partition by picture order by conf desc, box_id) as n, struct_pack(i := box_id, x1 := x1, y1 := y1, x2 := x2, y2 := y2) as b from nb"
    clash = f"{_W} > 0 and {_H} > 0 and ({_IOU_CLASH} or {_INTER} / least({_AREA('k')}, {_AREA('r.b')}) > 0.7e0)"
    return f"""{GRIDS}, s1 as (select picture, patch, {unit('sim')} + {unit('sim_grad')} as total from grid window g as (partition by picture)), s2 as (select picture, patch, {unit('total')} as score from s1 window g as (partition by picture)),
s3 as (select *, max(score) over (partition by picture) as top from s2), hit as (select picture, patch, score from s3 where top >= 1.4e0 and score >= greatest(1.2e0, top * 0.7e0)), {areas},
nr as (select *, energy as conf, peak >= max(peak) over (partition by picture) - 0.3e0 as near from az),
nb as (select picture, (row_number() over (partition by picture order by conf desc, area) - 1)::bigint as box_id, {padded}, conf, peak from nr where near and size >= 0.0001e0 * {FRAME_W * FRAME_H} and size <= 0.5e0 * {FRAME_W * FRAME_H} and least(x2 - x1, y2 - y1) >= 8),
{kept_sql(ranked, 'picture', clash)},
kp as (select nb.* from nb join kept_ids k on k.picture = nb.picture and k.i = nb.box_id),
sg as (select *, row_number() over (partition by picture order by conf desc, box_id) as place from (select *, max(conf) over (partition by picture) as best from kp) t where conf >= best * 0.5e0)
select picture, box_id, x1, y1, x2, y2, round(conf, 6) as conf, round(peak, 6) as peak from sg where place <= 5"""
