"""Streaming forms, run over what has arrived in the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from flightframe.catalog import query
from flightframe.catalog.matching import GATED, box_frames
from flightframe.catalog.navigation import LIVE, LIVE_COLUMNS, POLICY
from flightframe.catalog.sequences import _CONT
from flightframe.catalog.shared import ctes, rounded, view
from flightframe.plans.settle import checkpoint_folder
from flightframe.sources.frames import frames_stream
from flightframe.streaming import feeds, joins as J
from flightframe.streaming.sessions import continuity_stream, sessions_stream
from flightframe.streaming.tracks import track_gate_stream


@query("frames_stream", ctes("v_events") + " select session, event_type, count(*) as n from v_events group by session, event_type")
def frames_arriving(spark, sf_dir):
    folder = f"{checkpoint_folder(spark)}/arrivals/{uuid.uuid4().hex}"
    events = view(spark, sf_dir, "v_events").select("session", "seq", "event_type")
    events.write.parquet(folder)
    rows = feeds.run_available(frames_stream(spark, folder, events), "frames")
    return rows.groupBy("session", "event_type").agg(F.count(F.lit(1)).alias("n"))


@query("sessions_stream", f"{LIVE} select h.session, {LIVE_COLUMNS} from heard h left join located l using (session, seq)")
def sessions(spark, sf_dir):
    return rounded(feeds.run_in_slices(view(spark, sf_dir, "v_frames"), "sessions", lambda live: sessions_stream(live, calibration=POLICY)))


_PAUSE = 300
# A life of a session ends with a reset, which is no frame, or with a pause; a new one knows nothing of it.
_LIVES = f"""v_frames as (select * exclude (life, control) replace (session * 1000000 + life as session) from (select *, sum(case when control or gap > {_PAUSE} then 1 else 0 end) over (partition by session order by seq) as life
  from (select *, k % 50 = 17 as control, coalesce(seq - lag(seq) over (partition by session order by seq), 0) as gap from v_whole) t) u where not control)"""


@query(
    "sessions_forgotten",
    f"{LIVE.replace('v_frames as (', 'v_whole as (', 1).replace(', a as (select', f', {_LIVES}, a as (select', 1)} select cast(floor(h.session / 1e6) as bigint) as session, {LIVE_COLUMNS} from heard h left join located l using (session, seq)",
)
def sessions_forgotten(spark, sf_dir):
    """Live sessions with resets, and pauses longer than they are remembered."""
    frames = view(spark, sf_dir, "v_frames").withColumn("control", F.when(F.col("k") % 50 == 17, "reset")).withColumn("ts", F.timestamp_seconds(F.col("seq") + 1))
    return rounded(feeds.run_in_slices(frames, "forgotten", lambda live: sessions_stream(live, calibration=POLICY, idle_seconds=_PAUSE, at="ts")))


@query(
    "continuity_stream",
    f"""{_CONT} select session, seq, event, action from s union all select session, seq, case when usable then 'duplicate_frame' else 'unsupported_modality' end, case when usable then 'duplicate' else 'wipe' end from b where repeat or not usable""",
)
def continuity_live(spark, sf_dir):
    return feeds.run_in_slices(view(spark, sf_dir, "v_frames"), "continuity", continuity_stream).select("session", "seq", "event", "action")


@query("track_gate_stream", GATED)
def tracks_live(spark, sf_dir):
    return rounded(feeds.run_in_slices(box_frames(spark, sf_dir), "tracks", track_gate_stream))


def _timed(spark, sf_dir):
    return view(spark, sf_dir, "v_frames").withColumn("ts", F.col("ts").cast("timestamp"))


@query("frames_answered_once", ctes("v_frames") + " select session, frame_id, min(seq) as seq from v_frames group by session, frame_id")
def frames_answered_once(spark, sf_dir):
    first, _ = J.answered_once(view(spark, sf_dir, "v_frames"))
    return first.select("session", "frame_id", "seq")


@query("dedupe_frames_stream", ctes("v_frames") + " select distinct session, frame_id from v_frames")
def dedupe_live(spark, sf_dir):
    live = feeds.arrived(_timed(spark, sf_dir).select("session", "frame_id", "ts"), "frames")
    return feeds.run_available(J.dedupe_frames_stream(live), "dedupe").select("session", "frame_id")


@query("answers_committed", ctes("v_frames") + " select distinct session, frame_id from v_frames where k <> 98")
def answers_committed(spark, sf_dir):
    """Answers to frames as they arrive, each frame's once, committed batch by batch."""
    frames = _timed(spark, sf_dir).where("k <> 98").select("session", "frame_id", "seq", "ts")
    live = J.dedupe_frames_stream(feeds.arriving(frames, "answers", most=None)).select("session", "frame_id")
    sink = feeds.AnswerSink(spark, f"{checkpoint_folder(spark)}/answers/{uuid.uuid4().hex}", ["session", "frame_id"])
    sink.run(live)
    return sink.answers(live.schema)


_GEN = """(active_from is null and active_until is null) or (frame_index is not null and (active_from is null or frame_index >= active_from) and (active_until is null or frame_index <= active_until))"""


@query(
    "active_references_stream",
    ctes("v_frames", "v_windows") + f", g as (select session, max(object_id % 3) as generation from v_windows group by session), w as (select v.* from v_windows v join g on v.session = g.session and v.object_id % 3 = g.generation) select f.session, f.seq, w.object_id, w.object_id % 3 as generation from v_frames f join w on f.session = w.session where {_GEN}",
)
def references_live(spark, sf_dir):
    refs = view(spark, sf_dir, "v_windows").withColumn("generation", F.col("object_id") % 3)
    live = feeds.arrived(view(spark, sf_dir, "v_frames").select("session", "seq", "frame_index"), "frames")
    return feeds.run_available(J.active_references_stream(live, refs).select("session", "seq", "object_id", "generation"), "references")


@query(
    "matches_current",
    ctes("v_windows") + ", g as (select session, max(object_id % 3) as generation from v_windows group by session) select w.session, w.object_id from v_windows w join g on g.session = w.session and g.generation = w.object_id % 3",
)
def matches_current(spark, sf_dir):
    """Matches of live frames that were found with the reference set now in force."""
    refs = view(spark, sf_dir, "v_windows").withColumn("generation", F.col("object_id") % 3)
    live = feeds.arrived(refs.select("session", "object_id", "generation"), "matches")
    return feeds.run_available(J.drop_stale(live, refs).select("session", "object_id"), "matches")


@query(
    "combine_tasks_stream",
    ctes("v_frames") + """, r as (select session, cast(seq as varchar) as frame_id, k from v_frames)
select session, frame_id, case when k % 3 <> 0 then 'detected' end as detected, case when k % 4 <> 0 then 'position' end as position, case when k % 5 <> 0 then 'found' end as found from r""",
)
def tasks_live(spark, sf_dir):
    f = _timed(spark, sf_dir).select("session", F.col("seq").cast("string").alias("frame_id"), "ts", "k")
    part = lambda test, name: f.where(test).select("session", "frame_id", (F.col("ts") + F.expr("interval 5 seconds")).alias("ts"), F.lit(name).alias(name))
    sides = feeds.ended(f.drop("k"), [part("k % 3 <> 0", "detected"), part("k % 4 <> 0", "position"), part("k % 5 <> 0", "found")])
    combined = J.combine_tasks_stream(*[feeds.arrived(side, name) for side, name in zip(sides, ("frames", "detected", "position", "found"))])
    return feeds.run_available(combined, "tasks").select("session", "frame_id", "detected", "position", "found")
