"""Sources, checks, codes and payloads."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from flightframe.catalog import query
from flightframe.catalog.motion import detections
from flightframe.catalog.shared import DET, ctes, rounded, view
from flightframe.functions import labels as L
from flightframe.functions import numbers as N
from flightframe.functions.boxes import parse_box
from flightframe.operators import payload as P
from flightframe.operators import references as R
from flightframe.operators.matching import DescriptorStore
from flightframe.plans.settle import checkpoint_folder
from flightframe.sources import annotations as A
from flightframe.sources import frames as S
from flightframe.sources import tables as T

_EV = ctes("v_events")


def raw_frames(spark, sf_dir):
    """Frame and translation payload texts built from the event rows."""
    e = view(spark, sf_dir, "v_events")
    frame = F.concat(
        F.lit('{"url":"http://host/frames/'), F.col("seq").cast("string"), F.lit('/","image_url":"/media/f'), F.col("seq").cast("string"),
        F.when(F.col("k") % 17 == 3, F.lit('.jpg"')).otherwise(F.lit('.jpg","video_name":"v1"')),
        F.when(F.col("k") % 13 == 2, F.lit(',"extra":1,"added":2}')).otherwise(F.lit("}")),
    )
    health = F.when(F.col("k") % 19 == 4, '"bad"').when(F.col("event_type") == "error", "0").when(F.col("event_type") == "view", '"1"').otherwise("1")
    x = F.when(F.col("event_type") == "error", F.lit('"NaN"')).otherwise((F.col("k") * 2).cast("string"))
    move = F.concat(F.lit('{"url":"u","image_url":"i","health_status":'), health, F.lit(',"translation_x":'), x, F.lit(',"translation_y":"'), F.col("k").cast("string"), F.lit('.5","translation_z":null}'))
    return e.select("seq", frame.alias("payload")), e.where("k % 4 <> 1").select("seq", move.alias("payload"))


@query(
    "frames_read",
    f"""{_EV}, t as (select seq, case when k % 19 = 4 then null when event_type = 'error' then 0 else 1 end as health, case when event_type <> 'error' then k * 2e0 end as gps_x, k + 5e-1 as gps_y from v_events where k % 4 <> 1)
select e.seq, 'http://host/frames/' || e.seq || '/' as url, '/media/f' || e.seq || '.jpg' as image_url, case when k % 17 <> 3 then 'v1' end as video_name,
  case when k % 13 = 2 then 'added,extra' else '' end as unknown_fields, case when k % 17 = 3 then 'missing_video_name' else '' end as errors, t.health, t.gps_x, t.gps_y, cast(null as double) as gps_z
from v_events e left join t on e.seq = t.seq""",
)
def frames_read(spark, sf_dir):
    frames, moves = raw_frames(spark, sf_dir)
    context = S.frame_context(S.parse_frames(frames), S.parse_translations(moves), ["seq"])
    return context.withColumns({"unknown_fields": F.concat_ws(",", "unknown_fields"), "errors": F.concat_ws(",", "errors")})


def _requests(spark, sf_dir):
    e = view(spark, sf_dir, "v_events")
    source = F.when(F.col("k") % 9 == 0, "ftp://x/a.jpg").when(F.col("k") % 9 == 1, " ").when(F.col("k") % 9 == 2, "C:/a.jpg").when(F.col("k") % 9 == 3, "https://x/a.jpg").otherwise("/data/a.jpg")
    return e.select(
        "seq", F.concat(F.lit("u"), F.col("seq").cast("string")).alias("url"), source.alias("image_url"),
        F.when(F.col("k") % 23 != 0, "v").alias("video"), F.col("session").cast("string").alias("session"), (F.col("k") - 2).alias("frame_index"),
        F.when(F.col("k") % 5 == 0, F.col("k")).alias("active_from"), F.when(F.col("k") % 7 == 0, F.lit(40)).alias("active_until"),
    )


@query(
    "frames_rejected",
    f"""{_EV}, f as (select seq, case when k % 9 = 1 then 'image_url_empty' end as a, case when k % 23 = 0 then 'video_empty' end as b, case when k - 2 < 0 then 'frame_index_negative' end as c,
  case when k % 9 = 0 then 'image_source_scheme' end as d, case when k % 5 = 0 and k % 7 = 0 and 40 < k then 'active_range' end as e from v_events)
select seq, concat_ws(',', a, b, c, d, e) as failed from f where coalesce(a, b, c, d, e) is not null""",
)
def frames_rejected(spark, sf_dir):
    _, bad = S.validate_frames(_requests(spark, sf_dir))
    return bad.select("seq", F.concat_ws(",", "failed").alias("failed"))


@query("frames_accepted", f"""{_EV} select count(*) as n from v_events where k % 9 > 1 and k % 23 <> 0 and k >= 2 and not (k % 5 = 0 and k % 7 = 0 and 40 < k)""")
def frames_accepted(spark, sf_dir):
    good, _ = S.validate_frames(_requests(spark, sf_dir))
    return good.agg(F.count(F.lit(1)).alias("n"))


_REF = ctes("v_references") + """, b as (select *, case when position % 4 in (0, 1, 2) then cast(expected_start as bigint) when position % 4 = 3 then cast(expected_start as bigint) end as s, cast(expected_end as bigint) as t,
  min(position) over (partition by order_no) as fo, min(position) over (partition by url) as fu from v_references),
e as (select *, case when trim(image_url) = '' then 'image_url_empty' when order_no < 0 then 'order_invalid' when position > fo then 'order_repeated' when position > fu then 'url_repeated'
  when t < 0 then 'bound_invalid' when t < s then 'bound_order' end as error from b)"""


@query(
    "references_read",
    f"""{_REF} select position, order_no, url as official_url, image_url, case when error is null then row_number() over (partition by error is null order by order_no, position) end as object_id,
  case when error is null then s end as active_from, case when error is null then case when t > s then t - 1 else t end end as active_until, error from e""",
)
def references_read(spark, sf_dir):
    return R.read_references(view(spark, sf_dir, "v_references"))


_NAMES = ctes("v_names") + """, f as (select seq, name, lower(regexp_extract(name, '^(.*?)([0-9]+)[.][^.]+$', 1)) as sequence, cast(regexp_extract(name, '^(.*?)([0-9]+)[.][^.]+$', 2) as bigint) as number
  from v_names where lower(name) like '%.jpg' or lower(name) like '%.png' or lower(name) like '%.webp')"""


@query("file_names", f"{_NAMES} select seq, name, sequence, number from f")
def file_names(spark, sf_dir):
    return S.parse_file_names(view(spark, sf_dir, "v_names"))


@query("natural_order", ctes("v_names") + " select name, concat(lower(regexp_extract(name, '^([A-Za-z]+_?)', 1)), lpad(cast(length(coalesce(nullif(ltrim(regexp_extract(name, '([0-9]+)_', 1), '0'), ''), '0')) as varchar), 10, '0'), coalesce(nullif(ltrim(regexp_extract(name, '([0-9]+)_', 1), '0'), ''), '0'), '_', lpad(cast(length(coalesce(nullif(ltrim(regexp_extract(name, '_0*([0-9]+)[.]', 1), '0'), ''), '0')) as varchar), 10, '0'), coalesce(nullif(ltrim(regexp_extract(name, '_0*([0-9]+)[.]', 1), '0'), ''), '0'), lower(regexp_extract(name, '([.][a-zA-Z]+)$', 1))) as sort_key from v_names")
def natural_order(spark, sf_dir):
    return view(spark, sf_dir, "v_names").select("name", L.natural_key(F.col("name")).alias("sort_key"))


_BYTES = """with c as (select doc_id, case doc_id % 4 when 0 then unhex('FFD8FF') when 1 then unhex('89504E470D0A1A0A') when 2 then unhex('524946460000000057454250') else unhex('00') end || encode(text) as content from documents)"""


def _pictures(spark, sf_dir):
    head = F.when(F.col("doc_id") % 4 == 0, F.unhex(F.lit("FFD8FF"))).when(F.col("doc_id") % 4 == 1, F.unhex(F.lit("89504E470D0A1A0A"))).when(
        F.col("doc_id") % 4 == 2, F.unhex(F.lit("524946460000000057454250"))).otherwise(F.unhex(F.lit("00")))
    return view(spark, sf_dir, "documents").select("doc_id", F.concat(head, F.encode("text", "utf-8")).alias("content"))


@query("content_catalog", f"{_BYTES} select doc_id, case doc_id % 4 when 0 then 'jpeg' when 1 then 'png' when 2 then 'webp' end as format, sha256(content) as content_hash, octet_length(content) as bytes from c")
def content_catalog(spark, sf_dir):
    return S.content_catalog(_pictures(spark, sf_dir))


@query(
    "descriptors_missing",
    "with c as (select sha256(encode(text)) as content_hash, 'm' || (doc_id % 2) as model_hash, doc_id as object_id from documents), w as (select content_hash, model_hash, min(object_id) as object_id, count(*) as copies from c group by 1, 2) select * from w where not exists (select 1 from c where c.content_hash = w.content_hash and c.model_hash = w.model_hash and c.object_id % 3 = 0)",
)
def descriptors_missing(spark, sf_dir):
    from flightframe.operators.matching import missing_descriptors

    catalog = view(spark, sf_dir, "documents").select(
        F.sha2("text", 256).alias("content_hash"), F.concat(F.lit("m"), (F.col("doc_id") % 2).cast("string")).alias("model_hash"), F.col("doc_id").alias("object_id")
    )
    return missing_descriptors(catalog, catalog.where("object_id % 3 = 0"))


@query(
    "descriptors_stored",
    """with c as (select sha256(encode(text)) as content_hash, 'm' || (doc_id % 2) as model_hash, doc_id as object_id from documents),
w as (select content_hash, model_hash, min(object_id) filter (where object_id % 3 = 0) as early, min(object_id) as any_id from c group by 1, 2)
select content_hash, model_hash, coalesce(early, any_id) as object_id, case when early is null then 2 else 1 end as run from w""",
)
def descriptors_stored(spark, sf_dir):
    """A third of the pictures in a first run, all of them in a second, and nothing left for a third."""
    catalog = view(spark, sf_dir, "documents").select(
        F.sha2("text", 256).alias("content_hash"), F.concat(F.lit("m"), (F.col("doc_id") % 2).cast("string")).alias("model_hash"), F.col("doc_id").alias("object_id"))
    schema = catalog.withColumn("run", F.lit(0)).schema
    store = DescriptorStore(spark, f"{checkpoint_folder(spark)}/descriptors/{uuid.uuid4().hex}", schema)
    for run, part in enumerate((catalog.where("object_id % 3 = 0"), catalog, catalog), 1):
        store.add(part, lambda missing, run=run: missing.withColumn("run", F.lit(run)))
    return store.stored()


def annotation_files(spark, sf_dir):
    """One XML text per box, with two objects whose second repeats the first in places."""
    b = view(spark, sf_dir, "v_boxes")
    tag = lambda n, v: f"<{n}>{{}}</{n}>".replace("{}", v)
    coordinates = F.format_string(tag("xmin", "%.1f") + tag("ymin", "%.1f") + tag("xmax", "%.1f") + tag("ymax", "%.1f"), "x1", "y1", "x2", "y2")
    word = F.when(F.col("det_index") % 5 == 0, "MOVING").when(F.col("det_index") % 5 == 1, "hareketli").when(F.col("det_index") % 5 == 2, "Hareketsiz").when(F.col("det_index") % 5 == 3, "yoksay").otherwise("invalid")
    one = F.concat(F.lit("<object><name>"), word, F.lit("</name><bndbox>"), coordinates, F.lit("</bndbox></object>"))
    two = F.when(F.col("class_id") < 3, one).otherwise(F.concat(F.lit("<object><motion>sabit</motion><bbox>"), coordinates, F.lit("</bbox></object>")))
    text = F.concat(F.lit("<annotation><filename>a.jpg</filename><size><width>400</width><height>380</height></size>"), one, two, F.lit("</annotation>"))
    path = F.concat(F.col("frame").cast("string"), F.lit("-"), F.col("det_index").cast("string"), F.lit(".xml"))
    return b.select(path.alias("path"), text.alias("xml"))


_XML = ctes("v_boxes") + """, o as (select frame || '-' || det_index || '.xml' as path, 0 as object_index, case det_index % 5 when 0 then 'moving' when 1 then 'moving' when 2 then 'stationary' when 3 then 'ignore' end as motion, * from v_boxes
union all select frame || '-' || det_index || '.xml', 1, case when class_id >= 3 then 'stationary' else case det_index % 5 when 0 then 'moving' when 1 then 'moving' when 2 then 'stationary' when 3 then 'ignore' end end, * from v_boxes),
e as (select *, case when motion is null then 'invalid_motion_label' when x1 < 0 or y1 < 0 or x2 > 400 or y2 > 380 then 'bbox_out_of_bounds' end as err from o),
f as (select *, min(case when err is null then object_index end) over (partition by path, motion) as first_index from e)"""


@query(
    "annotations_parsed",
    f"{_XML} select path, object_index, motion, x1, y1, x2, y2, case when err is null and object_index > first_index then 'duplicate_object' else err end as error from f",
)
def annotations_parsed(spark, sf_dir):
    parsed = A.parse_annotations(annotation_files(spark, sf_dir))
    return parsed.select("path", "object_index", "motion", "x1", "y1", "x2", "y2", "error")


@query(
    "dataset_profile",
    f"""{_XML}, g as (select * from f where err is null and object_index = first_index) select 'frames' as item, count(*) as n from v_boxes union all select 'pairs', count(*) from v_boxes where det_index % 2 = 0
union all select 'annotations', count(distinct path) from f union all select 'objects_' || motion, count(*) from g group by motion""",
)
def dataset_profile(spark, sf_dir):
    boxes = view(spark, sf_dir, "v_boxes")
    return A.dataset_profile(boxes, boxes.where("det_index % 2 = 0"), A.parse_annotations(annotation_files(spark, sf_dir)))


@query(
    "dataset_issues",
    """with i as (select o_orderkey as k, 'img_' || o_orderkey as stem from orders where o_orderkey % 7 <> 0), a as (select o_orderkey as k, 'img_' || o_orderkey as stem, case when o_orderkey % 13 = 0 then '' when o_orderkey % 17 = 0 then 'other' else 'img_' || o_orderkey end as fn,
  case when o_orderkey % 19 = 0 then 0 else 500 end as w from orders where o_orderkey % 5 <> 0)
select stem, 'missing_xml' as error from i where k not in (select k from a) union all select stem, 'missing_filename' from a where fn = '' union all select stem, 'image_basename_mismatch' from a where fn = 'other'
union all select stem, 'missing_image' from a where k not in (select k from i) union all select stem, 'invalid_image_size' from a where w = 0""",
)
def dataset_issues(spark, sf_dir):
    o = view(spark, sf_dir, "orders")
    key = F.col("o_orderkey").cast("string")
    images = o.where("o_orderkey % 7 <> 0").select(F.concat(F.lit("IMG_"), key, F.lit(".JPG")).alias("name"))
    named = F.when(F.col("o_orderkey") % 13 == 0, "").when(F.col("o_orderkey") % 17 == 0, "other.png").otherwise(F.concat(F.lit("img_"), key, F.lit(".jpg")))
    files = o.where("o_orderkey % 5 <> 0").select(
        F.concat(F.lit("/labels/img_"), key, F.lit(".xml")).alias("path"), named.alias("filename"),
        F.when(F.col("o_orderkey") % 19 == 0, 0).otherwise(500).alias("width"), F.lit(400).alias("height"),
    )
    return A.dataset_issues(images, files)


@query(
    "pair_truth_checked",
    """with t as (select 'r' || (doc_id % 40) as reference_id, 'f' || (doc_id % 300) as frame_name, case when doc_id % 21 = 4 then 'MAYBE' when quality is null then 'IGNORE' else cast(quality as varchar) end as expected from labels),
c as (select *, count(*) over (partition by reference_id, frame_name) as n from t) select reference_id, frame_name, expected, case when expected = 'MAYBE' then 'invalid_expected_match' when n > 1 then 'duplicate_key' end as error from c""",
)
def pair_truth_checked(spark, sf_dir):
    value = F.when(F.col("doc_id") % 21 == 4, "maybe").otherwise(F.coalesce(F.col("quality").cast("string"), F.lit(" ignore ")))
    rows = view(spark, sf_dir, "labels").select(
        F.concat(F.lit(" r"), (F.col("doc_id") % 40).cast("string")).alias("reference_id"),
        F.concat(F.lit("f"), (F.col("doc_id") % 300).cast("string"), F.lit(" ")).alias("frame_name"), value.alias("expected_match"),
    )
    return T.check_pair_truth(rows)


@query("reports_written", f"{DET} select cls, count(*) as n, round(avg(conf), 6) as mean_conf from det group by cls")
def reports_written(spark, sf_dir):
    summary = rounded(detections(spark, sf_dir).groupBy("cls").agg(F.count(F.lit(1)).alias("n"), F.avg("conf").alias("mean_conf")))
    folder = f"{checkpoint_folder(spark)}/reports/{uuid.uuid4().hex}"
    T.write_reports({"classes": summary}, folder)
    return spark.read.schema(summary.schema).parquet(f"{folder}/classes")


def _answers(spark, sf_dir):
    d = detections(spark, sf_dir).withColumns({"landing_status": F.when(F.col("cls") == "uap", "suitable").otherwise("not_applicable"), "motion_status": F.when(F.col("det_index") % 2 == 0, "moving").otherwise("unknown")})
    frames = view(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("frame"))
    positions = frames.where("frame % 3 <> 0").select("frame", F.col("frame").cast("double").alias("x"), F.lit(1.5).alias("y"), F.lit(2.0).alias("z"))
    refs = view(spark, sf_dir, "orders").where("o_orderkey % 4 = 1").select(F.col("o_orderkey").alias("frame"), F.lit(1).alias("object_id"), F.lit("http://host/references/1/").alias("official_url"),
        F.lit(1.0).alias("x1"), F.lit(2.0).alias("y1"), F.lit(3.0).alias("x2"), F.lit(4.0).alias("y2"))
    return P.combine_tasks(frames, d, positions, refs)


_ANSWER = f"""{DET}, n as (select frame, count(*) as n, count(*) filter (where det_index % 2 = 0) as moving, arg_min(cls, det_index) as first_cls from det group by frame)
select o_orderkey as frame, coalesce(n, 0) as detected, coalesce(moving, 0) as moving, case first_cls when 'tasit' then 'http://server/classes/1/' when 'insan' then 'http://server/classes/2/' when 'uap' then 'http://server/classes/3/' when 'uai' then 'http://server/classes/4/' end as first_cls,
  case when o_orderkey % 3 <> 0 then 1 else 0 end as translations, case when o_orderkey % 4 = 1 then 1 else 0 end as refs"""


@query("tasks_combined", f"{_ANSWER} from orders left join n on o_orderkey = frame")
def tasks_combined(spark, sf_dir):
    c = _answers(spark, sf_dir)
    return c.select(
        "frame", F.size("detected_objects").cast("long").alias("detected"),
        F.size(F.filter("detected_objects", lambda o: o["moving_status"] == "1")).cast("long").alias("moving"),
        F.get("detected_objects", F.lit(0))["cls"].alias("first_cls"), F.size("detected_translations").alias("translations"), F.size("reference_predictions").alias("refs"),
    )


@query("prediction_payload", f"{_ANSWER}, 'http://host/frames/' || o_orderkey || '/' as url from orders left join n on o_orderkey = frame")
def prediction_payload(spark, sf_dir):
    url = F.concat(F.lit("http://host/frames/"), F.col("frame").cast("string"), F.lit("/"))
    text = P.prediction_payload(_answers(spark, sf_dir), url)
    body = F.from_json("payload", "frame string, detected_objects array<struct<cls:string,moving_status:string>>, detected_translations array<struct<translation_x:string>>, reference_predictions array<struct<reference:string>>")
    return text.withColumn("b", body).select(
        "frame", F.size("b.detected_objects").cast("long").alias("detected"),
        F.size(F.filter("b.detected_objects", lambda o: o["moving_status"] == "1")).cast("long").alias("moving"),
        F.get("b.detected_objects", F.lit(0))["cls"].alias("first_cls"), F.size("b.detected_translations").alias("translations"),
        F.size("b.reference_predictions").alias("refs"), F.col("b.frame").alias("url"),
    )


@query(
    "wire_codes",
    f"{DET} select cls, case cls when 'tasit' then 0 when 'insan' then 1 when 'uap' then 2 else 3 end as class_code, case when cls = 'uap' then '1' when cls = 'uai' then '0' else '-1' end as landing_code, case when det_index % 3 = 0 then '1' when det_index % 3 = 1 then '0' else '-1' end as motion_code, count(*) as n from det group by all",
)
def wire_codes(spark, sf_dir):
    landing = F.when(F.col("cls") == "uap", "suitable").when(F.col("cls") == "uai", "unsuitable").otherwise("not_applicable")
    motion = F.when(F.col("det_index") % 3 == 0, "moving").when(F.col("det_index") % 3 == 1, "stationary").otherwise("unknown")
    coded = detections(spark, sf_dir).select("cls", L.class_code(F.col("cls")).alias("class_code"), L.landing_code(landing).alias("landing_code"), L.motion_code(motion).alias("motion_code"))
    return coded.groupBy(*coded.columns).agg(F.count(F.lit(1)).alias("n"))


@query(
    "motion_labels",
    """with r as (select l_orderkey, l_linenumber, l_partkey, case l_partkey % 7 when 0 then ' MOVING ' when 1 then 'hare_ketli' when 2 then 'Hareketsiz' when 3 then 'yok say' when 4 then 'Durgun' when 5 then 'parked' else null end as raw from lineitem)
select l_orderkey, l_linenumber, l_partkey, raw, case l_partkey % 7 when 0 then 'moving' when 1 then 'moving' when 2 then 'stationary' when 3 then 'ignore' when 4 then 'stationary' end as motion from r""",
)
def motion_labels(spark, sf_dir):
    raw = F.expr("case l_partkey % 7 when 0 then ' MOVING ' when 1 then 'hare_ketli' when 2 then 'Hareketsiz' when 3 then 'yok say' when 4 then 'Durgun' when 5 then 'parked' else null end")
    rows = view(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", raw.alias("raw"))
    return rows.withColumn("motion", L.normalize_motion_label(F.col("raw")))


@query(
    "numbers_parsed",
    """with r as (select l_orderkey, l_linenumber, l_partkey, l_suppkey from lineitem) select l_orderkey, l_linenumber, l_partkey, case l_partkey % 5 when 0 then l_suppkey + 5e-1 when 1 then l_suppkey * 1e0 end as number,
  case l_partkey % 5 when 0 then l_suppkey + 5e-1 when 1 then l_suppkey * 1e0 else 7e0 end as first_number, l_partkey % 3 <> 2 as truth,
  case when l_partkey % 4 < 2 then 10e0 end as x1, case when l_partkey % 4 < 2 then l_suppkey + 11e0 end as x2 from r""",
)
def numbers_parsed(spark, sf_dir):
    s = F.col("l_suppkey").cast("string")
    text = F.expr("case l_partkey % 5 when 0 then concat(' ', cast(l_suppkey as string), '.5') when 1 then cast(l_suppkey as string) when 2 then 'nan' when 3 then '' else '1.5d' end")
    yes = F.expr("case l_partkey % 3 when 0 then ' True' when 1 then 'YES' else 'no' end")
    wide = F.concat(F.lit("10,2,"), (F.col("l_suppkey") + 11).cast("string"), F.lit(",30"))
    boxed = F.when(F.col("l_partkey") % 4 == 0, F.concat(F.lit("["), wide, F.lit("]"))).when(F.col("l_partkey") % 4 == 1, F.concat(F.lit("("), wide, F.lit(")"))).when(
        F.col("l_partkey") % 4 == 2, F.lit("[10,2,5,30]")).otherwise(wide)
    return view(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", N.finite_number(text).alias("number"), N.first_number(text, F.lit("x"), F.lit("7")).alias("first_number"),
        N.truth(yes).alias("truth"), parse_box(boxed)["x1"].alias("x1"), parse_box(boxed)["x2"].alias("x2"),
    )


@query(
    "frame_indexes",
    """select l_orderkey, l_linenumber, l_partkey, l_suppkey, case l_partkey % 7 when 0 then l_suppkey when 1 then l_suppkey when 2 then l_suppkey when 3 then l_suppkey when 4 then l_suppkey end as frame_index from lineitem""",
)
def frame_indexes(spark, sf_dir):
    text = F.expr("""case l_partkey % 7 when 0 then cast(l_suppkey as string) when 1 then concat('http://h/api/frames/', cast(l_suppkey as string), '/') when 2 then concat('/media/frame_', lpad(cast(l_suppkey as string), 6, '0'), '.webp')
      when 3 then concat('https://h/a%20b/img', cast(l_suppkey as string), '.png?x=1') when 4 then concat('/frames/1/frame-', cast(l_suppkey as string)) when 5 then 'v1_img2.png' else 'none' end""")
    return view(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", L.frame_index_of(text).alias("frame_index"))


@query(
    "modalities",
    """select l_orderkey, l_linenumber, l_partkey, case when l_partkey % 9 = 0 then 'thermal' when l_partkey % 9 = 1 then 'unknown' when l_quantity <= 6 then 'thermal' when l_quantity >= 12 then 'rgb' else 'unknown' end as modality,
  case when (case when l_partkey % 9 = 0 then 'thermal' when l_partkey % 9 = 1 then 'unknown' when l_quantity <= 6 then 'thermal' when l_quantity >= 12 then 'rgb' else 'unknown' end) = 'thermal' then 'cross_modal' else 'same_modal' end as route from lineitem""",
)
def modalities(spark, sf_dir):
    dimensions = F.when(F.col("l_partkey") % 9 == 0, 2).when(F.col("l_partkey") % 9 == 1, 4).otherwise(3)
    rows = view(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", L.modality(F.col("l_quantity"), dimensions, F.lit(3)).alias("modality"))
    return rows.withColumn("route", L.pipeline_kind(F.lit("rgb"), F.col("modality")))


@query("names_canonical", "select doc_id, nfc_normalize(trim(concat(' cafe', chr(769), '_', cast(doc_id as varchar), '.jpg '))) as name from documents")
def names_canonical(spark, sf_dir):
    name = F.concat(F.lit(" cafe\u0301_"), F.col("doc_id").cast("string"), F.lit(".jpg "))
    return view(spark, sf_dir, "documents").select("doc_id", L.canonical_name(name).alias("name"))


@query(
    "affine_matrices",
    ctes("v_frames") + " select session, seq, case when valid then round(yaw, 6) end as m01, case when valid then round(0 - dx - yaw * 558.896e0, 6) end as m02, case when valid then round(0 - dy + yaw * 954.007e0, 6) end as m12 from v_frames",
)
def affine_matrices(spark, sf_dir):
    m = view(spark, sf_dir, "v_frames").withColumn("m", P.affine_matrix(954.007, 558.896))
    at = lambda r, c: F.get(F.get("m", F.lit(r)), F.lit(c))
    return rounded(m.select("session", "seq", at(0, 1).alias("m01"), at(0, 2).alias("m02"), at(1, 2).alias("m12")))


@query(
    "angles",
    ctes("v_frames") + " select session, seq, round(degrees(atan2(dy, dx)), 6) as heading, round(abs((degrees(atan2(dy, dx)) - k * 4 + 180) - 360 * floor((degrees(atan2(dy, dx)) - k * 4 + 180) / 360) - 180), 6) as error from v_frames",
)
def angles(spark, sf_dir):
    heading = N.rotation_degrees(F.col("dy"), F.col("dx"))
    return rounded(view(spark, sf_dir, "v_frames").select("session", "seq", heading.alias("heading"), N.angle_error_degrees(heading, F.col("k") * 4).alias("error")))


@query("camera_rejected", ctes("v_frames") + " select session, seq, width, height, 'camera_resolution_mismatch' as reject_reason, 500 as expected_width, 400 as expected_height from v_frames where width <> 500")
def camera_rejected(spark, sf_dir):
    _, bad = S.camera_compatible(view(spark, sf_dir, "v_frames").select("session", "seq", "width", "height"), 500, 400)
    return bad


@query(
    "samples_enriched",
    ctes("v_evals") + """, e as (select * from v_evals where matched and not ignored and gt_index % 41 <> 0)
select gt_index as line_no, cast(frame as varchar) as current_frame, gt_motion, 400e0 as bbox_area, coalesce(case when gt_index % 3 <> 0 then frame % 50 / 1e1 end, bbox_center_residual) as bbox_center_residual, bbox_iou, cast(null as double) as association_score,
  flow_residual, local_corrected_residual, 'high' as homography_quality_level, 1.5e0 as reprojection_error, 0.2e0 as spatial_coverage, 0.5e0 as detection_confidence from e""",
)
def samples_enriched(spark, sf_dir):
    """Evaluation rows as text, joined with diagnostics and quality tables made of the same rows."""
    e = view(spark, sf_dir, "v_evals")
    text = lambda c: F.col(c).cast("string")
    box_of = F.when(F.col("gt_index") % 41 == 0, "[1,2]").otherwise("[10,10,30,30]")
    evals = e.select(
        F.col("gt_index").alias("line_no"), text("frame").alias("previous_frame"), text("frame").alias("current_frame"), text("gt_index").alias("gt_object_index"),
        F.col("gt_motion"), text("gt_index").alias("matched_detection_index"), box_of.alias("detection_bbox"), F.lit("0.5").alias("detection_confidence"),
        text("matched").alias("matched"), text("ignored").alias("ignored"), F.lit("1").alias("homography_valid"), F.lit("high").alias("homography_quality_level"),
        text("bbox_iou").alias("bbox_iou"), text("bbox_center_residual").alias("bbox_center_residual"), text("flow_residual").alias("flow_residual"), text("local_corrected_residual").alias("local_corrected_residual"),
    )
    extra = [F.lit(None).cast("string").alias(c) for c in ("hybrid_homography_quality_level", "bbox_iou", "bbox_size_ratio", "bbox_association_score", "homography_residual_px", "local_corrected_residual_magnitude")]
    both = lambda line, value: e.where("gt_index % 3 <> 0").select(
        line.alias("line_no"), text("frame").alias("frame_previous"), text("frame").alias("frame_current"), text("gt_index").alias("vehicle_index"), value.alias("bbox_center_residual_px"), *extra)
    # Two diagnostics rows per key: the later one must win.
    diagnostics = both(F.lit(1), F.lit("999")).unionByName(both(F.lit(2), (F.col("frame") % 50 / 10).cast("string")))
    quality = e.select(F.col("gt_index").alias("line_no"), text("frame").alias("previous_frame"), text("frame").alias("current_frame"), F.lit("1.5").alias("reprojection_error"), F.lit("0.2").alias("spatial_coverage"))
    good, _ = T.enrich_samples(evals, diagnostics, quality)
    return good.select(
        "line_no", "current_frame", "gt_motion", "bbox_area", "bbox_center_residual", "bbox_iou", "association_score", "flow_residual", "local_corrected_residual",
        "homography_quality_level", "reprojection_error", "spatial_coverage", "detection_confidence")
