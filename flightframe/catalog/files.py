"""Readers of files, run over files that Spark writes from the test tables."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flightframe.catalog import query
from flightframe.catalog.shared import ctes, view
from flightframe.plans.settle import checkpoint_folder
from flightframe.sources import annotations as A
from flightframe.sources import frames as S
from flightframe.sources import tables as T


def _new_folder(spark) -> str:
    return f"{checkpoint_folder(spark)}/files/{uuid.uuid4().hex}"


def _store(folder: str) -> tuple[fs.FileSystem, str]:
    where = urlparse(folder)
    return (fs.LocalFileSystem(), unquote(where.path)) if where.scheme in ("", "file") else fs.FileSystem.from_uri(folder)


def put_files(files: DataFrame, folder: str) -> str:
    """Write each row (name, content) as a file of a shared folder; a task that runs again writes the same files."""
    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, place = _store(folder)
        store.create_dir(place)
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with store.open_output_stream(f"{place}/{name}") as out:
                    out.write(content)
            yield pa.RecordBatch.from_arrays([pa.array([len(batch)], pa.int64())], ["n"])

    files.select("name", F.encode("content", "utf-8").alias("content")).mapInArrow(put, "n long").write.format("noop").mode("overwrite").save()
    return folder


@query(
    "frame_files_listed",
    """select case doc_id % 2 when 0 then 'Clip-A_' else 'run' end || lpad(cast(doc_id as varchar), 6, '0') || case doc_id % 5 when 0 then '.JPG' when 1 then '.png' when 2 then '.webp' else '.jpeg' end as name,
  case doc_id % 2 when 0 then 'clip-a_' else 'run' end as sequence, doc_id as number, strlen(source) as length from documents where doc_id % 5 <> 4""",
)
def frame_files_listed(spark, sf_dir):
    d = view(spark, sf_dir, "documents")
    ending = F.when(F.col("doc_id") % 5 == 0, ".JPG").when(F.col("doc_id") % 5 == 1, ".png").when(F.col("doc_id") % 5 == 2, ".webp").when(F.col("doc_id") % 5 == 3, ".jpeg").otherwise(".txt")
    name = F.concat(F.when(F.col("doc_id") % 2 == 0, "Clip-A_").otherwise("run"), F.lpad(F.col("doc_id").cast("string"), 6, "0"), ending)
    folder = put_files(d.select(name.alias("name"), F.col("source").alias("content")), _new_folder(spark))
    return S.frame_files(spark, folder).select("name", "sequence", "number", "length")


_WORDS = ("MOVING", "hareketli", "Hareketsiz", "yoksay", "invalid")


def _object_texts(boxes: DataFrame) -> DataFrame:
    """All boxes of a supplier as one annotation file, repeated ones behind the others."""
    word = F.element_at(F.array(*[F.lit(w) for w in _WORDS]), (F.col("det_index") % 5 + 1).cast("int"))
    sides = F.format_string("<xmin>%.1f</xmin><ymin>%.1f</ymin><xmax>%.1f</xmax><ymax>%.1f</ymax>", "x1", "y1", "x2", "y2")
    one = F.struct("frame", "det_index", F.concat(F.lit("<object><motion>"), word, F.lit("</motion><bndbox>"), sides, F.lit("</bndbox></object>")).alias("text"))
    head = "<annotation><filename>a.jpg</filename><size><width>400</width><height>380</height></size>"
    objects = F.array_join(F.transform(F.sort_array(F.collect_list(one)), lambda o: o["text"]), "")
    return boxes.groupBy("file").agg(F.concat(F.lit(head), objects, F.lit("</annotation>")).alias("content"))


@query(
    "annotations_read",
    ctes("v_boxes") + """, o as (select 'sup_' || (det_index % 10000000) || '.xml' as name, row_number() over (partition by det_index % 10000000 order by frame, det_index, x1, y1, x2, y2) - 1 as object_index,
  case det_index % 5 when 0 then 'moving' when 1 then 'moving' when 2 then 'stationary' when 3 then 'ignore' end as motion, x1, y1, x2, y2 from v_boxes),
e as (select *, case when motion is null then 'invalid_motion_label' when not (x2 > x1 and y2 > y1) then 'invalid_bbox' when x1 < 0 or y1 < 0 or x2 > 400 or y2 > 380 then 'bbox_out_of_bounds' end as err from o),
f as (select *, min(case when err is null then object_index end) over (partition by name, motion, x1, y1, x2, y2) as first_index from e),
g as (select name, motion, x1, y1, x2, y2, case when err is null and object_index > first_index then 'duplicate_object' else err end as error from f)
select name, motion, error, count(*) as n, round(sum(x1 + y1 + x2 + y2), 3) as extent from g group by all""",
)
def annotations_read(spark, sf_dir):
    boxes = view(spark, sf_dir, "v_boxes").withColumn("file", F.col("det_index") % 10000000)
    files = _object_texts(boxes).select(F.concat(F.lit("sup_"), F.col("file").cast("string"), F.lit(".xml")).alias("name"), "content")
    read = A.read_annotations(spark, put_files(files, _new_folder(spark)))
    sized = read.withColumn("name", F.substring_index("path", "/", -1)).groupBy("name", "motion", "error")
    return sized.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("x1") + F.col("y1") + F.col("x2") + F.col("y2")), 3).alias("extent"))


@query(
    "eval_csv_read",
    ctes("v_evals") + """ select cast(gt_index as varchar) as gt_object_index, gt_motion, cast(matched as varchar) as matched, '[' || cast(frame as varchar) || ',1,2,3]' as gt_bbox,
  case when bbox_iou is null then null else cast(cast(round(bbox_iou * 10) as bigint) as varchar) end as tenths, homography_prediction from v_evals""",
)
def eval_csv_read(spark, sf_dir):
    e = view(spark, sf_dir, "v_evals")
    folder = _new_folder(spark)
    e.select(
        F.col("gt_index").alias("gt_object_index"), "gt_motion", "matched", F.concat(F.lit("["), F.col("frame").cast("string"), F.lit(",1,2,3]")).alias("gt_bbox"),
        F.round(F.col("bbox_iou") * 10).cast("long").alias("tenths"), "homography_prediction",
    ).write.option("header", True).csv(folder)
    return T.read_eval_csv(spark, folder)


@query(
    "pair_truth_read",
    """with t as (select 'ref-\u00e9' || (doc_id % 40) as reference_id, 'f' || (doc_id % 300) as frame_name, case when doc_id % 21 = 4 then 'MAYBE' when quality is null then 'IGNORE' else cast(quality as varchar) end as expected from labels),
c as (select *, count(*) over (partition by reference_id, frame_name) as n from t) select reference_id, frame_name, expected, case when expected = 'MAYBE' then 'invalid_expected_match' when n > 1 then 'duplicate_key' end as error from c""",
)
def pair_truth_read(spark, sf_dir):
    """Names come composed and decomposed, with spaces around them; both are one name."""
    mark = F.when(F.col("doc_id") % 2 == 0, "ref-\u00e9").otherwise("ref-e\u0301")
    value = F.when(F.col("doc_id") % 21 == 4, "maybe").otherwise(F.coalesce(F.col("quality").cast("string"), F.lit(" ignore ")))
    folder = _new_folder(spark)
    view(spark, sf_dir, "labels").select(
        F.concat(mark, (F.col("doc_id") % 40).cast("string")).alias("reference_id"), F.concat(F.lit(" f"), (F.col("doc_id") % 300).cast("string"), F.lit(" ")).alias("frame_name"),
        value.alias("expected_match"),
    ).write.option("header", True).option("quoteAll", True).csv(folder)
    return T.read_pair_truth(spark, folder)
