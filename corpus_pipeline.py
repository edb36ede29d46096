"""Five stages that turn documents into a training mix; every stage works on all that the one before kept.

A document's columns travel packed into one, so that none of them meets a name the operators use. Stages that
decide between documents know each row by its place in the file it was read from, whatever its id.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flightframe.llm.leaks import leaked_items
from flightframe.llm.mixing import mixed_frames
from flightframe.llm.near import near_duplicate_files
from flightframe.llm.private import redacted, with_personal_data
from flightframe.llm.quality import judged
from flightframe.llm.store import column, written

ORACLE_SQL = None  # the span classifier is trained, which SQL cannot state


def _packed(docs: DataFrame, *more: Column) -> DataFrame:
    """All columns as ``row``, with the text and more beside them."""
    return docs.select(F.struct(*[column(c) for c in docs.columns]).alias("row"), column("text").cast("string").alias("text"), *more)


def _own(docs: DataFrame, name: str) -> Column:
    """A column under a plain name, null where there is none."""
    return (column(name) if name in docs.columns else F.lit(None).cast("string")).alias(name)


def _placed(docs: DataFrame) -> DataFrame:
    """Packed documents with ``key``: order by id, known ones first, then by file and place in it."""
    try:
        where = docs.metadataColumn("_metadata")
        docs.select(where)
    except AnalysisException:  # not read from files
        docs = written(docs)
        where = docs.metadataColumn("_metadata")
    key = F.struct(column("doc_id").isNull().alias("unknown"), column("doc_id").alias("id"), where["file_name"].alias("file"), where["row_index"].alias("place"))
    return _packed(docs, key.alias("key"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that break no quality rule of their language."""
    return judged(_packed(docs, _own(docs, "lang")), "text", language="lang").where("kept").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near duplicates: the first by id, or by place where ids are equal or unknown."""
    placed = _placed(docs)
    copies = near_duplicate_files(placed.select("key", "text"), "key", "text").where("not kept").select(F.col("path").alias("key"))
    return placed.join(copies, "key", "left_anti").select("row.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    benchmark, placed = spark.read.parquet(f"{sf_dir}/benchmark.parquet"), _placed(docs)
    leaked = leaked_items(placed.select("key", "text"), benchmark, "key", "text", "item_id", "text").select(F.col("path").alias("key")).distinct()
    return placed.join(leaked, "key", "left_anti").select("row.*")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by the name of its kind and ``n_chars`` counted anew."""
    found = with_personal_data(_packed(docs), "text")
    clean = found.select("row", F.size("spans").alias("n"), redacted(F.col("text"), F.col("spans")).alias("clean"))
    changed = {"text": F.col("clean"), "n_chars": F.char_length("clean").cast("long")}
    own = lambda c: F.col("row")[c]
    return clean.select(*[(F.when(F.col("n") > 0, changed[c]).otherwise(own(c)) if c in changed else own(c)).alias(c) for c in docs.columns])


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, copies counted in ``mix_copy`` (with more underscores where documents have one)."""
    name = "mix_copy"
    while name in docs.columns:
        name += "_"
    mixed = mixed_frames(_packed(docs, _own(docs, "doc_id"), _own(docs, "source")), "doc_id", "source", "text")
    return mixed.select("row.*", F.col("mix_copy").alias(name))


STAGES = [
    ("quality rules", quality), ("near duplicates", near_duplicates), ("decontamination", decontamination),
    ("personal data", personal_data), ("mixing", mixing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
