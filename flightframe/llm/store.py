"""Tables written to the shared folder, to read them more than once without their lineage."""

from __future__ import annotations

import uuid
from urllib.parse import unquote, urlparse

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flightframe.plans.settle import checkpoint_folder


def shared_folder(spark: SparkSession) -> str:
    """A new name below the folder in ``spark.checkpoint.dir``, which all executors share."""
    checkpoint_folder(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder."""
    folder = shared_folder(df.sparkSession)
    df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def filesystem(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder and its path there, for tasks that write files of their own."""
    where = urlparse(folder)
    return (fs.LocalFileSystem(), unquote(where.path)) if where.scheme in ("", "file") else fs.FileSystem.from_uri(folder)


def column(name: str) -> Column:
    """A column by its whole name, dots and spaces included."""
    return F.col("`" + name.replace("`", "``") + "`")


def type_of(df: DataFrame, name: str) -> str:
    """The type of a column as text, for schemas of functions over Arrow batches."""
    return df.select(column(name).alias("c")).schema["c"].dataType.simpleString()


def hex_sha256(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)
