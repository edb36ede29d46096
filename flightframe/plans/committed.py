"""Tables that grow by numbered parts, each of which counts once it is committed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType


class CommittedTable:
    """Parts in a shared folder, appended and never changed.

    A part's rows go to a folder of its number, in place of what a failed attempt may have left there, and count
    once its number is committed. Readers see committed parts only, so a part is there as a whole or not at all.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def _path(self, path: str) -> tuple:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()), place

    def _known(self, path: str) -> bool:
        store, place = self._path(path)
        return store.exists(place)

    def committed(self, part: int) -> bool:
        return self._known(f"{self.folder}/commits/part={part}/_SUCCESS")

    def parts(self) -> list[int]:
        """Numbers of the committed parts; one per append."""
        store, place = self._path(f"{self.folder}/commits")
        if not store.exists(place):
            return []
        numbers = [int(f.getPath().getName().split("=")[1]) for f in store.listStatus(place) if f.getPath().getName().startswith("part=")]
        return sorted(n for n in numbers if self.committed(n))

    def write(self, rows: DataFrame, part: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.folder}/rows/part={part}")

    def commit(self, part: int) -> None:
        self.spark.range(1).select(F.lit(part).cast("long").alias("number")).write.mode("overwrite").parquet(f"{self.folder}/commits/part={part}")

    def rows(self, schema: StructType, but: int | None = None) -> DataFrame:
        """Rows of the committed parts; the files of part ``but``, which may be about to be replaced, are not touched."""
        if not self._known(f"{self.folder}/commits"):
            return self.spark.createDataFrame([], schema)
        done = self.spark.read.parquet(f"{self.folder}/commits").select(F.col("number").alias("part"))
        numbered = StructType([*schema.fields, StructField("part", LongType())])
        found = self.spark.read.schema(numbered).parquet(f"{self.folder}/rows")
        return (found if but is None else found.where(F.col("part") != but)).join(done, "part", "left_semi").drop("part")
