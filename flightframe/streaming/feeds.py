"""Running live forms over tables: arrivals in the shared folder, answers committed by batch."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from flightframe.plans.committed import CommittedTable
from flightframe.plans.settle import checkpoint_folder, settle

BATCH_ROWS = 4000
#: A table comes in about this many batches, as each has a fixed cost whatever it brings ...
BATCHES = 16
#: ... but in more where a batch, which may be of one session, would be too large to sort in one task.
MOST_ROWS = 250_000


def batch_rows(rows: int, most: int | None = MOST_ROWS) -> int:
    """Rows a batch brings of a table of ``rows``; with ``most`` None their number alone decides."""
    share = -(-rows // BATCHES)
    return max(BATCH_ROWS, share if most is None else min(share, most))


def _place(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_folder(spark)}/streams/{name}-{uuid.uuid4().hex}"


def live_session(spark: SparkSession) -> SparkSession:
    """A session for live forms: state in RocksDB, no empty batches, which idle timers would ask for without end, and no
    more parts of the state than can be worked on at once, as every batch opens them all."""
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    own.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    parts = min(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    own.conf.set("spark.sql.shuffle.partitions", str(parts))
    return own


def _files(spark: SparkSession, folder: str) -> tuple:
    """The file system of a folder, and its data files by name."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [f.getPath() for f in store.listStatus(path) if f.getPath().getName().startswith("part-")]
    return store, sorted(found, key=lambda p: p.getName())


def arriving(df: DataFrame, name: str, order: str = "seq", rows: int | None = None, most: int | None = MOST_ROWS) -> DataFrame:
    """``df`` as a stream that brings about ``rows`` rows a batch (``batch_rows`` if not given), by ``order``: one file each,
    dated in their order."""
    spark, folder = df.sparkSession, f"{_place(df.sparkSession, name)}/arrivals"
    # Counting, choosing ranges and writing each read the rows, which are worked out once.
    df = settle(df)
    n = df.count()
    batches = max(1, -(-n // (rows or batch_rows(n, most))))
    df.repartitionByRange(batches, order).sortWithinPartitions(order).write.parquet(folder)
    store, paths = _files(spark, folder)
    for i, path in enumerate(paths):
        store.setTimes(path, 1_000_000_000_000 + 1000 * i, -1)
    return live_session(spark).readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def arrived(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it as a stream of files."""
    folder = _place(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.readStream.schema(df.schema).parquet(folder)


def ended(frames: DataFrame, results: Sequence[DataFrame], at: str = "ts", after: str = "1 hour") -> list[DataFrame]:
    """Tables of a live join, each with a last row a time ``after`` all others, so that what waits for its limit is answered
    when the streams end. That row stays behind the watermark itself: it has no answer, as no key is null, and is none, as
    no frame is that late. ``after`` is to be longer than delay and limits together."""
    tables = [frames, *results]
    last = [time for df in tables if (time := df.agg(F.max(at)).first()[0]) is not None]
    if not last:
        return tables
    end, one = F.lit(max(last)) + F.expr(f"interval {after}"), frames.sparkSession.range(1)
    # A result's row has a key, whatever it is, since rows without one are left out before their times are seen.
    closing = lambda df, value: one.select(*[(end if f.name == at else F.lit(value)).cast(f.dataType).alias(f.name) for f in df.schema])
    return [df.unionByName(closing(df, None if df is frames else 0)) for df in tables]


def _run(stream: DataFrame, folder: str) -> None:
    query = (
        stream.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/rows")
        .option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).start()
    )
    query.awaitTermination()


def run_available(stream: DataFrame, name: str) -> DataFrame:
    """Process what has arrived into a table in the shared folder, and read it."""
    folder = _place(stream.sparkSession, name)
    _run(stream, folder)
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows")


def run_in_slices(df: DataFrame, name: str, live: Callable[[DataFrame], DataFrame], order: str = "seq", rows: int | None = None) -> DataFrame:
    """Give ``df`` to a live form in batches of about ``rows`` rows (``batch_rows`` if not given), so state is carried from batch to batch."""
    spark, folder = df.sparkSession, _place(df.sparkSession, name)
    stream = live(arriving(df, name, order, rows))
    _run(stream, folder)
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


class AnswerSink(CommittedTable):
    """Answers written batch by batch, each batch once.

    For ``foreachBatch``: a batch that comes again after its commit changes nothing; one that failed before it
    is written anew. ``answers`` reads committed batches only. With ``keys``, what a committed batch has answered is
    left out of later ones, however long ago that was: only the keys of the answers are read for it.
    """

    def __init__(self, spark: SparkSession, folder: str, keys: Sequence[str] = ()) -> None:
        super().__init__(spark, folder)
        self.keys = list(keys)

    def write(self, rows: DataFrame, part: int) -> None:
        if self.keys:
            rows = rows.join(self.rows(rows.schema, but=part).select(*self.keys), self.keys, "left_anti").select(*rows.columns)
        super().write(rows, part)

    def __call__(self, rows: DataFrame, batch: int) -> None:
        if self.committed(batch):
            # Its answers stay; the state behind it may not have been kept, so it is made again.
            rows.write.format("noop").mode("overwrite").save()
            return
        self.write(rows, batch)
        self.commit(batch)

    def answers(self, schema: StructType) -> DataFrame:
        return self.rows(schema)

    def run(self, stream: DataFrame) -> None:
        """Process what has arrived; after a failure, called again with the same stream it goes on where it stopped."""
        query = stream.writeStream.foreachBatch(self).option("checkpointLocation", f"{self.folder}/log").trigger(availableNow=True).start()
        query.awaitTermination()
