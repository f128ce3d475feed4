"""Folders watched as streams: new files, quiet periods, and re-indexing of what came."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..functions.paths import EXTENSIONS, has_extension, normalize_key
from ..operators.catalog import upsert

DEBOUNCE = "3 seconds"
FILES = "path string, modificationTime timestamp, length bigint, content binary"


def changes(spark: SparkSession, root: str, extensions=EXTENSIONS, per_trigger: int = 10_000) -> DataFrame:
    """A stream of path, key, mtime, size of files that come to a folder; a file source doesn't report deletions."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", True).option("maxFilesPerTrigger", per_trigger).load(root)
    path = F.regexp_replace("path", "^file:/*", "/")
    return files.filter(has_extension(F.col("path"), extensions)).select(path.alias("path"), normalize_key(path).alias("key"), (F.unix_millis("modificationTime") / 1000).alias("mtime"), F.col("length").alias("size"))


def debounced(events: DataFrame, time_col: str, quiet: str = DEBOUNCE, keys: tuple[str, ...] = (), late: str | None = None) -> DataFrame:
    """keys, started, ended, n_events: one row for each run of events without a pause over quiet. Streams need late, a watermark."""
    if late:
        events = events.withWatermark(time_col, late)
    runs = events.groupBy(*keys, F.session_window(time_col, quiet).alias("w")).agg(F.count("*").alias("n_events"), F.max(time_col).alias("last"))
    return runs.select(*keys, F.col("w.start").alias("started"), F.col("last").alias("ended"), "n_events")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one that spark.checkpoint.dir names; below a temporary one where it is unset, if this is the only machine."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        own = tempfile.mkdtemp(prefix="loomlake-")
        atexit.register(shutil.rmtree, own, True)
        shared = f"file://{own}"
        spark.conf.set("spark.checkpoint.dir", shared)
    return f"{shared.rstrip('/')}/loomlake-{name}/{spark.sparkContext.applicationId}-{uuid.uuid4().hex}"


class Merged:
    """A table below base that micro-batches are merged into by key; a batch's version is named after it, so one that runs again rewrites its own."""

    def __init__(self, spark: SparkSession, base: str, schema: StructType, key: str, order_col: str | None = None):
        self.spark, self.base, self.schema, self.key, self.order_col = spark, base.rstrip("/"), schema, key, order_col

    def batches(self) -> list[int]:
        """The complete versions, which are the batches merged so far."""
        top = self.spark._jvm.org.apache.hadoop.fs.Path(self.base)
        fs = top.getFileSystem(self.spark._jsc.hadoopConfiguration())
        found = [s.getPath() for s in fs.listStatus(top)] if fs.exists(top) else []
        done = (p for p in found if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))
        return sorted(int(p.getName().removeprefix("batch-")) for p in done)

    def table(self, before: int | None = None) -> DataFrame:
        held = [b for b in self.batches() if before is None or b < before]
        return self.spark.read.schema(self.schema).parquet(f"{self.base}/batch-{held[-1]}") if held else self.spark.createDataFrame([], self.schema)

    def merge(self, batch: DataFrame, number: int) -> None:
        rows = batch.withColumn("_at", F.col(self.order_col)) if self.order_col else batch
        merged = upsert(self.table(before=number), rows, self.key, "_at" if self.order_col else None)
        merged.write.mode("overwrite").parquet(f"{self.base}/batch-{number}")


def merge_into(stream: DataFrame, held: Merged, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Merges each micro-batch into the table; without every, once for all there is."""
    writer = stream.writeStream.foreachBatch(held.merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def watch(stream: DataFrame, on_change: Callable[[DataFrame], object], checkpoint: str, every: str | None = DEBOUNCE) -> StreamingQuery:
    """Calls on_change with the files of each micro-batch, one batch at a time; without every, once for all there is.

    stop() pauses; a start with the same checkpoint goes on where it stopped.
    """

    def run(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            on_change(batch)

    writer = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
