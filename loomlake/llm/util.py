"""What the operators share: tables cut into the shared folder, size-checked broadcasts, batches bounded by bytes."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import logging
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

log = logging.getLogger(__name__)

#: Rows up to which a table is broadcast; each such table has narrow rows of fixed width, so this bounds its size.
BROADCAST_ROWS = 100_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is the one in spark.checkpoint.dir. Where that is unset and there is only this machine, as in tests, a temporary
    folder is made and set for the session, and goes when the driver ends; on a cluster it must be set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="loomlake-")
        atexit.register(shutil.rmtree, own, True)
        found = f"file://{own}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


@cache
def _own_folder(folder: str, session: SparkSession) -> str:
    """The application's folder, which goes when the driver's Python ends; results are read from it until then."""
    settings = session._jsc.hadoopConfiguration()  # with what gives access to the folder's store

    def remove() -> None:
        try:
            path = session._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(settings).delete(path, True)
        except Exception as e:  # the JVM has gone first
            log.warning("left %s: %s", folder, e)

    atexit.register(remove)
    return folder


def new_path(spark: SparkSession, name: str) -> str:
    return f"{_own_folder(f'{shared_dir(spark)}/loomlake/{spark.sparkContext.applicationId}', spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends here, and lost executors cost no recomputation."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def by_key(df: DataFrame) -> DataFrame:
    """df with a hint that joins move it by key. Spark's estimates take files by their compressed size and leave out what explode adds, so it would broadcast tables that no driver holds."""
    return df.hint("merge")


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it is a written table of at most so many narrow rows; moved by key otherwise."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else by_key(df)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def give_back() -> None:
    """Returns memory that a worker process has freed to the system, as idle workers stay beside those of the next stage."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def byte_slices(batch: pa.RecordBatch, column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with about limit bytes in the column; a longer row stands alone."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).tolist()
    begin = total = 0
    for i, n in enumerate(sizes):
        if i > begin and total + n > limit:
            yield batch.slice(begin, i - begin)
            begin, total = i, 0
        total += n
    yield batch.slice(begin)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like these that df has no column of."""
    held = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in held:
            name = f"_{name}"
        out.append(name)
    return out
