"""Tables and files that every executor can see.

All intermediate tables go below ``spark.checkpoint.dir``, the folder that the
cluster shares between driver and executors.  Where a session has no such
setting (unit tests in local mode), a folder is set once for the session.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_MADE: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by the session; local mode without one gets a temporary folder."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder shared by all executors")
        named = "file://" + tempfile.mkdtemp(prefix="gleaner-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store; a missing one is fine."""
    fs, p = _fs(spark, path)
    fs.delete(p, True)
    _MADE.pop(path, None)


@atexit.register
def _clean() -> None:
    for path, spark in list(_MADE.items()):
        try:
            if spark.sparkContext._jsc is not None:
                remove(spark, path)
        except Exception:  # the JVM may already be gone at exit
            return


def new_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder path in the shared store, deleted when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _MADE[path] = spark
    return path


BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_ROWS = "1000"


def table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared store and read it back: lineage ends here.

    While it is written, Arrow batches are small, since rows may hold whole texts.
    """
    path = new_dir(df.sparkSession, name)
    conf = df.sparkSession.conf
    before = conf.get(BATCH, None)
    conf.set(BATCH, BATCH_ROWS)
    try:
        df.write.parquet(path)
    finally:
        conf.unset(BATCH) if before is None else conf.set(BATCH, before)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._gleaner_path = path
    return back


def drop(df: DataFrame) -> None:
    """Delete a table made by :func:`table` once nothing reads it any more."""
    path = getattr(df, "_gleaner_path", None)
    if path:
        remove(df.sparkSession, path)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def without(df: DataFrame, *names: str) -> list[str]:
    """Columns of ``df`` other than ``names`` (case-insensitive), quoted for select."""
    low = {n.lower() for n in names}
    return [f"`{c}`" for c in df.columns if c.lower() not in low]


def schema(text: str) -> T.StructType:
    return T.StructType.fromDDL(text) if hasattr(T.StructType, "fromDDL") else T._parse_datatype_string(text)


def trim() -> None:
    """Give a worker's free memory back: workers outlive a stage and share an executor's memory."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        return


def open_fs(uri: str):
    """(filesystem, path) of a URI for use inside a task: local, HDFS, S3 or GCS through Arrow."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)
