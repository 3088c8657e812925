"""Written tables that cut lineage, kept in the folder the cluster shares."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only when its measured rows need no more than this.
BROADCAST_BYTES = 32 << 20
#: Spark's setting to delete the shuffle files of a query when it ends.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where it is unset, a new folder of this machine serves a local
    master, as in tests; on a cluster, whose executors wouldn't see it, that is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="gristmill-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; it goes when the JVM ends."""
    path = f"{shared_folder(spark)}/gristmill/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: it survives lost executors
    and is computed once, however often it is used. The write's shuffle files go when it ends: nothing runs
    ``df`` again. Else they would stay until the driver happens to collect its garbage."""
    spark = df.sparkSession
    path = new_path(spark, name)
    before = spark.conf.get(CLEAN_UP)
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEAN_UP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a materialized frame that nothing reads any more, as all made of it is written."""
    jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def broadcast_if_small(df: DataFrame, row_bytes: int, rows: int | None = None) -> DataFrame:
    """``df`` with a broadcast hint if its counted rows fit BROADCAST_BYTES, else unchanged, so that
    Spark joins it by shuffle. Give a materialized frame, as it is counted."""
    rows = df.count() if rows is None else rows
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def text_hash(text: str) -> Column:
    """With an id, what names a row: rows that agree in both repeat each other. Null counts as the empty text."""
    return F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))


def arrow_batches(spark: SparkSession, rows: int = 512) -> None:
    """Bound the rows of an Arrow batch that holds whole texts (the default of 10,000 long texts
    does not fit a Python worker). A smaller setting of the session stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) <= 0 or int(spark.conf.get(key)) > rows:
        spark.conf.set(key, str(rows))


def _give_back() -> None:
    """Return freed memory to the system: a worker lives on after its task, beside others."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not every C library has it
        pass


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``df.mapInArrow`` with a worker that gives back what it has freed when a task ends."""

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        _give_back()

    return df.mapInArrow(tidy, schema)
