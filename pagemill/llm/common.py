"""Shared helpers: durable intermediate tables and row identity."""

from __future__ import annotations

import atexit
import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as Java and RE2 character-class text.
WS = r"\x20\x09-\x0D"

#: Spark's setting that removes an execution's shuffle files when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Spark's bound on the bytes of a batch sent to a Python worker; an executor holds several batches a task.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 16 << 20

_own_dir: list[str] = []
_written: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; one of our own only in local mode, where the session names none (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _own_dir:
        _own_dir.append("file://" + tempfile.mkdtemp(prefix="pagemill-"))
    return _own_dir[0]


def staged(df: DataFrame, name: str, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """``df`` written as a Parquet table in the shared folder and read back.

    This cuts lineage: a lost executor costs a re-read, not a recomputation.  The shuffle files of the
    write are removed when it ends, since the table replaces them; the table is removed by ``forget``
    or when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/pagemill-{name}-{uuid.uuid4().hex}"
    wanted = {CLEANUP: "true", BATCH: str(batch_bytes)}
    before = {k: spark.conf.get(k, None) for k in wanted}
    known = [k for k, v in before.items() if v is not None]
    for k in known:
        spark.conf.set(k, wanted[k])
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        for k in known:
            spark.conf.set(k, before[k])
    _written[path] = spark
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Remove the table behind a ``staged`` frame that no later result reads."""
    for path in [p for p in _written if any(f.startswith(p + "/") for f in df.inputFiles()[:1])]:
        _remove(path, _written.pop(path))


def _remove(path: str, spark: SparkSession) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _clean() -> None:
    for path, spark in _written.items():
        try:
            _remove(path, spark)
        except Exception:  # the session may be gone already; the folder belongs to the job anyway
            return


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow, giving memory back to the system when a task ends.

    Python workers are kept for later tasks; what their allocators hold would stand beside the JVM's heap
    through stages that use no Python at all.
    """

    @functools.wraps(run)
    def call(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
            if trim is not None:
                trim(0)

    return call


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tasks(spark: SparkSession) -> int:
    """Partitions that the session wants after a shuffle."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
