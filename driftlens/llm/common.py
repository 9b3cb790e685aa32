"""What the operators of this subpackage share: table reading, shared scratch space and Arrow batch helpers."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables; the path may be in any store that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where it is unset, and Spark runs in this
    process alone, a temporary one; on a cluster that would be another folder on each machine, so it is an error."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    known = context._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get().rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    if context.applicationId not in _OWN:
        _OWN[context.applicationId] = tempfile.mkdtemp(prefix="driftlens-")
    return _OWN[context.applicationId]


#: Temporary folders of local sessions, by application.
_OWN: dict[str, str] = {}

#: Bytes of an Arrow batch between the JVM and Python; Spark's own bound is 64 MB for each running task, on both sides.
BATCH = ("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def shorten_batches(spark: SparkSession) -> None:
    """The same from now on, for results that the caller writes."""
    spark.conf.set(*BATCH)


@contextlib.contextmanager
def short_batches(spark: SparkSession) -> Iterator[None]:
    """Within it, jobs move texts between the JVM and Python in batches of ``BATCH`` bytes."""
    key = BATCH[0]
    before = spark.conf.get(key, None)
    shorten_batches(spark)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def stash(df: DataFrame, name: str, partitions: int | None = None) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet to the shared folder and read it back with the same schema.

    A lost executor then costs a re-read only. The files go with ``discard``, or when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/driftlens-{name}-{uuid.uuid4().hex}"
    with short_batches(spark):
        (df.coalesce(partitions) if partitions else df).write.parquet(path)
    folder, system = _hadoop(spark, path)
    system.deleteOnExit(folder)
    out = spark.read.schema(df.schema).parquet(path)
    out._driftlens_path = path
    return out


def _hadoop(spark: SparkSession, path: str) -> tuple:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def discard(df: DataFrame) -> None:
    """Delete the files of a stashed table that nothing reads any more; its own DataFrame must be given."""
    folder, system = _hadoop(df.sparkSession, df._driftlens_path)
    system.delete(folder, True)


def release() -> None:
    """Give freed memory back to the system: idle Python workers otherwise hold the peak of their last task."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it, other C libraries need not
    if trim:
        trim(0)


#: What this worker keeps from one task to the next, such as vocabularies and the pieces met.
KEPT: dict = {}


def forget() -> None:
    """Drop what tasks of another operator left in this worker: workers outlive operators, and a vocabulary with its
    pieces would stand beside all that later ones need."""
    if KEPT:
        KEPT.clear()
        release()


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256, keep: bool = False) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into short ones, so that Python holds few texts at a time; without ``keep``, ``KEPT`` goes."""
    if not keep:
        forget()
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    batch = None
    release()


def arrow_rows(
    work: Callable[[pa.RecordBatch], dict[str, list]], schema: pa.Schema, rows: int = 256
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A ``mapInArrow`` function from one that turns a short batch into columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, rows):
            yield pa.RecordBatch.from_pydict(work(batch), schema=schema)

    return run
