"""What the operators share: reading tables, staging in the shared folder, Arrow helpers."""

from __future__ import annotations

import atexit
import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Code points (or bytes) that one step of a vectorised kernel takes; a longer text is a step of its own.
STEP = 3_000_000
#: Where stages go if spark.checkpoint.dir is unset and the driver is the only process.
LOCAL_DIR = "/tmp/checkpoints/sieveline"
#: Bytes of rows that go to Python in one batch while a stage is written (Spark's own default is 64 MB or more).
BATCH_BYTES = 5_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table `name` of the data folder, read through Spark so that any store works."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Unset, it is LOCAL_DIR in local mode (as in tests), else an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = LOCAL_DIR
    return path.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
        hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop_path, True)
    except Exception:  # noqa: BLE001 - the session may have ended; leftovers are harmless
        pass


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the driver's Python ends."""
    path = f"{shared_dir(spark)}/sieveline-{name}-{uuid.uuid4().hex[:12]}"
    atexit.register(_remove, spark, path)
    return path


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as a table in the shared folder and read it again: cuts lineage, survives lost executors.

    While it is written, batches for Python are of BATCH_BYTES at most, or of one row; both sides hold one at a time.
    Its shuffle files go as soon as it is written; else they stay until the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    settings = {"spark.sql.execution.arrow.maxBytesPerBatch": str(BATCH_BYTES), "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Remove the files of a staged table that nothing needs any more."""
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if "/sieveline-" in path:
            _remove(df.sparkSession, path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def spans(lengths: np.ndarray, step: int = STEP) -> Iterator[tuple[int, int]]:
    """Row ranges whose summed lengths stay near `step`; each has one row at least."""
    if not len(lengths):
        return
    ends = np.cumsum(lengths, dtype=np.int64)
    at = 0
    while at < len(lengths):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + step, side="right")))
        yield at, to
        at = to


def binary_rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all rows back to back, offsets) of a string or binary column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else pa.binary()
    column = column.cast(kind)
    if column.null_count:
        column = column.fill_null(b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    width = np.int64 if kind == pa.large_binary() else np.int32
    _, raw, data = column.buffers()
    offsets = np.frombuffer(raw, width, len(column) + 1, column.offset * np.dtype(width).itemsize).astype(np.int64)
    body = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return body[offsets[0] : offsets[-1]], offsets - offsets[0]


def text_steps(column: pa.Array, step: int = 1 << 18) -> Iterator[tuple[int, int, list[str]]]:
    """(first row, last row, texts) of a string column by steps of about `step` bytes; nulls are empty."""
    lengths = np.diff(binary_rows(column)[1])
    for a, b in spans(lengths, step):
        yield a, b, [x or "" for x in column[a:b].to_pylist()]


def release() -> None:
    """Give this worker's free memory back to the system: Spark keeps idle workers for the next task."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library alone
    if trim is not None:
        trim(0)


def arrow_map(kernel: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], forget: Callable[[], None] = lambda: None):
    """A mapInArrow function that applies `kernel` to each batch; when they end, it calls `forget` and gives free memory back."""

    def run(batches):
        batch = None
        try:
            for batch in batches:
                if batch.num_rows:
                    yield from kernel(batch)
        finally:
            del batch
            forget()
            release()

    return run
