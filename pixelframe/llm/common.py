"""What the operators of this subpackage share: reading tables, cutting lineage, joins of a checked size, byte-bounded Arrow batches."""

from __future__ import annotations

import contextlib
import contextvars
import ctypes
import functools
import gc
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelframe.tables import shared_dir

#: A side of a join is broadcast only if its counted rows, at the given bytes each, stay below this.
BROADCAST_BYTES = 16 << 20
#: Most rows and bytes of an Arrow batch between the JVM and Python; a single longer row is a batch of its own.
ARROW_ROWS, ARROW_BYTES = 2000, 4 << 20
#: Bytes of a row group in written tables, which a task holds while it writes.
ROW_GROUP = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder, through Spark's own reader (any file system). One of fewer files, and fewer splits by
    its size, than the cluster has cores is dealt out to all of them; this moves at most one split for each core."""
    df, cores = spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    few = size < cores * int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()) and len(df.inputFiles()) < cores
    return df.repartition(cores) if few else df


def written(df: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: cuts the lineage, survives lost executors, and keeps
    what was computed from being computed again by later readers. `folder` is one that outlives a `scratch`."""
    path = f"{folder or _folder.get() or tables(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").option("parquet.block.size", ROW_GROUP).parquet(path)
    release_driver(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Where tables go inside a `scratch`; each thread of the driver has its own.
_folder: contextvars.ContextVar[str | None] = contextvars.ContextVar("folder", default=None)


def tables(spark: SparkSession) -> str:
    """This application's folder in the shared one."""
    return f"{shared_dir(spark)}/pixelframe-{spark.sparkContext.applicationId}"


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """Tables written inside go at the end, but for those written to the folder that this gives."""
    outer = _folder.get() or tables(spark)
    inner = f"{outer}/scratch-{uuid.uuid4().hex}"
    before = _folder.set(inner)
    try:
        yield outer
    finally:
        _folder.reset(before)
        discard(spark, inner)


def discard(spark: SparkSession, folder: str | None = None) -> None:
    """Delete the tables that this application has written (to one folder), once their results have been read or stored."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder or tables(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def join_small(left: DataFrame, right: DataFrame, on: str | list[str], how: str, row_bytes: int, rows: int | None = None) -> DataFrame:
    """Join with a side that is usually small: broadcast if its counted rows fit BROADCAST_BYTES, else a sort-merge join,
    whose skewed partitions AQE splits."""
    rows = right.count() if rows is None else rows
    if rows * row_bytes <= BROADCAST_BYTES:
        return left.join(F.broadcast(right), on, how)
    return left.join(right.hint("merge"), on, how)


def by_bytes(batches: Iterable[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """The same rows in slices whose `column` holds about `limit` bytes at most (a longer value stands alone)."""
    import numpy as np
    import pyarrow.compute as pc

    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64))
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def bounded_arrow(spark: SparkSession) -> None:
    """Hold the session's Arrow batches to ARROW_ROWS and ARROW_BYTES, unless it has set less itself."""
    for name, most in (("maxRecordsPerBatch", ARROW_ROWS), ("maxBytesPerBatch", ARROW_BYTES)):
        now = (spark.conf.get(f"spark.sql.execution.arrow.{name}") or "").removesuffix("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(most))


def release() -> None:
    """Give memory back to the system that a reused Python worker would keep after its task."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def release_driver(spark: SparkSession) -> None:
    """Give memory back that the driver's JVM keeps: a heap grown beyond half of its limit is collected, which shrinks it
    and drops the state of shuffles that are over; then what its native allocator holds free goes back to the system,
    where the JVM can do that. Long rows of jobs with many tasks would else let both grow up to their limits together."""
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    heap = jvm.java.lang.Runtime.getRuntime()
    if heap.totalMemory() > heap.maxMemory() // 2:
        jvm.java.lang.System.gc()
    with contextlib.suppress(Py4JError):
        strings, types, args = gateway.jvm.java.lang.String, gateway.new_array(jvm.java.lang.Class, 4), gateway.new_array(jvm.java.lang.Object, 4)
        kind = jvm.java.lang.Class.forName
        for i, name in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
            types[i] = kind(name)
        args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        args[2], args[3] = gateway.new_array(jvm.java.lang.Object, 1), gateway.new_array(strings, 1)
        args[2][0], args[3][0] = gateway.new_array(strings, 0), "[Ljava.lang.String;"
        # by the interface's method, since the server's own class is not open to reflection
        kind("javax.management.MBeanServer").getMethod("invoke", types).invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), args)


def released(run: Callable[[Iterator], Iterator], *caches: Callable[[], None]) -> Callable[[Iterator], Iterator]:
    """The function for mapInArrow, after which `caches` are emptied and memory is given back."""

    @functools.wraps(run)
    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            for empty in caches:
                empty()
            release()

    return wrapped


def packed(df: DataFrame) -> Column:
    """All columns of df as one struct, so that no name of theirs can clash with an operator's own."""
    return F.struct(F.lit(True).alias("row"), *[df[c].alias(f"c{i}") for i, c in enumerate(df.columns)])


def unpacked(df: DataFrame, column: str, names: list[str], *more: Column) -> DataFrame:
    """The columns that `packed` put into `column`, under their names, and `more`."""
    return df.select(*[F.col(column)[f"c{i}"].alias(c) for i, c in enumerate(names)], *more)
