"""Session helpers shared by every operator: scratch tables, checkpoints, worker imports."""

from __future__ import annotations

import atexit
import ctypes
import functools
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_ROOT = str(Path(__file__).resolve().parent.parent)
_made: list[tuple[SparkSession, str]] = []
#: Folders of local sessions that name none, by application.
_own: dict[str, str] = {}


#: Rows that a Python worker is sent at a time at most. Texts are long, and Spark's default of 10,000 rows can take
#: hundreds of megabytes on either side.
BATCH_ROWS = 2_000
#: Bytes of rows after which a batch ends, however few rows it has.
BATCH_BYTES = 16 << 20


def workers_can_import(spark: SparkSession) -> None:
    """Put this checkout on the Python path of workers started from now on, and bound what they are sent at a time."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    env = spark.sparkContext.environment
    parts = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if _ROOT not in parts:
        env["PYTHONPATH"] = os.pathsep.join([_ROOT, *parts])


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run``, a function over a task's batches, that gives back to the system what it has freed. Workers outlive their
    tasks, and what an idle one holds is missing elsewhere on its node."""

    @functools.wraps(run)
    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def keep_freed(limit: int = 256 << 20) -> None:
    """Let this process keep up to ``limit`` bytes that it frees, for what it allocates next, as far as the platform has
    a way to. For loops over large arrays, which the system would otherwise map and clear anew each time."""
    mallopt = getattr(ctypes.CDLL(None), "mallopt", None)
    if mallopt is not None:
        mallopt(-1, limit)  # M_TRIM_THRESHOLD
        mallopt(-3, 32 << 20)  # M_MMAP_THRESHOLD, at its largest


def give_back() -> None:
    """Return freed memory to the system, as far as the platform has a way to."""
    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def driver_gives_back(spark: SparkSession) -> None:
    """Have the driver's JVM collect its garbage, plans and finished shuffles among it, and return what its heap and its
    native allocator hold free, as far as it has a way to."""
    give_back()
    jvm = spark.sparkContext._jvm
    jvm.System.gc()
    try:
        args = spark.sparkContext._gateway.new_array(jvm.Object, 4)  # the last two are null: no arguments
        args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        # the server's class is not exported, so its method is that of an interface
        invoke = next(m for m in jvm.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), args)
    except Exception:  # noqa: BLE001  a JVM without that command keeps what it has
        return


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session without that setting gets a folder
    under the machine's temporary directory.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = Path(tempfile.mkdtemp(prefix="loomgraph-")).as_uri()
    return _own[app]


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/loomgraph-scratch/{name}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_drop_all)
    _made.append((spark, path))
    return path


def written(df: DataFrame, name: str, few_files: bool = False) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back: a reliable cut of the lineage whose columns
    can be read one by one. Unlike a checkpoint it survives the loss of every executor and costs no reread of
    unused columns. ``few_files`` is for tables much narrower than what they are made from: their rows are shuffled
    into partitions of the size that Spark advises, instead of a small file for each task."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    (df.hint("rebalance") if few_files else df).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def scratch_tables() -> list[str]:
    """Paths of the scratch tables that this process has made and not dropped, oldest first."""
    return [path for _, path in _made]


def drop_scratch(spark: SparkSession, paths: list[str]) -> None:
    """Delete scratch tables that nothing reads any more."""
    for path in paths:
        _drop(spark, path)
    _made[:] = [(s, p) for s, p in _made if p not in set(paths)]


def _drop(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _drop_all() -> None:
    for spark, path in _made:
        try:
            if spark.sparkContext._jsc is not None:
                _drop(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone at exit
            return
