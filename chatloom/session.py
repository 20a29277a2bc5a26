"""Session helpers: a configured SparkSession and a shared scratch location."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def get_spark(master: str | None = None, app: str = "chatloom", partitions: int | None = None) -> SparkSession:
    """Return a SparkSession tuned for the operators in this package.

    On a cluster, pass ``master=None`` and let spark-submit decide: shuffle partitions and
    memory then stay as the cluster sets them (AQE coalesces small partitions). Local runs
    get one shuffle partition per core and a large driver heap.
    """
    builder = SparkSession.builder.appName(app)
    local = bool(master) and master.startswith("local")
    if master:
        builder = builder.master(master)
    builder = (
        builder.config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.ui.retainedExecutions", "50")
        .config("spark.ui.retainedJobs", "100")
        .config("spark.ui.retainedStages", "100")
    )
    if partitions or local:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions or os.environ.get("BENCH_CPUS", "8")))
    if local:
        builder = builder.config("spark.driver.memory", os.environ.get("CHATLOOM_DRIVER_MEMORY", "16g"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the cluster (``spark.checkpoint.dir``).

    Only a local session without one (tests, trials) gets a private folder: on a cluster
    a folder of one machine would lose its parts, so that is an error.
    """
    sc = spark.sparkContext
    root = sc.getCheckpointDir()
    if not root:
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            root = tempfile.mkdtemp(prefix="chatloom-ckpt-")
        sc.setCheckpointDir(root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path below the shared checkpoint folder for written tables."""
    return f"{checkpoint_root(spark)}/chatloom-{name}-{uuid.uuid4().hex[:12]}"


#: Spark's setting to delete the shuffle files of a statement at its end, not when the driver collects garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Writer options of tables with texts, and of tables with arrays of token hashes (a dictionary holds each hash once a file).
TEXTS = {"compression": "zstd"}
HASHES = {"compression": "zstd", "parquet.dictionary.page.size": str(8 << 20)}


@contextmanager
def _shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def saved(df: DataFrame, name: str, options: dict[str, str] | None = None) -> DataFrame:
    """``df`` written to a scratch table in the shared folder and read back (cuts its lineage).

    The shuffle files of the write go with its end: nothing reads them again.
    """
    return saved_parts(df.sparkSession, [lambda: df], name, options)


def saved_parts(spark: SparkSession, parts: Iterable[Callable[[], DataFrame]], name: str, options: dict[str, str] | None = None) -> DataFrame:
    """:func:`saved` of the union of ``parts``, made and written one after the other.

    The shuffle files of a part, and the tables saved while it is made, go before the next.
    """
    path = scratch_path(spark, name)
    for part in parts:
        with scratch_block(spark), _shuffles_deleted(spark):
            df = part()
            df.write.mode("append").options(**(options or {})).parquet(path)
    _BLOCK.get().append(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.scratch = path
    return table


def shares(n: int | None, size: int, most: int) -> int:
    """How many shares of about ``size`` rows there are, ``most`` at most."""
    return max(1, min(most, -(-(n or 0) // size)))


def share(df: DataFrame, column: str, i: int, of: int) -> DataFrame:
    """The rows whose ``column`` falls to share ``i`` of ``of``."""
    return df if of == 1 else df.where(F.pmod(F.xxhash64(F.col(column), F.lit("share")), F.lit(of)) == i)


def saved_counted(df: DataFrame, name: str, options: dict[str, str] | None = None, **also: Column) -> tuple[DataFrame, int] | tuple[DataFrame, dict[str, int]]:
    """:func:`saved`, with the number of rows observed while they are written: no job counts them.

    With further aggregates in ``also``, all numbers come as a dictionary (the rows' is ``n``).
    """
    seen = Observation()
    table = saved(df.observe(seen, F.count(F.lit(1)).alias("n"), *[c.alias(k) for k, c in also.items()]), name, options)
    found = {k: int(v) for k, v in seen.get.items()}
    return (table, found) if also else (table, found["n"])


_SCRATCH: list[str] = []
#: Where :func:`saved` notes its tables: the innermost block's list.
_BLOCK: ContextVar[list[str]] = ContextVar("block", default=_SCRATCH)


def _delete(spark: SparkSession, path: str) -> bool:
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(jpath, True))


@contextmanager
def scratch_block(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Deletes the tables that :func:`saved` wrote inside at the block's end, but for those passed to the function it gives.

    A frame that leaves the block may read kept tables, and tables from outside, alone.
    """
    kept: set[str] = set()

    def keep(table: DataFrame) -> DataFrame:
        kept.add(table.scratch)
        return table

    outer, inner = _BLOCK.get(), []
    token = _BLOCK.set(inner)
    try:
        yield keep
    finally:
        _BLOCK.reset(token)
        for path in inner:
            if path in kept:
                outer.append(path)
            else:
                _delete(spark, path)


def release(table: DataFrame) -> None:
    """Delete a table of :func:`saved` that nothing reads any more, before its block's end."""
    _BLOCK.get().remove(table.scratch)
    _delete(table.sparkSession, table.scratch)


def lasting(table: DataFrame) -> DataFrame:
    """A table of :func:`saved` that outlives its blocks: only :func:`clear_scratch` deletes it. For narrow tables."""
    _BLOCK.get().remove(table.scratch)
    _SCRATCH.append(table.scratch)
    return table


def clear_scratch(spark: SparkSession) -> int:
    """Delete the scratch tables that :func:`saved` wrote so far; call it when their results are no
    longer read (between jobs of a long session). Returns how many were deleted."""
    n = 0
    while _SCRATCH:
        n += _delete(spark, _SCRATCH.pop())
    return n


_SHIPPED: set[str] = set()


def _write_shared_file(spark: SparkSession, path: str, data: bytes) -> None:
    """Write bytes to ``path`` through the Hadoop FileSystem of the session (any scheme)."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    jpath = jvm.org.apache.hadoop.fs.Path(path)
    out = jpath.getFileSystem(conf).create(jpath, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


def ship_package(spark: SparkSession) -> None:
    """Make ``chatloom`` importable in Python workers (pandas UDFs, ``mapInPandas``).

    The package is zipped once per application into the shared checkpoint folder and added
    with ``addPyFile``, which is how Spark distributes Python code to executors.
    """
    import io
    import zipfile

    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as zf:
        for root, _, files in os.walk(pkg_dir):
            for f in sorted(files):
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    zf.write(full, os.path.relpath(full, os.path.dirname(pkg_dir)))
    target = f"{checkpoint_root(spark)}/chatloom-pyfiles-{uuid.uuid4().hex[:12]}/chatloom.zip"
    _write_shared_file(spark, target, buf.getvalue())
    sc.addPyFile(target)
    _SHIPPED.add(app)
