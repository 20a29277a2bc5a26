"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatloom.session import scratch_path, ship_package

#: Separators of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing: every ASCII byte but digits and a-z.
_PLAIN = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20
               for b in bytes(range(0x41)) + bytes(range(0x61, 0x7B)) + bytes(range(0x5B, 0x100)))


def plain_words(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z only) words of letters, digits and non-ASCII characters; none for null."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_PLAIN).split()


def space_words(text: str | None, lower: bool = False) -> list[bytes]:
    """Words between the bytes space and \\t-\\r (what ``bytes.split`` splits on); none for null."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return (raw.lower() if lower else raw).split()


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, size: int = 1000) -> DataFrame:
    """Apply ``fn`` to the rows of ``df`` in Arrow batches of at most ``size``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, size):
                yield fn(batch.slice(start, size))
            pa.default_memory_pool().release_unused()

    ship_package(df.sparkSession)
    return df.mapInArrow(run, schema)


def save(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a fresh table in the shared checkpoint folder and read it back.

    This cuts the lineage in storage that all executors share, so a lost executor costs no
    recomputation of what was saved.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.saved_at = path
    return table


def release(*tables: DataFrame) -> None:
    """Delete saved tables that nothing reads any more; the disk they take is then free for later steps."""
    for table in tables:
        spark = table.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table.saved_at)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")


def parts_of(spark: SparkSession) -> int:
    """Number of key ranges for packed exchanges: at least 64, and twice the shuffle partitions."""
    return max(64, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns, also where other columns clash with them in case only."""
    fields = df.columns
    picked = []
    for n in names:
        same = [i for i, c in enumerate(fields) if c == n] or [i for i, c in enumerate(fields) if c.lower() == n.lower()]
        if not same:
            raise ValueError(f"no column {n!r} among {fields}")
        picked.append(same[0])
    renamed = df.toDF(*[f"_c{i}" for i in range(len(fields))])
    return renamed.select(*[F.col(f"_c{i}").alias(n) for i, n in zip(picked, names)])


def by_group(df: DataFrame, keys: list[str], fn: Callable[[pa.Table], pa.Table | None], schema: str) -> DataFrame:
    """Apply ``fn`` to each group of equal (integer) keys; groups must be small.

    Rows are dealt and sorted by the keys and streamed, so a task holds one batch and one group,
    and many small groups cost little each.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def ready(table: pa.Table, last: bool) -> tuple[list[pa.RecordBatch], pa.Table]:
            cols = [table[k].to_numpy() for k in keys]
            new = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
            ends = [0, *new.tolist(), *([table.num_rows] if last else [])]
            out = [fn(table.slice(a, b - a)) for a, b in zip(ends, ends[1:])]
            got = [b for t in out if t is not None for b in t.to_batches()]
            whole = pa.Table.from_batches(got).combine_chunks().to_batches() if got else []
            return whole, table.slice(ends[-1])

        for batch in batches:
            held.append(batch)
            out, rest = ready(pa.Table.from_batches(held).combine_chunks(), False)
            held = rest.to_batches()
            yield from out
        if sum(b.num_rows for b in held):
            yield from ready(pa.Table.from_batches(held).combine_chunks(), True)[0]

    ship_package(df.sparkSession)
    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def shelter(docs: DataFrame, *own: str) -> tuple[DataFrame, list[str]]:
    """`docs` with the columns `own` under these names and all others under names that clash with nothing.

    Returns it with the former names, for `.toDF(*names)` on a result with the same columns.
    """
    names = docs.columns
    chosen = {}
    for n in own:
        same = [i for i, c in enumerate(names) if c == n] or [i for i, c in enumerate(names) if c.lower() == n.lower()]
        if same:
            chosen[same[0]] = n
    return docs.toDF(*[chosen.get(i, f"_x{i}") for i in range(len(names))]), names
