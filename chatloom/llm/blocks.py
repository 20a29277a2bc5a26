"""Packed exchanges between blocks of documents and ranges of keys.

Looking up every word, n-gram or chunk of a corpus by one shuffled row each is dear. Here a
task packs consecutive documents into a *block* of bounded size and sends, for every range of
key hashes (a *part*), one row that holds the block's distinct keys of that range. All rows of
a part meet in one task, which resolves each distinct key once and answers every block that
asked; the answers and the block's documents then meet by block. So

- a frequent key reaches its part once per block (it is pre-aggregated where it is read);
- groups are bounded: a block by `block_bytes` of text, a part by the number of parts;
- Spark does the partitioning, shuffling and recovery; numpy works inside tasks.

Rows are ``(block string, part int, blob binary)``; a blob is a compressed Arrow table, and the
documents of a block travel in the row with part -1.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from chatloom.llm.util import save
from chatloom.session import ship_package

ROWS = "block string, part int, blob binary"
DOCS = -1
#: Text bytes after which a block is closed; one longer text makes a block of its own.
BLOCK_BYTES = 8 << 20

def to_blob(table: pa.Table, level: int = 3) -> bytes:
    sink = pa.BufferOutputStream()
    options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=level))
    with pa.ipc.new_stream(sink, table.schema, options=options) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def from_blob(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(blob).read_all()


def lean(table: pa.Table, size: int = 256) -> pa.Table:
    """`table` in small batches, so that the JVM receives little at a time; memory that Arrow holds for reuse is given back."""
    pa.default_memory_pool().release_unused()
    return pa.concat_tables([table.slice(i, size) for i in range(0, len(table), size)] or [table])


def rows(triples: Iterable[tuple[str, int, bytes]]) -> pa.RecordBatch:
    block, part, blob = zip(*triples) if (triples := list(triples)) else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(block, pa.string()), pa.array(part, pa.int32()), pa.array(blob, pa.binary())], names=["block", "part", "blob"])


def pack(docs: DataFrame, make: Callable[[pa.Table], Iterable[tuple[int, pa.Table]]], text: str, name: str | None, block_bytes: int = BLOCK_BYTES, level: int = 3) -> DataFrame:
    """Blocks of `docs` as rows, saved under `name`. `make` gets a block's documents and yields (part, table)s.

    Blocks are numbered within their partition. Without a name nothing is saved; `docs` must then
    read the same rows in the same partitions each time, as a scan of files does.
    """
    at = docs.columns.index(text)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, held, partition, number = [], 0, TaskContext.get().partitionId(), count()

        def close() -> pa.RecordBatch:
            block = f"{partition}-{next(number)}"
            return rows((block, part, to_blob(t, level)) for part, t in make(pa.Table.from_batches(waiting)))

        for batch in batches:
            start = 0
            sizes = pc.binary_length(batch.column(at)).fill_null(0)
            for i, size in enumerate(sizes.to_pylist()):
                if held and held + size + 16 > block_bytes:
                    waiting.append(batch.slice(start, i - start))
                    yield close()
                    waiting, held, start = [], 0, i
                    pa.default_memory_pool().release_unused()
                held += size + 16
            waiting.append(batch.slice(start))
        if any(b.num_rows for b in waiting):
            yield close()

    ship_package(docs.sparkSession)
    packed = docs.mapInArrow(run, ROWS)
    return save(packed, name) if name else packed


def answer(packed: DataFrame, resolve: Callable[[list[tuple[str, pa.Table]]], Iterable[tuple[str, pa.Table]]]) -> DataFrame:
    """Answers for every block: `resolve` gets all (block, table)s of one part and yields (block, table)s."""

    def run(key: tuple, group: pa.Table) -> pa.Table:
        asked = [(b, from_blob(x)) for b, x in zip(group["block"].to_pylist(), group["blob"].to_pylist())]
        part = key[0].as_py()
        return lean(pa.Table.from_batches([rows((b, part, to_blob(t)) for b, t in resolve(asked))]))

    return packed.where(f"part <> {DOCS}").groupBy("part").applyInArrow(run, ROWS)


def finish(packed: DataFrame, answers: DataFrame, fn: Callable[..., pa.Table], schema: str, named: bool = False) -> DataFrame:
    """`fn` gets a block's documents and all answers to it, in the order of their parts; if `named`, the block's name before them."""

    def run(group: pa.Table) -> pa.Table:
        tables = sorted(zip(group["part"].to_pylist(), group["blob"].to_pylist()))
        if tables[0][0] != DOCS or any(p == DOCS for p, _ in tables[1:]):
            raise ValueError("a block needs its documents once")
        name = [group["block"][0].as_py()] if named else []
        return lean(fn(*name, from_blob(tables[0][1]), [from_blob(x) for _, x in tables[1:]]))

    return packed.where(f"part = {DOCS}").unionByName(answers).groupBy("block").applyInArrow(run, schema)


def split_parts(hashes: np.ndarray, parts: int) -> list[np.ndarray]:
    """Positions of the keys of each part, by their hash."""
    part = (hashes % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    return np.split(order, np.searchsorted(part[order], np.arange(1, parts)))


def ask(packed: DataFrame, make: Callable[[pa.Table], Iterable[tuple[int, pa.Table]]]) -> DataFrame:
    """Key rows that `make` derives from each block's documents, beside those that were packed."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                yield rows((block, part, to_blob(t)) for part, t in make(from_blob(blob.as_buffer())))
                pa.default_memory_pool().release_unused()

    return packed.where(f"part = {DOCS}").select("block", "blob").mapInArrow(run, ROWS)


def deltas(keys: np.ndarray) -> pa.Array:
    """Sorted distinct keys as differences, in 32 bits where they fit."""
    d = np.diff(keys, prepend=np.uint64(0))
    return pa.array(d.astype(np.uint32) if not len(d) or d[1:].max(initial=0) < 1 << 32 and d[0] < 1 << 32 else d)


def undelta(column: pa.ChunkedArray) -> np.ndarray:
    return np.cumsum(column.to_numpy().astype(np.uint64), dtype=np.uint64)


#: Bits of the keys that `shared_counts` sends; more than one hash may share a key.
KEY_BITS = 48


def short(hashes: np.ndarray) -> np.ndarray:
    """The upper bits of 64-bit hashes, which keep their order."""
    return hashes >> np.uint64(64 - KEY_BITS)


def by_range(keys: np.ndarray, parts: int) -> Iterator[tuple[int, int, int]]:
    """(part, from, to) of sorted short keys, for the parts that have any."""
    part = (keys * np.uint64(parts)) >> np.uint64(KEY_BITS)
    ends = np.searchsorted(part, np.arange(parts + 1).astype(np.uint64))
    for p, (a, b) in enumerate(zip(ends.tolist(), ends[1:].tolist())):
        if b > a:
            yield p, a, b


def shared_counts(packed: DataFrame, hashes: Callable[[pa.Table], list[np.ndarray]], parts: int) -> DataFrame:
    """Answers to each block: its short keys that stand in two documents or more, and in how many.

    `hashes` gives the distinct sorted 64-bit hashes of each document of a block.
    """

    def make(block: pa.Table):
        found = [short(h) for h in hashes(block)]
        key, count = np.unique(np.concatenate(found), return_counts=True) if found else (np.empty(0, np.uint64), np.empty(0, np.int64))
        for p, a, b in by_range(key, parts):
            yield p, pa.table({"key": deltas(key[a:b]), "count": pa.array(count[a:b], pa.int32())})

    def resolve(asked):
        keys = [undelta(t["key"]) for _, t in asked]
        distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(place, np.concatenate([t["count"].to_numpy() for _, t in asked]), len(distinct)).astype(np.int64)
        at = 0
        for (block, _), k in zip(asked, keys):
            n = total[place[at:at + len(k)]]
            at += len(k)
            if (several := n > 1).any():
                yield block, pa.table({"key": deltas(k[several]), "n": pa.array(n[several])})

    return answer(ask(packed, make), resolve)


def joined_counts(answers: list[pa.Table]) -> tuple[np.ndarray, np.ndarray]:
    """The sorted keys of a block's answers and their numbers of documents."""
    if not answers:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.concatenate([undelta(t["key"]) for t in answers]), np.concatenate([t["n"].to_numpy() for t in answers])


def lookup(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of `wanted` in sorted `keys`, and which of them are there."""
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    return at, keys[at] == wanted if len(keys) else np.zeros(len(wanted), bool)
