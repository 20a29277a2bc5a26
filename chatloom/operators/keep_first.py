"""Sequential keep-first over components (D5): one sorted pass, streamed through Arrow batches.

Rows of a component come to one task in the order of their sets; the task holds what it has kept of
the component at hand and nothing else.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from chatloom.session import ship_package

#: Bits of a sketch of a kept set.
_BITS = 512


def _lists(column: pa.ListArray) -> tuple[np.ndarray, list[int]]:
    return column.values.to_numpy(), column.offsets.to_pylist()


def _sketch(tokens: np.ndarray) -> np.ndarray:
    """Parity of the tokens per bit: sets differ in at least as many tokens as their sketches in bits."""
    odd = np.bincount(tokens & (_BITS - 1), minlength=_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64)


class _Kept:
    """Sketches, sizes and sorted tokens of the sets that a component has kept."""

    def __init__(self):
        self.n, self.room = 0, 16
        self.sketch = np.empty((self.room, _BITS // 64), np.uint64)
        self.sizes, self.shared = np.empty(self.room, np.int64), np.empty(self.room, np.int64)
        self.tokens: list[np.ndarray] = []
        self.keys: list[frozenset] = []

    def add(self, sketch: np.ndarray, size: int, tokens: np.ndarray, keys: frozenset) -> None:
        if self.n == self.room:
            self.room *= 2
            self.sketch = np.resize(self.sketch, (self.room, self.sketch.shape[1]))
            self.sizes, self.shared = np.resize(self.sizes, self.room), np.resize(self.shared, self.room)
        self.sketch[self.n], self.sizes[self.n], self.shared[self.n] = sketch, size, len(tokens)
        self.tokens.append(np.sort(tokens))
        self.keys.append(keys)
        self.n += 1

    def similar(self, sketch: np.ndarray, size: int, tokens: np.ndarray, keys: frozenset, threshold: float) -> bool:
        """Whether a kept set is similar; only those whose sketch leaves it open are compared, the nearest first."""
        if not self.n:
            return False
        differ = np.bitwise_count(self.sketch[:self.n] ^ sketch).sum(1, dtype=np.int64)
        need = np.ceil((self.sizes[:self.n] + size) * (threshold / (1 + threshold)) - 1e-9)
        may = np.flatnonzero(self.shared[:self.n] + len(tokens) - differ >= 2 * need)
        for i in may[np.argsort(differ[may], kind="stable")].tolist():
            other = self.tokens[i]
            if not len(other):
                continue
            at = np.searchsorted(other, tokens)
            at[at == len(other)] = 0
            both = int(np.count_nonzero(other[at] == tokens))
            if both / (int(self.sizes[i]) + size - both) >= threshold and (not keys or not keys.isdisjoint(self.keys[i])):
                return True
        return False


def _streamed(rows: DataFrame, run) -> DataFrame:
    ship_package(rows.sparkSession)
    return rows.repartition("comp").sortWithinPartitions("comp", "rep").mapInArrow(run, "x long")


def stream_keep_first(rows: DataFrame, threshold: float) -> DataFrame:
    """Dropped sets ``(x)`` of ``rows(comp, rep, n, toks[, keys])``: those similar to a lower kept set of their component.

    ``n`` is a set's size; ``toks`` may leave out tokens that no other set has. With ``keys``, similar
    sets must also share a key.
    """
    banded = "keys" in rows.columns

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        comp, kept = None, _Kept()
        for batch in batches:
            comps, reps, sizes = (batch.column(i).to_pylist() for i in range(3))
            tokens, ends = _lists(batch.column(3))
            keys, key_ends = _lists(batch.column(4)) if banded else (None, None)
            gone = []
            for i, rep in enumerate(reps):
                if comps[i] != comp:
                    comp, kept = comps[i], _Kept()
                own = tokens[ends[i]:ends[i + 1]]
                key = frozenset(keys[key_ends[i]:key_ends[i + 1]].tolist()) if banded else frozenset()
                sketch = _sketch(own)
                if kept.similar(sketch, sizes[i], own, key, threshold):
                    gone.append(rep)
                else:
                    kept.add(sketch, sizes[i], own, key)
            yield pa.RecordBatch.from_arrays([pa.array(gone, pa.int64())], names=["x"])

    return _streamed(rows, run)


def stream_bucket_keep_first(rows: DataFrame) -> DataFrame:
    """Dropped sets ``(x)`` of ``rows(comp, rep, keys)``: those that share a key with a lower kept set."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        comp, held = None, set()
        for batch in batches:
            gone = []
            for c, rep, keys in zip(*(column.to_pylist() for column in batch.columns)):
                if c != comp:
                    comp, held = c, set()
                if held.isdisjoint(keys):
                    held.update(keys)
                else:
                    gone.append(rep)
            yield pa.RecordBatch.from_arrays([pa.array(gone, pa.int64())], names=["x"])

    return _streamed(rows, run)
