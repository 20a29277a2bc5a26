"""Items of JSON array files, read by many tasks per file (A2).

Spark reads a file's input splits as fragments that end at ``}``. What a split does to the scan's
state is a composable function: its quotes swap inside and outside of strings by their parity, and
its brackets change the depth by one amount if it starts outside a string and by another if it
starts inside. One row per split goes through a prefix sum, so every split knows the state it
starts in; then it cuts its text at the commas of depth 1. Items that straddle splits are put
together from their pieces.

An item is any text between those commas; whether it is JSON is the reader's to say. Defined cases:
a byte order mark is left out; ``[]`` has no items; an empty item (``[1,]``) is an item without
text; a file that is no array is one item (``is_array`` false); text behind the array and an array
without its end mark the file as broken; a file of no bytes is not seen by Spark's readers.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chatloom.session import saved, ship_package

#: Ends a fragment; an object holds at least one.
_END = b"}"
_SPACE = b" \t\n\r"
_BOM = b"\xef\xbb\xbf"
_DELTA = np.zeros(256, np.int8)
_DELTA[list(b"[{")], _DELTA[list(b"]}")] = 1, -1
_MARKS = _DELTA != 0
_MARKS[ord(",")] = True
#: Input splits whose states are sent along with the scan; more of them meet it in a join (about 20 MB at most).
BROADCAST_SPLITS = 200_000
#: Numbers of pieces that begin no item: the rest of an earlier one, and the mark of a broken file.
_REST, _BROKEN = -1, -2


def _bytes_of(column: pa.Array, last_is_open: bool = False) -> np.ndarray:
    """The fragments of a batch as they stand in the file; the last one of a file may have no end."""
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int32)[column.offset:column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[ends[0]:ends[-1]] if data is not None else np.empty(0, np.uint8)
    whole = np.insert(raw, ends[1:] - ends[0], _END[0])
    return whole[:-1] if last_is_open else whole


def _quotes(text: np.ndarray) -> np.ndarray:
    """Places of the quotes that no backslash escapes. A run of backslashes lies in one fragment."""
    at = np.flatnonzero(text == ord('"'))
    slash = np.flatnonzero(text == ord("\\"))
    if not len(slash) or not len(at):
        return at
    first = np.flatnonzero(np.append(True, np.diff(slash) > 1))  # where runs start
    run = np.diff(np.append(first, len(slash)))
    behind = slash[np.append(first[1:], len(slash)) - 1] + 1
    return at[~np.isin(at, behind[run % 2 == 1])]


def _structure(text: np.ndarray, inside: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Places of brackets and commas outside strings, their quotes' parity so far, and that at the end."""
    quotes = _quotes(text)
    at = np.flatnonzero(_MARKS[text])
    odd = (np.searchsorted(quotes, at) + inside) & 1
    return at[odd == 0], at[odd == 1], (len(quotes) + inside) & 1


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Consecutive rows of one split."""
    file, block = batch.column(0).to_pylist(), batch.column(1).to_pylist()
    start = 0
    for i in range(1, batch.num_rows + 1):
        if i == batch.num_rows or (file[i], block[i]) != (file[start], block[start]):
            yield (file[start], block[start]), batch.slice(start, i - start)
            start = i


def _effects(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, size, blk, n, bytes, parity, outside, inside, first) of every split."""
    names = ["file", "size", "blk", "n", "bytes", "parity", "outside", "inside", "first"]
    schema = pa.schema([(c, pa.string() if c in ("file", "first") else pa.int64()) for c in names])
    key, row = None, []

    def close() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([dict(zip(names, row))], schema)

    for batch in batches:
        for key_now, part in _runs(batch):
            if key_now != key:
                if key is not None:
                    yield close()
                key, row = key_now, [key_now[0], part.column(3)[0].as_py(), key_now[1], 0, 0, 0, 0, 0, ""]
            text = _bytes_of(part.column(2))
            outside, inside, parity = _structure(text, row[5])
            # places outside by the parity so far are outside if the split starts so
            row[3], row[4], row[5] = row[3] + part.num_rows, row[4] + len(text), parity
            row[6] += int(_DELTA[text[outside]].sum(dtype=np.int64))
            row[7] += int(_DELTA[text[inside]].sum(dtype=np.int64))
            if not row[8] and row[2] == 0:
                head = text.tobytes().removeprefix(_BOM).lstrip(_SPACE) if row[3] == part.num_rows else text.tobytes().lstrip(_SPACE)
                row[8] = chr(head[0]) if head else ""
    if key is not None:
        yield close()


class _Cutter:
    """Cuts one split's text into pieces (i, whole, text)."""

    def __init__(self, depth: int, inside: int, is_array: bool, block: int, n: int, last: bool, open_end: bool):
        self.depth, self.inside, self.is_array, self.first = depth, inside, is_array, block == 0
        self.left, self.last, self.open_end = n, last, open_end
        self.at_start, self.i, self.held, self.ended = block == 0, -1 if block else 0, [], depth == 0 and block > 0
        self.broken, self.some = False, False

    def feed(self, column: pa.Array) -> Iterator[tuple[int, bool, bytes]]:
        self.left -= len(column)
        text = _bytes_of(column, self.open_end and self.last and not self.left)
        if self.at_start and text[:3].tobytes() == _BOM:
            text = text[3:]
        self.at_start = False
        if not self.is_array:
            self.held.append(text.tobytes())
            return
        outside, _, self.inside = _structure(text, self.inside)
        delta = _DELTA[text[outside]]
        after = self.depth + np.cumsum(delta, dtype=np.int64)
        comma = (delta == 0) & (after == 1)
        edge = ((delta > 0) & (after == 1)) | ((delta < 0) & (after == 0))
        from_ = 0
        for place, is_comma, level in zip(outside[comma | edge].tolist(), comma[comma | edge].tolist(), after[comma | edge].tolist()):
            piece = text[from_:place].tobytes()
            from_ = place + 1
            if self.ended or (level == 0 and text[place] != ord("]")):
                self.broken = True
            if self.ended:
                continue
            if is_comma:
                yield self._close(piece)
                self.i, self.some = self.i + 1, True
            elif level == 1:  # the array's own bracket; nothing but space stands before it
                self.held, self.broken = [], self.broken or bool(piece.strip(_SPACE))
            else:
                done = self._close(piece)
                self.ended = True
                if done[0] != 0 or self.some or done[2].strip(_SPACE):
                    yield done
        self.depth = int(after[-1]) if len(after) else self.depth
        rest = text[from_:].tobytes()
        if self.ended:
            self.broken = self.broken or bool(rest.strip(_SPACE))
        else:
            self.held.append(rest)

    def _close(self, piece: bytes) -> tuple[int, bool, bytes]:
        self.held.append(piece)
        whole, self.held = b"".join(self.held), []
        return self.i, True, whole

    def finish(self) -> Iterator[tuple[int, bool, bytes]]:
        if self.held and not self.ended:
            yield self.i, False, b"".join(self.held)
        if self.broken or (self.is_array and self.last and not self.ended):
            yield _BROKEN, True, b""


def _pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, blk, i, whole, text) of batches (file, blk, value, depth, inside, is_array, n, last, open_end)."""
    key, cutter = None, None

    def rows(found: Iterable[tuple[int, bool, bytes]]) -> Iterator[pa.RecordBatch]:
        found = list(found)
        for start in range(0, len(found), 1000):
            i, whole, text = zip(*found[start:start + 1000])
            yield pa.RecordBatch.from_arrays([pa.array([key[0]] * len(i)), pa.array([key[1]] * len(i)), pa.array(i, pa.int64()), pa.array(whole), pa.array(text, pa.binary())],
                                             names=["file", "blk", "i", "whole", "text"])

    for batch in batches:
        for key_now, part in _runs(batch):
            if key_now != key:
                if key is not None:
                    yield from rows(cutter.finish())
                depth, inside, is_array, n, last, open_end = (part.column(c)[0].as_py() for c in range(3, 9))
                key, cutter = key_now, _Cutter(depth, inside, is_array, key_now[1], n, last, open_end)
            yield from rows(cutter.feed(part.column(2)))
    if key is not None:
        yield from rows(cutter.finish())


def array_items(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``(items(file, pos, is_array, text), broken(file))`` of the files below ``path``; both lazy over saved pieces."""
    ship_package(spark)
    scan = spark.read.option("recursiveFileLookup", "true").option("lineSep", _END.decode()).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("blk"), "value", F.col("_metadata.file_size").alias("size"))
    effects = saved(scan.mapInArrow(_effects, "file string, size long, blk long, n long, bytes long, parity long, outside long, inside long, first string"), "json-splits")
    by_file = Window.partitionBy("file")
    before = by_file.orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)  # one row per split
    states = effects.withColumn("start", F.coalesce(F.sum("parity").over(before), F.lit(0)) % 2)
    states = states.withColumn("change", F.when(F.col("start") == 0, F.col("outside")).otherwise(F.col("inside")))
    whole = by_file.orderBy("blk").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    states = saved(states.select(
        "file", "blk", F.coalesce(F.sum("change").over(before), F.lit(0)).alias("depth"), F.col("start").cast("int").alias("in_string"),
        (F.first("first").over(whole) == "[").alias("is_array"), "n", (F.col("blk") == F.max("blk").over(whole)).alias("last"),
        # every fragment counts its end; the line reader may have taken a byte order mark of three bytes
        (~(F.sum("bytes").over(whole) - F.col("size")).isin(0, -3)).alias("open_end")), "json-states")
    columns = ["file", "blk", "value", "depth", "in_string", "is_array", "n", "last", "open_end"]
    tagged = scan.select("file", "blk", "value", F.monotonically_increasing_id().alias("_id"))
    if states.count() <= BROADCAST_SPLITS:
        placed = tagged.join(F.broadcast(states), ["file", "blk"])  # the scan's order stays
    else:
        placed = tagged.join(states, ["file", "blk"]).repartition("file", "blk").sortWithinPartitions("file", "blk", "_id")
    pieces = saved(placed.select(*columns).mapInArrow(_pieces, "file string, blk long, i long, whole boolean, text binary"), "json-pieces")
    pieces = pieces.withColumn("text", F.col("text").cast("string"))

    starts = pieces.where("i >= 0").groupBy("file", "blk").agg(F.count(F.lit(1)).alias("items"))
    starts = states.select("file", "blk", "is_array").join(starts, ["file", "blk"], "left").withColumn("items", F.coalesce("items", F.lit(0)))
    owner = F.last(F.when(F.col("items") > 0, F.struct("blk", (F.col("items") - 1).alias("i"))), ignorenulls=True).over(before)
    starts = saved(starts.select("file", "blk", "is_array", F.coalesce(F.sum("items").over(before), F.lit(0)).alias("off"), owner.alias("owner")), "json-starts")
    numbered = pieces.where("i >= 0")
    heads = pieces.where(F.col("i") == _REST).join(starts.select("file", "blk", "owner"), ["file", "blk"]).select(
        "file", F.col("owner.blk").alias("blk"), F.col("owner.i").alias("i"), F.col("blk").alias("seq"), "text")
    parts = heads.unionByName(numbered.where("NOT whole").select("file", "blk", "i", F.col("blk").alias("seq"), "text"))
    joined = parts.groupBy("file", "blk", "i").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda p: p["text"]), "").alias("text"))
    placed = numbered.where("whole").select("file", "blk", "i", "text").unionByName(joined)
    items = placed.join(starts.select("file", "blk", "off", "is_array"), ["file", "blk"]).select("file", (F.col("off") + F.col("i")).alias("pos"), "is_array", "text")
    broken = pieces.where(F.col("i") == _BROKEN).select("file").distinct()
    return items, broken
