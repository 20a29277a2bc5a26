"""Paragraph chunking (E8): paragraph lengths are packed by prefix sums, in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

from chatloom.functions import ustrip
from chatloom.schema import CHUNK_CHARS
from chatloom.session import ship_package

_PARA_SEP = "\n\n"


def chunks_of(text: str, limit: int = CHUNK_CHARS) -> list[str]:
    """Chunks of one text.

    Paragraphs are separated by blank lines, stripped, and dropped when blank. A chunk takes as
    many paragraphs as have ``limit`` characters together (separators not counted); a longer
    paragraph stands alone, cut every ``limit`` characters. Without paragraphs the chunk is the
    head of the text. Each chunk's end is searched in the prefix sums of the lengths, so the
    work is linear in the text.
    """
    paras = [s for p in text.split(_PARA_SEP) if (s := p.strip())]
    if not paras:
        return [text[:limit]]
    ends = np.cumsum([len(p) for p in paras])
    long_ones = [*np.flatnonzero(np.diff(ends, prepend=0) > limit).tolist(), len(paras)]
    out, at, nth = [], 0, 0
    while at < len(paras):
        if at == long_ones[nth]:
            out += [paras[at][i:i + limit] for i in range(0, len(paras[at]), limit)]
            nth, at = nth + 1, at + 1
            continue
        taken = ends[at - 1] if at else 0
        stop = min(int(np.searchsorted(ends, taken + limit, side="right")), long_ones[nth])
        out.append(_PARA_SEP.join(paras[at:stop]))
        at = stop
    return out


def chunk_text(docs: DataFrame, text_col: str = "text", key: str = "doc_id", chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """``(key, chunk_idx, n_chunks, chunk)`` — one row per chunk, 0-based ``chunk_idx``; a null text has none."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, text in zip(batch.column(0), batch.column(1).to_pylist()):
                if text is not None:
                    cut = chunks_of(text, chunk_chars)
                    n = len(cut)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name.as_py()] * n, batch.schema.field(0).type), pa.array(range(n), pa.int32()), pa.array([n] * n, pa.int32()),
                         pa.array(cut, pa.string())], names=[key, "chunk_idx", "n_chunks", "chunk"])

    def joined(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in run(batches):
            held.append(b)
            size += b.nbytes
            if size > 4 << 20:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size = [], 0
        if held:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    ship_package(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text_col).mapInArrow(joined, f"{key} {kind}, chunk_idx int, n_chunks int, chunk string")


def is_blank(text: Column) -> Column:
    """Texts that cannot be structured: null, or empty after strip."""
    return text.isNull() | (ustrip(text) == "")
