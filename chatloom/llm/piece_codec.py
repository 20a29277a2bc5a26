"""SentencePiece encoding and decoding through a table of distinct chunks.

A *chunk* is a run of whitespace markers and the characters up to the next marker. Where no
piece holds a marker behind another character, no merge crosses chunks, so encoding chunks one
by one equals encoding the text. Blocks of documents list their distinct chunks; each distinct
chunk of the corpus is segmented once, in the part that its hash names; the ids go back to the
blocks, where they are joined by position.

Defined cases: null and empty texts have no ids and decode to ""; repeated rows are encoded
each; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatloom.llm import blocks
from chatloom.llm.util import only, parts_of

MARK = "▁"
#: Larger blocks repeat fewer chunks.
BLOCK_BYTES = 20 << 20
_CHUNK = re.compile(" +[^ ]*")


def chunks(text: str | None) -> list[str]:
    """Chunks of a text, each without its first marker (which the encoder puts before any text)."""
    if not text:
        return []
    text = text.replace(MARK, " ")
    if "  " in text or text[0] == " " or text[-1] == " ":
        return [c[1:] for c in _CHUNK.findall(" " + text)]
    return text.split(" ")


class Codec:
    """Encodes and decodes chunks with one model."""

    def __init__(self, model: bytes):
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.lone_mark = self.sp.piece_to_id(MARK)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [ids if c else [self.lone_mark] for c, ids in zip(texts, self.sp.encode(texts, num_threads=1))]

    def decode(self, ids: list[list[int]]) -> list[str]:
        """The surface of each chunk with its leading space."""
        return [" " + t for t in self.sp.decode(ids)]

    def check(self) -> None:
        pieces = (self.sp.id_to_piece(i) for i in range(self.sp.vocab_size()))
        if crossing := next((p for p in pieces if MARK in p.lstrip(MARK)), None):
            raise ValueError(f"piece {crossing!r} crosses a whitespace marker; chunks cannot be encoded alone")
        for probe in ("a", " a", "a  b "):
            if [i for c in self.encode(chunks(probe)) for i in c] != self.sp.encode(probe):
                raise ValueError("the model's normalization does not keep whitespace")


def one_list(values: pa.Array) -> pa.Array:
    """A column of one row that holds all values."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _flat(column: pa.ChunkedArray) -> pa.Array:
    column = column.combine_chunks()
    return column.chunk(0) if isinstance(column, pa.ChunkedArray) else column


def encode_decode(docs: DataFrame, model: bytes) -> DataFrame:
    """doc_id, ids array<int> and decoded string of every whole text.

    `docs` is read twice and must give the same rows in the same partitions, as a table does.
    """
    Codec(model).check()
    spark = docs.sparkSession
    shared, parts = spark.sparkContext.broadcast(model), parts_of(spark)

    def numbered(block: pa.Table) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """The block's distinct chunks and the parts they belong to; its texts in numbers of chunks, and where each ends."""
        table: dict[str, int] = {}
        codes, ends = [], [0]
        for text in block["text"].to_pylist():
            codes += [table.setdefault(c, len(table)) for c in chunks(text)]
            ends.append(len(codes))
        hashes = np.fromiter((zlib.crc32(k.encode("utf-8", "surrogatepass")) for k in table), np.uint64, len(table))
        return list(table), hashes, np.array(codes, np.int64), np.array(ends)

    def distinct(block: pa.Table):
        keys, hashes, _, _ = numbered(block)
        keys = np.array(keys, object)
        for part, at in enumerate(blocks.split_parts(hashes, parts)):
            if len(at):
                yield part, pa.table({"chunk": pa.array(keys[at], pa.string())})

    def resolve(asked):
        """Ids of each chunk, in the order asked, and the surface of those that do not decode to themselves."""
        codec = Codec(shared.value)
        known = dict.fromkeys(c for _, t in asked for c in t["chunk"].to_pylist())
        known = dict(zip(known, codec.encode(list(known))))
        odd = {c: d for c, d in zip(known, codec.decode(list(known.values()))) if d != " " + c}
        kind = pa.int16() if codec.sp.vocab_size() <= 1 << 15 else pa.int32()
        for block, t in asked:
            texts = t["chunk"].to_pylist()
            ids = [known[c] for c in texts]
            strange = [(i, odd[c]) for i, c in enumerate(texts) if c in odd] if odd else []
            yield block, pa.table({"sizes": one_list(pa.array(map(len, ids), pa.uint32())), "ids": one_list(pa.array([i for x in ids for i in x], kind)),
                                   "odd_at": one_list(pa.array([i for i, _ in strange], pa.int32())), "odd": one_list(pa.array([d for _, d in strange], pa.string()))})

    def join(block: pa.Table, answers: list[pa.Table]) -> pa.Table:
        keys, hashes, codes, ends = numbered(block)
        if not keys:
            return pa.table({"doc_id": block["doc_id"], "ids": pa.array([[]] * len(block), pa.list_(pa.int32())), "decoded": pa.array([""] * len(block))})
        sizes, every = (np.concatenate([_flat(t[c]).values.to_numpy() for t in answers]) for c in ("sizes", "ids"))
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(every.astype(np.int32)))
        split = [at for at in blocks.split_parts(hashes, parts) if len(at)]  # a part answers in this order
        if [len(at) for at in split] != [len(_flat(t["sizes"]).values) for t in answers]:
            raise ValueError("a block was answered for other chunks than it has")
        place = np.empty(len(keys), np.int64)
        place[np.concatenate(split)] = np.arange(len(keys))
        flat = lists.take(pa.array(place[codes]))  # the ids of every position
        to = np.append(0, np.cumsum(np.diff(flat.offsets.to_numpy())))[ends]
        ids = pa.ListArray.from_arrays(pa.array(to, pa.int32()), flat.flatten())
        strange = {int(at[i]): d for at, t in zip(split, answers) for i, d in zip(_flat(t["odd_at"]).values.to_pylist(), _flat(t["odd"]).values.to_pylist())}
        if strange:
            surface = np.array([strange.get(i, " " + k) for i, k in enumerate(keys)], object)
            decoded = ["".join(surface[codes[i:j]])[1:] for i, j in zip(ends.tolist(), ends.tolist()[1:])]
        else:  # every chunk of the block decodes to itself
            decoded = [(t or "").replace(MARK, " ") for t in block["text"].to_pylist()]
        return pa.table({"doc_id": block["doc_id"], "ids": ids, "decoded": pa.array(decoded, pa.string())})

    own, kind = only(docs, "doc_id", "text"), docs.schema["doc_id"].dataType.simpleString()
    # the input is read once for the table and once for the positions: cheaper than keeping both on disk
    asked, packed = (blocks.pack(own, make, "text", None, BLOCK_BYTES, level=9) for make in (distinct, lambda block: [(blocks.DOCS, block)]))
    return blocks.finish(packed, blocks.answer(asked, resolve), join, f"doc_id {kind}, ids array<int>, decoded string")


def digests(encoded: DataFrame) -> DataFrame:
    """Number of ids, and SHA-256 of the comma-joined ids and of the decoded text."""
    return encoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))
