"""Substring dedup by content-defined chunking with a gear rolling hash.

1. Texts are cut where a gear hash of the last 16 bytes is the smallest among its neighbours, so
   cuts depend on the bytes around them alone and an insertion shifts only the cuts it touches.
   Digests of the bytes around each cut are counted over the corpus; where one stands in two
   documents, its bytes and a margin around them become a *region*. Words are joined by single
   spaces for this. Neighbourhood and digest are together as long as the shortest passage of
   `min_words` words, so every such passage holds a digest that all its places share.
2. Regions alone are cut to words. A digest of each `window` words names its first document (the
   smallest id); in all other documents, words under such windows are repeats. A run of
   `min_words` of them or more is a repeated passage, with exact ends.

Every passage stays in its first document. Blocks of documents and ranges of digests exchange
packed rows (see `blocks`), so a passage in a third of all documents reaches its part once per
block. The regions of a block keep its name, so blocks of equal rows stay apart.

Defined cases: null and empty texts have no passages; repeats inside one document (or one id)
stay; a null id comes after all others; an empty table gives an empty table; extra columns stay
in `remove_passages`.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatloom.llm import blocks
from chatloom.llm.util import only, parts_of, release, save, shelter

_GEAR = np.random.default_rng(20240229).integers(0, 1 << 16, 256, np.uint16)
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_NO_ID = np.iinfo(np.int64).max
#: Bytes under the gear hash.
_HASHED = 16


def lengths(min_words: int) -> tuple[int, int]:
    """Bytes under a digest, and borders of a neighbourhood: a passage of so many one-byte words just holds both."""
    reach = 2 * min_words - 1
    piece = min(reach, max(_HASHED, (reach + 7) // 16 * 8))
    return piece, reach - piece + 1


def _extreme(x: np.ndarray, n: int, of: np.ufunc) -> np.ndarray:
    """`of` (minimum or maximum) of every n values in a row."""
    size = 1
    while size < n:
        step = min(size, n - size)
        x = of(x[:-step], x[step:])
        size += step
    return x


def cuts(raw: bytes, min_words: int = 45) -> np.ndarray:
    """Chunk borders of the bytes, 0 and their length included; never inside a character.

    A border is cut where its hash is the smallest of any neighbourhood, ties included.
    """
    piece, near = lengths(min_words)
    hashed = min(_HASHED, piece)
    ahead = piece - hashed  # bytes of a digest behind its border
    b = np.frombuffer(raw, np.uint8)
    ends = [0, len(b)] if len(b) else [0]
    if len(b) < piece + near - 1:
        return np.array(ends)
    h = _GEAR[b]
    for shift in (1, 2, 4, 8):  # after the last step: 16 bytes, the oldest shifted by 15
        older = h[:-shift] << np.uint16(shift)
        h = h.copy()
        h[shift:] += older
    # borders `hashed` to len(b) - ahead, whose digests lie inside
    starts = np.append((b & 0xC0) != 0x80, True)[hashed:len(b) - ahead + 1]
    h = np.where(starts, h[hashed - 1:len(b) - ahead], np.uint16(0xFFFF))
    least = _extreme(h, near, np.minimum)
    pad = np.zeros(near - 1, np.uint16)
    chosen = (_extreme(np.concatenate([pad, least, pad]), near, np.maximum) == h) & starts
    return np.unique(np.concatenate([np.flatnonzero(chosen) + hashed, ends]))


def digests_at_cuts(raw: bytes, min_words: int = 45, most: int = 1 << 16) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(digest, start, end) of the bytes around every cut; `most` at a time."""
    piece, _ = lengths(min_words)
    at = cuts(raw, min_words) - min(_HASHED, piece)
    at = at[(at >= 0) & (at + piece <= len(raw))]
    digest = np.empty(len(at), np.uint64)
    if len(at):
        view = np.lib.stride_tricks.sliding_window_view(np.frombuffer(raw, np.uint8), piece)
        for i in range(0, len(at), most):
            taken = view[at[i:i + most]]
            wide = np.zeros((len(taken), -(-piece // 8) * 8), np.uint8)
            wide[:, :piece] = taken
            h = np.zeros(len(taken), np.uint64)
            for column in wide.view(np.uint64).T:
                h = (h ^ column) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
                h *= np.uint64(0xBF58476D1CE4E5B9)
                h ^= h >> np.uint64(32)
            digest[i:i + most] = h
    return digest, at, at + piece


def _raw(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def merged(start: np.ndarray, end: np.ndarray) -> list[tuple[int, int]]:
    """Unions of overlapping or touching ranges, given in order."""
    out: list[list[int]] = []
    for a, b in zip(start.tolist(), end.tolist()):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def windows(raw: bytes, window: int) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Digest of each `window` words in a row, and the words' places."""
    words = [m.span() for m in _WORD.finditer(raw)]
    one = np.fromiter((xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in words), np.uint64, len(words))
    if len(words) < window:
        return np.empty(0, np.uint64), words
    h = np.zeros(len(words) - window + 1, np.uint64)
    for j in range(window):
        h = (h ^ one[j:len(one) - window + 1 + j]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h, words


def passages(docs: DataFrame, min_words: int = 45, window: int = 8, margin: int = 512) -> DataFrame:
    """Repeated passages: doc_id, text_hash, start and end (characters), n_words, first_doc_id, passage.

    `first_doc_id` is the smallest id that holds the start of the passage.
    """
    spark = docs.sparkSession
    parts = parts_of(spark)
    known = only(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    packed = blocks.pack(known, lambda block: [(blocks.DOCS, block)], "text", "chunk-blocks")

    def digests(block: pa.Table) -> list[np.ndarray]:
        return [np.unique(digests_at_cuts(b" ".join(_raw(t).split()), min_words)[0]) for t in block["text"].to_pylist()]

    def regions(name: str, block: pa.Table, answers: list[pa.Table]) -> pa.Table:
        keys, _ = blocks.joined_counts(answers)
        doc, hashes, starts, texts = [], [], [], []
        for doc_id, text, text_hash in zip(*(block[c].to_pylist() for c in ("doc_id", "text", "text_hash"))):
            raw = _raw(text)
            words = raw.split()
            digest, a, e = digests_at_cuts(b" ".join(words), min_words)
            _, there = blocks.lookup(keys, blocks.short(digest))
            if not there.any():
                continue
            place = [m.span() for m in _WORD.finditer(raw)]
            size = np.fromiter(map(len, words), np.int64, len(words)) + 1
            begin = np.cumsum(size) - size  # of each word in the joined words
            first = np.searchsorted(begin, np.maximum(a[there] - margin, 0), "right") - 1
            last = np.searchsorted(begin, e[there] + margin, "left")
            done = chars = 0
            for i, j in merged(first, last):
                x, y = place[i][0], place[j - 1][1]
                chars += len(raw[done:x].decode("utf-8", "surrogatepass"))
                body = raw[x:y].decode("utf-8", "surrogatepass")
                doc.append(doc_id)
                hashes.append(text_hash)
                starts.append(chars)
                texts.append(body)
                done, chars = y, chars + len(body)
        if not doc:
            return pa.Table.from_batches([blocks.rows([])])
        table = pa.table({"doc_id": pa.array(doc, pa.int64()), "text_hash": pa.array(hashes, pa.int64()), "start": pa.array(starts, pa.int64()), "text": pa.array(texts, pa.string())})
        return pa.Table.from_batches([blocks.rows([(name, blocks.DOCS, blocks.to_blob(table))])])

    found = save(blocks.finish(packed, blocks.shared_counts(packed, digests, parts), regions, blocks.ROWS, named=True), "chunk-regions")
    release(packed)

    def window_keys(block: pa.Table):
        """Each distinct window of the block with its smallest id, and whether the block has another."""
        keys, ids = [], []
        for doc_id, text in zip(block["doc_id"].to_pylist(), block["text"].to_pylist()):
            h = np.unique(windows(_raw(text), window)[0])
            keys.append(h)
            ids.append(np.full(len(h), _NO_ID if doc_id is None else doc_id))
        key, doc = np.concatenate(keys), np.concatenate(ids)
        order = np.lexsort((doc, key))
        key, doc = key[order], doc[order]
        first = np.flatnonzero(np.diff(key, prepend=key[:1] + np.uint64(1)) != 0) if len(key) else np.empty(0, np.int64)
        last = np.append(first[1:], len(key)) - 1
        for p, at in enumerate(blocks.split_parts(key[first], parts)):
            if len(at):
                yield p, pa.table({"key": key[first][at], "low": doc[first][at], "high": doc[last][at]})

    def owners(asked):
        key = np.concatenate([t["key"].to_numpy() for _, t in asked])
        distinct, place = np.unique(key, return_inverse=True)
        low, high = np.full(len(distinct), _NO_ID), np.full(len(distinct), -_NO_ID)
        np.minimum.at(low, place, np.concatenate([t["low"].to_numpy() for _, t in asked]))
        np.maximum.at(high, place, np.concatenate([t["high"].to_numpy() for _, t in asked]))
        at = 0
        for block, t in asked:
            mine = place[at:at + len(t)]
            at += len(t)
            if (several := (low != high)[mine]).any():
                yield block, pa.table({"key": t["key"].to_numpy()[several], "first": low[mine][several]})

    def spans(block: pa.Table, answers: list[pa.Table]) -> pa.Table:
        keys = np.concatenate([t["key"].to_numpy() for t in answers]) if answers else np.empty(0, np.uint64)
        first = np.concatenate([t["first"].to_numpy() for t in answers]) if answers else np.empty(0, np.int64)
        order = np.argsort(keys)
        keys, first = keys[order], first[order]
        out = []
        for doc_id, text_hash, start, text in zip(*(block[c].to_pylist() for c in ("doc_id", "text_hash", "start", "text"))):
            raw = _raw(text)
            h, words = windows(raw, window)
            at, there = blocks.lookup(keys, h)
            repeat = np.flatnonzero(there & (first[at] != (_NO_ID if doc_id is None else doc_id))) if len(keys) else np.empty(0, np.int64)
            for x, y in merged(repeat, repeat + window):
                if y - x >= min_words:
                    a, b = words[x][0], words[y - 1][1]
                    head, body = (raw[i:j].decode("utf-8", "surrogatepass") for i, j in ((0, a), (a, b)))
                    out.append((doc_id, text_hash, start + len(head), start + len(head) + len(body), y - x, int(first[at[x]]), body))
        kinds = [pa.int64()] * 6 + [pa.string()]
        names = ["doc_id", "text_hash", "start", "end", "n_words", "first_doc_id", "passage"]
        return pa.table([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 7, kinds)], names=names)

    answers = blocks.answer(blocks.ask(found, window_keys), owners)
    out = save(blocks.finish(found, answers, spans, "doc_id long, text_hash long, start long, end long, n_words long, first_doc_id long, passage string"), "passages")
    release(found)
    return out


def remove_passages(docs: DataFrame, **options) -> DataFrame:
    """`docs` without their repeated passages; same columns. Documents that had words and keep none go."""
    docs, names = shelter(docs, "doc_id", "text", "n_chars")
    found = passages(docs, **options).select("doc_id", "text_hash", "start", "end").distinct().groupBy("doc_id", "text_hash").agg(
        F.sort_array(F.collect_list(F.struct("start", "end")), asc=False).alias("_spans"))
    found = found.toDF("_d", "_h", "_spans")
    cut = F.aggregate("_spans", F.col("text"), lambda t, s: F.concat(F.substring(t, F.lit(1), s["start"].cast("int")), F.substring(t, s["end"].cast("int") + 1, F.length(t))))
    same = F.col("doc_id").eqNullSafe(F.col("_d")) & (F.xxhash64("text") == F.col("_h"))
    # the passages grow with the documents: they are joined by a merge at every size
    out = docs.join(found.hint("merge"), same, "left").withColumn("text", F.when(F.col("_spans").isNull(), F.col("text")).otherwise(cut))
    out = out.where(F.col("_spans").isNull() | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("_spans").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns).toDF(*names)
