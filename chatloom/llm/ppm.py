"""Language-model scoring by prediction by partial matching over bytes, and by word counts.

Model: a trie of byte contexts up to three bytes long, counted over all training texts. A byte
is predicted by the longest context; where that has not seen it, an escape (method C: as likely
as the number of distinct bytes the context has seen) leads to the next shorter one, without
the bytes that were excluded on the way, and at last to a uniform byte. Byte 0xFF, which no
UTF-8 text holds, pads the start and ends every text, so the texts' probabilities add up to 1.

How it runs: blocks of documents list their distinct contexts with the byte that follows, and
their training counts; parts of the key space add them up (the trie); contexts that share their
last byte meet to turn counts into costs (at most 2^24 keys); costs return to the blocks, which
sum them per document. Words take the same way, with counts in place of costs. The trie is
never collected or broadcast.

Defined cases: a null text is empty, so it is its end alone; a null id trains; without training
texts every byte is uniform; repeated rows train and are scored each; an empty table gives an
empty table; extra columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatloom.llm import blocks
from chatloom.llm.util import only, parts_of, save, space_words

ORDER = 3
_END = 0xFF
_TOTALS = "totals"


def byte_keys(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Context and byte as 32-bit keys at every place of the texts, ends included, and where each text begins."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    pad = bytes([_END]) * ORDER
    b = np.frombuffer(pad + b"".join(r + pad for r in raw), np.uint8).astype(np.uint32)
    keys = b[:-3] << np.uint32(24) | b[1:-2] << np.uint32(16) | b[2:-1] << np.uint32(8) | b[3:]
    sizes = np.array([len(r) for r in raw], np.int64)
    starts = np.append(0, np.cumsum(sizes + ORDER))[:-1]
    own = np.ones(len(keys), bool)  # not the places that only pad
    for extra in (1, 2):
        own[(starts + sizes + extra)[starts + sizes + extra < len(keys)]] = False
    return keys[own], np.append(0, np.cumsum(sizes + 1))[:-1]


def distinct_keys(block: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of a block's documents and their counts in training documents."""
    keys, starts = byte_keys(block["text"].to_pylist())
    train = np.repeat(block["train"].to_numpy(), np.diff(np.append(starts, len(keys))))
    every, (seen, n) = np.unique(keys), np.unique(keys[train], return_counts=True)
    count = np.zeros(len(every), np.int64)
    count[np.searchsorted(every, seen)] = n
    return every, count


def _part_of(keys: np.ndarray) -> np.ndarray:
    return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)


def costs(keys: np.ndarray, counts: np.ndarray, r0: np.ndarray) -> np.ndarray:
    """log10 probability of every key; all keys share the last byte of their context, r0 counts single bytes."""
    a, b, s = keys >> 24, keys >> 16 & 0xFF, keys & 0xFF
    out = np.empty(len(keys))
    r1 = np.bincount(s, counts, 256)

    def step(weights):
        """Probabilities of the bytes with weight, and of an escape, by row."""
        n, d = weights.sum(-1, keepdims=True), (weights > 0).sum(-1, keepdims=True)
        total = np.where(n > 0, n + d, 1)
        return weights / total, np.where(n > 0, d / total, 1.0)

    p0, e0 = step(r0 * (r1 == 0))
    left = r0 == 0
    uniform = left / max(1, left.sum())
    for ctx in np.unique(b):
        at = np.flatnonzero(b == ctx)
        rows, row = np.unique(a[at], return_inverse=True)
        m = np.zeros((len(rows), 256))
        m[row, s[at]] = counts[at]
        r2 = m.sum(0)
        p3, e3 = step(m)
        p2, e2 = step(r2 * (m == 0))
        p1, e1 = step(r1 * (r2 == 0))
        p = p3 + e3 * (p2 + e2 * (p1 + e1 * (p0 + e0 * uniform)))
        out[at] = np.log10(p[row, s[at]])
    return out


def _block_words(block: pa.Table) -> tuple[list[bytes], list[list[bytes]]]:
    """Distinct words of a block in order of appearance, and each document's words."""
    docs = [space_words(t, lower=True) for t in block["text"].to_pylist()]
    return list(dict.fromkeys(w for d in docs for w in d)), docs


def _word_parts(words: list[bytes], parts: int) -> list[np.ndarray]:
    return blocks.split_parts(np.fromiter(map(zlib.crc32, words), np.uint64, len(words)), parts)


def word_counts(packed: DataFrame, parts: int) -> tuple[DataFrame, int, int]:
    """Answers with the training count of each word of a block; all training words, and how many are distinct."""

    def ask(block: pa.Table):
        words, docs = _block_words(block)
        number = {w: i for i, w in enumerate(words)}
        train = block["train"].to_pylist()
        at = np.fromiter((number[w] for d, t in zip(docs, train) if t for w in d), np.int64)
        count, names = np.bincount(at, minlength=len(words)), np.array(words, object)
        for p, places in enumerate(_word_parts(words, parts)):
            if len(places):
                yield p, pa.table({"word": pa.array(names[places], pa.binary()), "n": pa.array(count[places], pa.int64())})

    def resolve(asked):
        total: dict[bytes, int] = {}
        for _, t in asked:
            for w, n in zip(t["word"].to_pylist(), t["n"].to_pylist()):
                total[w] = total.get(w, 0) + n
        for block, t in asked:
            yield block, pa.table({"n": pa.array([total[w] for w in t["word"].to_pylist()], pa.int64())})
        yield _TOTALS, pa.table({"n": [sum(total.values())], "distinct": [sum(n > 0 for n in total.values())]})

    answers = save(blocks.answer(blocks.ask(packed, ask), resolve), "ppm-words")
    sums = [blocks.from_blob(bytes(r["blob"])) for r in answers.where(F.col("block") == _TOTALS).select("blob").collect()]  # a row a part
    return (answers.where(F.col("block") != _TOTALS), sum(t["n"][0].as_py() for t in sums), sum(t["distinct"][0].as_py() for t in sums))


def byte_costs(packed: DataFrame, parts: int) -> DataFrame:
    """Answers with the log10 probability of each key of a block."""

    def ask(block: pa.Table):
        keys, count = distinct_keys(block)
        for p, at in enumerate(blocks.split_parts(_part_of(keys), parts)):
            if len(at):
                yield p, pa.table({"key": blocks.deltas(keys[at].astype(np.uint64)), "n": pa.array(count[at])})

    def trie(asked):
        """The distinct keys of a part with their counts, by the last byte of the context; and counts of single bytes."""
        found = [blocks.undelta(t["key"]) for _, t in asked]
        key, place = np.unique(np.concatenate(found), return_inverse=True)
        n = np.bincount(place, np.concatenate([t["n"].to_numpy() for _, t in asked]), len(key)).astype(np.int64)
        last = (key >> np.uint64(8)) & np.uint64(0xFF)
        for c in np.unique(last):
            yield str(c), pa.table({"key": blocks.deltas(key[last == c]), "n": n[last == c]})
        yield _TOTALS, pa.table({"n": np.bincount((key & np.uint64(0xFF)).astype(np.int64), n, 256)})

    asked = save(blocks.ask(packed, ask), "ppm-keys")
    counted = save(blocks.answer(asked, trie), "ppm-trie")
    r0 = np.sum([blocks.from_blob(bytes(r["blob"]))["n"].to_numpy() for r in counted.where(F.col("block") == _TOTALS).select("blob").collect()] or [np.zeros(256)], axis=0)

    def price(group: pa.Table) -> pa.Table:
        tables = [(p, blocks.from_blob(x)) for p, x in zip(group["part"].to_pylist(), group["blob"].to_pylist())]
        keys = [blocks.undelta(t["key"]) for _, t in tables]
        cost = costs(np.concatenate(keys).astype(np.int64), np.concatenate([t["n"].to_numpy() for _, t in tables]), r0)
        cut = np.split(cost, np.cumsum([len(k) for k in keys])[:-1])
        return pa.Table.from_batches([blocks.rows((_TOTALS, p, blocks.to_blob(pa.table({"key": k, "cost": c}))) for (p, _), k, c in zip(tables, keys, cut))])

    priced = counted.where(F.col("block") != _TOTALS).groupBy("block").applyInArrow(price, blocks.ROWS)

    def look_up(met):
        known = [t for b, t in met if b == _TOTALS]
        key, cost = (np.concatenate([t[c].to_numpy() for t in known]) for c in ("key", "cost"))
        order = np.argsort(key)
        key, cost = key[order], cost[order]
        for b, t in met:
            if b != _TOTALS:
                wanted = blocks.undelta(t["key"])
                yield b, pa.table({"key": t["key"], "cost": cost[np.searchsorted(key, wanted)]})

    return blocks.answer(asked.unionByName(priced), look_up)


_dense: list[np.ndarray] = []  # one table of context numbers per worker process, as it is large


def _sum_costs(texts: list[str | None], keys: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """Sum of the costs of each text's places."""
    if not _dense:
        _dense.append(np.zeros(1 << 24, np.int32))
    context = keys >> 8
    rows, row = np.unique(context, return_inverse=True)
    table = np.zeros((len(rows), 256))
    table[row, keys & 0xFF] = cost
    _dense[0][rows] = np.arange(len(rows), dtype=np.int32)
    out = np.empty(len(texts))
    for i, text in enumerate(texts):
        k, _ = byte_keys([text])
        out[i] = table[_dense[0][k >> np.uint32(8)], k & np.uint32(0xFF)].sum()
    return out


def score(docs: DataFrame, train: Column) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score (log10 probabilities) of every whole text.

    `train` says over the columns of `docs` which documents the model learns from.
    """
    kind, parts = docs.schema["doc_id"].dataType.simpleString(), parts_of(docs.sparkSession)
    known = only(docs.withColumn("_train", F.coalesce(train, F.lit(True))), "doc_id", "text", "_train").withColumnRenamed("_train", "train")
    packed = blocks.pack(known, lambda block: [(blocks.DOCS, block)], "text", "ppm-blocks")
    words, n, distinct = word_counts(packed, parts)
    ends = sum(int(r[0] or 0) for r in known.select(F.count(F.when(F.col("train"), 1))).collect())
    n, distinct = n + ends, distinct + (ends > 0)
    prices = byte_costs(packed, parts)

    def finish(block: pa.Table, answers: list[pa.Table]) -> pa.Table:
        texts = block["text"].to_pylist()
        counts = [t["n"].to_numpy() for t in answers if "n" in t.column_names]
        priced = [(blocks.undelta(t["key"]), t["cost"].to_numpy()) for t in answers if "cost" in t.column_names]
        names, split = _block_words(block)
        count = np.zeros(len(names), np.int64)
        if names:
            count[np.concatenate(_word_parts(names, parts))] = np.concatenate(counts)
        known_words = dict(zip(names, count.tolist()))
        n_tokens, n_known, base = [], [], []
        for ws in split:
            c = np.fromiter((known_words[w] for w in ws), np.float64, len(ws))
            n_tokens.append(len(ws) + 1)
            n_known.append(int((c > 0).sum()) + (ends > 0))
            base.append(float(np.log10(c + 1).sum() + np.log10(ends + 1) - (len(ws) + 1) * np.log10(n + distinct + 1)))
        total = _sum_costs(texts, np.concatenate([k for k, _ in priced]).astype(np.int64), np.concatenate([c for _, c in priced]))
        return pa.table({"doc_id": block["doc_id"], "n_tokens": pa.array(n_tokens, pa.int64()), "n_known": pa.array(n_known, pa.int64()),
                         "train_tokens": pa.array([n] * len(texts), pa.int64()), "base_score": pa.array(base, pa.float64()), "score": pa.array(total)})

    return blocks.finish(packed, words.unionByName(prices), finish,
                         f"doc_id {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double")
