"""Phrase collocation mining by SETM: set-oriented mining of sorted occurrence relations.

The occurrences of the frequent phrases of k words are a relation (piece, position, phrase), kept sorted by
position in blocks of documents; a document lies in one block, so a piece does too, and positions jump where
a piece ends. One turn of the mining

1. merge-joins the relation with itself at adjacent positions of a piece, which gives the candidate
   occurrences of k + 1 words (both halves of k words are frequent);
2. group-counts the candidates: distinct ones of a block are counted there, their sums are taken in the key
   range that their hash names, and each frequent one gets a number;
3. semi-joins the candidate occurrences with the numbers that came back and saves them sorted, before the
   next turn extends them.

Words are told apart by their bytes and phrases by the numbers of their two halves, so nothing rests on a
hash. Counts of all prefixes and suffixes then follow by joins of the narrow phrase tables, and scores in
38-digit decimals.

Bounds: a block holds `block_bytes` of text (or one longer text); a key range holds the distinct candidates
that fall into it, so the number of ranges must grow with the corpus; a frequent word or phrase reaches its
range once per block; phrases of one language are ranked by a range sort, not in one task.

Defined cases: null text is empty, null language is `und`; repeated rows count each; ids are not read, extra
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatloom.llm import blocks
from chatloom.llm.util import map_batches, only, parts_of, release, save
from chatloom.operators.positions import group_positions

#: Part of the rows that hold what a range found frequent (blocks use -1 and the ranges' numbers).
FOUND = -2
#: Language of a row without one.
NO_LANG = "und"

_LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)
_WORD, _SPACE, _END = 0, 1, 2
_KIND = np.full(256, _WORD, np.uint8)
_KIND[list(b" \t")] = _SPACE
_KIND[list(b".,;:!?\n\x0b\x0c\r")] = _END


@dataclass(frozen=True)
class Mining:
    """Least occurrences, longest phrase, phrases a language, share of a phrase's places that a longer one must cover."""

    min_count: int = 100
    longest: int = 5
    top: int = 2000
    percent: int = 100
    block_bytes: int = 10 << 20


def words_of(texts: Iterable[str | None]) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts and their positions; adjacent words of one piece have consecutive positions."""
    raw = np.frombuffer(b"\n".join((t or "").encode("utf-8", "surrogatepass") for t in texts) + b"\n", np.uint8)
    kind = _KIND[raw]
    inside = kind == _WORD
    edge = np.flatnonzero(inside[1:] != inside[:-1]).astype(np.int32) + 1  # the last byte ends a piece
    if inside[0]:
        edge = np.concatenate([np.zeros(1, np.int32), edge])
    starts, ends = edge[::2], edge[1::2]
    pieces = np.searchsorted(np.flatnonzero(kind == _END), starts)
    offsets = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(ends - starts, out=offsets[1:])
    data = _LOWER[raw[inside]]
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    return words, np.arange(len(starts), dtype=np.int64) + pieces


def narrow(values: np.ndarray) -> pa.Array:
    """Whole numbers from 0 on, in 8, 16 or 32 bits where they fit."""
    top = int(values.max(initial=0))
    for kind in (np.uint8, np.uint16, np.uint32):
        if top <= np.iinfo(kind).max:
            return pa.array(values.astype(kind))
    return pa.array(values.astype(np.int64))


def whole(column: pa.ChunkedArray) -> np.ndarray:
    return column.to_numpy().astype(np.int64)


def dealt(part: np.ndarray, parts: int, *inner: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Order of the keys by part (and then by `inner`), each key's place in that order, and where each part starts."""
    order = np.lexsort((*inner[::-1], part))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return order, place, np.searchsorted(part[order], np.arange(parts + 1)).tolist()


def relation(position: np.ndarray, code: np.ndarray, ident: np.ndarray) -> pa.Table:
    """Occurrences in the order of their positions and what their codes stand for, in one row of lists.

    Codes are numbered by their frequency and split into bytes, which compress to about what they say.
    """
    often = np.argsort(-np.bincount(code, minlength=len(ident)), kind="stable")
    rank = np.empty(len(ident), np.int64)
    rank[often] = np.arange(len(ident))
    code = rank[code]
    lists = {"step": narrow(np.diff(position, prepend=0)), "ident": narrow(ident[often])}
    lists |= {f"code{i}": pa.array(((code >> (8 * i)) & 255).astype(np.uint8)) for i in range(4)}
    return pa.table({k: pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for k, v in lists.items()})


def occurrences(held: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(positions, codes, what each code stands for) of a relation."""
    lists = {name: held[name].combine_chunks().flatten().to_numpy().astype(np.int64) for name in held.column_names}
    return np.cumsum(lists["step"]), sum(lists[f"code{i}"] << (8 * i) for i in range(4)), lists["ident"]


def keyed(starts: list[int], columns: dict[str, object]) -> Iterator[tuple[int, pa.Table]]:
    """The keys of each part, with the code of their first."""
    table = pa.table(columns)
    for p, (a, b) in enumerate(zip(starts, starts[1:])):
        if b > a:
            yield p, table.slice(a, b - a).replace_schema_metadata({"start": str(a)})


def first_keys(block: pa.Table, parts: int) -> Iterator[tuple[int, pa.Table]]:
    """The word occurrences of a block, and its distinct words by part."""
    block = block.combine_chunks()
    langs, texts = block["lang"].to_pylist(), block["text"].to_pylist()
    by_lang: dict[str, list[int]] = {}
    for i, lang in enumerate(langs):
        by_lang.setdefault(lang, []).append(i)
    positions, codes, words, counts, owner, at, known = [], [], [], [], [], 0, 0
    for lang, rows in by_lang.items():
        found, position = words_of(texts[i] for i in rows)
        if not len(found):
            continue
        coded = found.dictionary_encode()
        code = coded.indices.to_numpy()
        positions.append(position + at)
        codes.append(code.astype(np.int64) + known)
        words.append(coded.dictionary)
        counts.append(np.bincount(code, minlength=len(coded.dictionary)))
        owner += [lang] * len(coded.dictionary)
        at, known = at + int(position[-1]) + 2, known + len(coded.dictionary)
    if not known:
        return
    word = pa.concat_arrays(words)
    part = np.array([zlib.crc32(w, zlib.crc32(o.encode("utf-8", "surrogatepass"))) % parts for w, o in zip(word.to_pylist(), owner)])
    order, place, starts = dealt(part, parts)
    yield blocks.DOCS, relation(np.concatenate(positions), np.concatenate(codes), place)
    lang = pa.array(owner, pa.string()).take(pa.array(order)).dictionary_encode()
    yield from keyed(starts, {"lang": lang, "word": word.take(pa.array(order)), "n": narrow(np.concatenate(counts)[order])})


def _numbered(asked: list[tuple[str, pa.Table]], group: np.ndarray, groups: int, p: Mining, part: int, parts: int):
    """Sums of the groups, their numbers (-1 where too rare) and the answers to the blocks."""
    total = np.zeros(groups, np.int64)
    np.add.at(total, group, np.concatenate([whole(t["n"]) for _, t in asked]))
    often = np.flatnonzero(total >= p.min_count)
    number = np.full(groups, -1, np.int64)
    number[often] = np.arange(len(often)) * parts + part
    replies, at = [], 0
    for block, t in asked:
        got = number[group[at:at + len(t)]]
        at += len(t)
        there = np.flatnonzero(got >= 0)
        if len(there):
            start = int(t.schema.metadata[b"start"])
            replies.append((block, pa.table({"code": narrow(there + start), "id": narrow(got[there])})))
    return total, often, number, replies


def first_counts(asked: list[tuple[str, pa.Table]], p: Mining, part: int, parts: int):
    """Frequent words of a part (id, lang, word, a) with all words' sums by language, and the answers."""
    lang = pa.concat_arrays([c.cast(pa.string()) for _, t in asked for c in t["lang"].chunks]).dictionary_encode()
    word = pa.concat_arrays([c for _, t in asked for c in t["word"].chunks]).dictionary_encode()
    both = word.indices.to_numpy().astype(np.int64) * len(lang.dictionary) + lang.indices.to_numpy()
    distinct, group = np.unique(both, return_inverse=True)
    total, often, number, replies = _numbered(asked, group, len(distinct), p, part, parts)
    of_lang = distinct % len(lang.dictionary)
    found = pa.table({"id": number[often], "lang": lang.dictionary.take(pa.array(of_lang[often])),
                      "word": word.dictionary.take(pa.array(distinct[often] // len(lang.dictionary))), "a": total[often]})
    sums = np.zeros(len(lang.dictionary), np.int64)
    np.add.at(sums, of_lang, total)
    all_words = pa.table({"id": pa.nulls(len(sums), pa.int64()), "lang": lang.dictionary, "word": pa.nulls(len(sums), pa.binary()), "a": sums})
    yield "", FOUND, pa.concat_tables([found, all_words])
    for block, table in replies:
        yield block, part, table


def candidates(held: pa.Table, parts: int) -> tuple[np.ndarray, np.ndarray, list[int], dict[str, pa.Array]]:
    """Merge-join of a block's occurrences at adjacent positions: candidates of one word more.

    Their positions and codes, and the distinct ones (the codes' order) as key columns with the start of each part.
    """
    position, own, ident = occurrences(held)
    met = np.flatnonzero(position[1:] == position[:-1] + 1)
    pair, inverse, count = np.unique(own[met] * len(ident) + own[met + 1], return_inverse=True, return_counts=True)
    first, rest = ident[pair // len(ident)], ident[pair % len(ident)]
    mixed = (first.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (rest.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    part = ((mixed ^ (mixed >> np.uint64(31))) % np.uint64(parts)).astype(np.int64)
    order, place, starts = dealt(part, parts, first, rest)
    return position[met], place[inverse], starts, {"first": narrow(first[order]), "rest": narrow(rest[order]), "n": narrow(count[order])}


def next_keys(held: pa.Table, parts: int) -> Iterator[tuple[int, pa.Table]]:
    """The distinct candidates of a block by part."""
    _, _, starts, columns = candidates(held, parts)
    yield from keyed(starts, columns)


def frequent(position: np.ndarray, code: np.ndarray, replies: list[pa.Table]) -> pa.Table | None:
    """Semi-join of a block's occurrences with the frequent phrases; those with one next to them, None without any."""
    if not replies:
        return None
    known = np.concatenate([whole(t["code"]) for t in replies])
    ident = np.concatenate([whole(t["id"]) for t in replies])
    dense = np.full(max(int(code.max(initial=0)), int(known.max())) + 1, -1, np.int64)
    dense[known] = np.arange(len(known))
    own = dense[code]
    kept = np.flatnonzero(own >= 0)
    position, own = position[kept], own[kept]
    after = np.diff(position) == 1
    near = np.append(after, False) | np.append(False, after) if len(own) else np.zeros(0, bool)
    return relation(position[near], own[near], ident) if near.any() else None


def next_counts(asked: list[tuple[str, pa.Table]], p: Mining, part: int, parts: int):
    """Frequent phrases of a part (id, first, rest, a), and the answers."""
    first = np.concatenate([whole(t["first"]) for _, t in asked])
    rest = np.concatenate([whole(t["rest"]) for _, t in asked])
    order = np.lexsort((rest, first))
    new = np.append(True, (first[order][1:] != first[order][:-1]) | (rest[order][1:] != rest[order][:-1]))
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(new) - 1
    head = order[new]
    total, often, number, replies = _numbered(asked, group, len(head), p, part, parts)
    yield "", FOUND, pa.table({"id": number[often], "first": first[head[often]], "rest": rest[head[often]], "a": total[often]})
    for block, table in replies:
        yield block, part, table


def _count(packed: DataFrame, counts, p: Mining, parts: int, name: str) -> DataFrame:
    """The answers of all ranges, and what they found; saved, as both are read."""
    def run(key: tuple, group: pa.Table) -> pa.Table:
        asked = [(b, blocks.from_blob(x)) for b, x in zip(group["block"].to_pylist(), group["blob"].to_pylist())]
        return blocks.lean(pa.Table.from_batches([blocks.rows((b, n, blocks.to_blob(t)) for b, n, t in counts(asked, p, key[0].as_py(), parts))]))

    return save(packed.where(F.col("part") != blocks.DOCS).groupBy("part").applyInArrow(run, blocks.ROWS), name)


def _found(answers: DataFrame, schema: str) -> DataFrame:
    """Rows of what the ranges found."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        table = pa.concat_tables([blocks.from_blob(x) for x in batch.column(0).to_pylist()]).combine_chunks()
        return pa.RecordBatch.from_arrays([c.combine_chunks() if len(c.chunks) != 1 else c.chunk(0) for c in table.columns], names=table.column_names)

    return map_batches(answers.where(F.col("part") == FOUND).select("blob"), run, schema, 16)


def frequent_phrases(docs: DataFrame, p: Mining = Mining()) -> tuple[DataFrame, list[DataFrame]]:
    """`totals(lang, n)`, and per length from 1 the saved frequent phrases: (id, lang, phrase, last, a, pre, suf).

    `pre` and `suf` are the counts of the phrase's prefixes and suffixes of 1, 2, ... words; `first` and `rest`
    (from two words on) are the ids of its halves among the phrases that are one word shorter.
    """
    spark, parts = docs.sparkSession, parts_of(docs.sparkSession)
    rows = only(docs, "lang", "text").select(F.coalesce("lang", F.lit(NO_LANG)).alias("lang"), "text")
    packed = blocks.pack(rows, lambda block: first_keys(block, parts), "text", "setm-1", p.block_bytes)
    answers = _count(packed, first_counts, p, parts, "setm-count-1")
    words = save(_found(answers, "id long, lang string, word binary, a long"), "setm-words")
    totals = words.where("id IS NULL").groupBy("lang").agg(F.sum("a").alias("n"))
    text = F.col("word").cast("string")
    levels = [words.where("id IS NOT NULL").select("id", "lang", text.alias("phrase"), text.alias("last"), "a", F.array("a").alias("pre"), F.array("a").alias("suf"))]

    def extend(words: int):
        def run(block: str, held: pa.Table, replies: list[pa.Table]) -> pa.Table:
            if words > 1:
                position, code, _, _ = candidates(held, parts)
            else:  # words are named by their place among the block's keys
                position, rank, place = occurrences(held)
                code = place[rank]
            kept = frequent(position, code, replies)
            return pa.Table.from_batches([blocks.rows([] if kept is None else [(block, blocks.DOCS, blocks.to_blob(kept))])])

        return run

    for k in range(2, p.longest + 1):
        longer = save(blocks.finish(packed, answers.where(F.col("part") != FOUND), extend(k - 1), blocks.ROWS, named=True), f"setm-{k}")
        release(packed, answers)
        packed, answers = longer, _count(blocks.ask(longer, lambda held: next_keys(held, parts)), next_counts, p, parts, f"setm-count-{k}")
        found = _found(answers, "id long, first long, rest long, a long")
        before = levels[-1]
        head = before.select(F.col("id").alias("first"), "lang", F.col("phrase").alias("head"), "pre")
        tail = before.select(F.col("id").alias("rest"), "last", "suf")
        grown = found.join(head, "first").join(tail, "rest")
        levels.append(save(grown.select("id", "lang", F.concat_ws(" ", "head", "last").alias("phrase"), "last", "a", F.concat("pre", F.array("a")).alias("pre"),
                                        F.concat("suf", F.array("a")).alias("suf"), "first", "rest"), f"setm-phrases-{k}"))
    release(packed, answers)
    return totals, levels


def _scored(phrases: DataFrame, totals: DataFrame, words: int) -> DataFrame:
    """The lowest-scoring cut of phrases of so many words; 38 digits hold 1000 * a * n and l * r up to 10^17 words."""
    def big(c) -> F.Column:
        return F.col(c).cast("decimal(20,0)") if isinstance(c, str) else c.cast("decimal(20,0)")

    rows = phrases.join(totals, "lang")
    rows = rows.withColumn("_up", F.lit(1000).cast("decimal(4,0)") * big("a") * big("n"))
    cuts = []
    for cut in range(1, words):
        left, right = F.get("pre", F.lit(cut - 1)), F.get("suf", F.lit(words - cut - 1))
        rows = rows.withColumn(f"_by{cut}", big(left) * big(right))
        cuts.append(F.struct(F.expr(f"_up div _by{cut}").alias("score"), F.lit(cut).alias("cut"), left.alias("l"), right.alias("r")))
    lowest = cuts[0] if len(cuts) == 1 else F.least(*cuts)
    return rows.withColumn("_c", lowest).select("id", "lang", "phrase", "a", "_c.l", "_c.r", "n", "_c.score")


def collocations(docs: DataFrame, p: Mining = Mining()) -> DataFrame:
    """Each language's first `top` phrases of 2 to `longest` words: lang, rank, phrase, a, l, r, n, score."""
    totals, levels = frequent_phrases(docs, p)
    kept = None
    for words, phrases in enumerate(levels[1:], 2):
        rows = _scored(phrases, totals, words)
        if words < p.longest:
            # counts fall with every word, so a longer phrase covers only if one that is one word longer does
            longer = levels[words]
            cover = longer.select(F.col("first").alias("id"), F.col("a").alias("most")).unionByName(longer.select(F.col("rest").alias("id"), F.col("a").alias("most")))
            rows = rows.join(cover.groupBy("id").agg(F.max("most").alias("most")), "id", "left")
            rows = rows.where(F.col("most").isNull() | (F.col("most") * 100 < F.col("a") * p.percent)).drop("most")
        rows = rows.drop("id")
        kept = rows if kept is None else kept.unionByName(rows)
    kept = save(kept.withColumn("_score", -F.col("score")).withColumn("_a", -F.col("a")), "setm-scored")
    placed = group_positions(kept, ["lang"], ["_score", "_a", "phrase"], "rank").where(F.col("rank") < p.top)
    return placed.select("lang", (F.col("rank") + 1).alias("rank"), "phrase", "a", "l", "r", "n", "score")
