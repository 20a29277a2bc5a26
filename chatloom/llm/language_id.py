"""Language ID: blended-spectrum string kernel, Nyström landmarks, one-versus-rest kernel ridge regression.

Two texts are as alike as the share of byte n-grams (lengths 1 to `longest`) that are present in both:
k(x, y) = |G(x) & G(y)| / sqrt(|G(x)| |G(y)|), over the n-grams that stand in a landmark at all. Landmarks
are some learned texts of every language; ridge regression in their span needs only sums of the learned
rows' kernel columns (landmarks x landmarks and landmarks x languages), which tasks add up over matrices of
a batch. A text's scores are one matrix product: its presence row times the landmarks' presence times their
coefficients; the last two factors are multiplied once, so the model is n-grams x languages.

Bounds: learned rows are at most `per_class` of a language (smallest hash of the id) and `max_rows` in all;
landmarks at most `landmarks`, taken from texts up to `landmark_bytes` first; a task holds the presence of
`batch_rows` texts and reads a text in windows of `window` bytes, whatever its length.

Defined cases: a null text or one without a letter is `und` with score 0; so is every text where nothing was
learned; a text that shares no n-gram with any landmark gets the first language by name; of rows that share
an id and a language one is learned; ties go to the first language by name; rows are scored each, repeated
ones too; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chatloom.llm.util import map_batches, only, release, save
from chatloom.session import ship_package

#: Every ASCII byte but letters is a space.
_SPACED = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


@dataclass(frozen=True)
class Kernel:
    """Longest n-gram, bounds of the learned rows and landmarks, ridge, and sizes of a task's work."""

    longest: int = 4
    per_class: int = 2000
    max_rows: int = 16384
    landmarks: int = 256
    landmark_bytes: int = 16384
    ridge: float = 1e-4
    shard_rows: int = 1024
    batch_rows: int = 128
    window: int = 1 << 20


@dataclass(frozen=True)
class Model:
    """Languages in order, n-gram codes by length, and a weight per n-gram and language."""

    languages: list[str]
    codes: list[np.ndarray]
    weights: np.ndarray


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def spaced(text: str | None) -> bytes:
    """Lower-cased words of letters between single spaces, in UTF-8."""
    raw = (text or "").lower().encode("utf-8", "surrogatepass").translate(_SPACED)
    return b" " + b" ".join(raw.split()) + b" "


def codes_of(raw: np.ndarray, longest: int) -> Iterator[np.ndarray]:
    """The codes of the n-grams that start at each byte, for n = 1 to `longest` (4 at most)."""
    code = raw.astype(np.uint32)
    yield code
    for n in range(2, longest + 1):
        code = (code[:-1] << np.uint32(8)) | raw[n - 1:]
        yield code


class Lookup:
    """Places of n-gram codes of one length among `codes` (sorted); -1 for the others. Hashed, and compared exactly."""

    BITS = 20

    def __init__(self, codes: np.ndarray):
        self.keys = np.append(codes.astype(np.uint32), np.uint32(0xFFFFFFFF))  # no n-gram of UTF-8 has this code
        spot = self._spot(codes.astype(np.uint32))
        self.slot = np.full(1 << self.BITS, len(codes), np.int32)
        self.after = np.full(len(codes) + 1, -1, np.int32)
        order = np.argsort(spot, kind="stable").astype(np.int32)
        same = spot[order[1:]] == spot[order[:-1]]
        self.after[order[:-1][same]] = order[1:][same]
        first = np.append(True, ~same) if len(order) else np.zeros(0, bool)
        self.slot[spot[order[first]]] = order[first]

    def _spot(self, codes: np.ndarray) -> np.ndarray:
        return (codes * np.uint32(2654435761)) >> np.uint32(32 - self.BITS)

    def find(self, codes: np.ndarray) -> np.ndarray:
        at = self.slot[self._spot(codes)]
        same = self.keys[at] == codes
        found = np.where(same, at, -1)
        open_ = np.flatnonzero(~same & (self.after[at] >= 0))
        at = at[open_]
        while len(open_):
            at = self.after[at]
            same = self.keys[at] == codes[open_]
            found[open_[same]] = at[same]
            go = ~same & (self.after[at] >= 0)
            open_, at = open_[go], at[go]
        return found


class Presence:
    """Presence rows of texts over the n-grams of a model."""

    def __init__(self, codes: list[np.ndarray], window: int):
        self.lookups, self.window = [Lookup(c) for c in codes], window
        self.starts = np.cumsum([0] + [len(c) for c in codes]).tolist()

    def _windows(self, texts: list[bytes]) -> Iterator[tuple[list[int], list[bytes]]]:
        """Rows and pieces of about `window` bytes; pieces of one text overlap by what an n-gram can straddle."""
        rows, pieces, held, overlap = [], [], 0, len(self.lookups) - 1
        for i, text in enumerate(texts):
            for start in range(0, max(1, len(text) - overlap), self.window):
                piece = text[start:start + self.window + overlap]
                if held and held + len(piece) > self.window:
                    yield rows, pieces
                    rows, pieces, held = [], [], 0
                rows.append(i)
                pieces.append(piece)
                held += len(piece)
        if rows:
            yield rows, pieces

    def of(self, texts: list[bytes]) -> np.ndarray:
        width, longest = self.starts[-1], len(self.lookups)
        flat = np.zeros(len(texts) * width, np.uint8)
        gap = bytes(longest)  # no n-gram of a text holds a zero byte
        for rows, pieces in self._windows(texts):
            raw = np.frombuffer(gap.join(pieces) + gap, np.uint8)
            row = np.repeat(np.array(rows, np.int64) * width, [len(p) + longest for p in pieces])
            for codes, lookup, start in zip(codes_of(raw, longest), self.lookups, self.starts):
                at = lookup.find(codes)
                hit = np.flatnonzero(at >= 0)
                flat[row[hit] + (at[hit] + start)] = 1
        return flat.reshape(len(texts), width)


def _norms(counts: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(counts, 1))


def kernel(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The kernel between two sets of presence rows, as one matrix product."""
    a, b = x.astype(np.float32), y.astype(np.float32)
    return (a @ b.T).astype(np.float64) / np.outer(_norms(a.sum(1)), _norms(b.sum(1)))


def _sample(docs: DataFrame, p: Kernel) -> tuple[DataFrame, list[str]]:
    """The learned rows (lang, doc_id, text, rank), saved, and their languages in order."""
    rows = only(docs, "doc_id", "lang", "text").where("lang IS NOT NULL AND doc_id IS NOT NULL")
    languages = sorted(r["lang"] for r in rows.select("lang").distinct().limit(p.max_rows + 1).collect())
    if len(languages) > p.max_rows:
        raise ValueError(f"more than {p.max_rows} languages")
    each = max(1, min(p.per_class, p.max_rows // max(1, len(languages))))
    turn = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    ids = rows.groupBy("lang", "doc_id").agg(F.lit(1).alias("_one")).withColumn("rank", turn).where(F.col("rank") <= each).select("lang", "doc_id", "rank")
    chosen = rows.join(F.broadcast(ids), ["lang", "doc_id"])  # at most max_rows narrow rows
    return save(chosen.groupBy("lang", "doc_id", "rank").agg(F.max("text").alias("text")), "language-sample"), languages


def _landmarks(sample: DataFrame, languages: list[str], p: Kernel) -> list[bytes]:
    each = max(1, p.landmarks // max(1, len(languages)))
    size = F.octet_length("text")
    turn = F.row_number().over(Window.partitionBy("lang").orderBy(F.when(size <= p.landmark_bytes, 0).otherwise(size), "rank"))
    picked = sample.where("text IS NOT NULL").withColumn("turn", turn).where(F.col("turn") <= each)
    texts = picked.orderBy("turn", "lang").limit(max(p.landmarks, 1)).select("text").collect()
    return [spaced(r["text"]) for r in texts if has_letter(r["text"])]


def train(docs: DataFrame, p: Kernel = Kernel()) -> Model:
    """Learns from `text` and non-null `lang` of `docs`."""
    if not 1 <= p.longest <= 4:
        raise ValueError("n-grams of 1 to 4 bytes")
    sample, languages = _sample(docs, p)
    texts = _landmarks(sample, languages, p)
    empty = Model(languages, [np.empty(0, np.uint32)] * p.longest, np.zeros((0, len(languages))))
    if not texts:
        return empty
    sets = [[np.unique(c) for c in codes_of(np.frombuffer(t, np.uint8), p.longest)] for t in texts]
    codes = [np.unique(np.concatenate([s[n] for s in sets])) for n in range(p.longest)]
    marks = Presence(codes, p.window).of(texts)
    order = {lang: i for i, lang in enumerate(languages)}
    shared = sample.sparkSession.sparkContext.broadcast((codes, marks, order))

    def sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, marks, order = shared.value
        presence, gram, cross, n = Presence(codes, p.window), 0.0, 0.0, 0
        for batch in batches:
            for start in range(0, batch.num_rows, p.batch_rows):
                lang, text = (c.to_pylist() for c in batch.slice(start, p.batch_rows).columns)
                near = kernel(presence.of([spaced(t) for t in text]), marks)
                target = np.full((len(lang), len(order)), -1.0)
                target[np.arange(len(lang)), [order[x] for x in lang]] = 1.0
                gram, cross, n = gram + near.T @ near, cross + near.T @ target, n + len(lang)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([gram.tobytes()], pa.binary()), pa.array([cross.tobytes()], pa.binary())], names=["n", "gram", "cross"])

    ship_package(sample.sparkSession)
    shards = -(-p.max_rows // p.shard_rows)  # a fixed number of sums, each of a bounded size
    parts = sample.select("lang", "text").repartition(shards, F.xxhash64("lang", "text")).mapInArrow(sums, "n long, gram binary, cross binary").collect()
    release(sample)
    m = len(texts)
    gram = sum(np.frombuffer(r["gram"]).reshape(m, m) for r in parts)
    cross = sum(np.frombuffer(r["cross"]).reshape(m, len(languages)) for r in parts)
    own = kernel(marks, marks)
    left = gram + p.ridge * sum(r["n"] for r in parts) * own + 1e-8 * np.trace(gram) / m * np.eye(m)
    alpha = np.linalg.solve(left, cross)
    return Model(languages, codes, marks.T.astype(np.float64) @ (alpha / _norms(marks.sum(1, dtype=np.int64))[:, None]))


def scores_of(texts: list[bytes], presence: Presence, weights: np.ndarray) -> np.ndarray:
    """Regression values (texts x languages), about -1 to 1, by one matrix product."""
    x = presence.of(texts).astype(np.float32)
    return (x @ weights).astype(np.float64) / _norms(x.sum(1))[:, None]


def predict(docs: DataFrame, model: Model, p: Kernel = Kernel()) -> DataFrame:
    """doc_id, lang_pred and score (0 to 1: half of one plus the language's regression value) of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    built: list[tuple[Presence, np.ndarray]] = []  # once in a task

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        model = shared.value
        if not built:
            built.append((Presence(model.codes, p.window), model.weights.astype(np.float32)))
        texts = batch.column(1).to_pylist()
        known = [i for i, t in enumerate(texts) if len(model.languages) and has_letter(t)]
        lang, score = ["und"] * len(texts), np.zeros(len(texts))
        if known:
            value = scores_of([spaced(texts[i]) for i in known], *built[0])
            best = value.argmax(1)
            for i, b in zip(known, best.tolist()):
                lang[i] = model.languages[b]
            score[known] = np.clip((1 + value[np.arange(len(known)), best]) / 2, 0, 1)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return map_batches(only(docs, "doc_id", "text"), run, f"doc_id {only(docs, 'doc_id').schema[0].dataType.simpleString()}, lang_pred string, score double", p.batch_rows)
