"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Learning: at most `max_rows` labelled rows (smallest hash of the id; a documented bound) are
turned into hashed features where their texts are read, dealt to tasks of `shard_rows`, and learned
by FTRL-proximal with per-coordinate rates; the L1 term leaves few weights, whose shard means
make the model (at most `2**bits` floats, so it can travel with the tasks). Scoring reads every
whole text once and shuffles nothing.

Defined cases: null and empty texts score by the bias alone; labels that are null, rows without
a text row, and ids that repeat in `labels` (the larger label holds) are no error; without any
label the score is 0.5 for all; repeated rows are scored each; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatloom.llm.util import map_batches, only, plain_words, save


@dataclass(frozen=True)
class Ftrl:
    """Rates (alpha, beta), penalties (l1, l2), feature space, epochs, and the bound of the sample."""

    alpha: float = 50.0
    beta: float = 1.0
    l1: float = 0.3
    l2: float = 0.0
    bits: int = 20
    epochs: int = 10
    shard_rows: int = 16384
    max_rows: int = 32768


def features(text: str | None, bits: int) -> np.ndarray:
    """Distinct hashed features: words, word pairs and pairs with a word between; 0 is the bias."""
    words = plain_words(text)
    h = np.fromiter(map(zlib.crc32, words), np.uint64, len(words))
    mixed = [h * np.uint64(0x9E3779B97F4A7C15),
             (h[:-1] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (h[1:] * np.uint64(0x165667B19E3779F9)),
             (h[:-2] * np.uint64(0x27D4EB2F165667C5)) ^ (h[2:] * np.uint64(0x85EBCA77C2B2AE63))]
    flat = np.concatenate(mixed)
    flat = (flat ^ (flat >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - bits)
    return np.union1d(np.zeros(1, np.int32), flat.astype(np.int32))


def learn(rows: list[tuple[np.ndarray, int]], p: Ftrl) -> tuple[np.ndarray, np.ndarray]:
    """(features, weights) other than 0 after `epochs` passes over the rows in their order."""
    z, n = np.zeros(1 << p.bits), np.zeros(1 << p.bits)

    def weights(zi, ni):
        w = (np.sign(zi) * p.l1 - zi) / ((p.beta + np.sqrt(ni)) / p.alpha + p.l2)
        return np.where(np.abs(zi) <= p.l1, 0.0, w)

    for _ in range(p.epochs):
        for at, y in rows:
            zi, ni = z[at], n[at]
            w, x = weights(zi, ni), 1 / np.sqrt(len(at))
            g = (1 / (1 + np.exp(-np.clip(w.sum() * x, -35, 35))) - y) * x
            z[at] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / p.alpha * w
            n[at] = ni + g * g
    w = weights(z, n)
    at = np.flatnonzero(w)
    return at, w[at]


def train(docs: DataFrame, labels: DataFrame, p: Ftrl = Ftrl(), label: str = "toxic") -> dict[int, float]:
    """Weights by feature, learned from the bounded sample of `labels` (doc_id, `label`)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    sample = (only(labels, "doc_id", label).toDF("doc_id", "y").where("doc_id IS NOT NULL AND y IS NOT NULL")
              .groupBy("doc_id").agg(F.max(F.col("y").cast("int")).alias("y"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(p.max_rows))
    texts = only(docs, "doc_id", "text").join(F.broadcast(sample), "doc_id")  # at most max_rows narrow rows

    def hashed(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [features(t, p.bits) for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([f.tobytes() for f in found], pa.binary())], names=["doc_id", "y", "at"])

    once = (map_batches(texts.select("doc_id", "text", "y"), hashed, f"doc_id {kind}, y int, at binary")
            .groupBy("doc_id", "y").agg(F.max("at").alias("at")))

    def shard(batch: pa.Table) -> pa.Table:
        rows = batch.sort_by("doc_id")
        at, w = learn([(np.frombuffer(a, np.int32), y) for a, y in zip(rows["at"].to_pylist(), rows["y"].to_pylist())], p)
        return pa.table({"feature": pa.array(at, pa.int64()), "w": pa.array(w, pa.float64())})

    once = save(once, "toxicity-sample")
    shards = max(1, -(-once.count() // p.shard_rows))
    dealt = once.select(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(shards)).alias("shard"), "doc_id", "y", "at")
    means = dealt.groupBy("shard").applyInArrow(shard, "feature long, w double").groupBy("feature").agg((F.sum("w") / shards).alias("w"))
    return {r["feature"]: r["w"] for r in means.collect()}


def toxicity_scores(docs: DataFrame, weights: dict[int, float], bits: int = Ftrl.bits, cut: float = 0.3) -> DataFrame:
    """doc_id, score (0 to 1) and predicted (score >= cut) of every whole text."""
    model = np.zeros(1 << bits, np.float32)
    for k, w in weights.items():
        model[k] = w
    model = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [features(t, bits) for t in batch.column(1).to_pylist()]
        total = np.array([model.value[f].sum(dtype=np.float64) / np.sqrt(len(f)) for f in found])
        score = 1 / (1 + np.exp(-np.clip(total, -35, 35)))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array(score >= cut).cast(pa.int32())], names=["doc_id", "score", "predicted"])

    return map_batches(only(docs, "doc_id", "text"), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double, predicted int")


def held_out(column="doc_id", modulus: int = 4, remainder: int = 2):
    """Whether crc32 of the id as text leaves `remainder`; false for a null id."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % modulus == remainder, F.lit(False))
