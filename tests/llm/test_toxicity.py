import random
from collections import Counter

import numpy as np
import pytest
from cases import HARD, docs

from chatloom.llm import toxicity

WORDS = ["river", "stone", "cloud", "music", "garden", "window", "train", "paper", "silver", "market", "winter", "letter"]
BAD = ["grumph", "snarf", "blorkish"]


def corpus(n, seed):
    rng, rows, labels = random.Random(seed), [], []
    for i in range(n):
        words, toxic = rng.choices(WORDS, k=rng.randint(5, 120)), int(rng.random() < 0.2)
        for _ in range(2 * toxic):
            words.insert(rng.randint(0, len(words)), rng.choice(BAD))
        rows.append((i, " ".join(words)))
        labels.append((i, toxic))
    return rows, labels


def test_held_out_accuracy_and_hard_rows(spark):
    rows, labels = corpus(1200, 1)
    table = docs(spark, rows + [(10_000 + (i or 0), t) for i, t in HARD])
    marks = spark.createDataFrame(labels + [(None, 1), (7, None), (7, labels[7][1]), (99_999, 1)], "doc_id long, toxic int")
    weights = toxicity.train(table, marks.where(~toxicity.held_out()))
    got = {r.doc_id: r for r in toxicity.toxicity_scores(table, weights).withColumn("out", toxicity.held_out()).collect()}
    assert len(got) == 1200 + len({i for i, _ in HARD}) and all(0 <= r.score <= 1 for r in got.values())
    out = Counter((got[i].predicted, y) for i, y in labels if got[i].out)
    assert out[1, 1] >= 0.95 * (out[1, 1] + out[0, 1]) and out[1, 0] <= 0.05 * (out[1, 0] + out[0, 0])
    assert all(r.predicted == (r.score >= 0.3) for r in got.values())
    again = toxicity.train(table, marks.where(~toxicity.held_out()))
    assert again == pytest.approx(weights)


def test_l1_leaves_few_weights():
    rows, labels = corpus(400, 2)
    p = toxicity.Ftrl()
    at, w = toxicity.learn([(toxicity.features(t, p.bits), y) for (_, t), (_, y) in zip(rows, labels)], p)
    seen = len(np.unique(np.concatenate([toxicity.features(t, p.bits) for _, t in rows])))
    assert 0 < len(at) < seen and np.all(w != 0)


def test_without_labels_or_rows(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.train(docs(spark, [(1, "a")]), none) == {}
    assert [r.score for r in toxicity.toxicity_scores(docs(spark, [(1, "a"), (2, None)]), {}).collect()] == [0.5, 0.5]
    assert toxicity.toxicity_scores(docs(spark, []), {}).count() == 0
