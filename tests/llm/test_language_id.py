import random

import numpy as np
import pytest
from cases import HARD, docs
from pyspark.sql import functions as F

from chatloom.llm import language_id
from chatloom.llm.language_id import Kernel, Lookup, Presence, codes_of, has_letter, kernel, spaced
from chatloom.llm.toxicity import held_out

SYLLABLES = {
    "de": ["sch", "ei", "un", "gen", "ver", "ü", "auf", "licht", "keit", "der"],
    "en": ["the", "ing", "wh", "and", "ly", "ough", "er", "of", "tion", "sh"],
    "fr": ["eau", "é", "oi", "que", "les", "ment", "ai", "ç", "aux", "re"],
    "ru": ["ста", "но", "го", "при", "ель", "ова", "ть", "ми", "ест", "ка"],
}


def write(rng, lang, words):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 4))) for _ in range(words)).capitalize() + "."


def corpus(n, seed):
    rng = random.Random(seed)
    langs = rng.choices(list(SYLLABLES), [8, 4, 2, 1], k=n)
    return [(i, write(rng, lang, rng.randint(4, 120)), lang) for i, lang in enumerate(langs)]


def table(spark, rows):
    """rows: (doc_id, text, lang)."""
    other = docs(spark, [(i, t, lang or "none") for i, t, lang in rows]).drop("lang")
    return other.withColumn("lang", F.when(F.col("source") != "none", F.col("source")))


def grams(text, longest):
    raw = spaced(text)
    return {raw[i:i + n] for n in range(1, longest + 1) for i in range(len(raw) - n + 1)}


def test_held_out_accuracy_and_hard_rows(spark):
    rows = corpus(900, 1)
    hard = [(10_000 + (i or 0), t, None) for i, t in HARD] + [(20_000, "12 345 !?", "en"), (20_001, "日本", "de"), (None, "the shing", "en")]
    whole = table(spark, rows + hard)
    p = Kernel(landmarks=40, per_class=200)
    model = language_id.train(whole.where(~held_out()), p)
    assert model.languages == sorted(SYLLABLES)
    got = language_id.predict(whole, model, p).withColumn("out", held_out()).collect()
    assert len(got) == len(rows) + len(hard)
    truth = {i: lang for i, _, lang in rows}
    out = [(r.lang_pred, truth[r.doc_id]) for r in got if r.out and r.doc_id in truth]
    assert len(out) > 150 and sum(a == b for a, b in out) >= 0.99 * len(out)
    assert all(0 <= r.score <= 1 for r in got)
    by_id = {r.doc_id: r for r in got}
    for i, text, _ in hard:
        assert (by_id[i].lang_pred == "und") == (not has_letter(text))
    assert by_id[None].lang_pred == "en"
    again = language_id.train(whole.repartition(7).where(~held_out()), p)
    assert np.allclose(again.weights, model.weights, rtol=1e-4, atol=1e-6)


def test_equals_plain_kernel_ridge_regression(spark):
    rows = corpus(90, 2)
    p = Kernel(landmarks=16, per_class=50, longest=3, window=64, batch_rows=7, shard_rows=4096)
    model = language_id.train(table(spark, rows), p)
    sample = language_id._sample(table(spark, rows), p)[0].collect()
    turns = {}
    for r in sorted(sample, key=lambda r: r.rank):
        turns.setdefault(r.lang, []).append(r.text)
    marks = [grams(t, 3) for lang in turns for t in turns[lang][:4]]
    every = set().union(*marks)

    def k(a, b):
        return len(a & b) / np.sqrt(max(1, len(a)) * max(1, len(b)))

    near = np.array([[k(grams(r.text, 3) & every, b) for b in marks] for r in sample])
    own = np.array([[k(a, b) for b in marks] for a in marks])
    target = np.array([[1.0 if r.lang == lang else -1.0 for lang in model.languages] for r in sample])
    left = near.T @ near + p.ridge * len(sample) * own + 1e-8 * np.trace(near.T @ near) / len(marks) * np.eye(len(marks))
    alpha = np.linalg.solve(left, near.T @ target)
    texts = [t for _, t, _ in corpus(40, 3)] + ["", "x", "日本"]
    want = np.array([[k(grams(t, 3) & every, b) for b in marks] for t in texts]) @ alpha
    got = language_id.scores_of([spaced(t) for t in texts], Presence(model.codes, p.window), model.weights)
    assert np.allclose(got, want, atol=1e-5)


def test_kernel_counts_common_grams_over_windows():
    rng = random.Random(4)
    texts = [spaced(write(rng, lang, n)) for lang in SYLLABLES for n in (1, 30, 400)] + [spaced("")]
    codes = [np.unique(np.concatenate([c for t in texts for c in [list(codes_of(np.frombuffer(t, np.uint8), 4))[n]]])) for n in range(4)]
    want = [{t[i:i + n] for n in range(1, 5) for i in range(len(t) - n + 1)} for t in texts]
    for window in (5, 100, 1 << 20):
        x = Presence(codes, window).of(texts)
        assert x.sum(1).tolist() == [len(w) for w in want]
        assert np.allclose(kernel(x, x), [[len(a & b) / np.sqrt(len(a) * len(b)) for b in want] for a in want])


def test_lookup_is_exact_where_hashes_meet(monkeypatch):
    monkeypatch.setattr(Lookup, "BITS", 6)
    rng = np.random.default_rng(5)
    codes = np.unique(rng.integers(1, 1 << 32, 3000, dtype=np.uint32))
    asked = np.concatenate([codes, rng.integers(1, 1 << 32, 3000, dtype=np.uint32)])
    known = {c: i for i, c in enumerate(codes.tolist())}
    assert Lookup(codes).find(asked).tolist() == [known.get(c, -1) for c in asked.tolist()]
    assert Lookup(codes[:0]).find(asked[:3]).tolist() == [-1] * 3


def test_without_languages_or_rows(spark):
    rows = table(spark, [(1, "some text", None), (2, None, None)])
    model = language_id.train(rows)
    assert model.languages == []
    assert sorted((r.doc_id, r.lang_pred, r.score) for r in language_id.predict(rows, model).collect()) == [(1, "und", 0.0), (2, "und", 0.0)]
    silent = language_id.train(table(spark, [(1, "...", "en"), (2, None, "de")]))
    assert {r.lang_pred for r in language_id.predict(table(spark, [(1, "abc", None)]), silent).collect()} == {"de"}
    assert language_id.predict(table(spark, []), model).count() == 0
    with pytest.raises(ValueError):
        language_id.train(rows, Kernel(longest=5))
    with pytest.raises(ValueError):
        language_id.train(table(spark, corpus(30, 6)), Kernel(max_rows=2))
