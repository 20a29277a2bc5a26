import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from cases import HARD, docs
from pyspark.sql import functions as F

from chatloom.llm import collocations
from chatloom.llm.collocations import Mining, collocations as mine


def lowered(text):
    return "".join(c.lower() if c.isascii() else c for c in text or "")


def pieces_of(text):
    return [[w for w in re.split("[ \t]+", piece) if w] for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lowered(text))]


def plain(rows, p):
    """Counts of all phrases by language, then every rule as it is said."""
    count, total = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        seen = count.setdefault(lang, Counter())
        for words in pieces_of(text):
            total[lang] += len(words)
            for k in range(1, p.longest + 1):
                seen.update(tuple(words[i:i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in count.items():
        often = {w: a for w, a in f.items() if len(w) > 1 and a >= p.min_count}
        rows = []
        for w, a in often.items():
            def inside(longer):
                return any(longer[i:i + len(w)] == w for i in range(len(longer) - len(w) + 1))

            if any(len(q) > len(w) and 100 * b >= p.percent * a and inside(q) for q, b in often.items()):
                continue
            score, _, left, right = min((1000 * a * total[lang] // (f[w[:k]] * f[w[k:]]), k, f[w[:k]], f[w[k:]]) for k in range(1, len(w)))
            rows.append((-score, -a, " ".join(w).encode(), left, right))
        for i, (score, a, phrase, left, right) in enumerate(sorted(rows)[:p.top]):
            out.append((lang, i + 1, phrase.decode(), -a, left, right, total[lang], -score))
    return sorted(out)


def corpus(n, seed, langs=("en", "en", "en", "de", None)):
    rng = random.Random(seed)
    words = ["new", "York", "city", "the", "of", "é", "THE", "x-y", "über", "\x00z", "a\x85b", "日本"]
    fixed = ["new york city hall of the", "of the, of the; of the", "ha ha ha ha ha ha"]
    rows = []
    for _ in range(n):
        parts = [rng.choice(fixed) if rng.random() < 0.3 else rng.choice(words) for _ in range(rng.randint(0, 40))]
        rows.append((rng.choice(langs), "".join(x + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", "!?"]) for x in parts)))
    return rows + [(None, None), ("en", ""), ("fr", " ,. ")]


def table(spark, rows):
    other = docs(spark, [(i, t, "none" if lang is None else lang) for i, (lang, t) in enumerate(rows)]).drop("lang")
    return other.withColumn("lang", F.when(F.col("source") != "none", F.col("source")))


def found(df, p):
    return sorted(tuple(r) for r in mine(df, p).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.mark.parametrize("p", [Mining(min_count=8), Mining(min_count=3, top=25, block_bytes=2000), Mining(min_count=5, longest=3, percent=60), Mining(min_count=1, longest=2, block_bytes=1)])
def test_equals_the_plain_rules(spark, p):
    rows = corpus(120, 1)
    assert found(table(spark, rows), p) == plain(rows, p)


def test_hard_rows(spark):
    rows = [("en", t) for _, t in HARD] + [("en", "word " * 3000)] * 2
    p = Mining(min_count=2)
    assert found(table(spark, rows), p) == plain(rows, p)
    assert found(table(spark, []), p) == [] and found(table(spark, [(None, None)]), p) == []


def test_phrases_stay_inside_pieces_and_blocks(spark):
    rows = [("en", "alpha beta")] * 10 + [("en", "alpha, beta")] * 5 + [("en", "beta alpha"), ("de", "alpha beta")]
    got = found(table(spark, rows), Mining(min_count=10, block_bytes=30))
    assert got == [("en", 1, "alpha beta", 10, 16, 16, 32, 1000 * 10 * 32 // 256)]


def test_words_and_positions():
    rng = random.Random(3)
    for _ in range(200):
        texts = ["".join(rng.choices("aB .,\t\n!é", k=rng.randint(0, 30))) for _ in range(rng.randint(1, 4))]
        words, position = collocations.words_of(texts)
        want = [p for t in texts for p in pieces_of(t)]
        assert [w.decode() for w in words.to_pylist()] == [w for p in want for w in p]
        assert (np.diff(position) == 1).tolist() == [b for i, p in enumerate(q for q in want if q) for b in ([False] if i else []) + [True] * (len(p) - 1)]


def test_scores_beyond_64_bits(spark):
    n = 4 * 10**13
    phrases = spark.createDataFrame([(1, "en", "a b c", 3 * 10**12 + 7, [10**13 + 1, 4 * 10**12 + 3, 0], [9 * 10**12 + 5, 5 * 10**12 + 9, 0])],
                                    "id long, lang string, phrase string, a long, pre array<long>, suf array<long>")
    totals = spark.createDataFrame([("en", n)], "lang string, n long")
    row = collocations._scored(phrases, totals, 3).first()
    a = 3 * 10**12 + 7
    cuts = [(1000 * a * n // (x * y), x, y) for x, y in ((10**13 + 1, 5 * 10**12 + 9), (4 * 10**12 + 3, 9 * 10**12 + 5))]
    assert (row.score, row.l, row.r) == min(cuts) and row.l * row.r > 2**64


def test_numbers_do_not_depend_on_hashes(monkeypatch):
    monkeypatch.setattr(collocations.zlib, "crc32", lambda *_: 0)  # all words in one range
    block = pa.table({"lang": ["en", "de"], "text": ["a b a", "a"]})
    parts = list(collocations.first_keys(block, 8))
    assert [p for p, _ in parts] == [-1, 0] and len(parts[1][1]) == 3
