import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from chatloom.llm import ppm


def held_out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def brute(rows):
    """Escape method C with exclusion over dictionaries, byte by byte; and word counts."""
    seen, words = defaultdict(Counter), Counter()
    text = lambda t: b"\xff" * 3 + (t or "").encode() + b"\xff"
    for doc_id, t in rows:
        if not held_out(doc_id):
            b = text(t)
            for i in range(3, len(b)):
                for k in range(4):
                    seen[b[i - k:i]][b[i]] += 1
            words.update([*(t or "").encode().lower().split(), None])
    n, v, out = sum(words.values()), len(words), []
    for doc_id, t in rows:
        b, total = text(t), 0.0
        for i in range(3, len(b)):
            excluded, p = set(), 1.0
            for k in (3, 2, 1, 0):
                now = {s: c for s, c in seen[b[i - k:i]].items() if s not in excluded}
                if not now:
                    continue
                weight = sum(now.values()) + len(now)
                if b[i] in now:
                    p *= now[b[i]] / weight
                    break
                p *= len(now) / weight
                excluded |= set(now)
            else:
                p /= 256 - len(excluded)
            total += math.log10(p)
        tokens = [*(t or "").encode().lower().split(), None]
        base = sum(math.log10((words[w] + 1) / (n + v + 1)) for w in tokens)
        out.append((doc_id, len(tokens), sum(words[w] > 0 for w in tokens), n, base, total))
    return out


ROWS = [(1, "the cat sat on the mat"), (2, "The cat ate the rat"), (3, None), (4, ""), (None, "a null id trains"), (6, "é日本 the end\n\tÉÉ"),
        (6, "é日本 the end\n\tÉÉ"), (8, "zzz unseen bytes \x00\x01 q"), (9, "the " * 500), (10, "held out? cat mat rat sat"), (13, "the cat"), (16, "mat")]


@pytest.mark.parametrize("rows", [ROWS, [r for r in ROWS if held_out(r[0])], ROWS[2:3], []])
def test_scores_equal_brute_force(spark, rows):
    from pyspark.sql import functions as F

    from chatloom.llm.toxicity import held_out as out

    docs = spark.createDataFrame([(*r, 0, "x") for r in rows], "doc_id long, text string, train int, Text2 string").repartition(3)
    got = ppm.score(docs, ~out(modulus=7)).orderBy("doc_id", "n_tokens").collect()
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    want = sorted(brute(rows), key=key)
    assert len(got) == len(want)
    for g, w in zip(sorted(got, key=lambda r: key((r.doc_id, r.n_tokens))), want):
        assert (g.doc_id, g.n_tokens, g.n_known, g.train_tokens) == w[:4]
        assert g.base_score == pytest.approx(w[4]) and g.score == pytest.approx(w[5])


def test_probabilities_of_a_context_add_up():
    rng = np.random.default_rng(3)
    every = (np.int64(5) << 24 | 7 << 16 | 9 << 8) + np.arange(256)
    counts = np.where(rng.random(256) < 0.1, rng.integers(1, 9, 256), 0)
    assert (10 ** ppm.costs(every, counts, counts + (rng.random(256) < 0.2))).sum() == pytest.approx(1)
