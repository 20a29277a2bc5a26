import random
from collections import Counter

import pytest
from cases import HARD, docs

from chatloom.llm import ngram_join
from chatloom.llm.components import connected_components


def lowest(ids, links):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def brute(rows, n=5, percent=80):
    """(doc_id, set size, component) by comparing all pairs of rows with an id."""
    sets = []
    for doc_id, text in rows:
        w = (text or "").encode().lower().split()
        sets.append((doc_id, frozenset(tuple(w[i:i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])))
    links = []
    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and a is not None and b is not None and 100 * len(x & y) >= percent * len(x | y):
                links.append((a, b))
    comp = lowest({d for d, _ in sets if d is not None}, links)
    out = Counter()
    for doc_id, s in sets:
        mine = comp.get(doc_id)
        if doc_id is None and s:  # a null id takes its component from its copies
            mine = min((comp[d] for d, t in sets if d is not None and t == s), default=None)
        out[doc_id, len(s), mine] += 1
    return out


def edited(rng, words, k):
    words = list(words)
    for _ in range(k):
        words[rng.randrange(len(words))] = f"w{rng.randrange(10 ** 6)}"
    return words


def family(seed, n, length, edits):
    """Chains and clusters of near copies, shared passages, exact copies and unrelated texts."""
    rng, rows = random.Random(seed), []
    shared = [f"s{i}" for i in range(30)]
    for g in range(n):
        base = [f"g{g}t{i}" for i in range(length)]
        for _ in range(rng.randint(1, 6)):
            base = edited(rng, base, rng.randint(0, edits)) if rng.random() < 0.5 else base
            rows.append(" ".join(base))
        if rng.random() < 0.4:
            rows.append(" ".join(shared + edited(rng, base, 40)[:rng.randint(3, 20)]))
        if rng.random() < 0.3:
            rows.append(" ".join(base).upper())
    rng.shuffle(rows)
    return [(100 + i, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("seed,length,edits", [(1, 60, 3), (2, 25, 1), (3, 8, 1), (4, 120, 5)])
def test_components_equal_brute_force(spark, seed, length, edits):
    rows = family(seed, 25, length, edits) + HARD + [(None, "word " * 5000)]
    got = ngram_join.similar_components(docs(spark, rows))
    assert Counter(tuple(r) for r in got.collect()) == brute(rows)


def test_threshold_is_exact(spark):
    """Sets of 9 shingles: 8 of 10 link, 7 of 11 do not."""
    words = [f"a{i}" for i in range(13)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:12] + ["z"])), (3, " ".join(words[:11] + ["y", "x"]))]
    assert {tuple(r) for r in ngram_join.similar_components(docs(spark, rows)).collect()} == set(brute(rows)) == {(1, 9, 1), (2, 9, 1), (3, 9, 3)}


def test_large_near_copy_cluster_and_hot_passage(spark):
    rng = random.Random(9)
    base = [f"t{i}" for i in range(100)]
    rows = [(i, " ".join(edited(rng, base, 1))) for i in range(250)]
    rows += [(1000 + i, " ".join([f"p{j}" for j in range(40)] + [f"u{i}x{j}" for j in range(30)])) for i in range(250)]
    assert Counter(tuple(r) for r in ngram_join.similar_components(docs(spark, rows)).collect()) == brute(rows)


def test_empty_table(spark):
    assert ngram_join.similar_components(docs(spark, [])).count() == 0


def test_connected_components(spark):
    rng = random.Random(5)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(400 + i, 401 + i) for i in range(60)] + [(500, i) for i in range(501, 600)] + [(7, 7)]
    edges = spark.createDataFrame(links + [(None, 1)], "a long, b long")
    nodes = {x for e in links if e[0] != e[1] for x in e}
    want = lowest(nodes, [e for e in links if e[0] != e[1]])
    assert {r.node: r.component for r in connected_components(edges).collect()} == want
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
