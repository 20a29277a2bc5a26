import random

import numpy as np
import pytest

from chatloom.llm import nn_descent as nn


def brute(rows, threshold=0.98, kind=np.float32):
    """(id, links, component, kept) of every row with an id, sorted."""
    one = dict(enumerate(((v, label) for _, v, label in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]))))
    name = sorted(r[0] for r in rows if r[0] is not None)
    ok = {i: np.array(v, kind).astype(float) for i, (v, l) in one.items()
          if l is not None and v and None not in v and np.isfinite(np.array(v, float)).all() and np.any(np.array(v, kind))}
    parent, n, ids = {i: i for i in one}, dict.fromkeys(one, 0), sorted(ok)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[:k]:
            if one[a][1] == one[b][1] and len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] / np.linalg.norm(ok[a]) / np.linalg.norm(ok[b]) >= threshold:
                n[a] += 1
                n[b] += 1
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return sorted((name[i], n[i], name[find(i)], name[find(i)] == name[i]) for i in one)


def table(spark, rows, kind="float"):
    return spark.createDataFrame([(*r, 1, 2, "x") for r in rows], f"vec_id long, embedding array<{kind}>, label int, node long, h1 int, cos string").repartition(3)


def run(spark, rows, kind="float", **options):
    got = nn.near_duplicates(table(spark, rows, kind), **options).collect()
    assert all(r.n_links == 0 and r.component_id is None and not r.kept for r in got if r.vec_id is None)
    assert sum(r.vec_id is None for r in got) == sum(r[0] is None for r in rows)
    return sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got if r.vec_id is not None)


def near(rng, v, eps):
    return (v + rng.normal(size=len(v)) * eps).astype(np.float32).tolist()


def test_links_and_components_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    rows, k = [], 0
    for g in range(120):
        c = rng.normal(size=16)
        for _ in range(int(rng.choice([1, 1, 1, 2, 5]))):
            rows.append((k := k + 1, near(rng, c, 0.1), int(g % 3)))
    c = rng.normal(size=16)
    rows += [(1000 + i, near(rng, c, 0.12), 1) for i in range(150)]  # larger than any list
    rows += [(2000 + i, rows[0][1], rows[0][2]) for i in range(80)]  # one vector, many copies
    assert run(spark, rows) == brute(rows)


def test_lists_that_are_too_short_still_give_the_cluster(spark):
    rng = np.random.default_rng(2)
    c = rng.normal(size=8)
    rows = [(i, near(rng, c, 0.02), 1) for i in range(300)] + [(1000 + i, near(rng, rng.normal(size=8), 1), 1) for i in range(100)]
    p = nn.Search(k=3, trees=1, leaf=16, leaf_most=24, block=16, tile=50)
    assert run(spark, rows, p=p) == brute(rows)


def test_hard_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None, 1), (2, [], 1), (3, [0.0, 0.0], 1), (4, [1.0, None], 1), (5, [nan, 1.0], 1), (6, [inf, 1.0], 1), (7, [1.0, 0.0], None), (8, [1.0, 0.0], 1),
            (9, [2.0, 0.0], 1), (10, [1.0, 0.0], 2), (11, [1.0, 0.0, 0.0], 1), (12, [-1.0, 0.0], 1), (8, [1.0, 0.0], 1), (9, [0.0, 3.0], 1)]
    assert run(spark, rows + [(None, [1.0, 0.0], 1)]) == brute(rows)
    assert run(spark, []) == [] and run(spark, rows[:1]) == [(1, 0, 1, True)]


def test_rows_that_repeat_an_id_are_vectors_of_their_own(spark):
    rng = np.random.default_rng(5)
    a, b, c = rng.normal(size=(3, 8))
    rows = [(5, near(rng, a, 0.01), 1), (5, near(rng, b, 0.01), 1), (5, near(rng, b, 0.01), 1), (7, near(rng, a, 0.01), 1), (3, near(rng, b, 0.01), 1),
            (9, near(rng, c, 0.01), 1), (9, near(rng, c, 0.01), 2), (4, near(rng, a, 0.01), 1)]
    rows += [rows[0], rows[1], rows[5]]
    assert run(spark, rows) == brute(rows)


def test_doubles_keep_their_digits(spark):
    x = 0.9799999999
    rows = [(1, [1.0, 0.0], 1), (2, [x, (1 - x * x) ** 0.5], 1), (3, [1.0, 1e-12], 1), (4, [1.0, 0.0], 1)]
    assert run(spark, rows, kind="double") == brute(rows, kind=float) and brute(rows, kind=float)[1][1] == 0


def test_labels_that_the_search_fails_are_compared_in_full(spark):
    rng = np.random.default_rng(6)
    rows, k = [], 0
    for g in range(40):
        c = rng.normal(size=8)
        rows += [(k := k + 1, near(rng, c, 0.04), g % 2) for _ in range(4)]
    p = nn.Search(k=1, trees=1, leaf=2, leaf_most=2, rounds=0, block=2, tile=9, restarts=0)
    nodes = nn.nodes_of(nn._keyed(table(spark, rows).select("vec_id", "embedding", "label")))
    found = {tuple(sorted(r)) for r in nn.neighbour_lists(nodes, p, 0.98, 11)[1].collect()}
    assert len(found) < sum(r[1] for r in brute(rows)) / 4  # the search alone would lose links
    assert run(spark, rows, p=p) == brute(rows)


@pytest.mark.parametrize("seed", [3])
def test_audit_sees_missing_links(spark, seed):
    rng = random.Random(seed)
    rows = [(i, [rng.random(), 1.0], 1) for i in range(20)]
    nodes = nn.nodes_of(nn._keyed(table(spark, rows).select("vec_id", "embedding", "label")))
    none = spark.createDataFrame([], "node long, links long")
    true, got, missed = nn.audit(nodes, none, nn.Search(), 0.98)
    assert true == sum(r[1] for r in brute(rows)) and got == 0 and len(missed) == 1
