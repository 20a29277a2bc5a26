import random
import re
from collections import Counter, defaultdict

import pytest
from cases import HARD, docs

from chatloom.llm import mixing


def n_words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def targets(sizes, share=1.5, most=2.0, weights=(5, 2, 1)):
    """Water level by plain iteration over (source → words)."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, out, open_ = share * sum(sizes.values()), {}, set(order)
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > most * sizes[s]}
        if not over:
            return out | {s: level * weight[s] for s in open_}
        for s in over:
            out[s] = most * sizes[s]
            left -= out[s]
        open_ -= over
    return out


def table(seed, n=400):
    rng = random.Random(seed)
    sources = ["b", "a", "Z", "é", "ab", None, "\U0001F600", "￮"]
    return HARD + [(100 + i, " ".join(["w"] * rng.randint(0, 60)), "a" if rng.random() < 0.33 else rng.choice(sources)) for i in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_targets_and_taken(spark, seed):
    rows = [(*r, "s")[:3] for r in table(seed)]
    units = mixing.mix(docs(spark, rows))
    got = mixing.per_row(units).collect()
    assert Counter((r.doc_id, r.source, r.size) for r in got) == Counter((i, s, n_words(t)) for i, t, s in rows)
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += n_words(t)
    goal, taken, largest = targets(sizes), defaultdict(int), defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(goal[r.source])
        assert 0 <= r.copies <= 2 and (r.size or not r.copies)
        taken[r.source] += r.copies * r.size
        largest[r.source] = max(largest[r.source], r.size)
    for s in sizes:
        assert abs(taken[s] - goal[s]) <= largest[s]
        if s != "s":
            assert abs(taken[s] - goal[s]) <= 0.05 * goal[s] + 5
    key = lambda r: (r.source or "", r.doc_id or 0, r.size, r.copies)
    again = mixing.per_row(mixing.mix(docs(spark, rows[::-1]))).collect()
    assert sorted(map(key, again)) == sorted(map(key, got))


def test_expected_copies_keep_the_ratio(spark):
    """Over many seeds every document is taken as often as its source's ratio says."""
    rows = [(i, "w " * (1 + 7 * (i % 3)), "ab"[i % 2]) for i in range(40)]
    n = Counter()
    for seed in range(12):
        for r in mixing.mix(docs(spark, rows), seed=seed).collect():
            n[r.doc_id] += r.copies / 12
            ratio = {r.source: r.target / r.source_size}
            assert int(ratio[r.source]) <= r.copies <= int(ratio[r.source]) + 1
    assert 0 < len({round(v, 3) for v in n.values()})


def test_mixed_documents(spark):
    rows = [(*r, "s")[:3] for r in table(3)]
    frame = docs(spark, rows)
    mixed = mixing.mix_documents(frame)
    assert mixed.columns == frame.columns
    got, units = Counter((r.doc_id, r.source, r.text) for r in mixed.collect()), {(r.source, r.doc_id, r.size): r for r in mixing.mix(frame).collect()}
    for (doc_id, source, text), n in Counter((i, s, t) for i, t, s in rows).items():
        unit = units[source, doc_id, n_words(text)]
        if unit.rows == 1:
            assert got[doc_id, source, text] == unit.copies
        else:
            assert got[doc_id, source, text] <= 2 * n
    plan = mixed._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


@pytest.mark.parametrize("rows", [[], [(1, None, None)], [(1, "", "a"), (2, " ", "b")], [(1, "one", "a")], [(1, "x y", "a")] * 7])
def test_small_tables(spark, rows):
    frame = docs(spark, rows)
    got = mixing.per_row(mixing.mix(frame)).collect()
    assert len(got) == len(rows) and all(r.copies <= 2 for r in got)
    assert mixing.mix_documents(frame).columns == frame.columns
    if rows[:1] == [(1, "x y", "a")]:
        assert sum(r.copies for r in got) in (10, 11)


def test_mixed_documents_depend_on_the_rows_alone(spark, monkeypatch):
    """Rows without an id and of equal size share their unit's copies, however they are partitioned."""
    rows = [(None, f"word{i % 90} one two", "a") for i in range(400)] + [(i, "some other words", "b") for i in range(50)]
    table = docs(spark, rows)
    want = Counter()
    for r in mixing.per_row(mixing.mix(table)).collect():
        want[r.doc_id] += r.copies
    seen = []
    for parts, bucket in ((1, 1 << 16), (3, 1 << 16), (7, 1 << 16), (3, 20)):
        monkeypatch.setattr(mixing, "UNIT_BUCKET", bucket)
        seen.append(Counter((r.doc_id, r.text) for r in mixing.mix_documents(table.repartition(parts)).collect()))
        got = Counter()
        for (doc_id, _), n in seen[-1].items():
            got[doc_id] += n
        assert got == +want
    assert seen[0] == seen[1] == seen[2]
