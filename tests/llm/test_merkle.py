import random
import zlib
from hashlib import sha256

import pytest
from cases import HARD, docs
from pyspark.sql import functions as F

from chatloom.llm import merkle


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, text):
    coded = ["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row.doc_id, row.source, row.lang, row.n_chars, text)]
    return h(*coded)


def climb(nodes, fanout):
    """The root of `nodes`, and each node's (place, run's digests) up to it."""
    ways, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, k in enumerate(at):
            start = k // fanout * fanout
            ways[i].append((k - start, nodes[start:start + fanout]))
            at[i] = k // fanout
        nodes = [h(*nodes[i:i + fanout]) for i in range(0, len(nodes), fanout)]
    return nodes[0], ways


def plain(rows, fanout=16):
    by_source, out = {}, []
    for r in rows:
        by_source.setdefault(r.source, []).append((r.doc_id is not None, r.doc_id or 0, leaf_of(r, r.text), r))
    sources = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = [climb([x[2] for x in sorted(by_source[s], key=lambda x: x[:3])], fanout) for s in sources]
    root, tops = climb([t[0] for t in trees], fanout)
    for s, (subroot, ways), top in zip(sources, trees, tops):
        for (_, _, leaf, r), way in zip(sorted(by_source[s], key=lambda x: x[:3]), ways):
            steps = way + top
            siblings = [d for at, run in steps for i, d in enumerate(run) if i != at]
            changed = r.text
            if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and r.text is not None:
                changed = "".join(c.lower() if c.isascii() else c for c in r.text)
            up = leaf_of(r, changed)
            for at, run in steps:
                up = h(*run[:at], up, *run[at + 1:])
            out.append((r.doc_id, leaf, subroot, root, h(*siblings), up, up == root))
    return out


def found(table, fanout=16):
    rows = merkle.verify(merkle.prove(merkle.leaves(table, F.crc32(F.col("doc_id").cast("string")) % 5 == 0), fanout))
    return [tuple(r) for r in rows.collect()]


def key(row):
    return tuple((v is not None, v) for v in row)


def corpus(n, sources, seed):
    rng = random.Random(seed)
    return [(i, rng.choice(["Plain words", "no capitals", "ÉÀ İ ß", ""]) + str(i), rng.choice(sources)) for i in range(n)]


@pytest.mark.parametrize("fanout", [16, 2, 3])
def test_equals_the_plain_tree(spark, fanout):
    hot = ["hot"] * 8 + ["b", "é", "a", None]
    table = docs(spark, corpus(420, hot, 1) + [(1000, "one of its kind", "single")] + [(1001, "same", "b")] * 20)
    assert sorted(found(table, fanout), key=key) == sorted(plain(table.collect(), fanout), key=key)


def test_many_sources_and_deep_trees(spark):
    table = docs(spark, corpus(900, [f"s{i}" for i in range(290)], 2) + corpus(300, ["deep"], 3))
    assert sorted(found(table), key=key) == sorted(plain(table.collect()), key=key)
    assert sorted(found(table, 2), key=key) == sorted(plain(table.collect(), 2), key=key)


def test_jumps_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(merkle, "BROADCAST_BYTES", 0)
    table = docs(spark, corpus(300, ["a", "b", "b", "b"], 4))
    assert sorted(found(table, 2), key=key) == sorted(plain(table.collect(), 2), key=key)


def test_tampering_is_found(spark):
    rows = found(docs(spark, corpus(200, ["a", "b"], 5)))
    hit = {i for i in range(200) if zlib.crc32(str(i).encode()) % 5 == 0}
    texts = {i: t for i, t, _ in corpus(200, ["a", "b"], 5)}
    changed = {i for i in hit if any("A" <= c <= "Z" for c in texts[i])}
    assert changed and {r[0] for r in rows if not r[6]} == changed


def test_hard_rows_and_ties(spark):
    table = docs(spark, HARD + [(4, "word " * 5000)] * 30 + [(None, None, None)] * 3)
    assert sorted(found(table), key=key) == sorted(plain(table.collect()), key=key)


def test_one_row_one_source_and_none(spark):
    for rows in ([(1, "A")], [(1, "A"), (2, "B")], [(1, "A", "x"), (2, "B", "y")], [(None, None, None)]):
        table = docs(spark, rows)
        assert sorted(found(table), key=key) == sorted(plain(table.collect()), key=key)
    empty = merkle.verify(merkle.prove(merkle.leaves(docs(spark, []))))
    assert empty.count() == 0 and empty.columns[-1] == "verified"
    with pytest.raises(ValueError):
        merkle.prove(merkle.leaves(docs(spark, [(1, "a")])), 1)
