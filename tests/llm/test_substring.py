import random
from collections import defaultdict

import numpy as np
import pytest
from cases import HARD, docs

from chatloom.llm import blocks, substring


def brute(rows, min_words, window=8):
    """Repeated passages by plain windows of words over whole texts: (doc_id, start, end, n_words)."""
    owner, cut = {}, []
    for doc_id, text in rows:
        raw = (text or "").encode()
        words = [m.span() for m in substring._WORD.finditer(raw)]
        win = [tuple(raw[a:b] for a, b in words[i:i + window]) for i in range(len(words) - window + 1)]
        cut.append((doc_id, raw, words, win))
        for w in win:
            owner[w] = min(owner.get(w, 1 << 62), 1 << 62 if doc_id is None else doc_id)
    out = set()
    for doc_id, raw, words, win in cut:
        at = [i for i, w in enumerate(win) if owner[w] != (1 << 62 if doc_id is None else doc_id)]
        covered = sorted({j for i in at for j in range(i, i + window)})
        runs = np.split(covered, np.flatnonzero(np.diff(covered) != 1) + 1) if covered else []
        for run in runs:
            if len(run) >= min_words:
                out.add((doc_id, len(raw[:words[run[0]][0]].decode()), len(raw[:words[run[-1]][1]].decode()), len(run)))
    return out


def planted(seed, n=60):
    """Unique prose with passages of 51 to 80 words that several documents share at any place, and short shared lines."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeéfghi") for _ in range(rng.randint(1, 9)))
    passages = [[word() for _ in range(rng.randint(51, 80))] for _ in range(6)]
    rows, holders = [], defaultdict(list)
    for i in range(n):
        words = [word() + rng.choice(["", "", ".\n"]) for _ in range(rng.randint(20, 300))]
        if rng.random() < 0.5:
            k = rng.randrange(6)
            at = rng.randint(0, len(words))
            words[at:at] = passages[k]
            holders[k].append(100 + i)
        rows.append((100 + i, " ".join(words) + "\nAll of this is a short line that many documents share."))
    return rows, passages, holders


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_passages_equal_brute_force(spark, seed):
    rows, _, holders = planted(seed)
    rows += [(500, rows[0][1]), (None, rows[1][1]), (501, rows[2][1][7:])] + HARD
    got = substring.passages(docs(spark, rows)).collect()
    assert {(r.doc_id, r.start, r.end, r.n_words) for r in got} == brute(rows, 45)
    assert all(any(i == r.doc_id and (t or "")[r.start:r.end] == r.passage for i, t in rows) for r in got)
    first = {k: min(ids) for k, ids in holders.items()}
    assert {d for k, ids in holders.items() for d in ids if d != first[k]} <= {r.doc_id for r in got}


def test_removal_keeps_one_and_clean_documents(spark):
    rows, passages, holders = planted(7)
    frame = docs(spark, rows + [(900, " ".join(passages[0]))] + HARD)
    out = substring.remove_passages(frame)
    assert out.columns == frame.columns
    got = {r.doc_id: r for r in out.collect()}
    text = dict(rows)
    touched = {i for ids in holders.values() for i in ids if i != min(ids)}
    for i, t in rows:
        if i not in touched:
            assert got[i].text == t and got[i].n_chars == len(t)
    for k, ids in holders.items():
        body = " ".join(passages[k])
        for i in ids:
            assert (body in got[i].text) == (i == min(ids)) and len(got[i].text) <= len(text[i])
            assert got[i].n_chars == len(got[i].text)
    assert 900 not in got  # nothing of it was left
    assert got[1].text is None and got[2].text == ""


def test_cuts_follow_the_bytes(spark):
    rng = random.Random(3)
    raw = "".join(rng.choice("abcdefé日 ") for _ in range(4000)).encode()
    c = substring.cuts(raw)
    assert c[0] == 0 and c[-1] == len(raw) and (np.diff(c) > 0).all() and np.diff(c).max() <= 128
    for a, b in zip(c, c[1:]):
        raw[a:b].decode()
    shifted = substring.cuts(b"inserted " + raw) - 9
    assert len(set(c) & set(shifted)) > 0.9 * len(c)
    assert substring.cuts(b"").tolist() == [0] and substring.cuts(b"ab").tolist() == [0, 2]
    assert np.diff(substring.cuts(b"a" * 1000)).max() <= 128


WORDS = {
    "short": lambda rng: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 3))),
    "numbers": lambda rng: str(rng.randrange(100)),
    "letters": lambda rng: rng.choice("abcdefghijklmnopqrstuvwxyz"),
    "wide": lambda rng: "".join(rng.choice("日本語éa") for _ in range(rng.randint(1, 3))),
}


@pytest.mark.parametrize("kind", WORDS)
def test_every_passage_of_short_words_is_found(spark, kind):
    """Passages of exactly 45 words between different surroundings, their words parted otherwise in the copy."""
    rng = random.Random(21)
    rows, want = [], set()
    for i in range(400):
        passage = [WORDS[kind](rng) for _ in range(45)]
        for doc_id in (i, 1000 + i):
            before, after = ([f"{side}{doc_id}x{rng.randrange(10**6)}" for _ in range(rng.randint(1, 30))] for side in "ba")
            body = " ".join(passage) if doc_id < 1000 else "".join(w + rng.choice([" ", "\n", "  "]) for w in passage).strip()
            rows.append((doc_id, " ".join(before) + " " + body + " " + " ".join(after)))
            if doc_id >= 1000:
                start = len(" ".join(before)) + 1
                want.add((doc_id, start, start + len(body), 45, i))
    got = substring.passages(docs(spark, rows)).collect()
    assert {(r.doc_id, r.start, r.end, r.n_words, r.first_doc_id) for r in got} == want


@pytest.mark.parametrize("min_words", [8, 9, 20, 45, 60])
def test_passages_share_a_digest(min_words):
    rng = random.Random(min_words)
    for _ in range(1500):
        words = " ".join(WORDS[rng.choice(["letters", "numbers", "short", "wide"])](rng) for _ in range(min_words)).encode()
        found = []
        for _ in range(2):
            before, after = (" ".join(str(rng.random()) for _ in range(rng.randint(0, 4))) for _ in range(2))
            found.append(set(substring.digests_at_cuts(" ".join([before, words.decode(), after]).strip().encode(), min_words)[0].tolist()))
        assert found[0] & found[1]


def test_blocks_of_equal_rows(spark, tmp_dir):
    """A file that stands twice in the table, and a repeated text that fills a block of its own."""
    rows, _, _ = planted(11)
    docs(spark, rows).coalesce(1).write.parquet(f"{tmp_dir}/file")
    file = spark.read.parquet(f"{tmp_dir}/file")
    got = substring.passages(file.union(file)).collect()
    want = brute(rows, 45)
    assert want and sorted((r.doc_id, r.start, r.end, r.n_words) for r in got) == sorted([*want, *want])
    once = {r.doc_id: r.text for r in substring.remove_passages(file).collect()}
    twice = substring.remove_passages(file.union(file)).collect()
    assert len(twice) == 2 * len(once) and all(once[r.doc_id] == r.text for r in twice)

    rng = random.Random(12)
    long = " ".join("%09d" % rng.randrange(10**9) for _ in range(900_000))
    assert len(long) > blocks.BLOCK_BYTES
    table = docs(spark, [(1, long), (2, long), (2, long), (None, long), (None, long)])
    got = substring.passages(table).collect()
    assert sorted((r.doc_id or 0, r.start, r.end, r.n_words, r.first_doc_id) for r in got) == [(i, 0, len(long), 900_000, 1) for i in (0, 0, 2, 2)]
    assert [r.doc_id for r in substring.remove_passages(table).collect()] == [1]


def test_empty_table(spark):
    assert substring.passages(docs(spark, [])).count() == 0
    assert substring.remove_passages(docs(spark, [])).count() == 0
