import os
import random

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from chatloom.operators import dedup
from conftest import samples_df


def _texts(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "ord long, text string")


def _kept(spark, texts, t=0.85, mode="exact", verify=True):
    df = _texts(spark, texts)
    return sorted(r["ord"] for r in dedup.near_dedup(df, t, mode, text=F.col("text"), verify=verify).collect())


def _jac(a, b):
    return len(a & b) / len(a | b)


def sequential_keep_first(texts, t):
    """Plain sequential keep-first over exact Jaccard (the behaviour to match)."""
    kept, sets = [], []
    for i, x in enumerate(texts):
        s = set(x.lower().split())
        if s and any(_jac(s, k) >= t for k in sets if k):
            continue
        kept.append(i)
        sets.append(s)
    return kept


def test_chain_keeps_a_and_c(spark):
    base = [f"w{i}" for i in range(20)]
    a = " ".join(base)
    b = " ".join(base[:19] + ["x1"])               # J(a,b) = 19/21 ≥ 0.85
    c = " ".join(base[:18] + ["x1", "x2"])          # J(b,c) = 19/21, J(a,c) = 18/22 < 0.85
    assert _kept(spark, [a, b, c]) == [0, 2]


def test_empty_token_sets_are_kept(spark):
    assert _kept(spark, ["", "   ", "a b c", "a b c"]) == [0, 1, 2]


def test_same_text_other_role_is_not_exact_dup(spark):
    df = samples_df(spark, [(0, [("user", "q"), ("assistant", "same answer")]),
                            (1, [("user", "q"), ("system", "same answer")])])
    assert dedup.exact_dedup(df).count() == 2


def test_threshold_validation(spark):
    df = _texts(spark, ["a"])
    for t in (0, 1.1):
        with pytest.raises(ValueError):
            dedup.near_dedup(df, t, text=F.col("text"))
    assert _kept(spark, ["a b", "a b", "a b c"], t=1.0) == [0, 2]


def test_exact_dedup_hot_key(spark):
    rows = [(i, [("user", "q"), ("assistant", "same" if i % 3 == 0 else f"other {i}")]) for i in range(300)]
    kept = sorted(r["ord"] for r in dedup.exact_dedup(samples_df(spark, rows)).collect())
    assert kept == [0] + [i for i in range(300) if i % 3 != 0]


@settings(max_examples=6, deadline=None)
@given(st.data())
def test_exact_mode_equals_sequential(spark, data):
    vocab = [f"t{i}" for i in range(12)]
    n = data.draw(st.integers(3, 25))
    texts = [" ".join(data.draw(st.lists(st.sampled_from(vocab), min_size=0, max_size=8))) for _ in range(n)]
    t = data.draw(st.sampled_from([0.5, 0.7, 0.85, 1.0]))
    assert _kept(spark, texts, t) == sequential_keep_first(texts, t)


def test_pairs_equal_all_pairs(spark):
    rnd = random.Random(7)
    vocab = [f"v{i}" for i in range(15)]
    texts = [" ".join(rnd.sample(vocab, rnd.randint(3, 10))) for _ in range(60)]
    sets = dedup.token_sets(_texts(spark, texts), F.col("text"))
    pairs, _, members = dedup.near_dup_pairs(sets, 0.6)
    rep = {r["ord"]: r["rep"] for r in members.collect()}
    got = {(r["a"], r["b"]) for r in pairs.collect()}
    ss = [set(x.split()) for x in texts]
    reps = sorted(set(rep.values()))
    want = {(a, b) for i, a in enumerate(reps) for b in reps[i + 1:] if _jac(ss[a], ss[b]) >= 0.6}
    assert got == want


def test_lsh_mode_runs_and_drops_copies(spark):
    words = " ".join(f"w{i}" for i in range(40))
    kept = _kept(spark, [words, words + " extra", "completely different text here"], mode="lsh", verify=True)
    assert kept == [0, 2]


def test_greedy_random_graphs(spark):
    rnd = random.Random(3)
    for _ in range(5):
        n = rnd.randint(2, 30)
        edges = {(a, b) for a in range(n) for b in range(a + 1, n) if rnd.random() < 0.15}
        if not edges:
            continue
        df = spark.createDataFrame(sorted(edges), "a long, b long")
        dropped = {r["x"] for r in dedup.greedy_keep_first(df).collect()}
        kept = []
        for x in range(n):
            if not any((k, x) in edges for k in kept):
                kept.append(x)
        assert dropped == set(range(n)) - set(kept)


def test_near_copy_cluster(spark):
    rnd = random.Random(11)
    base = [f"b{i}" for i in range(60)]
    texts = []
    for i in range(40):                      # near copies: each swaps one word of the base text
        t = list(base)
        t[rnd.randrange(60)] = f"u{i}"
        texts.append(" ".join(t))
    texts += [" ".join(rnd.sample(base, 20)) + f" z{i}" for i in range(10)]
    want = sequential_keep_first(texts, 0.85)
    assert _kept(spark, texts) == want


@settings(max_examples=8, deadline=None)
@given(st.data())
def test_pair_greedy_equals_sequential(spark, data):
    vocab = [f"t{i}" for i in range(10)]
    n = data.draw(st.integers(3, 20))
    texts = [" ".join(data.draw(st.lists(st.sampled_from(vocab), min_size=0, max_size=7))) for _ in range(n)]
    sets = dedup.token_sets(_texts(spark, texts), F.col("text"))
    pairs, reps, _ = dedup.near_dup_pairs(sets, 0.7)
    dropped = {r["x"] for r in dedup.greedy_keep_first(pairs).collect()}
    assert sorted({r["rep"] for r in reps.collect()} - dropped) == sequential_keep_first(texts, 0.7)


def _verified(monkeypatch):
    """Candidate pairs of every verification, as they are asked for."""
    seen, verify = [], dedup.verify_pairs
    monkeypatch.setattr(dedup, "verify_pairs", lambda c, s, t: seen.append(c) or verify(c, s, t))
    return seen


def _near_copies(n, words, seed=6):
    rnd = random.Random(seed)
    base = [f"b{i}" for i in range(words)]
    for i in range(n):
        t = list(base)
        t[rnd.randrange(words)] = f"u{i}"
        yield " ".join(t)


def test_dissimilar_sets_that_share_tokens(spark, monkeypatch):
    """Two tokens in every set, and few others that are rare: few candidates are compared."""
    rnd = random.Random(5)
    texts = [" ".join(["shared", "common"] + [f"w{rnd.randrange(4000)}" for _ in range(rnd.randint(8, 18))]) for _ in range(2000)]
    seen = _verified(monkeypatch)
    assert _kept(spark, texts) == sequential_keep_first(texts, 0.85)
    assert sum(c.count() for c in seen) < 2_000


def test_small_vocabulary(spark, monkeypatch):
    """Every token is in a large share of all sets, so all keys are hot."""
    rnd = random.Random(15)
    texts = [" ".join(rnd.sample([f"w{i}" for i in range(60)], 20)) for _ in range(1200)]
    texts += [" ".join(rnd.sample(texts[i].split(), 19) + ["w0"]) for i in range(0, 300, 7)]
    monkeypatch.setattr(dedup, "KEY_BLOCK", 50)
    seen = _verified(monkeypatch)
    assert _kept(spark, texts) == sequential_keep_first(texts, 0.85)
    assert sum(c.count() for c in seen) < 10 * len(texts)


def test_many_near_copies_stay_linear(spark, monkeypatch):
    texts = list(_near_copies(2000, 80))
    seen = _verified(monkeypatch)
    assert _kept(spark, texts) == [0]
    assert sum(c.count() for c in seen) < 10 * len(texts)


def test_near_matches_whose_centre_comes_late(spark, monkeypatch):
    """Each is similar to a base set in the middle, but few are to each other."""
    rnd = random.Random(16)
    base = [f"b{i}" for i in range(40)]
    texts = []
    for i in range(600):
        t = rnd.sample(base, 37) + [f"u{i}a", f"u{i}b"]
        texts.append(" ".join(t))
    texts.insert(300, " ".join(base))
    seen = _verified(monkeypatch)
    assert _kept(spark, texts) == sequential_keep_first(texts, 0.85)
    assert sum(c.count() for c in seen) < 10 * len(texts)


def test_a_long_chain_is_one_pass(spark, monkeypatch):
    """Each set is similar to the next two only; streamed, nothing is decided by joins."""
    texts = [" ".join(f"t{i + k}" for k in range(25)) for i in range(1500)]
    monkeypatch.setattr(dedup, "greedy_keep_first", None)
    monkeypatch.setattr(dedup, "_keep_first_wide", None)
    got = _kept(spark, texts)
    assert got == sequential_keep_first(texts, 0.85) and len(got) == 500


def test_large_components_are_decided_by_joins(spark, monkeypatch):
    rnd = random.Random(17)
    monkeypatch.setattr(dedup, "STREAM_TOKENS", 150)
    texts = [" ".join(f"t{i + k}" for k in range(25)) for i in range(40)] + list(_near_copies(30, 40))
    texts += [" ".join(rnd.sample([f"v{i}" for i in range(12)], rnd.randint(6, 10))) for _ in range(60)]
    rnd.shuffle(texts)
    for t in (0.7, 0.85):
        assert _kept(spark, texts, t) == sequential_keep_first(texts, t)


def test_lsh_modes_equal_their_scan(spark, monkeypatch):
    rnd = random.Random(18)
    texts = list(_near_copies(25, 30)) + [" ".join(rnd.sample([f"v{i}" for i in range(14)], rnd.randint(5, 12))) for _ in range(60)] + ["", " "]
    rnd.shuffle(texts)
    reps, _ = dedup.collapse_identical_sets(dedup.token_sets(_texts(spark, texts), F.col("text")))
    keys = {r["rep"]: set(r["keys"]) for r in dedup.band_keys(reps, 0.7).collect()}
    sets = {i: set(texts[i].split()) for i in keys}
    for verify in (True, False):
        kept = []
        for i in sorted(keys):
            if not any(keys[i] & keys[k] and (not verify or sets[i] and _jac(sets[i], sets[k]) >= 0.7) for k in kept):
                kept.append(i)
        assert _kept(spark, texts, 0.7, "lsh", verify) == kept
        with monkeypatch.context() as m:
            m.setattr(dedup, "STREAM_TOKENS", 20)
            assert _kept(spark, texts, 0.7, "lsh", verify) == kept


def test_key_pairs_are_dealt_in_blocks(spark):
    rnd = random.Random(19)
    rows = sorted({(rnd.choice([1, 1, 1, 2, 3]), rnd.randrange(200)) for _ in range(300)})
    entry = spark.createDataFrame(rows, "key long, rep long")
    want = {(a, b) for k, a in rows for k2, b in rows if k == k2 and a < b}
    for block in (7, 1000):
        got = [tuple(r) for r in dedup._key_pairs(entry, F.lit(True), block).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_buckets_equal_the_pair_graph(spark):
    rnd = random.Random(8)
    for _ in range(3):
        rows = [(rnd.randrange(12), r) for r in range(40) for _ in range(rnd.randint(0, 2))]
        places = spark.createDataFrame(rows, "key long, rep long").groupBy("rep").agg(F.collect_list("key").alias("keys"))
        share = {(a, b) for k, a in rows for k2, b in rows if k == k2 and a < b}
        kept = []
        for x in sorted({r for _, r in rows}):
            if not any((k, x) in share for k in kept):
                kept.append(x)
        for bound in (None, 5):
            dropped = {r["x"] for r in dedup.bucket_keep_first(places, bound).collect()}
            assert dropped == {r for _, r in rows} - set(kept)


def test_counts_are_observed(spark):
    long = "word " * 20
    rows = [(0, [("user", "q"), ("assistant", long)]), (1, [("user", "q"), ("assistant", long)]), (2, [("user", "q"), ("assistant", "short")]),
            (3, [("user", "other"), ("assistant", " ".join(f"x{i}" for i in range(30)))])]
    for mode in ("exact", "exact_text"):
        kept, counts = dedup.dedup_and_filter(samples_df(spark, rows), mode=mode)
        assert sorted(r["ord"] for r in kept.collect()) == [0, 3] and counts == {"before": 4, "filtered": 3, "after": 2}
    assert dedup.dedup_and_filter(samples_df(spark, rows[2:3]))[1] == {"before": 1, "filtered": 0, "after": 0}


def test_counts_of_frequent_tokens_are_held_by_the_tasks(spark, monkeypatch):
    """Few, some and all tokens are frequent; stars, blocks and longer keys come early."""
    rnd = random.Random(20)
    texts = list(_near_copies(30, 40)) + [" ".join(rnd.sample([f"v{i}" for i in range(14)], rnd.randint(3, 12))) for _ in range(80)] + ["", " "]
    texts += [" ".join(["v1", "v2"] + [f"w{rnd.randrange(90)}" for _ in range(20)]) for _ in range(40)]
    rnd.shuffle(texts)
    for frequent, stars, hot, t in ((1, 2, 4, 0.6), (40, 10, 1 << 16, 0.85)):
        monkeypatch.setattr(dedup, "FREQUENT", frequent)
        monkeypatch.setattr(dedup, "STAR_KEYS", stars)
        monkeypatch.setattr(dedup, "HOT_KEYS", hot)
        assert _kept(spark, texts, t) == sequential_keep_first(texts, t)


def test_keys_of_some_hundred_entries_are_not_made_longer(spark, monkeypatch):
    """Longer keys multiply the postings; strings of tokens are not written."""
    rnd = random.Random(21)
    texts = [" ".join(rnd.sample([f"v{i}" for i in range(40)], 20)) for _ in range(300)]
    names, save = [], dedup.saved
    monkeypatch.setattr(dedup, "_longer_keys", None)
    monkeypatch.setattr(dedup, "saved", lambda df, name: names.append((name, df.dtypes)) or save(df, name))
    assert _kept(spark, texts) == sequential_keep_first(texts, 0.85)
    assert not [name for name, types in names if ("tokens", "array<string>") in types]


def test_rows_that_repeat_an_id_stay_together(spark):
    rows = [(0, " ".join(f"a{i}" for i in range(20)))] * 2 + [(1, " ".join(f"a{i}" for i in range(1, 21)))] + [(2, "other words here")] * 2
    df = spark.createDataFrame(rows, "ord long, text string")
    assert sorted(r["ord"] for r in dedup.near_dedup(df, 0.85, text=F.col("text")).collect()) == [0, 0, 2, 2]
    assert [(r["a"], r["b"]) for r in dedup.near_dup_pairs(dedup.token_sets(df, F.col("text")))[0].collect()] == [(0, 1)]


def test_shares_change_no_result(spark, monkeypatch):
    """Tokens and postings that move in small shares give the rows of one exchange."""
    rnd = random.Random(23)
    texts = list(_near_copies(12, 20)) + [" ".join(rnd.sample([f"v{i}" for i in range(14)], rnd.randint(3, 12))) for _ in range(30)] + ["", " "]
    rnd.shuffle(texts)
    for name, value in (("SHARE_TOKENS", 40), ("SHARE_POSTINGS", 40), ("TOKEN_SHARES", 2), ("POSTING_SHARES", 2), ("STAR_KEYS", 2), ("HOT_KEYS", 4), ("STREAM_TOKENS", 60)):
        monkeypatch.setattr(dedup, name, value)
    assert _kept(spark, texts, 0.6) == sequential_keep_first(texts, 0.6)
    sets = {i: set(t.lower().split()) for i, t in enumerate(texts) if t.strip()}
    pairs = dedup.near_dup_pairs(dedup.token_sets(_texts(spark, texts), F.col("text")), 0.6)[0].collect()
    first = {i: min(j for j in sets if sets[j] == sets[i]) for i in sets}
    assert sorted((r["a"], r["b"]) for r in pairs) == sorted(
        {(a, b) for a in first.values() for b in first.values() if a < b and _jac(sets[a], sets[b]) >= 0.6})


def test_dedup_leaves_one_table_of_texts(spark):
    """Pairs of ids stay; tables on the way held several times the input until the session's end."""
    from chatloom.session import checkpoint_root

    def names():
        root = checkpoint_root(spark).removeprefix("file:")
        return {n for n in os.listdir(root) if not n.startswith("chatloom-pyfiles")}

    rows = [(i, [("user", "q"), ("assistant", " ".join(f"w{j}" for j in range(i // 2, i // 2 + 30)))]) for i in range(12)]
    for mode in ("exact", "exact_text"):
        before = names()
        kept, counts = dedup.dedup_and_filter(samples_df(spark, rows), mode=mode)
        left = [n.rsplit("-", 1)[0] for n in names() - before]
        assert [n for n in left if n != "chatloom-near-met"] == ["chatloom-deduped"]
        assert kept.count() == counts["after"]
