import hashlib
import random
from collections import Counter

import pytest
from cases import HARD, docs
from test_ngram_join import brute as components
from test_piece_codec import LIBRARY
from test_substring import brute as repeated

import corpus_pipeline as cp
from chatloom.llm import mixing, quality


def corpus(seed=5):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeéghi") for _ in range(rng.randint(2, 9)))
    prose = lambda n: " ".join(word() + rng.choice(["", "", ",", "."]) for _ in range(n)) + "."
    rows, passage = [], prose(60)
    for i in range(60):
        text = "\n".join(prose(rng.randint(20, 60)) for _ in range(rng.randint(2, 4)))
        rows.append((100 + i, text, f"src{i % 4}"))
        if i % 6 == 0:
            rows.append((300 + i, text, "src0"))  # exact copy
        if i % 7 == 0:
            rows.append((400 + i, text + " tail", "src1"))  # near copy
        if i % 5 == 0:
            rows[-1] = (rows[-1][0], rows[-1][1] + "\n" + passage, rows[-1][2])
    rows += [(900, "too short", "src0"), (901, "Home | News | Sport\n" * 40, "src2"), (902, "a b c " * 100, "src3"), (100, rows[0][1], "src0")]
    return rows + [(*r, "src1") for r in HARD]


def test_stages_equal_brute_force(spark, tmp_dir):
    """Each stage is held on what its predecessor wrote."""
    rows = corpus()
    names = [n for n, _ in cp.STAGES]
    assert len(names) == 5
    frame, seen = docs(spark, rows), {}
    columns = frame.columns
    for name, stage in cp.STAGES:
        out = stage(spark, frame, "unused")
        out.write.parquet(f"{tmp_dir}/{name}")
        before, frame = frame, spark.read.parquet(f"{tmp_dir}/{name}")
        seen[name] = (before.collect(), frame.collect())
        if name != names[-1]:
            assert frame.columns == columns and dict(frame.dtypes) == dict(before.dtypes)

    before, after = seen["quality_rules"]
    judged = [(r, quality.judge(r.text, quality.Rules())) for r in before]
    assert Counter((r.doc_id, j[-1]) for r, j in judged if j[-2]) == Counter((r.doc_id, r.text) for r in after)
    assert not {900, 901, 902, 1, 2, 3} & {r.doc_id for r in after}
    assert {r.doc_id for r in after} >= set(range(100, 160))

    before, after = seen["near_duplicates"]
    comp = components([(r.doc_id, r.text) for r in before])
    assert Counter(r.doc_id for r in after) == Counter({c for _, _, c in comp})
    assert {r.doc_id: r.text for r in after}.items() <= {(r.doc_id, r.text) for r in before}

    before, after = seen["substring_dedup"]
    spans = repeated([(r.doc_id, r.text) for r in before], 45)
    want = {r.doc_id: r.text for r in before}
    for doc_id, a, b, _ in sorted(spans, key=lambda s: -s[1]):
        want[doc_id] = want[doc_id][:a] + want[doc_id][b:]
    want = {d: t for d, t in want.items() if t.strip()}
    assert spans and want == {r.doc_id: r.text for r in after} and all(r.n_chars == len(r.text) for r in after)

    before, after = seen["mixing"]
    units = {r.doc_id: r.copies for r in mixing.mix(spark.createDataFrame(before, spark.read.parquet(f"{tmp_dir}/substring_dedup").schema)).collect()}
    assert Counter((r.doc_id, r.text) for r in after) == Counter({(r.doc_id, r.text): units[r.doc_id] for r in before if units[r.doc_id]})

    before, after = seen["sentencepiece"]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    ids = [(r.doc_id, LIBRARY.encode(r.text)) for r in before]
    assert Counter((d, len(x), sha(",".join(map(str, x))), sha(LIBRARY.decode(x))) for d, x in ids) == Counter(tuple(r) for r in after)


def test_run_is_the_stages_in_order(spark, tmp_dir):
    docs(spark, corpus()).write.parquet(f"{tmp_dir}/documents.parquet")
    whole = Counter(tuple(r) for r in cp.run(spark, tmp_dir).collect())
    frame = spark.read.parquet(f"{tmp_dir}/documents.parquet")
    for _, stage in cp.STAGES:
        frame = stage(spark, frame, tmp_dir)
    assert whole == Counter(tuple(r) for r in frame.collect()) and whole


@pytest.mark.parametrize("rows", [[], [(1, None, None)], HARD])
def test_little_to_keep(spark, tmp_dir, rows):
    docs(spark, rows).write.parquet(f"{tmp_dir}/documents.parquet")
    assert cp.run(spark, tmp_dir).count() == 0


def test_rows_without_an_id(spark):
    text = " ".join(f"w{i}" for i in range(80))
    out = cp.near_duplicates(spark, docs(spark, [(None, text), (None, text), (None, "other " + text[::-1]), (5, text), (5, text)]), "")
    assert Counter(r.doc_id for r in out.collect()) == {None: 1, 5: 1}


def test_rows_without_a_text_stay_whole(spark):
    text = " ".join(f"w{i}" for i in range(80))
    out = cp.near_duplicates(spark, docs(spark, [(1, None, "a"), (2, None, "b"), (2, text, "c"), (3, "other " + text[::-1], "d")]), "").collect()
    assert all(r.source and r.lang == "en" and r.digest == "d" for r in out)
    assert {(2, "c"), (3, "d")} <= {(r.doc_id, r.source) for r in out} and 1 in {r.doc_id for r in out}


def test_unlike_rows_of_one_id_stay_and_like_rows_without_one_go(spark):
    words = [f"w{i}" for i in range(81)]
    near = " ".join(words[:80] + ["x"])
    rows = [(1, " ".join(f"a{i}" for i in range(80))), (1, " ".join(f"b{i}" for i in range(80))), (None, " ".join(words)), (None, near),
            (7, ""), (7, ""), (8, None), (8, None), (None, "")]
    out = Counter((r.doc_id, r.text) for r in cp.near_duplicates(spark, docs(spark, rows), "").collect())
    like = {(None, " ".join(words)), (None, near)}
    assert sum(out[k] for k in like) == 1 and out - Counter(like) == Counter(r for r in rows if r not in like)
