import math
import random
import re

import pytest
from cases import HARD, docs

from chatloom.llm import license_scan as ls
from chatloom.llm.util import plain_words


def test_words_are_those_of_the_pattern():
    text = "".join(map(chr, range(400))) + " MIT-License 2.0 Él"
    lower = re.sub("[A-Z]", lambda m: m.group().lower(), text)
    assert [w.decode() for w in plain_words(text)] == re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def brute_blocks(words, templates):
    """Template labels of which any window reaches the threshold; and all phrase places."""
    labels, places = set(), []
    for t in templates:
        if t.phrase:
            at = [i for i in range(len(words)) if tuple(words[i:i + len(t.phrase)]) == t.phrase]
            places += at
            labels |= {t.label} if at else set()
        elif any(t.must <= set(words[i:i + t.width]) and len(set(words[i:i + t.width]) & set(t.tokens)) >= t.need for i in range(max(1, len(words) - t.width + 1))):
            labels.add(t.label)
    return sorted(labels), sorted(places)


def test_filters_lose_no_block(spark):
    rng = random.Random(2)
    notices = [plain_words(n[1]) for n in ls.NOTICES] + [plain_words(t) for t, _ in ls.BASE_PHRASES]
    rows = list(HARD)
    for i in range(300):
        words = [b"filler%d" % rng.randint(0, 50) for _ in range(rng.randint(0, 40))]
        for _ in range(rng.randint(0, 2)):
            piece = [w for w in rng.choice(notices) if rng.random() > rng.choice([0, 0.1, 0.25, 0.5])]
            if rng.random() < 0.3:
                rng.shuffle(piece)
            words[(at := rng.randint(0, len(words))):at] = piece
        rows.append((1000 + i, b" ".join(words).decode()))
    got = {r.doc_id: r for r in ls.license_scan(docs(spark, rows)).collect()}
    templates = ls.order_templates(ls.NOTICES, ls.BASE_PHRASES, 0.8, {})
    found = 0
    for doc_id, text in rows:
        words, r = plain_words(text), got[doc_id]
        labels, places = brute_blocks(words, templates)
        assert r.labels == ",".join(labels) and r.n_words == len(words)
        assert (r.n_base, r.first_word, r.last_word) == (len(places), min(places, default=None), max(places, default=None))
        assert 0 <= r.score <= 1 and (r.score == 1.0 if places else True) and (r.score > 0) == bool(labels)
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
        for b in r.blocks:
            inside = max(len(set(words[b["first"]:b["last"] + 1]) & set(t.tokens)) / len(t.tokens) for t in templates if t.label == b["label"])
            assert inside >= b["containment"] - 1e-9 >= 0.8 - 1e-9
        found += len(r.blocks)
    assert found > 100


def test_templates_need_the_rounded_up_share():
    for t in ls.order_templates(ls.NOTICES, ls.BASE_PHRASES, 0.8, {}):
        assert t.need == (len(t.tokens) if t.phrase else math.ceil(0.8 * len(t.tokens) - 1e-9))


def test_the_word_that_names_a_license_must_stand(spark):
    want = {"Released under the Apache License": "apache", "Licensed under CC BY-SA 4.0": "cc-by-sa", "Licensed under CC BY 4.0": "",
            "Licensed under CC BY-NC 4.0": "cc-by-nc", "Licensed under CC BY-NC-SA 4.0": "cc-by-nc,cc-by-sa",
            "the license was released by the committee under rain": "", "Released under MIT License": "mit", "released under an MIT-style license, the usual": "mit",
            "This work is licensed under a Creative Commons Attribution 4.0 International License": "",
            "This Source Code Form is subject to the terms of the Eclipse Public License, v. 2.0": ""}
    rows = list(enumerate(want))
    got = {r.doc_id: r.labels for r in ls.license_scan(docs(spark, rows)).collect()}
    assert {t: got[i] for i, t in rows} == want


def test_words_that_must_stand_are_of_the_notice(spark):
    with pytest.raises(ValueError):
        ls.license_scan(docs(spark, []), notices=[("x", "some notice", "other")])


@pytest.mark.parametrize("threshold", [0, 1.5])
def test_threshold_is_checked(spark, threshold):
    with pytest.raises(ValueError):
        ls.license_scan(docs(spark, []), threshold=threshold)


def test_empty_table(spark):
    assert ls.license_scan(docs(spark, [])).count() == 0
