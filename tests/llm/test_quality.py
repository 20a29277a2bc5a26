import random
from collections import Counter

import pytest
from cases import HARD, docs

from chatloom.llm import quality


def base(text):
    """The contract's counts, by plain definitions."""
    import re

    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [ln for ln in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", ln)]
    win = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    covered = {j for i in range(len(words) - 2) if win[tuple(words[i:i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))


def texts():
    rng = random.Random(4)
    return ["".join(rng.choice(["a ", "b ", "c ", "é", "|", "\n", "a b c ", "#", "."]) for _ in range(rng.randint(0, 200))) for _ in range(120)]


def test_counts_equal_plain_definitions(spark):
    rows = HARD + [(100 + i, t) for i, t in enumerate(texts())]
    got = quality.quality_report(docs(spark, rows)).collect()
    want = Counter((i, *base(t)) for i, t in rows)
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    for r in got:
        failed = r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words
        assert r.base_failed == failed and not (failed and r.kept)


def test_lines_go_and_clean_texts_stay(spark):
    prose = "\n".join(" ".join(f"word{i}x{j}" for j in range(8)) + "." for i in range(12))
    menu = "Home | News | Sport | Weather | Contact"
    rows = [(1, prose), (2, prose + "\n" + menu + "\nAll rights reserved."), (3, "\n".join([menu + f" {i}" for i in range(30)])), (4, prose.replace(" ", "### "))]
    got = {r.doc_id: r for r in quality.clean_documents(docs(spark, rows)).collect()}
    assert set(got) == {1, 2}
    assert got[1].text == got[2].text == prose and got[2].n_chars == len(prose)
    assert got[1].digest == "d" and got[1].Text2 == "t"


@pytest.mark.parametrize("mark", ["-", "/", "*", ">", "|", "·"])
def test_separators_in_long_lines_are_no_navigation(spark, mark):
    words = [f"word{i}" for i in range(79)]
    for at in (60, 45, 30, 15):
        words.insert(at, mark)
    line = " ".join(words) + "."
    paragraphs = "\n".join(line.replace("word", f"w{k}x") for k in range(3))
    rows = [(1, line), (2, paragraphs), (3, "\n".join([line, f"Home {mark} Latest news {mark} All about us {mark} Contact", f" {mark} ".join("abcdefghijklmnop")]))]
    got = {r.doc_id: r.text for r in quality.clean_documents(docs(spark, rows)).collect()}
    assert got == {1: line, 2: paragraphs, 3: line}


def test_lists_headings_and_program_text_stay(spark):
    prose = "\n".join(" ".join(f"word{i}x{j}" for j in range(8)) + "." for i in range(3))
    shopping = prose + "\n" + "\n".join(f"- buy milk{i}" for i in range(30)) + "\n" + "\n".join(f"{i}. wash dish{i}" for i in range(9))
    heads = "\n\n".join(f"Chapter number {i}\n" + prose.replace("word", f"w{i}y") for i in range(5))
    code = "\n".join(f"def area{i}(width, height, depth, unit{i}):\n    total{i} = width{i} * height{i} + depth{i} - unit{i}\n    return total" for i in range(8))
    rows = [(1, shopping), (2, heads), (3, code)]
    assert {r.doc_id: r.text for r in quality.clean_documents(docs(spark, rows)).collect()} == dict(rows)


@pytest.mark.parametrize("menu", [["Главное меню", "Новый лист", "Новый дом", "О нас"], ["Menü", "Über uns", "Menü zu", "Startseite neu"], ["Home", "About us", "Contact"]])
def test_runs_of_short_lines_go_in_any_script(spark, menu):
    prose = "\n".join(" ".join(f"word{i}x{j}" for j in range(8)) + "." for i in range(12))
    ends = "Ende…\n终。\n«да»\n”"
    got = quality.clean_documents(docs(spark, [(1, prose + "\n" + "\n\n".join(menu)), (2, prose + "\n" + ends), (3, prose + "\n" + "\n".join(menu[:2]))])).collect()
    assert {r.doc_id: r.text.rstrip() for r in got} == {1: prose, 2: prose + "\n" + ends, 3: prose + "\n" + "\n".join(menu[:2])}


@pytest.mark.parametrize("rows", [[], HARD])
def test_empty_and_hard_tables(spark, rows):
    table = docs(spark, rows)
    assert quality.quality_report(table).count() == len(rows)
    assert quality.clean_documents(table).columns == table.columns
    assert quality.clean_documents(table).count() == 0
