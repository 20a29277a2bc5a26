"""Line-first quality rules.

Every line of a text is judged on its own (punctuation, navigation, boilerplate); failing lines
are removed, and a document that loses too large a share of its words, or that fails the
document rules, is rejected. A document is judged alone, so there is no shuffle.

Short lines without an end mark are navigation only in a run of their kind: a heading, a line of
program text or a list item (a line that starts with a list mark) stands for itself.

Defined cases: a null or empty text has no words and is rejected; repeated rows are judged
each; an empty table gives an empty table; extra columns pass through `clean_documents`.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from chatloom.llm.util import map_batches, only, shelter, space_words

_SYMBOLS = b"#*$%&|<>"
_KEEP_ALL_BUT_SYMBOLS = bytes(range(256))
_ENDS = tuple(c.encode() for c in ".!?:;\"')]…。！？”»")
_BOILERPLATE = re.compile(
    rb"\b(?:cookie policy|privacy policy|terms of (?:use|service)|all rights reserved|click here|read more|"
    rb"sign (?:in|up)|log ?in|subscribe|enable javascript|accept (?:all )?cookies|skip to content|share on|lorem ipsum)\b")
_SEPARATORS = frozenset((b"|", b"\xc2\xbb", b">", b"\xe2\x80\xba", b"\xc2\xb7", b"\xe2\x80\xa2", b"/", b"-", b"*"))
#: Separators that also stand in prose.
_PROSE_MARKS = frozenset((b">", b"/", b"-", b"*"))
#: First words of a list item.
_LIST_MARK = re.compile(rb"(?:[-*+>]|\xc2\xb7|\xe2\x80[\x93\x94\xa2]|\(?(?:[0-9]{1,3}|[A-Za-z])[.)])\Z")


@dataclass(frozen=True)
class Rules:
    """Thresholds of the line rules and the document rules."""

    min_words: int = 50
    max_repeat_percent: int = 50
    #: Unpunctuated lines of at most so many words fail when `short_line_run` of them or more follow one another, blank lines aside.
    short_line_words: int = 4
    short_line_run: int = 3
    #: A line fails as navigation with so many separators that part it into fields of few words, or a share of so many percent of its words.
    nav_separators: int = 3
    nav_percent: int = 25
    #: Words of a field on average, at most.
    nav_field_words: int = 4
    #: In a line of more words, the separators that also stand in prose part no fields.
    nav_line_words: int = 20
    #: A line fails with more symbols than this percentage of its words.
    max_symbol_percent: int = 30
    #: A boilerplate phrase fails a line of at most so many words.
    boilerplate_words: int = 20
    #: Copies of an earlier line of the same text go, if longer than a short line.
    drop_repeated_lines: bool = True
    #: A document loses at most this percentage of its words.
    max_removed_percent: int = 40


def n_symbols(raw: bytes) -> int:
    return len(raw) - len(raw.translate(_KEEP_ALL_BUT_SYMBOLS, _SYMBOLS))


def repeat_words(words: list[bytes]) -> int:
    """Words in three-word windows that stand twice or more in the text, first places included."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(windows) == len(set(windows)):
        return 0
    twice = {w for w, n in Counter(windows).items() if n > 1}
    total = end = 0
    for i, w in enumerate(windows):
        if w in twice:
            total += i + 3 - max(i, end)
            end = i + 3
    return total


def bare_runs(split: list[list[bytes]], rules: Rules) -> set[int]:
    """Lines (by index) in runs of short lines that neither end in an end mark nor start with a list mark."""
    out, run = set(), []
    for i, ws in enumerate(split):
        if ws and (len(ws) > rules.short_line_words or ws[-1].endswith(_ENDS) or _LIST_MARK.match(ws[0])):
            run = []
        elif ws:
            run.append(i)
            if len(run) >= rules.short_line_run:
                out.update(run if len(run) == rules.short_line_run else (i,))
    return out


def line_fault(line: bytes, words: list[bytes], bare: bool, rules: Rules) -> str | None:
    """The rule that a line with words fails, or None; `bare`: it stands in a run of short lines."""
    if len(words) > 1 and _LIST_MARK.match(words[0]):
        words = words[1:]
    n = len(words)
    separators = sum(w in _SEPARATORS for w in words)
    if 100 * separators > rules.nav_percent * n:
        return "navigation"
    if separators >= rules.nav_separators:
        parting = separators if n <= rules.nav_line_words else sum(w in _SEPARATORS and w not in _PROSE_MARKS for w in words)
        if parting >= rules.nav_separators and n - separators <= rules.nav_field_words * (parting + 1):
            return "navigation"
    if n <= rules.boilerplate_words and _BOILERPLATE.search(line.lower()):
        return "boilerplate"
    if 100 * n_symbols(line) > rules.max_symbol_percent * n and n_symbols(line) > 2:
        return "punctuation"
    if bare:
        return "punctuation"
    return None


def judge(text: str | None, rules: Rules) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, removed_words, n_removed_lines, kept, cleaned)"""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    lines, seen, out = raw.split(b"\n"), set(), []
    split = [ln.split() for ln in lines]
    words = [w for ws in split for w in ws]
    n, dup, removed, gone = len(words), 0, 0, 0
    bare = bare_runs(split, rules)
    for i, (line, ws) in enumerate(zip(lines, split)):
        fault = None
        if ws:
            again = line in seen
            seen.add(line)
            dup += again
            copy = again and rules.drop_repeated_lines and len(ws) > rules.short_line_words
            fault = "repeated" if copy else line_fault(line, ws, i in bare, rules)
        if fault:
            removed += len(ws)
            gone += 1
        else:
            out.append(line)
    chars = len(b"".join(words).decode("utf-8", "surrogatepass"))
    repeats = repeat_words(words)
    base_failed = n < rules.min_words or 100 * repeats > rules.max_repeat_percent * n
    kept = not base_failed and 100 * removed <= rules.max_removed_percent * n
    cleaned = b"\n".join(out).decode("utf-8", "surrogatepass") if gone else text
    return n, chars, n_symbols(raw), dup, repeats, base_failed, removed, gone, kept, cleaned


_JUDGED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "removed_words", "removed_lines", "kept", "cleaned")
_JUDGED_SCHEMA = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
                  "removed_words long, removed_lines long, kept boolean")


def quality_report(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """One row per document: its counts, whether the document rules fail it, and the verdict."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [judge(t, rules)[:-1] for t in batch.column(1).to_pylist()]
        cols = [pa.array(c, pa.bool_() if k in ("base_failed", "kept") else pa.int64()) for k, c in zip(_JUDGED, zip(*rows))]
        return pa.RecordBatch.from_arrays([batch.column(0), *cols], names=["doc_id", *_JUDGED[:-1]])

    return map_batches(only(docs, "doc_id", "text"), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {_JUDGED_SCHEMA}")


def clean_documents(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The kept documents with their failing lines removed; same columns, n_chars follows the text."""
    own, names = shelter(docs, "text", "n_chars")
    inner = own.columns
    at, size = (own.columns.index(c) if c in own.columns else None for c in ("text", "n_chars"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [judge(t, rules)[-2:] for t in batch.column(at).to_pylist()]
        cols = list(batch.columns)
        cols[at] = pa.array([c for _, c in rows], pa.string())
        if size is not None:
            cols[size] = pa.array([len(c) for _, c in rows]).cast(cols[size].type)
        return pa.RecordBatch.from_arrays(cols, names=inner).filter(pa.array([k for k, _ in rows], pa.bool_()))

    return map_batches(own, run, own.schema).toDF(*names)
