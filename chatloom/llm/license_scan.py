"""License scans: an exact set-similarity join of text blocks against license templates.

A *block* of a template is a window of consecutive words, 1.25 times as wide as the template
text; it matches when it holds at least `threshold` of the template's distinct tokens. The
tokens of all templates are ordered by their frequency over the whole corpus (one aggregation;
the templates are fixed, so the table is small). A matching block must then hold one of the
template's rarest `|T| - need + 1` tokens (prefix filter), the text must hold `need` of its
tokens at all (length filter), and so must the surroundings of that place (positional filter).
Only what is left is counted, so every matching block is found and most texts end at the
prefix test. The templates travel with the tasks; documents are never shuffled.

A notice names the words without which no block is an instance of it (`mit`, `nc`), so that the
word that tells two licenses apart is never the one that may be missing.

Base phrases are templates whose words must all stand, consecutively.

Defined cases: null and empty texts have no words and no matches; repeated rows are scanned
each; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatloom.llm.util import map_batches, only, plain_words

# Phrases of the scan's contract, and wordings of public license notices (label, text, words that must stand).
BASE_PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
NOTICES = (
    ("mit", "Released under the MIT License", "mit"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files, to deal in the Software without restriction, including without limitation the rights to use, "
            "copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software", "sublicense"),
    ("apache", "Licensed under the Apache License, Version 2.0", "apache"),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at "
               "http://www.apache.org/licenses/LICENSE-2.0", "apache"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3", "gnu general public"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
            "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
            "later version", "gnu general public"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0", "cc by nc"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0", "cc by sa"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "commons sharealike"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
            "following conditions are met", "redistribution"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "mozilla"),
    ("unlicense", "This is free and unencumbered software released into the public domain", "unencumbered"),
)


@dataclass(frozen=True)
class Template:
    """tokens: distinct, rarest first. need: how many a block must hold. width: words of a block. must: tokens that every block holds."""

    label: str
    tokens: tuple[bytes, ...]
    need: int
    width: int
    phrase: tuple[bytes, ...] = ()
    must: frozenset[bytes] = frozenset()

    @property
    def prefix(self) -> tuple[bytes, ...]:
        return self.tokens[: len(self.tokens) - self.need + 1]


def token_counts(docs: DataFrame, tokens: frozenset[bytes]) -> dict[bytes, int]:
    """How often each of `tokens` stands in the corpus; at most len(tokens) rows reach the driver."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n: Counter = Counter()
        for text in batch.column(0).to_pylist():
            n.update(w for w in plain_words(text) if w in tokens)
        return pa.RecordBatch.from_arrays([pa.array(list(n), pa.binary()), pa.array(list(n.values()), pa.int64())], names=["token", "n"])

    counted = map_batches(only(docs, "text"), run, "token binary, n long")
    return {bytes(r["token"]): r["n"] for r in counted.groupBy("token").agg(F.sum("n").alias("n")).collect()}


def order_templates(notices, phrases, threshold: float, counts: dict[bytes, int]) -> list[Template]:
    rarest = lambda ws: tuple(sorted(set(ws), key=lambda w: (counts.get(w, 0), w)))
    out = []
    for label, text, *named in notices:
        words, must = plain_words(text), frozenset(plain_words(" ".join(named)))
        if not must.issubset(words):
            raise ValueError(f"words that must stand are not in the notice {text!r}")
        tokens = rarest(words)
        out.append(Template(label, tokens, math.ceil(threshold * len(tokens) - 1e-9), math.ceil(1.25 * len(words)), must=must))
    for text, label in phrases:
        words = tuple(plain_words(text))
        tokens = rarest(words)
        out.append(Template(label, tokens, len(tokens), len(words), words))
    return out


def find_blocks(words: list[bytes], templates: list[Template], prefixes: frozenset[bytes]) -> list[tuple]:
    """(template index, first word, last word, containment) of every run of matching blocks, and of every phrase place."""
    if not (hits := prefixes.intersection(words)):
        return []
    active = [(k, t) for k, t in enumerate(templates) if not hits.isdisjoint(t.prefix)]
    present = set(words)
    active = [(k, t) for k, t in active if t.must <= present and sum(w in present for w in t.tokens) >= t.need]
    if not active:
        return []
    wanted = {w for _, t in active for w in t.tokens}
    places: dict[bytes, list[int]] = {}
    for i, w in enumerate(words):
        if w in wanted:
            places.setdefault(w, []).append(i)
    found = []
    for k, t in active:
        if t.phrase:
            rare = t.tokens[0]
            starts = {i - j for j, w in enumerate(t.phrase) if w == rare for i in places[rare]}
            found += [(k, s, s + len(t.phrase) - 1, 1.0) for s in sorted(starts) if s >= 0 and tuple(words[s:s + len(t.phrase)]) == t.phrase]
            continue
        at = sorted((i, w) for w in t.tokens for i in places.get(w, ()))
        index = [i for i, _ in at]
        anchors = sorted(i for w in t.prefix for i in places.get(w, ()))
        spans: list[list] = []
        done = -1  # occurrences up to here were ends of a tried block
        for p in anchors:
            lo, hi = bisect_left(index, p - t.width + 1), bisect_right(index, p + t.width - 1)
            if hi - lo < t.need:  # positional filter
                continue
            inside: Counter = Counter()
            left = lo
            for right in range(lo, hi):
                inside[at[right][1]] += 1
                while index[right] - index[left] >= t.width:
                    w = at[left][1]
                    inside[w] -= 1
                    if not inside[w]:
                        del inside[w]
                    left += 1
                if len(inside) >= t.need and right > done and t.must <= inside.keys():
                    share = len(inside) / len(t.tokens)
                    if spans and index[left] <= spans[-1][1]:
                        spans[-1][1], spans[-1][2] = index[right], max(spans[-1][2], share)
                    else:
                        spans.append([index[left], index[right], share])
            done = max(done, hi - 1)
        found += [(k, *s) for s in spans]
    return found


def license_scan(docs: DataFrame, notices=NOTICES, phrases=BASE_PHRASES, threshold: float = 0.8) -> DataFrame:
    """Per document: words, base phrase places, labels, best containment and the matching blocks.

    notices: (label, text) or (label, text, words of it that every match must hold).
    `base_labels` and `labels` are empty strings where nothing matches; `score` is the best
    containment of a match, 1 for a base phrase and 0 without a match.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be in (0, 1]")
    tokens = frozenset(w for text in [n[1] for n in notices] + [t for t, _ in phrases] for w in plain_words(text))
    templates = order_templates(notices, phrases, threshold, token_counts(docs, tokens))
    prefixes = frozenset(w for t in templates for w in t.prefix)
    first_phrase = len(templates) - len(phrases)

    def scan(text):
        words = plain_words(text)
        found = find_blocks(words, templates, prefixes)
        starts = [s for k, s, _, _ in found if k >= first_phrase]
        label = lambda hits: ",".join(sorted({templates[h[0]].label for h in hits}))
        return (len(words), len(starts), min(starts, default=None), max(starts, default=None),
                label([h for h in found if h[0] >= first_phrase]), label(found), max((h[3] for h in found), default=0.0),
                [{"label": templates[k].label, "first": a, "last": b, "containment": c} for k, a, b, c in sorted(found, key=lambda h: (h[1], h[0]))])

    block = pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("containment", pa.float64())])
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(block)]
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "blocks"]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [scan(t) for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))], names=["doc_id", *names])

    return map_batches(only(docs, "doc_id", "text"), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, n_base long, "
                       "first_word long, last_word long, base_labels string, labels string, score double, "
                       "blocks array<struct<label: string, first: long, last: long, containment: double>>")
