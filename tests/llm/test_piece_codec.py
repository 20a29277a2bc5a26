import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
from cases import HARD, docs

from chatloom.llm import blocks, piece_codec

PATH = public_tokenizers.path("piece_bpe_32k.model")
with open(PATH, "rb") as f:
    MODEL = f.read()
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)


def texts():
    rng = random.Random(8)
    some = ["  a  b\n c", "a▁b", " ", "▁", "a ", "a  ", " x", "<s> hi</s> <0x0A>", "\t\ta", "日本語 x 😀😀", "ﬁ é \x00z", " \n ", "　▁  "]
    return some + ["".join(rng.choice(" ▁ab \n\té日😀.<s>\x00　") for _ in range(rng.randint(0, 40))) for _ in range(400)]


def test_equals_the_library(spark):
    rows = HARD + [(100 + i, t) for i, t in enumerate(texts())]
    encoded = piece_codec.encode_decode(docs(spark, rows), MODEL)
    got = sorted((r.doc_id or 0, r.ids, r.decoded) for r in encoded.collect())
    want = sorted((i or 0, LIBRARY.encode(t or ""), LIBRARY.decode(LIBRARY.encode(t or "")) if t else "") for i, t in rows)
    assert got == want
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    digests = {r.doc_id: tuple(r)[1:] for r in piece_codec.digests(encoded).collect()}
    for i, t in rows:
        ids = LIBRARY.encode(t or "")
        assert digests[i] == (len(ids), sha(",".join(map(str, ids))), sha(LIBRARY.decode(ids) if ids else ""))


def test_many_blocks_in_a_task(spark, monkeypatch):
    rows = [(i, t) for i, t in enumerate(texts())]
    packed = blocks.pack(docs(spark, rows).select("doc_id", "text"), lambda block: [(blocks.DOCS, block)], "text", "small", block_bytes=200)
    sizes = [blocks.from_blob(bytes(r.blob)) for r in packed.collect()]
    assert sum(len(t) for t in sizes) == len(rows) and len(sizes) > 20
    assert all(len(t) == 1 or sum(len(x.encode()) + 16 for x in t["text"].to_pylist()) <= 200 for t in sizes)


@pytest.mark.parametrize("rows", [[], [(1, None), (2, "")]])
def test_no_chunks(spark, rows):
    assert [(r.ids, r.decoded) for r in piece_codec.encode_decode(docs(spark, rows), MODEL).collect()] == [([], "")] * len(rows)
