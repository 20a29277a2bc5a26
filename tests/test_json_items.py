import json
import random

import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from chatloom.sources import json_items, jsonl
from chatloom.sources.json_items import _effects, _pieces


def _scan(text: bytes, size: int):
    """Fragments as a line reader gives them for splits of ``size`` bytes: (blk, fragment without its end)."""
    rows, at = [], 0
    while at < len(text):
        end = text.find(b"}", at)
        end = len(text) if end < 0 else end
        # a fragment belongs to the split in which the one before it ends
        rows.append((max(0, at - 1) // size * size if at else 0, text[at:end]))
        at = end + 1
    return rows


def _items(text: bytes, size: int, batch: int = 3):
    """The module's two passes with plain prefix sums between them: (items by position, is_array, broken)."""
    rows = _scan(text, size)

    def batches(columns):
        for i in range(0, len(rows), batch):
            part = rows[i:i + batch]
            yield pa.RecordBatch.from_arrays([pa.array(["f"] * len(part)), pa.array([b for b, _ in part], pa.int64()), pa.array([t for _, t in part], pa.binary())]
                                             + [pa.array([v(b) for b, _ in part]) for v in columns], names=[f"c{k}" for k in range(3 + len(columns))])

    effects = [r for b in _effects(batches([lambda b: len(text)])) for r in b.to_pylist()]
    depth, start, states = 0, 0, {}
    for r in effects:
        states[r["blk"]] = (depth, start, r["n"])
        depth, start = depth + (r["inside"] if start else r["outside"]), (start + r["parity"]) % 2
    is_array, last = effects[0]["first"] == "[", effects[-1]["blk"]
    open_end = sum(r["bytes"] for r in effects) > len(text)
    columns = [lambda b: states[b][0], lambda b: states[b][1], lambda b: is_array, lambda b: states[b][2], lambda b: b == last, lambda b: open_end]
    found = [r for b in _pieces(batches(columns)) for r in b.to_pylist()]
    items, broken = [], any(r["i"] == json_items._BROKEN for r in found)
    for r in found:
        if r["i"] >= 0:
            items.append(r["text"])
        elif r["i"] == json_items._REST:
            if items:
                items[-1] += r["text"]
            else:  # behind an array without items
                assert broken
    return [i.decode() for i in items], is_array, broken


def _read(text: bytes, size: int):
    """The file's list, as its items say it; None for a rejected file."""
    items, is_array, broken = _items(text, size)
    try:
        values = [json.loads(i) for i in items]
    except ValueError:
        return None
    return values if is_array and not broken else None


def _plain(text: bytes):
    try:
        value = json.loads(text)
    except ValueError:
        return None
    return value if isinstance(value, list) else None


_TEXT = st.text(alphabet='a"\\{}[],: \né日', max_size=8)
_VALUE = st.recursive(st.one_of(st.none(), st.integers(-5, 5), _TEXT), lambda x: st.one_of(st.lists(x, max_size=3), st.dictionaries(_TEXT, x, max_size=3)), max_leaves=8)


@settings(max_examples=300, deadline=None)
@given(st.lists(_VALUE, max_size=6), st.integers(1, 60), st.booleans(), st.sampled_from([None, 1]))
def test_any_array_at_any_split_size(values, size, ascii_only, indent):
    text = (" " + json.dumps(values, ensure_ascii=ascii_only, indent=indent) + "\n").encode()
    assert _read(text, size) == values


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(['[', ']', '{', '}', ',', '"', '"a"', ':', '1', ' ', '\\', '\\"', '{"a":1}', '[]', '{}']), min_size=1, max_size=12), st.integers(1, 12))
def test_damaged_files_are_rejected_like_a_whole_parse(bits, size):
    text = "".join(bits).encode()
    assert _read(text, size) == _plain(text)


@pytest.mark.parametrize("text", ["[]", " [ ] ", "[{}]", '[1,"}",[2]]', '[{"a":1}] x', '[{"a":1}', '[{"a":1},]', "[,1]", '{"a":[1,{"b":2}]}', "  ", "[{]", "[{}}", "[{}]]",
                                  '"x"', '[{"a":"}]', "[{}]}", "[1 2]", "[}", "3", "[{}][{}]", "[{}{}]", '["\\\\"]', '["\\\\\\"}"]'])
def test_cases(text):
    for size in (1, 2, 3, 100):
        assert _read(text.encode(), size) == _plain(text.encode())


def test_one_file_is_read_by_many_tasks(spark, tmp_dir):
    rng = random.Random(2)
    data = [{"id": f"s{i}", "messages": [{"role": "user", "content": rng.choice(['}{"', "\\", "[,]", "é\n"]) * rng.randint(0, 9)}, {"role": "assistant", "content": "a"}]} for i in range(700)]
    data[5] = {"question": "q", "answer": "a"}
    data[9] = {"messages": []}
    import os

    os.makedirs(tmp_dir + "/in")
    with open(tmp_dir + "/in/a.json", "w", encoding="utf-8") as f:
        f.write("﻿\n" + json.dumps(data, indent=1, ensure_ascii=False) + " \n")
    with open(tmp_dir + "/in/b.json", "w", encoding="utf-8") as f:
        f.write(json.dumps(data[:3]) + "]")
    with open(tmp_dir + "/in/c.json", "w", encoding="utf-8") as f:
        f.write(json.dumps(data[0]))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        items, _ = json_items.array_items(spark, tmp_dir + "/in")
        assert items.where("is_array").count() >= 700
        samples, rejects = jsonl.read_json_array(spark, tmp_dir + "/in", strict=False)
        got = samples.orderBy("ord").collect()
        bad = sorted((r.file[-6:], r.pos, r.reason) for r in rejects.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [(r.ord, r.pos, r.id) for r in got] == [(i, n, "" if n == 5 else f"s{n}") for i, n in enumerate(n for n in range(700) if n != 9)]
    assert [m.content for m in got[7].messages] == [m["content"] for m in data[7]["messages"]]
    assert bad == [("a.json", 9, "messages_empty"), ("b.json", -1, "invalid_json"), ("c.json", -1, "not_array")]


def test_without_the_broadcast(spark, tmp_dir, monkeypatch):
    monkeypatch.setattr(json_items, "BROADCAST_SPLITS", -1)
    with open(tmp_dir + "/a.json", "w", encoding="utf-8") as f:
        f.write(json.dumps([{"prompt": f"p{i}", "completion": "c"} for i in range(50)]))
    samples, _ = jsonl.load_dataset(spark, tmp_dir + "/a.json")
    assert [r.messages[0].content for r in samples.orderBy("ord").collect()] == [f"p{i}" for i in range(50)]


def test_all_record_shapes_from_files(spark, tmp_dir):
    rows = [
        {"messages": [{"role": "user", "content": "m"}, {"role": "assistant", "content": "a"}], "instruction": "no", "output": "no"},
        {"conversations": [{"from": "human", "value": "c"}, {"from": "gpt", "value": "a"}], "prompt": "no", "response": "no"},
        {"instruction": "i", "output": "a"}, {"instruction": "i", "input": "  ", "output": "a"}, {"instruction": "i", "input": "x", "output": "a"},
        {"prompt": "p", "response": "a"}, {"prompt": "p", "completion": "a"}, {"question": "q", "answer": "a"}, {"messages": "text", "question": "q", "answer": "a"},
    ]
    bad = [{"text": "nothing"}, {"instruction": 5, "output": "a"}, {"prompt": None, "response": "a"}, {"prompt": "p"}]
    want = ["m", "c", "i", "i", "i\n\nx", "p", "p", "q", "q"]
    for name, text in (("d.jsonl", "\n".join(map(json.dumps, rows + bad))), ("d.json", json.dumps(rows + bad))):
        with open(f"{tmp_dir}/{name}", "w", encoding="utf-8") as f:
            f.write(text)
        read = jsonl.read_jsonl if name == "d.jsonl" else jsonl.read_json_array
        samples, rejects = read(spark, f"{tmp_dir}/{name}", strict=False)
        assert [[m.content for m in r.messages] for r in samples.orderBy("ord").collect()] == [[w, "a"] for w in want]
        assert rejects.count() == 4
        with pytest.raises(ValueError, match="Mixed dataset format"):
            jsonl.load_dataset(spark, f"{tmp_dir}/{name}")
