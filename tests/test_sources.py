import hashlib
import json
import os
import pathlib
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatloom.operators import convert
from chatloom.sources import jsonl, manifest, trial_log


def _write(path, name, text):
    os.makedirs(path, exist_ok=True)
    with open(os.path.join(path, name), "w", encoding="utf-8") as fh:
        fh.write(text)


GOLD = {"id": "a", "messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "é"}]}


def test_jsonl_bom_blank_and_bad_line(spark, tmp_dir):
    _write(tmp_dir, "d.jsonl", "﻿" + json.dumps(GOLD) + "\n\n   \n" + json.dumps(GOLD) + "\n")
    s, _ = jsonl.read_jsonl(spark, tmp_dir)
    assert s.count() == 2
    bad = tmp_dir + "/bad"
    _write(bad, "d.jsonl", json.dumps(GOLD) + "\n{oops\n" + json.dumps(GOLD) + " trailing\n")
    with pytest.raises(ValueError):
        jsonl.read_jsonl(spark, bad)
    _, rej = jsonl.read_jsonl(spark, bad, strict=False)
    assert rej.count() == 2
    empty = tmp_dir + "/empty"
    _write(empty, "d.jsonl", "\n\n")
    with pytest.raises(ValueError):
        jsonl.read_jsonl(spark, empty)


def test_json_array_and_object(spark, tmp_dir):
    _write(tmp_dir + "/ok", "a.json", json.dumps([GOLD, GOLD], indent=2))
    s, _ = jsonl.read_json_array(spark, tmp_dir + "/ok")
    assert s.count() == 2
    _write(tmp_dir + "/obj", "a.json", json.dumps(GOLD))
    with pytest.raises(ValueError):
        jsonl.read_json_array(spark, tmp_dir + "/obj")


def test_golden_line_format(spark):
    df = spark.createDataFrame([(0, "sample_0000", [{"role": "user", "content": 'a "q"\n'}])],
                               "ord long, id string, messages array<struct<role:string,content:string>>")
    line = df.select(jsonl.golden_line(F.col("id"), F.col("messages"))).first()[0]
    assert line == json.dumps({"id": "sample_0000", "messages": [{"role": "user", "content": 'a "q"\n'}]}, ensure_ascii=False)


def test_record_shapes(spark):
    rows = [
        {"messages": [{"role": "user", "content": "m"}], "conversations": [{"from": "human", "value": "c"}]},
        {"conversations": [{"from": "Wizard", "value": "c"}]},
        {"instruction": "i", "input": None, "output": "o"},
        {"instruction": "i", "input": "  ", "output": "o"},
        {"instruction": "i", "input": "x", "output": "o"},
        {"prompt": "p", "completion": "c"},
        {"text": "nothing"},
    ]
    schema = ("messages array<struct<role:string,content:string>>, conversations array<struct<from:string,value:string>>, "
              "instruction string, input string, output string, prompt string, completion string, text string")
    df = spark.createDataFrame([tuple(r.get(k) for k in ["messages", "conversations", "instruction", "input", "output",
                                                          "prompt", "completion", "text"]) for r in rows], schema)
    got = [(r["source_format"], [(m["role"], m["content"]) for m in r["messages"]] if r["messages"] else None)
           for r in convert.convert_records(df).collect()]
    assert got[0] == ("messages", [("user", "m")])
    assert got[1] == ("conversations", [("Wizard", "c")])
    assert got[2][1][0] == ("user", "i") and got[3][1][0] == ("user", "i") and got[4][1][0] == ("user", "i\n\nx")
    assert got[5] == ("prompt_completion", [("user", "p"), ("assistant", "c")])
    assert got[6] == ("unrecognized", None)
    with pytest.raises(ValueError):
        convert.require_single_format(df)


def test_sources(spark):
    srcs = ["https://x/y.jsonl?a=1", "org/name", "org/name/split", "data.jsonl", "./data.jsonl", "data/file.jsonl",
            "https://x/y/#frag", "https://x/y/"]
    df = spark.createDataFrame([(s,) for s in srcs], "source string")
    repo, split = manifest.hub_repo_and_split(F.col("source"))
    got = [(r["t"], r["c"], r["r"], r["s"]) for r in df.select(
        manifest.source_type(F.col("source")).alias("t"), manifest.cache_name(F.col("source")).alias("c"),
        repo.alias("r"), split.alias("s")).collect()]
    assert [g[0] for g in got] == ["url", "hf", "local", "local", "hf", "hf", "url", "url"]
    assert got[0][1] == "y.jsonl" and got[7][1] == "y" and got[6][1] == "#frag"
    assert got[2][2:] == ("org/name", "split")


def test_trial_log_reader(spark, tmp_dir):
    good = {"trial_id": 0, "recipe_diff": {"lora_rank": 8}, "eval_bpb": None, "judge_score": None, "kept": False,
            "wall_clock_secs": 1.0, "steps": 3, "timestamp": "t", "extra": 1}
    missing = dict(good, trial_id=1)
    del missing["steps"]
    no_bpb = dict(good, trial_id=2)
    del no_bpb["eval_bpb"]
    _write(tmp_dir + "/run-a", "experiments.jsonl",
           "\n".join([json.dumps(good), "{broken", json.dumps(missing), "", json.dumps(no_bpb)]) + "\n")
    rows = trial_log.read_trial_log(spark, tmp_dir).orderBy("trial_id").collect()
    assert [(r["run_id"], r["trial_id"]) for r in rows] == [("run-a", 0), ("run-a", 2)]
    assert all(r["eval_bpb"] == float("inf") for r in rows)


def test_loop_checkpoints_strict_keys(spark, tmp_dir):
    ok = {"current_trial": 3, "best_trial_id": 1, "best_bpb": None, "best_recipe_diff": {"lora_rank": 8},
          "total_trials_run": 3}
    _write(tmp_dir + "/run-a", "loop_checkpoint.json", json.dumps(ok, indent=2))
    _write(tmp_dir + "/run-b", "loop_checkpoint.json", json.dumps(dict(ok, extra=1), indent=2))
    missing = dict(ok)
    del missing["total_trials_run"]
    _write(tmp_dir + "/run-c", "loop_checkpoint.json", json.dumps(missing))
    rows = trial_log.read_loop_checkpoints(spark, tmp_dir).collect()
    assert [(r["run_id"], r["current_trial"], r["best_bpb"]) for r in rows] == [("run-a", 3, float("inf"))]
    assert json.loads(rows[0]["best_recipe_diff"]) == {"lora_rank": 8}


def test_jsonl_line_numbers(spark, tmp_dir):
    lines = [json.dumps(GOLD)] * 5 + ["", "{broken"] + [json.dumps(GOLD)] * 3
    _write(tmp_dir, "d.jsonl", "\n".join(lines) + "\n")
    with pytest.raises(ValueError, match=r"d\.jsonl:7: invalid_json"):
        jsonl.read_jsonl(spark, tmp_dir)
    s, rej = jsonl.read_jsonl(spark, tmp_dir, strict=False)
    assert [r["line_no"] for r in rej.collect()] == [7]
    assert [(r["ord"], r["line_no"]) for r in s.orderBy("ord").collect()] == [(i, n) for i, n in enumerate([1, 2, 3, 4, 5, 8, 9, 10])]


def test_jsonl_line_numbers_across_splits(spark, tmp_dir):
    lines = [json.dumps(dict(GOLD, id=f"s{i}")) if i != 123 else "{broken" for i in range(400)]
    _write(tmp_dir, "big.jsonl", "\n".join(lines) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        s, rej = jsonl.read_jsonl(spark, tmp_dir, strict=False)
        assert [r["line_no"] for r in rej.collect()] == [124]
        got = [(r["line_no"], r["id"]) for r in s.orderBy("ord").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == [(i + 1, f"s{i}") for i in range(400) if i != 123]


def _lines(spark, path, rows):
    spark.createDataFrame([(x,) for x in rows], "value string").coalesce(1).write.text(path)


def test_strict_json_has_no_tail(spark):
    from chatloom.sources.jsonl import _strict_json

    good = ['{"a": 1}', " [1, 2] ", '"x"', "3"]
    bad = ['{"a": 1}] x', '{"a": 1},{', '{"a": 1} ]', '{"a": 1}} x', '{"a": 1}, 2', "1 2", "{", "", '[1]]', '{"a":1}],"b":[2', '1},"w":{"x":2']
    df = spark.createDataFrame([(x,) for x in good + bad], "t string")
    got = [r.ok for r in df.select(_strict_json(F.col("t")).isNotNull().alias("ok")).collect()]
    assert got == [True] * len(good) + [False] * len(bad)


def test_conversations_files(spark, tmp_dir):
    from chatloom.sources import jsonl

    conv = '{"conversations": [{"from": "Human", "value": "q"}, {"from": "gpt", "value": "a"}], "id": "lost"}'
    gold = '{"id": "g", "messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]}'
    _lines(spark, tmp_dir + "/c.jsonl", [conv, conv])
    _lines(spark, tmp_dir + "/m.jsonl", [conv, gold])
    _lines(spark, tmp_dir + "/b.jsonl", ['{"conversations": [{"from": "human"}]}', '{"conversations": [{"from": "human", "value": 5}]}', '{"conversations": 3}', conv])
    _lines(spark, tmp_dir + "/a.json", [f"[{conv}, {conv}]"])
    for path in ("/c.jsonl", "/a.json"):
        rows = jsonl.load_dataset(spark, tmp_dir + path)[0].orderBy("ord").collect()
        assert [(r.ord, r.id, [tuple(m) for m in r.messages]) for r in rows] == [(i, "", [("user", "q"), ("assistant", "a")]) for i in (0, 1)]
    with pytest.raises(ValueError, match="Mixed dataset format"):
        jsonl.load_dataset(spark, tmp_dir + "/m.jsonl")
    assert jsonl.read_jsonl(spark, tmp_dir + "/m.jsonl")[0].count() == 2
    samples, rejects = jsonl.read_jsonl(spark, tmp_dir + "/b.jsonl", strict=False)
    assert samples.count() == 1 and [r.reason for r in rejects.collect()] == ["messages_not_list"] * 3
    for path in ("/x.csv", "/plain", "/dir.d/plain"):
        with pytest.raises(ValueError, match="known"):
            jsonl.load_dataset(spark, tmp_dir + path)


def test_raw_text_files(spark, tmp_dir):
    from chatloom.sources import jsonl

    _lines(spark, tmp_dir + "/raw", ["first line", "", "third é"])
    assert [r.text for r in jsonl.read_raw_text(spark, tmp_dir + "/raw").collect()] == ["first line\n\nthird é\n"]


def test_own_files_mode(spark, tmp_dir):
    from chatloom.plans import dataset_modes

    conv = '{"conversations": [{"from": "human", "value": " q "}, {"from": "gpt", "value": "a"}]}'
    _lines(spark, tmp_dir + "/own.jsonl", [conv, conv])
    ds, counts = dataset_modes.bring_your_own_files(spark, tmp_dir + "/own.jsonl", sink=tmp_dir + "/out")
    assert [(r.id, [m.content for m in r.messages]) for r in ds.orderBy("ord").collect()] == [("sample_0000", ["q", "a"]), ("sample_0001", ["q", "a"])]
    assert spark.read.text(tmp_dir + "/out").count() == 2 and [r.n for r in counts.orderBy("stage_no").collect()] == [2, 2]
    _lines(spark, tmp_dir + "/blank.jsonl", [conv.replace(" q ", " ")])
    with pytest.raises(RuntimeError, match="loaded=1, validated=0"):
        dataset_modes.bring_your_own_files(spark, tmp_dir + "/blank.jsonl")


def test_record_limits_and_nothing_converted(spark):
    from chatloom.operators.convert import convert_records
    from chatloom.plans import dataset_modes

    rows = spark.createDataFrame([(5 * i, f"q{i}", "a") for i in range(6)], "ord long, question string, answer string")
    assert sorted(r.ord for r in convert_records(rows, max_samples=2).collect()) == [0, 5]
    with pytest.raises(RuntimeError, match="no record of 6"):
        dataset_modes.bring_your_own_mode(rows.withColumnRenamed("answer", "reply"))


def test_scratch_can_be_cleared(spark):
    from chatloom.session import clear_scratch, saved

    clear_scratch(spark)
    df = saved(spark.range(5).toDF("n"), "to-clear")
    path = df.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    assert os.path.isdir(path) and clear_scratch(spark) == 1 and not os.path.isdir(path) and clear_scratch(spark) == 0


def test_a_write_leaves_no_shuffle_files(spark):
    from chatloom.session import saved

    manager = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()
    count = lambda: manager.getAllFiles().mkString(" ").count("/shuffle_")
    before = count()
    table = saved(spark.range(100).repartition(3).groupBy((F.col("id") % 7).alias("k")).count(), "shuffled")
    until = time.monotonic() + 20
    while count() > before and time.monotonic() < until:
        time.sleep(0.1)
    assert count() <= before and table.count() == 7


def test_a_block_deletes_its_tables(spark):
    from chatloom.session import release, saved, scratch_block

    there = lambda table: os.path.isdir(table.scratch.removeprefix("file:"))
    with scratch_block(spark) as keep:
        a, b, c = (saved(spark.range(3), name) for name in ("a", "b", "c"))
        keep(b)
        release(c)
        assert there(a) and not there(c)
        with pytest.raises(ValueError), scratch_block(spark):
            d = saved(spark.range(3), "d")
            raise ValueError
    assert [there(t) for t in (a, b, c, d)] == [False, True, False, False] and b.count() == 3
    release(b)


def test_structure_mode_in_shares(spark, monkeypatch):
    """Shares of the documents give the rows of one pass, with repeated and null ids; of the tables on the way none is left."""
    from chatloom.operators import inference
    from chatloom.plans import dataset_modes
    from chatloom.session import checkpoint_root

    texts = ["\n\n".join(" ".join(f"w{d}x{p}y{j}" for j in range(12 + d + 50 * (p % 2) * 3)) for p in range(3)) for d in range(9)]
    rows = [*enumerate(texts), (3, texts[3]), (4, texts[5]), (None, texts[6]), (20, texts[1]), (21, " "), (22, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")

    def names():
        return {n for n in os.listdir(checkpoint_root(spark).removeprefix("file:")) if not n.startswith("chatloom-pyfiles")}

    def run(**more):
        before = names()
        ds, counts = dataset_modes.structure_mode(docs, inference.passage_echo_model, allow_empty=True, **more)
        got = sorted(ds.select("ord", "id", F.to_json("messages").alias("m")).collect()), [r.n for r in counts.orderBy("stage_no").collect()]
        left = {n.rsplit("-", 1)[0] for n in names() - before}
        assert left <= {"chatloom-mode-validated", "chatloom-near-met", "chatloom-position-keys", "chatloom-position-buckets"}
        return got

    replies = spark.createDataFrame([(i, f"{i % 5}") for i in range(9)], "doc_id long, reply string")
    ways = [{"judge_model": inference.length_judge_model}, {"judge_replies": replies}]
    one = [run(**way) for way in ways]
    assert one[0][1][0] > 10 and one[0][0]
    monkeypatch.setattr(dataset_modes, "SHARE_TEXTS", 2)
    monkeypatch.setattr(dataset_modes, "TEXT_SHARES", 2)
    assert [run(**way) for way in ways] == one


def test_cluster_needs_a_shared_folder(monkeypatch):
    from types import SimpleNamespace

    from chatloom.session import checkpoint_root

    sc = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        checkpoint_root(SimpleNamespace(sparkContext=sc, conf=SimpleNamespace(get=lambda *a: None)))


def test_files_of_the_file_mode_grow_with_the_rows(spark, tmp_path, monkeypatch):
    from chatloom.plans import registry

    rows = [(i, f"text {i} " + "word " * 20, "en", "web", 100) for i in range(200)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(registry, "scratch_path", lambda spark, name: str(tmp_path / name))
    monkeypatch.setattr(registry, "OWN_FILE_ROWS", 20, raising=False)
    got = registry.QUERIES["mode_bring_your_own_files"](spark, str(tmp_path)).orderBy("ord").collect()
    assert [r["ord"] for r in got] == list(range(200)) and got[7]["id"] == "sample_0007"
    assert len(list((tmp_path / "own-files.jsonl").glob("part-*.txt"))) == 10


def test_raw_text_bundle(spark, tmp_path, monkeypatch):
    from chatloom.plans import registry

    texts = {1: "first line\n\nthird é\r\n", 2: None, 3: "", 4: 'a "quoted" \\   line'}
    spark.createDataFrame([*texts.items(), (4, "again")], "doc_id long, text string").repartition(2).write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(registry, "scratch_path", lambda spark, name: str(tmp_path / name))
    got = {r.doc_id: (r.n_chars, r.text_md5) for r in registry.QUERIES["read_raw_text"](spark, str(tmp_path)).collect()}
    assert sorted(got) == [1, 2, 3, 4] and got[4][0] == len(texts[4]) + len("again") + 2
    for i in (1, 2, 3):
        whole = (texts[i] or "") + "\n"
        assert got[i] == (len(whole), hashlib.md5(whole.encode()).hexdigest())
    assert not list(tmp_path.rglob("doc_id=*"))


def test_run_files_in_a_bundle_read_as_in_directories(spark, tmp_dir):
    state = {f.name: None for f in trial_log.RUN_STATE_SCHEMA.fields}
    rows = [("run-1", state | {"phase": "final", "best_bpb": 2.5, "total_trials": 3}), ("run-2", state | {"phase": "tune", "best_bpb": float("inf")}), ("a b", state)]
    states = spark.createDataFrame([(r, *s.values()) for r, s in rows], T.StructType([T.StructField("run_id", T.StringType()), *trial_log.RUN_STATE_SCHEMA.fields]))
    for where in ("/states", "/states.bundle"):
        trial_log.write_run_states(states, tmp_dir + where)
    key = lambda r: (r.phase or "", r.run_id)
    plain, packed = (sorted(trial_log.read_run_states(spark, tmp_dir + w).collect(), key=key) for w in ("/states", "/states.bundle"))
    assert packed[1:] == plain[1:] and packed[0].run_id == "a b" and packed[0][1:] == plain[0][1:] and packed[2].best_bpb == float("inf")
    assert not list(pathlib.Path(tmp_dir, "states.bundle").glob("run_id=*"))
    ok = {"current_trial": 3, "best_trial_id": 1, "best_bpb": None, "best_recipe_diff": {"lora_rank": 8}, "total_trials_run": 3}
    docs = [("run-a", json.dumps(ok, indent=2)), ("run-b", json.dumps(ok | {"extra": 1})), ("run-c", None), (None, json.dumps(ok))]
    trial_log.write_by_run(spark.createDataFrame(docs, "run_id string, value string"), tmp_dir + "/c.bundle", "errorifexists")
    got = trial_log.read_loop_checkpoints(spark, tmp_dir + "/c.bundle").collect()
    assert sorted((r.run_id, r.current_trial, r.best_bpb) for r in got) == [("__HIVE_DEFAULT_PARTITION__", 3, float("inf")), ("run-a", 3, float("inf"))]


@pytest.mark.parametrize("name", ["run_states", "loop_checkpoints", "stream_trial_tail", "trial_log_read", "trial_log_roundtrip"])
def test_queries_on_runs_write_no_file_per_run(spark, tmp_path, monkeypatch, name):
    from datetime import datetime

    from chatloom.plans import registry

    rows = [(i, datetime(2024, 1, 1, 0, 0, i % 60), i % 40, "view", 1.0 + i, '{"k": 3}') for i in range(80)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    monkeypatch.setattr(registry, "scratch_path", lambda spark, name: str(tmp_path / name))
    got = registry.QUERIES[name](spark, str(tmp_path)).collect()
    assert len({r.run_id for r in got}) == (40 if name != "loop_checkpoints" else 40 - len([n for n in range(40) if n % 11 == 3 or n % 7 == 2]))
    assert not list(tmp_path.rglob("run_id=*"))
