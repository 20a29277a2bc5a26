import json

from pyspark.sql import functions as F

from chatloom.streaming import reply_ingest
from chatloom.session import scratch_path


def test_stream_equals_batch(spark, tmp_dir):
    s = {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]}
    recs = [{"batch_id": i, "attempt": 1, "reply": json.dumps([s] if i % 2 else [dict(s, id=str(i))]),
             "ts": f"2024-01-01T00:00:{i:02d}"} for i in range(6)]
    recs.append({"batch_id": 9, "attempt": 1, "reply": "```json\n" + json.dumps([{"messages": [{"role": "user", "content": "z"}, {"role": "gpt", "content": " y "}]}]) + "\n```",
                 "ts": "2024-01-01T00:01:00"})
    recs.append({"batch_id": 10, "attempt": 1, "reply": json.dumps([{"messages": [{"role": "user", "content": "no answer"}]}]), "ts": "2024-01-01T00:01:01"})
    src = tmp_dir + "/src"
    spark.createDataFrame([json.dumps(r) for r in recs], "string").write.text(src)
    sink, ckpt = scratch_path(spark, "t-sink"), scratch_path(spark, "t-ckpt")
    reply_ingest.start_reply_ingest(spark, src, sink, ckpt).awaitTermination()
    streamed = {r["canon_sha"] for r in spark.read.parquet(sink).collect()}
    batch = reply_ingest.ingest_plan(spark.read.schema(reply_ingest.REPLY_RECORD_SCHEMA).json(src))
    assert streamed == {r["canon_sha"] for r in batch.collect()}
    assert len(streamed) == 2


def test_trial_tail_reads_lines_as_the_batch_reader(spark, tmp_dir):
    from chatloom.sources.trial_log import read_trial_log
    from chatloom.streaming import trial_tail

    good = {"trial_id": 3, "recipe_diff": {}, "eval_bpb": 2.0, "judge_score": None, "kept": True, "wall_clock_secs": 1.0, "steps": 5, "timestamp": "t"}
    short = {k: v for k, v in good.items() if k != "steps"} | {"trial_id": 7, "eval_bpb": 0.5}
    lines = [json.dumps(good), '{"trial_id": 9, "eval_bpb": 0.1', json.dumps(short), "", json.dumps(good | {"trial_id": 4, "eval_bpb": None, "note": 1})]
    log = tmp_dir + "/log/run_id=r1"
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(log)
    sink, ckpt = scratch_path(spark, "t2-sink"), scratch_path(spark, "t2-ckpt")
    trial_tail.start_trial_tail(spark, tmp_dir + "/log", sink, ckpt).awaitTermination()
    view = trial_tail.current_view(spark, sink).collect()
    assert [(r.run_id, r.best_bpb, r.best_trial_id, r.trials_logged, r.last_trial) for r in view] == [("r1", 2.0, 3, 2, 4)]
    assert read_trial_log(spark, tmp_dir + "/log").count() == 2
