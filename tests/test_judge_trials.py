import math

from pyspark.sql import functions as F

from chatloom.operators import judge, trials
from conftest import samples_df


def test_gate_and_eval_scores(spark):
    replies = ["4/5", "-2", "99", "0", "score7", "none", None, " 3.5 "]
    df = spark.createDataFrame([(r,) for r in replies], "reply string")
    got = [(r["g"], r["e"]) for r in df.select(judge.gate_score(F.col("reply"), 5).alias("g"),
                                               judge.eval_score(F.col("reply")).alias("e")).collect()]
    assert got == [(4.0, 4.0), (2.0, 2.0), (5.0, 10.0), (1.0, 1.0), (5.0, None), (None, None), (None, None), (3.5, 3.5)]


def test_quality_gate_min_is_kept(spark):
    s = samples_df(spark, [(0, [("user", "q"), ("assistant", "a")]), (1, [("user", "q"), ("assistant", "b")]),
                           (2, [("user", "q"), ("assistant", "c")])])
    r = spark.createDataFrame([(0, "3"), (1, "2.9")], "ord long, reply string")
    kept, drops = judge.quality_gate(s, r, 3.0, 5)
    assert sorted(x["ord"] for x in kept.collect()) == [0, 2]      # 2: no reply → midpoint 3.0
    assert [x["message"] for x in drops.collect()] == ["Sample 1: dropped, quality score 2.9/5 < 3.0"]


def test_judge_mean_default(spark):
    s = samples_df(spark, [(0, [("user", "q"), ("assistant", "a")])])
    r = spark.createDataFrame([(1, 0, "n/a")], "trial_id int, ord long, reply string")
    assert [(x["n_scored"], x["mean_score"]) for x in judge.judge_mean(s, r).collect()] == [(0, 5.0)]


def _log(spark, rows):
    return spark.createDataFrame([("r", i, "{}", b, None, False, 0.0, 0, "") for i, b in enumerate(rows)],
                                 "run_id string, trial_id int, recipe_diff string, eval_bpb double, judge_score double, "
                                 "kept boolean, wall_clock_secs double, steps int, timestamp string")


def test_running_best_nan_inf_ties(spark):
    log = _log(spark, [float("nan"), float("inf"), 2.0, 2.0, 1.5, None])
    got = [r["is_best"] for r in trials.running_best(log, block=2).orderBy("trial_id").collect()]
    assert got == [False, False, True, False, True, False]


def test_best_trial_all_failed(spark):
    log = _log(spark, [float("inf"), float("nan")])
    r = trials.best_trial(log).collect()[0]
    assert r["best_trial_id"] == -1 and math.isinf(r["best_bpb"]) and r["best_recipe_diff"] == "{}"


def test_top_k_larger_than_kept(spark):
    log = _log(spark, [3.0, 2.0, 1.0]).withColumn("kept", F.lit(True))
    got = [r["trial_id"] for r in trials.top_k_trials(log, k=10).orderBy("rank").collect()]
    assert got == [2, 1, 0]


def test_recipe_diff_audit(spark):
    diffs = ['{"bad_knob": 1}', '{"lora_rank": true}', '{"lora_rank": 512}', '{"lora_rank": 513}',
             '{"target_modules": []}', '{"scheduler": "step"}', "{}", '{"learning_rate": 0.1}']
    log = spark.createDataFrame([("r", i, d) for i, d in enumerate(diffs)], "run_id string, trial_id int, recipe_diff string")
    got = [(r["status"], r["reason"]) for r in trials.recipe_diff_audit(log).orderBy("trial_id").collect()]
    assert got == [("rejected", "unknown_knob"), ("rejected", "out_of_bounds"), ("ok", None), ("rejected", "out_of_bounds"),
                   ("rejected", "empty_target_modules"), ("rejected", "bad_scheduler"), ("ok", None), ("ok", None)]


def test_bits_per_byte_zero_tokens(spark):
    df = spark.createDataFrame([(1, 2.0, 10), (1, 4.0, 30), (2, 1.0, 0)], "trial_id int, loss double, n_tokens long")
    got = {r["trial_id"]: r["bpb"] for r in trials.bits_per_byte(df, ["trial_id"]).collect()}
    assert abs(got[1] - (3.5 / math.log(2) / 3.8)) < 1e-12 and math.isinf(got[2])
