"""Trial-log analytics: running best (H1), best trial (H2), top-k (H3), run summary (H4),
failed trials (H5), recipe-diff audit (C7) and bits-per-byte (G2).

A trial log row: ``run_id, trial_id, recipe_diff (JSON text), eval_bpb, judge_score, kept,
wall_clock_secs, steps, timestamp``. ``eval_bpb`` is +inf for failed trials.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

INF = float("inf")
SCAN_BLOCK = 4096

# ---------------------------------------------------------------------------
# The recipe knobs, their numeric bounds (inclusive) and schedulers
# ---------------------------------------------------------------------------
ALLOWED_KNOBS = ("learning_rate", "lora_rank", "lora_alpha", "target_modules", "warmup_steps", "num_epochs",
                 "max_steps", "batch_size", "gradient_accumulation_steps", "scheduler")
KNOB_BOUNDS = (
    ("learning_rate", 1e-6, 1e-1),
    ("lora_rank", 1, 512),
    ("lora_alpha", 1, 1024),
    ("warmup_steps", 0, 100_000),
    ("num_epochs", 1, 100),
    ("max_steps", 1, 1_000_000),
    ("batch_size", 1, 1024),
    ("gradient_accumulation_steps", 1, 1024),
)
SCHEDULERS = ("cosine", "linear", "constant")
DEFAULT_RECIPE = {
    "learning_rate": 2e-4, "lora_rank": 16, "lora_alpha": 16, "target_modules": ["q_proj", "v_proj"],
    "warmup_steps": 10, "num_epochs": 1, "max_steps": 200, "batch_size": 2, "gradient_accumulation_steps": 4,
    "scheduler": "cosine",
}


_INTEGER_KNOBS = ("lora_alpha", "warmup_steps", "num_epochs", "max_steps", "batch_size", "gradient_accumulation_steps")


def bpb_key(bpb: Column) -> Column:
    """NULL and NaN → +inf, so comparisons behave like ``bpb < best`` with NaN false."""
    return F.nanvl(F.coalesce(bpb, F.lit(INF)), F.lit(INF))


def running_best(log: DataFrame, run: str = "run_id", trial: str = "trial_id", bpb: str = "eval_bpb",
                 block: int = SCAN_BLOCK) -> DataFrame:
    """Adds ``best_before`` (min of all earlier trials, +inf at start) and ``is_best``
    (strictly below it). A blocked scan: per-(run, block) minima are prefix-combined on a
    small table, and the exact running min runs inside blocks of ``block`` trials, so a
    run holding a third of all rows is still split across many tasks."""
    m = log.withColumn("_m", bpb_key(F.col(bpb))).withColumn("_blk", F.floor(F.col(trial) / F.lit(block)))
    blocks = m.groupBy(run, "_blk").agg(F.min("_m").alias("_bmin"))
    wb = Window.partitionBy(run).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    prefix = blocks.select(run, "_blk", F.coalesce(F.min("_bmin").over(wb), F.lit(INF)).alias("_prefix"))
    wi = Window.partitionBy(run, "_blk").orderBy(trial).rowsBetween(Window.unboundedPreceding, -1)
    inner = m.withColumn("_inner", F.coalesce(F.min("_m").over(wi), F.lit(INF)))
    out = inner.join(prefix, [run, "_blk"]).withColumn("best_before", F.least("_inner", "_prefix"))
    return out.withColumn("is_best", F.col("_m") < F.col("best_before")).drop("_m", "_blk", "_inner", "_prefix")


def _best(m: Column) -> Column:
    """Aggregate: the row with the least finite ``m`` (ties by trial id), NULL without one."""
    return F.min_by(F.struct("trial_id", "recipe_diff", m.alias("_m")), F.when(m < F.lit(INF), F.struct(m, "trial_id")))


def _best_columns() -> list[Column]:
    return [F.coalesce("_w.trial_id", F.lit(-1)).cast("int").alias("best_trial_id"), F.coalesce("_w._m", F.lit(INF)).alias("best_bpb"),
            F.coalesce("_w.recipe_diff", F.lit("{}")).alias("best_recipe_diff")]


def best_trial(log: DataFrame, run: str = "run_id") -> DataFrame:
    """First trial reaching the run's minimum finite bpb; ``-1`` and ``{}`` when none."""
    m = log.withColumn("_m", bpb_key(F.col("eval_bpb")))
    return m.groupBy(run).agg(_best(F.col("_m")).alias("_w")).select(run, *_best_columns())


def top_k_trials(log: DataFrame, k: int = 3, run: str = "run_id") -> DataFrame:
    """Kept trials by ascending bpb (ties by trial id), first ``k`` per run, with ``rank``."""
    w = Window.partitionBy(run).orderBy(bpb_key(F.col("eval_bpb")), "trial_id")
    return log.where("kept").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def run_summary(log: DataFrame, run: str = "run_id") -> DataFrame:
    """Per run: best, counts, resume point (last trial + 1) and missing trial ids."""
    m = log.withColumn("_m", bpb_key(F.col("eval_bpb")))
    out = m.groupBy(run).agg(
        F.count(F.lit(1)).alias("trials_logged"),
        F.count_if("kept").alias("kept_count"),
        F.count_if(F.col("_m") == F.lit(INF)).alias("failed_count"),
        (F.max("trial_id") + 1).cast("int").alias("next_trial"),
        _best(F.col("_m")).alias("_w"),
    ).select(run, "trials_logged", "kept_count", "failed_count", "next_trial", *_best_columns())
    return out.withColumn("trial_gaps", (F.col("next_trial") - F.col("trials_logged")).cast("bigint")).withColumn(
        "failure_rate", F.col("failed_count") / F.col("trials_logged"))


def failed_trials(log: DataFrame) -> DataFrame:
    return log.where(bpb_key(F.col("eval_bpb")) == F.lit(INF))


# ---------------------------------------------------------------------------
# Recipe diff audit
# ---------------------------------------------------------------------------

def _json_type(v: Column, key: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(v, f"$.{key}", "variant"))


def recipe_diff_audit(log: DataFrame, diff_col: str = "recipe_diff") -> DataFrame:
    """First failing rule per diff → ``status`` (ok/rejected), ``reason``, ``knob``, plus the
    whole recipe after the diff as ``applied_*`` columns (NULL when rejected)."""
    v = F.try_parse_json(F.col(diff_col))
    keys = F.map_keys(F.from_json(F.col(diff_col), "map<string,string>"))
    allowed = F.array(*[F.lit(k) for k in ALLOWED_KNOBS])
    unknown = F.array_sort(F.filter(keys, lambda k: ~F.array_contains(allowed, k)))
    present = lambda k: F.array_contains(keys, F.lit(k))

    tm_type = _json_type(v, "target_modules")
    tm_bad = present("target_modules") & (
        (tm_type.startswith("ARRAY") & (F.size(F.try_variant_get(v, "$.target_modules", "array<variant>")) == 0))
        | (tm_type == "STRING") & (F.length(F.try_variant_get(v, "$.target_modules", "string")) == 0)
        | ~(tm_type.startswith("ARRAY") | (tm_type == "STRING")))

    reason, knob = F.when(v.isNull(), F.lit("not_json")), F.when(v.isNull(), F.lit(None).cast("string"))
    reason, knob = reason.when(F.size(unknown) > 0, F.lit("unknown_knob")), knob.when(F.size(unknown) > 0, F.array_join(unknown, ","))
    reason, knob = reason.when(tm_bad, F.lit("empty_target_modules")), knob.when(tm_bad, F.lit("target_modules"))
    for k, lo, hi in KNOB_BOUNDS:
        t = _json_type(v, k)
        numeric = (t == "BIGINT") | (t == "DOUBLE") | t.startswith("DECIMAL")
        val = F.try_variant_get(v, f"$.{k}", "double")
        bad = present(k) & ~(F.coalesce(numeric, F.lit(False)) & (val >= F.lit(float(lo))) & (val <= F.lit(float(hi))))
        reason, knob = reason.when(bad, F.lit("out_of_bounds")), knob.when(bad, F.lit(k))
    sched = F.try_variant_get(v, "$.scheduler", "string")
    sched_bad = present("scheduler") & ~F.coalesce(
        (_json_type(v, "scheduler") == "STRING") & sched.isin(*SCHEDULERS), F.lit(False))
    reason = reason.when(sched_bad, F.lit("bad_scheduler"))
    knob = knob.when(sched_bad, F.lit("scheduler"))
    ok = reason.isNull()
    applied = lambda k, typ: F.when(ok, F.coalesce(F.try_variant_get(v, f"$.{k}", typ), F.lit(DEFAULT_RECIPE[k])))
    return log.select(
        "*",
        F.when(ok, F.lit("ok")).otherwise(F.lit("rejected")).alias("status"),
        reason.alias("reason"), knob.alias("knob"),
        applied("lora_rank", "bigint").alias("applied_lora_rank"),
        applied("learning_rate", "double").alias("applied_learning_rate"),
        applied("scheduler", "string").alias("applied_scheduler"),
        *[applied(k, "bigint").alias(f"applied_{k}") for k in _INTEGER_KNOBS],
        F.when(ok, F.when(tm_type == "STRING", F.split(F.try_variant_get(v, "$.target_modules", "string"), ""))
               .otherwise(F.coalesce(F.try_variant_get(v, "$.target_modules", "array<string>"),
                                     F.array(*[F.lit(m) for m in DEFAULT_RECIPE["target_modules"]])))).alias("applied_target_modules"),
    )


# ---------------------------------------------------------------------------
# Bits per byte
# ---------------------------------------------------------------------------

CHARS_PER_TOKEN = 3.8


def bits_per_byte(losses: DataFrame, keys: list[str], loss: str = "loss", tokens: str = "n_tokens") -> DataFrame:
    """Token-weighted mean loss (nats) → bits per byte: ``Σ(loss·n)/Σn / ln 2 / 3.8``; +inf
    when there are no tokens."""
    agg = losses.groupBy(*keys).agg(F.sum(F.col(loss) * F.col(tokens)).alias("_ln"), F.sum(tokens).alias("n_tokens"))
    bpb = F.when(F.col("n_tokens") > 0, F.col("_ln") / F.col("n_tokens") / F.lit(math.log(2)) / F.lit(CHARS_PER_TOKEN)).otherwise(F.lit(INF))
    return agg.select(*keys, F.col("n_tokens").cast("bigint").alias("n_tokens"), bpb.alias("bpb"))
