"""Judge scores: gate parsing (F2), quality gate (F3), eval parsing (F4), judge mean."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatloom.functions import fill, first_content, ustrip
from chatloom.schema import MESSAGE_TEXT

_NUMBER = r"\d+(?:\.\d+)?"
_BOUNDED_NUMBER = r"(?U)\b\d+(?:\.\d+)?\b"
EVAL_FIELD_CHARS = 300
EVAL_SCALE = 10
EVAL_DEFAULT_MEAN = 5.0

EVAL_PROMPT = ("[question]\n{q}\n[known good answer]\n{ref}\n[answer under test]\n{gen}\n"
               "[task] Compare the answer under test with the known good one and give it 1 to 10 points. Output one number.")


def _clamp(x: Column, hi: float) -> Column:
    # greatest/least skip NULLs, so keep "no number" as NULL explicitly
    return F.when(x.isNotNull(), F.greatest(F.lit(1.0), F.least(F.lit(float(hi)), x)))


def gate_score(reply: Column, scale: int) -> Column:
    """First number in the reply, clamped to [1, scale]; NULL when there is none (sign ignored)."""
    m = F.regexp_substr(ustrip(reply), F.lit(_NUMBER))
    return _clamp(m.try_cast("double"), scale)


def eval_score(reply: Column) -> Column:
    """First word-bounded number, clamped to [1, 10]; NULL when there is none."""
    m = F.regexp_substr(ustrip(reply), F.lit(_BOUNDED_NUMBER))
    return _clamp(m.try_cast("double"), EVAL_SCALE)


def quality_gate(samples: DataFrame, judge_replies: DataFrame, min_score: float = 3.0, scale: int = 5,
                 index_col: str = "ord", key: str = "ord") -> tuple[DataFrame, DataFrame]:
    """Samples ⟕ judge replies on ``key``; a missing/failed/unparseable reply scores the
    midpoint ``(scale+1)/2``; drop when score < ``min_score``. Returns (kept, drops)."""
    fallback = (scale + 1) / 2
    r = judge_replies.select(key, gate_score(F.col("reply"), scale).alias("_parsed"))
    scored = samples.join(r, key, "left").withColumn("score", F.coalesce("_parsed", F.lit(float(fallback)))).drop("_parsed")
    kept = scored.where(F.col("score") >= F.lit(float(min_score)))
    drops = scored.where(F.col("score") < F.lit(float(min_score))).select(
        "ord", "score",
        fill(MESSAGE_TEXT["low_score"], n=F.col(index_col), score=F.format_string("%.1f", F.col("score")), scale=scale, least=min_score).alias("message"))
    return kept, drops


def eval_judge_requests(eval_samples: DataFrame, generations: DataFrame) -> DataFrame:
    """Judge prompts for generated answers: the three fields cut to 300 characters."""
    qa = eval_samples.select("ord", first_content("user").alias("q"), first_content("assistant").alias("ref"))
    g = qa.join(generations, "ord").where(F.col("q") != "")
    cut = lambda c: F.substring(F.coalesce(F.col(c), F.lit("")), 1, EVAL_FIELD_CHARS)
    return g.select("trial_id", "ord", fill(EVAL_PROMPT, q=cut("q"), ref=cut("ref"), gen=cut("generated")).alias("prompt"))


def judge_mean(eval_samples: DataFrame, eval_replies: DataFrame, n_prompts: int = 20) -> DataFrame:
    """Per trial: mean parsed score over the last ``n_prompts`` samples (by ``ord``) whose
    question is non-empty; 5.0 when nothing parsed. ``(trial_id, n_scored, mean_score)``."""
    last = eval_samples.orderBy(F.col("ord").desc()).limit(n_prompts)  # top-n: the feature
    asked = last.where(first_content("user") != "").select("ord")
    scored = eval_replies.join(asked, "ord").select("trial_id", eval_score(F.col("reply")).alias("score"))
    per = scored.groupBy("trial_id").agg(F.count("score").alias("n_scored"), F.avg("score").alias("_m"))
    trials = eval_replies.select("trial_id").distinct()
    return trials.join(per, "trial_id", "left").select(
        "trial_id", F.coalesce("n_scored", F.lit(0)).cast("bigint").alias("n_scored"),
        F.coalesce("_m", F.lit(EVAL_DEFAULT_MEAN)).alias("mean_score"))
