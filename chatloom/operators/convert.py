"""Record conversion: turn tables, conversations records, heterogeneous record shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatloom.schema import MESSAGE_TEXT, SHAREGPT_ROLE_MAP


def nest_turns(turns: DataFrame, key: str = "conv_id", order: str = "turn", role: str = "role",
               content: str = "text", id_col: str | None = None) -> DataFrame:
    """One row per turn → one sample row ``(ord, id, messages)`` ordered by ``order``.

    The group is one conversation, i.e. one training sample; its size is bounded by the
    model context, so ``collect_list`` here never gathers more than one sample.
    """
    parts = [F.col(order).alias("k"), F.col(role).alias("role"), F.col(content).alias("content")]
    aggs = [F.array_sort(F.collect_list(F.struct(*parts))).alias("_t")]
    if id_col:
        aggs.append(F.first(id_col, ignorenulls=True).alias("id"))
    out = turns.groupBy(F.col(key).alias("ord")).agg(*aggs)
    if not id_col:
        out = out.withColumn("id", F.lit(""))
    return out.select(
        "ord", "id", F.transform("_t", lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content"))).alias("messages")
    )


def sharegpt_messages(conversations_col="conversations") -> F.Column:
    """``[{from, value}]`` → ``[{role, content}]``; unknown ``from`` kept as written.

    Returns NULL when any turn lacks ``from`` or ``value`` (the record is rejected).
    """
    table = F.create_map(*[F.lit(x) for kv in SHAREGPT_ROLE_MAP.items() for x in kv])
    conv = F.col(conversations_col) if isinstance(conversations_col, str) else conversations_col
    mapped = F.transform(
        conv,
        lambda t: F.struct(
            F.coalesce(F.element_at(table, F.lower(t["from"])), t["from"]).alias("role"),
            t["value"].alias("content"),
        ),
    )
    bad = F.exists(conv, lambda t: t["from"].isNull() | t["value"].isNull())
    return F.when(bad, F.lit(None)).otherwise(mapped)


# ---------------------------------------------------------------------------
# Record shapes → golden messages
# ---------------------------------------------------------------------------

RECORD_FIELDS = ("messages", "conversations", "instruction", "input", "output", "prompt", "response", "completion",
                 "question", "answer")


def _has(df: DataFrame, name: str) -> F.Column:
    return F.col(name).isNotNull() if name in df.columns else F.lit(False)


def _pair(user: F.Column, assistant: F.Column) -> F.Column:
    return F.array(F.struct(F.lit("user").alias("role"), user.alias("content")),
                   F.struct(F.lit("assistant").alias("role"), assistant.alias("content")))


def convert_records(records: DataFrame, max_samples: int | None = None) -> DataFrame:
    """Adds ``source_format`` and ``messages`` (NULL = unrecognized record), first match wins:
    messages → conversations → instruction+output (``\\n\\n`` + input when not blank) →
    prompt+response → prompt+completion → question+answer. A NULL field counts as absent.
    ``max_samples`` takes the first records by ``ord``."""
    from chatloom.functions import ustrip
    from chatloom.operators.positions import dense_positions

    if max_samples is not None:
        records = dense_positions(records, "ord", "_at").where(F.col("_at") < max_samples).drop("_at")

    has = lambda n: _has(records, n)
    col = lambda n: F.col(n) if n in records.columns else F.lit(None).cast("string")
    instr = col("instruction")
    inp = F.coalesce(col("input"), F.lit(""))
    instruction = F.when(ustrip(inp) != "", F.concat(instr, F.lit("\n\n"), inp)).otherwise(instr)
    fmt = (F.when(has("messages"), F.lit("messages"))
           .when(has("conversations"), F.lit("conversations"))
           .when(has("instruction") & has("output"), F.lit("instruction"))
           .when(has("prompt") & has("response"), F.lit("prompt_response"))
           .when(has("prompt") & has("completion"), F.lit("prompt_completion"))
           .when(has("question") & has("answer"), F.lit("question_answer")))
    msgs = (F.when(fmt == "messages", F.col("messages") if "messages" in records.columns else F.lit(None))
            .when(fmt == "conversations", sharegpt_messages("conversations") if "conversations" in records.columns else F.lit(None))
            .when(fmt == "instruction", _pair(instruction, col("output")))
            .when(fmt == "prompt_response", _pair(col("prompt"), col("response")))
            .when(fmt == "prompt_completion", _pair(col("prompt"), col("completion")))
            .when(fmt == "question_answer", _pair(col("question"), col("answer"))))
    return records.withColumn("source_format", F.coalesce(fmt, F.lit("unrecognized"))).withColumn("messages", msgs)


def format_census(records: DataFrame) -> DataFrame:
    """B1 as one aggregate: are all records conversations-only (and none has messages)?"""
    conv_only = _has(records, "conversations") & ~_has(records, "messages")
    return records.agg(
        F.count(F.lit(1)).alias("n_records"),
        F.count_if(conv_only).alias("n_conversations_only"),
    ).select("n_records", "n_conversations_only",
             ((F.col("n_records") > 0) & (F.col("n_conversations_only") == F.col("n_records"))).alias("all_conversations"),
             ((F.col("n_conversations_only") > 0) & (F.col("n_conversations_only") < F.col("n_records"))).alias("mixed"))


def require_single_format(records: DataFrame) -> bool:
    """Raise on a mix of conversations-only and other records; True when all are conversations."""
    row = format_census(records).first()
    if row["mixed"]:
        raise ValueError(MESSAGE_TEXT["mixed_format"])
    return bool(row["all_conversations"])
