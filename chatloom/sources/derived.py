"""Operator inputs derived from the driver tables (the same derivations the oracle SQL uses).

Each derivation is a plain projection/aggregation of a driver table, so the work of every
query grows with the tables. Damage rules (aliases, blanks, broken replies) are fixed,
deterministic functions of the row keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatloom.operators.convert import nest_turns
from chatloom.sources.tables import table


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conversations`` nested per ``conv_id`` (ordered by ``turn``); ``ord = conv_id``."""
    return nest_turns(table(spark, sf_dir, "conversations"))


def dirty_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turn table with meaning-keeping damage: role aliases, blank and padded content, tool turns."""
    c = table(spark, sf_dir, "conversations")
    k = F.col("conv_id") + F.col("turn")
    alias_user = F.element_at(F.array(F.lit("user"), F.lit("human"), F.lit(" User "), F.lit("USER")), (k % 4 + 1).cast("int"))
    alias_asst = F.element_at(F.array(F.lit("assistant"), F.lit("GPT"), F.lit("bot"), F.lit("Assistant")), (k % 4 + 1).cast("int"))
    role = (F.when(k % 11 == 0, F.lit("tool"))
            .when(F.col("role") == "user", alias_user)
            .when(F.col("role") == "assistant", alias_asst)
            .otherwise(F.col("role")))
    content = (F.when(k % 7 == 0, F.when(F.col("turn") % 2 == 0, F.lit("")).otherwise(F.lit("   ")))
               .when(F.col("turn") % 3 == 0, F.concat(F.lit("  "), F.col("text"), F.lit("\u00a0")))
               .otherwise(F.col("text")))
    return c.select("conv_id", "turn", role.alias("role"), content.alias("text"))


def dirty_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nest_turns(dirty_turns(spark, sf_dir))


def document_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dedup set: ``messages = [user: source, assistant: text]``, ``ord = doc_id``."""
    d = table(spark, sf_dir, "documents")
    msgs = F.array(
        F.struct(F.lit("user").alias("role"), F.col("source").alias("content")),
        F.struct(F.lit("assistant").alias("role"), F.col("text").alias("content")),
    )
    return d.select(F.col("doc_id").alias("ord"), F.lit("").alias("id"), msgs.alias("messages"))


def document_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(ord, text)`` from ``documents`` for text-only dedup and chunking."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ord"), "text")


# ---------------------------------------------------------------------------
# Stored replies: one generation batch per conversation, damaged by conv_id % 8
# ---------------------------------------------------------------------------

BAD_ITEM = '{"messages":[{"role":"user","content":5}]}'
NO_JSON_REPLY = "I could not produce the JSON, sorry."
NON_OBJECT_REPLY = "[1, 2]"
TRUNCATED_TAIL = ',{"messages":[{"role":"user","content":"cut off'


def damaged_reply(conv_id: F.Column, messages: F.Column) -> F.Column:
    sample = F.to_json(F.struct(messages.alias("messages")))
    cls = conv_id % 8
    arr = F.concat(F.lit("["), sample, F.when((cls == 0) & (conv_id % 3 == 0), F.lit("," + BAD_ITEM)).otherwise(F.lit("")), F.lit("]"))
    n = F.length(arr)
    return (F.when(cls == 1, F.concat(F.lit("```json\n"), arr, F.lit("\n```")))
            .when(cls == 2, F.concat(F.lit("Here are the examples:\n"), arr, F.lit("\nHope this helps!")))
            .when(cls == 3, F.concat(arr.substr(F.lit(1), n - 4), F.lit("},]},,]")))
            .when(cls == 4, F.to_json(messages))
            .when(cls == 5, F.concat(F.lit("[ // batch of samples\n"), arr.substr(F.lit(2), n)))
            .when(cls == 6, F.concat(arr.substr(F.lit(1), n - 1), F.lit(TRUNCATED_TAIL)))
            .when(cls == 7, F.replace(arr, F.lit('"content":"'), F.lit('"content":"\\p')))
            .otherwise(arr))


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(topic, batch_id, attempt, reply)``; NULL reply = failed call (never retried)."""
    s = samples(spark, sf_dir)
    c = F.col("ord")
    dmg = damaged_reply(c, F.col("messages"))
    first = F.struct(F.lit(1).alias("attempt"), dmg.alias("reply"))
    failed_call = F.array(F.struct(F.lit(1).alias("attempt"), F.lit(None).cast("string").alias("reply")))
    retry = F.array(
        F.struct(F.lit(1).alias("attempt"), F.lit(NO_JSON_REPLY).alias("reply")),
        F.struct(F.lit(2).alias("attempt"), F.when(c % 3 == 0, F.lit(NON_OBJECT_REPLY)).otherwise(dmg).alias("reply")),
    )
    attempts = F.when(c % 13 == 12, failed_call).when(c % 5 == 4, retry).otherwise(F.array(first))
    return s.select(
        F.concat(F.lit("topic-"), (c % 4).cast("string")).alias("topic"), c.alias("batch_id"),
        F.explode(attempts).alias("a")).select("topic", "batch_id", "a.attempt", "a.reply")


def topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generation topics: one per (source, lang) of ``documents``; quota = its document count."""
    d = table(spark, sf_dir, "documents")
    return d.groupBy(F.concat("source", F.lit("/"), "lang").alias("topic")).agg(F.count(F.lit(1)).alias("num_samples"))


def judge_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gate replies ``(ord, reply)`` from ``labels``; score = 1 + 4*quality - toxic, in
    varied wording; one in five replies carries no number."""
    lab = table(spark, sf_dir, "labels")
    s = (F.lit(1) + F.col("quality") * 4 - F.col("toxic")).cast("string")
    k = F.col("doc_id") % 5
    reply = (F.when(k == 0, F.lit("No score given."))
             .when(k == 1, F.concat(F.lit("Score: "), s))
             .when(k == 2, F.concat(s, F.lit("/5")))
             .when(k == 3, F.concat(F.lit("I rate it -"), s))
             .otherwise(F.concat(F.lit("score"), s, F.lit("0"))))
    return lab.select(F.col("doc_id").alias("ord"), reply.alias("reply"))


def eval_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation dataset: document samples of labelled documents."""
    lab = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("ord"))
    return document_samples(spark, sf_dir).join(lab, "ord", "left_semi")


def generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generated answers ``(trial_id, ord, generated)`` of three trials: the text behind its trial's number, none for one in seven."""
    s = eval_samples(spark, sf_dir).select("ord", F.get("messages", 1)["content"].alias("text"), F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("trial_id"))
    text = F.when((F.col("ord") + F.col("trial_id")) % 7 == 3, F.lit(None)).otherwise(F.concat(F.lit("trial "), F.col("trial_id").cast("string"), F.lit(": "), F.col("text")))
    return s.select(F.col("trial_id").cast("int").alias("trial_id"), "ord", text.alias("generated"))


def eval_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eval judge replies ``(trial_id, ord, reply)``: three trials per labelled document."""
    lab = table(spark, sf_dir, "labels")
    t = lab.select("doc_id", "quality", "toxic", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("trial_id"))
    s = (F.lit(2) + F.col("quality") * 5 - F.col("toxic") + F.col("trial_id")).cast("string")
    k = (F.col("doc_id") + F.col("trial_id")) % 5
    reply = (F.when(k == 0, F.lit("n/a"))
             .when(k == 1, F.concat(F.lit("Score: "), s))
             .when(k == 2, F.concat(s, F.lit("/10")))
             .when(k == 3, F.concat(F.lit("score"), s))
             .otherwise(F.concat(F.lit("I give it "), s, F.lit(".5 out of 10"))))
    return t.select(F.col("trial_id").cast("int").alias("trial_id"), F.col("doc_id").alias("ord"), reply.alias("reply"))


# ---------------------------------------------------------------------------
# Trial log from ``events``: run = user, trial = order by (ts, event_id)
# ---------------------------------------------------------------------------

def recipe_diff_text(event_type: F.Column, k: F.Column) -> F.Column:
    ks = k.cast("string")
    return (F.when((event_type == "view") & (k % 10 == 0), F.lit("{}"))
            .when(event_type == "view", F.concat(F.lit('{"lora_rank": '), ks, F.lit("}")))
            .when(event_type == "click", F.concat(F.lit('{"learning_rate": '), F.format_string("%.4f", k / 10000.0), F.lit("}")))
            .when(event_type == "purchase", F.concat(F.lit('{"scheduler": "linear", "lora_alpha": '), (k * 11).cast("string"), F.lit("}")))
            .when((event_type == "signup") & (k % 3 == 0), F.lit('{"lora_rank": true}'))
            .when((event_type == "signup") & (k % 3 == 1), F.lit('{"target_modules": []}'))
            .when(event_type == "signup", F.lit('{"scheduler": "step"}'))
            .otherwise(F.concat(F.lit('{"dropout": 0.'), ks, F.lit("}"))))


def trial_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One trial per event; ``eval_bpb = value`` or +inf for ``error`` events; ``kept`` is
    the running-best flag as the tuning loop logs it."""
    from chatloom.operators.trials import running_best

    return running_best(trial_log_base(spark, sf_dir)).withColumnRenamed("is_best", "kept").drop("best_before")


def trial_log_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trial log without the ``kept`` flag; trial ids are positions in (ts, event_id)
    order inside each user's run (no per-run window)."""
    from chatloom.operators.positions import group_positions

    e = group_positions(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "_trial")
    k = F.get_json_object("props", "$.k").cast("int")
    log = e.select(
        F.concat(F.lit("run-"), F.col("user_id").cast("string")).alias("run_id"),
        F.col("_trial").cast("int").alias("trial_id"),
        recipe_diff_text(F.col("event_type"), k).alias("recipe_diff"),
        F.when(F.col("event_type") == "error", F.lit(float("inf"))).otherwise(F.col("value")).alias("eval_bpb"),
        F.lit(None).cast("double").alias("judge_score"),
        (F.col("value") * 3).alias("wall_clock_secs"),
        k.alias("steps"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'").alias("timestamp"),
    )
    return log


def losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-sample eval losses: trial = user, loss = value / 100, tokens = event_id % 50."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("trial_id"), F.col("event_id").alias("ord"),
                    (F.col("value") / 100).alias("loss"), (F.col("event_id") % 50).alias("n_tokens"))


# ---------------------------------------------------------------------------
# Record shapes, golden lines and source strings
# ---------------------------------------------------------------------------

def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Foreign record shapes from ``documents`` by ``doc_id % 7`` (6 = unrecognized)."""
    d = table(spark, sf_dir, "documents")
    k = F.col("doc_id") % 7
    msg = lambda r, c: F.struct(F.lit(r).alias("role"), c.alias("content"))
    turn = lambda f, v: F.struct(f.alias("from"), v.alias("value"))
    conv = F.array(turn(F.when(F.col("doc_id") % 2 == 0, F.lit("Human")).otherwise(F.lit("human")), F.col("source")),
                   turn(F.lit("gpt"), F.col("text")))
    conv = F.when(F.col("doc_id") % 5 == 0, F.concat(conv, F.array(turn(F.lit("narrator"), F.col("lang"))))).otherwise(conv)
    s = lambda cond, v: F.when(cond, v)
    return d.select(
        F.col("doc_id").alias("ord"),
        s(k == 0, F.array(msg("user", F.col("source")), msg("assistant", F.col("text")))).alias("messages"),
        s(k == 1, conv).alias("conversations"),
        s(k == 2, F.col("source")).alias("instruction"),
        s(k == 2, F.when(F.col("doc_id") % 2 == 0, F.col("lang")).otherwise(F.lit("  "))).alias("input"),
        s(k == 2, F.col("text")).alias("output"),
        s((k == 3) | (k == 4), F.col("source")).alias("prompt"),
        s(k == 3, F.col("text")).alias("response"),
        s(k == 4, F.col("text")).alias("completion"),
        s(k == 5, F.col("source")).alias("question"),
        s(k == 5, F.col("text")).alias("answer"),
        s(k == 6, F.col("text")).alias("text"),
    )


def golden_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Golden JSONL text per conversation, damaged by ``conv_id % 9`` (shape errors and
    accepted variants: no id, numeric id, double-nested list, ``[[]]``)."""
    s = samples(spark, sf_dir)
    c = F.col("ord")
    k = c % 9
    msgs_json = F.to_json(F.col("messages"))
    ident = F.concat(F.lit('"conv-'), c.cast("string"), F.lit('"'))
    first_as_number = F.regexp_replace(
        msgs_json, r'^\[\{"role":"([a-z]+)","content":"[^"\\]*+(?:\\.[^"\\]*+)*+"', '[{"role":"$1","content":7')
    no_role = F.regexp_replace(msgs_json, r'^\[\{"role":"[a-z]+",', "[{")
    body = (F.when(k == 1, F.concat(F.lit('{"messages":'), msgs_json, F.lit("}")))
            .when(k == 2, F.concat(F.lit('{"id":42,"messages":'), msgs_json, F.lit("}")))
            .when(k == 3, F.concat(F.lit('{"id":'), ident, F.lit(',"messages":'), first_as_number, F.lit("}")))
            .when(k == 4, F.concat(F.lit('{"id":'), ident, F.lit(',"messages":'), no_role, F.lit("}")))
            .when(k == 5, F.concat(F.lit('{"id":'), ident, F.lit(',"messages":"hello"}')))
            .when(k == 6, F.concat(F.lit('{"id":'), ident, F.lit(',"messages":[]}')))
            .when(k == 7, F.concat(F.lit('{"id":'), ident, F.lit(',"messages":['), msgs_json, F.lit("]}")))
            .when(k == 8, F.concat(F.lit('{"id":'), ident, F.lit(',"messages":[[]]}')))
            .otherwise(F.concat(F.lit('{"id":'), ident, F.lit(',"messages":'), msgs_json, F.lit("}"))))
    return s.select("ord", body.alias("line"))


def sources_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source strings: page URLs, hub-like ids ``source/lang``, three-part ids and local names."""
    pages = table(spark, sf_dir, "pages").select(F.col("url").alias("source"))
    d = table(spark, sf_dir, "documents").select("source", "lang").distinct()
    hub = d.select(F.concat("source", F.lit("/"), "lang").alias("source"))
    three = d.select(F.concat("source", F.lit("/"), "lang", F.lit("/validation")).alias("source"))
    local = d.select(F.concat("source", F.lit(".jsonl")).alias("source"))
    return pages.unionByName(hub).unionByName(three).unionByName(local).distinct()
