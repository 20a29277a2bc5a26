"""Inference hook (E12): run a user-supplied text-model callable over a request table.

The callable has the chat protocol ``fn(messages, model=, temperature=, max_tokens=, format=) -> str``. It runs in
``mapInPandas`` tasks, so requests are spread over the cluster; failures become an
``error`` value on the row instead of failing the task.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatloom.session import TEXTS, saved, ship_package


def inference_hook(requests: DataFrame, fn: Callable[..., str], keys: list[str], prompt_col: str = "prompt",
                   system_col: str | None = "system_prompt", max_tokens_col: str | None = None, retries: int = 0,
                   failed_reply_col: str | None = None, retry_prompt_col: str | None = None, model: str | None = None,
                   temperature: float | None = None, response_format: str | None = None) -> DataFrame:
    """``keys + (reply STRING, error STRING)``; ``reply`` is NULL when the call failed.

    ``fn(messages, **options)`` gets the options that are given: ``model``, ``temperature``,
    ``format`` and, per row, ``max_tokens``. With ``failed_reply_col`` and ``retry_prompt_col``
    the conversation goes on with the failed reply and the retry instruction.
    """
    ship_package(requests.sparkSession)
    extra = [c for c in (system_col, max_tokens_col, failed_reply_col, retry_prompt_col) if c]
    src = requests.select(*keys, prompt_col, *extra)
    key_schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in src.schema.fields if f.name in keys)
    fixed = {k: v for k, v in (("model", model), ("temperature", temperature), ("format", response_format)) if v is not None}

    def ask(row: dict) -> tuple[str | None, str | None]:
        turns = [("system", system_col), ("user", prompt_col), ("assistant", failed_reply_col), ("user", retry_prompt_col)]
        messages = [{"role": role, "content": row[c]} for role, c in turns if c]
        options = fixed | ({"max_tokens": int(row[max_tokens_col])} if max_tokens_col else {})
        error = None
        for _ in range(retries + 1):
            try:
                return fn(messages, **options), None
            except Exception as exc:  # noqa: BLE001 - the hook reports, the caller decides
                error = f"{type(exc).__name__}: {exc}"
        return None, error

    def run(batches):
        for pdf in batches:
            answers = [ask(row) for row in pdf.to_dict("records")]
            yield pdf[list(keys)].assign(reply=[r for r, _ in answers], error=[e for _, e in answers])

    return src.mapInPandas(run, f"{key_schema}, reply string, error string")


def passage_echo_model(messages, **options) -> str:
    """Deterministic stand-in model for tests and registered queries: asks what the passage says
    and answers with the whole passage. By the passage's length some calls fail (length % 7 == 2)
    and some replies are prose (length % 5 == 3)."""
    passage = messages[1]["content"].split("PASSAGE:\n", 1)[-1]
    if len(passage) % 7 == 2:
        raise RuntimeError("model not reached")
    if len(passage) % 5 == 3:
        return "Sorry, no pairs for this passage."
    sample = {"messages": [{"role": "user", "content": "What does this passage say?"},
                           {"role": "assistant", "content": passage}]}
    return json.dumps([sample], ensure_ascii=False)


def length_judge_model(messages, **options) -> str:
    """Deterministic stand-in judge: 1 to 5 by the length of the prompt."""
    return f"Score: {1 + len(messages[-1]['content']) % 5}"


def extraction_collect(replies: DataFrame, num_samples: int = 50, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """Parse chunk replies; failed chunks are skipped (no retry); first ``num_samples``
    valid samples per document by (chunk_idx, pos). Returns (samples, skipped chunks), both read
    from one saved parse, so the model is called once.

    A document has at most a few samples per chunk; its window is bounded by one text.
    """
    from pyspark.sql import Window

    from chatloom.operators.replies import explode_items, parse_replies

    replies = saved(replies, "extraction-replies", TEXTS)
    parsed = parse_replies(replies, keys=(key, "chunk_idx"))
    ok = parsed.where(F.col("status").isin("ok", "salvaged"))
    skipped = parsed.where(~F.col("status").isin("ok", "salvaged")).select(key, "chunk_idx", "status")
    items = explode_items(ok, keys=(key, "chunk_idx")).where("valid")
    w = Window.partitionBy(key).orderBy("chunk_idx", "pos")
    first = items.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= num_samples).drop("_rn")
    return first.select(key, "chunk_idx", "pos", "id", "messages"), skipped
