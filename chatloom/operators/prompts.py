"""Request tables for the text model: extraction (E9), generation (E11), judging (F1), cost.

Prompt wording is this package's own; only the placeholders, truncation and order matter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatloom.functions import fill, first_content
from chatloom.schema import CHARS_PER_TOKEN, PRICE_PER_1K_TOKENS

EXTRACT_SYSTEM = ("You turn source text into fine-tuning data. Read the passage and write question-and-answer "
                  "pairs taken from it. Answer with a JSON array only, with nothing before or after it.")
EXTRACT_USER = ("Read the passage below and write up to {n} question-and-answer pairs grounded in it.\n\n"
                "Return a JSON array; each element is an object whose \"messages\" list holds "
                "{{\"role\", \"content\"}} objects: the question with role \"user\", the answer with role \"assistant\".\n\n"
                "PASSAGE:\n{chunk}")
GENERATE_SYSTEM = "You are a data generator whose output is read by a JSON parser. Send the array and nothing else."
GENERATE_USER = ("subject: {topic}\nconversations wanted: {batch_size}\n"
                 "shape: [{{\"messages\": [{{\"role\": \"user\", \"content\": ...}}, {{\"role\": \"assistant\", \"content\": ...}}]}}, ...]\n"
                 "Fill the shape with varied conversations on the subject.")
RETRY_USER = "That could not be parsed as JSON. Send the same data again as one plain JSON array."
JUDGE_SELF = ("[question]\n{q}\n[answer]\n{a}\n"
              "[task] Give the answer 1 (unusable) to {scale} (excellent) points. Output one number.")
JUDGE_GROUNDED = ("[source]\n{source}\n[question]\n{q}\n[answer]\n{a}\n"
                  "[task] Give 1 (made up) to {scale} (fully backed by the source) points. Output one number.")
SOURCE_CHARS = 3000


def structure_requests(chunks: DataFrame, num_samples: int = 50, key: str = "doc_id") -> DataFrame:
    """Per chunk: quota ``max(1, num_samples // n_chunks)``, ``max_tokens = max(2048, quota*300)``, prompt."""
    per = F.greatest(F.lit(1), F.floor(F.lit(num_samples) / F.col("n_chunks"))).cast("int")
    return chunks.select(
        key, "chunk_idx", "n_chunks", per.alias("per_chunk"),
        F.greatest(F.lit(2048), per * 300).cast("int").alias("max_tokens"),
        F.lit(EXTRACT_SYSTEM).alias("system_prompt"),
        fill(EXTRACT_USER, n=per, chunk=F.col("chunk")).alias("prompt"),
        "chunk",
    )


def generation_requests(topics: DataFrame, batch_size: int = 10, topic_col: str = "topic", n_col: str = "num_samples") -> DataFrame:
    """``ceil(n / batch)`` calls per topic; call ``i`` asks for ``min(batch, n - i*batch)``."""
    if batch_size < 1:
        raise ValueError("batch_size must be at least 1")
    n = F.col(n_col)
    calls = F.sequence(F.lit(0), (F.ceil(n / F.lit(batch_size)) - 1).cast("int"))
    t = topics.where(n >= 1).select(topic_col, n_col, F.explode(calls).alias("call_idx"))
    size = F.least(F.lit(batch_size), n - F.col("call_idx") * batch_size).cast("int")
    return t.select(topic_col, F.col("call_idx").cast("int").alias("call_idx"), size.alias("batch_size"),
                    F.lit(GENERATE_SYSTEM).alias("system_prompt"),
                    fill(GENERATE_USER, batch_size=size, topic=F.col(topic_col)).alias("prompt"))


def judge_requests(samples: DataFrame, scale: int = 5, sources: DataFrame | None = None, source_key: str = "ord",
                   source_text: str = "text", grounding: str = "head") -> DataFrame:
    """Mode 0 (self): question + answer. Mode 1 (grounded): plus the sample's source, joined on
    ``source_key``: its first 3000 characters (``grounding="head"``) or, where ``sources`` holds the
    chunk that each sample was made from, that whole chunk (``grounding="chunk"``)."""
    if grounding not in ("head", "chunk"):
        raise ValueError(f"grounding must be 'head' or 'chunk', got {grounding!r}")
    qa = samples.select("ord", first_content("user").alias("q"), first_content("assistant").alias("a"))
    if sources is None:
        return qa.select("ord", F.lit(0).alias("mode"), fill(JUDGE_SELF, scale=scale, q=F.col("q"), a=F.col("a")).alias("prompt"))
    text = F.substring(source_text, 1, SOURCE_CHARS) if grounding == "head" else F.col(source_text)
    src = sources.select(F.col(source_key).alias("ord"), text.alias("src"))
    g = qa.join(src, "ord", "left").fillna({"src": ""})
    return g.select("ord", F.lit(1).alias("mode"),
                    fill(JUDGE_GROUNDED, scale=scale, source=F.col("src"), q=F.col("q"), a=F.col("a")).alias("prompt"))


def retry_requests(requests: DataFrame, parsed: DataFrame, key: str = "batch_id") -> DataFrame:
    """Second calls for replies that came but did not parse: the request with the failed reply
    and an instruction behind it (``failed_reply``, ``retry_prompt``). Failed calls are not retried.

    ``parsed`` has ``key, status, reply``.
    """
    failed = parsed.where(~F.col("status").isin("ok", "salvaged", "call_failed")).select(key, F.col("reply").alias("failed_reply"))
    return requests.join(failed, key).withColumn("retry_prompt", F.lit(RETRY_USER))


def request_cost(requests: dict[str, DataFrame]) -> DataFrame:
    """Per request kind: calls, prompt characters, tokens ≈ chars/3.8, price per 1k tokens."""
    parts = [df.select(F.lit(kind).alias("kind"), F.length("prompt").alias("chars")) for kind, df in requests.items()]
    allr = parts[0]
    for p in parts[1:]:
        allr = allr.unionByName(p)
    agg = allr.groupBy("kind").agg(F.count(F.lit(1)).alias("n_calls"), F.sum("chars").alias("prompt_chars"))
    tokens = F.col("prompt_chars") / F.lit(CHARS_PER_TOKEN)
    return agg.select("kind", "n_calls", F.col("prompt_chars").cast("bigint").alias("prompt_chars"),
                      tokens.alias("est_tokens"), (tokens / 1000 * F.lit(PRICE_PER_1K_TOKENS)).alias("est_cost"))
