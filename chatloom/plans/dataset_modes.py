"""The three dataset modes as compositions of operators (P1-P3), with stage counts.

Each mode returns ``(dataset, funnel)``: the final samples with ids and a small
``(stage_no, stage, n)`` table. What a later stage reads twice is saved once in the shared folder, and rows are
counted as they are written, so no stage and no model call runs twice; a saved stage is deleted when the last one that
reads it is saved. An empty result is an error (``allow_empty=False``), and ``sink`` writes the golden JSONL.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from chatloom.operators import chunking, convert, dedup, inference, judge, positions, prompts, replies, validate
from chatloom.schema import MESSAGE_TEXT
from chatloom.session import TEXTS, release, saved, saved_counted, saved_parts, scratch_block, share, shares
from chatloom.sources.jsonl import write_jsonl


#: Texts that move in one exchange, about: more of them move in shares of their documents, so many at most, and the files of one go before the next.
SHARE_TEXTS, TEXT_SHARES = 1 << 14, 4


def funnel(spark: SparkSession, stages: list[tuple[str, int]]) -> DataFrame:
    """The stages' counts as a small table; they were observed as the stages were written."""
    return spark.createDataFrame([(i, name, n) for i, (name, n) in enumerate(stages)], "stage_no int, stage string, n long")


def _repaired(samples: DataFrame, allow_empty: bool, stages: Callable[[], list[tuple[str, int]]]) -> tuple[DataFrame, list[tuple[str, int]]]:
    """Repaired samples, saved, and the stages with their count; ``stages`` is asked when they are written."""
    repaired, n = saved_counted(validate.validate_and_repair(samples, keep_id=False), "mode-validated", TEXTS)
    counted = [*stages(), ("validated", n)]
    if not n and not allow_empty:
        raise RuntimeError(f"{MESSAGE_TEXT['empty_dataset']} ({', '.join(f'{stage}={count}' for stage, count in counted)})")
    return repaired, counted


def _finish(repaired: DataFrame, stages: list[tuple[str, int]], sink: str | None) -> tuple[DataFrame, DataFrame]:
    final = positions.assign_ids(repaired).drop("pos")
    if sink:
        write_jsonl(final, sink)
    return final, funnel(repaired.sparkSession, stages)


def _check_similarity(similarity: float) -> None:
    if not (0.0 < similarity <= 1.0):
        raise ValueError(f"similarity_threshold must be in (0.0, 1.0], got {similarity!r}")


def _dedup_gate(filtered: DataFrame, counts: dict[str, int], gate: Callable[[DataFrame], DataFrame], similarity: float,
                allow_empty: bool) -> tuple[DataFrame, list[tuple[str, int]]]:
    """Near dedup, ``gate`` and repair of filtered samples, which go when they are read; gate and repair are one write."""
    with scratch_block(filtered.sparkSession) as keep:
        kept, n_kept = dedup.deduped(filtered, similarity)
        keep(kept)
    release(filtered)
    seen = Observation()
    gated = gate(kept).observe(seen, F.count(F.lit(1)).alias("n"))
    found = [("acquired", counts["before"]), ("length_filter", counts["filtered"]), ("dedup", n_kept)]
    return _repaired(gated, allow_empty, lambda: [*found, ("quality_gate", int(seen.get["n"]))])


def filter_dedup_gate(acquired: DataFrame, gate: Callable[[DataFrame], DataFrame], similarity: float = 0.85, min_assistant_chars: int = 50,
                      sink: str | None = None, allow_empty: bool = False) -> tuple[DataFrame, DataFrame]:
    """Length filter, near dedup, ``gate`` and repair of acquired samples; each stage runs once and is counted as it is written."""
    _check_similarity(similarity)
    with scratch_block(acquired.sparkSession) as keep:
        repaired, stages = _dedup_gate(*dedup.length_filtered([acquired], min_assistant_chars), gate, similarity, allow_empty)
        keep(repaired)
    return _finish(repaired, stages, sink)


def _judged(samples: DataFrame, requests: list[Callable[[], DataFrame]], model: Callable[..., str], min_score: float, scale: int) -> DataFrame:
    """Samples whose judge reply reaches the score; a failed or unreadable reply counts as the middle. Requests come in parts."""
    asked = [lambda part=part: inference.inference_hook(part(), model, ["ord"], system_col=None, temperature=0.0) for part in requests]
    answers = saved_parts(samples.sparkSession, asked, "mode-judged")
    return judge.quality_gate(samples, answers, min_score, scale)[0].drop("score")


def generated_replies(topics: DataFrame, model: Callable[..., str], batch_size: int = 10) -> DataFrame:
    """``(batch_id, attempt, reply)``: one call per batch of a topic, and a second one with the
    failed reply where the first did not parse."""
    requests = positions.dense_positions_by(prompts.generation_requests(topics, batch_size), ["topic", "call_idx"], "batch_id")
    requests = saved(requests, "mode-requests")
    first = saved(inference.inference_hook(requests, model, ["batch_id"], temperature=0.8, response_format="json").withColumn("attempt", F.lit(1)), "mode-replies")
    status = replies.parse_replies(first).select("batch_id", "status").join(first.select("batch_id", "reply"), "batch_id")
    again = prompts.retry_requests(requests, status)
    second = inference.inference_hook(again, model, ["batch_id"], failed_reply_col="failed_reply", retry_prompt_col="retry_prompt",
                                      temperature=0.5, response_format="json").withColumn("attempt", F.lit(2))
    return saved(first.unionByName(second).select("batch_id", "attempt", "reply"), "mode-all-replies")


def generate_mode(stored_replies: DataFrame, num_samples: int | None, judge_replies: DataFrame | None = None,
                  judge_model: Callable[..., str] | None = None, similarity: float = 0.85, min_assistant_chars: int = 50,
                  min_score: float = 3.0, scale: int = 5, sink: str | None = None, allow_empty: bool = False) -> tuple[DataFrame, DataFrame]:
    """Generation replies (stored, or from :func:`generated_replies`) → parse/retry/quota →
    length filter + near dedup → judge gate → repair → ids. A sample's ``ord`` is its rank in
    (batch, position) order; ``num_samples=None`` takes all. The gate asks ``judge_model``, or
    reads ``judge_replies`` (by ``ord``); without either, all pass."""
    merged = saved(replies.retry_merge(replies.parse_replies(stored_replies)), "mode-merged")
    first = replies.first_n_samples(merged, num_samples)
    acquired = positions.dense_positions_by(first, ["batch_id", "pos"]).select("ord", "id", "messages")

    def gate(samples: DataFrame) -> DataFrame:
        if judge_model is not None:
            return _judged(samples, [lambda: prompts.judge_requests(samples, scale)], judge_model, min_score, scale)
        return samples if judge_replies is None else judge.quality_gate(samples, judge_replies, min_score, scale)[0].drop("score")

    return filter_dedup_gate(acquired, gate, similarity, min_assistant_chars, sink, allow_empty)


def structure_mode(raw_texts: DataFrame, model: Callable[..., str], num_samples: int = 50, judge_replies: DataFrame | None = None,
                   judge_model: Callable[..., str] | None = None, grounding: str = "chunk", similarity: float = 0.85,
                   min_assistant_chars: int = 50, min_score: float = 3.0, scale: int = 5, sink: str | None = None,
                   allow_empty: bool = False) -> tuple[DataFrame, DataFrame]:
    """Raw texts ``(doc_id, text)`` → chunks → extraction requests → model → parse →
    first ``num_samples`` per text → length filter + near dedup → judge gate → repair.

    Blank texts are left out. The gate asks ``judge_model`` with each sample's chunk
    (``grounding="chunk"``) or the head of its text (``"head"``), or reads ``judge_replies`` (by
    ``doc_id``); without either, all pass.
    """
    _check_similarity(similarity)
    docs = raw_texts.where(~chunking.is_blank(F.col("text")))
    spark = raw_texts.sparkSession
    with scratch_block(spark) as keep:
        chunks, n = saved_counted(chunking.chunk_text(docs), "mode-chunks", TEXTS)
        of, place = shares(n, SHARE_TEXTS, TEXT_SHARES), ["doc_id", "chunk_idx", "pos"]

        def collected(i: int) -> DataFrame:
            reqs = prompts.structure_requests(share(chunks, "doc_id", i, of), num_samples)
            out = inference.inference_hook(reqs, model, ["doc_id", "chunk_idx"], max_tokens_col="max_tokens", temperature=0.3, response_format="json")
            return inference.extraction_collect(out, num_samples)[0]

        samples = saved_parts(spark, [partial(collected, i) for i in range(of)], "mode-samples", TEXTS)
        keys = saved(samples.select(*place), "mode-keys")
        acquired = positions.dense_positions_by(samples, place, keys=keys).select("doc_id", "ord", "id", "messages")
        filtered, counts = dedup.length_filtered([share(acquired, "doc_id", i, of) for i in range(of)], min_assistant_chars)
        release(samples)

        def gate(kept: DataFrame) -> DataFrame:
            # positions follow from the keys alone
            origin = positions.dense_positions_by(keys, place, keys=keys).select("ord", "doc_id", "chunk_idx")
            if judge_model is not None:
                sources = chunks.select("doc_id", "chunk_idx", F.col("chunk").alias("text")) if grounding == "chunk" else docs
                on = ["doc_id", "chunk_idx"] if grounding == "chunk" else ["doc_id"]

                def asked(i: int) -> DataFrame:
                    grounds = share(origin, "doc_id", i, of).join(share(sources, "doc_id", i, of), on)
                    return prompts.judge_requests(share(kept, "doc_id", i, of), scale, grounds, grounding=grounding)

                return _judged(kept, [partial(asked, i) for i in range(of)], judge_model, min_score, scale)
            if judge_replies is None:
                return kept
            named = kept.drop("doc_id").join(origin.select("ord", "doc_id"), "ord")
            return judge.quality_gate(named, judge_replies, min_score, scale, key="doc_id")[0].select("ord", "id", "messages")

        repaired, stages = _dedup_gate(filtered, counts, gate, similarity, allow_empty)
        keep(repaired)
    return _finish(repaired, stages, sink)


def bring_your_own_mode(records: DataFrame, max_samples: int | None = None, sink: str | None = None,
                        allow_empty: bool = False) -> tuple[DataFrame, DataFrame]:
    """Foreign records (with ``ord``) → golden messages → repair → ids; no dedup, no gate.
    Unrecognized records are skipped (the funnel counts both); records that give nothing are an error."""
    conv, n = saved_counted(convert.convert_records(records, max_samples), "mode-converted", converted=F.count("messages"))
    if not allow_empty and not n["converted"]:
        raise RuntimeError(f"no record of {n['n']} could be converted")
    acquired = conv.where(F.col("messages").isNotNull()).select("ord", F.lit("").alias("id"), "messages")
    return _finish(*_repaired(acquired, allow_empty, lambda: [("records", n["n"]), ("converted", n["converted"])]), sink)


def bring_your_own_files(spark: SparkSession, path: str, sink: str | None = None, allow_empty: bool = False) -> tuple[DataFrame, DataFrame]:
    """P3 from files: ``.jsonl`` or ``.json``, records of any known shape."""
    from chatloom.sources.jsonl import load_dataset

    samples, n = saved_counted(load_dataset(spark, path)[0], "mode-loaded")
    return _finish(*_repaired(samples.select("ord", "id", "messages"), allow_empty, lambda: [("loaded", n)]), sink)
