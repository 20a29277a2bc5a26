"""New reply files → clean → parse → golden check → repair → golden lines, exact dedup
within a watermark. Stateless apart from the dedup state, which the watermark bounds.

A second attempt counts as it comes: it is only made where the first did not parse."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from chatloom.functions import canonical_text
from chatloom.operators.replies import explode_items, parse_replies
from chatloom.operators.validate import repair
from chatloom.sources.jsonl import golden_line

REPLY_RECORD_SCHEMA = "batch_id BIGINT, attempt INT, reply STRING, ts TIMESTAMP"


def ingest_plan(replies: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """The streaming (or batch) plan: valid samples with their golden line and key."""
    parsed = parse_replies(replies, keys=("batch_id", "attempt", "ts"))
    items = explode_items(parsed.where(F.col("status").isin("ok", "salvaged")), keys=("batch_id", "attempt", "ts"))
    valid = repair(items.where("valid")).where(F.col("drop_code").isNull()).withColumn("messages", F.col("repaired"))
    valid = valid.drop("repaired", "drop_code", "drop_detail", "warnings").withColumn("canon_sha", F.sha2(canonical_text("messages"), 256))
    if replies.isStreaming:
        valid = valid.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["canon_sha"])
    else:
        valid = valid.dropDuplicates(["canon_sha"])
    return valid.select("batch_id", "attempt", "pos", "ts", "canon_sha", F.size("messages").alias("n_messages"),
                        F.md5(canonical_text("messages")).alias("canon_md5"),
                        golden_line(F.col("id"), F.col("messages")).alias("value"))


def start_reply_ingest(spark: SparkSession, source_dir: str, sink_dir: str, checkpoint_dir: str,
                       watermark: str = "1 hour", available_now: bool = True) -> StreamingQuery:
    """Start S1 over JSON-lines reply records (``batch_id, attempt, reply, ts``)."""
    src = spark.readStream.schema(REPLY_RECORD_SCHEMA).json(source_dir)
    writer = (ingest_plan(src, watermark).writeStream.format("parquet").option("path", sink_dir)
              .option("checkpointLocation", checkpoint_dir).outputMode("append"))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()
