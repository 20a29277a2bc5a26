"""Tail of trial logs → best bpb, best trial and counts per run (update mode).

Keyed state is one row per run. Updates go through ``foreachBatch`` into an append-only
parquet table tagged with the micro-batch id; the current view is the latest row per run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from chatloom.operators.trials import INF, bpb_key
from chatloom.sources.trial_log import parse_trial_lines, trial_lines


def tail_plan(log: DataFrame) -> DataFrame:
    m = log.withColumn("_m", bpb_key(F.col("eval_bpb")))
    finite = F.col("_m") < F.lit(INF)
    return m.groupBy("run_id").agg(
        F.min("_m").alias("best_bpb"),
        F.min_by("trial_id", F.when(finite, F.struct("_m", "trial_id"))).alias("best_trial_id"),
        F.count(F.lit(1)).alias("trials_logged"),
        F.max("trial_id").alias("last_trial"),
    )


def start_trial_tail(spark: SparkSession, log_dir: str, sink_dir: str, checkpoint_dir: str,
                     available_now: bool = True) -> StreamingQuery:
    """Start S2 over log files or a bundle of them; lines are read by the rules of the batch reader."""
    runs = parse_trial_lines(trial_lines(spark.readStream, log_dir))

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("micro_batch", F.lit(batch_id)).write.mode("append").parquet(sink_dir)

    writer = (tail_plan(runs).writeStream.outputMode("update").foreachBatch(sink)
              .option("checkpointLocation", checkpoint_dir))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()


def current_view(spark: SparkSession, sink_dir: str) -> DataFrame:
    """Latest state per run from the update table."""
    t = spark.read.parquet(sink_dir)
    latest = F.max_by(F.struct("best_bpb", "best_trial_id", "trials_logged", "last_trial"), "micro_batch")
    return t.groupBy("run_id").agg(latest.alias("s")).select("run_id", "s.*")
