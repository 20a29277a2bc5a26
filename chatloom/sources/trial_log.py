"""Trial-log files (A8, A9) and run snapshots (A10).

Logs are JSON lines, one file per run directory; the run id is the directory name
(``run_id=<id>`` when written partitioned by Spark, or any plain directory name). Where the path is
a bundle (:mod:`~chatloom.sources.bundles`), the files of many runs are kept in one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatloom.sources.bundles import file_of, is_bundle, unpack, write_bundle

TRIAL_SCHEMA = T.StructType([
    T.StructField("trial_id", T.LongType()),
    T.StructField("recipe_diff", T.StringType()),
    T.StructField("eval_bpb", T.DoubleType()),
    T.StructField("judge_score", T.DoubleType()),
    T.StructField("kept", T.BooleanType()),
    T.StructField("wall_clock_secs", T.DoubleType()),
    T.StructField("steps", T.LongType()),
    T.StructField("timestamp", T.StringType()),
])
# Fields without a default in the record type: a line lacking one of these keys is
# skipped (eval_bpb is filled with +inf before the record is built, so it may be absent).
REQUIRED = ("trial_id", "recipe_diff", "judge_score", "kept", "wall_clock_secs", "steps")

RUN_STATE_SCHEMA = T.StructType([
    T.StructField("run_dir", T.StringType()),
    T.StructField("base_model", T.StringType()),
    T.StructField("dataset_path", T.StringType()),
    T.StructField("started_at", T.StringType()),
    T.StructField("phase", T.StringType()),
    T.StructField("best_trial_id", T.LongType()),
    T.StructField("best_bpb", T.DoubleType()),
    T.StructField("total_trials", T.LongType()),
    T.StructField("final_adapter_path", T.StringType()),
    T.StructField("gguf_path", T.StringType()),
    T.StructField("merged_path", T.StringType()),
])
TRIALS_PER_FILE = 100_000
CHECKPOINT_KEYS = ("current_trial", "best_trial_id", "best_bpb", "best_recipe_diff", "total_trials_run")


def _run_from_path(path_col) -> F.Column:
    parent = F.regexp_extract(path_col, r"([^/]+)/[^/]+$", 1)
    return F.regexp_replace(parent, r"^run_id=", "")


def log_lines(log: DataFrame) -> DataFrame:
    """Trial rows → ``(run_id, value)`` JSON lines; +inf bpb is written as null."""
    bpb = F.when(F.col("eval_bpb") == F.lit(float("inf")), F.lit(None)).otherwise(F.col("eval_bpb"))
    rec = F.struct(
        F.col("trial_id"), F.parse_json(F.col("recipe_diff")).alias("recipe_diff"), bpb.alias("eval_bpb"),
        F.col("judge_score"), F.col("kept"), F.col("wall_clock_secs"), F.col("steps"), F.col("timestamp"))
    return log.select("run_id", F.to_json(rec, {"ignoreNullFields": "false"}).alias("value"))


def write_by_run(rows: DataFrame, path: str, mode: str) -> None:
    """``(run_id, value)`` rows as text files, one directory per run, or into a bundle."""
    if is_bundle(path):
        write_bundle(rows.select(file_of("run_id").alias("path"), "value"), path, mode)
    else:
        rows.write.mode(mode).partitionBy("run_id").text(path)


def write_trial_log(log: DataFrame, path: str, mode: str = "append") -> None:
    """Append trial rows as JSON lines, one directory per run, or into a bundle.

    Rows for directories are dealt by run and by blocks of trial ids, so a small run is one file
    and a large one is split over tasks.
    """
    if is_bundle(path):
        write_by_run(log_lines(log), path, mode)
        return
    dealt = log.repartition(F.col("run_id"), F.floor(F.col("trial_id") / F.lit(TRIALS_PER_FILE)))
    write_by_run(log_lines(dealt), path, mode)


def parse_trial_lines(lines: DataFrame) -> DataFrame:
    """``(value, _path)`` log lines → trial rows, batch or streaming.

    Blank, malformed and incomplete lines are skipped (key presence is checked, a null value
    is fine), unknown fields are ignored, a null or missing bpb reads as +inf.
    """
    v = F.try_parse_json(F.col("value"))
    is_obj = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    has = lambda k: F.try_variant_get(v, f"$.{k}", "variant").isNotNull()
    typed = lambda k, t: F.try_variant_get(v, f"$.{k}", t)
    present = is_obj
    for k in REQUIRED:
        present = present & has(k)
    return (lines.where(F.trim("value") != "").where(present).select(
        _run_from_path(F.col("_path")).alias("run_id"),
        typed("trial_id", "int").alias("trial_id"),
        F.to_json(typed("recipe_diff", "variant")).alias("recipe_diff"),
        F.coalesce(typed("eval_bpb", "double"), F.lit(float("inf"))).alias("eval_bpb"),
        typed("judge_score", "double").alias("judge_score"),
        typed("kept", "boolean").alias("kept"),
        typed("wall_clock_secs", "double").alias("wall_clock_secs"),
        typed("steps", "int").alias("steps"),
        typed("timestamp", "string").alias("timestamp")))


def trial_lines(reader, path: str) -> DataFrame:
    """``(value, _path)`` lines of the log files below ``path`` (batch or stream reader), or of a bundle."""
    lines = reader.option("recursiveFileLookup", "true").text(path)
    return unpack(lines) if is_bundle(path) else lines.select("value", F.col("_metadata.file_path").alias("_path"))


def read_trial_log(spark: SparkSession, path: str) -> DataFrame:
    """The trial rows of all log files below ``path``."""
    return parse_trial_lines(trial_lines(spark.read, path))


def _documents(spark: SparkSession, path: str) -> DataFrame:
    """``(value, _path)``: every file below ``path`` whole, or every file of a bundle."""
    if is_bundle(path):
        return unpack(spark.read.text(path))
    return spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select(
        "value", F.col("_metadata.file_path").alias("_path"))


def write_run_states(states: DataFrame, path: str) -> None:
    """One JSON document per run, in a directory of its own or in a bundle (+inf best is written as null)."""
    bpb = F.when(F.col("best_bpb") == F.lit(float("inf")), F.lit(None)).otherwise(F.col("best_bpb"))
    cols = [F.col(f.name) if f.name != "best_bpb" else bpb.alias("best_bpb") for f in RUN_STATE_SCHEMA.fields]
    doc = F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})
    docs = states.select("run_id", doc.alias("value"))
    write_by_run(docs if is_bundle(path) else docs.repartition("run_id"), path, "overwrite")


def read_run_states(spark: SparkSession, path: str) -> DataFrame:
    """A10: one multi-line JSON document per file; unknown keys dropped; null best → +inf."""
    if is_bundle(path):
        df = _documents(spark, path).select("_path", F.from_json("value", RUN_STATE_SCHEMA).alias("_d")).select("_path", "_d.*")
    else:
        df = (spark.read.schema(RUN_STATE_SCHEMA).option("multiLine", "true").option("recursiveFileLookup", "true")
              .json(path)).select("*", F.col("_metadata.file_path").alias("_path"))
    return df.select(_run_from_path(F.col("_path")).alias("run_id"), *[
        F.coalesce("best_bpb", F.lit(float("inf"))).alias("best_bpb") if f.name == "best_bpb" else F.col(f.name)
        for f in RUN_STATE_SCHEMA.fields])


def read_loop_checkpoints(spark: SparkSession, path: str) -> DataFrame:
    """A10 (checkpoint): the whole document is rejected when a key is unknown or missing."""
    docs = _documents(spark, path)
    v = F.try_parse_json("value")
    keys = F.map_keys(F.from_json(F.col("value"), "map<string,string>"))
    exact = F.array_sort(keys) == F.array_sort(F.array(*[F.lit(k) for k in CHECKPOINT_KEYS]))
    return docs.where(F.coalesce(exact, F.lit(False))).select(
        _run_from_path(F.col("_path")).alias("run_id"),
        F.try_variant_get(v, "$.current_trial", "int").alias("current_trial"),
        F.try_variant_get(v, "$.best_trial_id", "int").alias("best_trial_id"),
        F.coalesce(F.try_variant_get(v, "$.best_bpb", "double"), F.lit(float("inf"))).alias("best_bpb"),
        F.to_json(F.try_variant_get(v, "$.best_recipe_diff", "variant")).alias("best_recipe_diff"),
        F.try_variant_get(v, "$.total_trials_run", "int").alias("total_trials_run"))
