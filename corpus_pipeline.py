"""The corpus pipeline: ``run(spark, sf_dir)`` applies STAGES to ``documents``.

Each stage is ``(spark, docs, sf_dir) -> DataFrame``. Its rows are written as Parquet and read
back as the next stage's ``docs``; all stages but the last return the columns of ``documents``.

1. quality_rules: failing lines go, and documents that fail the document rules or lose too much.
2. near_duplicates: of each group of rows linked by 5-gram Jaccard, the one with the smallest
   id stays (rows without an id come last); unlike rows of one id all stay.
3. substring_dedup: passages that repeat across documents stay in the first one only.
4. mixing: each document as often as the mix takes it.
5. sentencepiece: ids and decoded text of every document of the mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatloom.llm import mixing, ngram_join, piece_codec, quality, substring
from chatloom.llm.queries import piece_model
from chatloom.llm.util import documents, save, shelter


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.clean_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    own, names = shelter(docs, "doc_id", "text")
    # an id names a document where all its rows have one text; other rows, and those without an id, are told
    # apart by a hash of id and text, above all usual ids
    texts = own.groupBy("doc_id").agg(F.min(F.xxhash64("text")).alias("_lo"), F.max(F.xxhash64("text")).alias("_hi"))
    unlike = save(texts.where("_lo <> _hi AND doc_id IS NOT NULL").select(F.col("doc_id").alias("_shared")), "pipeline-unlike")
    hashed = F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 2).bitwiseOR(F.lit(1 << 62))
    keyed = own.join(unlike, own["doc_id"] == unlike["_shared"], "left").withColumn(
        "_key", F.when(F.col("_shared").isNull() & F.col("doc_id").isNotNull(), F.col("doc_id").cast("long")).otherwise(hashed)).drop("_shared")
    found = ngram_join.similar_components(keyed.select(F.col("_key").alias("doc_id"), "text"))
    group = found.groupBy(F.col("doc_id").alias("_key")).agg(F.min("component_id").alias("_group"), F.max("n_shingles").alias("_n"))
    ids = keyed.groupBy("_key").agg(F.min("doc_id").alias("_id"))
    member = ids.join(group.hint("merge"), "_key")
    first = member.groupBy("_group").agg(F.min(F.struct(F.col("_id").isNull().alias("_none"), "_id", "_key", "_n")).alias("_f"))
    kept = keyed.join(first.select("_f._key", "_f._n").hint("merge"), "_key")
    # repeats of a kept row go, but for rows without words, which are linked with nothing
    kept = kept.withColumn("_own", F.when(F.col("_n") == 0, F.monotonically_increasing_id()))
    return kept.dropDuplicates(["_key", "doc_id", "text", "_own"]).select(*own.columns).toDF(*names)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substring.remove_passages(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return piece_codec.digests(piece_codec.encode_decode(docs, piece_model()))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", substring_dedup),
    ("mixing", mix_sources),
    ("sentencepiece", sentencepiece),
]

#: Several stages cannot be said in SQL; the tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
