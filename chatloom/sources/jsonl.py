"""Golden JSONL / JSON-array sources and the golden JSONL sink."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chatloom.functions import bind, ustrip
from chatloom.operators.convert import sharegpt_messages
from chatloom.operators.replies import parse_sample
from chatloom.schema import MESSAGE_TEXT
from chatloom.session import saved
from chatloom.sources.bundles import is_bundle, unpack


def _strict_json(text: Column) -> Column:
    """Exactly one JSON value (no trailing data) → VARIANT, else NULL.

    The parser ignores what follows a value, so the text is parsed inside brackets and inside
    an object: a remainder would have to go on with ``]`` for the one and ``}`` for the other,
    or with a comma, which gives the array a second element.
    """
    arr = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))).try_cast("array<variant>")
    obj = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
    return F.when((F.size(arr) == 1) & obj.isNotNull(), F.get(arr, 0))


def is_conversations(v: Column) -> Column:
    """A record with ``conversations`` and without ``messages``."""
    has = lambda key: F.try_variant_get(v, f"$.{key}", "variant").isNotNull()
    return has("conversations") & ~has("messages")


def _has(v: Column, key: str) -> Column:
    return F.try_variant_get(v, f"$.{key}", "variant").isNotNull()


def _text(v: Column, key: str) -> Column:
    """A text field; NULL where it is absent or of another type."""
    is_text = F.schema_of_variant(F.try_variant_get(v, f"$.{key}", "variant")) == "STRING"
    return F.when(is_text, F.try_variant_get(v, f"$.{key}", "string"))


def _flat_messages(v: Column) -> Column:
    """Messages of a record of text fields (instruction, prompt or question records); NULL for others."""
    extra = _text(v, "input")
    instruction = F.when(ustrip(extra) != "", F.concat(_text(v, "instruction"), F.lit("\n\n"), extra)).otherwise(_text(v, "instruction"))
    pairs = [("instruction", "output", instruction)] + [(a, b, _text(v, a)) for a, b in (("prompt", "response"), ("prompt", "completion"), ("question", "answer"))]
    found = None
    for asked, answer, user in pairs:
        messages = F.array(F.struct(F.lit("user").alias("role"), user.alias("content")), F.struct(F.lit("assistant").alias("role"), _text(v, answer).alias("content")))
        here = _has(v, asked) & _has(v, answer)
        found = F.when(here, messages) if found is None else found.when(here, messages)
    return found


def parse_record(v: Column) -> Column:
    """:func:`parse_sample` of a record of any known shape (B3), read as messages first.

    ``messages`` and ``conversations`` go before the flat shapes, which are told by their two fields in
    the order instruction and output (with input, where not blank), prompt and response, prompt and
    completion, question and answer. A conversations list without a list, or with a turn that lacks
    ``from`` or ``value``, and a field that is no text, make a record bad.
    """
    turns = F.try_variant_get(v, "$.conversations", "array<variant>")
    mapped = sharegpt_messages(F.transform(turns, lambda t: F.struct(_text(t, "from").alias("from"), _text(t, "value").alias("value"))))
    listed = F.try_variant_get(v, "$.messages", "variant").try_cast("array<variant>").isNotNull()

    def as_messages(messages):
        return F.try_parse_json(F.to_json(F.struct(messages.alias("messages"))))

    def shaped(flat):
        shape = F.when(is_conversations(v), as_messages(mapped)).when(~listed & flat.isNotNull(), as_messages(flat)).otherwise(v)
        return bind(shape, parse_sample)

    return bind(_flat_messages(v), shaped)


def _parsed(rows: DataFrame, keys: list[str], text: str, name: str) -> DataFrame:
    """``keys`` and ``(blank, is_json, other, reason, id, messages, snippet)`` of texts, each parsed once; saved.

    ``other``: a conversations record; ``reason`` is NULL for a good record.
    """
    staged = rows.select(*keys, F.col(text).alias("_t")).withColumn("_v", F.when(F.col("_t") != "", _strict_json(F.col("_t"))))
    staged = staged.withColumn("_s", F.when(F.col("_v").isNotNull(), parse_record(F.col("_v"))))
    is_json = F.col("_v").isNotNull()
    bad = ~is_json | F.col("_s.reason").isNotNull()
    return saved(staged.select(
        *keys, (F.col("_t") == "").alias("blank"), is_json.alias("is_json"), F.coalesce(is_conversations(F.col("_v")), F.lit(False)).alias("other"),
        F.when(~is_json, F.lit("invalid_json")).otherwise(F.col("_s.reason")).alias("reason"), F.col("_s.id").alias("id"),
        F.col("_s.messages").alias("messages"), F.when(bad, F.substring("_t", 1, 200)).alias("snippet")), name)


def require_one_format(parsed: DataFrame) -> None:
    """Raise when some parsed records hold conversations and others do not."""
    row = parsed.where("is_json").agg(F.count_if("other").alias("c"), F.count("*").alias("n")).first()
    if 0 < row["c"] < row["n"]:
        raise ValueError(MESSAGE_TEXT["mixed_format"])


def load_dataset(spark: SparkSession, path: str, one_format: bool = True) -> tuple[DataFrame, DataFrame]:
    """Samples of ``.jsonl`` or ``.json`` files by the suffix of the path; another suffix is an error."""
    suffix = re.search(r"(\.[^./*]*)?/*$", path).group(1) or ""
    if suffix.lower() == ".jsonl":
        return read_jsonl(spark, path, one_format=one_format)
    if suffix.lower() == ".json":
        return read_json_array(spark, path, one_format=one_format)
    raise ValueError(f"cannot tell the format of {path!r} by {suffix!r}: .jsonl and .json are known")


def read_jsonl(spark: SparkSession, path: str, strict: bool = True, one_format: bool = False) -> tuple[DataFrame, DataFrame]:
    """A1: golden samples from JSONL files (records of any shape of :func:`parse_record`) → ``(samples, rejects)``.

    ``samples``: ``(ord, file, line_no, id, messages)`` with ``ord`` the position in (file,
    line) order. ``rejects``: ``(file, line_no, reason, snippet)`` for bad JSON and bad shape. ``strict=True`` raises on the first reject and
    on an empty result (one small job each), as the single-file loader does.

    Files are read and parsed once. A line belongs to one input split; its number is the count of
    lines in the earlier splits of its file (a table with one row per split) plus its index inside the split.
    """
    from pyspark.sql import Window

    from chatloom.operators.positions import dense_positions_by

    lines = spark.read.option("recursiveFileLookup", "true").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_blk"),
        F.monotonically_increasing_id().alias("_id"), ustrip(F.regexp_replace("value", "^\ufeff", "")).alias("line"))
    parsed = _parsed(lines, ["file", "_blk", "_id"], "line", "jsonl-parsed")
    splits = parsed.groupBy("file", "_blk").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("file").orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.select("file", "_blk", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    records = parsed.where("NOT blank").join(offsets, ["file", "_blk"]).withColumn("line_no", F.col("_off") + F.col("_id") - F.col("_first") + 1)
    if one_format:
        require_one_format(parsed.where("NOT blank"))
    rejects = records.where("reason IS NOT NULL").select("file", "line_no", "reason", "snippet")
    good = records.where("reason IS NULL").select("file", "line_no", "id", "messages")
    samples = dense_positions_by(good, ["file", "line_no"], "ord").select("ord", "file", "line_no", "id", "messages")
    if strict:
        bad = rejects.orderBy("file", "line_no").first()
        if bad is not None:
            raise ValueError(f"{bad['file']}:{bad['line_no']}: {bad['reason']}: {bad['snippet']!r}")
        if parsed.where("NOT blank").isEmpty():
            raise ValueError(f"Dataset is empty: {path}")
    return samples, rejects


def read_json_array(spark: SparkSession, path: str, strict: bool = True, one_format: bool = False) -> tuple[DataFrame, DataFrame]:
    """A2: each file is one JSON array of records → ``(samples, rejects)``; ``ord`` is the position in (file, item) order.

    A file is cut into its items by as many tasks as it has input splits
    (:func:`~chatloom.sources.json_items.array_items`), and every item is parsed once. A file is
    rejected whole (position -1) when it is no array or when one of its items is no JSON.
    """
    from chatloom.operators.positions import dense_positions_by
    from chatloom.sources.json_items import array_items

    items, broken = array_items(spark, path)
    parsed = _parsed(items.withColumn("text", F.trim("text")), ["file", "pos", "is_array"], "text", "json-parsed")
    bad = parsed.where("NOT is_json").select("file").unionByName(broken).distinct().withColumn("reason", F.lit("invalid_json"))
    others = parsed.where("is_json AND NOT is_array").select("file", F.lit("not_array").alias("reason"))
    bad_files = saved(bad.unionByName(others), "json-bad-files")
    whole = parsed.join(bad_files.select("file").distinct(), "file", "left_anti")
    if one_format:
        require_one_format(whole)
    reason = F.when(F.array_contains("r", "invalid_json"), F.lit("invalid_json")).otherwise(F.lit("not_array"))
    file_rejects = bad_files.groupBy("file").agg(F.collect_set("reason").alias("r")).select("file", F.lit(-1).cast("long").alias("pos"), reason.alias("reason"))
    rejects = file_rejects.unionByName(whole.where("reason IS NOT NULL").select("file", "pos", "reason"))
    samples = dense_positions_by(whole.where("reason IS NULL").select("file", "pos", "id", "messages"), ["file", "pos"], "ord")
    if strict:
        bad = rejects.orderBy("file", "pos").first()
        if bad is not None:
            raise ValueError(f"{bad['file']}: {bad['reason']} (item {bad['pos']})")
        if parsed.isEmpty():
            raise ValueError(f"Dataset is empty: {path}")
    return samples, rejects


def read_raw_text(spark: SparkSession, path: str) -> DataFrame:
    """A5: one row per file, or per file of a bundle: ``(doc_id = file path, text)``."""
    if is_bundle(path):
        return unpack(spark.read.text(path)).select(F.col("_path").alias("doc_id"), F.col("value").alias("text"))
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("text"))


def _json_string(c: Column) -> Column:
    """A JSON string literal for ``c`` (escaping as JSON encoders do, non-ASCII kept)."""
    j = F.to_json(F.array(c))
    return j.substr(F.lit(2), F.length(j) - 2)


def golden_line(id_col: Column, messages: Column) -> Column:
    """``{"id": …, "messages": [{"role": …, "content": …}, …]}`` with ``", "`` / ``": "``
    separators, non-ASCII characters written as they are."""
    msg = lambda m: F.concat(F.lit('{"role": '), _json_string(m["role"]), F.lit(', "content": '),
                             _json_string(m["content"]), F.lit("}"))
    return F.concat(F.lit('{"id": '), _json_string(id_col), F.lit(', "messages": ['),
                    F.array_join(F.transform(messages, msg), ", "), F.lit("]}"))


LINES_PER_FILE = 200_000


def write_jsonl(samples: DataFrame, path: str, partitions: int | None = None) -> None:
    """One object per line in ``ord`` order across part files (range partitioned),
    LF line ends. Blank ids must be assigned first (``positions.assign_ids``)."""
    n = partitions or max(1, -(-samples.count() // LINES_PER_FILE))
    out = samples.repartitionByRange(n, "ord").sortWithinPartitions("ord").select(
        golden_line(F.col("id"), F.col("messages")).alias("value"))
    out.write.mode("overwrite").option("lineSep", "\n").text(path)
