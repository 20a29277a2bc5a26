"""Length filter, role normalization, repair with a warning table, strict validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatloom.functions import assistant_chars, fill, normalize_role, py_repr, ustrip
from chatloom.schema import DEFAULT_MIN_ASSISTANT_CHARS, MESSAGE_TEXT, VALID_ROLES

_WARN = "struct<msg_pos:int,code:string,detail:string>"


def min_answer_filter(samples: DataFrame, min_assistant_chars: int = DEFAULT_MIN_ASSISTANT_CHARS) -> DataFrame:
    """Keep samples whose assistant content totals at least ``min_assistant_chars``."""
    return samples.where(assistant_chars("messages") >= F.lit(min_assistant_chars))


def _valid(role: Column) -> Column:
    return role.isin(*VALID_ROLES)


def _warn(pos, code: str, detail: Column) -> Column:
    return F.struct(pos.cast("int").alias("msg_pos"), F.lit(code).alias("code"), detail.alias("detail"))


def _no_warn() -> Column:
    return F.array().cast(f"array<{_WARN}>")


def _annotate(messages: Column) -> Column:
    """Per message: position, raw role/content, stripped content, normalized role."""
    return F.transform(
        messages,
        lambda m, i: F.struct(
            i.alias("pos"),
            m["role"].alias("raw_role"),
            m["content"].alias("raw"),
            ustrip(m["content"]).alias("stripped"),
            normalize_role(m["role"]).alias("norm"),
        ),
    )


def _message_warnings(ann: Column) -> Column:
    def one(m):
        role, norm = py_repr(m["raw_role"]), py_repr(m["norm"])
        empty, strip, unknown, normed = (_warn(m["pos"], code, fill(MESSAGE_TEXT[code], role=role, norm=norm))
                                         for code in ("empty_content", "stripped_whitespace", "unknown_role", "normalized_role"))
        strip_part = F.when(m["stripped"] != m["raw"], F.array(strip)).otherwise(_no_warn())
        role_part = (F.when(~_valid(m["norm"]), F.array(unknown))
                     .when(m["norm"] != m["raw_role"], F.array(normed))
                     .otherwise(_no_warn()))
        return F.when(m["stripped"] == "", F.array(empty)).otherwise(F.concat(strip_part, role_part))

    return F.flatten(F.transform(ann, one))


def _kept_messages(ann: Column) -> Column:
    kept = F.filter(ann, lambda m: (m["stripped"] != "") & _valid(m["norm"]))
    return F.transform(kept, lambda m: F.struct(m["norm"].alias("role"), m["stripped"].alias("content")))


def _with_drop_reason(df: DataFrame, msgs: str = "repaired") -> DataFrame:
    """First failing sample rule → ``drop_code`` / ``drop_detail`` (NULL when kept).

    Intermediate arrays are staged as columns so each is evaluated once per row.
    """
    m = F.col(msgs)
    df = df.withColumn("_ns", F.filter(m, lambda x: x["role"] != "system"))
    ns = F.col("_ns")
    n_ns = F.size(ns)
    # index i (1-based in the non-system list) of the first repeated role
    steps = F.when(n_ns >= 2, F.sequence(F.lit(1), n_ns - 1)).otherwise(F.array().cast("array<int>"))
    df = df.withColumn("_rep", F.get(F.filter(steps, lambda i: F.get(ns, i)["role"] == F.get(ns, i - 1)["role"]), 0))
    df = df.withColumn("_roles", F.transform(m, lambda x: x["role"]))
    has = lambda r: F.array_contains(F.col("_roles"), r)
    first_role = F.get(ns, 0)["role"]
    rep = F.col("_rep")
    code = (F.when(F.size(m) == 0, F.lit("no_messages"))
            .when(~has("user"), F.lit("no_user"))
            .when(~has("assistant"), F.lit("no_assistant"))
            .when(first_role != "user", F.lit("first_not_user"))
            .when(rep.isNotNull(), F.lit("consecutive_roles")))
    df = df.withColumn("drop_code", code)
    c = F.col("drop_code")
    last = F.when(c == "first_not_user", first_role).otherwise(F.get(ns, rep)["role"])
    detail = None
    for name in ("no_messages", "no_user", "no_assistant", "first_not_user", "consecutive_roles"):
        text = fill(MESSAGE_TEXT[name], role=py_repr(last), i=rep - 1, j=rep)
        detail = F.when(c == name, text) if detail is None else detail.when(c == name, text)
    return df.withColumn("drop_detail", detail).drop("_ns", "_rep", "_roles")


def repair(samples: DataFrame) -> DataFrame:
    """Adds ``repaired ARRAY<message>``, ``drop_code``, ``drop_detail`` and ``warnings``.

    Message rules in order: drop empty (after strip), warn when stripped, drop unknown
    role, warn when the role was normalized. Sample rules: first failing only.
    """
    staged = samples.withColumn("_ann", _annotate(F.col("messages"))).withColumn("repaired", _kept_messages(F.col("_ann")))
    staged = _with_drop_reason(staged)
    drop_w = F.when(F.col("drop_code").isNotNull(), F.array(F.struct(
        F.lit(None).cast("int").alias("msg_pos"), F.col("drop_code").alias("code"), F.col("drop_detail").alias("detail"))))
    return (staged.withColumn("warnings", F.concat(_message_warnings(F.col("_ann")), F.coalesce(drop_w, _no_warn())))
            .drop("_ann"))


def validate_and_repair(samples: DataFrame, keep_id: bool = True) -> DataFrame:
    """Repaired samples that pass every rule (``ord``, ``id``, ``messages``)."""
    r = repair(samples).where(F.col("drop_code").isNull())
    id_col = F.col("id") if keep_id else F.lit("")
    return r.select("ord", id_col.alias("id"), F.col("repaired").alias("messages"))


def repair_warnings(samples: DataFrame, index_col: str = "ord") -> DataFrame:
    """Long warning table ``(ord, seq, msg_pos, code, message)``; message = "Sample {i}: …"."""
    r = repair(samples)
    r = r.select("ord", F.col(index_col).alias("_i"), F.posexplode_outer("warnings").alias("seq", "w"))
    return r.where(F.col("seq").isNotNull()).select(
        "ord", F.col("seq").cast("int").alias("seq"), F.coalesce(F.col("w.msg_pos"), F.lit(-1)).alias("msg_pos"), F.col("w.code").alias("code"),
        fill(MESSAGE_TEXT["sample_warning"], n=F.col("_i"), detail=F.col("w.detail")).alias("message"),
    )


def drop_reasons(samples: DataFrame) -> DataFrame:
    """Dropped samples with their first failing rule."""
    return repair(samples).where(F.col("drop_code").isNotNull()).select(
        "ord", F.col("drop_code").alias("code"), F.col("drop_detail").alias("detail"))


def warning_summary(samples: DataFrame) -> DataFrame:
    return repair_warnings(samples).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


def validate_strict(samples: DataFrame, index_col: str = "ord") -> DataFrame:
    """Errors without mutation: ``(ord, seq, msg_pos, code, message)``; no order check."""
    msgs = F.col("messages")
    norm_roles = F.transform(msgs, lambda m: normalize_role(m["role"]))
    none = F.array().cast("array<struct<msg_pos:int,code:string,message:string>>")

    def err(fails, code: str, pos=None, **values):
        text = fill(MESSAGE_TEXT[f"strict_{code}"], n=F.col(index_col), j=pos, **values)
        place = F.lit(None).cast("int") if pos is None else pos.cast("int")
        return F.when(fails, F.array(F.struct(place.alias("msg_pos"), F.lit(code).alias("code"), text.alias("message")))).otherwise(none)

    def per_msg(m, j):
        return F.concat(err(ustrip(m["content"]) == "", "empty_content", j),
                        err(~_valid(normalize_role(m["role"])), "unknown_role", j, role=py_repr(m["role"])))

    missing = [err(~F.array_contains(norm_roles, role), f"missing_{role}") for role in ("user", "assistant")]
    errors = F.when(F.size(msgs) == 0, err(F.lit(True), "no_messages")).otherwise(F.concat(*missing, F.flatten(F.transform(msgs, per_msg))))
    out = samples.select("ord", F.posexplode_outer(errors).alias("seq", "e")).where(F.col("seq").isNotNull())
    return out.select(
        "ord", F.col("seq").cast("int").alias("seq"), F.coalesce(F.col("e.msg_pos"), F.lit(-1)).alias("msg_pos"), F.col("e.code").alias("code"),
        F.col("e.message").alias("message"))
