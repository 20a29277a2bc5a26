"""Expressions over a ``messages ARRAY<STRUCT<role, content>>`` column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from chatloom.functions.text import ustrip
from chatloom.schema import (
    CANON_MSG_SEP,
    CANON_ROLE_SEP,
    CHAT_TURN_CLOSE,
    CHAT_TURN_OPEN,
    REPAIR_ROLE_ALIASES,
)


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def canonical_text(messages="messages") -> Column:
    """``role\\x01content`` per message joined by ``\\x00`` (the dedup key text)."""
    return F.array_join(
        F.transform(_c(messages), lambda m: F.concat(m["role"], F.lit(CANON_ROLE_SEP), m["content"])),
        CANON_MSG_SEP,
    )


def assistant_chars(messages="messages") -> Column:
    """Sum of content lengths over messages whose role is exactly ``assistant``."""
    return F.aggregate(
        F.filter(_c(messages), lambda m: m["role"] == F.lit("assistant")),
        F.lit(0).cast("bigint"),
        lambda acc, m: acc + F.length(m["content"]).cast("bigint"),
    )


def render_chat(messages="messages") -> Column:
    """Training text: ``<|im_start|>{role}\\n{content}<|im_end|>\\n`` per message."""
    return F.array_join(
        F.transform(
            _c(messages),
            lambda m: F.concat(
                F.lit(CHAT_TURN_OPEN), m["role"], F.lit("\n"), m["content"], F.lit(CHAT_TURN_CLOSE + "\n")
            ),
        ),
        "",
    )


def first_content(role: str, messages="messages") -> Column:
    """Content of the first message with exactly this role, ``''`` when none."""
    hit = F.filter(_c(messages), lambda m: m["role"] == F.lit(role))
    return F.coalesce(F.get(hit, 0)["content"], F.lit(""))


def normalize_role(role) -> Column:
    """lower + strip, then the alias table (human→user, gpt/bot→assistant)."""
    alias = F.create_map(*[F.lit(x) for kv in REPAIR_ROLE_ALIASES.items() for x in kv])
    r = ustrip(F.lower(_c(role)))
    return F.coalesce(F.element_at(alias, r), r)
