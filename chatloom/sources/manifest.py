"""Source strings: type (A11) and derived names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: a hub id is exactly two name parts separated by one slash.
HUB_ID_PATTERN = r"^[A-Za-z0-9_\-.]+/[A-Za-z0-9_\-.]+$"
HUB_ID_WITH_SPLIT_PATTERN = r"^[A-Za-z0-9_\-.]+/[A-Za-z0-9_\-.]+(/[A-Za-z0-9_\-.]+)?$"
DEFAULT_CACHE_NAME = "dataset.jsonl"
DEFAULT_SPLIT = "train"


def source_type(source: Column, allow_split: bool = False) -> Column:
    """``url`` for http(s)://, ``hf`` for a hub id, else ``local``. By default a three-part
    ``org/name/split`` is *not* a hub id (as in the original pattern)."""
    pattern = HUB_ID_WITH_SPLIT_PATTERN if allow_split else HUB_ID_PATTERN
    return (F.when(source.startswith("http://") | source.startswith("https://"), F.lit("url"))
            .when(source.rlike(pattern), F.lit("hf"))
            .otherwise(F.lit("local")))


def cache_name(url: Column) -> Column:
    """Last path part of the URL before any ``?``, trailing slashes dropped; default name."""
    base = F.regexp_replace(F.substring_index(url, "?", 1), "/+$", "")
    last = F.element_at(F.split(base, "/"), -1)
    return F.coalesce(F.nullif(last, F.lit("")), F.lit(DEFAULT_CACHE_NAME))


def hub_repo_and_split(source: Column) -> tuple[Column, Column]:
    """``a/b/split`` → (``a/b``, ``split``); anything else → (source, ``train``)."""
    parts = F.split(source, "/")
    three = F.size(parts) == 3
    repo = F.when(three, F.concat_ws("/", F.get(parts, 0), F.get(parts, 1))).otherwise(source)
    split = F.when(three, F.get(parts, 2)).otherwise(F.lit(DEFAULT_SPLIT))
    return repo, split


def staged_name(source: Column, split: Column) -> Column:
    """File name under which a hub source's records are staged."""
    return F.concat(F.replace(source, F.lit("/"), F.lit("__")), F.lit("_"), split, F.lit(".jsonl"))
