"""Many small files kept in few: a bundle.

A file system takes time for each file that is made, listed and opened, so a file per document or run
costs more than the work on it. A bundle is a folder named ``*.bundle`` with JSON lines
``{"path": <folder>/<file>, "value": <text>}``, where the value is a whole small file, or one line of
a log file. Readers of files take a bundle by the suffix of its path and go on as with plain files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SUFFIX = ".bundle"
#: The folder of rows without a key, as Spark names it.
_NO_KEY = "__HIVE_DEFAULT_PARTITION__"


def is_bundle(path: str) -> bool:
    return path.rstrip("/").endswith(SUFFIX)


def file_of(key: str) -> Column:
    """The path of a key's file inside a bundle: ``<key>=<value>/part.txt``."""
    name = F.coalesce(F.nullif(F.col(key).cast("string"), F.lit("")), F.lit(_NO_KEY))
    return F.concat(F.lit(f"{key}="), F.replace(name, F.lit("/"), F.lit("%2F")), F.lit("/part.txt"))


def write_bundle(files: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write ``(path, value)`` rows as they are dealt: no shuffle, as many files as there are tasks."""
    if not is_bundle(path):
        raise ValueError(f"a bundle's folder ends with {SUFFIX!r}: {path!r}")
    files.select(F.to_json(F.struct("path", "value")).alias("value")).write.mode(mode).text(path)


def unpack(lines: DataFrame) -> DataFrame:
    """Lines of a bundle (batch or stream) → ``(value, _path)``, the columns of text files read with their paths."""
    row = F.from_json("value", "path string, value string")
    return lines.select(row.alias("_f")).select(F.col("_f.value").alias("value"), F.col("_f.path").alias("_path"))
