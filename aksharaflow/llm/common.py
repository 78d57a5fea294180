"""Helpers that the operators share: text classes, staged tables, per-worker caches."""

from __future__ import annotations

import sys
import types

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.staging import discard, session_conf, shared_dir, staged

__all__ = ["SPACE", "SPACE_CHARS", "ascii_lower", "discard", "free_name", "give_back", "partitions", "session_conf", "shared_dir", "staged", "worker_cache"]

#: The white space of all contracts, as a character class body of a Java or RE2 regular expression.
SPACE = r"\x20\x09-\x0D"
SPACE_CHARS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def free_name(df: DataFrame, name: str) -> str:
    """A column name like name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def worker_cache(name: str) -> dict:
    """A dict that outlives a task on its Python worker, so that tasks of one kind share what they have looked up. It holds
    one name at a time: the next operator's tasks drop what the last one's left, and give its memory back to the machine."""
    keep = sys.modules.setdefault("_aksharaflow_worker", types.ModuleType("_aksharaflow_worker"))
    if getattr(keep, "name", None) != name:
        held = getattr(keep, "found", None)
        keep.name, keep.found = name, {}
        if held:
            del held
            give_back()
    return keep.found


def give_back() -> None:
    """Memory that this process has freed, to the machine: workers live on from stage to stage, and an executor's limit counts what
    they hold, used or not."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it, others needn't
    if trim:
        trim(0)
