"""What the operators share."""

from __future__ import annotations

import ctypes

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


_caches: list = []
_owner: str | None = None


def kept(cache) -> None:
    """Register a cache (with ``cache_clear``) that a Python worker keeps from task to task."""
    _caches.append(cache)


def give_back() -> None:
    """Memory that Python and Arrow hold but don't use goes back to the system, so that an idle worker is small."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim is not None:
        trim(0)


def working(owner: str) -> None:
    """Called where a task begins: what the tasks of another operator have kept in this worker is given back."""
    global _owner
    if _owner != owner:
        for cache in _caches:
            cache.cache_clear()
        give_back()
        _owner = owner


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_crc(column: str = "doc_id") -> Column:
    """crc32 of the id written as text (null for a null id)."""
    return F.crc32(F.col(column).cast("string").cast("binary"))
