"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import Window


def c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clip(x: str | Column, low: float = -1.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(c(x), F.lit(high)))


def peak(*keys: str, v: str = "v") -> Column:
    """Largest absolute value within the keys."""
    return F.max(F.abs(c(v))).over(Window.partitionBy(*keys))


def truncated(x: Column, kind: str = "int") -> Column:
    """Towards zero, like a cast of a finite float."""
    return x.cast(kind)


def seeded(seed: str, *parts: str | Column) -> Column:
    """A number in [0, 1) that is a pure function of the seed and the parts, the same in any engine."""
    key = F.concat(F.lit(f"{seed}:"), *[x for p in parts for x in (c(p).cast("string"), F.lit(":"))])
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0


def seeded_sql(seed: str, *parts: str) -> str:
    """``seeded`` in DuckDB."""
    key = " || ".join([f"'{seed}:'", *[f"CAST({p} AS VARCHAR) || ':'" for p in parts]])
    return f"(CAST(('0x' || substr(md5({key}), 1, 8)) AS BIGINT) / 4294967296.0)"


def decibel(x: Column) -> Column:
    return 10 * F.log10(x)
