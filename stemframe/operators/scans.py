"""Scans along a series in two levels.

A window over a whole series puts it into one task. Here a series is cut into blocks of positions; windows run within
blocks, each block folds to one row (its carry: how many rows, the last known value), and only these rows are
scanned over the series. So the largest task holds a block, or one row for each block of a series.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 65_536


def _block(block: int) -> Column:
    return F.floor(F.col("pos") / block)


def known_around(df: DataFrame, keys: list[str], known: Column, first: list[str] | None = None, block: int = BLOCK) -> DataFrame:
    """``df`` with ``back`` and ``ahead``: the last known value up to a row and the first from it on, in order of pos.

    ``known`` is null or a struct that begins with pos; of rows with equal pos those of lower ``first`` come before the others
    in both directions.
    """
    rows = df.withColumns({"__block": _block(block), "__known": known})
    own = Window.partitionBy(*keys, "__block")
    upto = [Window.unboundedPreceding, Window.currentRow]
    back = own.orderBy("pos", *(first or [])).rowsBetween(*upto)
    ahead = own.orderBy(F.desc("pos"), *(first or [])).rowsBetween(*upto)
    rows = rows.withColumns({"back": F.last("__known", ignorenulls=True).over(back), "ahead": F.last("__known", ignorenulls=True).over(ahead)})
    carries = rows.groupBy(*keys, "__block").agg(F.max("__known").alias("__last"), F.min("__known").alias("__first"))
    blocks, before = Window.partitionBy(*keys), [Window.unboundedPreceding, -1]
    carries = carries.select(
        *keys, "__block",
        F.last("__last", ignorenulls=True).over(blocks.orderBy("__block").rowsBetween(*before)).alias("__before"),
        F.last("__first", ignorenulls=True).over(blocks.orderBy(F.desc("__block")).rowsBetween(*before)).alias("__after"),
    )
    out = rows.join(carries, [*keys, "__block"])
    return out.withColumns({"back": F.coalesce("back", "__before"), "ahead": F.coalesce("ahead", "__after")}).drop("__block", "__known", "__before", "__after")


def ranked(df: DataFrame, keys: list[str], block: int = BLOCK) -> DataFrame:
    """``df`` with ``turn`` (place of a row in its series, from 1) and ``rows`` (of the series)."""
    rows = df.withColumn("__block", _block(block))
    rows = rows.withColumn("turn", F.row_number().over(Window.partitionBy(*keys, "__block").orderBy("pos")))
    sums = rows.groupBy(*keys, "__block").agg(F.count(F.lit(1)).alias("n"))
    own = Window.partitionBy(*keys)
    before = F.coalesce(F.sum("n").over(own.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(*keys, "__block", before.alias("__before"), F.sum("n").over(own).alias("rows"))
    out = rows.join(sums, [*keys, "__block"])
    return out.withColumn("turn", F.col("turn") + F.col("__before")).drop("__block", "__before")


def moving_sum(df: DataFrame, keys: list[str], width: int, block: int = BLOCK) -> DataFrame:
    """``df`` with ``sum``: of v over a row and the ``width`` - 1 rows after it. Positions are dense; a block gets the rows it needs of the next ones."""
    at = F.floor(F.greatest(F.col("pos") - width + 1, F.lit(0)) / block)
    rows = df.withColumn("__block", F.explode(F.sequence(at, _block(block))))
    ahead = Window.partitionBy(*keys, "__block").orderBy("pos").rowsBetween(0, width - 1)
    return rows.withColumn("sum", F.sum("v").over(ahead)).filter(F.col("__block") == _block(block)).drop("__block")
