"""Exact dedup by skew-safe combining; DataFrame functions only.

Equal texts are combined three times, and each time the whole text is part of the grouping key, so a
digest collision can never merge different texts: locally (each task's own rows of a text become one, by
map-side partial aggregation), per (digest, salt), the salt being the task that a row came from, so that a hot
text is spread over ``salts`` reducers, and globally over the at most ``salts`` winners that each text has
left. The digest only leads the key, to make comparisons short.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stemframe.storage import staged



def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _task(salts: int) -> Column:
    """The task that a row is read by, modulo ``salts``: all rows of a task share it, so they combine before they leave it."""
    return F.pmod(F.spark_partition_id(), F.lit(salts))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 32, digest=sha256) -> DataFrame:
    """Per input row: doc_id, keep_id, group_size, kept, text_sha256.

    * A null text counts as empty; all empty texts are one group.
    * Of equal texts the row with the largest id stays; a null id loses against any other. Rows that
      repeat the winning id (or groups whose ids are all null) keep exactly one of the repeated rows.
    * An empty table gives no rows; other columns of the input are ignored and may have any name.

    ``digest`` leads the grouping key; any function of the text gives right results.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("digest", digest(F.col("text")))
    partly = rows.withColumn("salt", _task(salts)).groupBy("digest", "text", "salt").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    groups = partly.groupBy("digest", "text").agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("group_size"))
    # Only texts that occur more than once need to find their way back to the rows.
    winners = staged(groups.filter("group_size > 1"), "winners")
    found = rows.join(winners, ["digest", "text"], "left").select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        sha256(F.col("text")).alias("text_sha256"),
    )
    # Of rows that repeat the winning id one is kept: first one of each task, then one of these. A row that can't
    # win is dealt by what it is, so that the many rows without an id of one text don't meet in one task.
    found = found.withColumn("task", _task(1 << 16))
    local = F.row_number().over(Window.partitionBy("doc_id", "text_sha256", "task").orderBy("keep_id"))
    found = found.withColumn("local", local)
    rest = F.when(F.col("local") > 1, F.concat_ws(":", "task", "local"))
    turn = F.row_number().over(Window.partitionBy("doc_id", "text_sha256", "rest").orderBy("task"))
    won = F.col("doc_id").eqNullSafe(F.col("keep_id")) & F.col("rest").isNull() & (turn == 1)
    return found.withColumn("rest", rest).withColumn("kept", won).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 32) -> DataFrame:
    """The input's rows and columns, one row for each text: the one with the largest id.

    The groups are combined as above, and each carries its winner's row along, so no row has to be looked up
    again. Nulls, ties, repeats and empty tables are treated as above; a null text stays null in the row that is
    kept (null and empty texts are one group).
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col], F.col(text_col).isNull().alias("__no_text"))
    # The order of the ids, a null one last; of rows that repeat an id a hash of their columns decides.
    hashed = [F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    rank = F.struct(F.col(id_col).isNotNull(), F.col(id_col), F.xxhash64(*hashed))
    rows = docs.select(sha256(text).alias("digest"), text.alias("text"), rank.alias("rank"), row.alias("row"), _task(salts).alias("salt"))
    best = [F.max_by("row", "rank").alias("row"), F.max("rank").alias("rank")]
    groups = rows.groupBy("digest", "text", "salt").agg(*best).groupBy("digest", "text").agg(*best)
    own = F.when(~F.col("row.__no_text"), F.col("text"))
    return groups.select(*[own.alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


ORACLE = """SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
  row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC) = 1 AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))"""
