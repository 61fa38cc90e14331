"""Mixing sources to target weights by capped water-filling.

The targets come from the sources' sizes alone: every source gets its weighted share of the budget,
sources above ``max_epochs`` times their size are clamped there, and the excess goes to the others by
weight, until none is above. A source's target is met by whole repetitions of all its documents and a
fractional one: a seeded shuffle of the source, cut where the words run out.

The cut needs a running sum over a source, which may hold a third of all rows. So the shuffle order is
cut into ``BUCKETS`` ranges of the seeded hash: sums per (source, range) are small, their running sum
gives each range its start, and within a range a window adds up a few rows. No task sees a source whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stemframe.operators.dataset import numbered
from stemframe.storage import discard, staged


#: Ranges of the seeded order within each source: the first three hex digits of the hash.
BUCKETS = 16**3


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def water_fill(sources: DataFrame, ratio: float, max_epochs: float) -> DataFrame:
    """``sources`` (size, weight, and any others) with ``target``: a budget of ratio x all sizes shared by weight,
    clamped at max_epochs x size, the excess reshared by weight until none is above.

    Every round is one aggregate over the sources, of which one row reaches the driver: the level (words for a
    unit of weight) at which the sources that are not clamped share what is left. It only rises, so the rounds end.
    Weights of 0 or less get nothing.
    """
    cap, open_ = max_epochs * F.col("size"), F.col("weight") > 0
    budget = ratio * (sources.agg(F.sum("size")).first()[0] or 0)
    level, before = 0.0, None
    while True:
        over = cap < F.col("weight") * F.lit(level)
        s = sources.filter(open_).agg(F.sum(F.when(over, cap)).alias("clamped"), F.sum(F.when(~over, F.col("weight"))).alias("weight"), F.sum(over.cast("int")).alias("n")).first()
        if not s["weight"] or s["n"] == before:
            break
        level, before = (budget - (s["clamped"] or 0)) / s["weight"], s["n"]
    if not s["weight"]:
        level = float("inf")
    share = F.when(F.lit(level) == float("inf"), cap).otherwise(F.least(cap, F.col("weight") * F.lit(level)))
    return sources.withColumn("target", F.when(open_, share).otherwise(0.0))


def cyclic_weights(sources: DataFrame, cycle: tuple = (3, 1, 2)) -> DataFrame:
    """``sources`` (key, source) with ``weight``: ``cycle`` repeated over the sources in code point order, null last.

    The sources are numbered range by range, so there may be any number of them.
    """
    ordered = numbered(sources.select(F.col("source").isNull().alias("none"), "key"), "none", "key")
    weight = F.element_at(F.array(*map(F.lit, cycle)), (F.col("no") % len(cycle) + 1).cast("int"))
    return sources.join(ordered.select("key", weight.alias("weight")), "key")


def _turn(doc_id: Column, text: Column, seed: int) -> Column:
    """The seeded order: a hash of the id, or of the text where there is none, so that rows without an id don't meet in one range."""
    own = F.coalesce(doc_id.cast("string"), F.concat(F.lit("null:"), F.md5(F.coalesce(text, F.lit("")).cast("binary"))))
    return F.md5(F.concat(F.lit(f"{seed}:"), own).cast("binary"))


def mix(docs: DataFrame, weights: dict | None = None, ratio: float = 1.5, max_epochs: float = 2.0, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: list[str] | None = None) -> DataFrame:
    """Per input row: doc_id, size, source_size, target, copies, taken, and the columns of ``carry`` as the struct ``row``.

    ``taken`` counts the words that the mix takes of the document, repeats included; a source's sum is its
    target rounded to a word, since the document at the cut gives only the words that are missing.
    ``copies`` is the mix in whole documents: the one at the cut counts if half of it is wanted.

    * Sizes are words between ASCII white space; null and blank texts have size 0 and are taken 0 times.
    * A null source is a source of its own, last in order. ``weights`` by source default to 3, 1, 2, repeating.
    * Repeated rows (equal ids) are documents of their own; rows without an id are ordered by their text.
    * An empty table gives no rows. The same seed gives the same mix.
    """
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"),
        _turn(F.col(id_col), F.col(text_col), seed).alias("turn"),
        *([F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row")] if carry else []),
    )
    # A key without nulls, so that joins on it are plain equalities.
    rows = rows.withColumn("key", F.coalesce(F.concat(F.lit("="), "source"), F.lit("null"))).withColumn("range", F.substring("turn", 1, 3))
    ranges = staged(rows.groupBy("key", "range").agg(F.sum("size").alias("words"), F.first("source").alias("source")), "ranges")
    sources = staged(ranges.groupBy("key").agg(F.first("source").alias("source"), F.sum("words").alias("size")), "sources")
    if weights is None:
        weighted = cyclic_weights(sources)
    else:
        named = docs.sparkSession.createDataFrame([("null" if s is None else f"={s}", float(w)) for s, w in weights.items()], "key string, weight double")
        weighted = sources.join(named, "key", "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    weighted = staged(weighted, "weights")
    plan = water_fill(weighted, ratio, max_epochs)
    whole = F.when(F.col("size") > 0, F.floor(F.col("target") / F.col("size"))).otherwise(0)
    plan = plan.select("key", F.col("size").alias("source_size"), "target", whole.cast("int").alias("whole"), F.bround(F.col("target") - whole * F.col("size"), 0).cast("long").alias("rest"))
    upto = Window.partitionBy("key").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.select("key", "range", F.coalesce(F.sum("words").over(upto), F.lit(0)).alias("start"))
    starts = staged(starts.join(plan, "key"), "starts")
    discard(ranges, sources, weighted)
    before = Window.partitionBy("key", "range").orderBy("turn", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.join(starts, ["key", "range"]).withColumn("before", F.col("start") + F.coalesce(F.sum("size").over(before), F.lit(0)))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("before")))
    return placed.select(
        "doc_id", "size", "source_size", "target",
        (F.col("whole") + F.when((F.col("size") > 0) & (2 * part >= F.col("size")), 1).otherwise(0)).alias("copies"),
        (F.col("whole") * F.col("size") + part).alias("taken"), *(["row"] if carry else []),
    )


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself in whole documents: the input's columns, a document's row as often as it is taken."""
    found = mix(docs, carry=docs.columns, **options).filter("copies > 0")
    return found.select(F.explode(F.array_repeat("row", F.col("copies"))).alias("row")).select("row.*")


ORACLE = r"""WITH rows AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    md5('7:' || coalesce(doc_id::VARCHAR, 'null:' || md5(coalesce(text, '')))) AS turn FROM documents),
  src AS (SELECT source, sum(size)::DOUBLE AS s FROM rows GROUP BY source),
  w AS (SELECT source, s, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w FROM src),
  -- The level at which sum(least(2 s, level w)) is the budget: clamp the sources in order of 2 s / w.
  o AS (SELECT *, coalesce(sum(2 * s) OVER (ORDER BY 2 * s / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS clamped,
    sum(w) OVER (ORDER BY 2 * s / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open, 1.5 * sum(s) OVER () AS budget FROM w),
  lvl AS (SELECT arg_min((budget - clamped) / open, 2 * s / w) AS level FROM o WHERE (budget - clamped) / open <= 2 * s / w),
  t AS (SELECT source, s, least(2 * s, coalesce((SELECT level FROM lvl) * w, 2 * s)) AS target FROM o),
  p AS (SELECT *, CASE WHEN s > 0 THEN floor(target / s) ELSE 0 END AS whole FROM t),
  c AS (SELECT r.doc_id, r.size, p.s, p.target, p.whole, round_even(p.target - p.whole * p.s, 0) AS rest,
    coalesce(sum(r.size) OVER (PARTITION BY r.source ORDER BY turn, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
    FROM rows r JOIN p ON r.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, s::BIGINT AS source_size, round(target, 3) AS target, (whole * size + greatest(0, least(size, rest - before)))::BIGINT AS taken FROM c"""
