"""Ensembling: aggregates over many estimates (``model``) of one signal.

All of them are one grouping by the signal's position, with partial aggregation before the exchange; no
group is ever larger than the number of estimates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stemframe import fixtures as fx
from stemframe.operators.scans import BLOCK, ranked
from stemframe.registry import query

KEYS = ["track", "pos"]
# The method that complements each method.
INVERSE_METHODS = {"avg_wave": "avg_wave", "median_wave": "median_wave", "min_wave": "max_wave", "max_wave": "min_wave", "avg_fft": "avg_fft", "median_fft": "median_fft", "min_fft": "max_fft", "max_fft": "min_fft"}


def weighted_mean(v: Column, w: Column) -> Column:
    return F.sum(v * w) / F.sum(w)


def least_magnitude(v: Column, order: Column) -> Column:
    """The value of least magnitude; the first in order wins ties."""
    return F.min_by(v, F.struct(F.abs(v), order))


def most_magnitude(v: Column, order: Column) -> Column:
    """The value of largest magnitude; the first in order wins ties."""
    return F.max_by(v, F.struct(F.abs(v), -order))


def combine(method: str, v: str | Column = "v", order: str | Column = "model", weight: Column | None = None) -> Column:
    """The aggregate of a named method; only the average uses weights."""
    v, order = (F.col(x) if isinstance(x, str) else x for x in (v, order))
    w = F.lit(1.0) if weight is None else weight
    return {
        "avg_wave": lambda: weighted_mean(v, w),
        "median_wave": lambda: F.median(v),
        "min_wave": lambda: least_magnitude(v, order),
        "max_wave": lambda: most_magnitude(v, order),
    }[method]()


def ensemble(df: DataFrame, method: str, keys: list[str] = KEYS, weight: Column | None = None, key: Column | None = None, extreme: str = "min") -> DataFrame:
    """Estimates to one signal by a named method, or by the extreme of a ``key`` expression of your own."""
    if key is not None:
        pick = F.min_by("v", F.struct(key, "model")) if extreme == "min" else F.max_by("v", F.struct(key, -F.col("model")))
        return df.groupBy(*keys).agg(pick.alias("v"))
    return df.groupBy(*keys).agg(combine(method, weight=weight).alias("v"))


def pairwise(df: DataFrame, method: str, keys: list[str] = KEYS) -> DataFrame:
    """Fold over estimates: min or max magnitude where the later one wins ties, within the shortest estimate;
    the tail up to the longest is silence. Average pads to the longest instead."""
    ends = df.groupBy("track", "model").agg((F.max("pos") + 1).alias("n"))
    bounds = ends.groupBy("track").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.count(F.lit(1)).alias("models"))
    # A track's bounds are one row for many samples.
    both = df.join(bounds, "track")
    if method == "average":
        return both.groupBy(*keys, "models").agg(F.sum("v").alias("s")).select(*keys, (F.col("s") / F.col("models")).alias("v"))
    size, later = F.abs("v"), F.col("model")
    pick = F.min_by("v", F.struct(size, -later)) if method == "min" else F.max_by("v", F.struct(size, later))
    return both.groupBy(*keys, "lo").agg(pick.alias("v")).select(*keys, F.when(F.col("pos") < F.col("lo"), F.col("v")).otherwise(0.0).alias("v"))


def quietest_segment(df: DataFrame, parts: int = 240) -> DataFrame:
    """Cut every estimate in ``parts`` near-equal segments and keep, in each, the estimate of least mean magnitude."""
    cut = df.withColumn("part", F.ntile(parts).over(Window.partitionBy("track", "model").orderBy("pos")))
    level = cut.groupBy("track", "part", "model").agg(F.avg(F.abs("v")).alias("level"))
    best = level.groupBy("track", "part").agg(F.min_by("model", F.struct("level", "model")).alias("model"))
    return cut.join(best, ["track", "part", "model"], "left_semi").drop("part")


def blend_two(a: DataFrame, b: DataFrame, share: float, keys: list[str] = KEYS) -> DataFrame:
    """share a + (1 - share) b; the shorter one is padded with silence."""
    both = a.withColumnRenamed("v", "va").join(b.withColumnRenamed("v", "vb"), keys, "full_outer")
    zero = F.lit(0.0)
    return both.select(*keys, (F.coalesce("va", zero) * share + F.coalesce("vb", zero) * (1 - share)).alias("v"))


def inverse_weights(df: DataFrame, keys: list[str]) -> DataFrame:
    """Each weight becomes the sum of all weights minus itself."""
    return df.withColumn("w", F.sum("w").over(Window.partitionBy(*keys)) - F.col("w"))


def parse_weights(text: str) -> Column:
    """Comma-separated weights as an array of doubles."""
    return F.transform(F.split(F.lit(text), ","), lambda x: F.trim(x).cast("double"))


def manual_ensemble(df: DataFrame, method: str, weights: str) -> DataFrame:
    """Estimates in order of ``model``, weighted by a comma-separated list (repeated if it is shorter)."""
    w = parse_weights(weights)
    at = F.pmod(F.col("model"), F.size(w)).cast("int")
    return ensemble(df, method, weight=F.get(w, at))


def ema(df: DataFrame, keys: list[str], beta: float, block: int = BLOCK) -> DataFrame:
    """Exponentially weighted mean of a history (pos, v, w): older entries count beta times less each step."""
    decayed = ranked(df, keys, block).withColumn("b", F.pow(F.lit(beta), F.col("rows") - F.col("turn")))
    return decayed.groupBy(*keys).agg((F.sum(F.col("v") * F.col("w") * F.col("b")) / F.sum(F.col("w") * F.col("b"))).alias("v"))


def _wave(name: str, method: str, agg: str) -> None:
    @query(name, f"WITH {fx.SIG} SELECT track, pos, round({agg}, 6) AS v FROM sig GROUP BY track, pos")
    def run(spark: SparkSession, sf_dir: str, method=method) -> DataFrame:
        weight = (F.col("model") % 5 + 1).cast("double") if method == "avg_wave" else None
        return ensemble(fx.sig(spark, sf_dir), method, weight=weight).withColumn("v", F.round("v", 6))


_wave("f1_ensemble_avg_wave", "avg_wave", "sum(v * (model % 5 + 1)) / sum(model % 5 + 1)")
_wave("f2_ensemble_median_wave", "median_wave", "median(v)")
_wave("f3_ensemble_min_wave", "min_wave", "arg_min(v, (abs(v), model))")
_wave("f3_ensemble_max_wave", "max_wave", "arg_max(v, (abs(v), -model))")

_ENDS = "q AS (SELECT * FROM sig WHERE pos < 64 - model % 4), e AS (SELECT track, min(n) AS lo, count(*) AS models FROM (SELECT track, model, max(pos) + 1 AS n FROM q GROUP BY ALL) GROUP BY track)"


@query("f7_ensemble_pairwise", f"""WITH {fx.SIG}, {_ENDS}
SELECT 'min' AS method, track, pos, round(CASE WHEN pos < any_value(lo) THEN arg_min(v, (abs(v), -model)) ELSE 0 END, 6) AS v FROM q JOIN e USING (track) GROUP BY track, pos
UNION ALL SELECT 'max', track, pos, round(CASE WHEN pos < any_value(lo) THEN arg_max(v, (abs(v), model)) ELSE 0 END, 6) FROM q JOIN e USING (track) GROUP BY track, pos
UNION ALL SELECT 'average', track, pos, round(sum(v) / any_value(models), 6) FROM q JOIN e USING (track) GROUP BY track, pos""")
def f7(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = fx.sig(spark, sf_dir).filter("pos < 64 - model % 4")
    out = [pairwise(df, m).select(F.lit(m).alias("method"), "track", "pos", F.round("v", 6).alias("v")) for m in ("min", "max", "average")]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("f8_ensemble_quietest_segment", f"""WITH {fx.SIG}, c AS (SELECT *, ntile(7) OVER (PARTITION BY track, model ORDER BY pos) AS part FROM sig),
b AS (SELECT track, part, arg_min(model, (level, model)) AS model FROM (SELECT track, part, model, avg(abs(v)) AS level FROM c GROUP BY ALL) GROUP BY ALL)
SELECT track, model, pos, round(v, 6) AS v FROM c JOIN b USING (track, part, model)""")
def f8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quietest_segment(fx.sig(spark, sf_dir), 7).select("track", "model", "pos", F.round("v", 6).alias("v"))


@query("f9_blend_two", f"""WITH {fx.SIG}, a AS (SELECT track, pos, v FROM sig WHERE model % 50 = 1 AND pos < 60 QUALIFY row_number() OVER (PARTITION BY track, pos ORDER BY model) = 1), b AS (SELECT track, pos, v FROM sig WHERE model % 50 <> 1 QUALIFY row_number() OVER (PARTITION BY track, pos ORDER BY model) = 1)
SELECT track, pos, round(coalesce(a.v, 0) * 0.3 + coalesce(b.v, 0) * 0.7, 6) AS v FROM a FULL JOIN b USING (track, pos)""")
def f9(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = fx.sig(spark, sf_dir)
    first = lambda d: d.groupBy("track", "pos").agg(F.min_by("v", "model").alias("v"))
    return blend_two(first(df.filter("model % 50 = 1 AND pos < 60")), first(df.filter("model % 50 <> 1")), 0.3).withColumn("v", F.round("v", 6))


@query("f10_bag_weighted", f"""WITH {fx.SIG}, w AS (SELECT DISTINCT model, track, model % 3 + CAST(track AS INTEGER) % 2 AS w FROM sig)
SELECT track, pos, round(sum(v * w) / sum(w), 6) AS v FROM sig JOIN w USING (model, track) GROUP BY track, pos""")
def f10(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = fx.sig(spark, sf_dir)
    weights = df.select("model", "track").distinct().withColumn("w", (F.col("model") % 3 + F.col("track").cast("int") % 2).cast("double"))
    return bag_weighted(df, weights).withColumn("v", F.round("v", 6))


def bag_weighted(df: DataFrame, weights: DataFrame) -> DataFrame:
    """Weighted mean with a weight for each (model, source): weights has model, track, w."""
    return df.join(weights, ["model", "track"]).groupBy("track", "pos").agg(weighted_mean(F.col("v"), F.col("w")).alias("v"))


@query("f11_inverse_weights", f"""WITH {fx.SIG}, w AS (SELECT DISTINCT track, model, model % 5 + 1 AS w FROM sig)
SELECT track, model, CAST(sum(w) OVER (PARTITION BY track) - w AS BIGINT) AS w, CASE WHEN model % 2 = 0 THEN 'max_wave' ELSE 'min_wave' END AS inverse FROM w""")
def f11(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = fx.sig(spark, sf_dir).select("track", "model", (F.col("model") % 5 + 1).alias("w")).distinct()
    methods = F.create_map(*[F.lit(x) for kv in INVERSE_METHODS.items() for x in kv])
    method = F.when(F.col("model") % 2 == 0, "min_wave").otherwise("max_wave")
    return inverse_weights(w, ["track"]).select("track", "model", "w", methods[method].alias("inverse"))


def dual_ensemble(df: DataFrame, method: str, weight: Column, invert_weights: bool = True, mixture: DataFrame | None = None) -> DataFrame:
    """Primary ensemble by ``method``, and the complements' by the inverse method with (inverse) weights.

    A complement is the mixture minus the estimate; the mixture defaults to the sum of a track's estimates.
    """
    if mixture is None:
        mixture = df.groupBy("track", "pos").agg(F.sum("v").alias("m"))
    weighted = df.withColumn("w", weight)
    primary = ensemble(weighted, method, weight=F.col("w")).withColumn("part", F.lit("primary"))
    other = weighted.join(mixture, ["track", "pos"]).withColumn("v", F.col("m") - F.col("v")).drop("m")
    if invert_weights:
        other = inverse_weights(other, ["track", "pos"])
    return primary.unionByName(ensemble(other, INVERSE_METHODS[method], weight=F.col("w")).withColumn("part", F.lit("secondary")))


@query("f12_dual_ensemble", f"""WITH {fx.SIG}, m AS (SELECT track, pos, sum(v) AS m FROM sig GROUP BY ALL), o AS (SELECT track, model, pos, m - v AS v, sum(model % 5 + 1) OVER (PARTITION BY track, pos) - (model % 5 + 1) AS w FROM sig JOIN m USING (track, pos))
SELECT 'primary' AS part, track, pos, round(sum(v * (model % 5 + 1)) / sum(model % 5 + 1), 5) AS v FROM sig GROUP BY track, pos
UNION ALL SELECT 'secondary', track, pos, round(sum(v * w) / sum(w), 5) FROM o GROUP BY track, pos""")
def f12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dual_ensemble(fx.sig(spark, sf_dir), "avg_wave", (F.col("model") % 5 + 1).cast("double")).withColumn("v", F.round("v", 5))


@query("f13_manual_ensemble", f"WITH {fx.SIG}, w AS (SELECT *, [0.5, 1, 2.5][model % 3 + 1] AS w FROM sig) SELECT track, pos, round(sum(v * w) / sum(w), 6) AS v FROM w GROUP BY track, pos")
def f13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manual_ensemble(fx.sig(spark, sf_dir), "avg_wave", "0.5, 1, 2.5").withColumn("v", F.round("v", 6))


@query("f14_ema_metrics", f"""WITH {fx.EVT}, b AS (SELECT *, pow(0.9, count(*) OVER (PARTITION BY track, stem) - 1 - pos) AS b FROM evt)
SELECT track, stem, round(sum(v * (pos % 3 + 1) * b) / sum((pos % 3 + 1) * b), 4) AS v FROM b GROUP BY track, stem""")
def f14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ema(fx.evt(spark, sf_dir).withColumn("w", F.col("pos") % 3 + 1), ["track", "stem"], 0.9).withColumn("v", F.round("v", 4))


@query("u3_ensemble_by_key", f"WITH {fx.SIG} SELECT track, pos, round(arg_min(v, (abs(v - 0.05), model)), 6) AS v FROM sig GROUP BY track, pos")
def u3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ensemble(fx.sig(spark, sf_dir), "", key=F.abs(F.col("v") - 0.05)).withColumn("v", F.round("v", 6))
