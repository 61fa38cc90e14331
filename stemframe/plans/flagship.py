"""Flagship: which estimate of a track is closest to the per-sample median of all estimates?"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemframe import fixtures as fx
from stemframe.registry import query


def median_reference(df: DataFrame) -> DataFrame:
    """Per (track, pos) median over models: the reference signal ``r``."""
    return df.groupBy("track", "pos").agg(F.median("v").alias("r"))


@query("flagship_leaderboard", f"""WITH {fx.SIG}, ref AS (SELECT track, pos, median(v) AS r FROM sig GROUP BY ALL)
SELECT track, model, round(10 * log10((sum(r * r) + 1e-8) / (sum((r - v) * (r - v)) + 1e-8)), 4) AS sdr
FROM sig JOIN ref USING (track, pos) GROUP BY ALL""")
def leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = fx.sig(spark, sf_dir)
    both = df.join(median_reference(df), ["track", "pos"])
    err = F.col("r") - F.col("v")
    sdr = 10 * F.log10((F.sum(F.col("r") * F.col("r")) + 1e-8) / (F.sum(err * err) + 1e-8))
    return both.groupBy("track", "model").agg(F.round(sdr, 4).alias("sdr"))
