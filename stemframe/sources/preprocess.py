"""Preprocessing that is done once: finished outputs are skipped, and a run appears as a whole or not at all.

A folder holds ``data/<run>`` (block rows) and ``manifest/<run>`` (one row for each track: the mark of what it was made from). A
run writes its data first, then its manifest beside the others, which is one move of a folder: a run that was
killed before has no manifest, so nothing of it is seen, and the next run removes it. A track is done if a manifest has
its mark, which is a hash of its samples and of the settings.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemframe import fixtures as fx
from stemframe.operators.blocks import BLOCK, from_blocks, to_blocks
from stemframe.operators.spectral import resample_sinc
from stemframe.registry import query
from stemframe.storage import below, delete, discard, new_path, publish, staged

KEYS = ["track", "channel"]


def marks(df: DataFrame, settings: str) -> DataFrame:
    """track and mark of a signal (track, channel, pos, v): equal for equal samples and settings, whatever the order of rows."""
    row = F.xxhash64("channel", "pos", "v")
    sums = df.groupBy("track").agg(F.bit_xor(row).alias("x"), F.sum(F.shiftrightunsigned(row, 20)).alias("s"), F.count(F.lit(1)).alias("n"))
    return sums.select("track", F.concat_ws(":", F.col("x").cast("string"), F.col("s").cast("string"), F.col("n").cast("string"), F.lit(settings)).alias("mark"))


def manifest(spark: SparkSession, folder: str) -> DataFrame | None:
    """track, mark and run of everything that finished runs have written; None where there is no run yet."""
    runs = below(spark, f"{folder}/manifest")
    return spark.read.parquet(*runs) if runs else None


def once(df: DataFrame, folder: str, work: Callable[[DataFrame], DataFrame], settings: str, block: int = BLOCK) -> DataFrame:
    """``work(df)`` of a signal (track, channel, pos, v) as a long-form signal, kept in ``folder`` track by track.

    Only tracks whose mark no finished run has are worked on; a second call with the same input writes nothing. What
    the result reads stays in the folder. ``settings`` names what ``work`` does, with its parameters.
    """
    spark = df.sparkSession
    wanted = staged(marks(df, settings), "marks")
    known = manifest(spark, folder)
    todo = wanted if known is None else wanted.join(known.select("track", "mark"), ["track", "mark"], "left_anti")
    finished = {path.rstrip("/").rsplit("/", 1)[-1] for path in below(spark, f"{folder}/manifest")}
    for path in [*below(spark, f"{folder}/data"), *below(spark, f"{folder}/pending")]:
        if path.rstrip("/").rsplit("/", 1)[-1] not in finished:
            delete(spark, path)  # of a run that did not finish; one job works on a folder at a time
    if not todo.isEmpty():
        run = uuid.uuid4().hex
        todo = staged(todo, "todo")
        to_blocks(work(df.join(todo.select("track"), "track", "left_semi")), KEYS, block=block).write.parquet(f"{folder}/data/{run}")
        todo.withColumn("run", F.lit(run)).write.parquet(f"{folder}/pending/{run}")
        publish(spark, f"{folder}/pending/{run}", f"{folder}/manifest/{run}")
        discard(todo)
    known = manifest(spark, folder)
    if known is None:
        return work(df)  # no track at all
    mine = staged(wanted.join(known, ["track", "mark"]).groupBy("track").agg(F.min("run").alias("run")), "runs")
    discard(wanted)
    runs = sorted(r.run for r in mine.select("run").distinct().collect())  # one for each run
    parts = [spark.read.parquet(f"{folder}/data/{run}").join(mine.filter(F.col("run") == run).select("track"), "track", "left_semi") for run in runs]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return from_blocks(out, KEYS, block=block)


def resample_once(df: DataFrame, folder: str, ratio: float, taps: int = 8) -> DataFrame:
    """Resampled tracks, each computed in one of the calls with this folder."""
    return once(df, folder, lambda d: resample_sinc(d, KEYS, ratio, taps), f"resample {ratio!r} {taps}")


@query("a12_resample_preprocess", f"""WITH {fx.STEREO}, d AS (SELECT track, channel, i, v, i / 2.0 - pos AS d FROM stereo JOIN (SELECT unnest(range(0, 128)) AS i) g ON abs(i / 2.0 - pos) <= 8),
w AS (SELECT track, channel, i, v, (CASE WHEN d = 0 THEN 1 ELSE sin(pi() * d) / (pi() * d) END) * (0.5 + 0.5 * cos(pi() * d / 8)) AS w FROM d)
SELECT track, channel, CAST(i AS BIGINT) AS pos, round(sum(v * w) / sum(w), 5) + 0.0 AS v FROM w GROUP BY track, channel, i""")
def a12(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A first run has a third of the tracks; the second one does the others only.
    df, folder = fx.stereo(spark, sf_dir), new_path(spark, "resampled")
    resample_once(df.filter("track % 3 = 0"), folder, 2.0)
    return resample_once(df, folder, 2.0).withColumn("v", F.round("v", 5) + 0.0)
