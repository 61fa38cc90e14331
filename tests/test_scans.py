"""Two-level scans against windows over whole series, with blocks of a few rows."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from stemframe.operators import ensemble, frames, pitch, scans


@pytest.fixture(scope="module")
def series(spark):
    """Series of several lengths, one with gaps, one without a known value, and a null key that stays apart."""
    rng = random.Random(3)
    rows = [(t, p, 0.0 if t == 2 or rng.random() < 0.7 else float(rng.randrange(60, 400))) for t, n in enumerate([1, 7, 50, 64, 200]) for p in range(n)]
    rows += [(9, p * p + 5, 0.0 if p % 4 else float(p + 50)) for p in range(40)]
    return spark.createDataFrame(rows, "track long, pos long, f0 double").repartition(4)


def rows_of(frame):
    return sorted(map(tuple, frame.collect()))


@pytest.mark.parametrize("block", [1, 5, 64, 65536])
def test_known_values_around_a_row(series, block):
    known = F.when(F.col("f0") > 0, F.struct("pos", "f0"))
    w = Window.partitionBy("track").orderBy("pos")
    want = series.withColumns({"back": F.last(known, True).over(w.rowsBetween(Window.unboundedPreceding, 0)), "ahead": F.first(known, True).over(w.rowsBetween(0, Window.unboundedFollowing))})
    flat = lambda d: d.select("track", "pos", *[F.coalesce(f"{c}.{x}", F.lit(-1)).alias(f"{c}_{x}") for c in ("back", "ahead") for x in ("pos", "f0")])
    assert rows_of(flat(scans.known_around(series, ["track"], known, block=block))) == rows_of(flat(want))


@pytest.mark.parametrize("block", [3, 64])
def test_curves_and_histories_do_not_depend_on_blocks(series, block):
    assert rows_of(pitch.f0_interpolate_unvoiced(series, ["track"], block)) == rows_of(pitch.f0_interpolate_unvoiced(series, ["track"]))
    curve = series.filter("pos % 17 = 3").select("track", "pos", (F.col("pos") + 100.0).alias("f"))
    assert rows_of(pitch.f0_override(series, curve, ["track"], block)) == rows_of(pitch.f0_override(series, curve, ["track"]))
    history = series.select("track", "pos", F.col("f0").alias("v"), (F.col("pos") % 3 + 1).alias("w"))
    rounded = lambda d: rows_of(d.withColumn("v", F.round("v", 9)))
    assert rounded(ensemble.ema(history, ["track"], 0.9, block)) == rounded(ensemble.ema(history, ["track"], 0.9))
    by_hand = {}
    for t, _, v, w in sorted(map(tuple, history.collect())):
        s = by_hand.get(t, (0.0, 0.0))
        by_hand[t] = (s[0] * 0.9 + v * w, s[1] * 0.9 + w)
    assert rounded(ensemble.ema(history, ["track"], 0.9, block)) == [(t, round(a / b, 9)) for t, (a, b) in sorted(by_hand.items())]


@pytest.mark.parametrize("block", [4, 30, 65536])
def test_moving_sums_and_cuts(series, block):
    dense = series.filter("track < 9").withColumn("v", F.sin(F.col("pos") * F.col("pos") + F.col("track")))
    w = Window.partitionBy("track").orderBy("pos").rowsBetween(0, 7)
    rounded = lambda d: rows_of(d.select("track", "pos", F.round("sum", 9)))
    assert rounded(scans.moving_sum(dense, ["track"], 8, block)) == rounded(dense.withColumn("sum", F.sum("v").over(w)))
    assert rows_of(frames.silence_cut_points(dense, ["track"], 60, 40, 12, 8, block)) == rows_of(frames.silence_cut_points(dense, ["track"], 60, 40, 12, 8))


def test_no_window_holds_more_than_a_block_or_a_row_for_each(series):
    """The plan partitions every window by block, but for those over the carries."""
    plan = scans.ranked(series, ["track"], 5)._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert len(windows) == 3 and sum("__block" in line.split("], [")[1] for line in windows) == 1
