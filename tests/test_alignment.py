"""Correlation, alignment and convolution on block rows against numpy, with blocks shorter and longer than lags and taps."""

import numpy as np
import pytest

from stemframe.operators import blocks, dataset, pair

SCHEMA = "track long, pos int, v double"


def frame_of(spark, signals):
    return spark.createDataFrame([(t, p, float(v)) for t, x in signals.items() for p, v in enumerate(x)], SCHEMA).repartition(4)


def lag_by_loops(a, b, most):
    best = None
    for lag in range(-most, most + 1):
        p = np.arange(max(0, lag), min(len(a), len(b) + lag))
        if p.size:
            c = round(float(np.dot(a[p], b[p - lag])), 9)
            if best is None or c > best[0]:
                best = (c, lag)
    return best[1]


@pytest.mark.parametrize("most, block", [(3, 16), (16, 16), (40, 16), (25, 65536), (300, 64)])
def test_best_lag_equals_loops(spark, most, block):
    rng = np.random.default_rng(most)
    a = {t: rng.normal(size=n) for t, n in enumerate([100, 97, 64, 5, 30])}
    b = {0: np.r_[np.zeros(7), a[0]][:100], 1: a[1][9:], 2: rng.normal(size=130), 3: rng.normal(size=90), 4: np.zeros(30)}
    got = {r.track: r.lag for r in pair.best_lag(frame_of(spark, a), frame_of(spark, b), most, block).collect()}
    assert got == {t: lag_by_loops(a[t], b[t], most) for t in a}


def test_lags_of_signals_with_gaps(spark):
    """Only samples that are there meet; signals that never meet have no lag."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=90)
    a = spark.createDataFrame([(1, p + 37, float(x[p])) for p in range(90) if p % 5] + [(2, 0, -1.0), (2, 50, -3.0), (3, 0, 1.0)], SCHEMA)
    b = spark.createDataFrame([(1, p + 30, float(x[p])) for p in range(90)] + [(2, 10, 2.0), (3, 99, 1.0)], SCHEMA)
    got = {r.track: r.lag for r in pair.best_lag(a, b, 45, 32).collect()}
    assert got == {1: 7, 2: -10}


@pytest.mark.parametrize("block", [16, 65536])
def test_align_track_equals_loops(spark, block):
    rng = np.random.default_rng(5)
    stem = {t: rng.normal(size=120) for t in range(4)}
    mix = {t: 0.05 * rng.normal(size=120) + 10 ** (db / 20) * np.r_[np.zeros(max(lag, 0)), stem[t][max(-lag, 0) :], np.zeros(120)][:120] for t, (lag, db) in enumerate([(5, -3.0), (-4, 0.0), (0, 3.0), (11, -3.0)])}
    rows = pair.align_track(frame_of(spark, mix), frame_of(spark, stem), [0, 30], 60, 12, [-3.0, 0.0, 3.0], block).collect()
    for t in stem:
        tried = []
        for lag in {lag_by_loops(mix[t][p : p + 60], stem[t][p : p + 60], 12) for p in (0, 30)}:
            at = np.arange(120) - lag
            moved = np.where((at >= 0) & (at < 120), stem[t][np.clip(at, 0, 119)], 0)
            for db in (-3.0, 0.0, 3.0):
                d = mix[t] - moved * 10 ** (db / 20)
                tried.append((round(float(np.abs(d).mean()), 9), lag, db, d))
        level, lag, db, d = min(tried, key=lambda x: x[:3])
        own = {r.pos: r for r in rows if r.track == t}
        assert {(r.lag, r.db) for r in own.values()} == {(lag, db)} and sorted(own) == list(range(120))
        assert np.allclose([own[p].v for p in range(120)], d) and abs(own[0].level - level) < 1e-6


@pytest.mark.parametrize("block", [24, 65536])
def test_local_time_correction_equals_loops(spark, block):
    rng = np.random.default_rng(6)
    mix, stem = {t: rng.normal(size=n) for t, n in enumerate([100, 61, 10])}, {t: rng.normal(size=n) for t, n in enumerate([100, 90, 10])}
    got = {}
    for r in pair.local_time_correction(frame_of(spark, mix), frame_of(spark, stem), 16, [0.5, 1.0], 3, block).collect():
        got.setdefault(r.track, {})[r.pos] = r.v
    h = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(16) / 15)
    for t, x in mix.items():
        total, weight = np.zeros(len(x)), np.zeros(len(x))
        for at in range(0, min(len(x), len(stem[t])) - 15, 8):
            tried = [(round(float(np.abs(x[at : at + 16] - np.roll(stem[t][at : at + 16], roll) * g).mean()), 9), abs(roll), roll, g) for roll in range(-3, 4) for g in (0.5, 1.0)]
            _, _, roll, g = min(tried)
            total[at : at + 16] += (x[at : at + 16] - np.roll(stem[t][at : at + 16], roll) * g) * h
            weight[at : at + 16] += h
        want = np.divide(total, weight, out=np.zeros(len(x)), where=weight > 1e-6)
        assert np.allclose([got[t][p] for p in range(len(x))], want)


@pytest.mark.parametrize("taps, block", [(1, 8), (8, 8), (9, 8), (70, 8), (300, 64), (5000, None)])
def test_convolution_equals_numpy_for_any_response(spark, taps, block):
    rng = np.random.default_rng(taps)
    signals = {t: rng.normal(size=n) for t, n in enumerate([100, 8, 1, 64, 2500])}
    h = rng.normal(size=taps)
    block = block or blocks.part_size(taps)
    own = blocks.to_blocks(frame_of(spark, signals), ["track"], block=block)
    made = blocks.convolved(own, ["track"], h, block=block)
    got = {}
    for r in made.collect():
        got.setdefault(r.track, {})[r.block] = r.v
    for t, x in signals.items():
        assert np.allclose(np.concatenate([got[t][b] for b in sorted(got[t])]), np.convolve(x, h)[: len(x)])


def test_reverb_of_a_long_response(spark):
    rng = np.random.default_rng(9)
    x, h = rng.normal(size=3000), rng.normal(size=2000) * 0.01
    df = spark.createDataFrame([(1, s, p, float(v)) for s in ("dry", "wet") for p, v in enumerate(x)], "track long, stem string, pos int, v double")
    got = {(r.stem, r.pos): r.v for r in dataset.reverb_augment(df, "wet", list(h), 0.3).collect()}
    want = x * 0.7 + np.convolve(x, h)[:3000] * 0.3
    assert np.allclose([got["wet", p] for p in range(3000)], want) and np.allclose([got["dry", p] for p in range(3000)], x)
