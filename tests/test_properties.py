"""Numpy checks of what SQL does not cover."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from stemframe.operators import bands, frames, level, pair, spectral
from stemframe.plans import naming
from stemframe.sources import wav


@pytest.fixture(scope="module")
def noise(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(2, 96))
    rows = [(7, c, i, float(x[c, i])) for c in range(2) for i in range(96)]
    return x, spark.createDataFrame(rows, "track long, channel long, pos int, v double")


def dense(df, keys, at="pos"):
    out = {}
    for r in df.collect():
        out.setdefault(tuple(r[k] for k in keys), {})[r[at]] = r["v"]
    return {k: np.array([v[i] for i in sorted(v)]) for k, v in out.items()}


@pytest.mark.parametrize("scheme", [
    lambda d, k: frames.overlap_add_fade(d, k, 30, 10), lambda d, k: frames.overlap_add_triangle(d, k, 20, 0.25),
    lambda d, k: frames.overlap_add_hann(d, k, 24, 12, 6), lambda d, k: frames.overlap_add_hamming(d, k, 25, 10),
    lambda d, k: frames.overlap_add_unfold(d, k, 24, 8), lambda d, k: frames.linear_fader(d, k, 24, 15), lambda d, k: frames.window_fader(d, k, 24, 12),
])
def test_overlap_add_of_the_identity_is_the_input(noise, scheme):
    x, df = noise
    got = dense(scheme(df, ["track", "channel"]), ["track", "channel"])
    assert np.allclose(got[7, 0], x[0]) and np.allclose(got[7, 1], x[1])


def test_fade_window_example(spark):
    w = [r[0] for r in spark.range(10).select(frames.fade_window(F.col("id"), 10, 3)).collect()]
    assert w == [0, 0.5, 1, 1, 1, 1, 1, 1, 0.5, 0]


def test_stft_is_numpys_and_inverts(noise):
    x, df = noise
    spec = spectral.stft(df, ["track", "channel"])
    w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(16) / 16)
    got = {(r.channel, r.frame, r.bin): complex(r.re, r.im) for r in spec.collect()}
    for f in range(11):
        z = np.fft.rfft(x[0, f * 8 : f * 8 + 16] * w)
        assert np.allclose([got[0, f, b] for b in range(9)], z)
    back = dense(spectral.istft(spec, ["track", "channel"]), ["track", "channel"])
    assert np.allclose(back[7, 0][1:95], x[0][1:95])


def test_resampling_keeps_a_slow_sine(spark):
    n = 200
    rows = [(1, i, math.sin(2 * math.pi * i / 25)) for i in range(n)]
    df = spark.createDataFrame(rows, "track long, pos int, v double")
    got = dense(spectral.resample_sinc(df, ["track"], 2.0), ["track"])[(1,)]
    want = np.sin(2 * np.pi * np.arange(2 * n) / 50)
    assert len(got) == 2 * n and np.abs(got - want)[40:-40].max() < 0.02


def test_multichannel_em_stems_add_up_to_the_mixture(spark):
    rng = np.random.default_rng(4)
    rows = [(s, 1, f, b, *map(float, rng.normal(size=4))) for s in "ab" for f in range(12) for b in range(3)]
    t = spark.createDataFrame(rows, "stem string, track long, frame int, bin int, xr double, xi double, yr double, yi double")
    mix = t.groupBy("track", "frame", "bin").agg(*[F.sum(c).alias(c) for c in ("xr", "xi", "yr", "yi")])
    out = pair.multichannel_em(t, mix).groupBy("track", "frame", "bin").agg(*[F.sum(c).alias("s" + c) for c in ("xr", "xi", "yr", "yi")])
    for r in out.join(mix, ["track", "frame", "bin"]).collect():
        assert abs(r.sxr - r.xr) < 1e-3 and abs(r.syi - r.yi) < 1e-3


def test_align_track_finds_the_delay(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=80)
    stem = spark.createDataFrame([(1, i, float(x[i])) for i in range(80)], "track long, pos int, v double")
    mix = stem.withColumn("pos", F.col("pos") + 4)
    out = pair.align_track(mix, stem, [0, 20], 50, 8, [-3.0, 0.0]).select("lag", "db", "level").distinct().collect()
    assert [(r.lag, r.db) for r in out] == [(4, 0.0)] and out[0].level < 1e-9


def test_filterbank_covers_every_bin_once(spark):
    """All bins but that of half the rate, where the last triangle ends; boxes hold that as well."""
    for scale, bins in (("mel", 32), ("tribark", 32), ("erb", 32), ("musical", 33)):
        s = bands.perceptual_filterbank(spark, 64, 16000, 6, scale).groupBy("bin").agg(F.sum("w").alias("w")).filter("w > 0").collect()
        assert len(s) == bins and all(abs(r.w - 1) < 1e-9 for r in s), scale


@pytest.mark.parametrize("block", [16, 64, 65536])
def test_wav_round_trip_at_any_block_size(spark, tmp_path, block):
    x = np.random.default_rng(6).uniform(-0.9, 0.9, size=(300, 2))
    (tmp_path / "t.wav").write_bytes(wav.wav_bytes(x, 8000))
    (tmp_path / "u.txt").write_text("no")
    rows = wav.scan_signals(spark, str(tmp_path), block=block)
    got = dense(wav.from_blocks(rows).drop("sr"), ["channel"])
    assert np.abs(got[(0,)] - x[:, 0]).max() < 1e-4 and np.abs(got[(1,)] - x[:, 1]).max() < 1e-4
    info = wav.scan_media_info(spark, str(tmp_path)).collect()
    assert len(info) == 1 and info[0].sr == 8000 and abs(info[0].duration - 300 / 8000) < 1e-9
    assert wav.list_directory(spark, str(tmp_path)).count() == 1
    again = wav.to_blocks(wav.from_blocks(rows).select("channel", "pos", "v"), ["channel"], block)
    assert again.agg(F.max("n")).first()[0] <= block


def test_names(spark):
    d = spark.createDataFrame([("a?b*c",), (" con ",), ("x" * 400,)], "n string")
    assert [r[0] for r in d.select(naming.clean_filename("n")).collect()][:2] == ["abc", "file_con"]
    assert len(d.select(naming.clean_filename("n")).collect()[2][0]) == 120 + 3 + 80
    t = spark.range(1).select(naming.render_name(F.lit("NAME_STEM_STEM"), F.lit("song"), F.lit("NAME"), F.lit("m"), F.lit(1))).first()[0]
    assert t == "song_song_"  # inserted text is replaced again


def test_silence_has_no_peak(spark):
    d = spark.createDataFrame([(1, "a", 0, 0.0), (1, "b", 0, 0.5)], "track long, stem string, pos int, v double")
    assert [r.stem for r in level.drop_silent_stems(d).collect()] == ["b"]
    assert level.normalize_peak(d, ["track", "stem"], 1.0).agg(F.max("v")).first()[0] == 1.0
