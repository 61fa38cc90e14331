"""The block tier against numpy over whole signals, with blocks that are shorter and longer than frames."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stemframe.operators import bands, blocks
from stemframe.operators.metrics import OPTIONS, score


def signals(rng, lengths):
    return {(t, c): rng.normal(size=n) for t, n in enumerate(lengths) for c in (0, 1)}


def long_form(spark, made):
    rows = [(t, c, p, float(v)) for (t, c), x in made.items() for p, v in enumerate(x)]
    return spark.createDataFrame(rows, "track long, channel int, pos int, v double").repartition(5)


def whole_frames(x, size, hop, pad):
    if pad != "none":
        border = size // 2
        x = np.pad(x, border, mode="reflect") if pad == "reflect" and x.size > 2 * border else np.pad(x, border)
    return np.array([x[k : k + size] for k in range(0, x.size - size + 1, hop)])


KEYS = ["track", "channel"]


@pytest.mark.parametrize("pad", ["none", "zero", "reflect"])
@pytest.mark.parametrize("size, hop, block", [(16, 8, 24), (16, 5, 7), (16, 16, 1000), (15, 4, 10), (8, 20, 16)])
def test_frames_of_blocks_equal_those_of_the_signal(spark, size, hop, block, pad):
    made = signals(np.random.default_rng(size + block), [1, 9, 16, 17, 24, 48, 100])
    own = blocks.to_blocks(long_form(spark, made), KEYS, block=block)
    got = {}
    for r in blocks.stft_blocks(own, KEYS, size, hop, block=block, pad=pad).collect():
        got.setdefault((r.track, r.channel), {})[r.frame] = np.array(r.re) + 1j * np.array(r.im)
    for key, x in made.items():
        want = whole_frames(x, size, hop, pad)
        mine = got.get(key, {})
        assert sorted(mine) == list(range(len(want)))
        if len(want):
            assert np.allclose(np.array([mine[k] for k in range(len(want))]), np.fft.rfft(want * blocks.hann_window(size), axis=1))


@pytest.mark.parametrize("size", [1024, 2048, 4096])
def test_round_trip_at_real_sizes(spark, size):
    made = signals(np.random.default_rng(size), [20_000, 4097])
    own = blocks.to_blocks(long_form(spark, made), KEYS, block=3000).cache()
    spec = blocks.stft_blocks(own, KEYS, size, size // 4, block=3000, pad="reflect", scale="sqrt").join(blocks.lengths(own, KEYS, block=3000), KEYS)
    back = blocks.from_blocks(blocks.istft_blocks(spec, KEYS, size, size // 4, block=3000, scale="sqrt", centred=True), KEYS, block=3000)
    rows = back.groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct("pos", "v"))).alias("s")).collect()
    assert len(rows) == len(made)
    for r in rows:
        x = made[r.track, r.channel]
        assert [s.pos for s in r.s] == list(range(x.size)) and np.allclose([s.v for s in r.s], x)


def test_scores_at_real_sizes_equal_whole_signals(spark):
    rng = np.random.default_rng(1)
    r, noise = signals(rng, [30_000, 12_345]), signals(rng, [30_000, 12_345])
    rows = [(t, c, p, float(v), float(v + 0.1 * n)) for (t, c), x in r.items() for p, (v, n) in enumerate(zip(x, noise[t, c]))]
    joined = spark.createDataFrame(rows, "track long, channel int, pos int, r double, e double").repartition(4)
    names = ["l1_freq", "aura_stft", "aura_mrstft", "bleedless", "fullness"]
    small = {(x.track, x.channel): x for x in bands.spectral_scores(blocks.to_blocks(joined, KEYS, ("r", "e"), 5000), KEYS, names, OPTIONS, 5000).collect()}
    whole = {(x.track, x.channel): x for x in score(joined, KEYS, ["sdr", *names]).collect()}
    spec = lambda x, size, hop: np.abs(np.fft.rfft(whole_frames(x, size, hop, "none") * blocks.hann_window(size), axis=1))
    for key, x in r.items():
        y = x + 0.1 * noise[key]
        a, b = spec(x, 2048, 512), spec(y, 2048, 512)
        want = {"l1_freq": 100 / (1 + 10 * np.abs(a - b).mean()), "aura_stft": 100 / (1 + 10 * (np.linalg.norm(a - b) / np.linalg.norm(a) + np.abs(np.log(a) - np.log(b)).mean()))}
        losses = []
        for size in (1024, 2048, 4096):
            m = bands.mel_matrix(128, size, 44100) * bands.a_weighting(np.arange(size // 2 + 1) * 44100 / size)
            p, q = (np.maximum(spec(s, size, size // 4) @ m.T, 1e-8) for s in (x, y))
            losses.append(np.linalg.norm(p - q) / np.linalg.norm(p) + np.abs(np.log(p) - np.log(q)).mean())
        want["aura_mrstft"] = 100 / (1 + 10 * np.mean(losses))
        p, q = (20 * np.log10(np.maximum(s @ bands.mel_matrix(512, 2048, 44100).T, 1e-10)) for s in (a, b))
        d = np.maximum(q, q.max() - 80) - np.maximum(p, p.max() - 80)
        want |= {"bleedless": 100 / (1 + d[d > 0].mean()), "fullness": 100 / (1 - d[d < 0].mean())}
        for name in names:
            assert small[key][name] == pytest.approx(want[name]) == whole[key][name]


def test_signals_too_short_for_a_frame_have_no_score(spark):
    joined = spark.createDataFrame([(t, p, float(p), 0.5 * p) for t, n in ((1, 5), (2, 40)) for p in range(n)], "track long, pos int, r double, e double")
    names = ["l1_freq", "aura_stft", "aura_mrstft", "bleedless", "fullness"]
    got = {r.track: r for r in score(joined, ["track"], ["sdr", *names], size=16, hop=8, sizes=(8, 16, 32), mr_mels=3, n_mels=4, rate=16000).collect()}
    assert got[1].sdr is not None and all(got[1][n] is None for n in names) and all(got[2][n] is not None for n in names)
    rows = {r.track: r for r in bands.time_freq_errors(blocks.to_blocks(joined, ["track"], ("r", "e")), ["track"], 0.5, 0.5, 16, 8, ("l1", "l2", "ratio")).collect()}
    assert rows[1].l1 is None and rows[2].ratio is not None


def test_halo_of_several_blocks(spark):
    made = signals(np.random.default_rng(7), [50])
    own = blocks.to_blocks(long_form(spark, made), KEYS, block=8)
    for r in blocks.with_halo(own, KEYS, ("v",), 11, 19, 8).collect():
        x, start = made[r.track, r.channel], r.block * 8
        assert np.allclose(r.v, x[max(0, start - 11) : start + 8 + 19]) and r.lead == min(11, start) and r.own == min(8, 50 - start)


@pytest.mark.parametrize("ratio, taps, block", [(1.5, 8, 16), (0.5, 8, 16), (44100 / 48000, 4, 64), (48000 / 44100, 8, 65536), (2 ** (-3 / 12), 8, 32), (np.pi, 3, 10), (2.0, 8, 65536), (1 / 3, 16, 20)])
def test_resampling_of_blocks_equals_sinc_sums(spark, ratio, taps, block):
    made = signals(np.random.default_rng(block), [200, 97, 16, 3])
    got = {}
    for r in blocks.resampled(blocks.to_blocks(long_form(spark, made), KEYS, block=block), KEYS, ratio, taps, block).collect():
        got.setdefault((r.track, r.channel), {}).update(zip(range(r.first, r.first + len(r.v)), r.v))
    cut = min(1.0, ratio)
    for key, x in made.items():
        n = int(np.ceil(len(x) * ratio - 1e-12))
        assert sorted(got[key]) == list(range(n))
        d = np.arange(n)[:, None] / ratio - np.arange(len(x))
        w = np.where(np.abs(d) <= taps / cut + 1e-12, cut * np.sinc(cut * d) * (0.5 + 0.5 * np.cos(np.pi * d * cut / taps)), 0)
        assert np.allclose([got[key][i] for i in range(n)], (w * x).sum(axis=1) / w.sum(axis=1), atol=1e-9)


def test_a_bank_has_a_phase_for_each_place_between_inputs():
    assert blocks.FilterBank(1.5, 8).bank.shape[0] == 3 and blocks.FilterBank(48000 / 44100, 8).bank.shape[0] == 160
    assert blocks.FilterBank(2 ** (-3 / 12), 8).bank is None


def test_weighted_error_is_that_of_filtered_signals(spark):
    from stemframe.operators.filters import impulse_response, k_weighting
    from stemframe.operators.metrics import weighted_log_wmse

    rng = np.random.default_rng(4)
    made = {t: rng.normal(size=(3, 5000 + 700 * t)) for t in range(2)}
    rows = [(t, p, *map(float, x[:, p])) for t, x in made.items() for p in range(x.shape[1])]
    joined = spark.createDataFrame(rows, "track long, pos int, r double, e double, m double").repartition(3)
    got = {r.track: r.log_wmse for r in weighted_log_wmse(joined, ["track"], 8000, block=1024).collect()}
    h = impulse_response(k_weighting(8000))
    for t, (r, e, m) in made.items():
        d, w = (np.convolve(x, h)[: r.size] for x in (r - e, m))
        assert got[t] == pytest.approx(-4 * np.log((d**2).mean() / ((w**2).mean() + 1e-8) + 1e-5))
