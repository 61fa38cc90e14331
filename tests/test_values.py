"""Operators without SQL against their definitions in numpy, written as plain loops over small inputs."""

import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from stemframe import catalogue
from stemframe import fixtures as fx
from stemframe.operators import bands, dataset, filters, frames, pair, spectral
from stemframe.sources import wav
from stemframe.streaming import jobs

SF = "/root/testdata/sf0.001"


def run(spark, name):
    return catalogue.queries()[name](spark, SF).collect()


@pytest.fixture(scope="module")
def stereo(spark):
    x = {}
    for r in fx.stereo(spark, SF).collect():
        x.setdefault((r.track, r.channel), np.zeros(64))[r.pos] = r.v
    return x


def polynomials(order, cutoff, rate):
    """b and a of a Butterworth high-pass, from the zeros and poles of its analogue."""
    warped = 4 * math.tan(math.pi * cutoff / rate)
    poles = [warped / np.exp(1j * math.pi * (2 * k + order + 1) / (2 * order)) for k in range(order)]
    z = [(4 + p) / (4 - p) for p in poles]
    a = np.real(np.poly(z))
    b = np.poly(np.ones(order))
    return b * (np.polyval(a, -1) / np.polyval(b, -1)), a


def recursion(b, a, x, state):
    state, y = list(state), []
    for v in x:
        out = b[0] * v + state[0]
        state = [(state[i + 1] if i + 1 < len(state) else 0.0) + b[i + 1] * v - a[i + 1] * out for i in range(len(state))]
        y.append(out)
    return np.array(y)


def forwards_and_backwards(b, a, x):
    n = len(a) - 1
    # The state in which a constant input gives a constant output.
    m = np.eye(n) - np.vstack([-a[1:], np.eye(n)[:-1]]).T
    rest = np.linalg.solve(m, b[1:] - a[1:] * b[0])
    odd = min(3 * len(a), len(x) - 1)
    ext = np.concatenate((2 * x[0] - x[odd:0:-1], x, 2 * x[-1] - x[-2 : -odd - 2 : -1]))
    y = recursion(b, a, ext, rest * ext[0])
    return recursion(b, a, y[::-1], rest * y[-1])[::-1][odd : odd + len(x)]


def test_highpass_equals_the_recursion(spark, stereo):
    b, a = polynomials(5, 0.05, 1)
    want = {k: forwards_and_backwards(b, a, x) for k, x in stereo.items()}
    got = run(spark, "d15_highpass_iir")
    assert len(got) == 64 * len(want) and all(abs(r.v - want[r.track, r.channel][r.pos]) < 2e-5 for r in got)


@pytest.mark.parametrize("block", [None, 1000])
def test_highpass_over_blocks_equals_the_recursion(spark, block):
    rng = np.random.default_rng(1)
    x = np.cumsum(rng.normal(size=7000)) / 20
    df = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(x)], "track long, pos int, v double")
    got = filters.filtered(df, ["track"], filters.butterworth_highpass(5, 0.02, 1), zero_phase=True, block=block).orderBy("pos").collect()
    want = forwards_and_backwards(*polynomials(5, 0.02, 1), x)
    assert [r.pos for r in got] == list(range(7000)) and np.abs(np.array([r.v for r in got]) - want).max() < 1e-6


def test_the_halo_follows_from_the_poles():
    """At 48 Hz of 16 kHz the response lasts for thousands of samples, and what is beyond its end does not matter."""
    h = filters.impulse_response(filters.butterworth_highpass(5, 48, 16000))
    assert 3000 < h.size < 6000 and np.abs(h[-100:]).max() < 1e-9
    gain = np.abs(np.fft.rfft(h, 1 << 17))
    hz = np.arange(gain.size) * 16000 / (1 << 17)
    assert np.allclose(gain, 1 / np.sqrt(1 + (np.tan(math.pi * 48 / 16000) / np.maximum(np.tan(math.pi * np.minimum(hz, 7999.9) / 16000), 1e-12)) ** 10), atol=1e-6)


def test_k_weighting(spark):
    h = filters.impulse_response(filters.k_weighting(48000))
    at = lambda f: 20 * np.log10(abs((h * np.exp(-2j * math.pi * f / 48000 * np.arange(h.size))).sum()))
    assert abs(at(997) - 0.69) < 0.15 and abs(at(10000) - 4.0) < 0.1 and at(20) < -10
    rate, t = 8000, np.arange(8000)
    x = 0.5 * np.sin(2 * math.pi * 997 / rate * t)
    df = spark.createDataFrame([(1, int(i), float(v)) for i, v in zip(t, x)], "track long, pos int, v double")
    y = x
    for b0, b1, b2, a1, a2 in filters.k_weighting(rate):
        y = recursion([b0, b1, b2], [1, a1, a2], y, [0.0, 0.0])
    z = [np.mean(y[k : k + 3200] ** 2) for k in range(0, 8000 - 3200 + 1, 800)]
    got = dataset.integrated_loudness(df, ["track"], 3200, 800, rate=rate).first().lufs
    assert abs(got - (-0.691 + 10 * math.log10(np.mean(z)))) < 1e-6
    level = dataset.loudness_normalize(df, ["track"], 3200, 800, -17.0, rate=rate)
    assert abs(dataset.integrated_loudness(level, ["track"], 3200, 800, rate=rate).first().lufs + 17) < 1e-6


def loop_triangles(n_fft, sr, n, there, back):
    points = [back(there(0) + (there(sr / 2) - there(0)) * i / (n + 1)) for i in range(n + 2)]
    return np.array([[max(0.0, min((f - points[i]) / (points[i + 1] - points[i]), (points[i + 2] - f) / (points[i + 2] - points[i + 1]))) for f in (k * sr / n_fft for k in range(n_fft // 2 + 1))] for i in range(n)])


def test_filterbanks():
    n_fft, sr, n = 512, 16000, 12
    mel = loop_triangles(n_fft, sr, n, lambda f: math.log10(1 + f / 700), lambda x: 700 * (10**x - 1))
    mel[0, 0] = 1
    assert np.allclose(bands.filterbank_matrix(n_fft, sr, n, "mel"), mel)
    bark = loop_triangles(n_fft, sr, n, lambda f: math.asinh(f / 600), lambda x: 600 * math.sinh(x))
    bark[0, : np.flatnonzero(bark[0])[0]] = 1
    assert np.allclose(bands.filterbank_matrix(n_fft, sr, n, "tribark"), bark)
    erb = loop_triangles(n_fft, sr, n, lambda f: math.log(1 + 0.00437 * f), lambda x: (math.exp(x) - 1) / 0.00437)
    erb[0, : np.flatnonzero(erb[0])[0]] = 1
    assert np.allclose(bands.filterbank_matrix(n_fft, sr, n, "erb"), erb)
    musical = bands.filterbank_matrix(n_fft, sr, n, "musical")
    step = sr / n_fft
    ratio = (sr / 2 / step) ** (1 / n)
    midi = lambda f: 69 + 12 * math.log2(f / 440)
    for i in range(n):
        centre = 440 * 2 ** ((midi(step) + (midi(sr / 2) - midi(step)) * i / (n - 1) - 69) / 12)
        on = [k for k in range(n_fft // 2 + 1) if math.floor(centre / ratio / step) <= k <= math.ceil(centre * ratio / step) or i == 0 and k < math.floor(centre / ratio / step)]
        assert list(np.flatnonzero(musical[i])) == on and set(musical[i, on]) == {1.0}
    curves = bands.filterbank_matrix(n_fft, sr, n, "bark")
    mini = bands.filterbank_matrix(n_fft, sr, n, "minibark")
    z = lambda f: 6 * math.asinh(f / 600)
    for i in range(n):
        centre = z(sr / 2) * (i + 2) / (n + 3)
        for k in np.flatnonzero(curves[i]):
            d = z(k * sr / (n_fft + 1)) - centre
            assert abs(curves[i, k] - (1 if -0.5 < d < 0.5 else 10 ** (d + 0.5) if d <= -0.5 else 10 ** (-2.5 * (d - 0.5)))) < 1e-9
        assert np.array_equal(mini[i], np.where(curves[i] ** 2 < 0.5 - 1e-12, 0, curves[i]))


def test_filterbank_weights_add_up_to_one(spark):
    for scale in ("mel", "erb", "tribark", "bark", "minibark", "musical"):
        rows = bands.perceptual_filterbank(spark, 256, 16000, 10, scale).collect()
        total = {}
        for r in rows:
            total[r.bin] = total.get(r.bin, 0) + r.w
        assert all(abs(v - 1) < 1e-9 for v in total.values() if v)
        for band in {r.band for r in rows}:
            at = sorted(r.bin for r in rows if r.band == band)
            assert at == list(range(at[0], at[-1] + 1))


def spectra(x, size, hop):
    w = 0.5 - 0.5 * np.cos(2 * math.pi * np.arange(size) / size)
    return np.array([np.fft.rfft(x[k : k + size] * w) for k in range(0, len(x) - size + 1, hop)])


def loop_mel(n_mels, n_fft, sr):
    w = loop_triangles(n_fft, sr, n_mels, lambda f: math.log10(1 + f / 700), lambda x: 700 * (10**x - 1))
    points = [700 * ((1 + sr / 2 / 700) ** (i / (n_mels + 1)) - 1) for i in range(n_mels + 2)]
    return w * np.array([[2 / (points[i + 2] - points[i])] for i in range(n_mels)])


def test_mrstft_equals_loops(spark, stereo):
    def a_curve(f):
        f2 = f * f
        return 12194**2 * f2 * f2 / ((f2 + 20.6**2) * np.sqrt((f2 + 107.7**2) * (f2 + 737.9**2)) * (f2 + 12194**2)) * 10**0.1

    got = {(r.track, r.channel): r.score for r in run(spark, "i5_aura_mrstft")}
    assert len(got) == len([k for k in stereo if k[0] % 2 == 0])
    for (track, channel), score in list(got.items())[:60]:
        losses = []
        for size in (8, 16, 32):
            mel = loop_mel(3, size, 16000)
            shown = lambda x: np.maximum((np.abs(spectra(x, size, size // 4)) * a_curve(np.arange(size // 2 + 1) * 16000 / size)) @ mel.T, 1e-8)  # noqa: E731,B023
            x, y = shown(stereo[track, channel]), shown(stereo[track + 1, channel])
            on = mel.any(axis=1)
            x, y = x[:, on], y[:, on]
            losses.append(np.sqrt(((x - y) ** 2).sum()) / np.sqrt((x**2).sum()) + np.abs(np.log(x) - np.log(y)).mean())
        assert abs(score - 100 / (1 + 10 * np.mean(losses))) < 2e-4


def test_bleedless_and_fullness_equal_loops(spark, stereo):
    mel = loop_mel(4, 16, 16000)
    for r in run(spark, "i7_bleedless_fullness")[:60]:
        levels = []
        for track in (r.track, r.track + 1):
            db = 20 * np.log10(np.maximum(np.abs(spectra(stereo[track, r.channel], 16, 8)) @ mel.T, 1e-10))
            levels.append(np.maximum(db, db.max() - 80))
        d = levels[1] - levels[0]
        up, down = (d[d > 0].mean() if (d > 0).any() else 0), (d[d < 0].mean() if (d < 0).any() else 0)
        assert abs(r.bleedless - 100 / (1 + up)) < 2e-4 and abs(r.fullness - 100 / (1 - down)) < 2e-4


def test_resampling_equals_sinc_sums(spark, stereo):
    def sinc_sum(x, ratio, taps=8):
        out, cut = [], min(1.0, ratio)
        for i in range(math.ceil(len(x) * ratio)):
            s = w = 0.0
            for k, v in enumerate(x):
                d = i / ratio - k
                if abs(d) <= taps / cut:
                    g = cut * np.sinc(cut * d) * (0.5 + 0.5 * math.cos(math.pi * d * cut / taps))
                    s, w = s + v * g, w + g
            out.append(s / w)
        return out

    for name, ratio in (("d12_resample", 1.5), ("d14_pitch_resample", 2 ** (-3 / 12))):
        got = {(r.track, r.channel, r.pos): r.v for r in run(spark, name)}
        for track, channel in list(stereo)[:6]:
            want = sinc_sum(stereo[track, channel], ratio)
            assert sum(k[:2] == (track, channel) for k in got) == len(want)
            assert all(abs(got[track, channel, i] - v) < 2e-5 for i, v in enumerate(want))


def test_multichannel_em_equals_loops(spark):
    rng = np.random.default_rng(2)
    y = 30 * (rng.normal(size=(2, 5, 3, 2)) + 1j * rng.normal(size=(2, 5, 3, 2)))  # stem, frame, bin, channel
    x = y.sum(axis=0)
    frame = lambda z, f, b: (*[float(part) for c in range(2) for part in (z[f, b, c].real, z[f, b, c].imag)],)
    cols = "xr double, xi double, yr double, yi double"
    targets = spark.createDataFrame([(1, f"s{j}", f, b, *frame(y[j], f, b)) for j in range(2) for f in range(5) for b in range(3)], f"track long, stem string, frame int, bin int, {cols}")
    mix = spark.createDataFrame([(1, f, b, *frame(x, f, b)) for f in range(5) for b in range(3)], f"track long, frame int, bin int, {cols}")
    eps, scale = 1e-10, max(1, np.abs(x).max() / 10)
    z, m = y / scale, x / scale
    for _ in range(2):
        v = (np.abs(z) ** 2).mean(axis=3)
        r = np.einsum("jfbc,jfbd->jbcd", z, z.conj()) / (v.sum(axis=1) + eps)[:, :, None, None]
        total = np.einsum("jfb,jbcd->fbcd", v, r) + math.sqrt(eps) * np.eye(2)
        z = np.einsum("jfb,jbcd,fbde,fbe->jfbc", v, r, np.linalg.inv(total), m)
    z *= scale
    got = pair.multichannel_em(targets, mix, rounds=2, eps=eps).collect()
    assert scale > 1 and len(got) == 30
    for r in got:
        assert np.allclose([r.xr + 1j * r.xi, r.yr + 1j * r.yi], z[int(r.stem[1]), r.frame, r.bin], atol=1e-6)


@pytest.mark.parametrize("channels, stems, tile", [(1, 2, 4), (2, 3, 100), (3, 2, 4), (4, 3, 3)])
def test_wiener_em_of_any_number_of_channels(spark, channels, stems, tile):
    rng = np.random.default_rng(channels)
    y = 20 * (rng.normal(size=(stems, 9, 2, channels)) + 1j * rng.normal(size=(stems, 9, 2, channels)))
    x = y.sum(axis=0) + rng.normal(size=(9, 2, channels))
    both = lambda z: ([float(c) for c in z.real], [float(c) for c in z.imag])
    cols = "frame int, bin int, re array<double>, im array<double>"
    targets = spark.createDataFrame([(1, f"s{j}", f, b, *both(y[j, f, b])) for j in range(stems) for f in range(9) for b in range(2)], f"track long, stem string, {cols}").repartition(4)
    mix = spark.createDataFrame([(1, f, b, *both(x[f, b])) for f in range(9) for b in range(2)], f"track long, {cols}")
    scale = max(1, np.abs(x).max() / 10)
    z, m = y / scale, x / scale
    for _ in range(2):
        v = (np.abs(z) ** 2).mean(axis=3)
        r = np.einsum("jfbc,jfbd->jbcd", z, z.conj()) / (v.sum(axis=1) + 1e-10)[:, :, None, None]
        total = np.einsum("jfb,jbcd->fbcd", v, r) + 1e-5 * np.eye(channels)
        z = np.einsum("jfb,jbcd,fbde,fbe->jfbc", v, r, np.linalg.inv(total), m)
    got = pair.wiener_em(targets, mix, channels, 2, tile=tile).collect()
    assert len(got) == stems * 18
    for row in got:
        assert np.allclose(np.array(row.re) + 1j * np.array(row.im), z[int(row.stem[1]), row.frame, row.bin] * scale, atol=1e-6)


def test_local_time_correction_equals_loops(spark):
    rng = np.random.default_rng(3)
    size, hop, n, most, gains = 16, 8, 64, 3, [0.5, 1.0]
    stem = rng.normal(size=n)
    mix = np.roll(stem, 2) * 0.5 + 0.01 * rng.normal(size=n)
    s, w = np.zeros(n), np.zeros(n)
    h = 0.5 - 0.5 * np.cos(2 * math.pi * np.arange(size) / (size - 1))
    for k in range(0, n - size + 1, hop):
        best = min(((round(float(np.abs(mix[k : k + size] - np.roll(stem[k : k + size], r) * g).mean()), 9), abs(r), r, g) for r in range(-most, most + 1) for g in gains))
        s[k : k + size] += (mix[k : k + size] - np.roll(stem[k : k + size], best[2]) * best[3]) * h
        w[k : k + size] += h
    want = np.where(w > 1e-6, s / np.maximum(w, 1e-12), 0)
    df = lambda x: spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(x)], "track long, pos int, v double")
    got = pair.local_time_correction(df(mix), df(stem), size, gains, most).orderBy("pos").collect()
    assert np.allclose([r.v for r in got], want, atol=1e-9)


def test_frames_cover_the_tail_by_policy(spark):
    df = spark.createDataFrame([(t, i, float(i)) for t, n in ((1, 17), (2, 14), (3, 3)) for i in range(n)], "track long, pos int, v double")

    def chunks(tail):
        out = {}
        for r in frames.frame(df, ["track"], 8, 4, tail).collect():
            out.setdefault((r.track, r.chunk), {})[r.i] = r.v
        return {k: [v[i] for i in sorted(v)] for k, v in out.items()}

    plain, mirrored = chunks("pad"), chunks("reflect")
    assert plain[1, 4] == [16.0] and mirrored[1, 4] == [16.0]  # one of eight: not more than half
    assert plain[1, 3] == [12.0, 13.0, 14.0, 15.0, 16.0] and mirrored[1, 3] == [12.0, 13.0, 14.0, 15.0, 16.0, 15.0, 14.0, 13.0]
    assert mirrored[2, 2] == [8.0, 9.0, 10.0, 11.0, 12.0, 13.0, 12.0, 11.0] and (3, 0) not in chunks("drop") and chunks("align")[3, 0] == [0.0, 1.0, 2.0]


@pytest.mark.parametrize("bits", [8, 16, 24, 32])
def test_wav_of_any_width(spark, bits):
    x = np.array([[0.0, 1.0], [-1.0, 0.5], [0.25, -0.75]])
    got, sr = wav.pcm_samples(wav.wav_bytes(x, 22050, bits))
    assert sr == 22050 and np.abs(got - x).max() <= 1.0 / ((1 << (bits - 1)) - 1)


def test_wav_of_extensible_floats_and_broken_files(spark):
    data = np.array([0.5, -0.25], "<f4").tobytes()
    fmt = struct.pack("<HHIIHHHHI", 0xFFFE, 1, 8000, 32000, 4, 32, 22, 32, 4) + struct.pack("<H", 3) + bytes(14)
    content = struct.pack("<4sI4s4sI", b"RIFF", 36 + len(fmt) + len(data), b"WAVE", b"fmt ", len(fmt)) + fmt + struct.pack("<4sI", b"data", len(data)) + data
    files = [("a/good.wav", content), ("a/text.wav", b"no sound"), ("a/none.wav", b""), ("a/mp3.wav", content.replace(struct.pack("<H", 3) + bytes(14), struct.pack("<H", 85) + bytes(14)))]
    df = spark.createDataFrame(files, "path string, content binary")
    rows = {r.track: r for r in wav.decoded(df).collect()}
    assert rows["good"].samples == [0.5, -0.25] and rows["good"].error is None and all(rows[k].n == 0 and rows[k].error for k in ("text", "none", "mp3"))
    assert sorted((r.pos, r.v) for r in wav.from_blocks(wav.decoded(df)).collect()) == [(0, 0.5), (1, -0.25)]
    info = {r.path: r for r in wav.media_info(df).collect()}
    assert info["a/good.wav"].duration == 2 / 8000 and info["a/text.wav"].error


def test_log_mel_of_moved_pitch_follows_the_sine(spark):
    n = np.arange(512)
    df = lambda f: spark.createDataFrame([(1, 0, int(i), float(v)) for i, v in zip(n, np.sin(2 * math.pi * f * n))], "track long, channel int, pos int, v double")
    w = spectral.mel_weights(spark, 16, 64, 16000)
    top = lambda d, k: d.groupBy("band").agg(F.avg("v").alias("v")).orderBy(F.desc("v")).first().band
    up = spectral.log_mel_shifted(df(0.1), w, ["track", "channel"], 64, 32, 12)
    assert top(up, 12) == top(spectral.log_mel_shifted(df(0.2), w, ["track", "channel"], 64, 32), 0)


def test_latest_status_of_a_job_over_batches(spark, tmp_path):
    """Three files, a batch each: repeated deliveries, a late row, and a status that is not the last to arrive."""
    schema = "event_id long, user_id long, event_type string, ts timestamp"
    batches = [
        [(1, 1, "queued", "2024-01-01 00:00:00"), (2, 2, "queued", "2024-01-01 00:00:00")],
        [(1, 1, "queued", "2024-01-01 00:00:00"), (4, 1, "done", "2024-01-03 00:00:00"), (3, 1, "running", "2024-01-02 00:00:00")],
        [(5, 2, "running", "2023-06-01 00:00:00"), (6, 2, "failed", "2024-01-03 12:00:00"), (6, 2, "failed", "2024-01-03 12:00:00")],
    ]
    for i, rows in enumerate(batches):
        df = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
        df.coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    got = {(r.user_id, r.event_type, r.n) for r in jobs.history_latest(stream, "10 days").collect()}
    assert got == {(1, "done", 3), (2, "failed", 2)}  # the row of June came too late


def test_a_status_table_goes_on_after_a_restart(spark, tmp_path):
    """Stopped between batches, and within one whose version was written but not committed: the same rows as in one run."""
    import shutil

    schema = "event_id long, user_id long, event_type string, ts timestamp"
    batches = [[(100 * k + u, u, f"state{k}", f"2024-01-{k + 1:02d} 00:00:{u:02d}") for u in range(k, 30, k + 1)] for k in range(5)]

    def land(k):
        df = spark.createDataFrame(batches[k], "event_id long, user_id long, event_type string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
        df.coalesce(1).write.parquet(f"{tmp_path}/in/{k}")

    def run(where):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
        return sorted((r.user_id, r.event_type, r.n) for r in jobs.history_latest(stream, "10 days", where=str(where)).collect())

    for k in range(3):
        land(k)
    run(tmp_path / "stays")
    land(3)
    run(tmp_path / "stays")
    shutil.copytree(tmp_path / "stays", tmp_path / "before")
    land(4)
    want = run(tmp_path / "stays")
    latest = {}
    for k, rows in enumerate(batches):
        for _, u, status, _ in rows:
            latest[u] = (status, latest.get(u, ("", 0))[1] + 1)
    assert want == sorted((u, *v) for u, v in latest.items()) == run(tmp_path / "once")
    # The last batch's version is there, its commit is not: it is run again.
    shutil.copytree(tmp_path / "stays" / "table", tmp_path / "before" / "table", dirs_exist_ok=True)
    assert run(tmp_path / "before") == want
    held = [p for p in (tmp_path / "stays" / "table").glob("version=*/bucket=*")]
    assert len(held) <= 2 * 30, "versions that nothing needs are gone"


def test_windows_close_at_the_end_and_late_rows_drop(spark, tmp_path):
    schema = "user_id long, value double, ts timestamp"
    # A batch drops what is late by the watermark that the batch before it began with.
    batches = [[(1, 1.0, "2024-01-01 00:10:00"), (1, 3.0, "2024-01-01 09:10:00")], [(1, 2.0, "2024-01-01 09:20:00")], [(1, 9.0, "2024-01-01 00:20:00")]]
    for i, rows in enumerate(batches):
        df = spark.createDataFrame(rows, "user_id long, value double, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
        df.coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    got = sorted((r.start.hour, r.n, r.energy) for r in jobs.drained_to_end(stream, lambda e: jobs.frame_energy(e, "1 hour", "1 hour", "2 hours")).collect())
    assert got == [(0, 1, 1.0), (9, 2, 6.5)]


def test_waveforms_of_different_rates_cancel(spark):
    tone = lambda rate, n: [(1, c, i, math.sin(2 * math.pi * 100 * i / rate) * (c + 1)) for c in (0, 1) for i in range(n)]
    df = lambda rows: spark.createDataFrame(rows, "track long, channel long, pos int, v double")
    got = pair.invert_waveform(df(tone(1600, 200)), df(tone(3200, 360)), (1600, 3200)).collect()
    assert {(r.channel, r.pos) for r in got} == {(c, i) for c in (0, 1) for i in range(180)}
    assert max(abs(r.v) for r in got if 20 <= r.pos < 160) < 5e-3
