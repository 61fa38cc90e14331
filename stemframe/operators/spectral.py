"""Spectral transforms.

Two tiers. The relational tier writes a transform as a grouping over (sample, bin) pairs made by
``explode``; it is exact, has an oracle and suits small sizes. The block tier (``blocks``) cuts frames from block rows
with a halo and runs numpy's FFT over Arrow batches; ``stft_centred`` and its inverse are that for long-form signals.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stemframe import fixtures as fx
from stemframe.operators.blocks import BLOCK, from_blocks, istft_blocks, lengths, resampled, stft_blocks, to_blocks
from stemframe.operators.filters import butterworth_highpass, filtered
from stemframe.operators.frames import frame, with_length
from stemframe.registry import query

SIZE, HOP = 16, 8
CHANNEL = ["track", "channel"]

# The closed forms of the named windows, valid in Spark and in DuckDB (i from 0, n the length).
WINDOWS = {
    "boxcar": "1.0",
    "triang": "1 - abs((2.0 * i - n + 1) / (n + n % 2))",
    "bartlett": "1 - abs(2.0 * i / (n - 1) - 1)",
    "hann": "0.5 - 0.5 * cos(2 * pi() * i / (n - 1))",
    "hamming": "0.54 - 0.46 * cos(2 * pi() * i / (n - 1))",
    "blackman": "0.42 - 0.5 * cos(2 * pi() * i / (n - 1)) + 0.08 * cos(4 * pi() * i / (n - 1))",
    "blackmanharris": "0.35875 - 0.48829 * cos(2 * pi() * i / (n - 1)) + 0.14128 * cos(4 * pi() * i / (n - 1)) - 0.01168 * cos(6 * pi() * i / (n - 1))",
    "nuttall": "0.3635819 - 0.4891775 * cos(2 * pi() * i / (n - 1)) + 0.1365995 * cos(4 * pi() * i / (n - 1)) - 0.0106411 * cos(6 * pi() * i / (n - 1))",
    "flattop": "0.21557895 - 0.41663158 * cos(2 * pi() * i / (n - 1)) + 0.277263158 * cos(4 * pi() * i / (n - 1)) - 0.083578947 * cos(6 * pi() * i / (n - 1)) + 0.006947368 * cos(8 * pi() * i / (n - 1))",
    "cosine": "sin(pi() * (i + 0.5) / n)",
    "bohman": "(1 - abs(2.0 * i / (n - 1) - 1)) * cos(pi() * abs(2.0 * i / (n - 1) - 1)) + sin(pi() * abs(2.0 * i / (n - 1) - 1)) / pi()",
    "barthann": "0.62 - 0.48 * abs(i / (n - 1.0) - 0.5) + 0.38 * cos(2 * pi() * (i / (n - 1.0) - 0.5))",
    "exponential": "exp(-abs(i - (n - 1) / 2.0))",
    "tukey": "CASE WHEN 4.0 * i < n - 1 THEN 0.5 - 0.5 * cos(4 * pi() * i / (n - 1)) WHEN 4.0 * (n - 1 - i) < n - 1 THEN 0.5 - 0.5 * cos(4 * pi() * (n - 1 - i) / (n - 1)) ELSE 1.0 END",
    "parzen": "CASE WHEN abs(2.0 * i - n + 1) <= n / 2.0 THEN 1 - 6 * pow((2.0 * i - n + 1) / n, 2) + 6 * pow(abs((2.0 * i - n + 1) / n), 3) ELSE 2 * pow(1 - abs((2.0 * i - n + 1) / n), 3) END",
    "lanczos": "CASE WHEN 2 * i = n - 1 THEN 1.0 ELSE sin(pi() * (2.0 * i / (n - 1) - 1)) / (pi() * (2.0 * i / (n - 1) - 1)) END",
}


def taylor(nbar: int = 4, level: float = 30.0) -> str:
    """The Taylor window with ``nbar`` nearly constant side lobes ``level`` dB down, one at its centre."""
    a = math.acosh(10 ** (level / 20)) / math.pi
    spread = nbar**2 / (a**2 + (nbar - 0.5) ** 2)
    terms, ones = [], [k for k in range(1, nbar)]
    for m in ones:
        top = math.prod(1 - m * m / spread / (a * a + (k - 0.5) ** 2) for k in ones)
        f = (1 if m % 2 else -1) * top / (2 * math.prod(1 - m * m / (k * k) for k in ones if k != m))
        terms.append((m, f))
    total = " + ".join(f"({f!r}) * cos({2 * m} * pi() * (i - n / 2.0 + 0.5) / n)" for m, f in terms)
    return f"(1 + 2 * ({total})) / {1 + 2 * sum(f for _, f in terms)!r}"


WINDOWS["taylor"] = taylor()


def hann(i: Column, size: int) -> Column:
    """Periodic Hann."""
    return 0.5 - 0.5 * F.cos(2 * math.pi * i / size)


def stft(df: DataFrame, keys: list[str], size: int = SIZE, hop: int = HOP, window=hann) -> DataFrame:
    """Relational STFT of whole frames: keys, frame, bin, re, im."""
    framed = frame(df, keys, size, hop, "drop").select(*keys, F.col("chunk").alias("frame"), "i", (F.col("v") * window(F.col("i"), size)).alias("x"))
    pairs = framed.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(size // 2))))
    angle = 2 * math.pi * F.col("bin") * F.col("i") / size
    return pairs.groupBy(*keys, "frame", "bin").agg(F.sum(F.col("x") * F.cos(angle)).alias("re"), (-F.sum(F.col("x") * F.sin(angle))).alias("im"))


def istft(spec: DataFrame, keys: list[str], size: int = SIZE, hop: int = HOP, window=hann) -> DataFrame:
    """Relational inverse: overlap-add of inverse frames over the sum of squared windows."""
    twice = F.when((F.col("bin") == 0) | (F.col("bin") == size // 2), 1.0).otherwise(2.0)
    places = spec.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(size - 1))))
    angle = 2 * math.pi * F.col("bin") * F.col("i") / size
    x = F.sum(twice * (F.col("re") * F.cos(angle) - F.col("im") * F.sin(angle))) / size
    frames = places.groupBy(*keys, "frame", "i").agg(x.alias("x"))
    w = window(F.col("i"), size)
    s = frames.groupBy(*keys, (F.col("frame") * hop + F.col("i")).alias("pos")).agg(F.sum(F.col("x") * w).alias("s"), F.sum(w * w).alias("w"))
    return s.select(*keys, "pos", F.when(F.col("w") > 1e-12, F.col("s") / F.col("w")).otherwise(0.0).alias("v"))


def window_values(spark: SparkSession, name: str, n: int) -> np.ndarray:
    """The n values of a named window; they go to the driver and with the job."""
    rows = spark.range(n).selectExpr("id AS i", f"{n} AS n").select("i", F.expr(WINDOWS[name]).cast("double").alias("w")).collect()
    return np.array([r.w for r in sorted(rows, key=lambda r: r.i)])


def stft_centred(df: DataFrame, keys: list[str], size: int = 2048, hop: int = 1024, pad: str = "reflect", window: np.ndarray | None = None, scale: str = "none") -> DataFrame:
    """STFT whose frame k is centred at k x hop, one row per frame: keys, frame, length (of the signal), re, im (arrays).

    pad: ``reflect`` continues the ends by mirrored samples, ``zero`` by silence (as ``reflect`` does for a signal of
    no more than ``size`` samples). window: periodic Hann if not given. scale: ``sqrt`` divides by the root of
    ``size``, ``window`` by the sum of the window.
    """
    own = to_blocks(df, keys)
    return stft_blocks(own, keys, size, hop, pad=pad, window=window, scale=scale).join(lengths(own, keys), keys).select(*keys, "frame", "length", "re", "im")


def istft_centred(spec: DataFrame, keys: list[str], size: int = 2048, hop: int = 1024, window: np.ndarray | None = None, scale: str = "none") -> DataFrame:
    """The inverse of ``stft_centred``, trimmed to the signal's length: keys, pos, v."""
    out = from_blocks(istft_blocks(spec, keys, size, hop, window=window, scale=scale, centred=True), keys)
    return out.withColumn("pos", F.col("pos").cast("int"))


def mag_phase(spec: DataFrame) -> DataFrame:
    """Magnitude and phase; where im is nothing but rounding (DC, Nyquist) the phase is 0 or pi by the sign of re, and 0 in silence."""
    real = F.abs("im") <= 1e-9 * F.abs("re")
    phase = F.when(F.hypot("re", "im") < 1e-12, 0.0).when(real, F.when(F.col("re") < 0, math.pi).otherwise(0.0)).otherwise(F.atan2("im", "re"))
    return spec.withColumns({"mag": F.hypot("re", "im"), "phase": phase})


def polar(mag: Column, phase: Column) -> tuple[Column, Column]:
    return mag * F.cos(phase), mag * F.sin(phase)


def lowpass_mask(b: Column, start: int, stop: int) -> Column:
    return F.when(b < start - 1, 1.0).when(b <= stop - 1, 1 - (b - (start - 1)) / (stop - start)).otherwise(0.0)


def highpass_mask(b: Column, start: int, stop: int) -> Column:
    return F.when(b <= stop, 0.0).when(b <= start + 1, (b - (stop + 1)) / (start - stop)).otherwise(1.0)


def fft_lp_gain(b: Column, start: int, stop: int) -> Column:
    return F.when(b < start, 1.0).when(b < stop, 1 - (b - start + 1) / (stop - start)).otherwise(0.0)


def fft_hp_gain(b: Column, start: int, stop: int) -> Column:
    return F.when(b > start, 1.0).when(b > stop, 1 - (start - b + 1) / (start - stop)).otherwise(0.0)


def prefilter_gains(start: int, stop: int) -> Column:
    """Array of gains for bins start+1 .. stop-1: each depends on the one before."""
    step = lambda acc, b: F.concat(acc, F.array(F.pow(F.lit(10.0), -b * (3.5 - F.element_at(acc, -1)) / 20)))
    gains = F.aggregate(F.sequence(F.lit(1), F.lit(stop - start - 1)), F.array(F.lit(1.0)), step)
    return F.slice(gains, 2, stop - start - 1)


def prefilter_rolloff(spec: DataFrame, start: int, stop: int) -> DataFrame:
    g = F.get(prefilter_gains(start, stop), F.col("bin") - start - 1)
    gain = F.when((F.col("bin") > start) & (F.col("bin") < stop), g).otherwise(1.0)
    return spec.withColumns({"re": F.col("re") * gain, "im": F.col("im") * gain})


def high_end_mirror(spec: DataFrame, top: int, n_high: int, variant: int = 1) -> DataFrame:
    """Bins top .. top + n_high - 1 against the magnitudes mirrored from below ``top``; the smaller stays."""
    keys = ["track", "channel", "frame"]
    low = spec.filter(F.col("bin").between(top - n_high, top - 1)).select(*keys, (2 * top - 1 - F.col("bin")).alias("bin"), F.hypot("re", "im").alias("mirror"))
    both = spec.filter(F.col("bin").between(top, top + n_high - 1)).join(low, [*keys, "bin"])
    size = F.hypot("re", "im")
    scale = F.col("mirror") / size if variant == 1 else F.col("mirror") * 1.7
    keep = size <= (F.col("mirror") if variant == 1 else size * scale)
    return both.select(*keys, "bin", F.when(keep, F.col("re")).otherwise(F.col("re") * scale).alias("re"), F.when(keep, F.col("im")).otherwise(F.col("im") * scale).alias("im"))


def mel_weights(spark: SparkSession, n_mels: int, n_fft: int, sr: int) -> DataFrame:
    """Triangular mel weights (band, bin, w), as area-normalised triangles on the HTK scale; a few rows per band."""
    edges = spark.range(n_mels).select(F.col("id").cast("int").alias("band"))
    top = 2595 * math.log10(1 + sr / 2 / 700)
    hz = lambda m: 700 * (F.pow(F.lit(10.0), m * top / (n_mels + 1) / 2595) - 1)
    rows = edges.select("band", hz(F.col("band")).alias("f0"), hz(F.col("band") + 1).alias("f1"), hz(F.col("band") + 2).alias("f2"), F.explode(F.sequence(F.lit(0), F.lit(n_fft // 2))).alias("bin"))
    f = F.col("bin") * sr / n_fft
    w = F.least((f - F.col("f0")) / (F.col("f1") - F.col("f0")), (F.col("f2") - f) / (F.col("f2") - F.col("f1")))
    return rows.withColumn("w", F.greatest(w, F.lit(0.0)) * 2 / (F.col("f2") - F.col("f0"))).filter("w > 0").select("band", "bin", "w")


def log_mel(spec: DataFrame, weights: DataFrame, keys: list[str]) -> DataFrame:
    """Log of the mel-weighted magnitudes, not below 1e-5. The weights are a table of the size of one frame."""
    both = spec.withColumn("mag", F.hypot("re", "im")).join(F.broadcast(weights), "bin")
    return both.groupBy(*keys, "frame", "band").agg(F.log(F.greatest(F.sum(F.col("w") * F.col("mag")), F.lit(1e-5))).alias("v"))


def log_mel_shifted(df: DataFrame, weights: DataFrame, keys: list[str], size: int, hop: int, semitones: float = 0.0) -> DataFrame:
    """``log_mel`` of a signal as if its pitch were moved: frames of size x 2^(semitones / 12), whose bins are cut off
    or missing above size / 2 and whose magnitudes are brought back to the plain size."""
    moved = round(size * 2 ** (semitones / 12))
    spec = stft(df, keys, moved, hop).filter(F.col("bin") <= size // 2)
    return log_mel(spec.withColumns({"re": F.col("re") * (size / moved), "im": F.col("im") * (size / moved)}), weights, keys)


def resample_index(df: DataFrame, keys: list[str], target: int, mode: str) -> DataFrame:
    """Signals of any length to ``target`` samples: ``nearest`` takes floor(i n / target), ``linear`` interpolates between centres."""
    n = with_length(df, keys).select(*keys, "n").distinct()
    grid = n.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(target - 1))))
    if mode == "nearest":
        grid = grid.withColumn("pos", F.floor(F.col("i") * F.col("n") / target).cast("int"))
        return grid.join(df, [*keys, "pos"]).select(*keys, "i", "v")
    x = F.greatest((F.col("i") + 0.5) * F.col("n") / target - 0.5, F.lit(0.0))
    grid = grid.withColumn("x", x).withColumn("pos", F.floor("x").cast("int")).withColumn("next", F.least(F.col("pos") + 1, F.col("n") - 1).cast("int"))
    a = df.select(*keys, "pos", F.col("v").alias("a"))
    b = df.select(*keys, F.col("pos").alias("next"), F.col("v").alias("b"))
    both = grid.join(a, [*keys, "pos"]).join(b, [*keys, "next"])
    t = F.col("x") - F.col("pos")
    return both.select(*keys, "i", (F.col("a") * (1 - t) + F.col("b") * t).alias("v"))


def resample_sinc(df: DataFrame, keys: list[str], ratio: float, taps: int = 8, block: int = BLOCK) -> DataFrame:
    """Band-limited resampling: output sample i is a Hann-windowed sinc sum over the 2 x taps inputs around i / ratio; length = ceil(n ratio).

    A polyphase filter bank works on block rows with a halo of the taps, so there is no row for a single tap.
    """
    rows = resampled(to_blocks(df, keys, block=block), keys, ratio, taps, block)
    return rows.select(*keys, "first", F.posexplode("v").alias("i", "v")).select(*keys, (F.col("first") + F.col("i")).cast("int").alias("pos"), "v")


def pitch_resample(df: DataFrame, keys: list[str], semitones: float) -> DataFrame:
    return resample_sinc(df, keys, 2 ** (-semitones / 12))


def rms_frames(df: DataFrame, keys: list[str], size: int, hop: int) -> DataFrame:
    """Root mean square of centred frames over a zero-padded signal: keys, frame, rms."""
    centred = with_length(df, keys).withColumn("pos", F.col("pos") + size // 2)
    k = F.explode(F.filter(F.sequence(F.greatest(F.ceil((F.col("pos") - size + 1) / hop), F.lit(0)).cast("int"), F.floor(F.col("pos") / hop).cast("int")), lambda k: k <= F.floor(F.col("n") / hop)))
    return centred.withColumn("frame", k).groupBy(*keys, "frame").agg(F.sqrt(F.sum(F.col("v") * F.col("v")) / size).alias("rms"))


def rms_envelope_match(source: DataFrame, target: DataFrame, keys: list[str], rate: float, size: int, hop: int, length: int) -> DataFrame:
    """target x rms1^(1 - rate) x max(rms2, 1e-6)^(rate - 1), the envelopes interpolated to ``length`` samples."""
    envelope = lambda d: resample_index(rms_frames(d, keys, size, hop).select(*keys, F.col("frame").alias("pos"), F.col("rms").alias("v")), keys, length, "linear").withColumnRenamed("i", "pos")
    one, two = envelope(source).withColumnRenamed("v", "r1"), envelope(target).withColumnRenamed("v", "r2")
    both = target.join(one, [*keys, "pos"]).join(two, [*keys, "pos"])
    return both.select(*keys, "pos", (F.col("v") * F.pow(F.col("r1"), F.lit(1 - rate)) * F.pow(F.greatest("r2", F.lit(1e-6)), F.lit(rate - 1))).alias("v"))


def spectrogram_image(spec: DataFrame, keys: list[str], mode: str = "magnitude", top: str | None = None) -> DataFrame:
    """Pixels 0..255: log10(mag^2 + 1e-8), or with mode "phase" the phase, scaled between its extremes within the keys.

    ``top`` names a column of planes (channels, say), to which their pixelwise maximum is added as plane -1.
    """
    if mode == "phase":
        x = mag_phase(spec).withColumnRenamed("phase", "x")
    else:
        x = spec.withColumn("x", F.log10(F.col("re") * F.col("re") + F.col("im") * F.col("im") + 1e-8))
    own = Window.partitionBy(*keys)
    lo, hi = F.min("x").over(own), F.max("x").over(own)
    at = list(dict.fromkeys([*keys, *([top] if top else []), "frame", "bin"]))
    image = x.select(*at, F.when(hi > lo, (F.col("x") - lo) / (hi - lo) * 255).otherwise(0.0).alias("v"))
    if top is None:
        return image
    most = image.groupBy(*[c for c in at if c != top]).agg(F.max("v").alias("v")).withColumn(top, F.lit(-1).cast(image.schema[top].dataType))
    return image.unionByName(most)


def highpass_iir(df: DataFrame, keys: list[str], cutoff: float, rate: float, order: int = 5) -> DataFrame:
    """Butterworth high-pass without phase shift, run forwards and backwards over blocks with a halo that follows from its poles."""
    return filtered(df, keys, butterworth_highpass(order, cutoff, rate), zero_phase=True)


SPEC = f"""{fx.STEREO}, fr AS (SELECT track, channel, frame, pos - frame * 8 AS i, v * (0.5 - 0.5 * cos(2 * pi() * (pos - frame * 8) / 16)) AS x
  FROM stereo JOIN (SELECT unnest(range(0, 7)) AS frame) f ON pos >= frame * 8 AND pos < frame * 8 + 16),
spec AS (SELECT track, channel, CAST(frame AS INTEGER) AS frame, CAST(bin AS INTEGER) AS bin, sum(x * cos(2 * pi() * bin * i / 16)) AS re, -sum(x * sin(2 * pi() * bin * i / 16)) AS im
  FROM fr CROSS JOIN (SELECT unnest(range(0, 9)) AS bin) b GROUP BY ALL)"""


def spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stft(fx.stereo(spark, sf_dir, sized=True), CHANNEL)


def _z(df: DataFrame, *keys: str, digits: int = 5) -> DataFrame:
    """Rounded re and im; adding 0.0 turns a negative zero into zero."""
    return df.select(*keys, *[(F.round(c, digits) + 0.0).alias(c) for c in ("re", "im")])


ZSQL = "round(re, 5) + 0.0 AS re, round(im, 5) + 0.0 AS im"
BINS = ["track", "channel", "frame", "bin"]


@query("d1_stft", f"WITH {SPEC} SELECT track, channel, frame, bin, {ZSQL} FROM spec")
def d1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _z(spectra(spark, sf_dir), *BINS)


@query("d1_stft_arrays", f"WITH {SPEC} SELECT track, channel, frame, bin, {ZSQL} FROM spec")
def d1_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Blocks of two frames and a half, so that most frames reach into the next one.
    rows = stft_blocks(to_blocks(fx.stereo(spark, sf_dir), CHANNEL, block=24), CHANNEL, SIZE, HOP, block=24)
    flat = rows.select("track", "channel", "frame", F.posexplode(F.arrays_zip("re", "im")).alias("bin", "z"))
    return _z(flat.select(*BINS, "z.re", "z.im"), *BINS)


@query("d2_istft", f"WITH {fx.STEREO} SELECT track, channel, pos, CASE WHEN pos = 0 THEN 0 ELSE round(v, 5) END AS v FROM stereo")
def d2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return istft(spectra(spark, sf_dir), CHANNEL).select("track", "channel", "pos", F.round("v", 5).alias("v"))


_CENTRED = """p AS (SELECT track, channel, pos + 8 AS q, v FROM stereo UNION ALL SELECT track, channel, 8 - pos, v FROM stereo WHERE pos BETWEEN 1 AND 8 UNION ALL SELECT track, channel, 126 - pos + 8, v FROM stereo WHERE pos BETWEEN 55 AND 62),
cf AS (SELECT track, channel, frame, q - frame * 8 AS i, v * pow(sin(pi() * (q - frame * 8) / 16), 2) AS x FROM p JOIN (SELECT unnest(range(0, 9)) AS frame) f ON q >= frame * 8 AND q < frame * 8 + 16)"""


@query("d1_stft_centred", f"""WITH {fx.STEREO}, {_CENTRED} SELECT track, channel, CAST(frame AS INTEGER) AS frame, CAST(bin AS INTEGER) AS bin, round(sum(x * cos(2 * pi() * bin * i / 16)) / 4, 5) + 0.0 AS re, round(-sum(x * sin(2 * pi() * bin * i / 16)) / 4, 5) + 0.0 AS im
FROM cf CROSS JOIN (SELECT unnest(range(0, 9)) AS bin) GROUP BY track, channel, frame, bin""")
def d1_centred(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stft_centred(fx.stereo(spark, sf_dir), CHANNEL, SIZE, HOP, scale="sqrt")
    return _z(rows.select(*CHANNEL, "frame", F.posexplode(F.arrays_zip("re", "im")).alias("bin", "z")).select(*BINS, "z.re", "z.im"), *BINS)


@query("d2_istft_centred", f"WITH {fx.STEREO} SELECT track, channel, pos, round(v, 5) AS v FROM stereo")
def d2_centred(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stft_centred(fx.stereo(spark, sf_dir), CHANNEL, SIZE, HOP, "zero", scale="window")
    return istft_centred(rows, CHANNEL, SIZE, HOP, scale="window").select(*CHANNEL, "pos", F.round("v", 5).alias("v"))


@query("d3_mag_phase", f"""WITH {SPEC} SELECT track, channel, frame, bin, round(sqrt(re * re + im * im), 5) AS mag,
round(CASE WHEN bin NOT IN (0, 8) THEN atan2(im, re) WHEN re < 0 THEN pi() ELSE 0 END, 4) AS phase FROM spec""")
def d3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mag_phase(spectra(spark, sf_dir)).select(*BINS, F.round("mag", 5).alias("mag"), F.round("phase", 4).alias("phase"))


def windowed(df: DataFrame, name: str, n: int) -> DataFrame:
    """A signal of n samples times a named window."""
    return df.selectExpr("*", f"{n} AS n", "pos AS i").withColumn("v", F.col("v") * F.expr(WINDOWS[name])).drop("n", "i")


# Each window in another closed form than above, for 64 samples: m is the place from the nearer end, c the cosine.
_WINDOWS_SQL = {
    "boxcar": "1", "triang": "(2 * m + 1) / 64.0", "bartlett": "m * 2 / 63.0", "hann": "pow(sin(pi() * i / 63), 2)", "hamming": "0.08 + 0.92 * pow(sin(pi() * i / 63), 2)",
    "blackman": "0.34 - 0.5 * c + 0.16 * c * c", "blackmanharris": "0.35875 - 0.48829 * c + 0.14128 * (2 * c * c - 1) - 0.01168 * (4 * c * c * c - 3 * c)",
    "nuttall": "0.3635819 - 0.4891775 * c + 0.1365995 * (2 * c * c - 1) - 0.0106411 * (4 * c * c * c - 3 * c)",
    "flattop": "0.21557895 - 0.41663158 * c + 0.277263158 * (2 * c * c - 1) - 0.083578947 * (4 * c * c * c - 3 * c) + 0.006947368 * (8 * c * c * c * c - 8 * c * c + 1)",
    "cosine": "sin(pi() * (2 * i + 1) / 128)", "bohman": "(1 - x) * cos(pi() * x) + sin(pi() * x) / pi()", "barthann": "0.62 - 0.24 * x - 0.38 * cos(pi() * (1 - x))", "exponential": "exp(m - 31.5)",
    "tukey": "CASE WHEN m < 15.75 THEN pow(sin(2 * pi() * m / 63), 2) ELSE 1 END", "parzen": "CASE WHEN u <= 0.5 THEN 1 - 6 * u * u * (1 - u) ELSE 2 * pow(1 - u, 3) END", "lanczos": "sin(pi() * x) / (pi() * x)",
    "taylor": "(1 + 2 * (0.2926560110171551 * cos(2 * pi() * (i - 31.5) / 64) - 0.01578375064105314 * cos(4 * pi() * (i - 31.5) / 64) + 0.0021810393128200286 * cos(6 * pi() * (i - 31.5) / 64))) / 1.558106599377844",
}


def _windows_sql() -> str:
    base = f"WITH {fx.SIG}, t AS (SELECT track, pos, pos AS i, least(pos, 63 - pos) AS m, cos(2 * pi() * pos / 63) AS c, abs(2 * pos - 63) / 63.0 AS x, abs(2 * pos - 63) / 64.0 AS u, sum(v) AS v FROM sig GROUP BY track, pos) "
    return base + " UNION ALL ".join(f"SELECT '{k}' AS name, track, pos, round(v * ({e}), 4) + 0.0 AS v FROM t" for k, e in _WINDOWS_SQL.items())


@query("d4_window_function", _windows_sql())
def d4(spark: SparkSession, sf_dir: str) -> DataFrame:
    summed = fx.sig(spark, sf_dir).groupBy("track", "pos").agg(F.sum("v").alias("v"))
    out = None
    for name in WINDOWS:
        one = windowed(summed, name, 64).select(F.lit(name).alias("name"), "track", "pos", (F.round("v", 4) + 0.0).alias("v"))
        out = one if out is None else out.unionByName(one)
    return out


@query("d5_band_masks", f"""WITH {SPEC} SELECT track, channel, frame, bin, round(re * CASE WHEN bin < 2 THEN 1 WHEN bin <= 5 THEN 1 - (bin - 2) / 3.0 ELSE 0 END, 5) + 0.0 AS low,
round(re * CASE WHEN bin <= 2 THEN 0 WHEN bin <= 6 THEN (bin - 3) / 3.0 ELSE 1 END, 5) + 0.0 AS high FROM spec""")
def d5(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = F.col("bin")
    return spectra(spark, sf_dir).select(*BINS, (F.round(F.col("re") * lowpass_mask(b, 3, 6), 5) + 0.0).alias("low"), (F.round(F.col("re") * highpass_mask(b, 5, 2), 5) + 0.0).alias("high"))


@query("d6_fft_filters", f"""WITH {SPEC} SELECT track, channel, frame, bin, round(re * CASE WHEN bin < 3 THEN 1 WHEN bin < 6 THEN 1 - (bin - 2) / 3.0 ELSE 0 END, 5) + 0.0 AS low,
round(re * CASE WHEN bin > 5 THEN 1 WHEN bin > 2 THEN 1 - (6 - bin) / 3.0 ELSE 0 END, 5) + 0.0 AS high FROM spec""")
def d6(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = F.col("bin")
    return spectra(spark, sf_dir).select(*BINS, (F.round(F.col("re") * fft_lp_gain(b, 3, 6), 5) + 0.0).alias("low"), (F.round(F.col("re") * fft_hp_gain(b, 5, 2), 5) + 0.0).alias("high"))


@query("d7_prefilter_rolloff", f"""WITH RECURSIVE {SPEC}, g(bin, gain) AS (SELECT 2, 1.0::DOUBLE UNION ALL SELECT bin + 1, pow(10.0::DOUBLE, -(bin - 1) * (3.5 - gain) / 20) FROM g WHERE bin < 6)
SELECT track, channel, frame, s.bin, round(re * coalesce(gain, 1), 5) + 0.0 AS re, round(im * coalesce(gain, 1), 5) + 0.0 AS im FROM spec s LEFT JOIN (SELECT * FROM g WHERE bin > 2) g ON g.bin = s.bin""")
def d7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _z(prefilter_rolloff(spectra(spark, sf_dir), 2, 7), *BINS)


_MIRROR = "m AS (SELECT h.track, h.channel, h.frame, h.bin, h.re, h.im, sqrt(h.re * h.re + h.im * h.im) AS s, sqrt(l.re * l.re + l.im * l.im) AS k FROM spec h JOIN spec l ON l.track = h.track AND l.channel = h.channel AND l.frame = h.frame AND l.bin = 9 - h.bin WHERE h.bin BETWEEN 5 AND 7)"


@query("d8_high_end_mirror", f"""WITH {SPEC}, {_MIRROR}
SELECT 1 AS variant, track, channel, frame, bin, round(CASE WHEN s <= k THEN re ELSE re * k / s END, 5) + 0.0 AS re, round(CASE WHEN s <= k THEN im ELSE im * k / s END, 5) + 0.0 AS im FROM m
UNION ALL SELECT 2, track, channel, frame, bin, round(CASE WHEN s <= s * k * 1.7 THEN re ELSE re * k * 1.7 END, 5) + 0.0, round(CASE WHEN s <= s * k * 1.7 THEN im ELSE im * k * 1.7 END, 5) + 0.0 FROM m""")
def d8(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = spectra(spark, sf_dir)
    out = [_z(high_end_mirror(spec, 5, 3, v), *BINS).withColumn("variant", F.lit(v)) for v in (1, 2)]
    return out[0].unionByName(out[1])


@query("d9_log_mel", f"""WITH {SPEC}, e AS (SELECT unnest(range(0, 4)) AS band), t AS (SELECT 2595 * log10(1 + 8000 / 700.0) AS top),
h AS (SELECT CAST(band AS INTEGER) AS band, 700 * (pow(10, band * top / 5 / 2595) - 1) AS f0, 700 * (pow(10, (band + 1) * top / 5 / 2595) - 1) AS f1, 700 * (pow(10, (band + 2) * top / 5 / 2595) - 1) AS f2 FROM e, t),
w AS (SELECT band, bin, greatest(least((bin * 1000.0 - f0) / (f1 - f0), (f2 - bin * 1000.0) / (f2 - f1)), 0) * 2 / (f2 - f0) AS w FROM h, (SELECT unnest(range(0, 9)) AS bin)),
f19 AS (SELECT track, channel, frame, pos - frame * 8 AS i, v * (0.5 - 0.5 * cos(2 * pi() * (pos - frame * 8) / 19)) AS x FROM stereo JOIN (SELECT unnest(range(0, 6)) AS frame) f ON pos >= frame * 8 AND pos < frame * 8 + 19),
s19 AS (SELECT track, channel, CAST(frame AS INTEGER) AS frame, bin, sum(x * cos(2 * pi() * bin * i / 19)) AS re, sum(x * sin(2 * pi() * bin * i / 19)) AS im FROM f19 CROSS JOIN (SELECT unnest(range(0, 9)) AS bin) GROUP BY ALL),
a AS (SELECT 0 AS semitones, track, channel, frame, bin, sqrt(re * re + im * im) AS mag FROM spec UNION ALL SELECT 3, track, channel, frame, bin, sqrt(re * re + im * im) * 16 / 19 FROM s19)
SELECT semitones, track, channel, frame, band, round(ln(greatest(sum(w * mag), 1e-5)), 4) AS v FROM a JOIN w USING (bin) WHERE w > 0 GROUP BY ALL""")
def d9(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, w = fx.stereo(spark, sf_dir), mel_weights(spark, 4, 16, 16000)
    out = [log_mel_shifted(df, w, CHANNEL, SIZE, HOP, k).withColumn("v", F.round("v", 4)).withColumn("semitones", F.lit(k)) for k in (0, 3)]
    return out[0].unionByName(out[1])


@query("d12_resample")
def d12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample_sinc(fx.stereo(spark, sf_dir), CHANNEL, 1.5).withColumn("v", F.round("v", 5))


@query("d13_resample_index", f"""WITH {fx.STEREO}, g AS (SELECT track, channel, CAST(i AS INTEGER) AS i, greatest((i + 0.5) * 64 / 100 - 0.5, 0) AS x FROM (SELECT DISTINCT track, channel FROM stereo) CROSS JOIN (SELECT unnest(range(0, 100)) AS i))
SELECT 'nearest' AS mode, s.track, s.channel, CAST(k.i AS INTEGER) AS i, round(v, 6) AS v FROM stereo s JOIN (SELECT unnest(range(0, 100)) AS i) k ON s.pos = k.i * 64 // 100
UNION ALL SELECT 'linear', g.track, g.channel, g.i, round(a.v * (1 - (x - floor(x))) + b.v * (x - floor(x)), 6) FROM g JOIN stereo a ON a.track = g.track AND a.channel = g.channel AND a.pos = floor(x) JOIN stereo b ON b.track = g.track AND b.channel = g.channel AND b.pos = least(floor(x) + 1, 63)""".replace("k.i * 64 // 100", "CAST(floor(k.i * 64 / 100) AS INTEGER)"))
def d13(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = fx.stereo(spark, sf_dir)
    out = [resample_index(df, CHANNEL, 100, m).select(F.lit(m).alias("mode"), *CHANNEL, "i", F.round("v", 6).alias("v")) for m in ("nearest", "linear")]
    return out[0].unionByName(out[1])


@query("d14_pitch_resample")
def d14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitch_resample(fx.stereo(spark, sf_dir), CHANNEL, 3).withColumn("v", F.round("v", 5))


@query("d15_highpass_iir")
def d15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return highpass_iir(fx.stereo(spark, sf_dir), CHANNEL, 0.05, 1.0).withColumn("v", F.round("v", 5))


_RMS = "r AS (SELECT track, channel, CAST(frame AS INTEGER) AS frame, sqrt(sum(v * v) / 16) AS rms FROM stereo JOIN (SELECT unnest(range(0, 9)) AS frame) f ON pos + 8 >= frame * 8 AND pos + 8 < frame * 8 + 16 GROUP BY ALL)"


@query("d16_rms_frames", f"WITH {fx.STEREO}, {_RMS} SELECT track, channel, frame, round(rms, 6) AS rms FROM r")
def d16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rms_frames(fx.stereo(spark, sf_dir), CHANNEL, 16, 8).withColumn("rms", F.round("rms", 6))


@query("d17_rms_envelope_match", f"""WITH {fx.STEREO}, {_RMS}, x AS (SELECT CAST(pos AS INTEGER) AS pos, greatest((pos + 0.5) * 9 / 64 - 0.5, 0) AS x FROM (SELECT unnest(range(0, 64)) AS pos)),
e AS (SELECT a.track, a.channel, x.pos, a.rms * (1 - (x - floor(x))) + b.rms * (x - floor(x)) AS e FROM x JOIN r a ON a.frame = floor(x) JOIN r b ON b.track = a.track AND b.channel = a.channel AND b.frame = least(floor(x) + 1, 8))
SELECT s.track, s.channel, s.pos, round(s.v * 0.5 * pow(e.e, 0.75) * pow(greatest(e.e * 0.5, 1e-6), -0.75), 5) AS v FROM stereo s JOIN e USING (track, channel, pos)""")
def d17(spark: SparkSession, sf_dir: str) -> DataFrame:
    loud = fx.stereo(spark, sf_dir)
    soft = loud.withColumn("v", F.col("v") * 0.5)
    return rms_envelope_match(loud, soft, CHANNEL, 0.25, 16, 8, 64).withColumn("v", F.round("v", 5))


@query("d18_spectrogram_image", f"""WITH {SPEC}, m AS (SELECT *, log10(re * re + im * im + 1e-8) AS x, CASE WHEN bin NOT IN (0, 8) THEN atan2(im, re) WHEN re < 0 THEN pi() ELSE 0 END AS p FROM spec),
y AS (SELECT 'magnitude' AS mode, track, channel, frame, bin, (x - min(x) OVER w) / (max(x) OVER w - min(x) OVER w) * 255 AS v FROM m WINDOW w AS (PARTITION BY track)
UNION ALL SELECT 'phase', track, channel, frame, bin, (p - min(p) OVER w) / (max(p) OVER w - min(p) OVER w) * 255 FROM m WINDOW w AS (PARTITION BY track))
SELECT mode, track, channel, frame, bin, round(v, 2) AS v FROM y UNION ALL SELECT mode, track, -1, frame, bin, round(max(v), 2) FROM y GROUP BY ALL""")
def d18(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = spectra(spark, sf_dir)
    out = [spectrogram_image(spec, ["track"], mode, "channel").select(F.lit(mode).alias("mode"), *BINS, F.round("v", 2).alias("v")) for mode in ("magnitude", "phase")]
    return out[0].unionByName(out[1])


@query("c12_denoise_pair", f"WITH {SPEC} SELECT track, channel, frame, bin, round(CASE WHEN bin < 3 THEN 0 ELSE 0.6 * re END, 5) + 0.0 AS re, round(CASE WHEN bin < 3 THEN 0 ELSE 0.6 * im END, 5) + 0.0 AS im FROM spec")
def c12(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stemframe.operators.frames import denoise_pair

    return _z(denoise_pair(spectra(spark, sf_dir), lambda x: 0.6 * x + x * x), *BINS)
