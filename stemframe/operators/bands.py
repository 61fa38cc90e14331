"""Band layouts as dimension tables, spectra split into bands and merged back, and transforms of ensembles in the spectral domain."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stemframe import fixtures as fx
from stemframe.operators.blocks import BLOCK, frame_sums, stft_blocks, to_blocks
from stemframe.operators.metrics import OPTIONS, against_median
from stemframe.operators.spectral import BINS, HOP, SIZE, SPEC, _z, spectra
from stemframe.registry import query
from stemframe.storage import staged

# Band widths in Hz by layout as (from, to, width); width 0 is one band.
LAYOUTS = {
    "vocals:1": [(0, None, 1000)],
    "vocals:2": [(0, 16000, 1000), (16000, 20000, 2000), (20000, None, 0)],
    "vocals:3": [(0, 8000, 1000), (8000, 16000, 2000), (16000, 20000, 0), (20000, None, 0)],
    "vocals:4": [(0, 1000, 100), (1000, 8000, 1000), (8000, 16000, 2000), (16000, 20000, 0), (20000, None, 0)],
    "vocals:5": [(0, 1000, 100), (1000, 16000, 1000), (16000, 20000, 2000), (20000, None, 0)],
    "vocals:6": [(0, 1000, 100), (1000, 4000, 500), (4000, 8000, 1000), (8000, 16000, 2000), (16000, 20000, 0), (20000, None, 0)],
    "vocals:7": [(0, 1000, 100), (1000, 4000, 250), (4000, 8000, 500), (8000, 16000, 1000), (16000, 20000, 2000), (20000, None, 0)],
    "bass": [(0, 500, 50), (500, 1000, 100), (1000, 4000, 500), (4000, 8000, 1000), (8000, 16000, 2000), (16000, None, 0)],
    "drums": [(0, 1000, 50), (1000, 2000, 100), (2000, 4000, 250), (4000, 8000, 500), (8000, 16000, 1000), (16000, None, 0)],
}
LAYOUTS["other"] = LAYOUTS["vocals:7"]
#: Bands of one width over all bins.
LAYOUTS |= {f"fixed:{width}": [(0, None, width)] for width in (250, 500, 2000)}


def band_edges(spark: SparkSession, n_fft: int, sr: int) -> DataFrame:
    """layout, lo, hi (bins) of every band of the known layouts; Hz to bins by rounding half to even."""
    rows = [(name, k, float(a), None if b is None else float(b), float(w)) for name, parts in LAYOUTS.items() for k, (a, b, w) in enumerate(parts)]
    parts = spark.createDataFrame(rows, "layout string, part int, a double, b double, w double")
    to_bin = lambda x: F.bround(x * n_fft / sr, 0).cast("int")
    parts = parts.select("layout", to_bin(F.col("a")).alias("s"), F.coalesce(to_bin(F.col("b")), F.lit(n_fft // 2 + 1)).alias("e"), to_bin(F.col("w")).alias("step"))
    starts = parts.filter("e > s").withColumn("lo", F.explode(F.when(F.col("step") > 0, F.sequence("s", F.col("e") - 1, "step")).otherwise(F.array("s"))))
    return starts.select("layout", "lo", F.when(F.col("step") > 0, F.least(F.col("lo") + F.col("step"), "e")).otherwise(F.col("e")).alias("hi"))


def band_spec_checks(bands: DataFrame) -> DataFrame:
    """Violations by layout: bands without width, overlaps, gaps, and layouts that do not begin at 0."""
    before = F.lag("hi").over(Window.partitionBy("layout").orderBy("lo", "hi"))
    b = bands.withColumn("before", before)
    what = F.when(F.col("hi") <= F.col("lo"), "width").when(F.col("before").isNull() & (F.col("lo") != 0), "start").when(F.col("before") > F.col("lo"), "overlap").when(F.col("lo") - F.col("before") > 1, "gap")
    return b.withColumn("violation", what).filter("violation IS NOT NULL").select("layout", "lo", "hi", "violation")


#: Scales on which filterbanks are even: Hz to the scale, and back.
PERCEPTUAL = {
    "mel": (lambda f: 2595 * np.log10(1 + f / 700), lambda x: 700 * (10 ** (x / 2595) - 1)),
    "bark": (lambda f: 6 * np.arcsinh(f / 600), lambda x: 600 * np.sinh(x / 6)),
    "erb": (lambda f: 1000 * np.log(10) / (24.7 * 4.37) * np.log10(1 + 0.00437 * f), lambda x: (10 ** (x * 24.7 * 4.37 / (1000 * np.log(10))) - 1) / 0.00437),
    "midi": (lambda f: 69 + 12 * np.log2(f / 440), lambda x: 440 * 2 ** ((x - 69) / 12)),
}


def _triangles(freqs: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Rows of triangles over ``freqs`` between neighbouring points; what rounding leaves at an end is 0."""
    left, mid, right = points[:-2, None], points[1:-1, None], points[2:, None]
    w = np.minimum((freqs - left) / (mid - left), (right - freqs) / (right - mid))
    return np.where(w > 1e-9, w, 0.0)


def filterbank_matrix(n_fft: int, sr: int, n_bands: int, scale: str, low: float = 0.0, high: float | None = None) -> np.ndarray:
    """Weights (band, bin): ``mel``, ``erb`` and ``tribark`` are triangles, ``bark`` critical-band curves, ``minibark``
    their part above half the power, ``musical`` boxes of equal parts of an octave.

    Bins below the first band's first active one count fully there (for mel only the first bin).
    """
    bins, high = n_fft // 2 + 1, high or sr / 2
    freqs = np.linspace(0, sr / 2, bins)
    if scale in ("mel", "erb", "tribark"):
        there, back = PERCEPTUAL["bark" if scale == "tribark" else scale]
        w = _triangles(freqs, back(np.linspace(there(low), there(high), n_bands + 2)))
        if scale == "mel":
            w[0, 0] = 1
        elif w.any():
            first = int(np.flatnonzero(w.any(axis=1))[0])
            w[first, : int(np.flatnonzero(w[first])[0])] = 1
        return w
    if scale in ("bark", "minibark"):
        there, back = PERCEPTUAL["bark"]
        points = np.linspace(there(low), there(high), n_bands + 4)
        edges = np.floor((n_fft + 1) * back(points) / sr).astype(int)
        at = there(np.arange(bins) * sr / (n_fft + 1))
        d = at - points[2:-2, None]
        curve = np.select([(d >= -2.5) & (d <= -0.5), (d > -0.5) & (d < 0.5), (d >= 0.5) & (d <= 1.3)], [10 ** np.minimum(d + 0.5, 0), 1.0, 10 ** np.minimum(-2.5 * (d - 0.5), 0)], 0.0)
        place = np.arange(bins)
        w = np.where((place >= edges[:-4, None]) & (place < edges[4:, None]), curve, 0.0)
        return np.where(w < math.sqrt(0.5), 0.0, w) if scale == "minibark" else w
    there, back = PERCEPTUAL["midi"]
    step = sr / n_fft
    ratio = 2 ** (math.log2(high / step) / n_bands)
    centres = back(np.linspace(max(0.0, there(step)), there(high), n_bands))
    lowest, highest = np.floor(centres / ratio / step).astype(int), np.ceil(centres * ratio / step).astype(int)
    place = np.arange(bins)
    w = ((place >= lowest[:, None]) & (place <= highest[:, None])).astype(float)
    w[0, : lowest[0]], w[-1, highest[-1] + 1 :] = 1, 1
    return w


def perceptual_filterbank(spark: SparkSession, n_fft: int, sr: int, n_bands: int, scale: str = "mel") -> DataFrame:
    """(band, bin, w) of a filterbank, divided by the sum over bands at each bin; a band goes from its first to its
    last active bin, and bands without one are dropped. A table of bands times bins of one frame."""
    w = filterbank_matrix(n_fft, sr, n_bands, scale)
    total = w.sum(axis=0)
    rows = []
    for band in range(n_bands):
        active = np.flatnonzero(w[band])
        if active.size:
            rows += [(band, int(k), float(w[band, k] / total[k])) for k in range(active[0], active[-1] + 1)]
    return spark.createDataFrame(rows, "band int, bin int, w double")


def band_split(spec: DataFrame, bands: DataFrame) -> DataFrame:
    """Bins of each band stacked on one axis: bands has band, crop_start, crop_stop, offset; a table of a few rows."""
    bins = bands.withColumn("bin", F.explode(F.sequence("crop_start", F.col("crop_stop") - 1)))
    both = spec.join(F.broadcast(bins), "bin")
    return both.withColumn("bin", (F.col("bin") - F.col("crop_start") + F.col("offset")).cast("int")).drop("crop_start", "crop_stop", "offset")


def band_merge(stacked: DataFrame, bands: DataFrame) -> DataFrame:
    """The inverse: bins back in place; where bands share a bin the values add up."""
    back = stacked.join(F.broadcast(bands), "band").withColumn("bin", (F.col("bin") + F.col("crop_start") - F.col("offset")).cast("int"))
    return back.groupBy(*BINS).agg(F.sum("re").alias("re"), F.sum("im").alias("im"))


def _bands(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(1, 0, 3, 0), (2, 2, 6, 3), (3, 6, 9, 7)], "band int, crop_start int, crop_stop int, offset int")


def a_weighting(f: np.ndarray) -> np.ndarray:
    """Gain of the A curve at frequencies, 1 at 1000 Hz."""
    f2 = np.asarray(f, float) ** 2
    return 12194.0**2 * f2 * f2 / ((f2 + 20.6**2) * np.sqrt((f2 + 107.7**2) * (f2 + 737.9**2)) * (f2 + 12194.0**2)) * 10 ** (2.0 / 20)


def mel_matrix(n_mels: int, size: int, rate: float) -> np.ndarray:
    """Bands by bins: triangles of equal area, even on the HTK scale; bands without a bin are left out."""
    top = 2595 * math.log10(1 + rate / 2 / 700)
    edges = 700 * (10 ** (np.arange(n_mels + 2) * top / (n_mels + 1) / 2595) - 1)
    f, lo, mid, hi = np.arange(size // 2 + 1) * rate / size, edges[:-2, None], edges[1:-1, None], edges[2:, None]
    w = np.maximum(np.minimum((f - lo) / (mid - lo), (hi - f) / (hi - mid)), 0) * 2 / (hi - lo)
    return w[w.any(axis=1)]


def paired_blocks(ref: DataFrame, est: DataFrame, keys: list[str], block: int = BLOCK) -> DataFrame:
    """Block rows with the arrays r and e of two long-form signals; of blocks of unequal length what both have."""
    r, e = (to_blocks(d, keys, ("v",), block).withColumnRenamed("v", name) for d, name in ((ref, "r"), (est, "e")))
    both = r.join(e, [*keys, "block"])
    n = F.least(F.size("r"), F.size("e"))
    return both.select(*keys, "block", F.slice("r", F.lit(1), n).alias("r"), F.slice("e", F.lit(1), n).alias("e"))


def spectral_scores(blocks: DataFrame, keys: list[str], metrics: list[str], options: dict, block: int = BLOCK) -> DataFrame:
    """The requested scores of spectra by key, of block rows with r and e: each size is transformed once, and a block gives one row of sums.

    l1_freq: 100 / (1 + 10 x mean absolute difference of magnitudes). aura_stft: 100 / (1 + 10 x loss), the loss being
    spectral convergence plus mean log-magnitude distance; aura_mrstft: of the mean loss over ``sizes`` (hop a
    quarter), A-weighted and summed up by ``mr_mels`` bands. bleedless and fullness: 100 / (1 + mean positive difference)
    and 100 / (1 - mean negative difference) of mel levels in dB, each side floored at its peak less 80.
    A signal too short for a frame has null.
    """
    size, rate = options["size"], options["rate"]
    plain, bleed = {"l1_freq", "aura_stft"} & set(metrics), {"bleedless", "fullness"} & set(metrics)
    sizes = {"plain": (size, options["hop"])} if plain or bleed else {}
    shown = {}
    if "aura_mrstft" in metrics:
        for k, n in enumerate(options["sizes"]):
            sizes[f"mr{k}"] = (n, n // 4)
            mel = mel_matrix(options["mr_mels"], n, rate) if options["mr_mels"] else np.eye(n // 2 + 1)
            shown[f"mr{k}"] = (mel * a_weighting(np.arange(n // 2 + 1) * (rate / n))).T
    mel = mel_matrix(options["n_mels"], size, rate).T if bleed else None
    losses = [*(["plain"] if "aura_stft" in metrics else []), *shown]

    def sums(spectra: dict) -> dict:
        out = {}
        for name, (r, e) in spectra.items():
            x, y = np.abs(r), np.abs(e)
            if name == "plain" and bleed:
                a, b = (20 * np.log10(np.maximum(m @ mel, 1e-10)) for m in (x, y))
                out |= {"bx": a.ravel(), "by": b.ravel(), "px": a.max(initial=-np.inf), "py": b.max(initial=-np.inf)}
            if name == "plain" and "l1_freq" in metrics:
                out |= {"l1": np.abs(x - y).sum(), "l1_n": x.size}
            if name in losses:
                x, y = (np.maximum(m @ shown[name] if name in shown else m, 1e-8) for m in (x, y))
                out |= {f"{name}_d": ((x - y) ** 2).sum(), f"{name}_x": (x * x).sum(), f"{name}_l": np.abs(np.log(x) - np.log(y)).sum(), f"{name}_n": x.size}
        return out

    adds = [*(["l1", "l1_n"] if "l1_freq" in metrics else []), *[f"{name}_{c}" for name in losses for c in "dxln"]]
    fields = [*(f"{c} double" for c in adds), *(["bx array<double>", "by array<double>", "px double", "py double"] if bleed else [])]
    parts = frame_sums(blocks, keys, ("r", "e"), sizes, sums, ", ".join(fields), block)
    if bleed:
        # The peaks of a signal are known when all of its blocks are; then each block gives sums again.
        parts = staged(parts, "levels")
        parts = parts.join(parts.groupBy(*keys).agg(F.max("px").alias("top_x"), F.max("py").alias("top_y")), keys)
        floored = F.zip_with("bx", "by", lambda x, y: F.greatest(y, F.col("top_y") - 80) - F.greatest(x, F.col("top_x") - 80))
        parts = parts.withColumn("__d", floored)
        for name, keep in (("up", lambda x: x > 0), ("down", lambda x: x < 0)):
            kept = F.filter("__d", keep)
            parts = parts.withColumns({name: F.aggregate(kept, F.lit(0.0), lambda t, x: t + x), f"{name}_n": F.size(kept).cast("double")})
        parts = parts.withColumn("levels", F.size("bx"))
        adds += ["up", "up_n", "down", "down_n", "levels"]
    total = parts.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in adds])
    loss = lambda name: F.expr(f"try_divide(sqrt({name}_d), sqrt({name}_x)) + try_divide({name}_l, {name}_n)")
    mean = lambda name: F.when(F.col("levels") > 0, F.coalesce(F.try_divide(name, f"{name}_n"), F.lit(0.0)))
    found = {
        "l1_freq": lambda: 100 / (1 + 10 * F.try_divide("l1", "l1_n")),
        "aura_stft": lambda: 100 / (1 + 10 * loss("plain")),
        "aura_mrstft": lambda: 100 / (1 + 10 * sum((loss(name) for name in shown), F.lit(0.0)) / len(shown)),
        "bleedless": lambda: 100 / (1 + mean("up")),
        "fullness": lambda: 100 / (1 - mean("down")),
    }
    return total.select(*keys, *[found[m]().alias(m) for m in metrics])


def time_freq_errors(blocks: DataFrame, keys: list[str], w_time: float, w_freq: float, size: int = 2048, hop: int = 512, norms: tuple[str, ...] = ("l1",), eps: float = 1e-3, block: int = BLOCK) -> DataFrame:
    """By key, for each of ``norms``: w_time x L of samples plus w_freq x L of spectra (re and im), of block rows with r and e.

    ``l1`` is the mean magnitude of the error, ``l2`` its mean square, ``ratio`` its level over the reference's in decibel;
    null for a signal too short for a frame.
    """

    def sums(spectra: dict) -> dict:
        r, e = spectra["f"]
        d = r - e
        sides = {"re": d.real, "im": d.imag, "base_re": r.real, "base_im": r.imag}
        return {f"{k}1": np.abs(x).sum() for k, x in sides.items()} | {"re2": (d.real**2).sum(), "im2": (d.imag**2).sum(), "n": d.size}

    def every(r: np.ndarray, e: np.ndarray) -> dict:
        return {"t1": np.abs(r - e).sum(), "t2": ((r - e) ** 2).sum(), "base_t1": np.abs(r).sum(), "samples": r.size}

    names = ["re1", "im1", "base_re1", "base_im1", "re2", "im2", "n", "t1", "t2", "base_t1", "samples"]
    parts = frame_sums(blocks, keys, ("r", "e"), {"f": (size, hop)}, sums, ", ".join(f"{c} double" for c in names), block, every)
    total = parts.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in names])
    over = lambda x, n: f"try_divide({x}1, {n})"
    level = lambda x, n: f"10 * (log10({over(x, n)} + {eps}) - log10({over('base_' + x, n)} + {eps}))"
    of = {"l1": over, "l2": lambda x, n: f"try_divide({x}2, {n})", "ratio": level}
    return total.select(*keys, *[F.expr(f"{w_time} * ({of[m]('t', 'samples')}) + {w_freq} * ({of[m]('re', 'n')} + {of[m]('im', 'n')})").alias(m) for m in norms])


def ensemble_frames(frames: DataFrame, keys: list[str], method: str) -> DataFrame:
    """One frame row of the estimates' frame rows (keys, model, w, re, im): avg_fft by weights w, min_fft and max_fft by
    magnitude (ties: the first model), median_fft in order of re and im.

    The estimates of a frame meet in one group; they are bounded by the number of models.
    """
    own = F.array_sort(F.collect_list(F.struct("model", F.col("w").cast("double").alias("w"), "re", "im")))
    rows = frames.groupBy(*keys).agg(own.alias("s")).select(*keys, *[F.transform("s", lambda s: s[c]).alias(f"__{c}") for c in ("w", "re", "im")])  # noqa: B023

    def one(w: np.ndarray, z: np.ndarray) -> np.ndarray:
        if method == "avg_fft":
            return (z * w[:, None]).sum(axis=0) / w.sum()
        if method == "median_fft":
            ordered = np.take_along_axis(z, np.lexsort((z.imag, z.real), axis=0), axis=0)
            return (ordered[(len(z) - 1) // 2] + ordered[len(z) // 2]) / 2
        power = z.real**2 + z.imag**2
        at = power.argmin(axis=0) if method == "min_fft" else power.argmax(axis=0)
        return np.take_along_axis(z, at[None], axis=0)[0]

    def run(batches):
        for pdf in batches:
            found = [one(np.asarray(w, float), np.stack(re) + 1j * np.stack(im)) for w, re, im in zip(pdf["__w"], pdf["__re"], pdf["__im"])]
            yield pdf[keys].assign(re=[z.real for z in found], im=[z.imag for z in found])

    types = ", ".join(f"`{k}` {frames.schema[k].dataType.simpleString()}" for k in keys)
    return rows.mapInPandas(run, f"{types}, re array<double>, im array<double>")


def phase_rotate(spec: DataFrame, degrees: float) -> DataFrame:
    """cos(a) x - sin(a) Hilbert(x) as a rotation of the spectrum; the ends (bin 0 and the last) only lose their cosine."""
    a = math.radians(degrees)
    c, s = math.cos(a), math.sin(a)
    edge = (F.col("bin") == 0) | (F.col("bin") == F.max("bin").over(Window.partitionBy("track", "channel", "frame")))
    return spec.withColumn("edge", edge).select(*BINS, F.when(F.col("edge"), F.col("re") * c).otherwise(F.col("re") * c - F.col("im") * s).alias("re"), F.when(F.col("edge"), F.col("im") * c).otherwise(F.col("im") * c + F.col("re") * s).alias("im"))


# from and to in Hz and width, by layout; width 0 is one band.
_LAYOUT_ROWS = """('vocals:1', 0, NULL, 1000), ('vocals:2', 0, 16000, 1000), ('vocals:2', 16000, 20000, 2000), ('vocals:2', 20000, NULL, 0),
('vocals:3', 0, 8000, 1000), ('vocals:3', 8000, 16000, 2000), ('vocals:3', 16000, 20000, 0), ('vocals:3', 20000, NULL, 0),
('vocals:4', 0, 1000, 100), ('vocals:4', 1000, 8000, 1000), ('vocals:4', 8000, 16000, 2000), ('vocals:4', 16000, 20000, 0), ('vocals:4', 20000, NULL, 0),
('vocals:5', 0, 1000, 100), ('vocals:5', 1000, 16000, 1000), ('vocals:5', 16000, 20000, 2000), ('vocals:5', 20000, NULL, 0),
('vocals:6', 0, 1000, 100), ('vocals:6', 1000, 4000, 500), ('vocals:6', 4000, 8000, 1000), ('vocals:6', 8000, 16000, 2000), ('vocals:6', 16000, 20000, 0), ('vocals:6', 20000, NULL, 0),
('vocals:7', 0, 1000, 100), ('vocals:7', 1000, 4000, 250), ('vocals:7', 4000, 8000, 500), ('vocals:7', 8000, 16000, 1000), ('vocals:7', 16000, 20000, 2000), ('vocals:7', 20000, NULL, 0),
('other', 0, 1000, 100), ('other', 1000, 4000, 250), ('other', 4000, 8000, 500), ('other', 8000, 16000, 1000), ('other', 16000, 20000, 2000), ('other', 20000, NULL, 0),
('bass', 0, 500, 50), ('bass', 500, 1000, 100), ('bass', 1000, 4000, 500), ('bass', 4000, 8000, 1000), ('bass', 8000, 16000, 2000), ('bass', 16000, NULL, 0),
('drums', 0, 1000, 50), ('drums', 1000, 2000, 100), ('drums', 2000, 4000, 250), ('drums', 4000, 8000, 500), ('drums', 8000, 16000, 1000), ('drums', 16000, NULL, 0),
('fixed:250', 0, NULL, 250), ('fixed:500', 0, NULL, 500), ('fixed:2000', 0, NULL, 2000)"""


def _layout_sql() -> str:
    return f"""p AS (SELECT layout, CAST(round_even(a * 2048 / 44100, 0) AS INTEGER) AS s, coalesce(CAST(round_even(b * 2048 / 44100, 0) AS INTEGER), 1025) AS e, CAST(round_even(w * 2048 / 44100, 0) AS INTEGER) AS step FROM (VALUES {_LAYOUT_ROWS}) v(layout, a, b, w)),
bands AS (SELECT layout, CAST(lo AS INTEGER) AS lo, CAST(CASE WHEN step > 0 THEN least(lo + step, e) ELSE e END AS INTEGER) AS hi FROM (SELECT layout, s, e, step, unnest(CASE WHEN step > 0 THEN range(s, e, step) ELSE [CAST(s AS BIGINT)] END) AS lo FROM p))"""


# Band layouts are dimension tables; the queries apply them to the energy of the table's spectra.
@query("d10_band_edges", f"WITH {SPEC}, {_layout_sql()} SELECT layout, lo, hi, count(*) AS rows_, round(sum(re * re + im * im), 3) AS energy FROM spec JOIN bands ON bin >= lo // 128 AND bin <= (hi - 1) // 128 GROUP BY ALL".replace("lo // 128", "CAST(floor(lo / 128) AS INTEGER)").replace("(hi - 1) // 128", "CAST(floor((hi - 1) / 128) AS INTEGER)"))
def d10(spark: SparkSession, sf_dir: str) -> DataFrame:
    bands = band_edges(spark, 2048, 44100).withColumn("bin", F.explode(F.sequence(F.floor(F.col("lo") / 128).cast("int"), F.floor((F.col("hi") - 1) / 128).cast("int"))))
    return spectra(spark, sf_dir).join(F.broadcast(bands), "bin").groupBy("layout", "lo", "hi").agg(F.count(F.lit(1)).alias("rows_"), F.round(F.sum(F.col("re") * F.col("re") + F.col("im") * F.col("im")), 3).alias("energy"))


@query("d11_perceptual_filterbanks")
def d11(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec, banks = spectra(spark, sf_dir).withColumn("mag", F.hypot("re", "im")), None
    for scale in ("mel", "erb", "tribark", "bark", "minibark", "musical"):
        one = perceptual_filterbank(spark, 16, 16000, 4, scale).withColumn("scale", F.lit(scale))
        banks = one if banks is None else banks.unionByName(one)
    # All six tables meet one pass over the spectra.
    sums = spec.join(F.broadcast(banks), "bin").groupBy("track", "channel", "frame", "band", "scale").agg(F.round(F.sum(F.col("w") * F.col("mag")), 5).alias("v"))
    return sums.select("track", "channel", "frame", "band", "v", "scale")


_CROP = "b(band, cs, ce, o) AS (VALUES (1, 0, 3, 0), (2, 2, 6, 3), (3, 6, 9, 7))"


@query("c17_band_split", f"WITH {SPEC}, {_CROP} SELECT track, channel, frame, band, CAST(bin - cs + o AS INTEGER) AS bin, {'round(re, 5) + 0.0 AS re, round(im, 5) + 0.0 AS im'} FROM spec JOIN b ON bin >= cs AND bin < ce")
def c17(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _z(band_split(spectra(spark, sf_dir), _bands(spark)), "track", "channel", "frame", "band", "bin")


@query("c18_band_merge", f"WITH {SPEC} SELECT track, channel, frame, bin, round(re * CASE WHEN bin = 2 THEN 2 ELSE 1 END, 5) + 0.0 AS re, round(im * CASE WHEN bin = 2 THEN 2 ELSE 1 END, 5) + 0.0 AS im FROM spec")
def c18(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _z(band_merge(band_split(spectra(spark, sf_dir), _bands(spark)), _bands(spark)), *BINS)


@query("h11_band_spec_checks", f"WITH {fx.MEDIA}, b AS (SELECT sr::VARCHAR AS layout, CAST(page_id AS INTEGER) AS lo, CAST(page_id + page_id % 7 AS INTEGER) AS hi FROM media), l AS (SELECT *, lag(hi) OVER (PARTITION BY layout ORDER BY lo, hi) AS before FROM b), v AS (SELECT *, CASE WHEN hi <= lo THEN 'width' WHEN before IS NULL AND lo <> 0 THEN 'start' WHEN before > lo THEN 'overlap' WHEN lo - before > 1 THEN 'gap' END AS violation FROM l) SELECT layout, lo, hi, violation FROM v WHERE violation IS NOT NULL")
def h11(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = fx.media(spark, sf_dir).select(F.col("sr").cast("string").alias("layout"), F.col("page_id").cast("int").alias("lo"), (F.col("page_id") + F.col("page_id") % 7).cast("int").alias("hi"))
    return band_spec_checks(m)


# Spectra of estimates: tracks 0..9 with their models.
ESPEC = SPEC.replace("spec AS (SELECT track, channel", "spec AS (SELECT track % 10 AS song, CAST(track * 2 + channel AS BIGINT) AS model, track, channel").replace("GROUP BY ALL)", "GROUP BY ALL)")


def estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frame rows of estimates: song, model, frame, w, re, im."""
    rows = stft_blocks(to_blocks(fx.stereo(spark, sf_dir), ["track", "channel"]), ["track", "channel"], SIZE, HOP)
    model = F.col("track") * 2 + F.col("channel")
    return rows.select((F.col("track") % 10).alias("song"), model.alias("model"), "frame", (model % 5 + 1).alias("w"), "re", "im")


def _bins(frames: DataFrame, *keys: str) -> DataFrame:
    return frames.select(*keys, F.posexplode(F.arrays_zip("re", "im")).alias("bin", "z")).select(*keys, "bin", "z.re", "z.im")


_E = ["song", "frame", "bin"]


@query("f4_ensemble_avg_fft", f"WITH {ESPEC} SELECT song, frame, bin, round(sum(re * (model % 5 + 1)) / sum(model % 5 + 1), 5) + 0.0 AS re, round(sum(im * (model % 5 + 1)) / sum(model % 5 + 1), 5) + 0.0 AS im FROM spec GROUP BY song, frame, bin")
def f4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _z(_bins(ensemble_frames(estimates(spark, sf_dir), _E[:2], "avg_fft"), *_E[:2]), *_E)


@query("f5_ensemble_extreme_fft", f"""WITH {ESPEC}, m AS (SELECT *, re * re + im * im AS s FROM spec) SELECT 'min' AS how, song, frame, bin, round(arg_min(re, (s, model)), 5) + 0.0 AS re, round(arg_min(im, (s, model)), 5) + 0.0 AS im FROM m GROUP BY song, frame, bin
UNION ALL SELECT 'max', song, frame, bin, round(arg_max(re, (s, -model)), 5) + 0.0, round(arg_max(im, (s, -model)), 5) + 0.0 FROM m GROUP BY song, frame, bin""")
def f5(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = estimates(spark, sf_dir)
    a, b = (_z(_bins(ensemble_frames(e, _E[:2], f"{how}_fft"), *_E[:2]), *_E).withColumn("how", F.lit(how)) for how in ("min", "max"))
    return a.unionByName(b)


@query("f6_ensemble_median_fft", f"""WITH {ESPEC}, r AS (SELECT *, row_number() OVER (PARTITION BY song, frame, bin ORDER BY re, im, model) AS turn, count(*) OVER (PARTITION BY song, frame, bin) AS n FROM spec)
SELECT song, frame, bin, round(avg(re), 5) + 0.0 AS re, round(avg(im), 5) + 0.0 AS im FROM r WHERE turn IN (floor((n + 1) / 2), floor((n + 2) / 2)) GROUP BY song, frame, bin""")
def f6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _z(_bins(ensemble_frames(estimates(spark, sf_dir), _E[:2], "median_fft"), *_E[:2]), *_E)


PSPEC = SPEC + ", p AS (SELECT x.track, x.channel, x.frame, x.bin, sqrt(x.re * x.re + x.im * x.im) AS xm, sqrt(y.re * y.re + y.im * y.im) AS ym FROM spec x JOIN spec y ON y.track = x.track + 1 AND y.channel = x.channel AND y.frame = x.frame AND y.bin = x.bin WHERE x.track % 2 = 0)"


def _pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = fx.stereo(spark, sf_dir)
    return paired_blocks(s.filter("track % 2 = 0"), s.filter("track % 2 = 1").withColumn("track", F.col("track") - 1), ["track", "channel"])


def _scored(spark: SparkSession, sf_dir: str, metrics: list[str], **options) -> DataFrame:
    out = spectral_scores(_pair(spark, sf_dir), ["track", "channel"], metrics, OPTIONS | options)
    return out.select("track", "channel", *[F.round(m, 4).alias(m) for m in metrics])


@query("i3_l1_freq", f"WITH {PSPEC} SELECT track, channel, round(100 / (1 + 10 * avg(abs(xm - ym))), 4) AS l1_freq FROM p GROUP BY ALL")
def i3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir, ["l1_freq"], size=SIZE, hop=HOP)


@query("i4_aura_stft", f"WITH {PSPEC}, f AS (SELECT track, channel, greatest(xm, 1e-8) AS x, greatest(ym, 1e-8) AS y FROM p) SELECT track, channel, round(100 / (1 + 10 * (sqrt(sum((x - y) * (x - y))) / sqrt(sum(x * x)) + avg(abs(ln(x) - ln(y))))), 4) AS score FROM f GROUP BY ALL")
def i4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir, ["aura_stft"], size=SIZE, hop=HOP).withColumnRenamed("aura_stft", "score")


@query("i5_aura_mrstft")
def i5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir, ["aura_mrstft"], sizes=(8, 16, 32), mr_mels=3, rate=16000).withColumnRenamed("aura_mrstft", "score")


@query("i7_bleedless_fullness")
def i7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir, ["bleedless", "fullness"], size=SIZE, hop=HOP, n_mels=4, rate=16000)


_F13 = """sp AS (SELECT track, model, frame, bin, sum(x * cos(2 * pi() * bin * i / 16)) AS re, sum(x * sin(2 * pi() * bin * i / 16)) AS im, sum(y * cos(2 * pi() * bin * i / 16)) AS rre, sum(y * sin(2 * pi() * bin * i / 16)) AS rim FROM fr CROSS JOIN (SELECT unnest(range(0, 9)) AS bin) GROUP BY ALL)"""


@query("i13_time_freq_error", f"""WITH {fx.SIG}, ref AS (SELECT track, pos, median(v) AS r FROM sig GROUP BY ALL), e AS (SELECT track, model, pos, r - v AS d, r FROM sig JOIN ref USING (track, pos)),
t AS (SELECT track, model, avg(abs(d)) AS t1, avg(d * d) AS t2, 10 * (log10(avg(abs(d)) + 1e-3) - log10(avg(abs(r)) + 1e-3)) AS t3 FROM e GROUP BY ALL),
fr AS (SELECT track, model, frame, pos - frame * 8 AS i, d * pow(sin(pi() * (pos - frame * 8) / 16), 2) AS x, r * pow(sin(pi() * (pos - frame * 8) / 16), 2) AS y FROM e JOIN (SELECT unnest(range(0, 7)) AS frame) f ON pos >= frame * 8 AND pos < frame * 8 + 16), {_F13},
g AS (SELECT track, model, avg(abs(re)) + avg(abs(im)) AS f1, avg(re * re) + avg(im * im) AS f2, 10 * (log10(avg(abs(re)) + 1e-3) - log10(avg(abs(rre)) + 1e-3) + log10(avg(abs(im)) + 1e-3) - log10(avg(abs(rim)) + 1e-3)) AS f3 FROM sp GROUP BY ALL)
SELECT track, model, round(0.6 * t1 + 0.4 * f1, 5) AS l1, round(0.6 * t2 + 0.4 * f2, 5) AS l2, round(0.6 * t3 + 0.4 * f3, 4) AS ratio FROM t JOIN g USING (track, model)""")
def i13(spark: SparkSession, sf_dir: str) -> DataFrame:
    j, keys = against_median(fx.sig(spark, sf_dir)), ["track", "model"]
    out = time_freq_errors(to_blocks(j, keys, ("r", "e")), keys, 0.6, 0.4, SIZE, HOP, ("l1", "l2", "ratio"))
    return out.select(*keys, *[F.round(n, 4 if n == "ratio" else 5).alias(n) for n in ("l1", "l2", "ratio")])


@query("b15_phase_rotate", f"WITH {SPEC} SELECT track, channel, frame, bin, round(CASE WHEN bin IN (0, 8) THEN re * cos(radians(30)) ELSE re * cos(radians(30)) - im * sin(radians(30)) END, 5) + 0.0 AS re, round(CASE WHEN bin IN (0, 8) THEN im * cos(radians(30)) ELSE im * cos(radians(30)) + re * sin(radians(30)) END, 5) + 0.0 AS im FROM spec")
def b15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _z(phase_rotate(spectra(spark, sf_dir), 30), *BINS)
