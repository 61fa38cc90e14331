"""Two aligned signals: subtraction, complements, masks, phase and lag.

Alignment is an equi-join on the position, and trimming to the shorter signal is what an inner join does.
There is no inequality join anywhere: lags come from cross-spectra of blocks, and candidates are tried within a block.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stemframe import fixtures as fx
from stemframe.operators.blocks import BLOCK, array_sums, correlations, frames_of, placed_blocks, surroundings, to_blocks, with_halo
from stemframe.operators.spectral import BINS, SPEC, _z, polar, resample_sinc, spectra
from stemframe.registry import query
from stemframe.storage import discard, staged

POS = ["track", "channel", "pos"]
FB = ["track", "frame", "bin"]


def invert_waveform(a: DataFrame, b: DataFrame, rates: tuple[float, float] = (1, 1)) -> DataFrame:
    """a - b by channel, as long as the shorter one; a mono b serves all channels, a mono a meets the mean of b's channels.

    ``rates`` are the sample rates of a and b; b is brought to that of a where they differ.
    """
    if rates[0] != rates[1]:
        b = resample_sinc(b, ["track", "channel"], rates[0] / rates[1])
    top = b.groupBy("track").agg((F.max("channel") + 1).alias("channels"))
    mono_a = a.groupBy("track").agg((F.max("channel") == 0).alias("mono"))
    left = a.join(mono_a, "track").join(top, "track").withColumn("pick", F.when(F.col("mono"), F.lit(-1)).otherwise(F.least("channel", F.col("channels") - 1)))
    mean = b.groupBy("track", "pos").agg(F.avg("v").alias("w")).withColumn("pick", F.lit(-1).cast("long"))
    right = b.select("track", F.col("channel").alias("pick"), "pos", F.col("v").alias("w")).unionByName(mean)
    return left.join(right, ["track", "pick", "pos"]).select("track", "channel", "pos", (F.col("v") - F.col("w")).alias("v"))


def both_spectra(x: DataFrame, y: DataFrame, keys: list[str] = BINS) -> DataFrame:
    """Two spectra side by side: keys, xr, xi, yr, yi."""
    return x.select(*keys, F.col("re").alias("xr"), F.col("im").alias("xi")).join(y.select(*keys, F.col("re").alias("yr"), F.col("im").alias("yi")), keys)


def xm() -> Column:
    """Magnitude of the first spectrum."""
    return F.hypot("xr", "xi")


def ym() -> Column:
    """Magnitude of the second."""
    return F.hypot("yr", "yi")


def _scaled(df: DataFrame, size: Column, re: str, im: str, keys: list[str] = BINS) -> DataFrame:
    """A magnitude with the phase of (re, im); phase 0 where that is 0."""
    m = F.hypot(re, im)
    return df.select(*keys, F.when(m > 0, size * F.col(re) / m).otherwise(size).alias("re"), F.when(m > 0, size * F.col(im) / m).otherwise(0.0).alias("im"))


def invert_spectrogram(x: DataFrame, y: DataFrame) -> DataFrame:
    """max(|x| - |y|, 0) with the phase of x."""
    return _scaled(both_spectra(x, y), F.greatest(xm() - ym(), F.lit(0.0)), "xr", "xi")


def invert_audio(x: DataFrame, y: DataFrame, by_peak: bool = True) -> DataFrame:
    """y - max(|x|, |y|) with the phase of x; or x less the softened magnitude of y."""
    both = both_spectra(x, y)
    if by_peak:
        top = F.greatest(xm(), ym())
        return both.select(*BINS, (F.col("yr") - F.when(xm() > 0, top * F.col("xr") / xm()).otherwise(top)).alias("re"), (F.col("yi") - F.when(xm() > 0, top * F.col("xi") / xm()).otherwise(0.0)).alias("im"))
    less = reduce_vocal(x, y, 0.2).select(*BINS, F.col("re").alias("yr"), F.col("im").alias("yi"))
    return x.join(less, BINS).select(*BINS, (F.col("re") - F.col("yr")).alias("re"), (F.col("im") - F.col("yi")).alias("im"))


def reduce_vocal(x: DataFrame, y: DataFrame, soft: float) -> DataFrame:
    """|y| less soft x |x - y| where that is the larger, not below 0, with the phase of y."""
    both = both_spectra(x, y)
    v = F.hypot(F.col("xr") - F.col("yr"), F.col("xi") - F.col("yi"))
    return _scaled(both, F.greatest(ym() - F.when(v > ym(), v * soft).otherwise(0.0), F.lit(0.0)), "yr", "yi")


def spec_effects(x: DataFrame, y: DataFrame, how: str, value: float = 0.5) -> DataFrame:
    """min or max by magnitude (the second wins ties), or the blend y v + x (1 - v)."""
    both = both_spectra(x, y)
    if how == "blend":
        return both.select(*BINS, (F.col("yr") * value + F.col("xr") * (1 - value)).alias("re"), (F.col("yi") * value + F.col("xi") * (1 - value)).alias("im"))
    second = ym() <= xm() if how == "min" else ym() >= xm()
    return both.select(*BINS, F.when(second, F.col("yr")).otherwise(F.col("xr")).alias("re"), F.when(second, F.col("yi")).otherwise(F.col("xi")).alias("im"))


def spec_left_right(spec: DataFrame) -> DataFrame:
    side = lambda c, n: F.max(F.when(F.col("channel") == n, F.col(c)))
    return spec.groupBy(*FB).agg(side("re", 0).alias("xr"), side("im", 0).alias("xi"), side("re", 1).alias("yr"), side("im", 1).alias("yi"))


def phantom_center(spec: DataFrame, reduction: float = 0.99999) -> DataFrame:
    """Centre (both channels): the smaller magnitude with the other channel's phase; side: the channel less reduction x centre."""
    lr = spec_left_right(spec)
    m = F.least(xm(), ym())
    # the left channel takes the phase of the right one, and the other way round
    lr = lr.select("*", *[F.when(s > 0, m * F.col(c) / s).otherwise(z).alias(n) for n, c, s, z in (("cl_re", "yr", ym(), m), ("cl_im", "yi", ym(), F.lit(0.0)), ("cr_re", "xr", xm(), m), ("cr_im", "xi", xm(), F.lit(0.0)))])
    part = lambda ch, w: F.struct(F.lit(ch).alias("channel"), *[F.col(f"c{w}_{c}").alias(f"c_{c}") for c in ("re", "im")], *[F.col(f"{'x' if ch == 0 else 'y'}{c[0]}").alias(c) for c in ("re", "im")])
    out = lr.select(*FB, F.explode(F.array(part(0, "l"), part(1, "r"))).alias("p")).select(*FB, "p.*")
    return out.select("track", "channel", "frame", "bin", "c_re", "c_im", (F.col("re") - reduction * F.col("c_re")).alias("s_re"), (F.col("im") - reduction * F.col("c_im")).alias("s_im"))


def apply_mask(spec: DataFrame, mask: DataFrame) -> DataFrame:
    """y = m x and v = (1 - m) x, phases kept."""
    both = spec.join(mask, BINS)
    m = F.col("m")
    return both.select(*BINS, (m * F.col("re")).alias("y_re"), (m * F.col("im")).alias("y_im"), ((1 - m) * F.col("re")).alias("v_re"), ((1 - m) * F.col("im")).alias("v_im"))


def adjust_aggressiveness(mask: DataFrame, value: float, split_bin: int, other_stem: bool = False, left: float = 0.0, right: float = 0.0) -> DataFrame:
    """m^(1 + a / 3) below the split bin and m^(1 + a) from there on; a = 2 value, 1 - a for other stems, plus a channel's correction."""
    a = value * 2
    if a == 0:
        return mask
    a = 1 - a if other_stem else a
    own = F.when(F.col("channel") == 0, a + left).otherwise(a + right)
    return mask.withColumn("m", F.pow("m", F.when(F.col("bin") < split_bin, 1 + own / 3).otherwise(1 + own)))


def merge_artifacts(mask: DataFrame, threshold: float, min_range: int, fade: int) -> DataFrame:
    """Runs of frames whose least mask is above the threshold and longer than ``min_range`` are raised towards 1, with faded ends.

    Gaps and islands: frame - row_number is constant within a run.
    """
    if min_range < 2 * fade:
        raise ValueError("min_range must be at least twice the fade")
    own = Window.partitionBy("track").orderBy("frame")
    low = mask.groupBy("track", "frame").agg(F.min("m").alias("low"))
    last = low.groupBy("track").agg((F.max("frame") + 1).alias("frames"))
    loud = low.filter(F.col("low") > threshold).withColumn("island", F.col("frame") - F.row_number().over(own))
    runs = loud.groupBy("track", "island").agg(F.min("frame").alias("s"), F.max("frame").alias("e")).filter(F.col("e") - F.col("s") > min_range)
    before = F.lag("e").over(Window.partitionBy("track").orderBy("s"))
    runs = runs.withColumn("s", F.when(F.col("s") - before < fade, before - 2 * fade).otherwise(F.col("s"))).join(last, "track")
    f = F.explode(F.sequence(F.greatest(F.col("s"), F.lit(0)), F.least(F.col("e"), F.col("frames")) - 1))
    rows = runs.withColumn("frame", f)
    step = 1.0 / (fade - 1)
    up, down = (F.col("frame") - F.col("s")) * step, (F.col("e") - 1 - F.col("frame")) * step
    w = F.when((F.col("e") != F.col("frames")) & (F.col("frame") >= F.col("e") - fade), down).when((F.col("s") != 0) & (F.col("frame") < F.col("s") + fade), up).otherwise(1.0)
    # where joined runs overlap, the later one writes last
    weights = rows.withColumn("w", w).groupBy("track", "frame").agg(F.max_by("w", "e").alias("w"))
    # weights lie beside the masks of their frame instead of being joined to them, so that masks that lie by track stay there
    both = mask.withColumn("__own", F.lit(True)).unionByName(weights, allowMissingColumns=True)
    both = both.withColumn("w", F.max("w").over(Window.partitionBy("track", "frame"))).filter("__own")
    return both.withColumn("m", F.col("m") + F.coalesce("w", F.lit(0.0)) * (1 - F.col("m"))).drop("w", "__own")


def soft_mask(targets: DataFrame, mix: DataFrame, eps: float = 1e-10) -> DataFrame:
    """mix x target / (eps + sum of targets): targets have stem and mag, mix has re and im."""
    total = F.sum("mag").over(Window.partitionBy(*BINS))
    share = targets.withColumn("g", F.col("mag") / (total + eps))
    return share.join(mix, BINS).select("stem", *BINS, (F.col("g") * F.col("re")).alias("re"), (F.col("g") * F.col("im")).alias("im"))


def mix_phase_estimate(targets: DataFrame, mix: DataFrame) -> DataFrame:
    both = targets.join(mix, BINS)
    re, im = polar(F.col("mag"), F.atan2("im", "re"))
    return both.select("stem", *BINS, re.alias("re"), im.alias("im"))


def _less(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """a less the sum of b where both have rows, as one grouping: inputs that lie by some of the keys stay where they are."""
    side = lambda d, name: d.select(*keys, *[(F.col("v") if n == name else F.lit(None).cast("double")).alias(n) for n in "ab"], F.lit(name).alias("side"))
    both = side(a, "a").unionByName(side(b, "b")).groupBy(*keys).agg((F.sum("a") - F.sum("b")).alias("v"), F.min("side").alias("low"), F.max("side").alias("high"))
    return both.filter("low = 'a' AND high = 'b'").select(*keys, "v")


def residual_target(stems: DataFrame, mix: DataFrame, keys: list[str]) -> DataFrame:
    """The stems and one more: the mixture less their sum."""
    rest = _less(mix, stems, keys).select(*keys, F.lit("residual").alias("stem"), "v")
    return stems.select(*keys, "stem", "v").unionByName(rest)


def mixdown(stems: DataFrame, keys: list[str], only: list[str] | None = None) -> DataFrame:
    """Sum of (the named) stems by position; shorter stems count as silence past their end."""
    some = stems if only is None else stems.filter(F.col("stem").isin(only))
    return some.groupBy(*keys).agg(F.sum("v").alias("v"))


def complement_stem(mix: DataFrame, primary: DataFrame, keys: list[str]) -> DataFrame:
    """The mixture less one stem, where both have a sample."""
    return _less(mix, primary, keys)


def minus_plus(stems: DataFrame, selected: Column, names: tuple[str, str]) -> DataFrame:
    """Two takes on what is not selected: the mixture less the selected stems, and the sum of the others scaled to its peak."""
    s = stems.groupBy("track", "pos").agg(F.sum("v").alias("all"), F.sum(F.when(selected, F.col("v")).otherwise(0.0)).alias("picked"), F.sum(F.when(~selected, F.col("v")).otherwise(0.0)).alias("plus"))
    s = s.withColumn("minus", F.col("all") - F.col("picked"))
    own = Window.partitionBy("track")
    a, b = F.max(F.abs("minus")).over(own), F.max(F.abs("plus")).over(own)
    s = s.withColumn("plus", F.when(b > 0, F.col("plus") * a / b).otherwise(F.col("plus")))
    return s.select("track", "pos", F.expr(f"stack(2, '{names[0]}', minus, '{names[1]}', plus) AS (stem, v)"))


def inverted_stems(stems: DataFrame, selected: list[str]) -> DataFrame:
    return minus_plus(stems, F.col("stem").isin(selected), ("inverted -", "inverted +"))


def instrumental_stems(stems: DataFrame, vocals: str) -> DataFrame:
    return minus_plus(stems, F.col("stem") == vocals, ("instrumental -", "instrumental +"))


def reduce_mix(inst: DataFrame, voc: DataFrame, rate: float = 0.9) -> DataFrame:
    return inst.join(voc.withColumnRenamed("v", "w"), ["track", "pos"]).select("track", "pos", (F.col("v") * (1 - rate) + F.col("w")).alias("v"))


def stem_combinations(stems: DataFrame, without: str) -> DataFrame:
    """Every subset (of two or more) of the stems but ``without``, summed and named a+b+c.

    The subsets come from bit masks over the stem names, a table of 2^n rows; a position's stems are gathered once and meet
    each mask in their row, so that sums are never exchanged. A subset has a row where one of its stems does.
    """
    some = stems.filter(F.col("stem") != without)
    names = some.select("stem").distinct().agg(F.array_sort(F.collect_set("stem")).alias("names"))
    masks = names.withColumn("mask", F.explode(F.expr("sequence(1, cast(shiftleft(1, size(names)) AS int) - 1)"))).filter("bit_count(mask) >= 2")
    named = masks.select("mask", F.concat_ws("+", F.expr("filter(names, (x, i) -> shiftright(mask, i) & 1 = 1)")).alias("combination"))
    bits = some.crossJoin(F.broadcast(names)).select("track", "pos", "v", F.expr("shiftleft(1, cast(array_position(names, stem) AS int) - 1)").alias("bit"))
    places = bits.groupBy("track", "pos").agg(F.bit_or("bit").alias("there"), F.collect_list(F.when(F.col("v").isNotNull(), F.struct("bit", "v"))).alias("s"))
    met = places.crossJoin(F.broadcast(named)).filter("there & mask <> 0")
    total = F.expr("aggregate(s, CAST(NULL AS DOUBLE), (a, x) -> if(x.bit & mask <> 0, coalesce(a, 0D) + x.v, a))")
    return met.select("track", "combination", "pos", total.alias("v"))


def phase_inverted(a: DataFrame, b: DataFrame, first: int = 1000) -> DataFrame:
    """track, corr, inverted: correlation of the first samples of the channels' means is negative."""
    mean = lambda d, n: d.filter(F.col("pos") < first).groupBy("track", "pos").agg(F.avg("v").alias(n))
    both = mean(a, "a").join(mean(b, "b"), ["track", "pos"])
    return both.groupBy("track").agg(F.corr("a", "b").alias("corr")).withColumn("inverted", F.col("corr") < 0)


def best_lag(a: DataFrame, b: DataFrame, most: int, block: int = BLOCK) -> DataFrame:
    """The shift of b against a of largest cross-correlation, within +-most, of lags at which they meet; the least shift wins ties.

    Values that differ by no more than the rounding of a transform (5e-10, or 1e-12 of the largest) are ties.
    """
    found = correlations(placed_blocks(a, ["track"], block), placed_blocks(b, ["track"], block), ["track"], most, block)

    def pick(batches):
        for pdf in batches:
            some = pdf[[bool(np.isfinite(c).any()) for c in pdf["c"]]]  # signals that meet at some lag
            lags = []
            for c in some["c"]:
                c = np.where(np.isfinite(c), c, -np.inf)
                lags.append(int(np.argmax(c >= c.max() - max(5e-10, 1e-12 * np.abs(c[np.isfinite(c)]).max()))) - most)
            yield some[["track"]].assign(lag=lags)

    return found.mapInPandas(pick, f"track {a.schema['track'].dataType.simpleString()}, lag int")


def align_track(mix: DataFrame, stem: DataFrame, probes: list[int], width: int, most: int, gains: list[float], block: int = BLOCK) -> DataFrame:
    """Residual of the mixture less the stem, over the lags found at several probes and some gains; the least mean magnitude wins.

    track, lag, db, level and the residual's samples (pos, v). A block of the mixture tries all candidates by
    itself and gives one row of sums; samples are moved only by what wins.
    """
    found = None
    for p in probes:
        cut = lambda d: d.filter((F.col("pos") >= p) & (F.col("pos") < p + width)).withColumn("pos", F.col("pos") - p)  # noqa: E731,B023
        one = best_lag(cut(mix), cut(stem), most, block)
        found = one if found is None else found.unionByName(one)
    lags = found.groupBy("track").agg(F.array_sort(F.collect_set("lag")).alias("lags"))
    near = surroundings(placed_blocks(mix, ["track"], block), placed_blocks(stem, ["track"], block), ["track"], most, block).join(lags, "track")

    def tried(batches):
        for pdf in batches:
            out = []
            for v, on, w, lags in zip(pdf["v"], pdf["on"], pdf["near_v"], pdf["lags"]):
                moved = np.array([w[most - lag : most - lag + len(v)] for lag in lags])
                out.append(np.array([(np.abs(v - moved * 10 ** (db / 20)) * on).sum(axis=1) for db in gains]).T.ravel())
            yield pdf[["track", "block"]].assign(c=out)

    kind = f"track {mix.schema['track'].dataType.simpleString()}"
    sums = array_sums(near.mapInPandas(tried, f"{kind}, block int, c array<double>"), ["track"], "c")
    n = mix.groupBy("track").agg(F.count(F.lit(1)).alias("n"))
    every = sums.join(lags, "track").join(n, "track").select("track", "lags", (F.posexplode(F.expr("transform(c, x -> x / n)"))).alias("k", "level"))
    every = every.select("track", F.expr(f"lags[k div {len(gains)}]").alias("lag"), F.element_at(F.array(*map(F.lit, gains)), F.col("k") % len(gains) + 1).alias("db"), "level")
    best = every.groupBy("track").agg(F.min_by(F.struct("lag", "db", "level"), F.struct(F.round("level", 9), "lag", "db")).alias("b")).select("track", "b.*")
    moved = stem.join(best, "track").select("track", (F.col("pos") + F.col("lag")).alias("pos"), (F.col("v") * F.pow(F.lit(10.0), F.col("db") / 20)).alias("w"))
    rest = mix.join(best, "track").join(moved, ["track", "pos"], "left")
    return rest.select("track", "lag", "db", "level", "pos", (F.col("v") - F.coalesce("w", F.lit(0.0))).alias("v"))


def local_time_correction(mix: DataFrame, stem: DataFrame, size: int, gains: list[float], most: int, block: int = BLOCK) -> DataFrame:
    """Within Hann-weighted windows (step half a window) the gain and circular shift of least mean residual; the residuals overlap-added.

    Positions where no whole window counts stay 0. Windows are frames of block rows; all shifts and gains of a
    window are tried in its task, so that rows don't grow with them. (The residual is a mean magnitude, which no
    correlation gives.)
    """
    hop = size // 2
    a, b = to_blocks(mix, ["track"], block=block), to_blocks(stem, ["track"], block=block).withColumnRenamed("v", "w")
    both = with_halo(a.join(b, ["track", "block"]), ["track"], ("v", "w"), 0, size - 1, block)
    order = sorted((abs(roll), roll, gain) for roll in range(-most, most + 1) for gain in gains)
    weight = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / (size - 1))

    def residuals(batches):
        for pdf in batches:
            for track, number, own, v, w in zip(pdf["track"], pdf["block"], pdf["own"], pdf["v"], pdf["w"]):
                n = min(len(v), len(w))
                first, x = frames_of(v[:n], 0, min(own, n), number * block, size, hop, size - 1)
                _, y = frames_of(w[:n], 0, min(own, n), number * block, size, hop, size - 1)
                if not len(x):
                    continue
                least, best = np.full(len(x), np.inf), np.zeros(x.shape)
                for _, roll, gain in order:
                    d = x - np.roll(y, roll, axis=1) * gain
                    level = np.round(np.abs(d).mean(axis=1), 9)
                    better = level < least
                    least, best = np.where(better, level, least), np.where(better[:, None], d, best)
                yield pd.DataFrame({"track": [track] * len(x), "start": (first + np.arange(len(x))) * hop, "d": list(best * weight)})

    rows = both.mapInPandas(residuals, f"track {mix.schema['track'].dataType.simpleString()}, start long, d array<double>")
    h = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: 0.5 - 0.5 * F.cos(2 * math.pi * i / (size - 1)))
    flat = rows.select("track", "start", F.posexplode(F.arrays_zip("d", h.alias("h"))).alias("i", "x"))
    s = flat.groupBy("track", (F.col("start") + F.col("i")).alias("pos")).agg(F.sum("x.d").alias("s"), F.sum("x.h").alias("w"))
    return mix.join(s, ["track", "pos"], "left").select("track", "pos", F.when(F.col("w") > 1e-6, F.col("s") / F.col("w")).otherwise(0.0).alias("v"))


def leading_silence(df: DataFrame, threshold: float, size: int = 1024) -> DataFrame:
    """Samples of silence at the start, in whole frames, on the channel of most energy; all silent: the length."""
    level = df.groupBy("track", "channel", F.floor(F.col("pos") / size).alias("f")).agg(F.max(F.abs("v")).alias("p"), F.sum(F.col("v") * F.col("v")).alias("e"), F.max("pos").alias("last"))
    per = level.groupBy("track", "channel").agg(F.min(F.when(F.col("p") > threshold, F.col("f") * size)).alias("start"), F.sum("e").alias("e"), (F.max("last") + 1).alias("n"))
    return per.groupBy("track").agg(F.max_by(F.coalesce("start", "n"), F.struct(F.round("e", 9), -F.col("channel"))).alias("silence"))


def match_leading_silence(reference: DataFrame, target: DataFrame, threshold: float, size: int) -> DataFrame:
    """Target moved so that its silence ends where the reference's does: zeros in front, or samples dropped."""
    d = leading_silence(reference, threshold, size).withColumnRenamed("silence", "r").join(leading_silence(target, threshold, size), "track").select("track", (F.col("r") - F.col("silence")).alias("d"))
    moved = target.join(d, "track").select("track", "channel", (F.col("pos") + F.col("d")).alias("pos"), "v").filter("pos >= 0")
    channels = target.select("track", "channel").distinct().join(d, "track").filter("d > 0")
    zeros = channels.select("track", "channel", F.explode(F.sequence(F.lit(0).cast("long"), F.col("d") - 1)).alias("pos"), F.lit(0.0).alias("v"))
    return moved.unionByName(zeros)


def wiener_em(targets: DataFrame, mix: DataFrame, channels: int, rounds: int = 1, eps: float = 1e-10, tile: int = 4096) -> DataFrame:
    """Multichannel Wiener estimates of stems with any number of channels by expectation-maximisation.

    targets: track, stem, frame, bin, and re, im as arrays of ``channels`` values; mix: the same without stem. In each round v is
    the mean power of a stem, R its spatial covariance by bin, and the stems become v R (sum of v R + sqrt(eps) I)^-1
    times the mixture. A track's input is divided by a tenth of its peak where that is above one, so that eps means the
    same for loud tracks, and multiplied back.

    Rows are tiles of up to ``tile`` frames of a bin. A round is two passes over them: sums for the covariances, which
    Spark adds up by stem and bin, and a batch of Hermitian solves. Frames that the mixture does not have are left out.
    """
    keys, wide = ["track", "bin", "part"], channels * channels
    part = F.expr(f"CAST(frame div {tile} AS INT)")
    power = lambda r, i: F.array_max(F.zip_with(r, i, lambda a, b: F.hypot(a, b)))
    peak = mix.groupBy("track").agg(F.greatest(F.lit(1.0), F.max(power("re", "im")) / 10).alias("scale"))
    own = targets.groupBy("track", "bin", part.alias("part")).agg(F.collect_list(F.struct(F.col("stem").cast("string").alias("stem"), F.col("frame").cast("long").alias("frame"), "re", "im")).alias("y"))
    whole = mix.groupBy("track", "bin", part.alias("part")).agg(F.collect_list(F.struct(F.col("frame").cast("long").alias("frame"), "re", "im")).alias("x"))
    columns = lambda name, *fields: [F.transform(name, lambda s: s[f]).alias(f"{name}_{f}") for f in fields]  # noqa: E731,B023
    packed = own.join(whole, keys).join(peak, "track").select(*keys, "scale", *columns("y", "stem", "frame", "re", "im"), *columns("x", "frame", "re", "im"))
    kinds = f"track {mix.schema['track'].dataType.simpleString()}, bin {mix.schema['bin'].dataType.simpleString()}, part int"
    state = f"{kinds}, scale double, stems array<string>, frames array<long>, there array<boolean>, yr array<double>, yi array<double>, xr array<double>, xi array<double>"

    def stacks(batches):
        """Dense stacks of a tile: stems by frames by channels, and which of them are rows."""
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                frames, at = np.unique(np.asarray(r.x_frame), return_index=True)
                x = (np.stack(r.x_re) + 1j * np.stack(r.x_im))[at] / r.scale
                stems, s = np.unique(np.asarray(r.y_stem, str), return_inverse=True)
                f = np.searchsorted(frames, r.y_frame)
                ok = (f < frames.size) & (frames[np.minimum(f, frames.size - 1)] == np.asarray(r.y_frame))
                y, there = np.zeros((stems.size, frames.size, channels), complex), np.zeros((stems.size, frames.size), bool)
                y[s[ok], f[ok]] = (np.stack(r.y_re) + 1j * np.stack(r.y_im))[ok] / r.scale
                there[s[ok], f[ok]] = True
                out.append((list(stems), frames, there.ravel(), y.real.ravel(), y.imag.ravel(), x.real.ravel(), x.imag.ravel()))
            yield pdf[[*keys, "scale"]].assign(**dict(zip(("stems", "frames", "there", "yr", "yi", "xr", "xi"), map(list, zip(*out)))))

    def stack(r) -> tuple[np.ndarray, np.ndarray]:
        y = (np.asarray(r.yr) + 1j * np.asarray(r.yi)).reshape(len(r.stems), len(r.frames), channels)
        return y, (np.abs(y) ** 2).mean(axis=2)

    def sums(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                y, v = stack(r)
                c = np.einsum("sfc,sfd->scd", y, y.conj()).reshape(len(y), wide)
                out += [(r.track, r.bin, stem, np.r_[c[k].real, c[k].imag, v[k].sum()]) for k, stem in enumerate(r.stems)]
            yield pd.DataFrame(out, columns=["track", "bin", "stem", "c"])

    def solved(batches):
        for pdf in batches:
            yr, yi = [], []
            for r in pdf.itertuples(index=False):
                y, v = stack(r)
                found = {s["stem"]: np.asarray(s["c"]) for s in r.sums}
                c = np.array([found[stem] for stem in r.stems])
                cov = ((c[:, :wide] + 1j * c[:, wide:-1]) / (c[:, -1:] + eps)).reshape(-1, channels, channels)
                total = np.einsum("sf,scd->fcd", v, cov) + np.sqrt(eps) * np.eye(channels)
                x = (np.asarray(r.xr) + 1j * np.asarray(r.xi)).reshape(len(r.frames), channels)
                z = np.einsum("sf,scd,fd->sfc", v, cov, np.linalg.solve(total, x[:, :, None])[:, :, 0])
                yr.append(z.real.ravel())
                yi.append(z.imag.ravel())
            yield pdf.drop(columns="sums").assign(yr=yr, yi=yi)

    tiles = staged(packed.mapInPandas(stacks, state), "tiles")
    for _ in range(rounds):
        each = tiles.mapInPandas(sums, f"{kinds.rsplit(',', 1)[0]}, stem string, c array<double>")
        added = each.groupBy("track", "bin", "stem").agg(F.array(*[F.sum(F.get("c", F.lit(k))) for k in range(2 * wide + 1)]).alias("c"))
        by_bin = added.groupBy("track", "bin").agg(F.collect_list(F.struct("stem", "c")).alias("sums"))
        after = staged(tiles.join(by_bin, ["track", "bin"]).mapInPandas(solved, state), "tiles")
        discard(tiles)
        tiles = after
    # Places of a stack are numbered stem by stem, frame by frame.
    flat = tiles.select("track", "bin", "scale", "stems", "frames", "yr", "yi", F.posexplode("there").alias("k", "here")).filter("here")
    value = lambda c: F.transform(F.slice(c, F.col("k") * channels + 1, F.lit(channels)), lambda v: v * F.col("scale"))
    stem, frame = F.expr("stems[k div size(frames)]"), F.expr("frames[k % size(frames)]")
    return flat.select("track", stem.cast(targets.schema["stem"].dataType).alias("stem"), frame.cast(targets.schema["frame"].dataType).alias("frame"), "bin", value("yr").alias("re"), value("yi").alias("im"))


def multichannel_em(targets: DataFrame, mix: DataFrame, rounds: int = 1, eps: float = 1e-10) -> DataFrame:
    """``wiener_em`` of two channels in columns: xr, xi, yr, yi are re and im of both."""
    arrays = lambda d: d.withColumns({"re": F.array("xr", "yr"), "im": F.array("xi", "yi")}).drop("xr", "xi", "yr", "yi")
    out = wiener_em(arrays(targets), arrays(mix), 2, rounds, eps)
    return out.select("track", "stem", "frame", "bin", *[F.get(c, F.lit(k)).alias(n) for n, c, k in (("xr", "re", 0), ("xi", "im", 0), ("yr", "re", 1), ("yi", "im", 1))])


def _two(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Spectra of even and odd tracks, the odd ones numbered like the even ones."""
    s = spectra(spark, sf_dir)
    return s.filter("track % 2 = 0"), s.filter("track % 2 = 1").withColumn("track", F.col("track") - 1)


PAIR = SPEC + ", b AS (SELECT x.track, x.channel, x.frame, x.bin, x.re AS xr, x.im AS xi, y.re AS yr, y.im AS yi, sqrt(x.re * x.re + x.im * x.im) AS xm, sqrt(y.re * y.re + y.im * y.im) AS ym FROM spec x JOIN spec y ON y.track = x.track + 1 AND y.channel = x.channel AND y.frame = x.frame AND y.bin = x.bin WHERE x.track % 2 = 0)"
_KEYS = "track, channel, frame, bin"


@query("e1_invert_waveform", f"""WITH {fx.STEREO} SELECT a.track, a.channel, a.pos, round(a.v - b.v, 6) AS v FROM stereo a JOIN (SELECT track - 1 AS track, channel, pos, v FROM stereo WHERE track % 2 = 1 AND channel = 0 AND pos < 60) b USING (track, pos) WHERE a.track % 2 = 0""")
def e1(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = fx.stereo(spark, sf_dir)
    mono = s.filter("track % 2 = 1 AND channel = 0 AND pos < 60").withColumn("track", F.col("track") - 1)
    return invert_waveform(s.filter("track % 2 = 0"), mono).withColumn("v", F.round("v", 6))


@query("e2_invert_spectrogram", f"WITH {PAIR} SELECT {_KEYS}, round(greatest(xm - ym, 0) * xr / xm, 5) + 0.0 AS re, round(greatest(xm - ym, 0) * xi / xm, 5) + 0.0 AS im FROM b")
def e2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _z(invert_spectrogram(*_two(spark, sf_dir)), *BINS)


_RV = "greatest(ym - CASE WHEN sqrt((xr - yr) * (xr - yr) + (xi - yi) * (xi - yi)) > ym THEN 0.2 * sqrt((xr - yr) * (xr - yr) + (xi - yi) * (xi - yi)) ELSE 0 END, 0)"


@query("e3_invert_audio", f"""WITH {PAIR} SELECT 'peak' AS how, {_KEYS}, round(yr - greatest(xm, ym) * xr / xm, 5) + 0.0 AS re, round(yi - greatest(xm, ym) * xi / xm, 5) + 0.0 AS im FROM b
UNION ALL SELECT 'soft', {_KEYS}, round(xr - {_RV} * yr / ym, 5) + 0.0, round(xi - {_RV} * yi / ym, 5) + 0.0 FROM b""")
def e3(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = _two(spark, sf_dir)
    return _z(invert_audio(x, y), *BINS).withColumn("how", F.lit("peak")).unionByName(_z(invert_audio(x, y, False), *BINS).withColumn("how", F.lit("soft")))


@query("e4_reduce_vocal", f"WITH {PAIR} SELECT {_KEYS}, round({_RV} * yr / ym, 5) + 0.0 AS re, round({_RV} * yi / ym, 5) + 0.0 AS im FROM b")
def e4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _z(reduce_vocal(*_two(spark, sf_dir), 0.2), *BINS)


@query("e5_invert_stem", f"""WITH {PAIR}, z AS (SELECT {_KEYS}, -(yr - greatest(xm, ym) * xr / xm) AS re, -(yi - greatest(xm, ym) * xi / xm) AS im FROM b),
t AS (SELECT track, channel, frame, i, sum(CASE WHEN bin IN (0, 8) THEN 1 ELSE 2 END * (re * cos(2 * pi() * bin * i / 16) - im * sin(2 * pi() * bin * i / 16))) / 16 AS x FROM z, (SELECT unnest(range(0, 16)) AS i) GROUP BY ALL),
w AS (SELECT track, channel, CAST(frame * 8 + i AS INTEGER) AS pos, x, 0.5 - 0.5 * cos(2 * pi() * i / 16) AS w FROM t)
SELECT track, channel, pos, CASE WHEN sum(w * w) > 1e-12 THEN round(sum(x * w) / sum(w * w), 5) ELSE 0 END AS v FROM w GROUP BY ALL""")
def e5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stemframe.operators.spectral import CHANNEL, istft

    x, y = _two(spark, sf_dir)
    z = invert_audio(x, y).withColumns({"re": -F.col("re"), "im": -F.col("im")})
    return istft(z, CHANNEL).withColumn("v", F.round("v", 5))


@query("e6_spec_effects", f"""WITH {PAIR} SELECT 'min' AS how, {_KEYS}, round(CASE WHEN ym <= xm THEN yr ELSE xr END, 5) + 0.0 AS re, round(CASE WHEN ym <= xm THEN yi ELSE xi END, 5) + 0.0 AS im FROM b
UNION ALL SELECT 'max', {_KEYS}, round(CASE WHEN ym >= xm THEN yr ELSE xr END, 5) + 0.0, round(CASE WHEN ym >= xm THEN yi ELSE xi END, 5) + 0.0 FROM b
UNION ALL SELECT 'blend', {_KEYS}, round(yr * 0.3 + xr * 0.7, 5) + 0.0, round(yi * 0.3 + xi * 0.7, 5) + 0.0 FROM b""")
def e6(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = _two(spark, sf_dir)
    out = [_z(spec_effects(x, y, how, 0.3), *BINS).withColumn("how", F.lit(how)) for how in ("min", "max", "blend")]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("e7_phantom_center", f"""WITH {SPEC}, q AS (SELECT a.track, a.channel, a.frame, a.bin, a.re, a.im, o.re AS qr, o.im AS qi, sqrt(o.re * o.re + o.im * o.im) AS om, least(sqrt(a.re * a.re + a.im * a.im), sqrt(o.re * o.re + o.im * o.im)) AS m FROM spec a JOIN spec o ON o.track = a.track AND o.frame = a.frame AND o.bin = a.bin AND o.channel = 1 - a.channel)
SELECT {_KEYS}, round(m * qr / om, 5) + 0.0 AS c_re, round(m * qi / om, 5) + 0.0 AS c_im, round(re - 0.99999 * m * qr / om, 5) + 0.0 AS s_re, round(im - 0.99999 * m * qi / om, 5) + 0.0 AS s_im FROM q""")
def e7(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = phantom_center(spectra(spark, sf_dir))
    return out.select("track", F.col("channel").cast("long").alias("channel"), "frame", "bin", *[(F.round(c, 5) + 0.0).alias(c) for c in ("c_re", "c_im", "s_re", "s_im")])


def ratio_mask(x: DataFrame, y: DataFrame) -> DataFrame:
    """A mask from two magnitudes: |y| / (|x| + |y|)."""
    return both_spectra(x, y).select(*BINS, (ym() / (xm() + ym() + 1e-12)).alias("m"))


@query("e8_apply_mask", f"WITH {PAIR}, m AS (SELECT *, ym / (xm + ym + 1e-12) AS m FROM b) SELECT {_KEYS}, round(m * xr, 5) + 0.0 AS y_re, round(m * xi, 5) + 0.0 AS y_im, round((1 - m) * xr, 5) + 0.0 AS v_re, round((1 - m) * xi, 5) + 0.0 AS v_im FROM m")
def e8(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = _two(spark, sf_dir)
    return apply_mask(x, ratio_mask(x, y)).select(*BINS, *[(F.round(c, 5) + 0.0).alias(c) for c in ("y_re", "y_im", "v_re", "v_im")])


@query("e9_adjust_aggressiveness", f"WITH {PAIR}, m AS (SELECT *, ym / (xm + ym + 1e-12) AS m, 0.6 + CASE WHEN channel = 0 THEN 0.1 ELSE 0.2 END AS a FROM b) SELECT {_KEYS}, round(pow(m, CASE WHEN bin < 4 THEN 1 + a / 3 ELSE 1 + a END), 5) AS m FROM m")
def e9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adjust_aggressiveness(ratio_mask(*_two(spark, sf_dir)), 0.3, 4, left=0.1, right=0.2).withColumn("m", F.round("m", 5))


def hourly_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mask from activity: 1 / (1 + value) of every stem and hour."""
    return fx.stems(spark, sf_dir).select("track", "stem", F.col("pos").alias("frame"), (1 / (1 + F.abs("v"))).alias("m"))


@query("e10_merge_artifacts", f"""WITH {fx.STEMS}, k AS (SELECT track, stem, pos AS frame, 1 / (1 + abs(v)) AS m FROM stems), lo AS (SELECT track, frame, min(m) AS lo FROM k GROUP BY ALL),
isl AS (SELECT track, frame, frame - row_number() OVER (PARTITION BY track ORDER BY frame) AS g FROM lo WHERE lo > 0.5), r0 AS (SELECT track, min(frame) AS s, max(frame) AS e FROM isl GROUP BY track, g HAVING max(frame) - min(frame) > 12),
r AS (SELECT track, CASE WHEN s - lag(e) OVER (PARTITION BY track ORDER BY s) < 4 THEN lag(e) OVER (PARTITION BY track ORDER BY s) - 8 ELSE s END AS s, e FROM r0),
w AS (SELECT track, f.frame, arg_max(CASE WHEN e <> 720 AND f.frame >= e - 4 THEN (e - 1 - f.frame) / 3.0 WHEN s <> 0 AND f.frame < s + 4 THEN (f.frame - s) / 3.0 ELSE 1 END, e) AS w FROM r JOIN (SELECT unnest(range(0, 720)) AS frame) f ON f.frame >= greatest(s, 0) AND f.frame < e GROUP BY ALL)
SELECT k.track, k.stem, k.frame, round(m + coalesce(w, 0) * (1 - m), 5) AS m FROM k LEFT JOIN w ON w.track = k.track AND w.frame = k.frame""")
def e10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge_artifacts(hourly_mask(spark, sf_dir), 0.5, 12, 4).select("track", "stem", "frame", F.round("m", 5).alias("m"))


def _targets(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    x, y = _two(spark, sf_dir)
    part = lambda d, n: d.select(F.lit(n).alias("stem"), *BINS, F.hypot("re", "im").alias("mag"))
    b = both_spectra(x, y)
    return part(x, "x").unionByName(part(y, "y")), b.select(*BINS, (F.col("xr") + F.col("yr")).alias("re"), (F.col("xi") + F.col("yi")).alias("im"))


@query("e11_soft_mask", f"""WITH {PAIR} SELECT 'x' AS stem, {_KEYS}, round(xm / (xm + ym + 1e-10) * (xr + yr), 5) + 0.0 AS re, round(xm / (xm + ym + 1e-10) * (xi + yi), 5) + 0.0 AS im FROM b
UNION ALL SELECT 'y', {_KEYS}, round(ym / (xm + ym + 1e-10) * (xr + yr), 5) + 0.0, round(ym / (xm + ym + 1e-10) * (xi + yi), 5) + 0.0 FROM b""")
def e11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _z(soft_mask(*_targets(spark, sf_dir)), "stem", *BINS)


_MP = "xr + yr AS mr, xi + yi AS mi, sqrt((xr + yr) * (xr + yr) + (xi + yi) * (xi + yi)) AS mm"


@query("e12_mix_phase_estimate", f"""WITH {PAIR}, m AS (SELECT *, {_MP} FROM b) SELECT 'x' AS stem, {_KEYS}, round(xm * mr / mm, 5) + 0.0 AS re, round(xm * mi / mm, 5) + 0.0 AS im FROM m
UNION ALL SELECT 'y', {_KEYS}, round(ym * mr / mm, 5) + 0.0, round(ym * mi / mm, 5) + 0.0 FROM m""")
def e12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _z(mix_phase_estimate(*_targets(spark, sf_dir)), "stem", *BINS)


@query("e13_residual_target", f"""WITH {fx.STEMS}, s AS (SELECT * FROM stems WHERE stem <> 'view'), m AS (SELECT track, pos, sum(v) AS m FROM stems GROUP BY ALL)
SELECT track, pos, stem, round(v, 4) AS v FROM s UNION ALL SELECT track, pos, 'residual', round(any_value(m) - sum(v), 4) + 0.0 FROM s JOIN m USING (track, pos) GROUP BY track, pos""")
def e13(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = fx.stems(spark, sf_dir)
    return residual_target(s.filter("stem <> 'view'"), mixdown(s, ["track", "pos"]), ["track", "pos"]).withColumn("v", F.round("v", 4) + 0.0)


@query("e14_multichannel_em")
def e14(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = _two(spark, sf_dir)
    wide = lambda d: spec_left_right(d)
    targets = wide(x).withColumn("stem", F.lit("x")).unionByName(wide(y).withColumn("stem", F.lit("y")))
    mix = targets.groupBy(*FB).agg(*[F.sum(c).alias(c) for c in ("xr", "xi", "yr", "yi")])
    return multichannel_em(targets, mix).select("stem", *FB, *[F.round(c, 5).alias(c) for c in ("xr", "xi", "yr", "yi")])


@query("e15_mixdown", f"WITH {fx.STEMS} SELECT track, pos, round(sum(v), 4) AS v FROM stems GROUP BY ALL")
def e15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixdown(fx.stems(spark, sf_dir), ["track", "pos"]).withColumn("v", F.round("v", 4))


@query("e16_complement_stem", f"WITH {fx.STEMS} SELECT track, pos, round(sum(v) - sum(CASE WHEN stem = 'click' THEN v ELSE 0 END), 4) + 0.0 AS v FROM stems GROUP BY ALL")
def e16(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = fx.stems(spark, sf_dir)
    return complement_stem(mixdown(s, ["track", "pos"]), s.filter("stem = 'click'").drop("stem"), ["track", "pos"]).withColumn("v", F.round("v", 4) + 0.0)


def _minus_plus_sql(cond: str, a: str, b: str) -> str:
    return f"""WITH {fx.STEMS}, s AS (SELECT track, pos, sum(v) - sum(CASE WHEN {cond} THEN v ELSE 0 END) AS mi, sum(CASE WHEN {cond} THEN 0 ELSE v END) AS pl FROM stems GROUP BY ALL), p AS (SELECT *, max(abs(mi)) OVER w AS x, max(abs(pl)) OVER w AS y FROM s WINDOW w AS (PARTITION BY track))
SELECT track, pos, '{a}' AS stem, round(mi, 4) + 0.0 AS v FROM p UNION ALL SELECT track, pos, '{b}', round(CASE WHEN y > 0 THEN pl * x / y ELSE pl END, 4) + 0.0 FROM p"""


@query("e17_inverted_stems", _minus_plus_sql("stem IN ('click', 'view')", "inverted -", "inverted +"))
def e17(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inverted_stems(fx.stems(spark, sf_dir), ["click", "view"]).withColumn("v", F.round("v", 4) + 0.0)


@query("e18_instrumental_stems", _minus_plus_sql("stem = 'click'", "instrumental -", "instrumental +"))
def e18(spark: SparkSession, sf_dir: str) -> DataFrame:
    return instrumental_stems(fx.stems(spark, sf_dir), "click").withColumn("v", F.round("v", 4) + 0.0)


@query("e19_reduce_mix", f"WITH {fx.STEMS} SELECT track, pos, round(sum(v) FILTER (stem = 'view') * (1 - 0.9) + sum(v) FILTER (stem = 'click'), 4) AS v FROM stems WHERE stem IN ('view', 'click') GROUP BY ALL")
def e19(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = fx.stems(spark, sf_dir)
    return reduce_mix(s.filter("stem = 'view'").drop("stem"), s.filter("stem = 'click'").drop("stem")).withColumn("v", F.round("v", 4))


@query("e20_stem_combinations", f"""WITH {fx.STEMS}, n AS (SELECT list_sort(list(DISTINCT stem)) AS names FROM stems WHERE stem <> 'click'), m AS (SELECT names, unnest(range(1, CAST(pow(2, len(names)) AS BIGINT))) AS mask FROM n),
o AS (SELECT list_filter(names, lambda x, i: (mask >> (i - 1)) & 1 = 1) AS on_ FROM m WHERE bit_count(mask) >= 2), c AS (SELECT array_to_string(on_, '+') AS combination, unnest(on_) AS stem FROM o)
SELECT track, combination, pos, round(sum(v), 4) AS v FROM stems JOIN c USING (stem) GROUP BY ALL""")
def e20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stem_combinations(fx.stems(spark, sf_dir), "click").withColumn("v", F.round("v", 4))


@query("e21_derived_stem", f"WITH {fx.STEMS} SELECT track, pos, round(sum(v), 4) AS v FROM stems WHERE stem IN ('error', 'view') GROUP BY ALL")
def e21(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixdown(fx.stems(spark, sf_dir), ["track", "pos"], ["error", "view"]).withColumn("v", F.round("v", 4))


@query("e22_phase_inverted_flag", f"""WITH {fx.STEREO}, m AS (SELECT track, pos, avg(v) AS v FROM stereo GROUP BY ALL) SELECT a.track, round(corr(a.v, b.v), 5) AS corr, corr(a.v, b.v) < 0 AS inverted FROM m a JOIN m b ON b.track = a.track + 1 AND b.pos = a.pos WHERE a.track % 2 = 0 GROUP BY a.track""")
def e22(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = fx.stereo(spark, sf_dir)
    return phase_inverted(s.filter("track % 2 = 0"), s.filter("track % 2 = 1").withColumn("track", F.col("track") - 1)).withColumn("corr", F.round("corr", 5))


@query("e23_best_lag", f"""WITH {fx.SIG}, m AS (SELECT model AS track, pos, v FROM sig), c AS (SELECT a.track, l.lag, sum(a.v * b.v) AS c FROM m a JOIN (SELECT unnest(range(-10, 11)) AS lag) l ON true JOIN m b ON b.track = a.track + 1 AND b.pos + l.lag = a.pos WHERE a.track % 2 = 0 GROUP BY ALL)
SELECT track, CAST(arg_max(lag, (round(c, 9), -lag)) AS INTEGER) AS lag FROM c GROUP BY track""")
def e23(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = fx.sig(spark, sf_dir).select(F.col("model").alias("track"), "pos", "v")
    return best_lag(m.filter("track % 2 = 0"), m.filter("track % 2 = 1").withColumn("track", F.col("track") - 1), 10)


def _delayed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A mixture, and one of its parts three samples early."""
    m = fx.sig(spark, sf_dir).select(F.col("model").alias("track"), "pos", "v")
    a, b = m.filter("track % 2 = 0"), m.filter("track % 2 = 1").withColumn("track", F.col("track") - 1)
    mix = a.join(b.select("track", "pos", F.col("v").alias("w")), ["track", "pos"]).select("track", "pos", (0.1 * F.col("v") + F.col("w")).alias("v"))
    return mix, b.withColumn("pos", F.col("pos") - 3).filter("pos >= 0")


@query("e24_align_track")
def e24(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = align_track(*_delayed(spark, sf_dir), [0, 16], 40, 8, [-3.0, 0.0, 3.0])
    return out.select("track", "lag", "db", F.round("level", 6).alias("level"), "pos", F.round("v", 6).alias("v"))


@query("e25_local_time_correction")
def e25(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix, part = _delayed(spark, sf_dir)
    return local_time_correction(mix, part, 16, [0.7, 1.0, 1.4], 4).withColumn("v", F.round("v", 6))


_SIL = """q AS (SELECT track, CAST(CASE WHEN stem = 'click' THEN 0 ELSE 1 END AS BIGINT) AS channel, CAST(pos AS BIGINT) AS pos, CASE WHEN pos < 20 + track % 7 * 9 THEN 0 ELSE v END AS v FROM stems WHERE stem IN ('click', 'view')),
lv AS (SELECT track, channel, floor(pos / 8) AS f, max(abs(v)) AS p, sum(v * v) AS e, max(pos) AS last FROM q GROUP BY ALL), pr AS (SELECT track, channel, min(CASE WHEN p > 1 THEN f * 8 END) AS st, sum(e) AS e, max(last) + 1 AS n FROM lv GROUP BY ALL),
si AS (SELECT track, CAST(arg_max(coalesce(st, n), (round(e, 9), -channel)) AS BIGINT) AS silence FROM pr GROUP BY track)"""


def _gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = fx.stems(spark, sf_dir).filter("stem IN ('click', 'view')").select("track", F.when(F.col("stem") == "click", 0).otherwise(1).cast("long").alias("channel"), F.col("pos").cast("long").alias("pos"), "v")
    return s.withColumn("v", F.when(F.col("pos") < 20 + F.col("track") % 7 * 9, 0.0).otherwise(F.col("v")))


@query("e26_leading_silence", f"WITH {fx.STEMS}, {_SIL} SELECT track, silence FROM si")
def e26(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leading_silence(_gated(spark, sf_dir), 1.0, 8).withColumn("silence", F.col("silence").cast("long"))


@query("e27_match_leading_silence", f"""WITH {fx.STEMS}, {_SIL}, d AS (SELECT a.track, r.silence - a.silence AS d FROM si a JOIN si r ON r.track = a.track // 2 * 2), m AS (SELECT track, channel, pos + d AS pos, v FROM q JOIN d USING (track) WHERE pos + d >= 0)
SELECT track, channel, pos, round(v, 4) AS v FROM m UNION ALL SELECT c.track, c.channel, z.pos, 0 FROM (SELECT DISTINCT track, channel, d FROM q JOIN d USING (track) WHERE d > 0) c JOIN (SELECT unnest(range(0, 720)) AS pos) z ON z.pos < c.d""".replace("a.track // 2 * 2", "CAST(floor(a.track / 2) * 2 AS BIGINT)"))
def e27(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _gated(spark, sf_dir)
    even = g.filter("track % 2 = 0")
    reference = even.unionByName(even.withColumn("track", F.col("track") + 1))
    return match_leading_silence(reference, g, 1.0, 8).withColumn("v", F.round("v", 4))
