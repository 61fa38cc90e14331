"""Level control: element-wise projections, and gains that depend on a peak or a moment of the signal.

Signals are in long form (keys, ``pos``, ``v``). Peaks and moments are partition aggregates, so each
operator costs one exchange by its key and nothing for the samples' order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stemframe import fixtures as fx
from stemframe.functions.exprs import clip, peak, seeded, seeded_sql
from stemframe.registry import query

SCALED = "round({}, 6) AS v"


def _rounded(df: DataFrame, *keys: str, digits: int = 6) -> DataFrame:
    return df.select(*keys, F.round("v", digits).alias("v"))


def normalize_range(df: DataFrame, keys: list[str], max_peak: float = 1.0, min_peak: float | None = None) -> DataFrame:
    """Scale down to ``max_peak`` above it, up to ``min_peak`` below that; else unchanged."""
    p = peak(*keys)
    gain = F.when(p > max_peak, max_peak / p)
    if min_peak is not None:
        gain = gain.when((p < min_peak) & (p > 0), min_peak / p)
    return df.withColumn("v", F.col("v") * gain.otherwise(1.0))


def normalize_peak(df: DataFrame, keys: list[str], level: float) -> DataFrame:
    """Scale so that the peak is ``level``; silence stays silence."""
    p = peak(*keys)
    return df.withColumn("v", F.when(p > 0, F.col("v") * (level / p)).otherwise(F.col("v")))


def limit_peak_joint(df: DataFrame, keys: list[str], limit: float = 1.0) -> DataFrame:
    """Divide all channels by their joint peak where that is above ``limit``."""
    p = peak(*keys)
    return df.withColumn("v", F.when(p > limit, F.col("v") / p).otherwise(F.col("v")))


def fix_clipping(df: DataFrame, margin: float = 0.0, seed: str = "clip") -> DataFrame:
    """All stems of a track times 1 / (peak + U margin) where their joint peak is above 1."""
    p = peak("track")
    room = p + seeded(seed, "track") * margin if margin else p
    return df.withColumn("v", F.when(p > 1, F.col("v") / room).otherwise(F.col("v")))


def drop_silent_stems(df: DataFrame, least: float = 1e-6) -> DataFrame:
    """Only the stems of a track whose peak reaches ``least``; a track of silence loses all of them."""
    loud = df.groupBy("track", "stem").agg(F.max(F.abs("v")).alias("p")).filter(F.col("p") >= least)
    return df.join(loud.select("track", "stem"), ["track", "stem"], "left_semi")


def moments(df: DataFrame, sample: bool = False) -> DataFrame:
    """Mean and standard deviation by track of the channels' mean signal."""
    mono = df.groupBy("track", "pos").agg(F.avg("v").alias("m"))
    return mono.groupBy("track").agg(F.avg("m").alias("mean"), (F.stddev_samp if sample else F.stddev_pop)("m").alias("std"))


def standardize(df: DataFrame, sample: bool = False) -> DataFrame:
    """Z-scores by the moments of the mono signal; keeps ``mean`` and ``std`` for the way back."""
    return df.join(moments(df, sample), "track").withColumn("v", (F.col("v") - F.col("mean")) / F.col("std"))


def unstandardize(df: DataFrame) -> DataFrame:
    return df.withColumn("v", F.col("v") * F.col("std") + F.col("mean")).drop("mean", "std")


def to_stereo(df: DataFrame) -> DataFrame:
    """Mono tracks get their channel twice, tracks of more than two channels keep the first two."""
    df = df.withColumn("top", F.max("channel").over(Window.partitionBy("track")))
    channels = F.when(F.col("top") == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.col("channel").cast("int")))
    return df.withColumn("channel", F.explode(channels)).drop("top").filter("channel < 2")


def to_mono(df: DataFrame) -> DataFrame:
    return df.groupBy("track", "pos").agg(F.avg("v").alias("v"))


def left_right(df: DataFrame, *keys: str) -> DataFrame:
    """Channels side by side: keys, l, r."""
    side = lambda n: F.max(F.when(F.col("channel") == n, F.col("v")))
    return df.groupBy(*keys).agg(side(0).alias("l"), side(1).alias("r"))


# Coefficients of the channel transforms, (l, r) of the left and of the right output.
FORWARD = {
    "mid_side_c": ((1, 0.25), (-0.25, 1)),
    "mid_side": ((0.5, 0.5), (1, -1)),
    "stereo_n": ((1 / 0.9375, 0.25 / 0.9375), (0.25 / 0.9375, 1 / 0.9375)),
    "mid_side_b2": ((0.5, 1), (1, -0.5)),
}
INVERSE = {
    "mid_side_c": ((1 / 1.0625, -1 / 4.25), (1 / 4.25, 1 / 1.0625)),
    "mid_side": ((1, 0.5), (1, -0.5)),
    "stereo_n": ((1, -0.25), (-0.25, 1)),
    "mid_side_b2": ((0.4, 1 / 1.25), (1 / 1.25, -0.4)),
}


def convert_channels(df: DataFrame, mode: str, inverse: bool = False, keys: tuple = ("track", "pos")) -> DataFrame:
    """Linear channel transform: keys, l, r."""
    (a, b), (x, y) = (INVERSE if inverse else FORWARD)[mode]
    both = df if "l" in df.columns else left_right(df, *keys)
    return both.select(*keys, (F.col("l") * a + F.col("r") * b).alias("l"), (F.col("l") * x + F.col("r") * y).alias("r"))


def reverse_time(df: DataFrame, keys: list[str]) -> DataFrame:
    """The signal backwards."""
    return df.withColumn("pos", F.max("pos").over(Window.partitionBy(*keys)) - F.col("pos"))


def gain_db(df: DataFrame, db: float) -> DataFrame:
    return df.withColumn("v", F.col("v") * F.pow(F.lit(10.0), F.lit(db / 20)))


def clip_signal(df: DataFrame, limit: float = 1.0) -> DataFrame:
    return df.withColumn("v", clip("v", -limit, limit))


def lengths(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg((F.max("pos") + 1).alias("n"))


def match_length(df: DataFrame, keys: list[str], rule: str, group: list[str]) -> DataFrame:
    """Signals of a ``group`` trimmed to its shortest or zero-padded to its longest (rule: shortest, longest).

    Padding adds rows for the missing tail only; it is not made by a grid of all positions.
    """
    n = lengths(df, keys)
    if rule == "shortest":
        # The target is the group's, so samples that lie by group stay there.
        target = n.dropna(subset=keys).groupBy(*group).agg(F.min("n").alias("target"))
        return df.dropna(subset=keys).join(target, group).filter("pos < target").drop("target")
    n = n.withColumn("target", F.max("n").over(Window.partitionBy(*group)))
    tail = n.filter("n < target").select(*keys, F.explode(F.sequence(F.col("n"), F.col("target") - 1)).alias("pos"), F.lit(0.0).alias("v"))
    return df.select(*keys, "pos", "v").unionByName(tail.withColumn("pos", F.col("pos").cast(df.schema["pos"].dataType)))


def center_trim(df: DataFrame, keys: list[str], length: int) -> DataFrame:
    """The middle ``length`` samples: (n - length) // 2 are dropped at the head, the rest at the tail."""
    n = F.max("pos").over(Window.partitionBy(*keys)) + 1
    head = F.floor((n - length) / 2).cast("int")
    return df.withColumn("head", F.greatest(head, F.lit(0))).filter((F.col("pos") >= F.col("head")) & (F.col("pos") < F.col("head") + length)).withColumn("pos", F.col("pos") - F.col("head")).drop("head")


def overlay(stereo: DataFrame, mono: DataFrame, gain: float = 0.5) -> DataFrame:
    """stereo + gain mono at equal positions (so trimmed to the shorter), scaled by the joint peak to 16-bit integers."""
    both = stereo.join(mono.select("track", "pos", F.col("v").alias("m")), ["track", "pos"])
    both = both.withColumn("v", F.col("v") + gain * F.col("m"))
    p = peak("track")
    return both.select("track", "channel", "pos", (F.when(p > 0, F.col("v") / p).otherwise(0.0) * 32767).cast("int").alias("v"))


def compress(x, scale: float = 1.0, floor: float = 1e-5):
    return F.log(F.greatest(x, F.lit(floor)) * scale)


def decompress(x, scale: float = 1.0):
    return F.exp(x) / scale


def pcm_encode(df: DataFrame) -> DataFrame:
    """Floats in [-1, 1] to 16-bit integers: clipped, times 32767, towards zero."""
    return df.withColumn("v", (clip("v") * 32767).cast("smallint"))


def pcm_decode(df: DataFrame) -> DataFrame:
    return df.withColumn("v", F.col("v").cast("double") / 32767)


def peak_to_int16(df: DataFrame, keys: list[str]) -> DataFrame:
    """Divide by max(1, peak / 0.99), times 32768, towards zero, within 16 bits."""
    room = F.greatest(F.lit(1.0), peak(*keys) / 0.99)
    return df.withColumn("v", F.least(F.greatest(F.col("v") / room * 32768, F.lit(-32768)), F.lit(32767)).cast("smallint"))


@query("b1_normalize_range", f"""WITH {fx.STEREO}, p AS (SELECT *, max(abs(v)) OVER (PARTITION BY track) AS p FROM stereo)
SELECT track, channel, pos, round(v * CASE WHEN p > 0.45 THEN 0.45 / p WHEN p < 0.4 AND p > 0 THEN 0.4 / p ELSE 1 END, 6) AS v FROM p""")
def b1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(normalize_range(fx.stereo(spark, sf_dir), ["track"], 0.45, 0.4), "track", "channel", "pos")


@query("b2_normalize_peak", f"""WITH {fx.SIG}, p AS (SELECT *, max(abs(v)) OVER (PARTITION BY track, model) AS p FROM sig)
SELECT track, model, pos, round(CASE WHEN p > 0 THEN v * (0.8 / p) ELSE v END, 6) AS v FROM p""")
def b2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(normalize_peak(fx.sig(spark, sf_dir), ["track", "model"], 0.8), "track", "model", "pos")


@query("b3_normalize_per_channel", f"""WITH {fx.STEREO}, p AS (SELECT *, max(abs(v)) OVER (PARTITION BY track, channel) AS p FROM stereo)
SELECT track, channel, pos, round(CASE WHEN p > 0 THEN v * (0.9 / p) ELSE v END, 6) AS v FROM p""")
def b3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(normalize_peak(fx.stereo(spark, sf_dir), ["track", "channel"], 0.9), "track", "channel", "pos")


@query("b4_limit_peak_joint", f"""WITH {fx.STEREO}, g AS (SELECT track, channel, pos, v * 3 AS v FROM stereo), p AS (SELECT *, max(abs(v)) OVER (PARTITION BY track) AS p FROM g)
SELECT track, channel, pos, round(CASE WHEN p > 1 THEN v / p ELSE v END, 6) AS v FROM p""")
def b4(spark: SparkSession, sf_dir: str) -> DataFrame:
    loud = fx.stereo(spark, sf_dir).withColumn("v", F.col("v") * 3)
    return _rounded(limit_peak_joint(loud, ["track"]), "track", "channel", "pos")


@query("b5_fix_clipping", f"""WITH {fx.STEMS}, p AS (SELECT *, max(abs(v)) OVER (PARTITION BY track) AS p FROM stems)
SELECT track, stem, pos, round(CASE WHEN p > 1 THEN v / (p + {seeded_sql("clip", "track")} * 0.1) ELSE v END, 6) AS v FROM p""")
def b5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(fix_clipping(fx.stems(spark, sf_dir), 0.1), "track", "stem", "pos")


@query("b6_drop_silent_stems", f"""WITH {fx.STEMS}, q AS (SELECT track, stem, pos, CASE WHEN v > 100 THEN v ELSE 0 END AS v FROM stems)
SELECT track, stem, pos, round(v, 4) AS v FROM q WHERE (track, stem) IN (SELECT (track, stem) FROM q GROUP BY track, stem HAVING max(abs(v)) >= 1e-6)""")
def b6(spark: SparkSession, sf_dir: str) -> DataFrame:
    gated = fx.stems(spark, sf_dir).withColumn("v", F.when(F.col("v") > 100, F.col("v")).otherwise(0.0))
    return _rounded(drop_silent_stems(gated), "track", "stem", "pos", digits=4)


@query("b7_standardize", f"""WITH {fx.STEREO}, m AS (SELECT track, pos, avg(v) AS m FROM stereo GROUP BY ALL),
s AS (SELECT track, avg(m) AS mean, stddev_pop(m) AS sp, stddev_samp(m) AS ss FROM m GROUP BY track)
SELECT track, channel, pos, round((v - mean) / sp, 6) AS v_pop, round((v - mean) / ss, 6) AS v_samp, round(v, 6) AS back FROM stereo JOIN s USING (track)""")
def b7(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = fx.stereo(spark, sf_dir)
    z, back = standardize(df), unstandardize(standardize(df, sample=True))
    out = z.select("track", "channel", "pos", F.round("v", 6).alias("v_pop"))
    zs = standardize(df, sample=True).select("track", "channel", "pos", F.round("v", 6).alias("v_samp"))
    return out.join(zs, ["track", "channel", "pos"]).join(back.select("track", "channel", "pos", F.round("v", 6).alias("back")), ["track", "channel", "pos"])


@query("b8_to_stereo", f"""WITH {fx.SIG}, q AS (SELECT model // 6 * 3 + CASE WHEN model % 6 = 0 THEN 0 WHEN model % 6 < 3 THEN 1 ELSE 2 END AS track,
  CASE WHEN model % 6 = 0 THEN 0 WHEN model % 6 < 3 THEN model % 6 - 1 ELSE model % 6 - 3 END AS channel, pos, v FROM sig),
n AS (SELECT *, max(channel) OVER (PARTITION BY track) AS top FROM q)
SELECT track, pos, channel, round(v, 6) AS v FROM (SELECT track, pos, v, unnest(CASE WHEN top = 0 THEN [0, 1] ELSE [CAST(channel AS INTEGER)] END) AS channel FROM n) WHERE channel < 2""")
def b8(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Six models in a row are a track of one channel, one of two and one of three.
    part = F.col("model") % 6
    kind = F.when(part == 0, 0).when(part < 3, 1).otherwise(2)
    channel = F.when(part == 0, part).when(part < 3, part - 1).otherwise(part - 3)
    df = fx.sig(spark, sf_dir).select((F.floor(F.col("model") / 6) * 3 + kind).cast("long").alias("track"), channel.alias("channel"), "pos", "v")
    return _rounded(to_stereo(df), "track", "pos", "channel")


@query("b9_to_mono", f"WITH {fx.STEREO} SELECT track, pos, round(avg(v), 6) AS v FROM stereo GROUP BY track, pos")
def b9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(to_mono(fx.stereo(spark, sf_dir)), "track", "pos")


def _convert_sql() -> str:
    parts = []
    for mode, ((a, b), (x, y)) in FORWARD.items():
        (i, j), (p, q) = INVERSE[mode]
        left, right = f"(l * {a!r} + r * {b!r})", f"(l * {x!r} + r * {y!r})"
        parts.append(f"SELECT '{mode}' AS mode, track, pos, round({left}, 6) AS l, round({right}, 6) AS r, round({left} * {i!r} + {right} * {j!r}, 6) AS back_l, round({left} * {p!r} + {right} * {q!r}, 6) AS back_r FROM lr")
    return f"WITH {fx.STEREO}, lr AS (SELECT track, pos, max(CASE WHEN channel = 0 THEN v END) AS l, max(CASE WHEN channel = 1 THEN v END) AS r FROM stereo GROUP BY track, pos) " + " UNION ALL ".join(parts)


@query("b10_convert_channels", _convert_sql())
def b10(spark: SparkSession, sf_dir: str) -> DataFrame:
    both, out = left_right(fx.stereo(spark, sf_dir), "track", "pos"), None
    for mode in FORWARD:
        there = convert_channels(both, mode)
        back = convert_channels(there, mode, inverse=True).select("track", "pos", F.round("l", 6).alias("back_l"), F.round("r", 6).alias("back_r"))
        one = there.select(F.lit(mode).alias("mode"), "track", "pos", F.round("l", 6).alias("l"), F.round("r", 6).alias("r")).join(back, ["track", "pos"])
        out = one if out is None else out.unionByName(one)
    return out


@query("b11_gain_db", f"WITH {fx.SIG} SELECT track, model, pos, round(v * pow(10, -6 / 20.0), 6) AS v FROM sig")
def b11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(gain_db(fx.sig(spark, sf_dir), -6), "track", "model", "pos")


@query("b12_clip_signal", f"WITH {fx.SIG} SELECT track, model, pos, round(greatest(-1, least(1, v * 8)), 6) AS v FROM sig")
def b12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(clip_signal(fx.sig(spark, sf_dir).withColumn("v", F.col("v") * 8)), "track", "model", "pos")


_UNEVEN = "q AS (SELECT track, stem, pos, v FROM stems WHERE pos < 700 - 10 * length(stem))"


@query("b13_match_length", f"""WITH {fx.STEMS}, {_UNEVEN}, n AS (SELECT track, stem, max(pos) + 1 AS n FROM q GROUP BY ALL), t AS (SELECT *, max(n) OVER (PARTITION BY track) AS hi, min(n) OVER (PARTITION BY track) AS lo FROM n)
SELECT 'longest' AS rule, track, stem, CAST(g.pos AS INTEGER) AS pos, round(coalesce(v, 0), 4) AS v FROM t JOIN (SELECT unnest(range(0, 720)) AS pos) g ON g.pos < hi LEFT JOIN q USING (track, stem, pos)
UNION ALL SELECT 'shortest', track, stem, pos, round(v, 4) FROM q JOIN t USING (track, stem) WHERE pos < lo""")
def b13(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = fx.stems(spark, sf_dir).filter(F.col("pos") < 700 - 10 * F.length("stem"))
    both = [match_length(df, ["track", "stem"], rule, ["track"]).select(F.lit(rule).alias("rule"), "track", "stem", "pos", F.round("v", 4).alias("v")) for rule in ("longest", "shortest")]
    return both[0].unionByName(both[1])


@query("b14_center_trim", f"WITH {fx.STEMS} SELECT track, stem, pos - 110 AS pos, round(v, 4) AS v FROM stems WHERE pos >= 110 AND pos < 610")
def b14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(center_trim(fx.stems(spark, sf_dir), ["track", "stem"], 500), "track", "stem", "pos", digits=4)


@query("b16_overlay", f"""WITH {fx.STEREO}, o AS (SELECT s.track, s.channel, s.pos, s.v + 0.5 * m.v AS v FROM stereo s JOIN sig m ON m.model = s.track AND m.pos = s.pos), p AS (SELECT *, max(abs(v)) OVER (PARTITION BY track) AS p FROM o)
SELECT track, channel, pos, CAST(trunc(CASE WHEN p > 0 THEN v / p ELSE 0 END * 32767) AS INTEGER) AS v FROM p""")
def b16(spark: SparkSession, sf_dir: str) -> DataFrame:
    mono = fx.sig(spark, sf_dir).select(F.col("model").alias("track"), "pos", "v")
    return overlay(fx.stereo(spark, sf_dir), mono)


@query("b17_dynamic_range", f"WITH {fx.EVT} SELECT track, stem, pos, round(ln(greatest(v, 1e-5) * 2), 4) AS z, round(exp(ln(greatest(v, 1e-5) * 2)) / 2, 4) AS back FROM evt")
def b17(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = compress(F.col("v"), 2)
    return fx.evt(spark, sf_dir).select("track", "stem", "pos", F.round(z, 4).alias("z"), F.round(decompress(z, 2), 4).alias("back"))


@query("a8_pcm_encode", f"WITH {fx.SIG} SELECT track, model, pos, CAST(trunc(greatest(-1, least(1, v * 4)) * 32767) AS SMALLINT) AS v FROM sig")
def a8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pcm_encode(fx.sig(spark, sf_dir).withColumn("v", F.col("v") * 4)).select("track", "model", "pos", "v")


@query("a9_peak_to_int16", f"""WITH {fx.SIG}, p AS (SELECT track, model, pos, v * 3 AS v, max(abs(v * 3)) OVER (PARTITION BY track, model) AS p FROM sig)
SELECT track, model, pos, CAST(trunc(least(greatest(v / greatest(1, p / 0.99) * 32768, -32768), 32767)) AS SMALLINT) AS v FROM p""")
def a9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return peak_to_int16(fx.sig(spark, sf_dir).withColumn("v", F.col("v") * 3), ["track", "model"]).select("track", "model", "pos", "v")
