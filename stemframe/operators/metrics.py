"""Quality of estimates against references: sums over the joined samples, then algebra on the sums.

``joined`` frames have the keys, the reference ``r`` and the estimate ``e``. Every metric is a function
from these columns to one aggregate, so any set of metrics costs one grouping.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stemframe import fixtures as fx
from stemframe.functions.exprs import decibel
from stemframe.registry import query

EPS = 1e-8


def _r() -> Column:
    return F.col("r")


def _d() -> Column:
    """The error."""
    return F.col("r") - F.col("e")


def sdr() -> Column:
    return decibel((F.sum(_r() * _r()) + EPS) / (F.sum(_d() * _d()) + EPS))


def si_sdr() -> Column:
    """Scale-invariant; the square of a r - e is expanded, so that one pass is enough. eps counts once a sample."""
    rr, re, ee, n = F.sum(_r() * _r()), F.sum(_r() * F.col("e")), F.sum(F.col("e") * F.col("e")), F.count(F.lit(1))
    a = (re + n * EPS) / (rr + n * EPS)
    return decibel(a * a * rr / (F.greatest(a * a * rr - 2 * a * re + ee, F.lit(0.0)) + EPS) + EPS)


def l1() -> Column:
    return F.avg(F.abs(_d()))


def mse() -> Column:
    return F.avg(_d() * _d())


def log_wmse() -> Column:
    """-4 ln of the mean squared error once both signals are scaled by the mixture's level (column m); 1e-5 is silence.

    The error is taken as it is; ``weighted_log_wmse`` filters first.
    """
    return -4 * F.log(F.avg(_d() * _d()) / (F.avg(F.col("m") * F.col("m")) + EPS) + 1e-5)


def weighted_log_wmse(joined: DataFrame, keys: list[str], rate: float, response: list[float] | None = None, block: int | None = None) -> DataFrame:
    """keys and log_wmse of error and mixture (columns pos, r, e, m) as they are heard: both pass a filter first.

    ``response`` is the impulse response of the filter, K-weighting at ``rate`` if not given; the filter is linear, so the error
    alone is filtered. Signals are convolved as block rows, of which sums leave a task.
    """
    from stemframe.operators.blocks import convolved, part_size, to_blocks
    from stemframe.operators.filters import impulse_response, k_weighting

    h = impulse_response(k_weighting(rate)) if response is None else np.asarray(response, float)
    block = block or part_size(h.size)
    total = None
    for name, value in (("d", _d()), ("m", F.col("m"))):
        rows = to_blocks(joined.select(*keys, "pos", value.alias("v")), keys, block=block)
        power = F.aggregate("v", F.lit(0.0), lambda t, x: t + x * x)
        sums = convolved(rows, keys, h, block=block).groupBy(*keys).agg(F.sum(power).alias(name), F.sum(F.size("v")).alias("n"))
        total = sums if total is None else total.join(sums.drop("n"), keys)
    return total.select(*keys, (-4 * F.log(F.col("d") / F.col("n") / (F.col("m") / F.col("n") + EPS) + 1e-5)).alias("log_wmse"))


#: Metrics by name; ``register_score`` adds to them.
SCORES: dict[str, Callable[[], Column]] = {"sdr": sdr, "si_sdr": si_sdr, "l1": l1, "mse": mse, "log_wmse": log_wmse}


def register_score(name: str, build: Callable[[], Column]) -> None:
    """Make ``name`` known to ``score``: ``build`` gives an aggregate of the columns r and e."""
    SCORES[name] = build


#: Metrics of spectra, and their options: of ``bands.spectral_scores``.
SPECTRAL = frozenset({"l1_freq", "aura_stft", "aura_mrstft", "bleedless", "fullness"})
OPTIONS = {"size": 2048, "hop": 512, "n_mels": 512, "rate": 44100, "sizes": (1024, 2048, 4096), "mr_mels": 128}


def score(joined: DataFrame, keys: list[str], metrics: list[str], **options) -> DataFrame:
    """The requested metrics by key: those of samples in one grouping, those of spectra in one pass over block rows.

    What is not requested is not computed. Metrics of spectra need the column pos; ``options`` are those of OPTIONS.
    """
    from stemframe.operators.bands import spectral_scores
    from stemframe.operators.blocks import to_blocks

    unknown = [m for m in metrics if m not in SCORES and m not in SPECTRAL]
    if unknown:
        raise ValueError(f"unknown metrics: {', '.join(unknown)}")
    plain, spectral = [m for m in metrics if m in SCORES], [m for m in metrics if m in SPECTRAL]
    out = joined.groupBy(*keys).agg(*[SCORES[m]().alias(m) for m in plain]) if plain else None
    if spectral:
        found = spectral_scores(to_blocks(joined, keys, ("r", "e")), keys, spectral, OPTIONS | options)
        out = found if out is None else out.join(found, keys, "left")
    return out.select(*keys, *metrics)


def against_median(df: DataFrame) -> DataFrame:
    """Estimates joined with the per-sample median of all estimates of their track."""
    ref = df.groupBy("track", "pos").agg(F.median("v").alias("r"))
    return df.join(ref, ["track", "pos"]).withColumnRenamed("v", "e")


REF = f"{fx.SIG}, ref AS (SELECT track, pos, median(v) AS r FROM sig GROUP BY ALL), j AS (SELECT track, model, pos, r, v AS e FROM sig JOIN ref USING (track, pos))"
_SDR = "10 * log10((sum(r * r) + 1e-8) / (sum((r - e) * (r - e)) + 1e-8))"
_SISDR = "10 * log10(a * a * rr / (greatest(a * a * rr - 2 * a * re + ee, 0) + 1e-8) + 1e-8)"
_SUMS = "s AS (SELECT track, model, sum(r * r) AS rr, sum(r * e) AS re, sum(e * e) AS ee, count(*) AS n, (sum(r * e) + count(*) * 1e-8) / (sum(r * r) + count(*) * 1e-8) AS a FROM j GROUP BY ALL)"


@query("i1_sdr", f"WITH {REF} SELECT track, model, round({_SDR}, 4) AS sdr FROM j GROUP BY ALL")
def i1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(against_median(fx.sig(spark, sf_dir)), ["track", "model"], ["sdr"]).withColumn("sdr", F.round("sdr", 4))


@query("i2_si_sdr", f"WITH {REF}, {_SUMS} SELECT track, model, round({_SISDR}, 4) AS si_sdr FROM s")
def i2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(against_median(fx.sig(spark, sf_dir)), ["track", "model"], ["si_sdr"]).withColumn("si_sdr", F.round("si_sdr", 4))


@query("i6_log_wmse", f"WITH {REF}, x AS (SELECT track, pos, sum(e) AS m FROM j GROUP BY ALL) SELECT track, model, round(-4 * ln(avg((r - e) * (r - e)) / (avg(m * m) + 1e-8) + 1e-5), 4) AS log_wmse FROM j JOIN x USING (track, pos) GROUP BY ALL")
def i6(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = against_median(fx.sig(spark, sf_dir))
    mixture = j.groupBy("track", "pos").agg(F.sum("e").alias("m"))
    return score(j.join(mixture, ["track", "pos"]), ["track", "model"], ["log_wmse"]).withColumn("log_wmse", F.round("log_wmse", 4))


_SPECTRA = """fr AS (SELECT track, model, frame, pos - frame * 8 AS i, r * pow(sin(pi() * (pos - frame * 8) / 16), 2) AS x, e * pow(sin(pi() * (pos - frame * 8) / 16), 2) AS y FROM j JOIN (SELECT unnest(range(0, 7)) AS frame) f ON pos >= frame * 8 AND pos < frame * 8 + 16),
sp AS (SELECT track, model, frame, bin, greatest(sqrt(pow(sum(x * cos(2 * pi() * bin * i / 16)), 2) + pow(sum(x * sin(2 * pi() * bin * i / 16)), 2)), 1e-8) AS xm, greatest(sqrt(pow(sum(y * cos(2 * pi() * bin * i / 16)), 2) + pow(sum(y * sin(2 * pi() * bin * i / 16)), 2)), 1e-8) AS ym FROM fr CROSS JOIN (SELECT unnest(range(0, 9)) AS bin) GROUP BY ALL),
z AS (SELECT track, model, 100 / (1 + 10 * avg(abs(xm - ym))) AS l1_freq, 100 / (1 + 10 * (sqrt(sum((xm - ym) * (xm - ym))) / sqrt(sum(xm * xm)) + avg(abs(ln(xm) - ln(ym))))) AS aura_stft FROM sp GROUP BY ALL)"""


@query("i8_score", f"""WITH {REF}, {_SUMS}, {_SPECTRA}, b AS (SELECT track, model, {_SDR} AS sdr, avg(abs(r - e)) AS l1 FROM j GROUP BY ALL)
SELECT track, model, round(sdr, 4) AS sdr, round({_SISDR}, 4) AS si_sdr, round(l1, 6) AS l1, round(l1_freq, 4) AS l1_freq, round(aura_stft, 4) AS aura_stft FROM b JOIN s USING (track, model) JOIN z USING (track, model)""")
def i8(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = score(against_median(fx.sig(spark, sf_dir)), ["track", "model"], ["sdr", "si_sdr", "l1", "l1_freq", "aura_stft"], size=16, hop=8)
    return out.select("track", "model", *[F.round(m, 6 if m == "l1" else 4).alias(m) for m in ("sdr", "si_sdr", "l1", "l1_freq", "aura_stft")])


@query("i6_weighted_log_wmse", f"""WITH {REF}, x AS (SELECT track, pos, sum(e) AS m FROM j GROUP BY ALL), h(k, h) AS (VALUES (0, 1.0), (1, -0.95), (4, 0.25)),
f AS (SELECT track, model, pos + k AS pos, sum((r - e) * h) AS d, sum(m * h) AS m FROM j JOIN x USING (track, pos) CROSS JOIN h WHERE pos + k < 64 GROUP BY track, model, pos + k)
SELECT track, model, round(-4 * ln(avg(d * d) / (avg(m * m) + 1e-8) + 1e-5), 4) AS log_wmse FROM f GROUP BY ALL""")
def i6_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = against_median(fx.sig(spark, sf_dir))
    mixture = j.groupBy("track", "pos").agg(F.sum("e").alias("m"))
    out = weighted_log_wmse(j.join(mixture, ["track", "pos"]), ["track", "model"], 44100, [1.0, -0.95, 0, 0, 0.25])
    return out.withColumn("log_wmse", F.round("log_wmse", 4))


def chunk_median(joined: DataFrame, keys: list[str], size: int, metrics: list[str]) -> DataFrame:
    """Metrics by whole chunks of ``size`` samples, then their lower median; partial and non-finite chunks are skipped."""
    chunked = joined.withColumn("chunk", F.floor(F.col("pos") / size))
    found = chunked.groupBy(*keys, "chunk").agg(F.count(F.lit(1)).alias("n"), *[SCORES[m]().alias(m) for m in metrics]).filter(F.col("n") == size)
    finite = lambda m: F.when(~F.isnan(m) & (F.abs(m) < F.lit(float("inf"))), F.col(m))
    return found.select(*keys, *[finite(m).alias(m) for m in metrics]).groupBy(*keys).agg(*[F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {m})").alias(m) for m in metrics])


@query("i9_chunk_median_ratio", f"""WITH {REF}, c AS (SELECT track, model, pos // 12 AS chunk, count(*) AS n, {_SDR} AS sdr FROM j GROUP BY ALL)
SELECT track, model, round(quantile_disc(sdr, 0.5), 4) AS sdr FROM c WHERE n = 12 GROUP BY ALL""")
def i9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_median(against_median(fx.sig(spark, sf_dir)), ["track", "model"], 12, ["sdr"]).withColumn("sdr", F.round("sdr", 4))


def score_report(scores: DataFrame) -> DataFrame:
    """Means by (track, metric) and by metric over all tracks in one pass (rollup); NaN where nothing was scored."""
    return scores.rollup("metric", "track").agg(F.coalesce(F.avg("value"), F.lit(float("nan"))).alias("value")).filter("metric IS NOT NULL")


def aliased_references(wanted: DataFrame, references: DataFrame, groups: list[list[str]]) -> DataFrame:
    """For each wanted (track, stem) the reference stem to score against: its own, else the first of its group that the track has.

    Columns track, stem, reference; pairs without any are left out. The groups are a few names.
    """
    names = [(a, b, k) for g in groups for a in g for k, b in enumerate([a, *[x for x in g if x != a]])]
    of = wanted.sparkSession.createDataFrame(names, "stem string, reference string, turn int")
    listed = wanted.join(of, "stem", "left").withColumns({"reference": F.coalesce("reference", "stem"), "turn": F.coalesce("turn", F.lit(0))})
    there = references.select("track", F.col("stem").alias("reference")).distinct()
    return listed.join(there, ["track", "reference"]).groupBy("track", "stem").agg(F.min_by("reference", "turn").alias("reference"))


def stem_report(estimates: DataFrame, references: DataFrame, groups: list[list[str]], metrics: list[str], derived: tuple[str, list[str]] = ("mne", ["music", "effects"])) -> DataFrame:
    """Means over tracks by key ``stem/metric`` of estimates (track, stem, pos, v) against references of the same form.

    Missing reference stems take the first of their group; an estimate of the ``derived`` stem is the sum of its
    parts where a track has none of its own; a stem that nothing was scored for is NaN.
    """
    name, parts = derived
    own = estimates.filter(F.col("stem") == name).select("track").distinct()
    summed = estimates.filter(F.col("stem").isin(parts)).join(own, "track", "left_anti").groupBy("track", "pos").agg(F.sum("v").alias("v")).withColumn("stem", F.lit(name))
    est = estimates.select("track", "stem", "pos", "v").unionByName(summed.select("track", "stem", "pos", "v"))
    stems = est.select("track", "stem").distinct()
    pairs = aliased_references(stems, references, groups)
    ref = references.select("track", F.col("stem").alias("reference"), "pos", F.col("v").alias("r"))
    joined = est.join(pairs, ["track", "stem"]).join(ref, ["track", "reference", "pos"]).withColumnRenamed("v", "e")
    found = score(joined, ["track", "stem"], metrics)
    long = stems.join(found, ["track", "stem"], "left").select("stem", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in metrics])).alias("x"))
    return long.groupBy(F.concat_ws("/", "stem", "x.metric").alias("key")).agg(F.coalesce(F.avg("x.value"), F.lit(float("nan"))).alias("value"))


@query("i10_score_report", f"""WITH {REF}, {_SUMS}, v AS (SELECT track, 'sdr' AS metric, {_SDR} AS value FROM j GROUP BY track, model UNION ALL SELECT track, 'si_sdr', {_SISDR} FROM s)
SELECT metric, track, round(avg(value), 4) AS value FROM v GROUP BY GROUPING SETS ((metric, track), (metric))""")
def i10(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = score(against_median(fx.sig(spark, sf_dir)), ["track", "model"], ["sdr", "si_sdr"])
    long = found.select("track", F.expr("stack(2, 'sdr', sdr, 'si_sdr', si_sdr) AS (metric, value)"))
    return score_report(long).withColumn("value", F.round("value", 4))


@query("i10_stem_report", f"""WITH {fx.STEMS}, e AS (SELECT track, stem, pos, v FROM stems WHERE stem <> 'click' UNION ALL SELECT track, 'mne', pos, sum(v) FROM stems WHERE stem IN ('view', 'error') GROUP BY track, pos),
r AS (SELECT track, CASE stem WHEN 'view' THEN 'mne' ELSE stem END AS stem, pos, v * 0.5 AS v FROM stems WHERE stem <> 'error' OR track % 2 = 0),
p AS (SELECT DISTINCT track, stem, CASE WHEN stem = 'view' THEN 'click' WHEN stem = 'error' AND track % 2 = 1 THEN NULL ELSE stem END AS reference FROM e),
s AS (SELECT e.track, e.stem, 10 * log10((sum(r.v * r.v) + 1e-8) / (sum(pow(r.v - e.v, 2)) + 1e-8)) AS sdr FROM e JOIN p ON p.track = e.track AND p.stem = e.stem JOIN r ON r.track = e.track AND r.stem = p.reference AND r.pos = e.pos GROUP BY ALL)
SELECT stem || '/sdr' AS key, round(avg(sdr), 4) AS value FROM s GROUP BY stem""")
def i10_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = fx.stems(spark, sf_dir).filter("stem IS NOT NULL")
    ref = df.filter("stem <> 'error' OR track % 2 = 0").withColumns({"stem": F.when(F.col("stem") == "view", "mne").otherwise(F.col("stem")), "v": F.col("v") * 0.5})
    return stem_report(df.filter("stem <> 'click'"), ref, [["view", "click"]], ["sdr"], ("mne", ["view", "error"])).withColumn("value", F.round("value", 4))


def p_norm_ratio(p: int = 1, eps: float = 1e-3, log: bool = True) -> Column:
    """Error norm against target norm, p = 1 (mean absolute) or 2 (mean square); in decibel or as a plain ratio."""
    norm = (lambda x: F.avg(F.abs(x))) if p == 1 else (lambda x: F.avg(x * x))
    top, base = norm(_d()), norm(_r())
    return 10 * (F.log10(top + eps) - F.log10(base + eps)) if log else top / (base + eps)


@query("i11_p_norm_ratio", f"""WITH {REF} SELECT track, model, round(10 * (log10(avg(abs(r - e)) + 1e-3) - log10(avg(abs(r)) + 1e-3)), 4) AS p1,
round(10 * (log10(avg((r - e) * (r - e)) + 1e-3) - log10(avg(r * r) + 1e-3)), 4) AS p2, round(avg(abs(r - e)) / (avg(abs(r)) + 1e-3), 4) AS plain FROM j GROUP BY ALL""")
def i11(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = against_median(fx.sig(spark, sf_dir))
    return j.groupBy("track", "model").agg(F.round(p_norm_ratio(1), 4).alias("p1"), F.round(p_norm_ratio(2), 4).alias("p2"), F.round(p_norm_ratio(1, log=False), 4).alias("plain"))


def neg_sdr_family(joined: DataFrame, keys: list[str], zero_mean: bool = True) -> DataFrame:
    """Negative snr, sisdr and sdsdr by key, of the signals less their means."""
    n = F.count(F.lit(1))
    s = joined.groupBy(*keys).agg(n.alias("n"), F.sum("r").alias("r1"), F.sum("e").alias("e1"), F.sum(_r() * _r()).alias("rr"), F.sum(_r() * F.col("e")).alias("re"), F.sum(F.col("e") * F.col("e")).alias("ee"))
    if zero_mean:
        s = s.withColumns({"rr": F.expr("rr - r1 * r1 / n"), "re": F.expr("re - r1 * e1 / n"), "ee": F.expr("ee - e1 * e1 / n")})
    s = s.withColumn("a", F.expr("re / (rr + 1e-8)"))
    ratio = lambda top, err: -decibel(F.expr(top) / (F.greatest(F.expr(err), F.lit(0.0)) + EPS) + EPS)
    return s.select(*keys, ratio("rr", "rr - 2 * re + ee").alias("snr"), ratio("a * a * rr", "a * a * rr - 2 * a * re + ee").alias("sisdr"), ratio("a * a * rr", "rr - 2 * re + ee").alias("sdsdr"))


@query("i12_neg_sdr_family", f"""WITH {REF}, s AS (SELECT track, model, sum(r * r) - sum(r) * sum(r) / count(*) AS rr, sum(r * e) - sum(r) * sum(e) / count(*) AS re, sum(e * e) - sum(e) * sum(e) / count(*) AS ee FROM j GROUP BY ALL), t AS (SELECT *, re / (rr + 1e-8) AS a FROM s)
SELECT track, model, round(-10 * log10(rr / (greatest(rr - 2 * re + ee, 0) + 1e-8) + 1e-8), 4) AS snr, round(-10 * log10(a * a * rr / (greatest(a * a * rr - 2 * a * re + ee, 0) + 1e-8) + 1e-8), 4) AS sisdr,
round(-10 * log10(a * a * rr / (greatest(rr - 2 * re + ee, 0) + 1e-8) + 1e-8), 4) AS sdsdr FROM t""")
def i12(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = neg_sdr_family(against_median(fx.sig(spark, sf_dir)), ["track", "model"])
    return out.select("track", "model", *[F.round(m, 4).alias(m) for m in ("snr", "sisdr", "sdsdr")])


@query("u2_register_score", f"WITH {REF} SELECT track, model, round(max(abs(r - e)), 6) AS worst, round({_SDR}, 4) AS sdr FROM j GROUP BY ALL")
def u2(spark: SparkSession, sf_dir: str) -> DataFrame:
    register_score("worst", lambda: F.max(F.abs(_d())))
    out = score(against_median(fx.sig(spark, sf_dir)), ["track", "model"], ["worst", "sdr"])
    return out.select("track", "model", F.round("worst", 6).alias("worst"), F.round("sdr", 4).alias("sdr"))
