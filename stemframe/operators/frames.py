"""Framing and overlap-add.

A signal in long form is cut into chunks by arithmetic on ``pos``: each sample goes to the chunks that
hold it (``explode`` of a short sequence, no join). A model of single samples may also look at their place in the
chunk; then a sample's output is a sum over the few chunks that hold it, and overlap-add is an expression on its
row, without an exchange of samples: padding only moves the chunks, and of a signal only its length must be known.
The schemes differ in padding, in the weight of a sample by its place in a chunk, and in whether the weights are
divided out again. For models of whole chunks ``functions.udf.apply_model`` has the same schemes.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from stemframe import fixtures as fx
from stemframe.functions.exprs import seeded, seeded_sql
from stemframe.operators.scans import BLOCK, moving_sum
from stemframe.registry import query

#: model(v) of a sample.
Model = Callable[[Column], Column]
#: model(v, i) of a sample and its place in a chunk.
ChunkModel = Callable[[Column, Column], Column]
#: weight(i, chunk, last chunk, samples in the chunk)
Weight = Callable[[Column, Column, Column, Column], Column]
KEYS = ["track", "stem"]


def identity(v: Column, i: Column | None = None) -> Column:
    return v


def gain(g: float) -> ChunkModel:
    """The test model v -> g v."""
    return lambda v, i=None: v * g


def ramp(size: int) -> ChunkModel:
    """A test model that rises over the chunk: v -> v (0.7312345 + 0.4567891 i / size)."""
    return lambda v, i: v * (0.7312345 + 0.4567891 * i / size)


def with_length(df: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``n``, the length of the signal: one row by key, which AQE broadcasts where that is small."""
    return df.join(df.groupBy(*keys).agg((F.max("pos") + 1).alias("n")), keys)


def frame(df: DataFrame, keys: list[str], size: int, hop: int, tail: str = "pad") -> DataFrame:
    """Samples by chunk: keys, chunk, i (place in the chunk), last (last chunk), len (samples in the chunk), v, n, pos.

    tail: ``pad`` keeps a partial chunk at the end, ``drop`` leaves it out, ``align`` moves the last chunk
    back so that it ends with the signal, ``reflect`` fills a partial chunk with mirrored samples where it holds more
    than half of its size (a shorter one stays partial, as with ``pad``).
    """
    df = df if "n" in df.columns else with_length(df, keys)
    n, pos = F.col("n"), F.col("pos")
    if tail == "reflect":
        chunks = frame(df, keys, size, hop, "pad")
        mirror = 2 * F.col("len") - 2 - F.col("i")
        fills = (F.col("len") < size) & (2 * F.col("len") > size) & (mirror >= F.col("len")) & (mirror < size)
        extra = chunks.filter(fills).withColumn("i", mirror.cast("int"))
        return chunks.unionByName(extra)
    if tail == "align":
        last = F.greatest(F.ceil((n - size) / hop), F.lit(0)).cast("int")
        regular = F.sequence(F.greatest(F.ceil((pos - size + 1) / hop), F.lit(0)).cast("int"), F.floor(pos / hop).cast("int"))
        ended = F.when(pos >= n - size, F.array(last)).otherwise(F.array().cast("array<int>"))
        chunks = F.concat(F.filter(regular, lambda k: k < last), ended)
        start = lambda k: F.when(k < F.col("last"), k * hop).otherwise(F.greatest(n - size, F.lit(0)))
    else:
        last = (F.ceil(n / hop) - 1 if tail == "pad" else F.floor((n - size) / hop)).cast("int")
        chunks = F.filter(F.sequence(F.greatest(F.ceil((pos - size + 1) / hop), F.lit(0)).cast("int"), F.floor(pos / hop).cast("int")), lambda k: k <= last)
        start = lambda k: k * hop
    out = df.withColumn("last", last).withColumn("chunk", F.explode(chunks))
    at = start(F.col("chunk"))
    return out.withColumn("i", (pos - at).cast("int")).withColumn("len", F.least(F.lit(size), n - at).cast("int"))


def overlap_add(df: DataFrame, keys: list[str], size: int, hop: int, weight: Weight, model: ChunkModel = identity, divide: bool = True, tail: str = "pad", left: int | Column = 0, n: Column | None = None) -> DataFrame:
    """A signal through a model in chunks and back to one value by position.

    ``left`` samples of padding stand before the signal and ``n`` is its padded length (with ``left`` and ``n`` as
    expressions of the column n, the length of the signal itself). What is in the padding does not matter to a
    model of single samples. tail: ``pad`` or ``align``, as in ``frame``.
    """
    df = df if "n" in df.columns else with_length(df, keys)
    n = F.col("n") if n is None else n
    pos = F.col("pos") + left
    last = (F.ceil(n / hop) - 1 if tail == "pad" else F.greatest(F.ceil((n - size) / hop), F.lit(0))).cast("int")
    rows = df.select(*keys, "pos", "v", pos.cast("int").alias("__at"), n.cast("int").alias("__n"), last.alias("__last"))
    at, n, last = F.col("__at"), F.col("__n"), F.col("__last")
    rows = rows.withColumns({"__rest": at % hop, "__newest": F.floor(at / hop).cast("int"), "__end": at - F.greatest(n - size, F.lit(0))})
    places = []  # of each chunk that may hold the sample: whether it does, its number, and the sample's place in it
    for back in range(-(-size // hop)):
        chunk, i = F.col("__newest") - back, F.col("__rest") + back * hop
        places.append(((chunk >= 0) & (i < size) & (chunk <= last if tail == "pad" else chunk < last), chunk, i))
    if tail == "align":
        places.append((F.col("__end") >= 0, last, F.col("__end")))
    # Weights are columns of their own: short expressions stay within what the JIT compiles.
    weights = {f"__w{k}": F.when(there, weight(i, chunk, last, F.least(F.lit(size), n - at + i)).cast("double")).otherwise(0.0) for k, (there, chunk, i) in enumerate(places)}
    rows = rows.withColumns(weights)
    top = sum((model(F.col("v"), i) * F.col(w) for w, (_, _, i) in zip(weights, places)), F.lit(0.0))
    base = sum((F.col(w) for w in weights), F.lit(0.0))
    return rows.select(*keys, "pos", (F.when(base != 0, top / base).otherwise(0.0) if divide else top).alias("v"))


def reflected(border: int) -> tuple[int, Column]:
    """Padding before and padded length of a signal with ``border`` mirrored samples, where it is longer than twice that."""
    return border, F.when(F.col("n") > 2 * border, F.col("n") + 2 * border).otherwise(F.col("n") + border)


def reflect_pad(df: DataFrame, keys: list[str], border: int) -> DataFrame:
    """The signal with ``border`` mirrored samples on both sides, where it is longer than twice that; positions begin at -border."""
    df = df if "n" in df.columns else with_length(df, keys)
    n, pos = F.col("n"), F.col("pos")
    here = F.array(pos)
    left = F.when((n > 2 * border) & (pos >= 1) & (pos <= border), F.array(-pos)).otherwise(F.array().cast(f"array<{df.schema['pos'].dataType.simpleString()}>"))
    right = F.when((n > 2 * border) & (pos >= n - 1 - border) & (pos <= n - 2), F.array(2 * (n - 1) - pos)).otherwise(F.array().cast(f"array<{df.schema['pos'].dataType.simpleString()}>"))
    return df.withColumn("pos", F.explode(F.concat(left, here, right)))


def moved(df: DataFrame, by: int | Column) -> DataFrame:
    """The signal ``by`` positions later; a length that it carries grows with it."""
    return df.withColumns({c: F.col(c) + by for c in ("pos", "n") if c in df.columns})


def fade_window(i: Column, size: int, fade: int) -> Column:
    """Linear from 0 to 1 over ``fade`` samples, ones, and back."""
    step = 1.0 / (fade - 1) if fade > 1 else 0.0
    return F.when(i < fade, i * step).when(i >= size - fade, (size - 1 - i) * step).otherwise(1.0)


def fade_weight(size: int, fade: int) -> Weight:
    """Linear from 0 to 1 and back over ``fade`` samples, but not at the first chunk's start and the last one's end."""
    step = 1.0 / (fade - 1) if fade > 1 else 0.0
    return lambda i, chunk, last, length: F.when((i < fade) & (chunk > 0), i * step).when((i >= size - fade) & (chunk < last), (size - 1 - i) * step).otherwise(1.0)


def overlap_add_fade(df: DataFrame, keys: list[str], size: int, hop: int, model: ChunkModel = identity, fade: int | None = None) -> DataFrame:
    """Reflected borders, trapezoid weights, no fade-in on the first chunk and no fade-out on the last."""
    left, n = reflected(size - hop)
    return overlap_add(df, keys, size, hop, fade_weight(size, fade or size // 10), model, left=left, n=n)


def overlap_add_triangle(df: DataFrame, keys: list[str], size: int, overlap: float = 0.25, model: ChunkModel = identity, power: float = 1.0) -> DataFrame:
    hop, half = int((1 - overlap) * size), size // 2
    weight = lambda i, chunk, last, length: F.pow(F.when(i < half, i + 1).otherwise(size - i) / max(half, size - half), F.lit(power))
    return overlap_add(df, keys, size, hop, weight, model)


def overlap_add_hann(df: DataFrame, keys: list[str], size: int, hop: int, trim: int, model: ChunkModel = identity) -> DataFrame:
    """Zeros of ``trim`` around the signal; symmetric Hann weights of each chunk's own length."""
    weight = lambda i, chunk, last, length: F.when(length > 1, 0.5 - 0.5 * F.cos(2 * math.pi * i / (length - 1))).otherwise(1.0)
    return overlap_add(df, keys, size, hop, weight, model, left=trim, n=F.col("n") + (2 * trim + hop))


def overlap_add_hamming(df: DataFrame, keys: list[str], size: int, hop: int, model: ChunkModel = identity) -> DataFrame:
    """Hamming weights; the last chunk ends with the signal."""
    weight = lambda i, chunk, last, length: 0.54 - 0.46 * F.cos(2 * math.pi * i / (size - 1))
    return overlap_add(df, keys, size, hop, weight, model, tail="align")


def overlap_add_unfold(df: DataFrame, keys: list[str], size: int, hop: int, model: ChunkModel = identity) -> DataFrame:
    """Zeros of size - hop around the signal; the plain sum divided by the number of overlapping chunks."""
    pad = size - hop
    return overlap_add(df, keys, size, hop, lambda *_: F.lit(hop / size), model, divide=False, left=pad, n=F.col("n") + 2 * pad)


def linear_fader(df: DataFrame, keys: list[str], size: int, hop: int, model: ChunkModel = identity) -> DataFrame:
    """Linear cross-fades that add up to one, ones at the outer edges; needs hop >= size / 2."""
    if 2 * hop < size:
        raise ValueError("a sample may be in two chunks at most")
    over = size - hop

    def weight(i, chunk, last, length):
        up = (i + 1) / (over + 1.0)
        down = (size - i) / (over + 1.0)
        return F.when((i < over) & (chunk > 0), up).when((i >= hop) & (chunk < last), down).otherwise(1.0)

    return overlap_add(df, keys, size, hop, weight, model, divide=False)


def window_fader(df: DataFrame, keys: list[str], size: int, hop: int, model: ChunkModel = identity) -> DataFrame:
    """Periodic Hann weights over size / (2 hop), reflected borders; chunks of silence never reach the model."""
    border = 2 * (size - hop)
    df = df if "n" in df.columns else with_length(df, keys)
    padded = reflect_pad(df, keys, border).withColumns({"pos": F.col("pos") + border, "own": F.col("n"), "n": reflected(border)[1]})
    chunks = frame(padded, keys, size, hop)
    at = F.col("pos") - border
    loud = F.max(F.abs("v")).over(Window.partitionBy(*keys, "chunk")) > 0
    # Samples of the border, here without a position, count for a chunk's loudness only.
    chunks = chunks.withColumn("pos", F.when((at >= 0) & (at < F.col("own")), at)).withColumn("loud", loud).filter(F.col("pos").isNotNull())
    weight = lambda i, chunk, last, length: (0.5 - 0.5 * F.cos(2 * math.pi * i / size)) * (2 * hop / size)
    w = weight(F.col("i"), None, None, None)
    return chunks.groupBy(*keys, "pos").agg(F.sum(F.when(F.col("loud"), model(F.col("v"), F.col("i")) * w).otherwise(0.0)).alias("v"))


def shift_average(df: DataFrame, keys: list[str], shifts: int, most: int, model: Callable[[DataFrame], DataFrame], seed: str = "shift") -> DataFrame:
    """Mean over runs of ``model`` (DataFrame to DataFrame) on the signal moved by seeded offsets, moved back."""
    runs = df.withColumn("shift", F.explode(F.sequence(F.lit(0), F.lit(shifts - 1))))
    offset = F.floor(seeded(seed, "shift") * most).cast("int")
    out = model(moved(runs, offset))
    return out.withColumn("pos", F.col("pos") - F.floor(seeded(seed, "shift") * most).cast("int")).groupBy(*keys, "pos").agg(F.avg("v").alias("v"))


def tta_average(df: DataFrame, model: Model) -> DataFrame:
    """Mean of three runs (as it is, channels swapped, polarity inverted), each undone; null results don't count."""
    variants = df.withColumn("variant", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    channel = F.when(F.col("variant") == 1, 1 - F.col("channel")).otherwise(F.col("channel"))
    sign = F.when(F.col("variant") == 2, -1.0).otherwise(1.0)
    run = variants.withColumn("channel", channel).withColumn("v", sign * model(sign * F.col("v")))
    return run.withColumn("channel", F.when(F.col("variant") == 1, 1 - F.col("channel")).otherwise(F.col("channel"))).groupBy("track", "channel", "pos").agg(F.avg("v").alias("v"))


def denoise_pair(spec: DataFrame, model: Model, low_bins: int = 3) -> DataFrame:
    """(f(x) - f(-x)) / 2 on spectra (bin, re, im), with the lowest bins silenced first."""
    keep = F.when(F.col("bin") < low_bins, 0.0).otherwise(1.0)
    half = lambda x: 0.5 * model(keep * x) - 0.5 * model(-(keep * x))
    return spec.withColumns({"re": half(F.col("re")), "im": half(F.col("im"))})


def mask_tta(df: DataFrame, keys: list[str], size: int, model: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Mean of two runs of a chunked mask model, the second moved by half a chunk."""
    second = model(moved(df, size // 2)).withColumn("pos", F.col("pos") - size // 2)
    return model(df).unionByName(second).groupBy(*keys, "pos").agg(F.avg("v").alias("v"))


def patch_layout(df: DataFrame, width: str, crop: int, offset: int) -> DataFrame:
    """Padding of a spectrogram for patches: left, roi, right."""
    roi = crop - 2 * offset or crop
    return df.withColumns({"pad_left": F.lit(offset), "roi": F.lit(roi), "pad_right": roi - F.col(width) % roi + offset})


def silence_cut_points(df: DataFrame, keys: list[str], t_max: int, t_center: int, t_query: int, window: int, block: int = BLOCK) -> DataFrame:
    """For signals longer than t_max: around each multiple of t_center the place of least moving sum, on the grid of ``window``.

    df is in long form, or has block rows (keys, start, samples, n: the length of the signal), of which only the stretches
    around the centres are taken.
    """
    if "samples" in df.columns:
        return _block_cut_points(df.filter(F.col("n") > t_max), keys, t_center, t_query, window)
    df = (df if "n" in df.columns else with_length(df, keys)).filter(F.col("n") > t_max)
    moving = moving_sum(df, keys, window, block).withColumn("s", F.round(F.abs("sum"), 6))
    near = F.round(F.col("pos") / t_center).cast("int")  # the only centre within t_query, as t_query < t_center / 2
    near = moving.withColumn("centre", near * t_center).filter((F.col("centre") > 0) & (F.col("centre") < F.col("n")) & (F.col("pos") >= F.col("centre") - t_query) & (F.col("pos") < F.col("centre") + t_query))
    found = near.groupBy(*keys, "centre").agg(F.min_by("pos", F.struct("s", "pos")).alias("at"))
    return found.withColumn("cut", F.floor(F.col("at") / window).cast("int") * window).drop("at")


def _stretches(blocks: DataFrame, keys: list[str], wanted: Column, lo: Column, hi: Column) -> DataFrame:
    """The samples lo..hi of each ``wanted`` (an array of structs, column z once exploded) put together from block rows: keys, z, first (place of the first sample) and samples."""
    begin, end = F.greatest(lo, F.col("start")), F.least(hi, F.col("start") + F.size("samples"))
    pieces = blocks.withColumn("z", F.explode(wanted)).withColumns({"begin": begin.cast("int"), "end": end.cast("int")}).filter("begin < end")
    piece = F.slice("samples", (F.col("begin") - F.col("start") + 1).cast("int"), F.col("end") - F.col("begin"))
    held = pieces.groupBy(*keys, "z").agg(F.array_sort(F.collect_list(F.struct("begin", piece.alias("own")))).alias("s"))
    return held.select(*keys, "z", F.col("s")[0]["begin"].alias("first"), F.flatten(F.col("s.own")).alias("samples"))


def _block_cut_points(blocks: DataFrame, keys: list[str], t_center: int, t_query: int, window: int) -> DataFrame:
    last = F.least(F.floor((F.col("start") + F.size("samples") + t_query) / t_center), F.ceil(F.col("n") / t_center) - 1).cast("int")
    from_ = F.greatest(F.lit(1), F.floor((F.col("start") - t_query - window) / t_center)).cast("int")
    centres = F.when(from_ <= last, F.transform(F.sequence(from_, last), lambda k: F.struct((k * t_center).alias("centre"))))
    centre = F.col("z.centre")
    near = _stretches(blocks, keys, centres, centre - t_query, centre + t_query + window - 1)
    places = F.least(F.size("samples"), centre + t_query - F.col("first")).alias("places")

    def quietest(batches):
        for whole in batches:
            step = max(1, 2_000_000 // max(1, pc.max(pc.list_value_length(whole.column("samples"))).as_py() or 1))
            for batch in (whole.slice(k, step) for k in range(0, whole.num_rows, step)):
                own = {name: batch.column(name) for name in (*keys, "centre")}
                first, places, held = batch.column("first").to_numpy(), batch.column("places").to_numpy(), batch.column("samples")
                sizes, flat = pc.list_value_length(held).to_numpy(), pc.fill_null(pc.list_flatten(held), 0.0).to_numpy(zero_copy_only=False)
                x = np.zeros((len(sizes), sizes.max() + window - 1))
                inside = np.arange(x.shape[1])
                x[inside < sizes[:, None]] = flat
                sums = sum(x[:, k : x.shape[1] - window + 1 + k] for k in range(window))
                s = np.floor(np.abs(sums) * 1e6 + 0.5) / 1e6
                s[np.isnan(s) | (inside[: s.shape[1]] >= places[:, None])] = np.inf
                yield pa.RecordBatch.from_arrays([*own.values(), pa.array((first + s.argmin(axis=1)) // window * window, pa.int32())], names=[*own, "cut"])

    rows = near.select(*keys, centre.alias("centre"), "first", places, "samples")
    return rows.mapInArrow(quietest, StructType([*(rows.schema[name] for name in (*keys, "centre")), StructField("cut", IntegerType())]))


def split_concat(blocks: DataFrame, cuts: DataFrame, keys: list[str], halo: int, model: Callable[[Column], Column]) -> DataFrame:
    """Cut at ``cuts`` (keys, cut), run the model on parts with a halo on both sides, drop the halo, put together: keys, pos, v.

    Signals are block rows (keys, start, samples, n: the length of the signal); the model gets a part's samples as an
    array and gives as many. Blocks meet the cuts as they are: samples become rows at the very end.
    """
    edges = cuts.groupBy(*keys).agg(F.array_sort(F.collect_set("cut")).alias("cuts"))
    bounds = F.concat(F.array(F.lit(0)), F.coalesce("cuts", F.array().cast("array<int>")), F.array(F.col("n").cast("int")))
    both = blocks.join(edges, keys, "left").withColumn("bounds", bounds)
    part = lambda k: F.struct(F.get("bounds", k).alias("lo"), F.get("bounds", k + 1).alias("hi"))
    meets = lambda z: (z["lo"] < z["hi"]) & (z["lo"] - halo < F.col("start") + F.size("samples")) & (z["hi"] + halo > F.col("start"))
    parts = F.filter(F.transform(F.sequence(F.lit(0), F.size("bounds") - 2), part), meets)
    cut = _stretches(both, keys, parts, F.col("z.lo") - halo, F.col("z.hi") + halo)
    kept = F.slice(model(F.col("samples")), F.col("z.lo") - F.col("first") + 1, F.col("z.hi") - F.col("z.lo"))
    # A part is never empty, so outer only saves Spark a filter on the length.
    return cut.select(*keys, F.col("z.lo").alias("lo"), F.posexplode_outer(kept).alias("i", "v")).select(*keys, (F.col("lo") + F.col("i")).alias("pos"), "v")


def context_pad(df: DataFrame, keys: list[str], offset: int, length: int, target: int) -> DataFrame:
    """The stretch offset..offset+length widened to ``target`` samples by its neighbours, zeros only past the ends."""
    start = offset - (target - length) // 2
    grid = df.select(*keys).distinct().withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(target - 1))))
    own = df.select(*keys, (F.col("pos") - start).cast("int").alias("i"), "v").filter((F.col("i") >= 0) & (F.col("i") < target))
    return grid.join(own, [*keys, "i"], "left").withColumn("v", F.coalesce("v", F.lit(0.0)))


def cosine_model(g: float) -> Model:
    return lambda v: F.cos(v) * g


def _q(name: str, run: Callable[[DataFrame], DataFrame], sql: str) -> None:
    """An overlap-add scheme with a model that depends on the place in the chunk, so that every weight shows."""

    @query(name, f"WITH {fx.STEMS}, {sql}")
    def q(spark: SparkSession, sf_dir: str, run=run) -> DataFrame:
        return run(fx.stems(spark, sf_dir, sized=True)).select("track", "stem", "pos", (F.round("v", 3) + 0.0).alias("v"))


def _chunks_sql(size: int, hop: int, left: int, chunks: int) -> str:
    """Samples of the 720 positions by chunk k, at place i in it."""
    return f"c AS (SELECT track, stem, pos, v, k, pos + {left} - k * {hop} AS i FROM stems JOIN (SELECT unnest(range(0, {chunks})) AS k) ON pos + {left} >= k * {hop} AND pos + {left} < k * {hop} + {size})"


_MEAN = "SELECT track, stem, pos, round(CASE WHEN sum(w) <> 0 THEN sum(w * v * (0.7312345 + 0.4567891 * i / {}.0)) / sum(w) ELSE 0 END, 3) + 0.0 AS v FROM w GROUP BY ALL"
_SUM = "SELECT track, stem, pos, round(sum(w * v * (0.7312345 + 0.4567891 * i / {}.0)), 3) + 0.0 AS v FROM w GROUP BY ALL"
_G = gain(0.7312345)
_q("c3_overlap_add_fade", lambda d: overlap_add_fade(d, KEYS, 60, 20, ramp(60), 6),
   f"{_chunks_sql(60, 20, 40, 40)}, w AS (SELECT *, CASE WHEN i < 6 AND k > 0 THEN i / 5.0 WHEN i > 53 AND k < 39 THEN (59 - i) / 5.0 ELSE 1 END AS w FROM c) {_MEAN.format(60)}")
_q("c4_overlap_add_triangle", lambda d: overlap_add_triangle(d, KEYS, 48, 0.25, ramp(48)),
   f"{_chunks_sql(48, 36, 0, 20)}, w AS (SELECT *, least(i + 1, 48 - i) / 24.0 AS w FROM c) {_MEAN.format(48)}")
_q("c5_overlap_add_hann", lambda d: overlap_add_hann(d, KEYS, 48, 24, 12, ramp(48)),
   f"{_chunks_sql(48, 24, 12, 32)}, w AS (SELECT *, pow(sin(pi() * i / CASE WHEN k = 31 THEN 23 ELSE 47 END), 2) AS w FROM c) {_MEAN.format(48)}")
_q("c6_overlap_add_hamming", lambda d: overlap_add_hamming(d, KEYS, 50, 25, ramp(50)),
   f"""c AS (SELECT track, stem, pos, v, pos - s AS i FROM stems JOIN (SELECT least(k * 25, 670) AS s FROM (SELECT unnest(range(0, 28)) AS k)) ON pos >= s AND pos < s + 50),
   w AS (SELECT *, 0.54 - 0.46 * cos(2 * pi() * i / 49) AS w FROM c) {_MEAN.format(50)}""")  # fmt: skip
_q("c7_overlap_add_unfold", lambda d: overlap_add_unfold(d, KEYS, 48, 24, ramp(48)), f"{_chunks_sql(48, 24, 24, 32)}, w AS (SELECT *, 0.5 AS w FROM c) {_SUM.format(48)}")
_q("c8_linear_fader", lambda d: linear_fader(d, KEYS, 48, 30, ramp(48)),
   f"{_chunks_sql(48, 30, 0, 24)}, w AS (SELECT *, CASE WHEN i < 18 AND k > 0 THEN (i + 1) / 19.0 WHEN i >= 30 AND k < 23 THEN (48 - i) / 19.0 ELSE 1 END AS w FROM c) {_SUM.format(48)}")
# The model adds a little, which a chunk of silence must not show.
_q("c9_window_fader", lambda d: window_fader(d, KEYS, 48, 24, lambda v, i: v * (0.7312345 + 0.4567891 * i / 48) + 0.0137),
   f"""p AS (SELECT track, stem, pos + 48 AS q, v FROM stems UNION ALL SELECT track, stem, 48 - pos, v FROM stems WHERE pos BETWEEN 1 AND 48 UNION ALL SELECT track, stem, 1438 - pos + 48, v FROM stems WHERE pos BETWEEN 671 AND 718),
   c AS (SELECT *, q - k * 24 AS i FROM p JOIN (SELECT unnest(range(0, 34)) AS k) ON q >= k * 24 AND q < k * 24 + 48), l AS (SELECT *, max(abs(v)) OVER (PARTITION BY track, stem, k) > 0 AS loud FROM c)
   SELECT track, stem, q - 48 AS pos, round(sum(CASE WHEN loud THEN (v * (0.7312345 + 0.4567891 * i / 48.0) + 0.0137) * pow(sin(pi() * i / 48), 2) ELSE 0 END), 3) + 0.0 AS v FROM l WHERE q BETWEEN 48 AND 767 GROUP BY ALL""")  # fmt: skip


# Chunks of 50 at hop 36: the last one, from 684, is partial with 36 samples, more than half; 14 mirrored ones fill it.
@query("c1_frame", f"""WITH {fx.STEMS}, n AS (SELECT unnest(range(0, 20)) AS chunk), c AS (SELECT track, stem, chunk, pos - chunk * 36 AS i, v FROM stems JOIN n ON pos >= chunk * 36 AND pos < chunk * 36 + 50),
t AS (SELECT 'pad' AS tail, * FROM c UNION ALL SELECT 'drop', * FROM c WHERE chunk < 19 UNION ALL SELECT 'align', track, stem, chunk, pos - CASE WHEN chunk = 19 THEN 670 ELSE chunk * 36 END, v FROM stems JOIN n ON pos >= CASE WHEN chunk = 19 THEN 670 ELSE chunk * 36 END AND pos < chunk * 36 + 50
UNION ALL SELECT 'reflect', * FROM c UNION ALL SELECT 'reflect', track, stem, 19, 1438 - pos - 684, v FROM stems WHERE pos BETWEEN 705 AND 718)
SELECT tail, track, stem, CAST(chunk AS INTEGER) AS chunk, count(*) AS n, round(sum(v), 4) + 0.0 AS s, round(sum(v * i), 2) + 0.0 AS m FROM t GROUP BY ALL""")
def c1(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, out = fx.stems(spark, sf_dir, sized=True), None
    for tail in ("pad", "drop", "align", "reflect"):
        one = frame(df, KEYS, 50, 36, tail).groupBy(*KEYS, "chunk").agg(F.count(F.lit(1)).alias("n"), (F.round(F.sum("v"), 4) + 0.0).alias("s"), (F.round(F.sum(F.col("v") * F.col("i")), 2) + 0.0).alias("m"))
        one = one.withColumn("tail", F.lit(tail))
        out = one if out is None else out.unionByName(one)
    return out


@query("c2_fade_window", f"""WITH {fx.SIG} SELECT track, model, pos, round(v * CASE WHEN pos < 6 THEN pos / 5.0 WHEN pos >= 58 THEN (63 - pos) / 5.0 ELSE 1 END, 6) AS v FROM sig""")
def c2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.sig(spark, sf_dir).select("track", "model", "pos", F.round(F.col("v") * fade_window(F.col("pos"), 64, 6), 6).alias("v"))


def _c4(pos: str, last: int) -> str:
    """Mean weight of the ramp model under triangle weights at a place of the chunk grid, in SQL."""
    at = lambda k: f"({pos} - ({k}) * 36)"
    k = f"CAST(floor({pos} / 36) AS INTEGER)"
    w = lambda k: f"CASE WHEN ({k}) >= 0 AND ({k}) <= {last} AND {at(k)} < 48 THEN least({at(k)} + 1, 48 - {at(k)}) ELSE 0 END"
    k0, k1 = k, f"{k} - 1"
    m = lambda k: f"(0.7312345 + 0.4567891 * {at(k)} / 48.0)"
    return f"(({w(k0)}) * {m(k0)} + ({w(k1)}) * {m(k1)}) / (({w(k0)}) + ({w(k1)}))"


@query("c10_shift_average", f"""WITH {fx.STEMS}, s AS (SELECT shift, CAST(floor({seeded_sql("shift", "shift")} * 12) AS INTEGER) AS o FROM (SELECT unnest(range(0, 3)) AS shift))
SELECT track, stem, pos, round(avg(v * {_c4("(pos + o)", 20)}), 3) + 0.0 AS v FROM stems CROSS JOIN s GROUP BY ALL""")
def c10(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = lambda d: overlap_add_triangle(d, [*KEYS, "shift"], 48, 0.25, ramp(48))
    return shift_average(fx.stems(spark, sf_dir, sized=True), KEYS, 3, 12, model).withColumn("v", F.round("v", 3) + 0.0)


@query("c11_tta_average", f"""WITH {fx.STEREO}, o AS (SELECT s.track, s.channel, s.pos, s.v FROM stereo s)
SELECT track, channel, pos, round((2 * (v * v + v) + -(v * v - v)) / 3, 6) AS v FROM o""")
def c11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tta_average(fx.stereo(spark, sf_dir), lambda v: v * v + v).withColumn("v", F.round("v", 6))


@query("c13_mask_tta", f"WITH {fx.STEMS} SELECT track, stem, pos, round(v * ({_c4('pos', 20)} + {_c4('(pos + 24)', 20)}) / 2, 3) + 0.0 AS v FROM stems")
def c13(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = lambda d: overlap_add_triangle(d, KEYS, 48, 0.25, ramp(48))
    return mask_tta(fx.stems(spark, sf_dir, sized=True), KEYS, 48, model).withColumn("v", F.round("v", 3) + 0.0)


@query("c14_patch_layout", "SELECT page_id, length(html) AS width, 16 AS pad_left, 224 AS roi, CAST(224 - length(html) % 224 + 16 AS INTEGER) AS pad_right FROM pages")
def c14(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stemframe.registry import table

    return patch_layout(table(spark, sf_dir, "pages").select("page_id", F.length("html").cast("long").alias("width")), "width", 256, 16).withColumn("pad_right", F.col("pad_right").cast("int"))


_CUT = """m AS (SELECT *, abs(sum(v) OVER (PARTITION BY track, stem ORDER BY pos ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)) AS s FROM stems),
c AS (SELECT unnest(range(120, 720, 120)) AS centre), f AS (SELECT track, stem, centre, arg_min(pos, (round(s, 6), pos)) AS spot FROM m JOIN c ON pos >= centre - 30 AND pos < centre + 30 GROUP BY ALL)"""


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stems as block rows, one for each."""
    return fx.stem_rows(spark, sf_dir).withColumns({"start": F.lit(0), "n": F.size("samples")})


@query("c15_silence_cut_points", f"WITH {fx.STEMS}, {_CUT} SELECT track, stem, CAST(centre AS INTEGER) AS centre, CAST(floor(spot / 8) * 8 AS INTEGER) AS cut FROM f")
def c15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return silence_cut_points(_blocks(spark, sf_dir), KEYS, 300, 120, 30, 8)


# The model looks one sample back, so a part without its halo would differ at its first sample.
@query("c16_split_concat", f"WITH {fx.STEMS} SELECT track, stem, pos, round(v * 0.7312345 + 0.2612349 * coalesce(lag(v) OVER (PARTITION BY track, stem ORDER BY pos), 0), 3) + 0.0 AS v FROM stems")
def c16(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _blocks(spark, sf_dir)
    cuts = silence_cut_points(df, KEYS, 300, 120, 30, 8)
    model = lambda s: F.zip_with(s, F.slice(F.concat(F.array(F.lit(0.0)), s), F.lit(1), F.size(s)), lambda v, before: _G(v) + 0.2612349 * before)
    return split_concat(df, cuts, KEYS, 10, model).withColumn("v", F.round("v", 3) + 0.0)


@query("c19_context_pad", f"""WITH {fx.STEMS} SELECT k.track, k.stem, CAST(g.i AS INTEGER) AS i, round(coalesce(v, 0), 4) AS v FROM (SELECT DISTINCT track, stem FROM stems) k CROSS JOIN (SELECT unnest(range(0, 64)) AS i) g
LEFT JOIN stems s ON s.track = k.track AND s.stem = k.stem AND s.pos = g.i + 700 - 20""")
def c19(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_pad(fx.stems(spark, sf_dir), KEYS, 700, 24, 64).withColumn("v", F.round("v", 4))
