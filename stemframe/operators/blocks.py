"""Signals as block rows, and frames of them.

A block row holds ``block`` samples of a signal as arrays (one for each column), so a signal of any length is many
rows that tasks work on by themselves. What an operation needs of the neighbours comes by a *halo exchange*: a join
of each block with the ends of the blocks before and after it, by key and block. Frames are slices of a block with
its halo; they belong to the block in which they begin. Transforms and sums over frames are numpy on Arrow batches,
and of a block only its frames or a few sums leave a task.

Signals are dense from position 0.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 65_536


def to_blocks(df: DataFrame, keys: list[str], columns: tuple[str, ...] = ("v",), block: int = BLOCK) -> DataFrame:
    """Block rows of a long-form signal: keys, block, and an array of doubles for each of ``columns``."""
    number = F.expr(f"CAST(pos div {block} AS INT)")
    values = [F.col(c).cast("double").alias(c) for c in columns]
    rows = df.groupBy(*keys, number.alias("block")).agg(F.array_sort(F.collect_list(F.struct("pos", *values))).alias("__s"))
    return rows.select(*keys, "block", *[F.transform("__s", lambda s: s[c]).alias(c) for c in columns])  # noqa: B023


def placed_blocks(df: DataFrame, keys: list[str], block: int = BLOCK) -> DataFrame:
    """Block rows (keys, block, v, on) of a long-form signal that may have gaps: v is 0 in them, and on is 1 where there is a sample."""
    number = F.expr(f"CAST(pos div {block} AS INT)")
    rows = df.groupBy(*keys, number.alias("block")).agg(F.collect_list(F.struct((F.col("pos") % block).cast("int").alias("i"), F.col("v").cast("double").alias("v"))).alias("s"))
    rows = rows.select(*keys, "block", F.transform("s", lambda s: s["i"]).alias("__i"), F.transform("s", lambda s: s["v"]).alias("v"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            v, on = [], []
            for i, x in zip(pdf["__i"], pdf["v"]):
                v.append(np.zeros(int(np.max(i)) + 1))
                on.append(v[-1].copy())
                v[-1][i], on[-1][i] = x, 1.0
            yield pdf[[*keys, "block"]].assign(v=v, on=on)

    return rows.mapInPandas(run, f"{_schema(df, keys)}, block int, v array<double>, on array<double>")


def from_blocks(blocks: DataFrame, keys: list[str], column: str = "v", block: int = BLOCK) -> DataFrame:
    """Long form: keys, pos, v."""
    flat = blocks.select(*keys, "block", F.posexplode(column).alias("i", "v"))
    return flat.select(*keys, (F.col("block").cast("long") * block + F.col("i")).alias("pos"), "v")


def with_halo(blocks: DataFrame, keys: list[str], columns: tuple[str, ...], before: int, after: int, block: int = BLOCK) -> DataFrame:
    """The arrays of ``columns`` with up to ``before`` samples in front and ``after`` behind; own: samples of the block itself, lead: those in front of them.

    One join for each neighbour that is reached (one on each side where the halo is no longer than a block); only the
    ends of blocks are exchanged.
    """
    own = blocks.select(*keys, "block", *columns).withColumn("own", F.size(columns[0]))
    parts: dict[str, list] = {c: [F.col(c)] for c in columns}
    for side, reach in (("after", after), ("before", before)):
        for d in range(1, -(-reach // block) + 1):
            most = min(block, reach - (d - 1) * block)
            start = F.lit(1) if side == "after" else F.greatest(F.size(columns[0]) - most + 1, F.lit(1))
            ends = [F.slice(c, start, most).alias(f"__{side}{d}_{c}") for c in columns]
            number = F.col("block") - d if side == "after" else F.col("block") + d
            own = own.join(blocks.select(*keys, number.alias("block"), *ends), [*keys, "block"], "left")
            for c in columns:
                part = F.coalesce(f"__{side}{d}_{c}", F.array().cast("array<double>"))
                parts[c] = [*parts[c], part] if side == "after" else [part, *parts[c]]
    lead = sum((F.size(F.coalesce(f"__before{d}_{columns[0]}", F.array().cast("array<double>"))) for d in range(1, -(-before // block) + 1)), F.lit(0))
    return own.select(*keys, "block", "own", lead.alias("lead"), *[F.concat(*parts[c]).alias(c) if len(parts[c]) > 1 else F.col(c) for c in columns])


def frames_of(x: np.ndarray, lead: int, own: int, start: int, size: int, hop: int, after: int, pad: str = "none") -> tuple[int, np.ndarray]:
    """(number of the first, frames as rows) of the frames that begin in a block: x are its samples with ``lead`` before and up to ``after`` behind.

    pad: ``none`` has whole frames only, frame k beginning at k hop; ``zero`` and ``reflect`` centre frame k at k hop and continue
    the ends by silence or mirrored samples (silence, if the signal is not longer than twice what is missing).
    """
    border = size // 2 if pad != "none" else 0
    at = start - lead  # position of x[0]
    x = np.asarray(x, float)
    ended = x.size - lead - own < after
    n = at + x.size  # the signal's length, if it has ended
    if border:
        enough = pad == "reflect" and (not ended or n > 2 * border)
        if ended:
            x = np.concatenate((x, x[-2 : -border - 2 : -1] if enough else np.zeros(border)))
        if start == 0:
            x = np.concatenate((x[border:0:-1] if enough else np.zeros(border), x))
            at -= border
    first = -(-start // hop) if not border else 0 if start == 0 else -(-(start + border) // hop)
    origin = first * hop - border - at
    last = min(start + own - 1, (n + border - size) if ended else start + own - 1)
    count = (last + border) // hop - first + 1
    if count <= 0 or origin + size > x.size:
        return first, np.zeros((0, size))
    return first, np.lib.stride_tricks.sliding_window_view(x[origin:], size)[::hop][:count]


def hann_window(size: int) -> np.ndarray:
    """Periodic Hann."""
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)


def _scaled_by(window: np.ndarray, scale: str) -> float:
    return {"none": 1.0, "sqrt": math.sqrt(window.size), "window": float(window.sum())}[scale]


def _schema(df: DataFrame, names: list[str]) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in names)


def stft_blocks(blocks: DataFrame, keys: list[str], size: int = 2048, hop: int = 512, column: str = "v", block: int = BLOCK, pad: str = "none", window: np.ndarray | None = None, scale: str = "none") -> DataFrame:
    """Frame rows of block rows: keys, frame, re, im (arrays of size / 2 + 1). ``pad`` as in ``frames_of``, ``scale`` as in ``spectral.stft_centred``."""
    w = hann_window(size) if window is None else window
    by = _scaled_by(w, scale)
    rows = with_halo(blocks, keys, (column,), int(pad == "reflect"), size - 1, block)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for k, r in enumerate(pdf.itertuples(index=False)):
                first, x = frames_of(getattr(r, column), r.lead, r.own, r.block * block, size, hop, size - 1, pad)
                if len(x):
                    z = np.fft.rfft(x * w, axis=1) / by
                    yield pd.DataFrame({c: [pdf[c].iloc[k]] * len(z) for c in keys} | {"frame": np.arange(first, first + len(z)), "re": list(z.real), "im": list(z.imag)})

    return rows.mapInPandas(run, f"{_schema(blocks, keys)}, frame int, re array<double>, im array<double>")


def istft_blocks(frames: DataFrame, keys: list[str], size: int = 2048, hop: int = 512, block: int = BLOCK, window: np.ndarray | None = None, scale: str = "none", centred: bool = False) -> DataFrame:
    """Block rows (keys, block, v) of frame rows: overlap-add over the sum of squared windows.

    Frames are sent to the blocks that they reach, cut to them. The signal ends after ``length`` samples if the rows
    have that column, else where the last frame does, less half a frame where they are ``centred``; samples that
    no window reaches are 0.
    """
    w = hann_window(size) if window is None else window
    by, border = _scaled_by(w, scale), size // 2 if centred else 0

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            x = np.fft.irfft((np.stack(pdf["re"]) + 1j * np.stack(pdf["im"])) * by, size, axis=1) * w
            out = []
            for k, f in enumerate(pdf["frame"]):
                start = int(f) * hop - border
                for b in range(max(start, 0) // block, (start + size - 1) // block + 1):
                    lo, hi = max(start, b * block), min(start + size, (b + 1) * block)
                    out.append((k, b, lo - b * block, x[k, lo - start : hi - start], lo - start))
            at = [o[0] for o in out]
            yield pdf[keys].iloc[at].assign(block=[o[1] for o in out], at=[o[2] for o in out], x=[o[3] for o in out], i=[o[4] for o in out])

    parts = frames.select(*keys, "frame", "re", "im").mapInPandas(cut, f"{_schema(frames, keys)}, block int, at int, x array<double>, i int")
    n = F.max("length") if "length" in frames.columns else F.max("frame") * hop + size - 2 * border
    ends = frames.groupBy(*keys).agg(n.alias("n"))
    gathered = parts.groupBy(*keys, "block").agg(F.collect_list("at").alias("at"), F.collect_list("i").alias("i"), F.collect_list("x").alias("x")).join(ends, keys)

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                # Arrays are as long as what is kept: a batch has thousands of short signals.
                here = max(0, min(block, r.n - r.block * block))
                total, weight = np.zeros(here), np.zeros(here)
                for at, i, x in zip(r.at, r.i, r.x):
                    m = min(x.size, max(0, here - at))
                    total[at : at + m] += x[:m]
                    weight[at : at + m] += (w * w)[i : i + m]
                out.append(np.divide(total, weight, out=np.zeros(here), where=weight > 1e-12))
            yield pdf[[*keys, "block"]].assign(v=out)[[len(o) > 0 for o in out]]

    return gathered.mapInPandas(add, f"{_schema(frames, keys)}, block int, v array<double>")


def lengths(blocks: DataFrame, keys: list[str], column: str = "v", block: int = BLOCK) -> DataFrame:
    """keys and length of each signal."""
    return blocks.groupBy(*keys).agg(F.max(F.col("block").cast("long") * block + F.size(column)).alias("length"))


def frame_sums(blocks: DataFrame, keys: list[str], columns: tuple[str, ...], sizes: dict[str, tuple[int, int]], sums: Callable[[dict[str, list[np.ndarray]]], dict], fields: str, block: int = BLOCK, every: Callable[..., dict] | None = None) -> DataFrame:
    """One row for each block: keys and what ``sums`` makes of its frames, with the names and types of ``fields``.

    ``sizes``: name -> (size, hop); sums gets name -> spectra (frames by bins, complex) of each of ``columns``. ``every`` gets the
    block's own samples of each column and gives further values.
    """
    after = max((size for size, _ in sizes.values()), default=1) - 1
    rows = with_halo(blocks, keys, columns, 0, after, block)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                arrays = [np.asarray(getattr(r, c), float) for c in columns]
                spectra = {name: [np.fft.rfft(frames_of(x, 0, r.own, r.block * block, size, hop, after)[1] * hann_window(size), axis=1) for x in arrays] for name, (size, hop) in sizes.items()}
                out.append(sums(spectra) | (every(*[x[: r.own] for x in arrays]) if every else {}))
            if out:
                yield pd.concat((pdf[keys].reset_index(drop=True), pd.DataFrame(out)), axis=1)

    return rows.mapInPandas(run, f"{_schema(blocks, keys)}, {fields}")


def part_size(taps: int) -> int:
    """The block for a response of so many taps: one part where that is not too long."""
    return min(BLOCK, max(1024, 1 << (taps - 1).bit_length()))


def convolved(blocks: DataFrame, keys: list[str], response: np.ndarray, column: str = "v", block: int = BLOCK) -> DataFrame:
    """Block rows of each signal through ``response`` (a finite impulse response of any length), cut to the signal's length.

    Partitioned overlap-save: signal and response are cut into parts of ``block`` samples. A block's samples and those of the
    block before it become one spectrum, which meets the spectrum of every part of the response: part p adds to the
    output of the block p places later. So a signal makes rows by blocks times parts, whatever the taps are, and the sum of
    an output block is an inverse transform of a sum of products.
    """
    size = 2 * block
    parts = [np.fft.rfft(response[k : k + block], size) for k in range(0, len(response), block)]
    pairs = with_halo(blocks, keys, (column,), block, 0, block)
    last = blocks.groupBy(*keys).agg(F.max("block").alias("last"), F.max_by(F.size(column), "block").alias("rest"))

    def spectra(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for k, r in enumerate(pdf.itertuples(index=False)):
                x = np.zeros(size)
                x[block - r.lead : block + r.own] = getattr(r, column)
                z = np.fft.rfft(x)
                reached = range(r.block, min(r.last, r.block + len(parts) - 1) + 1)
                products = [z * parts[b - r.block] for b in reached]
                if products:
                    yield pd.DataFrame({c: [pdf[c].iloc[k]] * len(products) for c in keys} | {"block": list(reached), "re": [p.real for p in products], "im": [p.imag for p in products]})

    products = pairs.join(last.drop("rest"), keys).mapInPandas(spectra, f"{_schema(blocks, keys)}, block int, re array<double>, im array<double>")
    gathered = products.groupBy(*keys, "block").agg(F.collect_list("re").alias("re"), F.collect_list("im").alias("im")).join(last, keys)

    def added(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [np.fft.irfft(np.sum(np.stack(r.re), axis=0) + 1j * np.sum(np.stack(r.im), axis=0), size)[block : block + (r.rest if r.block == r.last else block)] for r in pdf.itertuples(index=False)]
            yield pdf[[*keys, "block"]].assign(**{column: out})

    return gathered.mapInPandas(added, f"{_schema(blocks, keys)}, block int, {column} array<double>")


def surroundings(a: DataFrame, b: DataFrame, keys: list[str], reach: int, block: int = BLOCK) -> DataFrame:
    """Blocks of a (keys, block, v, on) with near_v, near_on: the samples of b from ``reach`` before the block to ``reach`` past its end, 0 where b has none.

    Of blocks of b that are not at the same place only the part within reach is sent.
    """
    d = F.col("__d")
    at = F.when(d > 0, F.greatest(d * block - reach, F.lit(0))).otherwise(0)
    upto = F.when(d < 0, F.least(F.size("v"), block + reach + d * block)).otherwise(F.size("v"))
    sent = b.withColumn("__d", F.explode(F.sequence(*map(F.lit, (-(-reach // block) * -1, -(-reach // block))))))
    cut = lambda c: F.slice(c, at + 1, F.greatest(upto - at, F.lit(0)))
    sent = sent.select(*keys, (F.col("block") + d).alias("block"), F.struct((at - d * block + reach).alias("at"), cut("v").alias("v"), cut("on").alias("on")).alias("s")).filter("size(s.v) > 0")
    pieces = sent.groupBy(*keys, "block").agg(F.collect_list("s").alias("s"))
    pieces = pieces.select(*keys, "block", *[F.transform("s", lambda s: s[c]).alias(f"__{c}") for c in ("at", "v", "on")])  # noqa: B023
    rows = a.select(*keys, "block", "v", "on").join(pieces, [*keys, "block"], "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out: dict[str, list] = {"v": [], "on": []}
            for own, places, *sides in zip(pdf["v"], pdf["__at"], pdf["__v"], pdf["__on"]):
                for (name, near), side in zip(out.items(), sides):
                    w = np.zeros(len(own) + 2 * reach)
                    for at, x in zip(places, side) if places is not None else ():
                        x = x[: max(0, w.size - at)]
                        w[at : at + len(x)] = x
                    near.append(w)
            yield pdf[[*keys, "block", "v", "on"]].assign(near_v=out["v"], near_on=out["on"])

    return rows.mapInPandas(run, f"{_schema(a, [*keys, 'block'])}, v array<double>, on array<double>, near_v array<double>, near_on array<double>")


def array_sums(rows: DataFrame, keys: list[str], column: str, fan: int = 256) -> DataFrame:
    """keys and the sum of the arrays of ``column``, position by position, of rows that are numbered by ``block``; in two steps, so that no task gets all arrays of a long signal."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(**{column: [np.sum(np.stack(x), axis=0) for x in pdf[column]]})

    for own in ([*keys, "__part"], keys):
        rows = rows.withColumn("__part", F.expr(f"block div {fan}")) if "__part" in own else rows
        schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in own)
        rows = rows.groupBy(*own).agg(F.collect_list(column).alias(column)).mapInPandas(add, f"{schema}, {column} array<double>")
    return rows


def correlations(a: DataFrame, b: DataFrame, keys: list[str], most: int, block: int = BLOCK) -> DataFrame:
    """keys and c, whose place most + lag has the sum of a[p] b[p - lag] over the signal, and NaN where no samples meet.

    a and b are ``placed_blocks``. A block of a and its surroundings in b give all lags by one inverse transform of
    their cross-spectrum, and the blocks' arrays add up.
    """

    def cross(v: np.ndarray, w: np.ndarray) -> np.ndarray:
        size = 1 << (len(v) + len(w)).bit_length()
        circle = np.fft.irfft(np.conj(np.fft.rfft(v, size)) * np.fft.rfft(w, size), size)
        return circle[: 2 * most + 1][::-1]  # place k has v[p] w[p + k], and w begins ``most`` before v

    def both(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            c = [np.r_[cross(v, w), np.round(cross(on, near))] for v, on, w, near in zip(pdf["v"], pdf["on"], pdf["near_v"], pdf["near_on"])]
            yield pdf[[*keys, "block"]].assign(c=c)

    rows = surroundings(a, b, keys, most, block).mapInPandas(both, f"{_schema(a, keys)}, block int, c array<double>")
    lags = 2 * most + 1
    met = F.zip_with(F.slice("c", 1, lags), F.slice("c", lags + 1, lags), lambda c, n: F.when(n > 0, c).otherwise(float("nan")))
    return array_sums(rows, keys, "c").select(*keys, met.alias("c"))


class FilterBank:
    """Band-limited resampling by a Hann-windowed sinc of 2 x taps inputs: for an output between two inputs, the weights of those around it.

    A ratio of small whole numbers has as many phases as its numerator; their weights are computed once. For other ratios
    every output has a phase of its own.
    """

    def __init__(self, ratio: float, taps: int, most_phases: int = 4096):
        self.ratio, self.cut = ratio, min(1.0, ratio)
        self.reach = taps / self.cut
        self.side = math.ceil(self.reach) + 1
        near = Fraction(ratio).limit_denominator(most_phases)
        self.exact = near if near.numerator <= most_phases and abs(float(near) - ratio) <= 1e-15 * ratio else None
        self.bank = self.weights(np.arange(near.numerator) / near.numerator) if self.exact else None

    def weights(self, fraction: np.ndarray) -> np.ndarray:
        """Rows for outputs ``fraction`` past an input; columns for the inputs from 1 - side to side beside it."""
        d = fraction[:, None] - np.arange(1 - self.side, self.side + 1)
        w = self.cut * np.sinc(self.cut * d) * (0.5 + 0.5 * np.cos(np.pi * d / self.reach))
        return np.where(np.abs(d) <= self.reach, w, 0.0)

    def place(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The input at or before each output, and the output's weights."""
        if self.exact:
            at = i * self.exact.denominator
            return at // self.exact.numerator, self.bank[at % self.exact.numerator]
        x = i / self.ratio
        return np.floor(x).astype(np.int64), self.weights(x - np.floor(x))

    def outputs(self, x: np.ndarray, lead: int, own: int, start: int) -> tuple[int, np.ndarray]:
        """(number of the first, values) of the outputs at or after the inputs start .. start + own - 1; x has ``lead`` before and what there is behind."""
        if self.exact:
            first, end = (-(-k * self.exact.numerator // self.exact.denominator) for k in (start, start + own))
        else:
            first, end = (math.ceil(k * self.ratio) for k in (start, start + own))
        values = np.empty(max(0, end - first))
        padded = np.concatenate((np.zeros(self.side), x, np.zeros(self.side)))
        there = np.concatenate((np.zeros(self.side), np.ones(x.size), np.zeros(self.side)))
        for k in range(first, end, 8192):
            i = np.arange(k, min(end, k + 8192))
            base, w = self.place(i)
            at = (np.clip(base, start, start + own - 1) - start + lead + 1)[:, None] + np.arange(2 * self.side)
            values[k - first : k - first + i.size] = (padded[at] * w).sum(axis=1) / (there[at] * w).sum(axis=1)
        return first, values


def resampled(blocks: DataFrame, keys: list[str], ratio: float, taps: int = 8, block: int = BLOCK) -> DataFrame:
    """keys, first, v: the outputs of each block as an array, numbered from ``first``; a signal of n samples gets ceil(n ratio)."""
    bank = FilterBank(ratio, taps)
    rows = with_halo(blocks, keys, ("v",), bank.side, bank.side, block)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [bank.outputs(np.asarray(v, float), lead, own, number * block) for v, lead, own, number in zip(pdf["v"], pdf["lead"], pdf["own"], pdf["block"])]
            yield pdf[keys].assign(first=[o[0] for o in out], v=[o[1] for o in out])

    return rows.mapInPandas(run, f"{_schema(blocks, keys)}, first long, v array<double>")
