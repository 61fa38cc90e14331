"""Recursive filters as block jobs.

A recursion along a track can't be split, but its impulse response has decayed below any tolerance after a number
of samples that follows from its poles. So a track is cut into blocks with a halo of that length, and each block
is a row that numpy convolves with the response by itself.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemframe.operators.frames import with_length

#: (b0, b1, b2, a1, a2) of second-order sections, one after another.
Sections = list[tuple[float, float, float, float, float]]


def butterworth_highpass(order: int, cutoff: float, rate: float) -> Sections:
    """Sections of a Butterworth high-pass by the bilinear transform; unit gain at half the rate."""
    warped = math.tan(math.pi * cutoff / rate)
    found: Sections = []
    for k in range((order + 1) // 2):
        angle = math.pi * (2 * k + 1) / (2 * order)  # of the pole from the imaginary axis
        if 2 * k + 1 == order:
            gain = 1 / (1 + warped)
            found.append((gain, -gain, 0.0, (warped - 1) / (warped + 1), 0.0))
            continue
        damp = 2 * math.sin(angle) * warped
        base = 1 + damp + warped * warped
        found.append((1 / base, -2 / base, 1 / base, 2 * (warped * warped - 1) / base, (1 - damp + warped * warped) / base))
    return found


def k_weighting(rate: float) -> Sections:
    """The shelf of 4 dB above 1500 Hz and the high-pass at 38 Hz by which loudness is weighted."""

    def normal(b0, b1, b2, a0, a1, a2):
        return b0 / a0, b1 / a0, b2 / a0, a1 / a0, a2 / a0

    a, w = 10 ** (4 / 40), 2 * math.pi * 1500 / rate
    c, alpha = math.cos(w), math.sin(w) / math.sqrt(2)
    root = 2 * math.sqrt(a) * alpha
    shelf = normal(a * (a + 1 + (a - 1) * c + root), -2 * a * (a - 1 + (a + 1) * c), a * (a + 1 + (a - 1) * c - root), a + 1 - (a - 1) * c + root, 2 * (a - 1 - (a + 1) * c), a + 1 - (a - 1) * c - root)
    w = 2 * math.pi * 38 / rate
    c, alpha = math.cos(w), math.sin(w)  # Q of a half
    return [shelf, normal((1 + c) / 2, -(1 + c), (1 + c) / 2, 1 + alpha, -2 * c, 1 - alpha)]


def impulse_response(sections: Sections, tolerance: float = 1e-10) -> np.ndarray:
    """The response up to where the slowest pole has decayed to ``tolerance``."""
    radius = max(abs(p) for _, _, _, a1, a2 in sections for p in np.roots([1, a1, a2]))
    h = np.zeros(max(8, math.ceil(math.log(tolerance) / math.log(radius))) + 1)
    h[0] = 1
    for b0, b1, b2, a1, a2 in sections:
        x1 = x2 = y1 = y2 = 0.0
        for n, x in enumerate(h.tolist()):
            y = b0 * x + b1 * x1 + b2 * x2 - a1 * y1 - a2 * y2
            x1, x2, y1, y2 = x, x1, y, y1
            h[n] = y
    return h


def _convolved(x: np.ndarray, h: np.ndarray, before: float) -> np.ndarray:
    """x through h, as if ``before`` had stood in front of it for ever."""
    padded = np.concatenate((np.full(h.size - 1, before), x))
    n = padded.size + h.size
    return np.fft.irfft(np.fft.rfft(padded, n) * np.fft.rfft(h, n), n)[h.size - 1 : padded.size]


def filtered(df: DataFrame, keys: list[str], sections: Sections, zero_phase: bool = False, block: int | None = None) -> DataFrame:
    """A long-form signal (keys, pos from 0, v) through a filter.

    Forwards only it starts from rest. With ``zero_phase`` it runs forwards and then backwards: the ends are
    continued by odd reflection and the filter starts as if its first value had lasted for ever, at both ends.
    """
    h = impulse_response(sections)
    reach, odd = h.size - 1, 3 * (2 * len(sections) - sum(s[2] == s[4] == 0 for s in sections) + 1)
    ahead = reach + odd if zero_phase else 0
    block = block or max(4 * reach, 8192)
    pos = F.col("pos")
    near = F.sequence(F.greatest(F.floor((pos - ahead) / block), F.lit(0)), F.floor((pos + reach + odd) / block))
    cut = with_length(df.select(*keys, "pos", "v"), keys).withColumn("__block", F.explode(near)).filter(F.col("__block") * block < F.col("n"))
    rows = cut.groupBy(*keys, "__block").agg(F.max("n").alias("__n"), F.array_sort(F.collect_list(F.struct(pos.cast("long").alias("p"), F.col("v").cast("double").alias("x")))).alias("__s"))
    rows = rows.select(*keys, "__block", "__n", F.transform("__s", lambda s: s["x"]).alias("__x"), F.col("__s")[0]["p"].alias("__from"))

    def one(x: np.ndarray, start: int, n: int, at: int) -> np.ndarray:
        """Outputs of the block from ``at``; x are the samples from ``start``, to the end of the signal or past the halo."""
        size = min(block, n - at)
        if not zero_phase:
            return _convolved(x, h, 0.0)[at - start : at - start + size]
        lead = 0
        if start == 0:
            lead = min(odd, x.size - 1)
            x = np.concatenate((2 * x[0] - x[lead:0:-1], x))
        if start + x.size - lead == n:
            tail = min(odd, n - 1)
            x = np.concatenate((x, 2 * x[-1] - x[-2 : -tail - 2 : -1]))
        y = _convolved(x, h, x[0])
        return _convolved(y[::-1], h, y[-1])[::-1][lead + at - start : lead + at - start + size]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [one(np.asarray(x, float), s, n, b * block) for x, s, n, b in zip(pdf["__x"], pdf["__from"], pdf["__n"], pdf["__block"])]
            yield pdf[keys].assign(__at=pdf["__block"] * block, __y=out)

    types = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    flat = rows.mapInPandas(run, f"{types}, __at long, __y array<double>").select(*keys, "__at", F.posexplode("__y").alias("__i", "v"))
    return flat.select(*keys, (F.col("__at") + F.col("__i")).cast(df.schema["pos"].dataType).alias("pos"), "v")
