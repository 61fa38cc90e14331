"""User functions: any callable on chunk arrays, and framing for SQL users."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from stemframe import fixtures as fx
from stemframe.operators.frames import frame
from stemframe.registry import query

Model = Callable[[np.ndarray], dict[str, np.ndarray]]


def chunk_arrays(df: DataFrame, keys: list[str], size: int, hop: int) -> DataFrame:
    """keys, chunk, last (chunk), samples: one row per chunk, the last one short."""
    framed = frame(df, keys, size, hop)
    return framed.groupBy(*keys, "chunk", "last").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias("samples"))


#: Weights of the n samples of a chunk of ``size``: weight(n, size, first chunk, last chunk).
SCHEMES: dict[str, Callable[[int, int, bool, bool], np.ndarray]] = {
    "average": lambda n, size, first, last: np.ones(n),
    "triangle": lambda n, size, first, last: np.minimum(np.arange(n) + 1, size - np.arange(n)) / max(size // 2, 1),
    "hamming": lambda n, size, first, last: 0.54 - 0.46 * np.cos(2 * np.pi * np.arange(n) / max(size - 1, 1)),
    "hann": lambda n, size, first, last: 0.5 - 0.5 * np.cos(2 * np.pi * (np.arange(n) + 0.5) / size),
    "fade": lambda n, size, first, last: np.minimum(np.where(first, 1.0, np.minimum(1, np.arange(n) / max(size // 10 - 1, 1))), np.where(last, 1.0, np.minimum(1, (size - 1 - np.arange(n)) / max(size // 10 - 1, 1)))),
}


def apply_model(df: DataFrame, keys: list[str], model_fn: Model, size: int, hop: int, scheme: str = "average") -> DataFrame:
    """Run ``model_fn`` (array to stems) on every chunk and overlap-add the results: keys, stem, pos, v.

    ``scheme`` names the weights by which overlapping chunks are averaged. Chunks are rows of Arrow batches; the
    function travels once per worker and sees one chunk at a time. A sample that all weights leave out is 0.
    """
    rows = chunk_arrays(df, keys, size, hop)
    weight = SCHEMES[scheme]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                w = weight(len(row.samples), size, row.chunk == 0, row.chunk == row.last)
                for stem, v in model_fn(np.asarray(row.samples, float)).items():
                    out.append((*[getattr(row, k) for k in keys], row.chunk, stem, w * np.asarray(v, float), w))
            yield pd.DataFrame(out, columns=[*keys, "chunk", "stem", "samples", "weights"])

    types = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    stems = rows.mapInPandas(run, f"{types}, chunk int, stem string, samples array<double>, weights array<double>")
    flat = stems.select(*keys, "stem", "chunk", F.posexplode(F.arrays_zip("samples", "weights")).alias("i", "x"))
    sums = flat.groupBy(*keys, "stem", (F.col("chunk") * hop + F.col("i")).alias("pos")).agg(F.sum("x.samples").alias("v"), F.sum("x.weights").alias("w"))
    return sums.select(*keys, "stem", "pos", F.when(F.col("w") != 0, F.col("v") / F.col("w")).otherwise(0.0).alias("v"))


@udtf(returnType="chunk int, i int, v double")
class FrameSamples:
    """SELECT ... LATERAL frame_samples(samples, size, hop): the chunk rows of one array."""

    def eval(self, samples: list, size: int, hop: int):
        for chunk, start in enumerate(range(0, len(samples), hop)):
            for i, v in enumerate(samples[start : start + size]):
                yield chunk, i, float(v)


def halves(x: np.ndarray) -> dict[str, np.ndarray]:
    """A test model: two stems that add up to the input, the first one rising over the chunk."""
    a = 0.25 * x * (1 + np.arange(x.size) / 24)
    return {"a": a, "b": x - a}


_U1 = "SELECT track, model, pos, v, pos - k * 12 AS i, k FROM sig JOIN (SELECT unnest(range(0, 6)) AS k) ON pos >= k * 12 AND pos < k * 12 + 24"


@query("u1_apply_model", f"""WITH {fx.SIG}, c AS ({_U1}), w AS (SELECT *, least(i + 1, 24 - i) / 12.0 AS w, 0.25 * v * (1 + i / 24.0) AS a FROM c)
SELECT track, model, pos, stem, round(CASE stem WHEN 'a' THEN a ELSE b END, 6) + 0.0 AS v FROM (SELECT track, model, pos, sum(w * a) / sum(w) AS a, sum(w * (v - a)) / sum(w) AS b FROM w GROUP BY ALL) CROSS JOIN (VALUES ('a'), ('b')) n(stem)""")
def u1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_model(fx.sig(spark, sf_dir), ["track", "model"], halves, 24, 12, "triangle").withColumn("v", F.round("v", 6) + 0.0)


@query("u4_frame_udtf", "WITH s AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS pos, unnest(embedding)::DOUBLE AS v FROM embeddings) SELECT vec_id, CAST(chunk AS INTEGER) AS chunk, CAST(pos - chunk * 16 AS INTEGER) AS i, round(v, 6) AS v FROM s JOIN (SELECT unnest(range(0, 4)) AS chunk) c ON pos >= chunk * 16 AND pos < chunk * 16 + 24")
def u4(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.udtf.register("frame_samples", FrameSamples)
    from stemframe.registry import table

    e = table(spark, sf_dir, "embeddings")
    return spark.sql("SELECT vec_id, chunk, i, round(v, 6) AS v FROM {e}, LATERAL frame_samples(embedding, 24, 16)", e=e)
