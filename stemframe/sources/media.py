"""File inventories: which files are media, and what rates their formats allow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stemframe import fixtures as fx
from stemframe.registry import query, table

# Extensions, sample rates by format (in order of preference), bit rates.
EXTENSIONS = ["mp3", "wav", "flac", "ogg", "opus", "m4a", "aac", "ac3", "aiff"]
RATES = {
    "mp3": [44100, 48000, 32000, 22050, 24000, 16000, 11025, 12000, 8000],
    "opus": [48000, 24000, 16000, 12000, 8000],
    "m4a": [96000, 88200, 64000, 48000, 44100, 32000, 24000, 22050, 16000, 12000, 11025, 8000, 7350],
    "aac": [96000, 88200, 64000, 48000, 44100, 32000, 24000, 22050, 16000, 12000, 11025, 8000, 7350],
    "ac3": [48000, 44100, 32000],
}
RANGES = {"ogg": (6, 192000), "wav": (0, None), "aiff": (0, None), "flac": (0, 192000)}


def extension(path: str | Column) -> Column:
    return F.element_at(F.split(path, r"\."), -1)


def filter_media(df: DataFrame) -> DataFrame:
    """Files with an allowed extension (case matters) and at least one stream."""
    return df.filter(extension("path").isin(EXTENSIONS) & (F.col("n_streams") > 0))


def fit_sample_rate(fmt: str | Column, rate: str | Column) -> Column:
    """The nearest rate the format allows (the first listed wins ties), within its range, or null for an unknown format."""
    f, r = F.lower(F.col(fmt) if isinstance(fmt, str) else fmt), F.col(rate) if isinstance(rate, str) else rate
    out = F.lit(None).cast("int")
    for name, rates in RATES.items():
        near = F.array_min(F.transform(F.array(*map(F.lit, rates)), lambda x, i: F.struct(F.abs(x - r).alias("d"), i.alias("i"), x.alias("x"))))["x"]
        out = F.when(f == name, near).otherwise(out)
    for name, (lo, hi) in RANGES.items():
        fit = F.greatest(r, F.lit(lo))
        out = F.when(f == name, F.least(fit, F.lit(hi)) if hi else fit).otherwise(out)
    return out.cast("int")


def fit_bitrate(rate: str | Column, low: int, high: int) -> Column:
    """Bit rates like 320k as numbers within [low, high]."""
    r = F.regexp_replace(F.col(rate) if isinstance(rate, str) else rate, "[kK]", "").cast("int")
    return F.least(F.greatest(r, F.lit(low)), F.lit(high))


def sample_rate_audit(df: DataFrame, keys: list[str]) -> DataFrame:
    """How many rates there are, the least, and whether all agree."""
    return df.groupBy(*keys).agg(F.count_distinct("sr").alias("rates"), F.min("sr").alias("least")).withColumn("agree", F.col("rates") == 1)


def zip_manifest(df: DataFrame) -> DataFrame:
    """Archive names: the stem with the file's own extension, for files that exist."""
    return df.filter("path IS NOT NULL").withColumn("name", F.concat("stem", F.regexp_extract("path", r"(\.[^.]*)$", 1)))


@query("a3_filter_media", f"WITH {fx.MEDIA} SELECT page_id, path FROM media WHERE list_last(string_split(path, '.')) IN ('mp3', 'wav', 'flac', 'ogg', 'opus', 'm4a', 'aac', 'ac3', 'aiff') AND n_streams > 0")
def a3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_media(fx.media(spark, sf_dir)).select("page_id", "path")


# The rates by format, in order of preference, beside each rate its rank.
_A6 = """r(f, x, turn) AS (SELECT 'mp3', unnest([44100, 48000, 32000, 22050, 24000, 16000, 11025, 12000, 8000]), unnest(range(0, 9)) UNION ALL SELECT 'opus', unnest([48000, 24000, 16000, 12000, 8000]), unnest(range(0, 5))
UNION ALL SELECT unnest(['m4a', 'aac']), x, turn FROM (SELECT unnest([96000, 88200, 64000, 48000, 44100, 32000, 24000, 22050, 16000, 12000, 11025, 8000, 7350]) AS x, unnest(range(0, 13)) AS turn) UNION ALL SELECT 'ac3', unnest([48000, 44100, 32000]), unnest(range(0, 3)))"""


@query("a6_fit_sample_rate", f"""WITH p AS (SELECT p_partkey, ['mp3', 'OPUS', 'm4a', 'ac3', 'ogg', 'wav', 'flac', 'xyz', 'aac', 'AIFF'][p_partkey % 10 + 1] AS fmt, CAST(p_partkey * 131 % 250000 AS INTEGER) AS rate FROM part), {_A6},
n AS (SELECT p_partkey, arg_min(x, (abs(x - rate), turn)) AS x FROM p JOIN r ON f = lower(fmt) GROUP BY p_partkey)
SELECT p_partkey, fmt, CAST(CASE lower(fmt) WHEN 'ogg' THEN least(greatest(rate, 6), 192000) WHEN 'flac' THEN least(rate, 192000) WHEN 'wav' THEN rate WHEN 'aiff' THEN rate ELSE x END AS INTEGER) AS rate FROM p LEFT JOIN n USING (p_partkey)""")
def a6(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*map(F.lit, ["mp3", "OPUS", "m4a", "ac3", "ogg", "wav", "flac", "xyz", "aac", "AIFF"]))
    df = table(spark, sf_dir, "part").select("p_partkey", F.get(names, (F.col("p_partkey") % 10).cast("int")).alias("fmt"), (F.col("p_partkey") * 131 % 250000).cast("int").alias("r"))
    return df.select("p_partkey", "fmt", fit_sample_rate("fmt", "r").alias("rate"))


@query("a7_fit_bitrate", "SELECT p_partkey, CAST(least(greatest(p_size * 10, 32), 320) AS INTEGER) AS br FROM part")
def a7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", fit_bitrate(F.concat((F.col("p_size") * 10).cast("string"), F.lit("k")), 32, 320).alias("br"))


@query("a10_sample_rate_audit", f"WITH {fx.MEDIA} SELECT n_streams, count(DISTINCT sr) AS rates, min(sr) AS least, count(DISTINCT sr) = 1 AS agree FROM media GROUP BY n_streams")
def a10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample_rate_audit(fx.media(spark, sf_dir), ["n_streams"])


@query("a11_results_zip_manifest", f"WITH {fx.HISTORY} SELECT job_id, ord, stem || regexp_extract(path, '(\\.[^.]*)$', 1) AS name FROM history WHERE ord % 2 = 0")
def a11(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = fx.history(spark, sf_dir).withColumn("path", F.when(F.col("ord") % 2 == 0, F.col("path")))
    return zip_manifest(h).select("job_id", "ord", "name")
