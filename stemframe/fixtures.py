"""Signal views over the driver's tables, in Spark and (as text) in DuckDB.

A *signal* in long form has one row per sample: key columns, ``pos`` and ``v``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stemframe.registry import table

SIG = """sig AS (SELECT CAST(label AS VARCHAR) AS track, vec_id AS model, pos, CAST(v AS DOUBLE) AS v FROM (
  SELECT label, vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings))"""

STEREO = SIG + """, stereo AS (SELECT CAST(floor(model / 2) AS BIGINT) AS track, model % 2 AS channel, pos, v FROM sig)"""

STEMS = """ev AS (SELECT user_id, event_type, date_diff('hour', TIMESTAMP '2024-01-01 00:00:00', ts) AS pos, sum(value) AS v
  FROM events GROUP BY ALL),
stems AS (SELECT u.user_id AS track, t.event_type AS stem, CAST(g.pos AS INTEGER) AS pos, coalesce(e.v, 0) AS v
  FROM (SELECT DISTINCT user_id FROM events) u CROSS JOIN (SELECT DISTINCT event_type FROM events) t
  CROSS JOIN (SELECT unnest(range(0, 720)) AS pos) g
  LEFT JOIN ev e ON e.user_id = u.user_id AND e.event_type = t.event_type AND e.pos = g.pos)"""

EVT = """evt AS (SELECT user_id AS track, event_type AS stem,
  row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1 AS pos, value AS v, ts FROM events)"""

CATALOG = """catalog AS (SELECT p_type AS model_type, CAST(p_partkey % 1500 AS INTEGER) AS id,
  concat(replace(p_name, ' ', '-'), '_', p_partkey) AS model_name,
  [split_part(p_name, ' ', 1), split_part(p_name, ' ', 2)] AS stems,
  CASE WHEN p_size % 3 = 0 THEN split_part(p_name, ' ', 1) END AS target,
  CASE WHEN p_size % 5 <> 0 THEN p_retailprice / 100 END AS sdr, p_partkey AS ord FROM part)"""

HISTORY = """history AS (SELECT o_orderkey AS job_id, CASE WHEN o_orderkey % 2 = 0 THEN 'single' ELSE 'batch' END AS kind,
  o_orderdate AS job_ts, l_linenumber AS ord, concat(l_returnflag, l_linestatus) AS stem,
  concat('/out/', o_orderkey, '/', l_linenumber, '.wav') AS path
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"""

MEDIA = """media AS (SELECT page_id,
  concat(url, '.', CASE page_id % 4 WHEN 0 THEN 'wav' WHEN 1 THEN 'mp3' WHEN 2 THEN 'flac' ELSE 'txt' END) AS path,
  CAST(page_id % 3 AS INTEGER) AS n_streams,
  CASE page_id % 4 WHEN 0 THEN 44100 WHEN 1 THEN 48000 WHEN 2 THEN 96000 ELSE 11000 END AS sr FROM pages)"""


def sig(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many estimates (``model``) of one ``track``: track, model, pos, v."""
    return table(spark, sf_dir, "embeddings").select(F.col("label").cast("string").alias("track"), F.col("vec_id").alias("model"), F.posexplode("embedding").alias("pos", "v")).withColumn("v", F.col("v").cast("double"))


def stereo(spark: SparkSession, sf_dir: str, sized: bool = False) -> DataFrame:
    """Two-channel tracks: track, channel, pos, v; ``sized``: and n, the length of the signal.

    Vectors lie by track before their samples become rows, in a fixed number of partitions, so that groupings of samples by
    track and more stay within a task's share of the tracks, however few files there are.
    """
    parts, model = int(spark.conf.get("spark.sql.shuffle.partitions")), F.col("vec_id")
    own = table(spark, sf_dir, "embeddings").select(F.floor(model / 2).cast("long").alias("track"), (model % 2).alias("channel"), "embedding").repartition(parts, "track")
    rows = own.select("track", "channel", F.posexplode("embedding").alias("pos", "v"), *([F.size("embedding").alias("n")] if sized else []))
    return rows.withColumn("v", F.col("v").cast("double"))


def stem_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aligned stems of 720 hourly samples as one row each: track, stem, samples (0 where nothing happened).

    Only what happened is exchanged, and lies by track; a stem's samples are filled in where its track lies, so that
    grouping by track and more takes no exchange of samples. The number of partitions is fixed, as AQE would judge them by
    the rows before filling.
    """
    ev = table(spark, sf_dir, "events")
    start = F.expr("TIMESTAMP_NTZ'2024-01-01 00:00:00'")
    sums = ev.groupBy(F.col("user_id").alias("track"), F.col("event_type").alias("stem"), F.timestamp_diff("HOUR", start, F.col("ts")).cast("int").alias("pos")).agg(F.sum("value").alias("v"))
    # Every track has every stem: one row with all stem names goes to the tracks, which explode it.
    names = ev.agg(F.collect_set("event_type").alias("names"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    there = F.col("track").isNotNull() & F.col("pos").between(0, 719)
    tracks = sums.repartition(parts, "track").groupBy("track").agg(F.collect_list(F.when(there, F.struct("pos", F.coalesce("v", F.lit(0.0)).alias("v"), "stem"))).alias("all"))
    own = tracks.crossJoin(F.broadcast(names)).select("track", "all", F.explode("names").alias("stem"))
    own = own.select("track", "stem", F.expr("array_sort(filter(all, x -> x.stem = stem))").alias("s"))
    return own.select("track", "stem", filled("s", "720").alias("samples"))


def filled(s: str, n: str) -> Column:
    """``n`` samples of which those in ``s``, (pos, v) in order of pos, are not zero."""
    # Zeros up to each sample that is there, the sample, and zeros behind the last one.
    return F.expr(f"""flatten(concat(transform({s}, (x, i) -> concat(array_repeat(0D, x.pos - if(i = 0, 0, {s}[i - 1].pos + 1)), array(x.v))),
        array(array_repeat(0D, {n} - if(size({s}) = 0, 0, {s}[size({s}) - 1].pos + 1)))))""")


def stems(spark: SparkSession, sf_dir: str, sized: bool = False) -> DataFrame:
    """``stem_rows`` in long form: track, stem, pos, v; ``sized``: and n, their length."""
    # Never empty, so outer only saves Spark a filter on the length.
    return stem_rows(spark, sf_dir).select("track", "stem", F.posexplode_outer("samples").alias("pos", "v"), *([F.size("samples").alias("n")] if sized else []))


def evt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Irregular series: track, stem, pos (order in time), v, ts."""
    return table(spark, sf_dir, "events").selectExpr("user_id AS track", "event_type AS stem", "row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1 AS pos", "value AS v", "ts")


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models: model_type, id (with duplicates), model_name, stems, target, sdr, ord."""
    words = F.split("p_name", " ")
    return table(spark, sf_dir, "part").select(
        F.col("p_type").alias("model_type"), (F.col("p_partkey") % 1500).cast("int").alias("id"),
        F.concat(F.translate("p_name", " ", "-"), F.lit("_"), F.col("p_partkey").cast("string")).alias("model_name"),
        F.array(words[0], words[1]).alias("stems"), F.when(F.col("p_size") % 3 == 0, words[0]).alias("target"),
        F.when(F.col("p_size") % 5 != 0, F.col("p_retailprice") / 100).alias("sdr"), F.col("p_partkey").alias("ord"))


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs and their results: job_id, kind, job_ts, ord, stem, path."""
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    return o.join(li, o.o_orderkey == li.l_orderkey).select(
        F.col("o_orderkey").alias("job_id"), F.when(F.col("o_orderkey") % 2 == 0, "single").otherwise("batch").alias("kind"),
        F.col("o_orderdate").alias("job_ts"), F.col("l_linenumber").alias("ord"), F.concat("l_returnflag", "l_linestatus").alias("stem"),
        F.concat(F.lit("/out/"), F.col("o_orderkey").cast("string"), F.lit("/"), F.col("l_linenumber").cast("string"), F.lit(".wav")).alias("path"))


def media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File inventory: page_id, path, n_streams, sr."""
    kind = F.col("page_id") % 4
    ext = F.when(kind == 0, "wav").when(kind == 1, "mp3").when(kind == 2, "flac").otherwise("txt")
    rate = F.when(kind == 0, 44100).when(kind == 1, 48000).when(kind == 2, 96000).otherwise(11000)
    return table(spark, sf_dir, "pages").select("page_id", F.concat("url", F.lit("."), ext).alias("path"), (F.col("page_id") % 3).cast("int").alias("n_streams"), rate.alias("sr"))
