"""File and stem names: templates, clean-up rules, pairs and canonical outputs, as string expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stemframe import fixtures as fx
from stemframe.functions.exprs import c
from stemframe.registry import query, table

# Forbidden characters, reserved names, stem pairs and canonical stems.
FORBIDDEN = "\\/*?:<>|&;~'`()[]$#^%!"
RESERVED = ["CON", "AUX", "COM1", "COM2", "COM3", "COM4", "LPT1", "LPT2", "LPT3", "PRN", "NUL"]
PAIRS = {"Vocals": "Instrumental", "Instrumental": "Vocals", "lead_only": "backing_only", "backing_only": "lead_only", "Primary Stem": "Secondary Stem"}
CANONICAL_STEMS = [
    "Bass", "Crowd", "Drums", "Dry", "Breath", "Echo", "Instrumental", "No Bass", "No Crowd", "No Drums", "No Dry", "No Echo",
    "No Noise", "No Other", "No Breath", "No Reverb", "No Woodwinds", "Noise", "Other", "Reverb", "Vocals", "Woodwinds", "Guitar", "Piano",
]
KEYS = ["NAME", "MODEL", "STEM", "ID"]
VOICE_KEYS = ["NAME", "MODEL", "PITCH", "F0METHOD", "DATETIME"]
LONGEST = 255


def clean_filename(name: str | Column, length: int = 240) -> Column:
    """Forbidden characters dropped, trimmed, reserved names prefixed, long names cut in the middle."""
    x = F.trim(F.translate(c(name), FORBIDDEN, ""))
    x = F.when(F.upper(x).isin(RESERVED), F.concat(F.lit("file_"), x)).otherwise(x)
    cut = F.concat(F.substring(x, 1, length // 2), F.lit("..."), F.right(x, F.lit(length // 3)))
    return F.when(F.length(x) > length, cut).otherwise(x)


def sanitize_filename(name: str | Column) -> Column:
    """Characters that paths can't hold become one underscore; dots, spaces and underscores at the ends go."""
    x = F.regexp_replace(c(name), r'[<>:"/\\|?*]', "_")
    return F.regexp_replace(F.regexp_replace(x, "_+", "_"), r"^[_. ]+|[_. ]+$", "")


def dedupe_keys(template: str | Column, keys: list[str] = KEYS) -> Column:
    """Only the first occurrence of each key stays: cut the template at each key and drop the key before later parts."""

    def once(t: Column, k: Column) -> Column:
        end = F.position(k, t) + F.length(k)
        return F.when(F.contains(t, k), F.concat(F.substring(t, F.lit(1), end - 1), F.replace(F.substring(t, end, F.length(t)), k, F.lit("")))).otherwise(t)

    # A fold keeps the expression small: each step's result is named once.
    return F.aggregate(F.array(*map(F.lit, keys)), c(template), once)


def shortened(template: Column, name: Column, values: list[tuple[str, Column]], keys: list[str]) -> Column:
    """The name cut in the middle where it leaves no room; of the other keys only the first present one counts."""
    plain = F.aggregate(F.array(*map(F.lit, keys)), template, lambda t, k: F.replace(t, k, F.lit("")))
    used = F.lit(0)
    for k, v in reversed(values):
        used = F.when(F.contains(template, F.lit(k)), F.length(v)).otherwise(used)
    free = F.lit(LONGEST) - (F.length(plain) + used)
    half = F.floor(free / 2).cast("int")
    cut = F.concat(F.substring(name, F.lit(1), half), F.lit("..."), F.right(name, half - 7))
    return F.when(F.length(name) > free - 7, cut).otherwise(name)


def render_name(template: str | Column, name: str | Column, stem: Column, model: Column, id_: Column) -> Column:
    """MODEL, STEM, ID and NAME replaced in this order; inserted text may be replaced again."""
    t, model, stem, id_ = dedupe_keys(template), c(model), c(stem), c(id_).cast("string")
    short = shortened(t, c(name), [("MODEL", model), ("STEM", stem), ("ID", id_)], KEYS)
    for k, v in (("MODEL", model), ("STEM", stem), ("ID", id_), ("NAME", short)):
        t = F.replace(t, F.lit(k), v)
    return t


def render_voice_name(template: str | Column, name: Column, model: Column, pitch: Column, method: Column, when: Column) -> Column:
    """The keys of voice outputs: MODEL, DATETIME, PITCH, F0METHOD, NAME in this order."""
    t, stamp, pitch = dedupe_keys(template, VOICE_KEYS), F.date_format(when, "yyyyMMdd_HHmmss"), c(pitch).cast("string")
    short = shortened(t, c(name), [("MODEL", c(model)), ("F0METHOD", c(method)), ("PITCH", pitch), ("DATETIME", stamp)], VOICE_KEYS)
    for k, v in (("MODEL", c(model)), ("DATETIME", stamp), ("PITCH", pitch), ("F0METHOD", c(method)), ("NAME", short)):
        t = F.replace(t, F.lit(k), v)
    return t


def secondary_stem_name(stem: str | Column) -> Column:
    """The stem's partner, else the name with or without its "No "."""
    x = F.when(F.length(c(stem)) > 0, c(stem)).otherwise(F.lit("No "))
    out = F.when(F.contains(x, F.lit("No ")), F.replace(x, F.lit("No "), F.lit(""))).otherwise(F.concat(F.lit("No "), x))
    for a, b in PAIRS.items():
        out = F.when(x == a, b).otherwise(out)
    return out


def stem_output_names(tracks: DataFrame, template: str) -> DataFrame:
    """Names of all canonical stems of every track: a track's row times a handful of stems."""
    stems = F.explode(F.array(*map(F.lit, CANONICAL_STEMS)))
    return tracks.withColumn("stem", stems).withColumn("out", render_name(F.lit(template), "name", F.col("stem"), F.col("model"), F.col("id")))


def stem_output_path(df: DataFrame, custom: DataFrame, ext: str) -> DataFrame:
    """A stem's custom name if there is one (case does not matter), else base_(stem)_model; custom has stem and name, a small dimension."""
    own = custom.select(F.lower("stem").alias("key"), sanitize_filename("name").alias("own"))
    both = df.join(own, F.lower("stem") == F.col("key"), "left")
    made = F.concat(sanitize_filename("base"), F.lit("_("), sanitize_filename("stem"), F.lit(")_"), sanitize_filename("model"))
    return both.withColumn("path", F.concat(F.coalesce("own", made), F.lit(f".{ext.lower()}"))).drop("key", "own")


def classify_inputs(df: DataFrame) -> DataFrame:
    """The last path of each role by job: reference, target, reverb, instrumental."""
    p = F.col("path")
    role = F.when(p.endswith("_(Vocals).wav"), "reference").when(p.contains("_RVC_"), "target").when(p.endswith("reverbed_stem.wav"), "reverb").when(p.endswith("_(Instrumental).wav"), "inst")
    return df.withColumn("role", role).filter("role IS NOT NULL").groupBy("job", "role").agg(F.max_by("path", "ord").alias("path"))


def score_file_name(results: DataFrame, scores: DataFrame) -> DataFrame:
    """``stem - snr=..dB - sdr=..dB.wav`` where there are scores, else ``stem.wav``."""
    both = results.join(scores, ["track", "stem"], "left")
    scored = F.format_string("%s - snr=%.2fdB - sdr=%.2fdB.wav", "stem", "snr", "sdr")
    return both.withColumn("name", F.when(F.col("snr").isNotNull(), scored).otherwise(F.concat("stem", F.lit(".wav")))).select("track", "stem", "name")


_J10 = r"""SELECT page_id, CASE WHEN length(x) > 30 THEN substr(x, 1, 15) || '...' || right(x, 10) ELSE x END AS clean, regexp_replace(regexp_replace(regexp_replace(url, '[<>:"/\\|?*]', '_', 'g'), '_+', '_', 'g'), '^[_. ]+|[_. ]+$', '', 'g') AS safe
FROM (SELECT page_id, url, CASE WHEN upper(y) IN ('CON', 'AUX', 'COM1', 'COM2', 'COM3', 'COM4', 'LPT1', 'LPT2', 'LPT3', 'PRN', 'NUL') THEN 'file_' || y ELSE y END AS x FROM (SELECT page_id, url, trim(regexp_replace(CASE WHEN page_id % 10 = 0 THEN '(nul)' ELSE url END, '[][\\/*?:<>|&;~''`()$#^%!]', '', 'g')) AS y FROM pages))"""


@query("j10_sanitize_name", _J10)
def j10(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("page_id") % 10 == 0, "(nul)").otherwise(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", clean_filename(name, 30).alias("clean"), sanitize_filename("url").alias("safe"))


@query("j9_secondary_stem_name", f"""WITH {fx.CATALOG}, s AS (SELECT ord, CASE ord % 5 WHEN 0 THEN 'Vocals' WHEN 1 THEN 'lead_only' WHEN 2 THEN 'No ' || stems[1] WHEN 3 THEN '' ELSE stems[2] END AS stem FROM catalog)
SELECT ord, CASE WHEN stem = 'Vocals' THEN 'Instrumental' WHEN stem = 'lead_only' THEN 'backing_only' WHEN stem = '' THEN '' WHEN contains(stem, 'No ') THEN replace(stem, 'No ', '') ELSE 'No ' || stem END AS secondary FROM s""")
def j9(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("ord") % 5
    stem = F.when(k == 0, "Vocals").when(k == 1, "lead_only").when(k == 2, F.concat(F.lit("No "), F.col("stems")[0])).when(k == 3, "").otherwise(F.col("stems")[1])
    return fx.catalog(spark, sf_dir).select("ord", secondary_stem_name(stem).alias("secondary"))


_LONG = "repeat(c_name, 18)"


@query("j11_render_name", f"""SELECT c_custkey, replace(replace(replace(replace('NAME_(STEM)_MODEL_ID-', 'MODEL', c_mktsegment), 'STEM', 'voc'), 'ID', c_custkey::VARCHAR),
'NAME', CASE WHEN length({_LONG}) > 255 - (6 + length(c_mktsegment)) - 7 THEN substr({_LONG}, 1, CAST(floor((255 - (6 + length(c_mktsegment))) / 2) AS BIGINT)) || '...' || right({_LONG}, CAST(floor((255 - (6 + length(c_mktsegment))) / 2) AS BIGINT) - 7) ELSE {_LONG} END) AS name FROM customer""")
def j11(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.repeat("c_name", F.lit(18))
    return table(spark, sf_dir, "customer").select("c_custkey", render_name(F.lit("NAME_(STEM)_MODEL_ID-STEM"), name, F.lit("voc"), F.col("c_mktsegment"), F.col("c_custkey")).alias("name"))


@query("j12_render_voice_name", "SELECT o_orderkey, replace(replace(replace('MODEL-PITCH-DATETIME', 'MODEL', 'm' || o_custkey), 'DATETIME', strftime(o_orderdate, '%Y%m%d_%H%M%S')), 'PITCH', (o_orderkey % 12)::VARCHAR) AS name FROM orders")
def j12(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", render_voice_name(F.lit("MODEL-PITCH-DATETIMEPITCH"), F.lit("x"), F.concat(F.lit("m"), F.col("o_custkey").cast("string")), F.col("o_orderkey") % 12, F.lit("rmvpe"), F.col("o_orderdate")).alias("name"))


@query("j13_stem_output_names", """SELECT c_custkey AS id, stem, c_name || '_' || stem AS out FROM customer CROSS JOIN (SELECT unnest(['Vocals', 'Instrumental', 'Drums', 'Bass', 'Guitar', 'Piano', 'Other', 'Crowd', 'Dry', 'Breath', 'Echo', 'Noise', 'Reverb', 'Woodwinds']) AS stem
UNION ALL SELECT 'No ' || unnest(['Bass', 'Crowd', 'Drums', 'Dry', 'Echo', 'Noise', 'Other', 'Breath', 'Reverb', 'Woodwinds']))""")
def j13(spark: SparkSession, sf_dir: str) -> DataFrame:
    tracks = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.lit("m").alias("model"))
    return stem_output_names(tracks, "NAME_STEM").select("id", "stem", "out")


@query("j14_stem_output_path", """SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'my_lead.flac' ELSE replace(c_name, '#', '#') || '_(' || 'Drums' || ')_' || c_mktsegment || '.flac' END AS path FROM customer""")
def j14(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("base"), F.when(F.col("c_custkey") % 2 == 0, "VOCALS").otherwise("Drums").alias("stem"), F.col("c_mktsegment").alias("model"))
    custom = spark.createDataFrame([("vocals", "my:lead_")], "stem string, name string")
    return stem_output_path(df, custom, "FLAC").select("c_custkey", "path")


@query("j25_classify_inputs", """WITH p AS (SELECT l_orderkey AS job, l_linenumber AS ord, l_linenumber || CASE l_linenumber % 4 WHEN 0 THEN '_(Vocals).wav' WHEN 1 THEN '_RVC_x.wav' WHEN 2 THEN 'reverbed_stem.wav' ELSE '_(Instrumental).wav' END AS path FROM lineitem)
SELECT job, CASE WHEN path LIKE '%\\_(Vocals).wav' ESCAPE '\\' THEN 'reference' WHEN path LIKE '%\\_RVC\\_%' ESCAPE '\\' THEN 'target' WHEN path LIKE '%reverbed\\_stem.wav' ESCAPE '\\' THEN 'reverb' ELSE 'inst' END AS role, arg_max(path, ord) AS path FROM p GROUP BY 1, 2""")
def j25(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("l_linenumber") % 4
    tail = F.when(k == 0, "_(Vocals).wav").when(k == 1, "_RVC_x.wav").when(k == 2, "reverbed_stem.wav").otherwise("_(Instrumental).wav")
    return classify_inputs(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("job"), F.col("l_linenumber").alias("ord"), F.concat(F.col("l_linenumber").cast("string"), tail).alias("path")))


@query("j26_score_file_name", f"""WITH {fx.HISTORY} SELECT DISTINCT job_id AS track, stem, CASE WHEN job_id % 3 = 0 THEN stem || ' - snr=' || printf('%.2f', job_id / 7.0) || 'dB - sdr=' || printf('%.2f', job_id / 3.1) || 'dB.wav' ELSE stem || '.wav' END AS name FROM history""")
def j26(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = fx.history(spark, sf_dir).select(F.col("job_id").alias("track"), "stem").distinct()
    scores = r.filter("track % 3 = 0").select("track", "stem", (F.col("track") / 7.0).alias("snr"), (F.col("track") / 3.1).alias("sdr"))
    return score_file_name(r, scores)
