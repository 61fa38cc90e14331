"""Queries that once did a part of the job, against SQL or brute force over all of it, at the smallest scale."""

import datetime
import numpy as np
import pytest
from pyspark.sql import functions as F

from stemframe import catalogue
from stemframe import fixtures as fx
from stemframe.functions.exprs import seeded_sql
from stemframe.operators import dataset, frames, pitch
from stemframe.operators.bands import ESPEC
from stemframe.operators.pair import PAIR
from stemframe.streaming import jobs
from tests.oracle import connect, rows_of, rows_sql

SF = "/root/testdata/sf0.001"
NO = "t AS (SELECT track, row_number() OVER (ORDER BY track) - 1 AS no FROM (SELECT DISTINCT track FROM stems))"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def rows(spark, name):
    return rows_of(catalogue.queries()[name](spark, SF))


def near(got, want, tolerance=2e-5):
    """Equal keys in equal order, and v within the last digit that is kept."""
    at, keys = got[0].index("v"), lambda r: [(*x[:at], *x[at + 1 :]) for x in r]
    got, want = (sorted(r[1], key=lambda x: keys([x])) for r in (got, want))
    assert keys(got) == keys(want)
    assert all(abs(a[at] - b[at]) <= tolerance for a, b in zip(got, want))


def test_remix_takes_whole_tracks_and_draws_from_all_segments(spark, con):
    r = lambda s: seeded_sql(s, "seg", "stem")
    want = rows_sql(con, f"""WITH {fx.STEMS}, c AS (SELECT track, stem, pos // 48 AS chunk, pos % 48 AS i, v FROM stems), t AS (SELECT track, chunk, row_number() OVER (ORDER BY track, chunk) - 1 AS seg FROM (SELECT DISTINCT track, chunk FROM c)),
    g AS (SELECT seg, stem, i, v FROM c JOIN t USING (track, chunk)), p AS (SELECT seg, stem, CASE WHEN stem <> 'click' AND {r("mixs")} < 0.5 THEN CAST(floor({r("mixt")} * (SELECT count(*) FROM t)) AS BIGINT) ELSE seg END AS source,
    CASE WHEN stem = 'click' THEN 1 WHEN {r("mixd")} < 0.1 THEN 0 ELSE pow(10, ({r("mixg")} * 20 - 10) / 20) END AS gain FROM (SELECT DISTINCT seg, stem FROM g)),
    m AS (SELECT p.seg, g.i, sum(g.v * gain) AS v FROM p JOIN g ON g.seg = p.source AND g.stem = p.stem GROUP BY ALL), k AS (SELECT *, max(abs(v)) OVER (PARTITION BY seg) AS pk FROM m)
    SELECT seg, i, round(CASE WHEN pk > 1 THEN v / pk ELSE v END, 5) AS v FROM k""")
    assert len(want[1]) == 15 * 720
    near(rows(spark, "h7_remix_augment"), want)


def test_numbers_follow_the_order_at_any_count_of_ranges(spark):
    df = spark.createDataFrame([(x * 7 % 101, x) for x in range(101)] * 2, "track long, other long")
    for ranges in (1, 5, 256):
        assert sorted((r.no, r.track) for r in dataset.numbered(df, "track", ranges=ranges).collect()) == [(x, x) for x in range(101)]


def test_oversampling_covers_every_track(spark, con):
    want = rows_sql(con, f"WITH {fx.STEMS}, {NO} SELECT i, no, track FROM (SELECT unnest(range(0, (SELECT count(*) * 5 // 2 FROM t))) AS i) JOIN t ON no = i % (SELECT count(*) FROM t)")
    assert len(want[1]) == 37 and rows(spark, "h8_oversample_cycle") == want
    many = spark.range(1500).select(F.col("id").alias("track"), F.col("id").alias("no"))
    assert dataset.oversample_cycle(many, F.expr("n * 2")).select("track").distinct().count() == 1500
    assert {(r.i, r.no) for r in dataset.oversample_cycle(many, 4).collect()} == {(x, x) for x in range(4)}


def test_random_chunks_follow_tracks_and_lengths(spark, con):
    want = rows_sql(con, f"""WITH {fx.STEMS}, {NO}, n AS (SELECT track, max(pos) + 1 AS n FROM stems GROUP BY track), p AS (SELECT item, track, CAST(floor({seeded_sql("chunk", "item")} * (n - 100)) AS INTEGER) AS start FROM (SELECT unnest(range(0, (SELECT count(*) * 5 // 2 FROM t))) AS item) JOIN t ON no = item % (SELECT count(*) FROM t) JOIN n USING (track))
    SELECT item, track, stem, start, count(*) AS n, round(sum(v), 4) AS s FROM p JOIN stems USING (track) WHERE pos >= start AND pos < start + 100 GROUP BY ALL""")
    assert rows(spark, "h6_random_chunks") == want
    signal = spark.createDataFrame([(t, "a", i, 1.0) for t, n in ((0, 50), (1, 400)) for i in range(n)], "track long, stem string, pos int, v double")
    got = dataset.random_chunks(signal, dataset.numbered(signal, "track"), 200, 40).groupBy("item", "track").agg(F.count("*").alias("n"), F.max("start").alias("start")).collect()
    assert len(got) == 200 and {r.n for r in got} == {40}
    assert max(r.start for r in got if r.track == 0) <= 10 and max(r.start for r in got if r.track == 1) > 300


def test_deterministic_chunks_reach_the_end_of_each_track(spark, con):
    want = rows_sql(con, f"""WITH {fx.STEMS}, {NO}, n AS (SELECT track, max(pos) + 1 AS n FROM stems GROUP BY track), k AS (SELECT track, unnest(range(0, CAST(floor((n - 100) / 60) AS BIGINT))) AS chunk FROM n)
    SELECT chunk * (SELECT count(*) FROM t) + no AS item, track, stem, count(*) AS n, round(sum(v), 4) AS s FROM stems JOIN t USING (track) JOIN k USING (track) WHERE pos >= chunk * 60 AND pos < chunk * 60 + 100 GROUP BY ALL""")
    assert len(want[1]) == 15 * 10 * 5 and rows(spark, "h5_deterministic_chunks") == want


def test_upsampling_keeps_each_series_to_its_own_length(spark, con):
    want = rows_sql(con, f"WITH {fx.EVT} SELECT track, stem, pos * 2 + h AS pos, v FROM evt CROSS JOIN (SELECT unnest([0, 1]) AS h)")
    assert max(r[want[0].index("pos")] for r in want[1]) > 25 and rows(spark, "g10_upsample_features") == want
    series = spark.createDataFrame([(t, i, float(i)) for t in (0, 1) for i in range(5)], "track long, pos int, v double")
    got = pitch.upsample_features(series, ["track"], spark.createDataFrame([(0, 7), (1, 100)], "track long, frames int"))
    assert sorted((r.track, r.pos, r.v) for r in got.collect()) == [(t, i, float(i // 2)) for t, n in ((0, 7), (1, 10)) for i in range(n)]


def test_voice_registry_numbers_every_file(spark, con):
    want = rows_sql(con, """WITH f AS (SELECT 'v' || (l_orderkey % 300) AS voice, l_orderkey || '_' || l_linenumber || CASE WHEN l_linenumber % 2 = 0 THEN '.pth' ELSE '.index' END AS path, CAST(l_quantity * 1000000 AS BIGINT) AS size FROM lineitem),
    k AS (SELECT *, CASE WHEN path LIKE '%.index' AND size > 102400 THEN 'index' WHEN path LIKE '%.pth' AND size > 20971520 THEN 'weights' END AS kind FROM f), t AS (SELECT *, row_number() OVER (PARTITION BY voice, kind ORDER BY path) AS turn FROM k WHERE kind IS NOT NULL)
    SELECT voice, kind, CASE WHEN turn = 1 THEN voice ELSE voice || '_' || (turn - 1) END AS name, path FROM t""")
    assert len(want[1]) > 4000 and rows(spark, "j21_voice_registry") == want


def test_lookup_of_every_id(spark, con):
    want = rows_sql(con, f"WITH {fx.CATALOG}, b AS (SELECT id, max(model_type) AS model_type FROM catalog GROUP BY id) SELECT id, model_type, min(model_name) AS model_name FROM catalog JOIN b USING (id, model_type) GROUP BY ALL")
    assert len(want[1]) == 200 and rows(spark, "j4_catalog_lookup_id") == want


def test_to_stereo_takes_every_model(spark, con):
    want = rows_sql(con, f"""WITH {fx.SIG}, q AS (SELECT model // 6 * 3 + CASE WHEN model % 6 = 0 THEN 0 WHEN model % 6 < 3 THEN 1 ELSE 2 END AS track, CASE WHEN model % 6 = 0 THEN 0 WHEN model % 6 < 3 THEN model % 6 - 1 ELSE model % 6 - 3 END AS channel, pos, v FROM sig),
    n AS (SELECT *, max(channel) OVER (PARTITION BY track) AS top FROM q)
    SELECT track, pos, channel, round(v, 6) AS v FROM (SELECT track, pos, v, unnest(CASE WHEN top = 0 THEN [0, 1] ELSE [CAST(channel AS INTEGER)] END) AS channel FROM n) WHERE channel < 2""")
    # 500 models: 84 tracks of one channel, 84 of two (the table ends within the last), 83 of three.
    assert len({r[want[0].index("track")] for r in want[1]}) == 84 + 84 + 83 and rows(spark, "b8_to_stereo") == want


def test_knn_searches_all_vectors_but_the_query(spark, con):
    table = con.execute("SELECT vec_id, embedding FROM embeddings ORDER BY vec_id").fetchall()
    ids, x = np.array([r[0] for r in table]), np.array([r[1] for r in table], float)
    want = {}
    for q in np.flatnonzero(ids % 10 == 0):
        d = ((x - x[q]) ** 2).sum(axis=1)
        d[q] = np.inf
        top = np.lexsort((ids, d))[:8]
        w = (d[top] == 0).astype(float) if (d[top] == 0).any() else 1 / d[top] ** 2
        want[int(ids[q])] = 0.75 * (w[:, None] * x[top]).sum(axis=0) / w.sum() + 0.25 * x[q]
    got = catalogue.queries()["g8_knn_blend"](spark, SF).collect()
    assert {(r.query, r.dim) for r in got} == {(q, i) for q in want for i in range(64)} and len(got) == 64 * len(want)
    assert all(abs(r.v - want[r.query][r.dim]) <= 1e-4 for r in got)


def test_stream_overlap_add_equals_the_batch_form_to_the_end(spark):
    signal = fx.sig(spark, SF).select(F.col("model").alias("track"), "pos", "v")
    batch = frames.overlap_add_fade(signal, ["track"], 32, 16)
    want = {(r.track, r.pos): r.v for r in batch.collect()}
    got = catalogue.queries()["s4_stream_overlap_add"](spark, SF).collect()
    assert len(got) == len(want) == 500 * 64
    assert all(abs(want[r.track, r.pos] - r.v) <= 1e-5 for r in got)


def test_stream_overlap_add_flushes_at_the_end_of_a_track(spark, tmp_path):
    """Chunks come in files, each a batch. Track 1 is ended by a row, track 2 by its timer, track 3 not yet."""
    schema = "track long, start long, samples array<double>, ts timestamp"
    at = lambda minute: datetime.datetime(2024, 1, 1, 0, minute)
    parts = [
        [(1, 0, [2.0] * 4, at(0)), (2, 0, [1.0] * 4, at(0))],
        [(1, 2, [4.0] * 4, at(1))],
        [(1, 6, None, at(2)), (2, 2, [1.0] * 4, at(2))],
        [(3, 0, [5.0] * 4, at(30))],
        [(3, 2, [7.0] * 4, at(31))],
    ]
    for i, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    got = sorted((r.track, r.pos, r.v) for r in jobs.drained(jobs.overlap_add_stream(stream, "1 minute", 300_000)).collect())
    assert got == [(1, i, v) for i, v in enumerate([2.0, 2.0, 3.0, 3.0, 4.0, 4.0])] + [(2, i, 1.0) for i in range(6)] + [(3, 0, 5.0), (3, 1, 5.0)]


def test_stream_overlap_add_goes_on_after_a_restart(spark, tmp_path):
    """The query is stopped between batches and started again from its checkpoint."""
    schema = "track long, start long, samples array<double>, ts timestamp"
    where = str(tmp_path / "query")
    for i in range(3):
        part = [(t, 2 * i, [float(10 * t + i)] * 4, datetime.datetime(2024, 1, 1, 0, i)) for t in range(4)]
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
        stream = jobs.overlap_add_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*"), "1 minute", 600_000)
        jobs._run(stream, where)
    got = sorted((r.track, r.pos, r.v) for r in spark.read.parquet(f"{where}/out").collect())
    assert got == [(t, p, 10 * t + (0.0 if p < 2 else 0.5)) for t in range(4) for p in range(4)]


def test_median_of_every_bin(spark, con):
    want = rows_sql(con, f"""WITH {ESPEC}, r AS (SELECT *, row_number() OVER (PARTITION BY song, frame, bin ORDER BY re, im, model) AS turn, count(*) OVER (PARTITION BY song, frame, bin) AS n FROM spec)
    SELECT song, frame, bin, round(avg(re), 5) + 0.0 AS re, round(avg(im), 5) + 0.0 AS im FROM r WHERE turn IN (floor((n + 1) / 2), floor((n + 2) / 2)) GROUP BY song, frame, bin""")
    assert {r[want[0].index("bin")] for r in want[1]} == set(range(9)) and rows(spark, "f6_ensemble_median_fft") == want


def test_inverse_returns_every_position(spark, con):
    """All samples of the input but the first, where the window is 0 and the inverse has nothing to go by."""
    want = rows_sql(con, f"WITH {fx.STEREO} SELECT track, channel, pos, CASE WHEN pos = 0 THEN 0 ELSE round(v, 5) END AS v FROM stereo")
    assert len(want[1]) == 500 * 64
    near(rows(spark, "d2_istft"), want)


def test_magnitude_and_phase_of_every_bin(spark, con):
    x = {}
    for track, channel, pos, v in con.execute(f"WITH {fx.STEREO} SELECT track, channel, pos, v FROM stereo").fetchall():
        x.setdefault((track, channel), np.zeros(64))[pos] = v
    w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(16) / 16)
    z = {(*k, f): np.fft.rfft(v[f * 8 : f * 8 + 16] * w) for k, v in x.items() for f in range(7)}
    got = catalogue.queries()["d3_mag_phase"](spark, SF).collect()
    assert len(got) == 500 * 7 * 9
    for r in got:
        c = z[r.track, r.channel, r.frame][r.bin]
        edge = r.bin in (0, 8)
        phase = (np.pi if c.real < 0 else 0.0) if edge else np.angle(c)
        assert abs(r.mag - abs(c)) <= 2e-5 and (abs(r.phase - phase) <= 2e-4 or abs(c) < 1e-9)


def test_inverted_stem_has_every_position(spark, con):
    want = rows_sql(con, f"""WITH {PAIR}, z AS (SELECT track, channel, frame, bin, -(yr - greatest(xm, ym) * xr / xm) AS re, -(yi - greatest(xm, ym) * xi / xm) AS im FROM b),
    t AS (SELECT track, channel, frame, i, sum(CASE WHEN bin IN (0, 8) THEN 1 ELSE 2 END * (re * cos(2 * pi() * bin * i / 16) - im * sin(2 * pi() * bin * i / 16))) / 16 AS x FROM z, (SELECT unnest(range(0, 16)) AS i) GROUP BY ALL),
    w AS (SELECT track, channel, CAST(frame * 8 + i AS INTEGER) AS pos, x, 0.5 - 0.5 * cos(2 * pi() * i / 16) AS w FROM t)
    SELECT track, channel, pos, CASE WHEN sum(w * w) > 1e-12 THEN round(sum(x * w) / sum(w * w), 5) ELSE 0 END AS v FROM w GROUP BY ALL""")
    assert {r[want[0].index("pos")] for r in want[1]} == set(range(64))
    near(rows(spark, "e5_invert_stem"), want)
