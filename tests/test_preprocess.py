"""Preprocessing once: a second run writes nothing, changed tracks are done again, a killed run is not seen."""

import os

import pytest
from pyspark.sql import functions as F

from stemframe.operators.spectral import resample_sinc
from stemframe.sources import preprocess


def files(folder):
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, names in os.walk(folder) for f in names}


def rows_of(df):
    return sorted((r.track, r.channel, r.pos, round(r.v, 9)) for r in df.collect())


def signal(spark, tracks, gain=1.0):
    rows = [(t, c, p, gain * ((p * 7 + t * 3 + c) % 11)) for t in tracks for c in (0, 1) for p in range(30 + t)]
    return spark.createDataFrame(rows, "track long, channel long, pos int, v double").repartition(3)


def test_finished_tracks_are_skipped(spark, tmp_path):
    folder, seen = str(tmp_path / "out"), []

    def work(d):
        seen.append(sorted(r.track for r in d.select("track").distinct().collect()))
        return resample_sinc(d, ["track", "channel"], 1.5)

    run = lambda d: rows_of(preprocess.once(d, folder, work, "x"))
    want = lambda d: rows_of(resample_sinc(d, ["track", "channel"], 1.5))
    assert run(signal(spark, [1, 2])) == want(signal(spark, [1, 2]))
    before = files(folder)
    assert run(signal(spark, [2, 1])) == want(signal(spark, [1, 2])) and files(folder) == before, "a second run writes nothing"
    assert run(signal(spark, [1, 2, 3])) == want(signal(spark, [1, 2, 3]))
    changed = signal(spark, [1]).unionByName(signal(spark, [2], 2.0))
    assert run(changed) == want(changed)
    assert seen == [[1, 2], [3], [2]]
    assert run(signal(spark, [1, 2, 3])) == want(signal(spark, [1, 2, 3])) and len(seen) == 3, "what was made before is still there"
    preprocess.once(signal(spark, [1]), folder, work, "other settings")
    assert seen[-1] == [1]


def test_a_killed_run_is_not_seen_and_goes(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "out")
    preprocess.resample_once(signal(spark, [1]), folder, 2.0).collect()
    before = files(folder)
    with monkeypatch.context() as m:
        m.setattr(preprocess, "publish", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt))
        with pytest.raises(KeyboardInterrupt):
            preprocess.resample_once(signal(spark, [1, 2]), folder, 2.0)
    assert len(files(folder)) > len(before)
    assert [r.track for r in preprocess.manifest(spark, folder).collect()] == [1]
    got = preprocess.resample_once(signal(spark, [1]), folder, 2.0)
    assert rows_of(got) == rows_of(resample_sinc(signal(spark, [1]), ["track", "channel"], 2.0)) and files(folder) == before
    lost = signal(spark, [4]).withColumn("v", F.when(F.col("pos") == 9, F.raise_error(F.lit("lost"))).otherwise(F.col("v")))
    with pytest.raises(Exception, match="lost"):
        preprocess.resample_once(lost, folder, 2.0)
    assert files(folder) == before


def test_no_tracks(spark, tmp_path):
    assert preprocess.resample_once(signal(spark, [1]).limit(0), str(tmp_path / "out"), 2.0).count() == 0
