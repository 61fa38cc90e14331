"""The WAV data source: ranges of files, headers alone, and a writer that leaves all or nothing."""

import os
import pickle

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stemframe.sources import wav, wav_source


def written(path, x, sr=8000, bits=16):
    path.write_bytes(wav.wav_bytes(x, sr, bits))


@pytest.mark.parametrize("bits, block, ranges", [(16, 64, 100), (24, 100, 999), (8, 7, 44), (32, 1000, 10**6)])
def test_ranges_of_a_file_are_tasks_and_lose_nothing(spark, tmp_path, bits, block, ranges):
    x = np.random.default_rng(bits).uniform(-0.9, 0.9, size=(1000, 2))
    written(tmp_path / "t.wav", x, bits=bits)
    spark.dataSource.register(wav_source.WavSource)
    rows = spark.read.format("wav").option("block", block).option("rangebytes", ranges).option("path", str(tmp_path)).load()
    size = os.path.getsize(tmp_path / "t.wav")
    assert rows.rdd.getNumPartitions() == -(-size // ranges)
    got = sorted(map(tuple, rows.select("channel", "start", "n", "samples").collect()))
    assert [(c, s, n) for c, s, n, _ in got] == [(c, s, min(block, 1000 - s)) for c in (0, 1) for s in range(0, 1000, block)]
    for c in (0, 1):
        assert np.abs(np.concatenate([v for k, _, _, v in got if k == c]) - x[:, c]).max() <= 1.1 / ((1 << (bits - 1)) - 1) + 1e-7


def test_short_files_share_a_task(spark, tmp_path):
    for k in range(40):
        written(tmp_path / f"{k}.wav", np.full((10, 1), k / 50))
    rows = wav.scan_signals(spark, str(tmp_path))
    assert rows.rdd.getNumPartitions() == 1
    assert sorted((int(r.track), round(r.samples[0] * 50)) for r in rows.collect()) == [(k, k) for k in range(40)]


def test_a_header_is_read_without_the_samples(tmp_path):
    """Bytes asked for, of a file of 8 MB with a long chunk before the format."""
    x = np.zeros((2_000_000, 2))
    content = wav.wav_bytes(x, 44100)
    content = content[:12] + b"LIST" + (100_000).to_bytes(4, "little") + bytes(100_000) + content[12:]
    asked = []

    def read(at, n):
        asked.append(n)
        return content[at : at + n]

    fmt, start, size = wav_source.header(read, len(content))
    assert (fmt["sr"], fmt["channels"], fmt["bits"], start, size) == (44100, 2, 16, 100_052, 8_000_000) and sum(asked) < 200


def test_bad_files_are_rows_with_a_reason(spark, tmp_path):
    written(tmp_path / "good.wav", np.zeros((10, 1)))
    (tmp_path / "text.wav").write_text("no sound at all, but long enough to have a header")
    (tmp_path / "none.wav").write_bytes(b"")
    (tmp_path / "cut.wav").write_bytes(wav.wav_bytes(np.zeros((100, 1)), 8000)[:144])
    (tmp_path / "sub").mkdir()
    written(tmp_path / "sub" / "deep.wav", np.zeros((5, 3)))
    rows = {(r.track, r.channel): r for r in wav.scan_signals(spark, str(tmp_path)).collect()}
    assert set(rows) == {("good", 0), ("text", None), ("none", None), ("cut", 0), ("sub/deep", 0), ("sub/deep", 1)}
    assert rows["cut", 0].n == 50 and rows["text", None].error and rows["none", None].error
    info = {r.path.rsplit("/", 1)[-1]: r for r in wav.scan_media_info(spark, str(tmp_path)).collect()}
    assert len(info) == 5 and info["text.wav"].error and info["deep.wav"].duration == 5 / 8000
    assert wav.scan_media_info(spark, str(tmp_path / "good.wav")).count() == 1


@pytest.mark.parametrize("bits", [16, -32, -64])
def test_written_files_hold_the_signal_and_a_failed_job_leaves_none(spark, tmp_path, bits):
    rng = np.random.default_rng(1)
    made = {f"a/{t}.wav": rng.uniform(-1, 1, size=(n, c)) for t, (n, c) in enumerate([(1000, 2), (7, 1), (64, 2), (1, 1)])}
    rows = [(f, c, p, float(x[p, c])) for f, x in made.items() for p in range(len(x)) for c in range(x.shape[1])]
    df = spark.createDataFrame(rows, "file string, channel int, pos int, v double").repartition(3)
    target = str(tmp_path / "out")
    wav.write_wav(df, target, 16000, bits, block=64)
    assert sorted(os.listdir(target)) == ["_SUCCESS", "a"] and len(os.listdir(f"{target}/a")) == len(made)
    for f, x in made.items():
        got, sr = wav.pcm_samples(open(f"{target}/{f}", "rb").read())
        assert sr == 16000 and got.shape == x.shape and np.abs(got - x).max() < (1e-15 if bits == -64 else 1e-7 if bits == -32 else 1e-4)
    before = {f: os.path.getmtime(f"{target}/{f}") for f in made}
    with pytest.raises(Exception, match="there already"):
        wav.write_wav(df, target, 16000, bits)
    broken = df.withColumn("v", F.when(F.col("file") == "a/0.wav", F.raise_error(F.lit("lost"))).otherwise(F.col("v")))
    with pytest.raises(Exception, match="lost"):
        wav.write_wav(broken, str(tmp_path / "fails"), 16000, bits, block=64)
    left = [f for _, _, files in os.walk(tmp_path / "fails") for f in files]
    assert not left and {f: os.path.getmtime(f"{target}/{f}") for f in made} == before
    wav.write_wav(df.withColumn("v", F.lit(0.5)), target, 16000, bits, mode="overwrite")
    assert np.allclose(wav.pcm_samples(open(f"{target}/a/0.wav", "rb").read())[0], 0.5, atol=1e-4)


def test_a_file_without_a_block_is_not_written(spark, tmp_path):
    spark.dataSource.register(wav_source.WavSource)
    rows = spark.createDataFrame([("x.wav", 0, 8000, 1, 10, [0.0] * 4)], wav_source.WRITE_SCHEMA)
    with pytest.raises(Exception, match="missing"):
        rows.write.format("wav").option("path", str(tmp_path / "t")).mode("append").save()
    assert not [f for _, _, files in os.walk(tmp_path / "t") for f in files]


def test_the_driver_gets_no_names_of_files(tmp_path, monkeypatch):
    """What tasks report and what they are told doesn't grow with the number of files; every file is there once."""
    monkeypatch.setattr(wav_source, "SOME", 7)
    monkeypatch.setattr(wav_source, "_batched", lambda items, real=wav_source._batched: real(items, 11))
    target, names = str(tmp_path / "out"), [f"{stem}/{'x' * 50}{k}.wav" for stem in ("a", "a-b", "a b", "b\n") for k in range(100)] + ["a.wav", "c/d/e.wav"]
    row = lambda name, k: pa.RecordBatch.from_pylist([{"file": name, "block": 0, "sr": 8000, "channels": 1, "total": 3, "samples": [k / 1000, 0.0, -0.5]}])
    writer = wav_source.FileWriter({"path": target, "bits": -64}, False)
    messages = [writer.write(iter([row(n, k) for k, n in enumerate(names) if k % 3 == task])) for task in range(3)]
    assert len(pickle.dumps(messages)) < 1000 and not [f for f in os.listdir(target) if not f.startswith("_")]
    writer.commit([*messages, None])
    assert sorted(os.listdir(target)) == ["_SUCCESS", "a", "a b", "a-b", "a.wav", "b\n", "c"]
    read = lambda reader: [b for p in reader.partitions() for b in reader.read(p)]
    for ranges in (4096, 5 * 4096, 1 << 20):
        reader = wav_source.BlockReader({"path": target, "double": "true", "rangebytes": ranges})
        assert all(len(pickle.dumps(p)) < 500 for p in reader.partitions()) and len(reader.partitions()) == -(-len(names) * 4096 // ranges)
        assert sorted((b["track"][0].as_py(), b["samples"][0].as_py()) for b in read(reader)) == sorted((n.removesuffix(".wav"), [k / 1000, 0.0, -0.5]) for k, n in enumerate(names))
    info = wav_source.InfoReader({"path": target, "files": 37})
    assert all(len(pickle.dumps(p)) < 500 for p in info.partitions()) and sorted(x for b in read(info) for x in b["path"].to_pylist()) == sorted(f"{target}/{n}" for n in names)
    again = wav_source.FileWriter({"path": target}, False)
    with pytest.raises(FileExistsError, match="2 files are there already"):
        again.commit([again.write(iter([row(n, 1)])) for n in ("c/d/e.wav", "new.wav", names[9])])
    with pytest.raises(FileExistsError, match="several tasks"):
        again.commit([again.write(iter([row(n, 1)])) for n in ("new.wav", "other.wav", "new.wav")])
    assert not os.path.exists(f"{target}/new.wav") and not [f for f in os.listdir(target) if f.startswith("_temporary")]
    parts = reader.partitions()
    os.remove(f"{target}/{names[5]}")
    with pytest.raises(OSError, match="came or went"):
        [b for p in parts for b in reader.read(p)]


def test_stems_are_written_from_block_rows_but_silent_ones(spark, tmp_path):
    x = {("a", 1): [0.0, 0.5, -0.25, 0.0, 0.125], ("b", 1): [0.0, 1e-7, 0.0, 0.0, 0.0], ("c", 2): [0.0, 0.0, 0.0, 0.0, 0.75]}
    rows = spark.createDataFrame([(t, s, b, 5, v[2 * b : 2 * b + 2]) for (s, t), v in x.items() for b in range(3)], "track long, stem string, block int, total long, samples array<double>")
    wav.write_stems(rows.repartition(3), str(tmp_path / "out"), bits=-64)
    found = {f"{folder}/{f}": wav.pcm_samples((tmp_path / "out" / folder / f).read_bytes())[0][:, 0].tolist() for folder in ("a", "c") for f in os.listdir(tmp_path / "out" / folder)}
    assert found == {"a/1.wav": x["a", 1], "c/2.wav": x["c", 2]} and not (tmp_path / "out" / "b").exists()
