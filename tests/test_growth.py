"""Steps whose memory, shuffled rows or ties once grew beyond the input."""

import math
import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stemframe import catalogue
from stemframe.functions.exprs import seeded
from stemframe.operators import blocks, dataset, frames, pitch
from stemframe.plans import catalog

SF = "/root/testdata/sf0.001"


def test_overlap_add_of_short_signals_keeps_their_samples_only(spark, monkeypatch):
    frames = spark.createDataFrame([(0, 0, [0.0] * 9, [0.0] * 9)], "track long, frame int, re array<double>, im array<double>")
    ran, real = [], type(frames).mapInPandas
    monkeypatch.setattr(type(frames), "mapInPandas", lambda self, f, schema: ran.append(f) or real(self, f, schema))
    blocks.istft_blocks(frames, ["track"], 16, 8, centred=True)
    many = pd.DataFrame({"track": range(500), "block": 0, "at": [[0, 8]] * 500, "i": [[8, 0]] * 500, "x": [[np.ones(8), np.ones(16)]] * 500, "n": 20})
    tracemalloc.start()
    out = next(ran[-1](iter([many])))["v"]
    assert all(v.size == 20 for v in out) and tracemalloc.get_traced_memory()[1] < 20_000_000
    tracemalloc.stop()


@pytest.mark.parametrize("name", ["b5_fix_clipping", "b13_match_length", "b14_center_trim", "c1_frame", "c4_overlap_add_triangle", "c5_overlap_add_hann", "c6_overlap_add_hamming", "c7_overlap_add_unfold", "c8_linear_fader", "e10_merge_artifacts", "e13_residual_target", "e15_mixdown", "e16_complement_stem", "e17_inverted_stems", "e18_instrumental_stems", "e20_stem_combinations", "h3_integrated_loudness"])
def test_filled_in_samples_are_not_exchanged(spark, name):
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with tables that are too large for it
    try:
        # the samples are 15 tracks by 5 stems by 720 hours, the events 1,000
        assert stage_rows(spark, catalogue.queries()[name](spark, SF)) <= 10_000 < 15 * 5 * 720
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


@pytest.mark.parametrize("name", ["c3_overlap_add_fade", "c9_window_fader", "c10_shift_average", "c13_mask_tta", "c15_silence_cut_points"])
def test_moved_and_padded_signals_keep_their_length(spark, name):
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert stage_rows(spark, catalogue.queries()[name](spark, SF)) <= 10_000 < 15 * 5 * 720
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


@pytest.mark.parametrize("scheme", [
    lambda d: frames.overlap_add_hann(d, ["track"], 24, 12, 6, frames.ramp(24)), lambda d: frames.overlap_add_hamming(d, ["track"], 25, 10, frames.ramp(25)), lambda d: frames.overlap_add_unfold(d, ["track"], 24, 8, frames.ramp(24)),
    lambda d: frames.window_fader(d, ["track"], 24, 12, frames.ramp(24)), lambda d: frames.shift_average(d, ["track"], 3, 12, lambda m: frames.overlap_add_hamming(m, ["track", "shift"], 25, 10, frames.ramp(25))),
    lambda d: frames.mask_tta(d, ["track"], 24, lambda m: frames.overlap_add_hamming(m, ["track"], 25, 10, frames.ramp(25))), lambda d: frames.silence_cut_points(d, ["track"], 30, 20, 6, 4),
])
def test_a_carried_length_gives_what_a_counted_one_gives(spark, scheme):
    # Tracks of 1 to 95 samples, shorter and longer than a chunk and its borders.
    df = spark.createDataFrame([(n, i, float((7 * i + n) % 11 - 5), n) for n in (1, 9, 24, 25, 47, 49, 95) for i in range(n)], "track long, pos int, v double, n int")
    rows = lambda out: sorted(tuple(round(x, 9) for x in r) for r in out.collect())
    counted, carried = scheme(df.drop("n")), scheme(df)
    assert rows(carried.select(counted.columns)) == rows(counted) and counted.count() > 0


def stage_rows(spark, df):
    """Rows that the query's stages write to exchanges."""
    sc = spark.sparkContext
    stages = lambda: {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in (found.apply(i) for found in [sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())] for i in range(found.size()))}
    before = stages()
    df.write.format("noop").mode("overwrite").save()
    return sum(n for key, n in stages().items() if key not in before)


def test_added_steps_count_from_their_offset_in_longer_plans(spark):
    plan = spark.createDataFrame([(p, s, "t", f"m{s}", 1.0) for p, n in ((0, 6), (1, 3)) for s in range(n)], "plan int, step int, model_type string, model_name string, weight double")
    more = plan.filter("step < 2").selectExpr("plan", "step", "model_type", "'again_' || model_name AS model_name", "weight")
    rows = lambda df, p: [r.model_name for r in sorted(df.filter(f"plan = {p}").collect(), key=lambda r: r.step)]
    assert rows(catalog.added(plan, more, 4), 0) == ["m0", "m1", "m2", "m3", "m4", "again_m0", "m5", "again_m1"]
    assert rows(catalog.added(plan, more, 4), 1) == ["m0", "m1", "m2", "again_m0", "again_m1"]
    assert rows(catalog.added(plan, more), 0) == [*(f"m{s}" for s in range(6)), "again_m0", "again_m1"]


def test_filterbanks_exchange_vectors_not_samples(spark):
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        vectors = spark.read.parquet(f"{SF}/embeddings.parquet").count()
        assert stage_rows(spark, catalogue.queries()["d11_perceptual_filterbanks"](spark, SF)) <= 2 * vectors
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_nearest_vectors_of_a_tile_leave_as_one_batch(spark, monkeypatch):
    q = spark.createDataFrame([(0, [0.0], 0, 0.0, 1.0)], "id long, x array<double>, cell int, d double, bound double")
    ran, real = [], type(q).mapInPandas
    monkeypatch.setattr(type(q), "mapInPandas", lambda self, f, schema: ran.append(f) or real(self, f, schema))
    pitch._met(q, q.drop("bound"), 2, 8, None)
    tile = pd.DataFrame({"q_id": [[0, 1]], "q_d": [[0.0, 1.0]], "q_x": [[0.0, 1.0]], "q_bound": [[9.0, 9.0]], "x_id": [[0, 1, 2]], "x_d": [[0.0, 1.0, 3.0]], "x_x": [[0.0, 1.0, 3.0]]})
    (out,) = ran[-1](iter([tile]))
    assert out.to_numpy().tolist() == [[0, 1, 1], [0, 2, 9], [1, 0, 1], [1, 2, 4]]


def without_broadcasts(spark, run):
    """Rows that all stages of ``run()`` and of its result write to exchanges, those of staged tables among them."""
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        made = []

        class Lazy:
            @property
            def write(self):
                made.append(run())
                return made[-1].write

        return stage_rows(spark, Lazy())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_remixing_exchanges_segments_not_samples(spark):
    assert without_broadcasts(spark, lambda: catalogue.queries()["h7_remix_augment"](spark, SF)) <= 20_000 < 15 * 5 * 720


def test_remixed_segments_of_other_lengths_keep_all_places(spark):
    """Against sums over plain rows; the last segment of a track is shorter, and some segments are silent."""
    signal = {("a", t): [0.0] * 5 + [float((i * t + 3) % 7 - 3) for i in range(n - 5)] for t, n in ((1, 20), (2, 9), (3, 13))}
    signal |= {("b", t): [0.0] * len(signal["a", t]) for t in (1, 2, 3)} | {("c", t): [0.5 * t] * len(signal["a", t]) for t in (1, 2, 3)}
    packed = dataset.sparse_segments(spark.createDataFrame([(t, s, v) for (s, t), v in signal.items()], "track long, stem string, samples array<double>"), 8)
    segs = [(no, s, v[at : at + 8]) for s in "abc" for no, (t, at) in enumerate((t, at) for t in (1, 2, 3) for at in range(0, len(signal["a", t]), 8)) for v in [signal[s, t]]]
    assert sorted((r.seg, r.stem, r.n) for r in packed.collect()) == sorted((no, s, len(v)) for no, s, v in segs)
    long = spark.createDataFrame([(no, s, i, x) for no, s, v in segs for i, x in enumerate(v)], "seg long, stem string, i int, v double")
    rows = lambda df: sorted((r.seg, r.i, round(r.v, 9)) for r in df.collect())
    got = rows(dataset.remix_augment(packed, "a", 0.5, 0.3))
    assert got == rows(dataset.remix_augment(long, "a", 0.5, 0.3)) and {s for s, _, _ in got} == {no for no, _, _ in segs}
    draws = spark.range(7).selectExpr("id AS seg", "explode(array('a', 'b', 'c')) AS stem").select("seg", "stem", *[seeded(f"mix{x}", "seg", "stem").alias(x) for x in "stgd"]).collect()
    own, want = {(no, s): v for no, s, v in segs}, {}
    for r in draws:
        other = r.stem != "a"
        source = math.floor(r.t * 7) if other and r.s < 0.5 else r.seg
        gain = 1.0 if not other else 0.0 if r.d < 0.3 else 10 ** ((r.g * 20 - 10) / 20)
        for i, x in enumerate(own[source, r.stem]):
            want[r.seg, i] = want.get((r.seg, i), 0.0) + x * gain
    top = {no: max(abs(v) for (s, _), v in want.items() if s == no) for no in range(7)}
    assert [(s, i) for s, i, _ in got] == sorted(want) and all(abs(v - want[s, i] / max(1, top[s])) < 1e-8 for s, i, v in got)


@pytest.mark.parametrize("name", ["c15_silence_cut_points", "c16_split_concat"])
def test_parts_of_signals_are_cut_without_exchanging_samples(spark, name):
    assert without_broadcasts(spark, lambda: catalogue.queries()[name](spark, SF)) <= 10_000 < 15 * 5 * 720


def test_block_rows_are_cut_where_the_long_form_is_and_give_whole_signals(spark):
    """Tracks of 1 to 95 samples, shorter and longer than a block of 16, a part and the border of a part."""
    df = spark.createDataFrame([(n, i, float((7 * i * i + n) % 11 - 5)) for n in (1, 9, 16, 31, 33, 47, 95) for i in range(n)], "track long, pos int, v double")
    packed = df.groupBy("track", F.floor(F.col("pos") / 16).alias("b")).agg(F.min("pos").alias("start"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda x: x["v"]).alias("samples"))
    packed = packed.drop("b").join(df.groupBy("track").agg((F.max("pos") + 1).alias("n")), "track")
    rows = lambda out: sorted(tuple(round(x, 9) for x in r) for r in out.collect())
    cuts = frames.silence_cut_points(packed, ["track"], 30, 20, 6, 4)
    assert rows(cuts) == rows(frames.silence_cut_points(df, ["track"], 30, 20, 6, 4)) and cuts.count() == 1 + 1 + 2 + 4
    # A model that looks three samples back and two ahead: halos of three give what the whole signal gives.
    at = lambda s, i: F.when(i >= 0, F.coalesce(F.get(s, i), F.lit(0.0))).otherwise(0.0)
    out = frames.split_concat(packed, cuts, ["track"], 3, lambda s: F.transform(s, lambda v, i: v + 2 * at(s, i - 3) + 5 * at(s, i + 2)))
    x = {n: [float((7 * i * i + n) % 11 - 5) for i in range(n)] for n in (1, 9, 16, 31, 33, 47, 95)}
    near = lambda v, i: v[i] if 0 <= i < len(v) else 0.0
    assert rows(out) == sorted((n, i, v[i] + 2 * near(v, i - 3) + 5 * near(v, i + 2)) for n, v in x.items() for i in range(n))
