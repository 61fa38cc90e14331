"""Each operator against brute force or SQL, and on awkward tables."""

import base64
import hashlib
import random
import re
import sys
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

from stemframe.llm import byte_bpe, exact_dedup, html_text, language, license_scan, mixing, near_dedup, quality_gam, quality_rules, queries, substring_dedup
from tests.oracle import connect, rows_of, rows_sql

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names the operators use inside or in their results.
EXTRA = ["digest", "salt", "keep_id", "kept", "row", "key", "version", "n_words", "size", "copied", "component", "rep", "turn", "copies"]


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}


def words(rng, n, of=400):
    return " ".join(f"w{rng.randrange(of)}" for _ in range(n))


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls in any column, empty, blank and very long texts, ties, repeated rows, and clashing columns."""
    rng = random.Random(1)
    base = words(rng, 120)
    long = words(rng, 60_000, 5_000)
    rows = [
        (1, base, "en", "a", 1), (2, base, "en", "a", 1), (2, base, "en", "a", 1), (3, None, None, None, None), (4, "", "fr", "b", 0), (5, " \t\n", "fr", None, 3),
        (6, base + " tail", "en", "b", 1), (None, base, "en", "a", 1), (None, None, None, None, None), (7, "12 34 !!", "de", "b", 1), (8, long, "de", "c", 1),
        (9, "word", "en", "c", 1), (10, "Word", "en", "c", 1), (11, "un deux trois quatre cinq six", "fr", "c", 2), (12, base[:300], "fr", "c", 2), (13, long[1000:], None, "c", 1), (14, "é😀" * 50, "fr", "a", 1),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    return df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(EXTRA)])


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, con, name):
    assert rows_of(queries.QUERIES[name](spark, SF)) == rows_sql(con, queries.ORACLES[name])


# 1: language ID


def test_language_of_held_out_documents(spark, docs):
    found = {r.doc_id: r for r in queries.op1(spark, SF).collect()}
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    held = [d for d in found if found[d].held_out]
    assert len(found) == len(truth) and all(found[d].held_out == (zlib.crc32(str(d).encode()) % 3 == 1) for d in found)
    assert sum(found[d].lang_pred == truth[d] for d in held) >= 0.95 * len(held) and all(0 <= r.score <= 1 for r in found.values())


def test_mixtures_are_inferred(spark, docs):
    model = language.fit(docs)
    by = {}
    for r in docs.select("text", "lang").collect():
        by.setdefault(r.lang, []).append(r.text)
    en, de = max(by["en"], key=len)[:4000], max(by["de"], key=len)[:4000]
    shares, _ = model.infer([language.trigrams(en + " " + de), language.trigrams(en)])
    i, j = model.langs.index("en"), model.langs.index("de")
    assert 0.3 < shares[0, i] < 0.7 and 0.3 < shares[0, j] < 0.7 and shares[1, i] > 0.9


def test_a_document_may_mix_more_than_four_languages():
    rng = np.random.default_rng(5)
    counts = rng.dirichlet(np.full(language.BUCKETS, 0.02), 7).T * 1e6
    model = language.Mixture([f"l{i}" for i in range(7)], counts)
    draw = lambda langs, n: np.concatenate([rng.choice(language.BUCKETS, n, p=model.p[:, i]) for i in langs])
    shares, score = model.infer([draw(range(6), 2000), draw([2], 2000), draw([1, 4], 2000), draw(range(7), 3000)])
    assert [int((s > 0).sum()) for s in shares] == [6, 1, 2, 7]
    assert np.allclose(shares[0, :6], 1 / 6, atol=0.02) and np.allclose(shares[3], 1 / 7, atol=0.02) and abs(score[0] - 1 / 6) < 0.02


def test_em_reaches_the_likeliest_mixture():
    rng = np.random.default_rng(3)
    model = language.Mixture(list("abcde"), rng.dirichlet(np.full(language.BUCKETS, 0.02), 5).T * 1e6)
    grams = np.concatenate([rng.choice(language.BUCKETS, n, p=model.p[:, i]) for i, n in ((0, 500), (1, 300), (2, 200), (3, 150), (4, 150))])
    at, n = np.unique(grams, return_counts=True)
    share, likely, room = model._em(model.p[at], n.astype(float), np.array([at.size]), np.full((1, 5), 0.2))
    best = np.full(5, 0.2)
    for _ in range(5000):
        joint = model.p[at] * best
        best = (joint * (n / joint.sum(axis=1))[:, None]).sum(axis=0) / n.sum()
    assert abs(likely[0] - (n * np.log((model.p[at] * best).sum(axis=1))).sum()) <= model.slack + 0.02 and np.abs(share[0] - best).max() < 0.02
    shares, score = model.infer([grams])
    assert (shares[0] > 0).sum() == 5 and 0.3 < score[0] < 0.5  # a document of five languages has five


def test_language_awkward(awkward, empty):
    got = {r.doc_id: r for r in language.identify(awkward).collect()}
    assert all(got[d].lang_pred == "und" and got[d].score == 0 for d in (3, 4, 5)) and got[7].lang_pred == "und" and got[1].lang_pred in {"en", "fr", "de"}
    assert language.identify(awkward).count() == 17 and language.identify(empty).count() == 0
    assert language.with_known_language(awkward).columns == awkward.columns
    unlearned = language.identify(awkward.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in unlearned.collect()} == {"und"}


# 2: quality classifier


def test_quality_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    found = {r.doc_id: r for r in queries.op2(spark, sf).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [d for d in labels if found[d].held_out]
    assert sum(found[d].predicted == labels[d] for d in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in found.values())


def test_gam_needs_its_pairs():
    rng = np.random.default_rng(1)
    x = rng.uniform(-1, 1, (4000, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)  # no feature alone tells anything
    m = quality_gam.Gam().fit(x[:3000], y[:3000])
    assert (0, 1) in m.pairs and ((m.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.9


def test_scores_are_sums_of_lookups():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1500, 4)).round(1)  # ties at the bins' edges
    y = ((x[:, 0] * x[:, 1] > 0) | (x[:, 2] > 1)).astype(float)
    m = quality_gam.Gam(rounds=60, pair_rounds=30).fit(x, y)
    assert m.pairs and len(m.tables) == 4
    for row, got in zip(x[:200], m.score(x[:200])):
        at = [sum(e < v for e in edges.tolist()) for v, edges in zip(row, m.edges)]
        z = m.base + sum(t[k] for t, k in zip(m.tables, at))
        for (i, j), t in zip(m.pairs, m.pair_tables):
            z += t[at[i] * m.coarse // (len(m.edges[i]) + 1)][at[j] * m.coarse // (len(m.edges[j]) + 1)]
        assert abs(got - 1 / (1 + np.exp(-z))) < 1e-12


def test_quality_awkward(spark, awkward, empty):
    labels = spark.createDataFrame([(1, 1), (2, 1), (4, 0), (7, 0), (9, None), (None, 1)], "doc_id long, quality int")
    model = quality_gam.fit(awkward, labels)
    assert quality_gam.score(awkward, model).count() == 17 and quality_gam.score(empty, model).count() == 0
    nothing = quality_gam.fit(empty, labels.limit(0))
    assert {r.score for r in quality_gam.score(awkward, nothing).collect()} == {0.5}


# 3: substring dedup


def test_substring_dedup_is_exact(spark, texts):
    want = substring_dedup.brute_force(texts)
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in queries.op3(spark, SF).collect()} == want
    assert sum(v[1] for v in want.values()) > 0


def test_substring_dedup_at_boundaries(spark):
    rng = random.Random(2)
    a, b = words(rng, 300).split(), words(rng, 300).split()
    made = {1: a, 2: b, 3: a[10:60] + b[5:55], 4: a[100:149] + ["x"], 5: ["y"] + a[200:250] + ["z"], 6: a[20:90] + a[60:120], 7: ["q"] * 200, 8: ["q"] * 60, 9: ["q"] * 49, 10: b[:40] + a[:40] + b[40:120]}
    made = {k: " ".join(v) for k, v in made.items()}
    df = spark.createDataFrame(list(made.items()), "doc_id long, text string")
    rows = substring_dedup.substring_dedup(df).collect()
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in rows}
    assert got == substring_dedup.brute_force(made) and got[3][1] == 100 and got[4][1] == 0
    valid_factors(rows, made, 50)
    by = {r.doc_id: r.factors for r in rows}
    assert [tuple(f) for f in by[3]] == [(0, 50, 1, 10), (50, 100, 2, 5)] and [tuple(f) for f in by[5]] == [(1, 51, 1, 200)]


def valid_factors(rows, made, window):
    """Factors are disjoint, in order, add up to what is removed, and are the words of an earlier source."""
    for r in rows:
        own = made[r.doc_id].split()
        assert sum(f.end - f.start for f in r.factors) == r.n_removed
        assert all(a.end <= b.start for a, b in zip(r.factors, r.factors[1:]))
        for f in r.factors:
            assert f.source < r.doc_id and own[f.start : f.end] == made[f.source].split()[f.source_start : f.source_start + f.end - f.start]


def test_substring_dedup_random_small_alphabet(spark):
    rng = random.Random(3)
    made = {i: " ".join(rng.choice("ab") for _ in range(rng.randrange(40))) for i in range(40)}
    df = spark.createDataFrame(list(made.items()), "doc_id long, text string")
    rows = substring_dedup.substring_dedup(df, window=8, anchor=3).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in rows} == substring_dedup.brute_force(made, 8)
    valid_factors(rows, made, 8)


def test_factors_are_greedy():
    # Windows of 4 words: places 0-3 are in document 7, 2-5 in 8, 2-9 in 9; the longest that covers the next word wins.
    assert substring_dedup.factors([(0, 3, 7, 10), (2, 5, 8, 0), (2, 9, 9, 50)], 4) == [(0, 7, 7, 10), (7, 13, 9, 55)]
    # Neighbouring windows of one source are one match; a jump in the source ends it.
    assert substring_dedup.factors([(0, 1, 7, 0), (2, 2, 7, 2), (3, 3, 7, 9)], 4) == [(0, 6, 7, 0), (6, 7, 7, 12)]
    assert substring_dedup.factors([(5, 5, 1, 0), (20, 21, 1, 0)], 4) == [(5, 9, 1, 0), (20, 25, 1, 0)] and substring_dedup.factors([], 4) == []


def test_substring_dedup_awkward(awkward, empty):
    rows = substring_dedup.substring_dedup(awkward).collect()
    got = {r.doc_id: r for r in rows}
    assert len(rows) == 17 and got[1].n_removed == 0 and got[2].n_removed == 120 and got[6].n_removed == 120 and got[13].n_removed > 50_000
    assert all(r.n_removed == 0 for r in rows if r.doc_id is None) and got[3].kept_sha256 == hashlib.sha256(b"").hexdigest()
    assert substring_dedup.substring_dedup(empty).count() == 0


# 4: exact dedup


def test_exact_dedup_awkward(awkward, empty):
    rows = exact_dedup.exact_dedup(awkward).collect()
    assert len(rows) == 17 and sum(r.kept for r in rows) == len({r.text_sha256 for r in rows})
    same = [r for r in rows if r.text_sha256 == rows[[x.doc_id for x in rows].index(1)].text_sha256]
    assert {r.keep_id for r in same} == {2} and {r.group_size for r in same} == {4} and sum(r.kept for r in same) == 1
    none = [r for r in rows if r.text_sha256 == hashlib.sha256(b"").hexdigest()]
    assert {r.keep_id for r in none} == {4} and len(none) == 3
    kept = exact_dedup.deduplicated(awkward)
    assert kept.columns == awkward.columns and kept.count() == sum(r.kept for r in rows)
    assert exact_dedup.exact_dedup(empty).count() == 0 and exact_dedup.deduplicated(empty).count() == 0


def test_many_rows_without_an_id_keep_one(spark):
    df = spark.range(5000).select(F.lit(None).cast("long").alias("doc_id"), F.when(F.col("id") % 2 == 0, "same").otherwise("other").alias("text")).repartition(6)
    rows = exact_dedup.exact_dedup(df).collect()
    assert len(rows) == 5000 and sum(r.kept for r in rows) == 2 and {r.group_size for r in rows} == {2500} and {r.keep_id for r in rows} == {None}
    assert sorted(r.text for r in exact_dedup.deduplicated(df).collect()) == ["other", "same"]


def test_the_winner_keeps_its_own_columns(spark):
    rows = [(1, "t", "en", "a", 1), (3, "t", None, "b", 2), (2, "t", "fr", "c", 3), (4, None, "de", None, 0), (None, "", "xx", "z", 9)]
    got = exact_dedup.deduplicated(spark.createDataFrame(rows, SCHEMA).withColumn("m", F.create_map(F.lit("k"), F.col("lang")))).collect()
    assert sorted((r.doc_id, r.text, r.lang, r.source, r.n_chars, r.m["k"]) for r in got) == [(3, "t", None, "b", 2, None), (4, None, "de", None, 0, "de")]


def test_exact_dedup_does_not_trust_the_digest(awkward):
    weak = exact_dedup.exact_dedup(awkward, digest=lambda t: F.length(t) % 2)
    assert rows_of(weak) == rows_of(exact_dedup.exact_dedup(awkward))


# 5: near dedup


def test_near_dedup_is_exact(spark, texts):
    want = near_dedup.brute_force(texts, 2, 80)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op5(spark, SF).collect()} == want
    assert any(d != c for d, (_, c) in want.items())


def test_near_dedup_of_dense_families(spark):
    rng = random.Random(4)
    made, doc = {}, 0
    for family in range(3):
        base = words(rng, 100, 10_000).split()
        for _ in range(60):
            w = list(base)
            for _ in range(rng.randrange(1, 14)):
                w[rng.randrange(100)] = f"n{rng.randrange(10**6)}"
            made[doc], doc = " ".join(w), doc + 1
    for w in ("", "one", "one", "ONE two", "one two"):
        made[doc], doc = w, doc + 1
    df = spark.createDataFrame(list(made.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(df, 2, 80).collect()}
    assert got == near_dedup.brute_force(made, 2, 80)


def family(rng, size, edits, length=100):
    """Texts that are one base with up to ``edits`` words changed, each on its own."""
    base = words(rng, length, 10_000).split()
    for _ in range(size):
        w = list(base)
        for _ in range(rng.randrange(1, edits)):
            w[rng.randrange(length)] = f"n{rng.randrange(10**6)}"
        yield " ".join(w)


@pytest.mark.parametrize("width,edits,rounds", [(2, 14, 0), (5, 7, 1), (5, 7, 2)])
def test_rounds_of_leaders_do_not_change_the_result(spark, width, edits, rounds):
    rng = random.Random(width)
    made = dict(enumerate(t for _ in range(2) for t in family(rng, 40, edits)))
    df = spark.createDataFrame(list(made.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(df, width, 80, rounds=rounds).collect()}
    want = near_dedup.brute_force(made, width, 80)
    assert got == want and len({c for _, c in want.values()}) > 2


@pytest.mark.parametrize("width,edits", [(2, 14), (5, 7)])
def test_candidates_grow_with_a_family_and_not_with_its_square(spark, width, edits, monkeypatch):
    made, plain = [], near_dedup._confirmed
    monkeypatch.setattr(near_dedup, "_confirmed", lambda pairs, *a: made.append(pairs.count()) or plain(pairs, *a))

    def candidates(size):
        made.clear()
        rows = list(enumerate(family(random.Random(8), size, edits)))
        near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width, 80)
        return sum(made)

    few, many = candidates(100), candidates(300)
    assert many <= 5 * few and many <= 10 * 300


@pytest.mark.parametrize("length", [100, 3000, 6000])
def test_a_family_below_the_threshold_makes_few_pairs_at_any_length(length):
    """Pairwise similarity 0.70 to 0.79 and no common text to lead: candidates don't grow with the square."""

    def made(size):
        rng = random.Random(size)
        base = words(rng, length, 10**6).split()
        sets = []
        for k in range(size):
            w = list(base)
            for at in rng.sample(range(length), round(length * rng.uniform(0.034, 0.046))):
                w[at] = f"n{rng.randrange(10**9)}"
            sets.append(near_dedup.shingles(" ".join(w), 2))
        bits = [near_dedup.parity(x) for x in sets]
        side = {"n": np.array([x.size for x in sets]), "component": np.arange(size), "bits": {}}
        for width in {b.size for b in bits}:
            at = np.array([k for k, b in enumerate(bits) if b.size == width])
            side["bits"][width] = (at, np.array([bits[k] for k in at]))
        a, b = near_dedup.tile_pairs(side, side, 80)
        similar = lambda i, j: 100 * np.intersect1d(sets[i], sets[j]).size >= 80 * np.union1d(sets[i], sets[j]).size
        assert np.mean([similar(i, j) for i in range(20) for j in range(i)]) < 0.2
        return sum(not similar(i, j) for i, j in zip(a, b) if i < j)

    few, many = made(40), made(120)
    assert few <= 40 and many <= 5 * max(few, 24), (few, many)


def test_bitmaps_of_two_sizes_bound_the_difference():
    rng = np.random.default_rng(3)
    for n, m in ((100, 125), (125, 131), (500, 520), (3000, 3700)):
        x = rng.integers(0, 1 << 62, n + m, dtype=np.uint64)
        a, b = np.unique(x[: n]), np.unique(x[n // 2 : n // 2 + m])
        bits = [near_dedup.parity(s)[None] for s in (a, b)]
        assert near_dedup.differing(*bits)[0, 0] == near_dedup.differing(*bits[::-1])[0, 0] <= np.setxor1d(a, b).size
    assert len({near_dedup.parity(np.arange(n, dtype=np.uint64)).size for n in (100, 500, 3000)}) == 3


@pytest.mark.parametrize("tile", [3, 512])
def test_long_texts_in_dense_families(spark, monkeypatch, tile):
    """Families of long texts around the threshold, and a hot one, in tiles of any size: as brute force."""
    plain = near_dedup._tile_pairs
    monkeypatch.setattr(near_dedup, "_tile_pairs", lambda *a: plain(*a, tile))
    rng = random.Random(11)
    made = list(family(rng, 40, 14)) + [t for length in (800, 2500) for t in family(rng, 12, round(length * 0.09), length)]
    made = dict(enumerate(rng.sample(made, len(made))))
    df = spark.createDataFrame(list(made.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(df, 2, 80, rounds=0).collect()}
    assert got == near_dedup.brute_force(made, 2, 80)


def test_rows_that_repeat_an_id_are_one_document(spark):
    a, b, c = "a b c d e", "x y z w v u", "one two three four five six"
    rows = [(3, a), (5, a), (5, b), (9, b), (12, c), (10, c), (10, "q r s t u v"), (11, "q r s t u v"), (20, None), (20, c), (21, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.component_id, r.kept) for r in near_dedup.near_duplicates(df, 2, 80).collect()}
    assert got == {(3, 3, True), (5, 3, False), (9, 3, False), (10, 10, True), (11, 10, False), (12, 10, False), (20, 10, False), (20, 20, True), (21, 21, True)}


def test_components(spark):
    from stemframe.llm.components import components

    rng = random.Random(5)
    links = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 160)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    assert got == {x: find(x) for x in root}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_dedup_awkward(awkward, empty):
    rows = near_dedup.near_duplicates(awkward, 5, 80).collect()
    got = {r.doc_id: r for r in rows}
    assert len(rows) == 17 and got[2].component_id == 1 and got[6].component_id == 1 and got[10].component_id == 9 and got[13].component_id == 8
    assert all(r.component_id is None and r.kept for r in rows if r.doc_id is None) and got[3].component_id == 3 and got[4].n_shingles == 0
    kept = near_dedup.without_near_duplicates(awkward)
    assert kept.columns == awkward.columns and {r.doc_id for r in kept.collect()} == {1, 3, 4, 5, 7, 8, 9, 11, 12, 14, None}
    assert near_dedup.near_duplicates(empty).count() == 0


# 6: byte BPE


@pytest.fixture(scope="module")
def own():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_tiktoken(spark, texts, own):
    got = {r.doc_id: r for r in queries.op6(spark, SF).collect()}
    for d, t in texts.items():
        ids = own.encode_ordinary(t)
        assert got[d].n_tokens == len(ids)
        assert got[d].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[d].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()


def test_bpe_appends_and_edits(own):
    enc = byte_bpe.encoder(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    rng = random.Random(6)
    parts = ["a", "the", "ß", "日本", " ", "  ", "\n", "'", "re", "1", "🙂", "é", "!!", "\x1c", "<|endoftext|>", "　"]
    for _ in range(150):
        s = "".join(rng.choice(parts) for _ in range(rng.randrange(50)))
        assert enc.encode(s) == own.encode_ordinary(s) and enc.decode(enc.encode(s)) == s.encode()
        t = byte_bpe.EncodedText(enc, s)
        for _ in range(4):
            a = rng.randrange(len(t.text) + 1)
            t.replace(a, min(len(t.text), a + rng.randrange(4)), rng.choice(parts))
            assert t.ids() == own.encode_ordinary(t.text)
    piece = byte_bpe.Piece(enc.of, b"inter")
    piece.append(b"nationalisation")
    piece.replace(3, 6, b"xy")
    assert piece.ids() == own.encode_ordinary(piece.data.decode())


def test_bpe_awkward(awkward, empty):
    path = P.path("byte_bpe_multi_50k.tiktoken")
    rows = byte_bpe.bpe_digests(awkward, path, P.PATTERN, with_ids=True).collect()
    assert len(rows) == 17 and all((r.n_tokens == 0) == (r.doc_id in (3, 4) or r.ids == []) for r in rows) and all(len(r.ids) == r.n_tokens for r in rows)
    assert byte_bpe.bpe_digests(empty, path, P.PATTERN).count() == 0


# 7: license scan


def test_license_scan_finds_edited_notices(spark):
    rng = random.Random(7)
    mit = license_scan.TEMPLATES["MIT"].split()
    edited = mit[:30] + ["CHANGED"] + mit[31:]
    noise = lambda n: words(rng, n).split()
    made = [(1, " ".join(noise(700) + edited + noise(50))), (2, " ".join(mit[:40])), (3, "# Released UNDER the\n# MIT license!!"), (4, " ".join(noise(2000))), (5, "Released under the BSD License."), (6, " ".join(noise(509) + ["released", "under", "the", "mit", "license"] + noise(600)))]
    got = {r.doc_id: r.licenses for r in license_scan.scan_licenses(spark.createDataFrame(made, "doc_id long, text string")).collect()}
    assert got == {1: ["MIT"], 2: [], 3: ["MIT (short)"], 4: [], 5: [], 6: ["MIT (short)"]}


def test_every_template_is_found_wherever_it_stands(spark):
    """Each template behind some noise, once as it is and once with every twentieth word changed (if that leaves four fifths)."""
    rng = random.Random(13)
    made, own = [], {}
    for k, (name, text) in enumerate(sorted(license_scan.TEMPLATES.items())):
        w = text.split()
        changed = [f"edit{i}" if i % 40 == 20 else x for i, x in enumerate(w)] if len(w) > 60 else w
        made += [(2 * k, " ".join(words(rng, rng.randrange(1200)).split() + w + ["end"] * 9)), (2 * k + 1, " ".join(changed))]
        own[2 * k] = own[2 * k + 1] = name
    got = {r.doc_id: r.licenses for r in license_scan.scan_licenses(spark.createDataFrame(made, "doc_id long, text string")).collect()}

    def shingles(text):
        w = re.findall(r"[^\W_]+", text.lower())
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    for doc, text in made:
        assert own[doc] in got[doc]
        held = shingles(text)
        for name in got[doc]:  # nothing is reported that the whole text does not hold by four fifths
            wanted = shingles(license_scan.TEMPLATES[name])
            assert len(wanted & held) >= 0.8 * len(wanted)


def test_license_scan_awkward(awkward, empty):
    rows = license_scan.scan_licenses(awkward).collect()
    assert len(rows) == 17 and all(r.licenses == [] for r in rows)
    assert license_scan.scan_licenses(empty).count() == 0 and license_scan.scan_licenses(awkward, templates={}).count() == 17
    plan = license_scan.scan_licenses(awkward)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# 8: quality rules


def test_hosts_fall_with_their_documents(spark):
    good, bad = "one two three four five six seven eight nine ten eleven", "x"
    rows = [(i, bad, "en", "bad", 1) for i in range(90)] + [(i, good, "en", "bad", 1) for i in range(90, 100)] + [(i, good, "en", "good", 1) for i in range(100, 200)] + [(200, bad, "en", "small", 1), (201, good, "en", "small", 1)]
    rows += [(300 + i, good if i % 10 else bad, "en", f"h{i % 7}", 1) for i in range(140)]
    got = {r.doc_id: r for r in quality_rules.quality_rules(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert not got[95].kept and not got[95].base_failed and got[150].kept and got[201].kept and not got[200].kept


def plain_measures(text):
    """The measures by definition: words, their code points, symbols, repeated lines, words in repeated 5-word windows, lines."""
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen, hit = {}, set()
    for i in range(len(w) - 4):
        seen.setdefault(tuple(w[i : i + 5]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            hit |= {i + k for i in at for k in range(5)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit), len(lines)


def test_measures_equal_their_definition(awkward):
    rng = random.Random(12)
    texts = [r.text for r in awkward.select("text").collect()]
    for _ in range(300):
        texts.append("".join(rng.choice(["a", "b ", "c", " ", "\n", "\n", "a b a b ", "é", "#", "\xa0", "\x1c", "\t", "😀 "]) for _ in range(rng.randrange(60))))
    for t in texts:
        assert quality_rules.measures(t) == plain_measures(t), t


def test_each_rule_judges_hosts(spark):
    good = "one two three four five six seven eight nine ten eleven"
    odd, copied = good + " ###", "\n".join(f"{good} {i % 2}" for i in range(3))
    rows = [(i, odd, "en", "symbols", 1) for i in range(90)] + [(i, good, "en", "symbols", 1) for i in range(90, 100)]
    rows += [(i, "\n".join(["a b c d e f g h i j k"] + ["z"] * 3), "en", "lines", 1) for i in range(100, 190)] + [(i, good, "en", "lines", 1) for i in range(190, 200)]
    rows += [(i, good, "en", f"h{i % 5}", 1) for i in range(200, 400)] + [(400, copied, "en", "h1", 1)]
    got = {r.doc_id: r for r in quality_rules.quality_rules(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert not any(r.base_failed for r in got.values() if r.doc_id != 400) and not got[95].kept and not got[195].kept and got[300].kept
    assert got[95].host_rates.symbols > 0.5 > got[95].host_rates.lines and got[195].host_rates.lines > 0.5 > got[195].host_rates.base


def test_quality_rules_awkward(awkward, empty):
    rows = quality_rules.quality_rules(awkward).collect()
    for r, t in zip(sorted(rows, key=lambda r: (r.doc_id is None, r.doc_id or 0, r.n_words)), sorted(awkward.collect(), key=lambda t: (t.doc_id is None, t.doc_id or 0, len((t.text or "").split())))):
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain_measures(t.text)[:5]
    assert len(rows) == 17 and all(r.base_failed and r.n_words == 0 for r in rows if r.doc_id in (3, 4, 5))
    assert quality_rules.quality_rules(empty).count() == 0


# 9: HTML extraction


def test_main_text_of_a_page_with_everything():
    page = """<!DOCTYPE html><html><head><title>No</title><style>p{x:"</p>"}</style></head><body class="page">
    <header><a href=/>Home</a></header><div id="cookie-banner">We use cookies and all of that for you and it is not in the text.</div>
    <main><article><header><h1>The&nbsp;Title &amp; more</h1></header><p>First <b>part</b> of the text,<!-- hidden --> and
    it goes on and on for the reader who is in it.</p><p>Short.<div class="ad">Buy this and that from us, it is the best for you and for all of them.</div>
    <ul><li>One</li><li>Two</li></ul><form><p>Your name is the thing that we want to have in this form of ours.</p></form><script>if (a < b) { "<p>no</p>" }</script>
    <aside>See also the other article that is in the side bar of the page.</aside><p>Last <a href=x>link</a> of it &lt;ok&gt;</p></article>
    <section class="comments"><p>I think that this is the best of the texts that I have read in the last year.</p></section></main>
    <footer>All of the rights are in the hands of the owners of the site.</footer></body></html>"""
    assert html_text.main_text(page) == "The Title & more\nFirst part of the text, and it goes on and on for the reader who is in it.\nShort.\nOne\nTwo\nLast link of it <ok>"


def test_main_text_without_marks():
    menu = "<div>" + "".join(f"<p><a href=x>Item {i} of the menu</a></p>" for i in range(5)) + "</div>"
    prose = "<p>This is the text of the page and it is as long as it has to be for the rules to see that it is prose.</p>"
    assert html_text.main_text(menu + "<h2>Head</h2>" + prose + "<p>Short one</p>" + prose + "<p>(c) x</p>" + menu).split("\n")[:3] == ["Head", html_text.main_text(prose), "Short one"]


@pytest.mark.parametrize("page", [None, "", "plain text", "<", "<p", "<p>a<b", "<!-- open", "<script>never closed", "<a href='x", "&am", "<div>" * 3000 + "x" + "</div>" * 10])
def test_broken_pages_do_not_crash(page):
    assert isinstance(html_text.main_text(page), str)


def test_html_awkward(spark):
    rows = [(1, "u", "<article><p>a &amp; b</p></article>"), (1, "u", None), (None, None, "<article><p>x</article>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1))
    got = html_text.extract(df).collect()
    assert sorted((r.text, r.n_chars) for r in got) == [("", 0), ("a & b", 5), ("x", 1)] and html_text.extract(df.limit(0)).count() == 0


# 10: mixing


def test_water_filling(spark):
    def fill(sizes, weights, ratio, most):
        rows = [(k, sizes[k], float(weights[k])) for k in sizes]
        return {r.key: r.target for r in mixing.water_fill(spark.createDataFrame(rows, "key string, size long, weight double"), ratio, most).collect()}

    assert fill({"a": 10, "b": 100}, {"a": 3, "b": 1}, 100 / 110, 2) == pytest.approx({"a": 20.0, "b": 80.0})
    t = fill({"a": 100, "b": 100, "c": 100}, {"a": 3, "b": 1, "c": 2}, 1.5, 2)
    assert t["a"] == 200 and abs(t["c"] - 250 * 2 / 3) < 1e-9 and abs(sum(t.values()) - 450) < 1e-9
    assert fill({"a": 0}, {"a": 1}, 1.5, 2) == {"a": 0.0} and fill({}, {}, 1.5, 2) == {} and fill({"a": 10, "b": 10}, {"a": 1, "b": 0}, 1.5, 2) == {"a": 20.0, "b": 0.0}
    assert fill({"a": 10, "b": 10}, {"a": 1, "b": 1}, 5, 2) == {"a": 20.0, "b": 20.0}  # more is asked for than there is
    rng = random.Random(10)
    sizes, weights = {f"s{i}": rng.randrange(1, 1000) for i in range(200)}, {f"s{i}": rng.randrange(1, 4) for i in range(200)}
    t = fill(sizes, weights, 1.5, 2)
    assert abs(sum(t.values()) - 1.5 * sum(sizes.values())) < 1e-6 and all(t[k] <= 2 * sizes[k] for k in t)
    free = {round(t[k] / weights[k], 6) for k in t if t[k] < 2 * sizes[k]}
    assert len(free) == 1 and all(2 * sizes[k] / weights[k] <= max(free) + 1e-6 for k in t if t[k] == 2 * sizes[k])


def test_weights_repeat_over_any_number_of_sources(spark):
    names = ["b", None, "a", "ä", "z", "\U0001f600", "\uffee"] + [f"host{i:05d}" for i in range(3000)]
    df = spark.createDataFrame([("null" if n is None else f"={n}", n) for n in names], "key string, source string")
    got = {r.source: r.weight for r in mixing.cyclic_weights(df).collect()}
    ordered = sorted((n for n in names if n is not None), key=lambda n: [ord(c) for c in n]) + [None]
    assert got == {n: (3, 1, 2)[i % 3] for i, n in enumerate(ordered)}


def test_mix_meets_its_targets(spark, docs):
    rows = mixing.mix(docs, carry=["source"]).collect()
    by = {}
    for r in rows:
        assert 0 <= r.taken <= 2 * r["size"]
        s = by.setdefault(r.row.source, [0, r.target])
        s[0] += r.taken
    assert all(abs(taken - target) <= 1 for taken, target in by.values())
    assert rows_of(mixing.mix(docs)) == rows_of(mixing.mix(docs.repartition(7)))


def test_rows_without_an_id_are_spread_and_mixed_like_others(spark):
    rows = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("one two w"), F.col("id").cast("string")).alias("text"), F.lit("hot").alias("source"))
    ranges = rows.select(F.substring(mixing._turn(F.col("doc_id"), F.col("text"), 7), 1, 3).alias("r")).groupBy("r").count()
    assert ranges.count() > 1500 and ranges.agg(F.max("count")).first()[0] < 12
    out = mixing.mix(rows).agg(F.sum("taken").alias("taken"), F.max("target").alias("target"), F.count(F.lit(1)).alias("n")).first()
    assert out.n == 3000 and out.taken == round(out.target)


def test_mixing_awkward(awkward, empty):
    rows = mixing.mix(awkward, carry=["source"]).collect()
    assert len(rows) == 17 and all(r.taken == 0 for r in rows if r["size"] == 0)
    # By hand: sizes by source, weights 3, 1, 2 and again 3, and a level at which the targets add up to 150 %.
    sizes, taken = {}, {}
    for r in rows:
        sizes[r.row.source] = sizes.get(r.row.source, 0) + r["size"]
        taken[r.row.source] = taken.get(r.row.source, 0) + r.taken
    weights = dict(zip(["a", "b", "c", None], (3, 1, 2, 3)))
    low, high = 0.0, 1e9
    for _ in range(200):
        level = (low + high) / 2
        low, high = (level, high) if sum(min(2 * sizes[k], level * weights[k]) for k in sizes) < 1.5 * sum(sizes.values()) else (low, level)
    for r in rows:
        assert r.source_size == sizes[r.row.source] and abs(r.target - min(2 * sizes[r.row.source], level * weights[r.row.source])) < 1e-3
    assert all(abs(taken[k] - min(2 * sizes[k], level * weights[k])) <= 1 for k in sizes)
    out = mixing.mixed(awkward)
    assert out.columns == awkward.columns and out.count() == sum(r.copies for r in rows)
    assert mixing.mix(empty).count() == 0 and mixing.mixed(empty).count() == 0


def test_bpe_memory_is_bounded_in_bytes_and_freed_with_the_task():
    enc = byte_bpe.encoder(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    enc.clear()
    words = [f"w{i * 7919 % 100003}ord{i}" for i in range(4000)]
    text = " ".join(words + words[::-1])
    whole = enc.packed(text)
    enc.clear()
    enc.memory.most = enc.of.memory.most = 100_000
    try:
        assert enc.packed(text) == whole, "forgetting changes no result"
        for memory in (enc.memory, enc.of.memory):
            held = [(k, v) for side in (memory.old, memory.new) for table in side.values() for k, v in table.items()]
            assert sum(sys.getsizeof(k) + (sys.getsizeof(v) if isinstance(v, (bytes, list)) else 0) for k, v in held) <= 110_000
    finally:
        enc.memory.most, enc.of.memory.most = byte_bpe.MEMO_BYTES, byte_bpe.PAIR_BYTES
    enc.clear()
    assert not any(enc.memory.new.values()) and not any(enc.memory.old.values()) and not enc.of.memory.new["pairs"]
    assert len(whole) // 4 > 8000
