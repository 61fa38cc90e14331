"""Exact nearest neighbours by lists against all distances."""

import numpy as np
import pytest

from stemframe.operators import pitch
from tests.test_growth import stage_rows

SCHEMA = "vec_id long, vec array<double>"


def brute(queries, index, k):
    ids = np.array([i for i, _ in index])
    x = np.array([v for _, v in index])
    out = []
    for q, v in queries:
        d = ((x - np.array(v)) ** 2).sum(axis=1)
        order = [j for j in np.lexsort((ids, d)) if ids[j] != q][:k]
        out += [(q, int(ids[j]), round(float(d[j]), 9)) for j in order]
    return sorted(out)


def made(spark, v, ids):
    rows = [(int(i), [float(c) for c in x]) for i, x in zip(ids, v)]
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.mark.parametrize("kind", ["even", "clustered", "copies", "few"])
def test_nearest_equals_all_distances(spark, kind):
    rng = np.random.default_rng(1)
    v = {"even": rng.normal(size=(300, 6)), "clustered": np.repeat(rng.normal(size=(12, 6)) * 20, 25, axis=0) + rng.normal(size=(300, 6)), "copies": np.repeat(rng.integers(0, 3, size=(30, 3)), 10, axis=0).astype(float), "few": rng.normal(size=(5, 4))}[kind]
    rows, index = made(spark, v, rng.permutation(1000)[: len(v)])
    asked, queries = made(spark, np.vstack((v[: len(v) // 3], rng.normal(size=(9, v.shape[1])) * 5)), [*[r[0] for r in rows[: len(v) // 3]], *range(2000, 2009)])
    got = sorted((r.query, r.hit, round(r.d, 9)) for r in pitch.nearest(queries, index, 8, 64).collect())
    assert got == brute(asked, rows, 8)


def test_lists_that_cannot_hold_a_nearer_vector_are_skipped(spark):
    """Of clustered vectors few are compared, and the share falls as the index grows."""
    shares = []
    for n in (500, 4000):
        rng = np.random.default_rng(2)
        v = np.repeat(rng.normal(size=(n // 25, 8)) * 10, 25, axis=0) + 0.3 * rng.normal(size=(n, 8))
        _, index = made(spark, v, range(n))
        compared = spark.sparkContext.accumulator(0)
        assert pitch.nearest(index.filter("vec_id % 10 = 0"), index, 4, 512, compared).count() == 4 * n // 10
        shares.append(compared.value / (n * n / 10))
    assert shares[1] < 0.6 * shares[0] and shares[1] < 0.05


def test_an_empty_index_has_no_hits(spark):
    _, index = made(spark, np.ones((3, 2)), range(3))
    assert pitch.nearest(index, index.limit(0)).count() == 0 and pitch.nearest(index.limit(0), index).count() == 0


def test_queries_go_to_blocks_of_the_index_not_to_each_list(spark):
    """On even vectors no list can be skipped; rows that are exchanged stay near the numbers of vectors and queries."""
    _, index = made(spark, np.random.default_rng(4).normal(size=(2500, 6)), range(2500))

    class Lazy:
        @property
        def write(self):
            return pitch.nearest(index.filter("vec_id % 5 = 0"), index, 8).write

    assert stage_rows(spark, Lazy()) < 500 * 50


@pytest.mark.parametrize("kind", ["even", "copies", "far"])
def test_blocks_of_any_size_give_all_distances(spark, monkeypatch, kind):
    monkeypatch.setattr(pitch, "BLOCK_INDEX", 37)
    monkeypatch.setattr(pitch, "BLOCK_QUERIES", 20)
    rng = np.random.default_rng(5)
    v = {"even": rng.normal(size=(300, 6)), "copies": np.repeat(rng.normal(size=(3, 6)), 100, axis=0), "far": 1e6 + rng.normal(size=(300, 6))}[kind]
    rows, index = made(spark, v, rng.permutation(1000)[:300] - 500)
    got = sorted((r.query, r.hit, round(r.d, 9)) for r in pitch.nearest(index.limit(60), index, 8, 64).collect())
    assert got == [r for r in brute(rows, rows, 8) if r[0] in {q for q, _, _ in got}] and len(got) == 60 * 8
