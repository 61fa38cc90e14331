"""Near vectors against brute force."""

import numpy as np
import pytest

from stemframe.llm import pivot_index as P
from stemframe.llm import queries

SCHEMA = "vec_id long, label int, embedding array<float>"


def rows_of(frame):
    return sorted((tuple(r) for r in frame.select("vec_id", "n_links", "component_id", "kept").collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def family(rng, centre, n, spread):
    return centre + spread * rng.normal(size=(n, centre.size)) / np.sqrt(centre.size)


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.label, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert rows_of(queries.QUERIES["op11_embedding_near_dedup"](spark, sf)) == sorted(P.brute_force(rows))


@pytest.mark.parametrize("tile", [16, 1024])
def test_families_copies_and_labels(spark, tile):
    """A family of a third of all rows, chains of links, copies, three labels: as brute force, whatever the tiles."""
    rng = np.random.default_rng(tile)
    centres = rng.normal(size=(30, 24))
    parts = [family(rng, centres[0], 250, 0.12)] + [family(rng, c, 8, s) for c, s in zip(centres[1:], np.linspace(0.02, 0.3, 29))] + [rng.normal(size=(200, 24))]
    line = np.array([np.cos(t) * centres[1] + np.sin(t) * centres[2] for t in np.linspace(0, 2, 40)])
    v = np.vstack(parts + [line, np.repeat(parts[0][:3], 20, axis=0)]).astype(np.float32)
    order = rng.permutation(len(v))
    rows = [(int(k), int(k) % 3 if k > 40 else 0, [float(x) for x in v[at]]) for k, at in enumerate(order)]
    want = sorted(P.brute_force(rows))
    have = rows_of(P.near_vectors(spark.createDataFrame(rows, SCHEMA).repartition(3), tile=tile))
    found, true = sum(r[1] for r in have), sum(r[1] for r in want)
    assert true > 10_000 and found >= 0.999 * true
    assert all(h[1] <= w[1] for h, w in zip(have, want)), "no link below the threshold, none counted twice"
    assert sum(h == w for h, w in zip(have, want)) >= 0.99 * len(want)


def test_tiles_hold_each_pair_once():
    """Every pair in the lists of one dense family is judged in exactly one of them."""
    rng = np.random.default_rng(5)
    v = family(rng, rng.normal(size=16), 60, 0.3)
    near = np.sort(np.array([rng.permutation(14)[: P.NEAREST] for _ in v]), axis=1)
    post = P.NEAREST - P.SHARED + 1
    seen = []
    for pivot in range(14):
        own = np.flatnonzero((near[:, :post] == pivot).any(axis=1))
        half = np.arange(own.size) % 2 == 0
        for i, j in ((half, half), (half, ~half), (~half, ~half)):
            a, b = P.tile_links(i, j, near[own], v[own], pivot, -1.0)
            seen += [tuple(sorted(x)) for x in zip(own[a], own[b])]
    shared = lambda a, b: len(set(near[a]) & set(near[b])) >= P.SHARED
    assert sorted(seen) == [(a, b) for a in range(60) for b in range(a + 1, 60) if shared(a, b)]


def test_pivots_are_apart_and_bounded():
    rng = np.random.default_rng(2)
    sample = [list(x) for x in np.vstack((family(rng, rng.normal(size=12), 300, 0.1), rng.normal(size=(300, 12))))]
    pivots = P.chosen_pivots(sample + [[1.0, 2.0]], 40)
    assert set(pivots) == {2, 12} and len(pivots[12]) <= 40
    cosine = pivots[12] @ pivots[12].T
    assert (cosine[np.triu_indices(len(cosine), 1)] < P.APART).all()


def test_awkward(spark):
    """Null ids, labels, vectors and components, zeros, NaN, infinity, lengths, repeated ids, clashing columns, no rows."""
    x, y, far = [1.0, 2.0, 3.0], [1.0, 2.0, 3.1], [-3.0, 0.0, 1.0]
    rows = [
        (1, 1, x), (2, 1, [2.0, 4.0, 6.0]), (3, 2, x), (4, None, x), (None, 1, x), (5, 1, None), (6, 1, []), (7, 1, [0.0] * 3), (8, 1, [1.0, None, 3.0]),
        (9, 1, [1.0, float("nan"), 3.0]), (10, 1, [1.0, float("inf"), 3.0]), (11, 1, [1.0, 2.0]), (12, 1, [1e-30, 2e-30, 3e-30]), (13, 1, far), (13, 1, y), (14, 2, far), (15, 1, far), (16, 1, [3e38, 3e38, 3e38]), (17, 1, [1.0, 1.0, 1.0]),
    ]
    docs = spark.createDataFrame([(*r, 1, "x", 0.5) for r in rows], SCHEMA + ", n int, class string, near double").repartition(4)
    have = rows_of(P.near_vectors(docs))
    alone = lambda i: (i, 0, i, True)
    want = [(1, 3, 1, True), (2, 3, 1, False), alone(3), *map(alone, range(4, 12)), (12, 3, 1, False), (13, 1, 1, False), (13, 3, 1, False), alone(14), (15, 1, 1, False), (16, 1, 16, True), (17, 1, 16, False), (None, 0, None, True)]
    assert have == want
    assert P.near_vectors(docs.limit(0)).count() == 0
