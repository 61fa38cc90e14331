"""Near duplicates among vectors by a pivot-permutation index.

1. Reference points (pivots) are chosen from a bounded sample of the distinct vectors, so that no two are close.
   A vector is described by its NEAREST pivots in order; only these few ordered numbers are indexed.
2. Inverted lists: a pivot's list holds the vectors near to it. Vectors whose descriptions share at least SHARED
   pivots are candidates. Of two such vectors, both are in the list of one of their NEAREST - SHARED + 1 rarest
   pivots, so that a vector goes to so many lists only.
3. A list is worked on in tiles of bounded size, pairs of tiles as tasks of their own. The counts of shared pivots are
   one matrix product of a tile pair; candidates are then verified by their cosine in double precision. A pair
   is judged in the first of the lists that both are in. Out of a tile pair come sums of links for each
   vector and a spanning forest of the links, never the pairs.
4. Components of these forests are found by alternating large-star and small-star.

Equal vectors are one class from the start, so that copies cost nothing; links count them all.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stemframe.llm.common import working
from stemframe.llm.components import components
from stemframe.storage import discard, staged

#: Pivots in a description, and how many of them two candidates share. At cosine 0.98 in 64 dimensions one pair in 5,000 shares fewer.
NEAREST, SHARED = 10, 4
#: Pivots grow with the square root of the vectors, between these; the sample they are chosen from is so many times as large.
LEAST_PIVOTS, MOST_PIVOTS, SAMPLE = 16, 4096, 2
#: Pivots are less similar to each other than this, so that a dense family of vectors has few of them.
APART = 0.9
#: Vectors of a tile.
TILE = 1024


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled by their largest component first, so that no square is too large or too small."""
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def _usable(vector: str) -> Column:
    """Not null or empty, all components finite, one of them not zero."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(vector).isNotNull() & ~odd & F.exists(vector, lambda x: x != 0)


def chosen_pivots(sample: list, most: int) -> dict[int, np.ndarray]:
    """By dimension: up to ``most`` vectors of the sample, in its order, of which no two are close. The rarest come
    first: those that are near to the fewest vectors of the sample."""
    found = {}
    for size in {len(v) for v in sample}:
        own = unit(np.array([v for v in sample if len(v) == size], float))
        kept = np.empty((0, size))
        for start in range(0, len(own), 64):
            block = own[start : start + 64]
            for v in block[(block @ kept.T < APART).all(axis=1)] if len(kept) else block:
                if len(kept) < most and (kept @ v < APART).all():
                    kept = np.vstack((kept, v))
        near = np.argsort(-(own @ kept.T), axis=1, kind="stable")[:, :NEAREST]
        found[size] = kept[np.argsort(np.bincount(near.ravel(), minlength=len(kept)), kind="stable")]
    return found


def _described(classes: DataFrame, pivots) -> DataFrame:
    """``classes`` with ``near``: the numbers of the nearest pivots, nearest first."""

    def run(batches):
        working("pivot_index")
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("vector"))
            sizes = np.diff(column.offsets.to_numpy())
            flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
            ends = np.cumsum(sizes)
            near: list = [None] * batch.num_rows
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                if size not in pivots.value:  # nothing of this dimension was sampled: one list for all
                    for i in at:
                        near[i] = np.zeros(1, np.int32)
                    continue
                own = pivots.value[size]
                for part in np.array_split(at, max(1, at.size * len(own) // 4_000_000 + 1)):
                    cosine = unit(flat[(ends[part] - size)[:, None] + np.arange(size)]) @ own.T
                    nearest = np.argsort(-cosine, axis=1, kind="stable")[:, :NEAREST].astype(np.int32)
                    for i, numbers in zip(part, nearest):
                        near[i] = numbers
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near, pa.list_(pa.int32()))], names=[*batch.schema.names, "near"])

    kind = dict(classes.dtypes)
    return classes.mapInArrow(run, ", ".join(f"`{c}` {kind[c]}" for c in classes.columns) + ", near array<int>")


def _judge(least: float):
    """Of a tile pair: (a, its class, null, number of rows linked to a) and (a, its class, b, null), a spanning forest of the links."""

    def run(key, rows):
        working("pivot_index")
        _, size, pivot, i, j = (k.as_py() for k in key)
        pairs = tile_links(
            rows.column("tile").to_numpy() == i, rows.column("tile").to_numpy() == j,
            np.sort(rows.column("near").combine_chunks().flatten().to_numpy().reshape(rows.num_rows, -1), axis=1),
            rows.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, size), pivot, least,
        )
        rep, class_id, n = (rows.column(c).to_numpy() for c in ("rep", "class", "n"))
        a, b = pairs
        weight = np.bincount(np.r_[a, b], np.r_[n[b], n[a]], rows.num_rows).astype(np.int64)
        linked = np.flatnonzero(weight)
        root = np.arange(rows.num_rows)
        while True:  # every vector takes the least number among those it is linked to
            new = root.copy()
            np.minimum.at(new, a, root[b])
            np.minimum.at(new, b, root[a])
            new = new[new]
            if (new == root).all():
                break
            root = new
        child = linked[root[linked] != linked]
        none = pa.nulls(linked.size, pa.int64())
        return pa.table(
            {
                "a": np.r_[rep[linked], rep[child]],
                "class": np.r_[class_id[linked], class_id[child]],
                "b": pa.chunked_array([none, pa.array(rep[root[child]], pa.int64())]).combine_chunks(),
                "n": pa.chunked_array([pa.array(weight[linked], pa.int64()), pa.nulls(child.size, pa.int64())]).combine_chunks(),
            }
        )

    return run


def tile_links(left: np.ndarray, right: np.ndarray, near: np.ndarray, vectors: np.ndarray, pivot: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows, one of ``left`` and one of ``right`` (the same tile: each pair once), that share enough pivots,
    are not judged in an earlier list, and have a cosine of ``least`` or more."""
    left, right = np.flatnonzero(left), np.flatnonzero(right)
    share = min(SHARED, near.shape[1])
    posted = near[:, : near.shape[1] - share + 1]
    names, code = np.unique(near, return_inverse=True)
    holds = np.zeros((len(near), names.size), np.float32)
    np.put_along_axis(holds, code.reshape(near.shape), 1, axis=1)
    candidate = holds[left] @ holds[right].T >= share
    earlier = np.searchsorted(names, pivot)
    if earlier:
        before = np.zeros((len(near), names.size + 1), np.float32)
        np.put_along_axis(before, np.where(posted < pivot, code.reshape(near.shape)[:, : posted.shape[1]], names.size), 1, axis=1)
        candidate &= before[left, :earlier] @ before[right, :earlier].T == 0
    if left.size == right.size and (left == right).all():
        candidate &= left[:, None] < right
    a, b = np.nonzero(candidate)
    vectors = unit(vectors)
    if a.size > candidate.size // 16:
        cosine = (vectors[left] @ vectors[right].T)[a, b]
    else:
        cosine = np.einsum("ij,ij->i", vectors[left[a]], vectors[right[b]])
    linked = cosine >= least
    return left[a[linked]], right[b[linked]]


def near_vectors(table: DataFrame, least: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", tile: int = TILE) -> DataFrame:
    """Per input row: vec_id, n_links, component_id, kept.

    Two rows are linked if their labels are equal and their vectors have a cosine of ``least`` or more; n_links is the number
    of rows linked to a row, component_id the least id that links reach, and that row is kept. Every link that
    is found is verified; pairs that share fewer than SHARED of NEAREST pivots are missed.

    * Rows with a null label, and vectors that are null, empty or zero, or that hold null or non-finite components, are linked
      with nothing; vectors of different lengths have no cosine.
    * Rows that repeat an id are vectors of their own, linked with each other if their vectors are similar; they share a component.
    * A row without an id is linked with nothing; its component is null and it is kept.
    * An empty table gives no rows; other columns are ignored.

    ``tile`` changes how work is split, not the result.
    """
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector"))
    known = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & _usable("vector"))
    classes = known.groupBy("label", "vector").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n"))
    # An id with several rows may stand for several classes; with a hash of the class it tells them apart.
    classes = staged(classes.withColumn("class", F.xxhash64("label", "vector")), "classes")
    n_classes = classes.count()
    most = min(MOST_PIVOTS, max(LEAST_PIVOTS, 1 << round(np.log2(max(1, n_classes)) / 2)))
    sample = [r.vector for r in classes.orderBy(F.xxhash64("vector"), "rep").limit(SAMPLE * most).select("vector").collect()]
    pivots = table.sparkSession.sparkContext.broadcast(chosen_pivots(sample, most))
    described = staged(_described(classes, pivots).withColumn("size", F.size("vector")), "described")

    n_lists = F.size("near") - F.least(F.lit(SHARED), F.size("near")) + 1
    posted = described.withColumn("pivot", F.explode(F.slice(F.array_sort("near"), F.lit(1), n_lists)))
    lists = posted.groupBy("label", "size", "pivot").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    lists = staged(lists.select("label", "size", "pivot", F.ceil(F.col("members") / tile).cast("int").alias("tiles")), "lists")
    members = posted.join(lists, ["label", "size", "pivot"]).withColumn("tile", F.pmod(F.xxhash64("vector", F.lit(1)), F.col("tiles")).cast("int"))
    dealt = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    dealt = dealt.select("label", "size", "pivot", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "tile", "rep", "class", "n", "near", "vector")
    judged = staged(dealt.groupBy("label", "size", "pivot", "i", "j").applyInArrow(_judge(least), "a long, class long, b long, n long"), "judged")
    return _joined(rows, classes, judged, [described, lists])


def _joined(rows: DataFrame, classes: DataFrame, judged: DataFrame, used: list[DataFrame]) -> DataFrame:
    degrees = judged.filter("b IS NULL").groupBy(F.col("a").alias("rep"), "class").agg(F.sum("n").alias("linked"))
    found = staged(components(judged.filter("b IS NOT NULL").select("a", "b")), "found")
    own = classes.join(degrees, ["rep", "class"], "left").join(found.withColumnRenamed("node", "rep"), "rep", "left")
    by_class = own.select("label", "vector", (F.coalesce("linked", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    by_class = staged(by_class.filter((F.col("n_links") > 0)), "by_class")
    discard(judged, found, classes, *used)
    out = rows.withColumn("usable", F.col("vec_id").isNotNull() & F.col("label").isNotNull() & _usable("vector"))
    out = out.select("vec_id", F.when(F.col("usable"), F.col("label")).alias("label"), F.when(F.col("usable"), F.col("vector")).alias("vector"))
    out = out.join(by_class, ["label", "vector"], "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def brute_force(rows: list[tuple], least: float = 0.98) -> list[tuple]:
    """The same by definition, for tests, for distinct ids: (vec_id, label, vector) rows to (vec_id, n_links, component_id, kept)."""

    def usable(vec_id, label, v):
        return vec_id is not None and label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)

    index = [k for k, r in enumerate(rows) if usable(*r)]
    root, degree = list(range(len(rows))), [0] * len(rows)
    for label, size in {(rows[k][1], len(rows[k][2])) for k in index}:
        own = [k for k in index if rows[k][1] == label and len(rows[k][2]) == size]
        v = np.array([rows[k][2] for k in own], float)
        v /= np.sqrt((v * v).sum(axis=1, keepdims=True))
        for x, y in zip(*np.nonzero(v @ v.T >= least)):
            if x != y:
                degree[own[x]] += 1
                a, b = own[x], own[y]
                while root[a] != a:
                    a = root[a]
                while root[b] != b:
                    b = root[b]
                root[max(a, b, key=lambda k: rows[k][0])] = min(a, b, key=lambda k: rows[k][0])
    out = []
    for k, (vec_id, *_) in enumerate(rows):
        a = k
        while root[a] != a:
            a = root[a]
        out.append((vec_id, degree[k], rows[a][0], vec_id == rows[a][0]))
    return out
