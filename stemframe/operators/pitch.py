"""Pitch curves and feature retrieval."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stemframe import fixtures as fx
from stemframe.operators.frames import with_length
from stemframe.operators.scans import BLOCK, known_around
from stemframe.registry import query, table
from stemframe.storage import discard, staged

KEYS = ["track", "stem"]


def f0_decode(salience: DataFrame, keys: list[str], threshold: float, reach: int = 4) -> DataFrame:
    """f0 by key from salience rows (k, s): weighted mean of the cents around the peak; 0 where the peak is not above the threshold."""
    peak = salience.groupBy(*keys).agg(F.max_by(F.struct("k", "s"), F.struct("s", -F.col("k"))).alias("p")).select(*keys, F.col("p.k").alias("top"), F.col("p.s").alias("best"))
    near = salience.join(peak, keys).filter(F.abs(F.col("k") - F.col("top")) <= reach)
    cents = 20 * F.col("k") + 1997.3794084376191
    f = near.groupBy(*keys, "best").agg((F.sum(F.col("s") * cents) / F.sum("s")).alias("cents"))
    return f.select(*keys, F.when(F.col("best") > threshold, 10 * F.pow(F.lit(2.0), F.col("cents") / 1200)).otherwise(0.0).alias("f0"))


def f0_range_gate(f0: str | Column, low: float, high: float) -> Column:
    f0 = F.col(f0) if isinstance(f0, str) else f0
    return F.when((f0 < low) | (f0 > high), 0.0).otherwise(f0)


def f0_interpolate_unvoiced(df: DataFrame, keys: list[str], block: int = BLOCK) -> DataFrame:
    """Zeros filled on a line between the voiced neighbours, edges held; none voiced: 0. Adds ``voiced``."""
    df = known_around(df, keys, F.when(F.col("f0") > 0, F.struct("pos", "f0")), block=block).withColumnsRenamed({"back": "a", "ahead": "b"})
    line = F.col("a.f0") + (F.col("b.f0") - F.col("a.f0")) * (F.col("pos") - F.col("a.pos")) / (F.col("b.pos") - F.col("a.pos"))
    filled = F.when(F.col("f0") > 0, F.col("f0")).when(F.col("a").isNull() & F.col("b").isNull(), 0.0).when(F.col("a").isNull(), F.col("b.f0")).when(F.col("b").isNull(), F.col("a.f0")).otherwise(line)
    return df.select(*keys, "pos", filled.alias("f0"), (F.col("f0") > 0).alias("voiced"))


def f0_resize(df: DataFrame, keys: list[str], target: int, least: float = 0.001) -> DataFrame:
    """The curve at ``target`` evenly scaled places i n / target, on a line between frames; gaps (values below ``least``) give 0."""
    n = with_length(df, keys).select(*keys, "n").distinct()
    grid = n.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(target - 1)))).withColumn("x", F.col("i") * F.col("n") / target)
    grid = grid.withColumn("pos", F.floor("x").cast("long")).withColumn("next", F.least(F.col("pos") + 1, F.col("n") - 1).cast("long"))
    known = F.when(F.col("f0") >= least, F.col("f0"))
    a, b = df.select(*keys, F.col("pos").cast("long").alias("pos"), known.alias("a")), df.select(*keys, F.col("pos").cast("long").alias("next"), known.alias("b"))
    t = F.col("x") - F.col("pos")
    both = grid.join(a, [*keys, "pos"]).join(b, [*keys, "next"])
    at = F.when(t == 0, F.col("a")).otherwise(F.col("a") * (1 - t) + F.col("b") * t)
    return both.select(*keys, "i", F.coalesce(at, F.lit(0.0)).alias("f0"))


def f0_transpose(f0: Column, semitones: float) -> Column:
    return f0 * F.pow(F.lit(2.0), F.lit(semitones / 12))


def f0_override(df: DataFrame, curve: DataFrame, keys: list[str], block: int = BLOCK) -> DataFrame:
    """A user's curve (keys, pos, f) replaces the span it covers, interpolated between its points.

    Curve points and frames are merged into one ordered series, so that the as-of lookups are scans, not an
    inequality join.
    """
    points = curve.select(*keys, "pos", F.col("f").alias("f"), F.lit(None).cast("double").alias("f0"), F.lit(0).alias("own"))
    rows = df.select(*keys, "pos", F.lit(None).cast("double").alias("f"), "f0", F.lit(1).alias("own")).unionByName(points)
    rows = known_around(rows, keys, F.when(F.col("f").isNotNull(), F.struct("pos", "f")), ["own"], block).withColumnsRenamed({"back": "a", "ahead": "b"}).filter("own = 1")
    t = (F.col("pos") - F.col("a.pos")) / (F.col("b.pos") - F.col("a.pos"))
    line = F.when(F.col("a.pos") == F.col("b.pos"), F.col("a.f")).otherwise(F.col("a.f") * (1 - t) + F.col("b.f") * t)
    return rows.select(*keys, "pos", F.coalesce(line, F.col("f0")).alias("f0"))


def f0_coarse(f0: Column, low: float = 50.0, high: float = 1100.0) -> Column:
    """1..255 on the mel scale, rounded half to even."""
    mel = lambda f: 1127 * F.log(1 + f / 700)
    lo, hi = mel(F.lit(low)), mel(F.lit(high))
    m = mel(f0)
    scaled = F.when(m > 0, (m - lo) * 254 / (hi - lo) + 1).otherwise(m)
    return F.bround(F.greatest(F.lit(1.0), F.least(scaled, F.lit(255.0))), 0).cast("int")


#: Centres of lists: the root of the index's size, of a sample of so many rows at most.
MOST_CENTRES, SAMPLE = 1024, 8192


def centres_of(index: DataFrame, most: int = MOST_CENTRES) -> np.ndarray:
    """Up to ``most`` vectors that are far from each other, out of a bounded sample in order of a hash: each is the farthest from those before it."""
    wanted = min(most, max(1, round(math.sqrt(index.count()))))
    rows = index.orderBy(F.xxhash64("vec"), "vec_id").limit(min(SAMPLE, 8 * wanted)).select("vec").collect()
    x = np.array([r.vec for r in rows], float)
    if not len(x):
        return np.zeros((0, 0))
    chosen, d = [0], ((x - x[0]) ** 2).sum(axis=1)
    while len(chosen) < min(wanted, len(x)) and d.max() > 0:
        chosen.append(int(d.argmax()))
        d = np.minimum(d, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
    return x[chosen]


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """From each vector (up to 256) to each centre."""
    return np.sqrt(((x[:, None, :] - c[None, :, :]) ** 2).sum(axis=2)) if c.size * len(x) < 4_000_000 else np.stack([np.sqrt(((c - v) ** 2).sum(axis=1)) for v in x])


def _placed(vectors: DataFrame, centres) -> DataFrame:
    """id, x (doubles) and cell: the nearest centre, and its distance."""

    def run(batches):
        c = centres.value
        for pdf in batches:
            for at in range(0, len(pdf), 256):
                part = pdf.iloc[at : at + 256]
                d = _distances(np.stack(part["x"].to_numpy()).astype(float), c)
                yield part.assign(cell=d.argmin(axis=1), d=d.min(axis=1))

    rows = vectors.select(F.col("vec_id").cast("long").alias("id"), F.transform("vec", lambda v: v.cast("double")).alias("x"))
    return rows.mapInPandas(run, "id long, x array<double>, cell int, d double")


def _tiles(rows: DataFrame, size: int, prefix: str, *more: str) -> DataFrame:
    """Rows of about ``size`` vectors of a cell: cell, and the columns id, d, x and ``more`` as arrays."""
    counts = rows.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias("tiles"))
    dealt = rows.join(counts, "cell").withColumn("tile", F.pmod(F.xxhash64("id"), F.col("tiles")))
    names = ["id", "d", "x", *more]
    packed = dealt.groupBy("cell", "tile").agg(F.collect_list(F.struct(*names)).alias("s"))
    of = lambda c: F.flatten(F.transform("s", lambda s: s[c])) if c == "x" else F.transform("s", lambda s: s[c])
    return packed.select("cell", *[of(c).alias(f"{prefix}_{c}") for c in names])


def _met(q: DataFrame, x: DataFrame, k: int, tile: int, compared) -> DataFrame:
    """(query, hit, d) of the k nearest in each tile of their cells: q has id, x, cell, d and bound (a distance beyond which nothing counts), x has id, x, cell, d."""
    pairs = _tiles(q, 256, "q", "bound").join(_tiles(x, tile, "x"), "cell")

    def run(batches):
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                qi, xi, qd, xd = (np.asarray(c) for c in (row.q_id, row.x_id, row.q_d, row.x_d))
                a, b = np.asarray(row.q_x, float).reshape(qi.size, -1), np.asarray(row.x_x, float).reshape(xi.size, -1)
                order = np.argsort(xi, kind="stable")
                xi, b, xd = xi[order], b[order], xd[order]
                found = []
                for n, own in enumerate(qi):
                    # Of a list only the shell can be nearer than the bound: |d(q, centre) - d(x, centre)| <= d(q, x).
                    shell = np.flatnonzero((np.abs(xd - qd[n]) <= row.q_bound[n]) & (xi != own))
                    if shell.size:
                        if compared is not None:
                            compared.add(int(shell.size))
                        d = ((b[shell] - a[n]) ** 2).sum(axis=1)
                        best = np.argsort(d, kind="stable")[:k]
                        found.append((np.full(best.size, own), xi[shell[best]], d[best]))
                if found:
                    yield pd.DataFrame(dict(zip(("query", "hit", "d"), map(np.concatenate, zip(*found)))))

    return pairs.select("q_id", "q_d", "q_x", "q_bound", "x_id", "x_d", "x_x").mapInPandas(run, "query long, hit long, d double")


def _merged(top: tuple[np.ndarray, np.ndarray], row: np.ndarray, d: np.ndarray, hit: np.ndarray) -> None:
    """Take found (row, d, hit) into the rows of ``top``, (d, hit) of the k nearest so far in their order."""
    rows, k = np.unique(row), top[0].shape[1]
    row = np.concatenate((np.repeat(rows, k), row))
    d, hit = np.concatenate((top[0][rows].ravel(), d)), np.concatenate((top[1][rows].ravel(), hit))
    order = np.lexsort((hit, d, row))
    row, d, hit = row[order], d[order], hit[order]
    begin = np.searchsorted(row, rows)[:, None] + np.arange(k)
    top[0][rows], top[1][rows] = d[begin], hit[begin]


def _block_met(a: np.ndarray, own: np.ndarray, bound: np.ndarray, b: np.ndarray, ids: np.ndarray, top: tuple[np.ndarray, np.ndarray], rows: np.ndarray, centre: np.ndarray) -> None:
    """Queries a (ids own, distances bound, places rows in ``top``) against vectors b: products bound the distances, and those that may count are computed as they are."""
    x, y = a - centre, b - centre
    xx, yy = (x * x).sum(axis=1), (y * y).sum(axis=1)
    limit = np.minimum(bound * bound, top[0][rows, -1])
    error = 1e-12 * (xx[:, None] + yy[None, :]) + 1e-300
    at, to = np.nonzero(xx[:, None] + yy[None, :] - 2 * (x @ y.T) <= limit[:, None] + error)
    keep = ids[to] != own[at]
    at, to = at[keep], to[keep]
    step = max(1, 2_000_000 // a.shape[1])
    for k in range(0, len(at), step):
        one, other = at[k : k + step], to[k : k + step]
        d = ((b[other] - a[one]) ** 2).sum(axis=1)
        near = d <= limit[one]
        if near.any():
            _merged(top, rows[one[near]], d[near], ids[other[near]])


#: Queries and vectors of the index that meet in a task at once.
BLOCK_QUERIES, BLOCK_INDEX = 16_384, 16_384
#: Stands for no hit, behind all others.
NONE = np.iinfo(np.int64).max


def _searched(q: DataFrame, x: DataFrame, k: int, centres, compared) -> DataFrame:
    """(query, hit, d): the k nearest in each block of the index, of lists that a query has not looked into.

    q has bucket, part, id, x, bound, seen (an array of lists), x has bucket, part, id, x, cell and d. Queries and vectors of a
    bucket and part meet in one task; they are blocks of bounded size, whatever lists the queries ask for.
    """

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        flat = lambda table: table.column("x").combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1)
        number = lambda table, name: table.column(name).to_numpy()
        if not left.num_rows or not right.num_rows:
            return pa.Table.from_pydict({"query": pa.array([], pa.int64()), "hit": pa.array([], pa.int64()), "d": pa.array([], pa.float64())})
        a, own, bound = flat(left), number(left, "id"), number(left, "bound")
        b, ids, cell, xd = flat(right), number(right, "id"), number(right, "cell"), number(right, "d")
        seen = left.column("seen").combine_chunks()
        seen_by, seen_list = np.repeat(np.arange(len(own)), seen.value_lengths().to_numpy()), seen.flatten().to_numpy()
        order = np.lexsort((xd, cell))
        b, ids, cell, xd = b[order], ids[order], cell[order], xd[order]
        top = np.full((len(own), k), np.inf), np.full((len(own), k), NONE)
        c = centres.value
        for one in np.unique(cell):
            begin, end = np.searchsorted(cell, one), np.searchsorted(cell, one, "right")
            d = np.sqrt(((a - c[one]) ** 2).sum(axis=1))
            reach = bound * (1 + 1e-9) + 1e-12 * (1 + d)
            asked = (d - xd[end - 1] <= reach) & (xd[begin] - d <= reach)
            asked[seen_by[seen_list == one]] = False
            rows = np.flatnonzero(asked)
            rows = rows[np.argsort(d[rows], kind="stable")]
            # Of a list only the shell can be nearer than the bound: |d(q, centre) - d(x, centre)| <= d(q, x).
            lo, hi = begin + np.searchsorted(xd[begin:end], d[rows] - reach[rows]), begin + np.searchsorted(xd[begin:end], d[rows] + reach[rows], "right")
            rows, lo, hi = rows[hi > lo], lo[hi > lo], hi[hi > lo]
            todo = [(at, min(at + 128, len(rows))) for at in range(0, len(rows), 128)]
            while todo:
                at, to = todo.pop()
                low, high, wanted = lo[at:to].min(), hi[at:to].max(), (hi[at:to] - lo[at:to]).sum()
                if to - at > 1 and (high - low) * (to - at) > 1.25 * wanted:  # their shells differ
                    todo += [(at, (at + to) // 2), ((at + to) // 2, to)]
                    continue
                some = rows[at:to]
                for go in range(low, high, 1024):
                    stop = min(high, go + 1024)
                    if compared is not None:
                        compared.add(len(some) * int(stop - go))
                    _block_met(a[some], own[some], bound[some], b[go:stop], ids[go:stop], top, some, c[one])
        at, turn = np.nonzero(top[1] != NONE)
        return pa.Table.from_pydict({"query": own[at], "hit": top[1][at, turn], "d": top[0][at, turn]})

    return q.groupBy("bucket", "part").cogroup(x.groupBy("bucket", "part")).applyInArrow(run, "query long, hit long, d double")


def nearest(queries: DataFrame, index: DataFrame, k: int = 8, tile: int = 2048, compared=None) -> DataFrame:
    """(query, hit, d): the k index vectors (vec_id, vec) of least squared distance to each query, by exact search.

    The index is kept in lists by nearest centre. A query first looks into the lists of the centres nearest to it that
    hold k vectors together; the k-th distance found bounds what follows: by the triangle inequality a list whose
    distances to its centre lie between lo and hi holds nothing within r of a query at distance d of that centre, if d - hi > r or
    lo - d > r. Such lists are skipped, no vector is left out. Lists and queries meet in tiles of bounded size, and what is
    left after the first look in blocks: a query goes to each block of the index once, not to each of its lists. A
    query does not meet its own vec_id; equal distances go to the smaller id. Vectors have no nulls and one length.
    ``compared``: an accumulator that gets the number of distances to vectors that were computed.
    """
    spark = index.sparkSession
    centres = spark.sparkContext.broadcast(centres_of(index))
    if not len(centres.value):
        return queries.select(F.col("vec_id").cast("long").alias("query"), F.lit(0).cast("long").alias("hit"), F.lit(0.0).alias("d")).limit(0)
    x = staged(_placed(index, centres), "lists")
    q = staged(_placed(queries, centres), "queries")
    # One row for each centre: at most MOST_CENTRES.
    shells = {r.cell: r for r in x.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("d").alias("lo"), F.max("d").alias("hi")).collect()}
    n, lo, hi = (np.array([getattr(shells[c], name) if c in shells else none for c in range(len(centres.value))]) for name, none in (("n", 0), ("lo", np.inf), ("hi", -np.inf)))
    slack = 1 + 1e-9
    # Vectors lie in blocks in order of their lists; within a list by a hash, so that a long one is dealt over several.
    start, parts = np.cumsum(n) - n, -(-q.count() // BLOCK_QUERIES)

    def asked(make, columns):
        def run(batches):
            for pdf in batches:
                for at in range(0, len(pdf), 256):
                    part, rows = pdf.iloc[at : at + 256], []
                    for own, v, bound, every in zip(part["id"], part["x"], part["bound"], _distances(np.stack(part["x"].to_numpy()), centres.value)):
                        order = np.argsort(every, kind="stable")
                        near = order[: np.searchsorted(np.cumsum(n[order]), k + 1) + 1]
                        rows += make(own, v, bound, every, near[n[near] > 0])
                    yield pd.DataFrame(rows, columns=columns)

        return run

    def first(own, v, bound, every, near):
        return [(own, v, int(c), every[c], bound) for c in near]

    def others(own, v, bound, every, near):
        lists = np.flatnonzero((n > 0) & (every - hi <= bound) & (lo - every <= bound))
        lists = lists[~np.isin(lists, near)]
        buckets = {b for s, e in zip(start[lists] // BLOCK_INDEX, (start[lists] + n[lists] - 1) // BLOCK_INDEX) for b in range(s, e + 1)}
        return [(int(b), own, v, bound, near) for b in buckets]

    turn = F.row_number().over(Window.partitionBy("query").orderBy("d", "hit"))
    best = lambda found: found.withColumn("turn", turn).filter(F.col("turn") <= k).drop("turn")
    look = q.withColumn("bound", F.lit(float("inf"))).mapInPandas(asked(first, ["id", "x", "cell", "d", "bound"]), "id long, x array<double>, cell int, d double, bound double")
    began = staged(best(_met(look, x, k, tile, compared)), "began")
    bounds = began.groupBy(F.col("query").alias("id")).agg((F.sqrt(F.max("d")) * slack + 1e-12).alias("r"), F.count(F.lit(1)).alias("found"))
    rest = q.join(bounds, "id", "left").withColumn("bound", F.when(F.col("found") >= k, F.col("r")).otherwise(float("inf"))).select("id", "x", "bound")
    rest = rest.mapInPandas(asked(others, ["bucket", "id", "x", "bound", "seen"]), "bucket int, id long, x array<double>, bound double, seen array<int>").withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)))
    place = F.get(F.array(*map(F.lit, start.tolist())), F.col("cell")) + F.pmod(F.xxhash64("id"), F.get(F.array(*map(F.lit, n.tolist())), F.col("cell")).cast("long"))
    blocks = x.withColumn("bucket", F.floor(place / BLOCK_INDEX).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(parts, 1) - 1).cast("long"))))
    out = staged(best(began.unionByName(_searched(rest, blocks, k, centres, compared))), "nearest")
    discard(x, q, began)
    return out


def knn_blend(queries: DataFrame, index: DataFrame, k: int = 8, rate: float = 0.75, tile: int = 2048) -> DataFrame:
    """Blend query vectors with the mean of their k nearest index vectors, weighted by 1 / distance^2 squared.

    Index and queries have vec_id and vec. A query does not meet the index vector of its own vec_id; an exact hit
    on another one counts as that vector alone.
    """
    best = nearest(queries, index, k, tile)
    x = index.select(F.col("vec_id").cast("long").alias("hit"), F.col("vec").alias("x"))
    w = F.when(F.min("d").over(Window.partitionBy("query")) == 0, F.when(F.col("d") == 0, 1.0).otherwise(0.0)).otherwise(1 / (F.col("d") * F.col("d")))
    weighted = best.withColumn("w", w).join(x, "hit").select("query", "w", F.posexplode("x").alias("dim", "v"))
    mean = weighted.groupBy("query", "dim").agg((F.sum(F.col("w") * F.col("v").cast("double")) / F.sum("w")).alias("m"))
    own = queries.select(F.col("vec_id").cast("long").alias("query"), F.posexplode("vec").alias("dim", "v"))
    return mean.join(own, ["query", "dim"]).select("query", "dim", (rate * F.col("m") + (1 - rate) * F.col("v").cast("double")).alias("v"))


def protect_blend(feats: DataFrame, raw: DataFrame, f0: DataFrame, keys: list[str], protect: float) -> DataFrame:
    """feats where voiced, protect feats + (1 - protect) raw elsewhere; protect of 0.5 and more changes nothing."""
    if protect >= 0.5:
        return feats
    both = feats.join(raw.withColumnRenamed("v", "r"), [*keys, "pos"]).join(f0.select(*keys, "pos", "f0"), [*keys, "pos"])
    m = F.when(F.col("f0") > 0, 1.0).otherwise(protect)
    return both.select(*keys, "pos", (F.col("v") * m + F.col("r") * (1 - m)).alias("v"))


def upsample_features(df: DataFrame, keys: list[str], frames: DataFrame | None = None) -> DataFrame:
    """Every frame twice; with ``frames`` (keys, frames: those of its audio), a series is trimmed to its own number of them."""
    twice = df.withColumn("half", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("pos", F.col("pos") * 2 + F.col("half"))
    if frames is not None:
        twice = twice.join(frames.select(*keys, "frames"), keys).filter(F.col("pos") < F.col("frames"))
    return twice.select(*keys, "pos", "v")


def _f0(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.evt(spark, sf_dir).select(*KEYS, "pos", F.when(F.col("pos") % 3 == 0, 0.0).otherwise(F.col("v") * 10).alias("f0"))


F0 = f"{fx.EVT}, f AS (SELECT track, stem, pos, CASE WHEN pos % 3 = 0 THEN 0 ELSE v * 10 END AS f0 FROM evt)"


@query("g1_f0_decode", f"""WITH {fx.SIG}, s AS (SELECT track, model, pos AS k, abs(v) AS s FROM sig), p AS (SELECT track, model, arg_max(k, (s, -k)) AS top, max(s) AS best FROM s GROUP BY ALL)
SELECT track, model, round(CASE WHEN best > 0.3 THEN 10 * pow(2, sum(s * (20 * k + 1997.3794084376191)) / sum(s) / 1200) ELSE 0 END, 4) AS f0 FROM s JOIN p USING (track, model) WHERE abs(k - top) <= 4 GROUP BY track, model, best""")
def g1(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = fx.sig(spark, sf_dir).select("track", "model", F.col("pos").alias("k"), F.abs("v").alias("s"))
    return f0_decode(s, ["track", "model"], 0.3).withColumn("f0", F.round("f0", 4))


@query("g2_f0_range_gate", f"WITH {F0} SELECT track, stem, pos, CASE WHEN f0 < 50 OR f0 > 1100 THEN 0 ELSE f0 END AS f0 FROM f")
def g2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _f0(spark, sf_dir).withColumn("f0", f0_range_gate("f0", 50, 1100))


@query("g3_f0_interpolate_unvoiced", f"""WITH {F0}, e AS (SELECT *, last_value(CASE WHEN f0 > 0 THEN pos END IGNORE NULLS) OVER b AS ap, last_value(CASE WHEN f0 > 0 THEN f0 END IGNORE NULLS) OVER b AS af, first_value(CASE WHEN f0 > 0 THEN pos END IGNORE NULLS) OVER a AS bp, first_value(CASE WHEN f0 > 0 THEN f0 END IGNORE NULLS) OVER a AS bf
FROM f WINDOW b AS (PARTITION BY track, stem ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY track, stem ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT track, stem, pos, f0 > 0 AS voiced, round(CASE WHEN f0 > 0 THEN f0 WHEN ap IS NULL AND bp IS NULL THEN 0 WHEN ap IS NULL THEN bf WHEN bp IS NULL THEN af ELSE af + (bf - af) * (pos - ap) / (bp - ap) END, 3) AS f0 FROM e""")
def g3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return f0_interpolate_unvoiced(_f0(spark, sf_dir), KEYS).withColumn("f0", F.round("f0", 3))


@query("g4_f0_resize", f"""WITH {F0}, n AS (SELECT track, stem, max(pos) + 1 AS n FROM f GROUP BY ALL), g AS (SELECT track, stem, CAST(i AS INTEGER) AS i, i * n / 20 AS x, n FROM n CROSS JOIN (SELECT unnest(range(0, 20)) AS i)),
k AS (SELECT track, stem, pos, CASE WHEN f0 >= 0.001 THEN f0 END AS f0 FROM f)
SELECT g.track, g.stem, g.i, round(coalesce(CASE WHEN x = floor(x) THEN a.f0 ELSE a.f0 * (1 - (x - floor(x))) + b.f0 * (x - floor(x)) END, 0), 3) AS f0 FROM g JOIN k a ON a.track = g.track AND a.stem = g.stem AND a.pos = floor(x) JOIN k b ON b.track = g.track AND b.stem = g.stem AND b.pos = least(floor(x) + 1, n - 1)""")
def g4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return f0_resize(_f0(spark, sf_dir), KEYS, 20).withColumn("f0", F.round("f0", 3))


@query("g5_f0_transpose", f"WITH {F0} SELECT track, stem, pos, round(f0 * pow(2, 5 / 12.0), 3) AS f0 FROM f")
def g5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _f0(spark, sf_dir).withColumn("f0", F.round(f0_transpose(F.col("f0"), 5), 3))


@query("g6_f0_override", f"""WITH {F0} SELECT track, stem, pos, round(CASE WHEN pos BETWEEN 4 AND 10 THEN 100 + (pos - 4) / 6.0 * 60 ELSE f0 END, 3) AS f0 FROM f""")
def g6(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _f0(spark, sf_dir)
    tracks = df.select(*KEYS).distinct()
    curve = tracks.select(*KEYS, F.explode(F.array(F.struct(F.lit(4).alias("p"), F.lit(100.0).alias("f")), F.struct(F.lit(10).alias("p"), F.lit(160.0).alias("f")))).alias("z")).select(*KEYS, F.col("z.p").alias("pos"), F.col("z.f").alias("f"))
    return f0_override(df, curve, KEYS).select(*KEYS, F.col("pos").cast("int").alias("pos"), F.round("f0", 3).alias("f0"))


@query("g7_f0_coarse", f"""WITH {F0}, m AS (SELECT track, stem, pos, 1127 * ln(1 + f0 / 700) AS m, 1127 * ln(1 + 50 / 700.0) AS lo, 1127 * ln(1 + 1100 / 700.0) AS hi FROM f)
SELECT track, stem, pos, CAST(round_even(greatest(1, least(CASE WHEN m > 0 THEN (m - lo) * 254 / (hi - lo) + 1 ELSE m END, 255)), 0) AS INTEGER) AS coarse FROM m""")
def g7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _f0(spark, sf_dir).select(*KEYS, "pos", f0_coarse(F.col("f0")).alias("coarse"))


@query("g8_knn_blend", """WITH q AS (SELECT vec_id AS query, embedding AS q FROM embeddings WHERE vec_id % 10 = 0), x AS (SELECT vec_id AS hit, embedding AS x FROM embeddings),
d AS (SELECT query, hit, list_sum(list_transform(list_zip(q, x), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE))) AS d FROM q CROSS JOIN x WHERE query <> hit),
b AS (SELECT query, hit, CASE WHEN min(d) OVER (PARTITION BY query) > 0 THEN 1 / (d * d) WHEN d = 0 THEN 1 ELSE 0 END AS w FROM d QUALIFY row_number() OVER (PARTITION BY query ORDER BY d, hit) <= 8),
m AS (SELECT query, generate_subscripts(x, 1) - 1 AS dim, w, unnest(x)::DOUBLE AS v FROM b JOIN x USING (hit)), s AS (SELECT query, dim, sum(w * v) / sum(w) AS m FROM m GROUP BY ALL),
o AS (SELECT query, generate_subscripts(q, 1) - 1 AS dim, unnest(q)::DOUBLE AS v FROM q)
SELECT query, CAST(dim AS INTEGER) AS dim, round(0.75 * m + 0.25 * v, 4) AS v FROM s JOIN o USING (query, dim)""")
def g8(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vec"))
    return knn_blend(e.filter("vec_id % 10 = 0"), e).withColumn("v", F.round("v", 4))


@query("g9_protect_blend", f"WITH {F0} SELECT f.track, f.stem, f.pos, round(CASE WHEN f0 > 0 THEN v * 2 ELSE v * 2 * 0.3 + v * 0.7 END, 3) AS v FROM f JOIN evt USING (track, stem, pos)")
def g9(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = fx.evt(spark, sf_dir).select(*KEYS, "pos", "v")
    return protect_blend(raw.withColumn("v", F.col("v") * 2), raw, _f0(spark, sf_dir), KEYS, 0.3).withColumn("v", F.round("v", 3))


@query("g10_upsample_features", f"WITH {fx.EVT} SELECT track, stem, pos * 2 + h AS pos, v FROM evt CROSS JOIN (SELECT unnest([0, 1]) AS h)")
def g10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upsample_features(fx.evt(spark, sf_dir), KEYS)
