"""MinHash near-dedup with exact links.

1. Every document becomes a set of hashed word shingles and MINIMA universal hash minima of it. Equal sets
   are one class from here on, so exact copies cost nothing further.
2. Banding: classes that agree in a band share a bucket. Each bucket has a leader, the member that meets the
   most others over all its buckets (the centre of a family of copies), and every other member is held
   against it: by parity bitmap, then by signature, then by full sets. That is one pair for each member.
3. Components of these links are found by alternating large-star and small-star. A bucket whose members
   are in one component needs nothing more, which is how large groups of copies end here. The others get
   a second leader from a component that has not led yet.
4. In buckets that are still open, members may be similar to each other though not to a leader. A prefix filter
   says which can be: ordered by how rare they are, two sets of the wanted similarity share one of their first
   shingles, and a class whose first shingles are in no other component drops out. What is left of a bucket is
   cut into tiles, and each pair of tiles is a task: it compares parity bitmaps, which grow with the sets, and hands on
   only pairs that may be similar and are in different components. So it is not pairs of a family that are made, but
   those about as similar as links are; all are confirmed on the full sets.

Only a pair that shares no band at all can be missed: with 32 bands of 4 minima that happens to one pair in
20 million at similarity 0.8. Sets hold 64-bit hashes of shingles and classes are equal sums of two of them
(128 bits, and equal sizes), so "equal" here means equal but for a collision of these hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemframe.llm.common import working
from stemframe.llm.components import components
from stemframe.llm.hashing import mix, signed, word_hashes
from stemframe.storage import discard, staged

BANDS, ROWS = 32, 4
MINIMA = BANDS * ROWS
_random = np.random.default_rng(20_24)
#: Multiply-add-shift hashes of 64-bit shingles to 32 bits.
_A = _random.integers(0, 1 << 63, MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _random.integers(0, 1 << 63, MINIMA, dtype=np.uint64)


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of the ``width``-word shingles; A-Z is lower-cased; a shorter text is one shingle."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    x = word_hashes(words)
    size = min(width, x.size)
    h = np.full(x.size - size + 1, 1469598103934665603 + size, np.uint64)
    for i in range(size):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + x[i : i + h.size])
    return np.unique(h)


def minima(s: np.ndarray) -> np.ndarray:
    out = np.empty(MINIMA, np.uint32)
    step = max(1, 2_000_000 // max(s.size, 1))
    for k in range(0, MINIMA, step):
        out[k : k + step] = ((s[:, None] * _A[k : k + step] + _B[k : k + step]) >> np.uint64(32)).min(axis=0)
    return out.view(np.int32)


#: A parity bitmap has a power of two of bits, this many at least and so many for each item at least; classes of a tile, and
#: of a bucket that needs none, as a join makes its pairs (so many for each class at most).
LEAST_BITS, BITS_PER_ITEM, TILE, FEW = 1024, 8, 512, 4


def parity(s: np.ndarray) -> np.ndarray:
    """Bit k is the parity of the items that hash to k: the bits in which two sets differ are never more than their items that differ.

    One half of a bitmap XORed with the other is the bitmap of half the size.
    """
    bits = max(LEAST_BITS, 1 << (BITS_PER_ITEM * s.size - 1).bit_length())
    n = np.bincount((mix(s + np.uint64(11)) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(n.astype(np.uint8)).view(np.int64)


def _folded(bits: str, other: str):
    """Of the column ``bits`` its half size, if ``other`` has that."""
    half = F.size(other)
    return F.when(F.size(bits) > half, F.zip_with(F.slice(bits, 1, half), F.slice(bits, half + 1, half), lambda x, y: x.bitwiseXOR(y))).otherwise(F.col(bits))


def _sketcher(width: int):
    def run(batches):
        working("near_dedup")
        for batch in batches:
            n, h1, h2, sig = [], [], [], []
            for text in batch.column(2).to_pylist():
                s = shingles(text, width)
                n.append(s.size)
                with np.errstate(over="ignore"):
                    h1.append(int(signed(mix(s).sum(keepdims=True, dtype=np.uint64))[0]) if s.size else 0)
                    h2.append(int(signed(mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(keepdims=True, dtype=np.uint64))[0]) if s.size else 0)
                sig.append(minima(s) if s.size else np.zeros(0, np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(sig, pa.list_(pa.int32()))], names=["doc_id", "version", "n", "h1", "h2", "sig"])

    return run


def _setter(width: int):
    def run(batches):
        working("near_dedup")
        for batch in batches:
            sets = [shingles(t, width) for t in batch.column(4).to_pylist()]
            bits = pa.array([parity(s) for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array([signed(s) for s in sets], pa.list_(pa.int64())), bits], names=["rep", "n", "sig", "version", "items", "bits"])

    return run


def _may_be_similar(both, differ, percent: int):
    """Sets of ``both`` items together, with at least ``differ`` items in one only, can be similar."""
    return 2 * percent * both <= (100 + percent) * (both - differ)


def _sizes_allow(n: str, m: str, percent: int):
    return (100 * F.col(n) >= percent * F.col(m)) & (100 * F.col(m) >= percent * F.col(n))


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) that are similar: by bitmap, by signature with room for its error, then by full sets.

    A popular leader is in many pairs. Nothing here groups by it after the joins, so AQE can split its rows; a pair of
    documents of several texts may come more than once.
    """
    side = lambda s, *columns: sets.select(F.col("rep").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in columns])
    bits = pairs.join(side("b", "n", "bits"), "b").join(side("a", "n", "bits"), "a")
    differ = F.aggregate(F.zip_with(_folded("a_bits", "b_bits"), _folded("b_bits", "a_bits"), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)
    likely = staged(bits.filter(_may_be_similar(F.col("a_n") + F.col("b_n"), differ, percent)).select("a", "b"), "likely")
    joined = likely.join(side("b", "n", "sig", "items"), "b").join(side("a", "n", "sig", "items"), "a")
    agree = F.aggregate(F.zip_with("a_sig", "b_sig", lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda t, x: t + x)
    # Six standard errors below the threshold: one true pair in a billion falls here.
    least = percent / 100 - 6 * (percent / 100 * (1 - percent / 100) / MINIMA) ** 0.5
    both = F.size(F.array_intersect("a_items", "b_items"))
    similar = F.when(agree < int(least * MINIMA), False).otherwise(100 * both >= percent * (F.col("a_n") + F.col("b_n") - both))
    links = staged(joined.filter(similar).select("a", "b"), "links")
    discard(likely)
    return links


def _placed(members: DataFrame, at: DataFrame) -> DataFrame:
    """Members with the component that their class is in by now (its own, if nothing is linked to it)."""
    found = members.join(at.select(F.col("node").alias("rep"), "component"), "rep", "left")
    return staged(found.withColumn("component", F.coalesce("component", "rep")), "placed")


def _merged(at: DataFrame, links: DataFrame) -> DataFrame:
    """Components (node, component) after further links (a, b) between classes; ``at`` holds every node linked so far."""
    for side in "ab":
        links = links.join(at.select(F.col("node").alias(side), F.col("component").alias(f"c{side}")), side, "left")
    joined = staged(components(links.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))), "joined")
    moved = at.join(joined.select(F.col("node").alias("component"), F.col("component").alias("far")), "component", "left").select("node", F.coalesce("far", "component").alias("component"))
    out = staged(moved.unionByName(joined.join(at, "node", "left_anti")), "components")
    discard(joined, at)
    return out


def _leader_pairs(placed: DataFrame, led: DataFrame | None, at: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(pairs, leaders): members of each bucket against its most popular one in a component that has not led the bucket yet."""
    choice = placed
    if led is not None:
        over = led.join(at.select(F.col("node").alias("rep"), "component"), "rep", "left").select("bucket", F.coalesce("component", "rep").alias("component")).distinct()
        choice = placed.join(over, ["bucket", "component"], "left_anti")
    top = choice.groupBy("bucket").agg(F.max(F.struct("popular", (-F.col("rep")).alias("low"), "n", "component")).alias("top"))
    leaders = staged(top.select("bucket", (-F.col("top.low")).alias("rep"), F.col("top.n").alias("n"), F.col("top.component").alias("component")), "leaders")
    against = placed.join(leaders.select("bucket", F.col("rep").alias("leader"), F.col("n").alias("leader_n"), F.col("component").alias("leader_component")), "bucket")
    pairs = against.filter(F.col("component") != F.col("leader_component")).filter(_sizes_allow("n", "leader_n", percent))
    return staged(pairs.select(F.least("leader", "rep").alias("a"), F.greatest("leader", "rep").alias("b")).distinct(), "pairs"), leaders


def _alive(open_classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(rep) of the classes that share one of their rarest shingles with a class in a different component.

    Of a set of n, the first n - ceil(t n) + 1 shingles in order of rarity are its prefix; sets with
    similarity t share one. A shingle in one set only is never shared, yet takes a place in its prefix,
    so sets with many of them drop out at once.
    """
    items = sets.join(open_classes, "rep").select("rep", "version", "component", "n", F.explode("items").alias("item"))
    common = staged(items.groupBy("item").agg(F.count(F.lit(1)).alias("df"), F.min("component").alias("x"), F.max("component").alias("y")).filter("df > 1").select("item", "df", (F.col("x") < F.col("y")).alias("crossing")), "common")
    kept = items.join(common, "item")
    ranked = kept.selectExpr("*", "row_number() OVER (PARTITION BY rep, version ORDER BY df, item) AS turn", "count(*) OVER (PARTITION BY rep, version) AS kept")
    at = F.col("n") - F.col("kept") + F.col("turn")  # place in the whole set, from 1
    least = F.floor((percent * F.col("n") + 99) / 100)
    prefix = staged(ranked.withColumn("at", at).filter((F.col("at") <= F.col("n") - least + 1) & F.col("crossing")).select("item", "rep", "component"), "prefix")
    shared = prefix.groupBy("item").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x < y").select("item")
    alive = staged(prefix.join(shared, "item").select("rep").distinct(), "alive")
    discard(common, prefix)
    return alive


def differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bits in which each row of ``a`` differs from each of ``b``; the wider bitmaps are folded."""
    a, b = np.ascontiguousarray(a).view(np.uint64), np.ascontiguousarray(b).view(np.uint64)  # bits of signed numbers are counted by their absolute value
    while a.shape[1] != b.shape[1]:
        wide = a if a.shape[1] > b.shape[1] else b
        half = wide.shape[1] // 2
        folded = wide[:, :half] ^ wide[:, half:]
        a, b = (folded, b) if wide is a else (a, folded)
    out = np.zeros((len(a), len(b)), np.int32)
    for x, y in zip(a.T, b.T):
        out += np.bitwise_count(x[:, None] ^ y[None, :])
    return out


def tile_pairs(left: dict, right: dict, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``left`` and of ``right`` (columns n, component, and bits by their size) that may be similar and are in different components."""
    found = [(np.zeros(0, np.int64),) * 2]
    for one in left["bits"]:
        for other in right["bits"]:
            (x, a), (y, b) = left["bits"][one], right["bits"][other]
            n, m = left["n"][x][:, None], right["n"][y][None, :]
            may = (100 * n >= percent * m) & (100 * m >= percent * n) & (left["component"][x][:, None] != right["component"][y][None, :])
            rows, columns = may.any(axis=1), may.any(axis=0)
            if rows.any():
                x, a, y, b, may = x[rows], a[rows], y[columns], b[columns], may[np.ix_(rows, columns)]
                both = left["n"][x][:, None] + right["n"][y][None, :]
                i, j = np.nonzero(may & _may_be_similar(both, differing(a, b), percent))
                found.append((x[i], y[j]))
    return tuple(np.concatenate(side) for side in zip(*found))


def _tile_judge(percent: int):
    def columns(rows: pa.Table) -> dict:
        bits = rows.column("bits").combine_chunks()
        sizes, flat = np.diff(bits.offsets.to_numpy()), bits.flatten().to_numpy()
        starts = np.cumsum(sizes) - sizes
        by_size = {}
        for size in np.unique(sizes):
            at = np.flatnonzero(sizes == size)
            by_size[int(size)] = (at, flat[starts[at][:, None] + np.arange(size)])
        return {"n": rows.column("n").to_numpy(), "component": rows.column("component").to_numpy(), "rep": rows.column("rep").to_numpy(), "bits": by_size}

    def run(key, rows):
        working("near_dedup")
        own = [columns(rows.filter(pa.compute.equal(rows.column("side"), side))) for side in (0, 1)]
        if not len(own[1]["rep"]):  # a tile against itself
            own[1] = own[0]
        i, j = tile_pairs(*own, percent)
        a, b = own[0]["rep"][i], own[1]["rep"][j]
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)}).group_by(["a", "b"]).aggregate([])

    return run


def _tile_pairs(placed: DataFrame, alive: DataFrame, sets: DataFrame, percent: int, tile: int = TILE) -> DataFrame:
    """Pairs (a, b) of classes in different components that share a bucket and whose bitmaps may be those of similar sets.

    The component of a bucket's most popular member may hold most of it; its members are not compared with each
    other, only with the others, so they go to as many tasks as there are tiles of others.
    """
    rows = placed.join(alive, "rep").select("bucket", "rep", "component", "popular")
    main = rows.groupBy("bucket").agg(F.max_by("component", F.struct("popular", (-F.col("rep")).alias("low"))).alias("main"), F.min("component").alias("x"), F.max("component").alias("y")).filter("x < y").select("bucket", "main")
    rows = staged(rows.join(main, "bucket").select("bucket", "rep", "component", (F.col("component") == F.col("main")).alias("own")), "rows")
    sizes = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.ceil(F.sum(F.col("own").cast("int")) / tile).cast("int").alias("owns"), F.ceil(F.sum((~F.col("own")).cast("int")) / tile).cast("int").alias("others"))
    small = rows.join(rows.groupBy("bucket").count().filter(F.col("count") <= FEW), "bucket").select("bucket", "rep", "component")
    other = small.select("bucket", F.col("rep").alias("b"), F.col("component").alias("other"))
    direct = small.join(other, "bucket").filter((F.col("rep") < F.col("b")) & (F.col("component") != F.col("other"))).select(F.col("rep").alias("a"), "b")
    sizes = sizes.filter(F.col("size") > FEW)
    dealt = rows.join(sizes, "bucket").withColumn("tile", F.pmod(F.xxhash64("rep", "bucket"), F.when(F.col("own"), F.col("owns")).otherwise(F.col("others"))).cast("int"))
    task = lambda kind, i, j, side: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"), side.cast("int").alias("side"))
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    of_own = F.transform(upto("others"), lambda k: task(0, F.col("tile"), k, F.lit(0)))
    across = F.transform(upto("owns"), lambda k: task(0, k, F.col("tile"), F.lit(1)))
    among = F.transform(upto("others"), lambda k: task(1, F.least(F.col("tile"), k), F.greatest(F.col("tile"), k), F.col("tile") > k))
    dealt = dealt.select("bucket", "rep", "component", F.explode(F.when(F.col("own"), of_own).otherwise(F.concat(across, among))).alias("task"))
    dealt = dealt.select("bucket", "task.*", "rep", "component").join(sets.select("rep", "n", "bits"), "rep")
    pairs = dealt.groupBy("bucket", "kind", "i", "j").applyInArrow(_tile_judge(percent), "a long, b long")
    found = staged(pairs.unionByName(direct).distinct(), "pairs")
    discard(rows)
    return found


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", rounds: int = 1) -> DataFrame:
    """Per input row: doc_id, n_shingles, component_id, kept.

    Two documents are linked if their sets of ``width``-word shingles have a Jaccard similarity of
    ``percent`` / 100 or more; ``component_id`` is the least id that links reach, and that row is kept.

    * A null or empty text has the empty set, which is similar to nothing; a text below ``width`` words is
      one shingle.
    * Rows that repeat an id are one document of several texts: its links are those of any of them, and its
      rows share their component and verdict.
    * A row without an id is linked to nothing; its component is null and it is kept.
    * An empty table gives no rows; other columns are ignored.

    ``rounds`` of leaders change how much work is left to the tiles, not the result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("version"), F.col(text_col).alias("text"))
    sketch = staged(rows.mapInArrow(_sketcher(width), "doc_id long, version long, n long, h1 long, h2 long, sig array<int>"), "sketch")
    known = sketch.filter("doc_id IS NOT NULL AND n > 0")
    classes = known.groupBy("h1", "h2", "n").agg(F.min(F.struct("doc_id", "version")).alias("first"), F.first("sig").alias("sig"))
    classes = staged(classes.select("h1", "h2", "n", F.col("first.doc_id").alias("rep"), F.col("first.version").alias("version"), "sig"), "classes")

    keys = [F.xxhash64(F.lit(i), *[F.col("sig")[i * ROWS + j] for j in range(ROWS)]) for i in range(BANDS)]
    banded = classes.select("rep", "n", F.explode(F.array(*keys)).alias("bucket"))
    buckets = staged(banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"), "buckets")
    sized = staged(banded.join(buckets, "bucket").select("bucket", "rep", "n", "size"), "sized")
    members = staged(sized.join(sized.groupBy("rep").agg(F.sum("size").alias("popular")), "rep").select("bucket", "rep", "n", "popular"), "members")

    flagged = members.select("rep").distinct()
    wanted = classes.join(flagged, "rep").select(F.col("rep").alias("doc_id"), "version", "n", "sig")
    texts = wanted.join(rows, ["doc_id", "version"]).select("doc_id", "n", "sig", "version", "text").dropDuplicates(["doc_id", "version"])
    sets = staged(texts.mapInArrow(_setter(width), "rep long, n long, sig array<int>, version long, items array<long>, bits array<long>"), "sets")
    discard(buckets, sized)

    # A document of several texts is in several classes, which it links.
    several = known.groupBy("doc_id").agg(F.min(F.struct("h1", "h2", "n")).alias("lo"), F.max(F.struct("h1", "h2", "n")).alias("hi")).filter("lo <> hi").select("doc_id")
    own = known.join(several, "doc_id").select("doc_id", "h1", "h2", "n").distinct().join(classes, ["h1", "h2", "n"])
    at = staged(components(own.select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))), "components")
    led = None
    for _ in range(rounds):
        placed = _placed(members, at)
        pairs, leaders = _leader_pairs(placed, led, at, percent)
        links = _confirmed(pairs, sets, percent)
        at = _merged(at, links)
        discard(placed, pairs, links)
        leaders = leaders.select("bucket", "rep")
        led = leaders if led is None else led.unionByName(leaders)

    placed = _placed(members, at)
    mixed = placed.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x < y").select("bucket")
    open_classes = staged(placed.join(mixed, "bucket").select("rep", "component").distinct(), "open")
    alive = _alive(open_classes, sets, percent)
    pairs = _tile_pairs(placed, alive, sets, percent)
    links = _confirmed(pairs, sets, percent)
    at = _merged(at, links)
    by_class = classes.select("h1", "h2", "n", "rep").join(at.select(F.col("node").alias("rep"), "component"), "rep", "left")
    by_class = staged(by_class.select("h1", "h2", "n", F.coalesce("component", "rep").alias("component")), "by_class")
    discard(placed, open_classes, alive, pairs, links, sets, members, at, classes)

    found = sketch.select("doc_id", "n", "h1", "h2").join(by_class, ["h1", "h2", "n"], "left")
    component = F.when((F.col("n") == 0) | F.col("doc_id").isNull(), F.col("doc_id")).otherwise(F.col("component"))
    found = found.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def without_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input's rows and columns, one document of each group: that of the least id (and all rows without an id)."""
    gone = near_duplicates(docs, width, percent, id_col, text_col).filter("NOT kept").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(staged(gone, "gone"), F.col(id_col).cast("long") == F.col("__gone"), "left_anti")


def brute_force(texts: dict[int, str | None], width: int, percent: int) -> dict[int, tuple[int, int]]:
    """The same by definition, for tests: doc_id -> (n_shingles, component_id)."""
    sets, by_item = {}, {}
    for doc, text in texts.items():
        w = (text or "").encode("utf-8", "surrogatepass").lower().split()
        size = min(width, len(w))
        sets[doc] = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if w else set()
        for item in sets[doc]:
            by_item.setdefault(item, []).append(doc)
    root = {doc: doc for doc in texts}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for doc, own in sets.items():
        seen: dict[int, int] = {}
        for item in own:
            for other in by_item[item]:
                if other < doc:
                    seen[other] = seen.get(other, 0) + 1
        for other, both in seen.items():
            if 100 * both >= percent * (len(own) + len(sets[other]) - both):
                a, b = find(doc), find(other)
                root[max(a, b)] = min(a, b)
    return {doc: (len(sets[doc]), find(doc)) for doc in texts}
