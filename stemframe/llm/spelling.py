"""Spelling variants: words one edit apart, found by dynamic programming over sorted lists of words.

Two words that differ by one edit agree before it and after it. So they share the first half of their letters
or else the last half, and each word goes to the lists of both halves: stretches of the sorted vocabulary that
Spark sorts and spreads. A list with too many words is split by the same rule again: its words share a head and
a tail, and the free middle between them is halved until a list is short enough or one letter is free.

In a list, words are compared by the edit matrix of a query (rows: letters of the list's words), of which only the
band next to the diagonal matters. Words that follow each other in sorted order share a prefix (their LCP), and so
they share its matrix rows: a row is computed once for each distinct prefix. Where all of a row's band exceeds
one edit, the whole range of words with that prefix is skipped. All queries of a list go down the prefixes together.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemframe.llm.common import working
from stemframe.storage import discard, staged

#: A list above so many words is split; a task works on so many words at a time.
MOST_WORDS, AT_A_TIME = 4096, 16384
_runs = re.compile("[a-zÀ-ÿ]+").findall
_FAR = 9


def lowered(text: str) -> str:
    """A-Z lower-cased and nothing else."""
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def damaged(word: str, doc_id: int | None, every: int) -> str:
    """``word`` as it counts in a document: with one code point less, where ``every`` divides the crc32 of ``<doc_id>:<word>``."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
    at = h % len(word)
    return word if h % every else word[:at] + word[at + 1 :]


def vocabulary(docs: DataFrame, min_length: int = 7, min_count: int = 2, delete_every: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): distinct words of at least ``min_length`` code points with ``min_count`` occurrences or more.

    Words are the maximal runs of Latin letters (A-Z, a-z, U+00C0 to U+00FF), A-Z lower-cased. With
    ``delete_every`` one code point is deleted from those runs whose hash with the id it divides, which plants
    misspellings to be found; a null id counts as no digits. Null and empty texts have no words, repeated rows count
    each, an empty table gives no rows, other columns are ignored. Counts are added within a task first.
    """

    def run(batches):
        working("spelling")
        counts: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                for word, n in Counter(_runs(lowered(text.as_py() or ""))).items():
                    counts[damaged(word, doc_id, delete_every) if delete_every else word] += n
                if len(counts) > 300_000:
                    yield as_batch(counts)
                    counts = Counter()
        yield as_batch(counts)

    def as_batch(counts):
        kept = [w for w in counts if len(w) >= min_length]
        return pa.RecordBatch.from_arrays([pa.array(kept, pa.string()), pa.array([counts[w] for w in kept], pa.int64())], names=["word", "n"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def _near(words: np.ndarray, length: int, shared: int, first: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, other) of rows one edit apart in the same list, the query of ``length`` letters.

    ``words``: sorted rows of letters, 0 after the end; ``first``: where a list begins; all words of a list share
    ``shared`` letters. Pairs that have ``below`` letters or more in common at the front are left to another list.
    """
    n = len(words)
    lcp = np.full(n, -1)
    lcp[1:] = np.argmax(words[1:] != words[:-1], axis=1)
    lcp[first] = -1
    query = np.flatnonzero(words[:, length] == 0)
    starts, node_of = _nodes(lcp, shared)
    node = node_of[query]
    band = [np.full(query.size, b, np.uint8) for b in (1 if shared else _FAR, 0, 1)]
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for depth in range(shared, length + 1):
        if depth == length:  # words that end here; the middle of the band is the distance
            row = starts[node]
            hit = (band[1] == 1) & (words[row, length] == 0)
            found.append((query[hit], row[hit]))
        below_starts, below_node_of = _nodes(lcp, depth + 1)
        ends = np.append(starts[1:], n) - 1
        child = below_node_of[starts[node]]
        many = below_node_of[ends[node]] - child + 1
        parent = np.repeat(np.arange(node.size), many)
        child = child[parent] + np.arange(parent.size) - np.repeat(np.cumsum(many) - many, many)
        letter = words[below_starts[child], depth]
        alive = letter != 0
        parent, child, letter = parent[alive], child[alive], letter[alive]
        q = query[parent]
        b0, b1, b2 = (b[parent] for b in band)
        n0 = np.minimum(b1 + 1, b0 + (letter != words[q, depth - 1])) if depth else b1 + 1
        n1 = np.minimum(np.minimum(b2, n0) + 1, b1 + (letter != words[q, depth])) if depth < length else np.full(q.size, _FAR, np.uint8)
        n2 = np.minimum(n1 + 1, b2 + (letter != words[q, depth + 1])) if depth + 1 < length else np.full(q.size, _FAR, np.uint8)
        alive = (np.minimum(np.minimum(n0, n1), n2) <= 1) & ~((n1 == 0) & (depth + 1 >= below[q]))
        node, query, band = child[alive], q[alive], [np.minimum(b[alive], _FAR).astype(np.uint8) for b in (n0, n1, n2)]
        starts, node_of = below_starts, below_node_of
    hit = band[0] == 1  # words of one letter more
    found.append((query[hit], starts[node[hit]]))
    pairs = tuple(np.concatenate(side) for side in zip(*found))
    front = np.argmax(words[pairs[0]] != words[pairs[1]], axis=1)
    keep = front < below[pairs[0]]
    return pairs[0][keep], pairs[1][keep]


def _nodes(lcp: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """First rows of the ranges that share a prefix of ``depth`` letters, and each row's range."""
    begins = lcp < depth
    return np.flatnonzero(begins), np.cumsum(begins) - 1


def _near_in_lists(batches):
    """Of rows in the order of their lists: for each word with near words in a list how many, and the best."""
    working("spelling")
    carry = None
    for batch in batches:
        carry = batch if carry is None else pa.concat_batches([carry, batch])
        lists = carry.column(0).to_numpy()
        changes = np.flatnonzero(lists[1:] != lists[:-1]) + 1
        if carry.num_rows >= AT_A_TIME and changes.size:
            yield from _by_length(carry.slice(0, changes[-1]))
            carry = carry.slice(changes[-1])
    if carry is not None and carry.num_rows:
        yield from _by_length(carry)


def _by_length(rows: pa.RecordBatch):
    lists, length, shared, below, n = (rows.column(i).to_numpy() for i in (0, 1, 2, 3, 5))
    text = rows.column(4).to_pylist()
    begins = np.r_[True, lists[1:] != lists[:-1]]
    kind = np.r_[True, (length[1:] != length[:-1]) | (shared[1:] != shared[:-1])]
    cells = AT_A_TIME * 64
    start = 0
    while start < rows.num_rows:  # lists of one length and one shared head, in parts of bounded size
        later = np.flatnonzero(kind[start + 1 :])
        end = start + 1 + later[0] if later.size else rows.num_rows
        width = int(length[start]) + 1
        if (end - start) * width > cells:
            cuts = np.flatnonzero(begins[start + 1 : end]) + start + 1
            fit = cuts[cuts - start <= max(1, cells // width)]
            end = fit[-1] if fit.size else (cuts[0] if cuts.size else end)
        words = np.array(text[start:end], f"<U{width}").view(np.uint32).reshape(end - start, width)
        a, b = _near(words, width - 1, int(shared[start]), np.flatnonzero(begins[start:end]), below[start:end])
        longer = words[b, width - 1] != 0  # a longer word is never a query, so the pair counts for both
        to, other = np.concatenate((a, b[longer])) + start, np.concatenate((b, a[longer])) + start
        order = np.lexsort((other, -n[other], to))
        to, other = to[order], other[order]
        top = np.flatnonzero(np.r_[True, to[1:] != to[:-1]]) if to.size else to
        many = np.diff(np.append(top, to.size))
        best = other[top]
        yield pa.RecordBatch.from_arrays(
            [pa.array([text[i] for i in to[top]], pa.string()), pa.array(many, pa.int64()), pa.array(n[best], pa.int64()), pa.array([text[i] for i in best], pa.string())], names=["word", "n_near", "form_n", "form"]
        )
        start = end


def _halved(rows: DataFrame) -> DataFrame:
    """Each row in two lists: by the first half of what is free as well, or by the last half (pairs that the first list has are left to it)."""
    half = F.expr("(length - head - tail) div 2")
    first = F.struct((F.col("head") + half).alias("head"), F.col("tail"), F.col("below"))
    last = F.struct(F.col("head"), (F.col("length") - F.col("head") - half).alias("tail"), (F.col("head") + half).alias("below"))
    split = rows.withColumn("part", F.explode(F.array(first, last))).select("length", "part.*", "word", "n")
    ends = [F.expr("substring(word, 1, head)"), F.expr("right(word, tail)")]
    return split.withColumn("list", F.xxhash64("length", "head", "tail", "below", *ends))


def near_words(words: DataFrame, most_words: int = MOST_WORDS) -> DataFrame:
    """(word, n_near, form_n, form) for every word of ``words`` (word, n; distinct) that has a near word.

    Near words differ by exactly one inserted, deleted or replaced code point; ``form`` is the one of largest n
    (ties: the smallest in code-point order). Lists meet no bound on what is near; ``most_words`` only says when
    one is split.
    """
    lengths = F.array(F.length("word"), F.length("word") - 1)
    rows = words.select(F.explode(lengths).alias("length"), F.lit(0).alias("head"), F.lit(0).alias("tail"), F.lit(2**31 - 1).alias("below"), "word", "n").filter("length >= 0")
    done, used = None, []
    while True:
        rows = staged(_halved(rows), "lists")
        sizes = rows.groupBy("list").agg(F.count(F.lit(1)).alias("size"), F.max(F.length("word") == F.col("length")).alias("asks"), F.max(F.expr("length - head - tail")).alias("free")).filter("size > 1 AND asks")
        sizes = staged(sizes.select("list", (F.col("size") > most_words).__and__(F.col("free") > 1).alias("split")), "sizes")
        used += [rows, sizes]
        part = rows.join(sizes.filter("NOT split"), "list").drop("split")
        done = part if done is None else done.unionByName(part)
        if sizes.filter("split").isEmpty():
            break
        rows = rows.join(sizes.filter("split"), "list").drop("split", "list")
    ordered = done.select("list", "length", F.col("head").alias("shared"), "below", "word", "n").repartition("list").sortWithinPartitions("length", "shared", "list", "word")
    found = ordered.mapInArrow(_near_in_lists, "word string, n_near long, form_n long, form string")
    best = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("form_n")).alias("less"), "form")).alias("best"))
    out = staged(best.select("word", "n_near", (-F.col("best.less")).alias("form_n"), "best.form"), "near_words")
    discard(*used)
    return out


def variants(words: DataFrame, ratio: int = 10, most_words: int = MOST_WORDS) -> DataFrame:
    """Per word of ``words`` (word, n): word, n, n_near, form, form_n, root.

    A word's form is its best near word, if that is at least ``ratio`` times (2 or more) as frequent; else form and form_n are
    null. root is where the forms lead, the word itself if it has none. Null words are dropped and repeated ones
    added up; an empty word is near to words of one letter; an empty table gives no rows.
    """
    if ratio < 2:
        raise ValueError("forms must get more frequent from step to step")
    words = staged(words.filter("word IS NOT NULL").groupBy("word").agg(F.sum("n").cast("long").alias("n")), "words")
    near = near_words(words, most_words)
    known = words.join(near, "word", "left").withColumn("close", F.col("form_n") >= ratio * F.col("n"))
    known = known.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(F.col("close"), F.col("form")).alias("form"), F.when(F.col("close"), F.col("form_n")).alias("form_n"))
    known = staged(known, "known")
    # Each round doubles the length of the path that a row has followed; frequencies grow along it, so it is short.
    paths = staged(known.filter("form IS NOT NULL").select("word", F.col("form").alias("root")), "paths")
    while True:
        on = paths.select(F.col("word").alias("root"), F.col("root").alias("next"))
        longer = staged(paths.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "paths")
        moved = not longer.filter("moved").isEmpty()
        discard(paths)
        paths = longer
        if not moved:
            break
    discard(words, near)
    return known.join(paths.select("word", "root"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def brute_force(words: dict[str, int], ratio: int = 10) -> dict[str, tuple]:
    """The same by definition, for tests: word -> (form, root, n, n_near, form_n)."""

    def is_near(a: str, b: str) -> bool:
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    near: dict[str, list[str]] = {w: [] for w in words}
    for a, b in combinations(words, 2):
        if is_near(a, b):
            near[a].append(b)
            near[b].append(a)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= ratio * words[w] else None
    out = {}
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, words[w], len(near[w]), words.get(form[w]))
    return out
