"""Substring dedup by relative Lempel-Ziv parsing.

The reference is every document, cut into blocks by content: each window of WINDOW words holds an anchor, the
leftmost of its ANCHOR-word stretches with the least hash. Equal windows have their anchor at the same place, so
the windows of a document fall into runs of one anchor each, and the words under a run form a *reference block*.
All blocks of all documents are indexed by content, with the first document that holds them and their place in it.

A document is then parsed from left to right. Where its next words are those of indexed blocks that follow each
other in one earlier document, they are one match; of the matches that cover the next word, the one that
reaches furthest becomes the factor (its source document and place, and its length), and the parse goes on behind
it. Words that no match covers are literals.

A match ends where the next block is not in the index as a whole, though some of its windows may be. These
boundary blocks, and only if another block shares their anchor, are checked window by window against an index of
such windows, which prolongs matches to where they truly end. So factors cover exactly the words that windows
of earlier documents cover.

Blocks and windows are compared by a 128-bit BLAKE2 digest of their words, so different words count as equal only
if that cryptographic hash collides. Anchors thin the rows to about one in twenty words. Blocks that many
documents share are one row of the index however many hold them; no two documents are ever paired.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemframe.llm.hashing import Sequence, mix, signed, word_hashes
from stemframe.storage import discard, staged

WINDOW, ANCHOR = 50, 12


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def digests(words: list[bytes], start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """128-bit digests, two longs each, of the words start..end."""
    joined = b" ".join(words)
    at = np.concatenate(([0], np.cumsum([len(w) + 1 for w in words]))) if words else np.zeros(1, np.int64)
    blake = hashlib.blake2b
    found = [blake(joined[a:b], digest_size=16).digest() for a, b in zip(at[start].tolist(), (at[end] - 1).tolist())]
    return np.frombuffer(b"".join(found), "<i8").reshape(-1, 2)


def runs(words: list[bytes], window: int = WINDOW, anchor: int = ANCHOR):
    """(first window, last window, anchor hash, block digest 1, block digest 2) of each run of windows."""
    n = len(words)
    if n < window:
        return [np.zeros(0, np.int64)] * 5
    at = np.arange(n - anchor + 1)
    h = mix(Sequence(word_hashes(words)).of(at, at + anchor))
    span = window - anchor + 1
    chosen = np.empty(n - window + 1, np.int64)
    views = np.lib.stride_tricks.sliding_window_view(h, span)
    for a in range(0, chosen.size, 1 << 16):
        chosen[a : a + (1 << 16)] = views[a : a + (1 << 16)].argmin(axis=1)
    chosen += np.arange(chosen.size)
    first = np.flatnonzero(np.concatenate(([True], chosen[1:] != chosen[:-1])))
    last = np.concatenate((first[1:] - 1, [chosen.size - 1]))
    d = digests(words, first, last + window)
    return first, last, signed(h[chosen[first]]), d[:, 0], d[:, 1]


def matches(found: list[tuple[int, int, int, int]], window: int = WINDOW) -> list[tuple[int, int, int, int]]:
    """Longest stretches (start, end, source, source start) of words from windows (first, last, source, source first).

    Windows that follow each other both here and in their source are one match.
    """
    out: list[list[int]] = []
    open_: dict[tuple[int, int], list[int]] = {}
    for first, last, source, at in sorted(found):
        m = open_.get((source, at - first))
        if m is not None and first <= m[1] - window + 1:
            m[1] = max(m[1], last + window)
        else:
            open_[source, at - first] = m = [first, last + window, source, at]
            out.append(m)
    return [(a, b, s, t) for a, b, s, t in out]


def factors(found: list[tuple[int, int, int, int]], window: int = WINDOW) -> list[tuple[int, int, int, int]]:
    """The greedy parse: disjoint factors (start, end, source, source start), from windows that are copies.

    >>> factors([(0, 3, 7, 10), (2, 5, 8, 0)], 4)
    [(0, 7, 7, 10), (7, 9, 8, 5)]
    """
    rest, out = sorted(matches(found, window)), []
    at = k = 0
    while k < len(rest):
        best = None
        while k < len(rest) and rest[k][0] <= at:
            if rest[k][1] > at and (best is None or rest[k][1] > best[1]):
                best = rest[k]
            k += 1
        if best is not None:
            out.append((at, best[1], best[2], best[3] + at - best[0]))
            at = best[1]
        elif k < len(rest):
            at = rest[k][0]
    return out


def _split(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, version (rows that repeat an id with another text stay apart) and text."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("version"), F.col(text_col).alias("text"))


def _rows(parts: list[list[np.ndarray]], names: list[str], narrow: tuple[int, ...]) -> pa.RecordBatch:
    columns = [np.concatenate(p) if p else np.zeros(0, np.int64) for p in parts]
    return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32) if k in narrow else c.astype(np.int64)) for k, c in enumerate(columns)], names=names)


def copied_windows(rows: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """doc_id, version, copied: ranges (first, last) of windows that an earlier document holds, with the source and the first one's place there."""

    def to_blocks(batches):
        for batch in batches:
            parts = [[] for _ in range(7)]
            for doc, version, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                own = runs(_words(text), window, anchor)
                for p, v in zip(parts, [np.full(own[0].size, doc, np.int64), np.full(own[0].size, version, np.int64), *own]):
                    p.append(v)
            yield _rows(parts, ["doc_id", "version", "first", "last", "anchor", "h1", "h2"], (2, 3))

    blocks = rows.filter("doc_id IS NOT NULL").mapInArrow(to_blocks, "doc_id long, version long, first int, last int, anchor long, h1 long, h2 long")
    blocks = staged(blocks, "blocks")
    index = blocks.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "first")).alias("origin"), F.max("doc_id").alias("latest"), F.first("anchor").alias("anchor"))
    index = staged(index.select("h1", "h2", F.col("origin.doc_id").alias("origin"), F.col("origin.first").alias("place"), "latest", "anchor"), "index")
    # Blocks that differ but share an anchor may share windows, if the anchor is in more than one document.
    shared = index.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.min("origin").alias("a"), F.max("latest").alias("z")).filter("n > 1 AND a < z").select("anchor", F.lit(True).alias("shared"))
    shared = staged(shared, "anchors")
    useful = index.join(shared, "anchor", "left").filter("shared OR latest > origin")
    useful = staged(useful.select("h1", "h2", "origin", "place", F.coalesce("shared", F.lit(False)).alias("shared")), "useful")
    discard(index, shared)
    hits = blocks.join(useful, ["h1", "h2"]).filter("doc_id > origin OR shared")
    hits = staged(hits.select("doc_id", "version", "first", "last", "origin", "place", (F.col("doc_id") > F.col("origin")).alias("whole")), "hits")
    discard(blocks, useful)

    def to_windows(batches):
        for batch in batches:
            parts = [[] for _ in range(5)]
            for doc, version, text, spans in zip(*(batch.column(i).to_pylist() for i in range(4))):
                at = np.unique(np.concatenate([np.arange(s["first"], s["last"] + 1) for s in spans]))
                d = digests(_words(text), at, at + window)
                for p, v in zip(parts, [np.full(at.size, doc, np.int64), np.full(at.size, version, np.int64), at, d[:, 0], d[:, 1]]):
                    p.append(v)
            yield _rows(parts, ["doc_id", "version", "at", "w1", "w2"], (2,))

    ends = hits.filter("NOT whole").groupBy("doc_id", "version").agg(F.collect_list(F.struct("first", "last")).alias("spans"))
    windows = ends.join(rows, ["doc_id", "version"]).dropDuplicates(["doc_id", "version"]).select("doc_id", "version", "text", "spans")
    windows = staged(windows.mapInArrow(to_windows, "doc_id long, version long, at int, w1 long, w2 long"), "windows")
    earliest = windows.groupBy("w1", "w2").agg(F.min(F.struct("doc_id", "at")).alias("origin"), F.max("doc_id").alias("latest")).filter("latest > origin.doc_id")
    earliest = staged(earliest.select("w1", "w2", F.col("origin.doc_id").alias("origin"), F.col("origin.at").alias("place")), "earliest")
    single = windows.join(earliest, ["w1", "w2"]).filter("doc_id > origin").select("doc_id", "version", F.col("at").alias("first"), F.col("at").alias("last"), "origin", "place")
    whole = hits.filter("whole").select("doc_id", "version", "first", "last", "origin", "place")
    spans = whole.unionByName(single).groupBy("doc_id", "version").agg(F.collect_list(F.struct("first", "last", "origin", "place")).alias("copied"))
    spans = staged(spans, "spans")
    discard(hits, windows, earliest)
    return spans


def substring_dedup(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """Per input row: doc_id, n_words, n_removed, kept_sha256, factors, and with_text also text (kept words).

    ``factors`` are the parse's factors: disjoint ranges (start, end) of removed words, each with the document
    (source) and the word in it (source_start) from which they are a copy. Words are what stands between ASCII
    white space.

    * A null or empty text has no words; texts below ``window`` words lose nothing.
    * Only documents of a smaller id count as earlier; repeats within a document stay, and so do copies
      between rows of one id. A row without an id is neither compared nor changed.
    * Of equal earlier copies the one in the smallest id, and in it the first, is the source.
    * An empty table gives no rows; other columns are ignored.
    """
    if not 0 < anchor < window:
        raise ValueError("an anchor must be shorter than a window")
    rows = _split(docs, id_col, text_col)
    spans = copied_windows(rows, window, anchor)

    def cut(batches):
        for batch in batches:
            n, removed, digest, found, texts = [], [], [], [], []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                words = _words(text)
                parsed = factors([(s["first"], s["last"], s["origin"], s["place"]) for s in spans or ()], window)
                kept, at = [], 0
                for a, b, *_ in parsed:
                    kept += words[at:a]
                    at = b
                kept += words[at:]
                joined = b" ".join(kept)
                n.append(len(words))
                removed.append(len(words) - len(kept))
                digest.append(hashlib.sha256(joined).hexdigest())
                found.append([dict(zip(("start", "end", "source", "source_start"), f)) for f in parsed])
                if with_text:
                    texts.append(joined.decode("utf-8", "surrogatepass"))
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("source", pa.int64()), ("source_start", pa.int32())]))
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest, pa.string()), pa.array(found, kind)]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(texts, pa.string())] * with_text, names=["doc_id", "n_words", "n_removed", "kept_sha256", "factors"] + ["text"] * with_text)

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string, factors array<struct<start: int, end: int, source: bigint, source_start: int>>" + ", text string" * with_text
    return rows.join(spans, ["doc_id", "version"], "left").select("doc_id", "text", "copied").mapInArrow(cut, schema)


def brute_force(texts: dict[int, str | None], window: int = WINDOW) -> dict[int, tuple[int, int, str]]:
    """The same by definition, for tests: doc_id -> (n_words, n_removed, kept_sha256)."""
    first: dict[tuple, int] = {}
    for doc in sorted(texts):
        w = _words(texts[doc])
        for i in range(len(w) - window + 1):
            first.setdefault(tuple(w[i : i + window]), doc)
    out = {}
    for doc, text in texts.items():
        w = _words(text)
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < doc:
                gone.update(range(i, i + window))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out[doc] = (len(w), len(gone), hashlib.sha256(kept).hexdigest())
    return out
