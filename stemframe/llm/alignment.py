"""Alignment of two tokenizers' tokens over the same bytes, as a monoid of fragments.

Both token sequences of a text cover the same bytes. Offsets where tokens of both end cut the text into groups.
A fragment is what a range of bytes knows of this: an open prefix (tokens up to its first cut, whose group began
earlier), closed groups, and an open suffix (tokens after its last cut). Putting two neighbours together closes one
group, made of the first one's suffix and the second one's prefix, and nothing else changes; so it is associative,
and the fragments of a long document are put together by a tree of Spark tasks in any shape.

Between neighbouring ends of either tokenizer lies exactly one overlap of a token of A with a token of B, so a
closed group has as many links as it has different ends.

How many documents hold a pair of ids is counted by Spark. The pairs in most documents, up to a bound, go to all
tasks as sorted arrays; the rare ones, of which each is in few documents, are joined by a shuffle.
"""

from __future__ import annotations

import hashlib
import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemframe.llm.common import kept, working
from stemframe.storage import discard, staged

#: Bytes of a fragment that the first tasks make, and fragments that a task of the tree puts together.
CHUNK, FAN = 1 << 16, 16
#: Pairs that are sent to all tasks: at most so many, those in most documents.
FREQUENT = 1_000_000


def byte_level() -> dict[str, int]:
    """The characters that byte-level vocabularies write for bytes; printable ones stand for themselves."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Side:
    """One tokenizer: ``ids(texts)``, and the bytes of every id."""

    def __init__(self, tokens: dict[int, bytes], ids):
        self.ids, self.size = ids, max(tokens) + 1
        self.tokens = [tokens.get(i, b"") for i in range(self.size)]
        self.lengths = np.array([len(t) for t in self.tokens], np.int64)

    def joined(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def byte_bpe(path: str) -> Side:
    """A byte-level BPE of a tokenizers file, without special tokens.

    If its merges are in the order of their ids, ranks alone define it, and the tiktoken library encodes faster; a text on which that
    fails goes to the tokenizers library.
    """
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(path)
    slow.encode_special_tokens = True
    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    as_byte = byte_level()
    tokens = {i: bytes(as_byte[c] for c in t) for t, i in model["vocab"].items() if all(c in as_byte for c in t)}
    merges = [model["vocab"]["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in model["merges"]]
    fast = None
    if merges == sorted(merges) and len(tokens) == len(model["vocab"]):
        fast = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in tokens.items()}, special_tokens={})

    def ids(texts: list[str]) -> list:
        found = []
        for text in texts:
            try:
                found.append(fast.encode_ordinary(" " + text) if fast else slow.encode(" " + text, add_special_tokens=False).ids)
            except Exception:  # the pattern's library gives up on some long runs
                found.append(slow.encode(" " + text, add_special_tokens=False).ids)
        return found

    return Side(tokens, ids)


def piece_bpe(path: str) -> Side:
    """A sentencepiece model that puts a space before the text."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    tokens = {}
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        tokens[i] = bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode()
    return Side(tokens, lambda texts: model.encode(texts, num_threads=1))


class Speller:
    """Groups of ids as text: ``a1,a2|b1;``."""

    def __init__(self, size_a: int, size_b: int):
        marks = [(size_a, ","), (size_a, "|"), (size_b, ","), (size_b, ";")]
        self.table = [f"{i}{mark}" for size, mark in marks for i in range(size)]
        self.at = np.cumsum([0] + [size for size, _ in marks])

    def __call__(self, a: np.ndarray, a_cut: np.ndarray, b: np.ndarray, b_cut: np.ndarray) -> str:
        """a_cut, b_cut: does a group end with this token."""
        a_last, b_last = np.flatnonzero(a_cut), np.flatnonzero(b_cut)
        out = np.empty(a.size + b.size, np.int64)
        out[np.arange(a.size) + np.r_[0, b_last + 1][np.cumsum(a_cut) - a_cut]] = a + self.at[a_cut.astype(int)]
        out[np.arange(b.size) + (a_last + 1)[np.cumsum(b_cut) - b_cut]] = b + self.at[2 + b_cut.astype(int)]
        return "".join(map(self.table.__getitem__, out.tolist()))


class Tokens:
    """Tokens of both sides that follow each other: ids and the bytes where they end."""

    def __init__(self, a, a_ends, b, b_ends):
        self.a, self.a_ends, self.b, self.b_ends = (np.asarray(x, np.int64) for x in (a, a_ends, b, b_ends))

    def part(self, after: int, upto: int) -> Tokens:
        """Those that end after one offset, and up to another."""
        i, j = np.searchsorted(self.a_ends, (after, upto), "right")
        k, m = np.searchsorted(self.b_ends, (after, upto), "right")
        return Tokens(self.a[i:j], self.a_ends[i:j], self.b[k:m], self.b_ends[k:m])

    def __add__(self, other: Tokens) -> Tokens:
        return Tokens(*(np.concatenate((x, y)) for x, y in zip(self, other)))

    def __iter__(self):
        return iter((self.a, self.a_ends, self.b, self.b_ends))

    def cuts(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.a.size or not self.b.size:
            return np.zeros(self.a.size, bool), np.zeros(self.b.size, bool)
        there = lambda x, y: y[np.minimum(np.searchsorted(y, x), y.size - 1)] == x
        return there(self.a_ends, self.b_ends), there(self.b_ends, self.a_ends)


class Fragment:
    """``cut``: is there a cut; if not, ``prefix`` holds all tokens. ``pairs`` and ``times``: links of closed groups."""

    def __init__(self, prefix: Tokens, cut: bool, suffix: Tokens, groups: int = 0, text: str = "", pairs=(), times=()):
        self.prefix, self.cut, self.suffix, self.groups, self.text = prefix, cut, suffix, groups, text
        self.pairs, self.times = np.asarray(pairs, np.int64), np.asarray(times, np.int64)


NONE = Tokens([], [], [], [])


class Aligner:
    def __init__(self, size_a: int, size_b: int):
        self.size_b, self.spell = size_b, Speller(size_a, size_b)

    def closed(self, tokens: Tokens) -> tuple[int, str, np.ndarray]:
        """Groups, their text and their links, of tokens that begin and end at a cut."""
        a_cut, b_cut = tokens.cuts()
        ends = np.union1d(tokens.a_ends, tokens.b_ends)
        pairs = tokens.a[np.searchsorted(tokens.a_ends, ends)] * self.size_b + tokens.b[np.searchsorted(tokens.b_ends, ends)]
        return int(a_cut.sum()), self.spell(tokens.a, a_cut, tokens.b, b_cut), pairs

    def fragment(self, tokens: Tokens, begins: bool) -> Fragment:
        """``begins``: the range begins where the text does, which is a cut."""
        a_cut, _ = tokens.cuts()
        cuts = tokens.a_ends[a_cut]
        if not cuts.size:
            return Fragment(NONE, True, tokens) if begins else Fragment(tokens, False, NONE)
        first, last = (-1 if begins else cuts[0]), cuts[-1]
        groups, text, pairs = self.closed(tokens.part(first, last)) if first < last else (0, "", NONE.a)
        end = np.iinfo(np.int64).max
        return Fragment(tokens.part(-1, first), True, tokens.part(last, end), groups, text, *np.unique(pairs, return_counts=True))

    def joined(self, parts: list[Fragment]) -> Fragment:
        """Neighbours put together, in their order."""
        out, texts, pairs, times = parts[0], [parts[0].text], [parts[0].pairs], [parts[0].times]
        groups = out.groups
        prefix, cut, suffix = out.prefix, out.cut, out.suffix
        for part in parts[1:]:
            if not part.cut:
                prefix, suffix = (prefix, suffix + part.prefix) if cut else (prefix + part.prefix, suffix)
                continue
            if cut:
                more, text, links = self.closed(suffix + part.prefix)
                groups += more
                texts.append(text)
                pairs.append(links)
                times.append(np.ones(links.size, np.int64))
            else:
                prefix = prefix + part.prefix
            groups += part.groups
            texts.append(part.text)
            pairs.append(part.pairs)
            times.append(part.times)
            cut, suffix = True, part.suffix
        names, code = np.unique(np.concatenate(pairs), return_inverse=True)
        return Fragment(prefix, cut, suffix, groups, "".join(texts), names, np.bincount(code, np.concatenate(times), names.size).astype(np.int64))


@lru_cache(maxsize=2)
def sides(path_a: str, path_b: str) -> tuple[Side, Side, Aligner]:
    a, b = byte_bpe(path_a), piece_bpe(path_b)
    return a, b, Aligner(a.size, b.size)


kept(sides)

_OPEN = [f"{part}_{x}" for part in ("prefix", "suffix") for x in ("a", "a_ends", "b", "b_ends")]
_SCHEMA = "row long, doc_id long, chunk long, chunks long, n_a long, n_b long, groups long, sha string, text string, cut boolean, pairs array<long>, times array<int>, " + ", ".join(f"{x} array<long>" for x in _OPEN)
_NAMES = [x.split()[0] for x in _SCHEMA.split(", ")]
_ARROW = [pa.int64()] * 7 + [pa.string()] * 2 + [pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.int32())] + [pa.list_(pa.int64())] * 8


def _record(row, doc_id, chunk: int, chunks: int, n_a: int, n_b: int, f: Fragment) -> tuple:
    """A row of a fragment; one that is all of a document has the digest in place of the text."""
    whole = chunks == 1
    sha = hashlib.sha256(f.text[:-1].encode()).hexdigest() if whole and n_a else "" if whole else None
    return (row, doc_id, chunk, chunks, n_a, n_b, f.groups, sha, None if whole else f.text, f.cut, f.pairs, f.times.astype(np.int32), *([None] * 8 if whole else [*f.prefix, *f.suffix]))


def _batch(records: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(column), kind) for column, kind in zip(zip(*records) if records else [[]] * len(_NAMES), _ARROW)], names=_NAMES)


def _fragments(path_a: str, path_b: str, chunk: int):
    def of(row, doc_id, text, a, b, side_a, side_b, aligner):
        target = (" " + text).encode()
        if not text or side_a.joined(a) != target or side_b.joined(b) != target:
            yield _record(row, doc_id, 0, 1, 0, 0, Fragment(NONE, True, NONE))
            return
        a, b = np.array(a, np.int64), np.array(b, np.int64)
        tokens = Tokens(a, np.cumsum(side_a.lengths[a]), b, np.cumsum(side_b.lengths[b]))
        chunks = -(-len(target) // chunk)
        for k in range(chunks):
            own = tokens.part(k * chunk, (k + 1) * chunk) if chunks > 1 else tokens
            yield _record(row, doc_id, k, chunks, own.a.size, own.b.size, aligner.fragment(own, not k))

    def run(batches):
        working("alignment")
        side_a, side_b, aligner = sides(path_a, path_b)
        for batch in batches:
            start = 0
            every_row, every_id, every_text = (batch.column(k).to_pylist() for k in range(3))
            sizes = np.array([len(x or "") for x in every_text])
            while start < batch.num_rows:  # about a million characters at a time
                end = start + max(1, int(np.searchsorted(np.cumsum(sizes[start:]), 1_000_000, "right")))
                texts = [x or "" for x in every_text[start:end]]
                every = zip(every_row[start:end], every_id[start:end], texts, side_a.ids(texts), side_b.ids(texts))
                yield _batch([r for x in every for r in of(*x, side_a, side_b, aligner)])
                start = end

    return run


def _put_together(path_a: str, path_b: str, fan: int):
    def run(_, table):
        working("alignment")
        aligner = sides(path_a, path_b)[2]
        rows = sorted(table.to_pylist(), key=lambda r: r["chunk"])
        parts = [Fragment(Tokens(*(r[x] for x in _OPEN[:4])), r["cut"], Tokens(*(r[x] for x in _OPEN[4:])), r["groups"], r["text"], r["pairs"], r["times"]) for r in rows]
        first = rows[0]
        return pa.Table.from_batches([_batch([_record(first["row"], first["doc_id"], first["chunk"] // fan, -(-first["chunks"] // fan), sum(r["n_a"] for r in rows), sum(r["n_b"] for r in rows), aligner.joined(parts))])])

    return run


def aligned(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, fan: int = FAN) -> DataFrame:
    """A staged table with one row per input row: row, doc_id, n_a, n_b, groups, sha, pairs (a's id x number of ids of b + b's id) and times."""
    a, b, _ = sides(path_a, path_b)
    pairs = F.col("pairs").cast("array<int>" if a.size * b.size < 1 << 31 else "array<long>").alias("pairs")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    shrunk = lambda frame: staged(frame.withColumn("pairs", pairs), "fragments")
    made = shrunk(rows.mapInArrow(_fragments(path_a, path_b, chunk), _SCHEMA))
    columns = ["row", "doc_id", "n_a", "n_b", "groups", "sha", "pairs", "times"]
    whole = made.filter("chunks = 1").select(*columns)
    most = made.agg(F.max("chunks")).first()[0] or 1
    parts = made.filter("chunks > 1")
    while most > 1:
        parts = shrunk(parts.withColumn("part", F.expr(f"chunk div {fan}")).groupBy("row", "part").applyInArrow(_put_together(path_a, path_b, fan), _SCHEMA))
        whole = whole.unionByName(parts.filter("chunks = 1").select(*columns))
        parts = parts.filter("chunks > 1")
        most = -(-most // fan)
    return whole


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, fan: int = FAN, frequent: int = FREQUENT) -> DataFrame:
    """Per input row: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A (a tokenizers file of byte-level BPE) encodes a space and the text, B (a sentencepiece model) the text. A text that is null or
    empty, or whose tokens' bytes of either side are not that space and text, has no tokens: zeros and an
    empty string. Each row is a document of its own, whether its id is null or repeated; an empty table gives no
    rows; other columns are ignored. ``chunk``, ``fan`` and ``frequent`` change how work is split, not the result.
    """
    found = aligned(docs, path_a, path_b, id_col, text_col, chunk, fan)
    size_b = sides(path_a, path_b)[1].size
    counts = staged(found.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("df")), "counts")
    highest = counts.groupBy(F.expr(f"pair div {size_b}").alias("a")).agg(F.max("df").alias("most"))
    counts_best = staged(counts.withColumn("a", F.expr(f"pair div {size_b}")).join(highest, "a").select("pair", "df", (F.col("df") == F.col("most")).alias("best")), "pairs")
    # By powers of two: from how many documents on are no more than ``frequent`` pairs.
    by_power = counts_best.groupBy(F.floor(F.log2("df")).cast("int").alias("power")).agg(F.count(F.lit(1)).alias("n")).collect()
    total, least = 0, 62
    for power, n in sorted(((r["power"], r["n"]) for r in by_power), reverse=True):
        total += n
        if total > frequent:
            break
        least = power
    bound = 1 << least
    top = counts_best.filter(F.col("df") >= bound).orderBy("pair").toArrow()
    known = found.sparkSession.sparkContext.broadcast(tuple(top.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in ("pair", "df", "best")))

    def look_up(batches):
        pair, df, best = known.value
        for batch in batches:
            values, times = batch.column(1).flatten().to_numpy().astype(np.int64), batch.column(2).flatten().to_numpy()
            row = np.repeat(np.arange(batch.num_rows), np.diff(batch.column(1).offsets.to_numpy()))
            at = np.searchsorted(pair, values)
            hit = np.zeros(values.size, bool)
            if pair.size:
                at = np.minimum(at, pair.size - 1)
                hit = pair[at] == values
            at, where = at[hit], row[hit]
            n_best = np.bincount(where, times[hit] * best[at], batch.num_rows).astype(np.int64)
            total = np.bincount(where, times[hit] * df[at], batch.num_rows).astype(np.int64)
            rest = np.bincount(row[~hit], minlength=batch.num_rows)
            offsets = pa.array(np.r_[0, np.cumsum(rest)], pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x[~hit])) for x in (values, times)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_best), pa.array(total), *lists], names=["row", "n_best", "total", "pairs", "times"])

    looked = staged(found.select("row", "pairs", "times").mapInArrow(look_up, "row long, n_best long, total long, pairs array<long>, times array<int>"), "looked_up")
    rare = looked.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    rare = rare.join(counts_best.filter(F.col("df") < bound), "pair").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times"))).alias("more_best"), F.sum(F.col("times") * F.col("df")).alias("more"))
    sums = looked.select("row", "n_best", "total").join(rare, "row", "left")
    sums = sums.select("row", (F.col("n_best") + F.coalesce("more_best", F.lit(0))).alias("n_best"), (F.col("total") + F.coalesce("more", F.lit(0))).alias("count_sum"))
    sums = staged(sums, "sums")
    discard(counts, counts_best, looked)
    links = F.col("n_a") + F.col("n_b") - F.col("groups")
    return found.select("row", "doc_id", "n_a", "n_b", F.col("groups").alias("n_groups"), links.alias("n_links"), F.col("sha").alias("groups_sha256")).join(sums, "row").select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
