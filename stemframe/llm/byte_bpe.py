"""Byte-level BPE encoding and decoding by dynamic programming over prefixes.

Every prefix of a byte string has exactly one BPE encoding, so it has exactly one last token. The last
token of a prefix is the token ``t`` ending there for which the prefix before it ends in a token that BPE
leaves standing beside ``t``. Storing that one number per prefix makes encoding a walk over positions,
makes appending exact (old prefixes never change), and lets an edit keep all prefixes before it.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemframe.llm.common import give_back, kept, working

#: A task remembers what it has found about pieces and words up to so many characters, in so many bytes altogether; and in so many
#: bytes which tokens stand beside each other.
MEMO_LENGTH, MEMO_BYTES, PAIR_BYTES = 64, 128 << 20, 40 << 20
#: Prefix tables are shared between pieces that begin with the same so many bytes.
HEADS = (7, 5, 3)


#: Fixed value: the public pattern for which a text may be cut before single spaces.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Memory:
    """Tables under one bound in bytes. Half of it holds what came last, the other half what came before that.

    Costs are estimates from above of CPython's objects, slots of the dict included.
    """

    def __init__(self, names: str, most: int = MEMO_BYTES):
        self.names, self.most = names.split(), most
        self.clear()

    def clear(self) -> None:
        self.used = 0
        self.new: dict[str, dict] = {n: {} for n in self.names}
        self.old: dict[str, dict] = {n: {} for n in self.names}

    def get(self, name: str, key):
        found = self.new[name].get(key)
        return self.old[name].get(key) if found is None else found

    def put(self, name: str, key, value, cost: int) -> None:
        self.used += cost
        if 2 * self.used > self.most:
            self.old, self.new, self.used = self.new, {n: {} for n in self.names}, cost
        self.new[name][key] = value


class Ranks:
    """A vocabulary of ranks, and which pairs of tokens stand beside each other in an encoding."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {i: b for b, i in ranks.items()}
        self.longest = max(map(len, ranks), default=0)
        self.memory = Memory("pairs", PAIR_BYTES)

    def merged(self, piece: bytes) -> list[int]:
        """BPE as defined: merge the adjacent pair of lowest rank, leftmost first, until none is left."""
        get, none = self.ranks.get, 1 << 60
        parts = [piece[i : i + 1] for i in range(len(piece))]
        ranks = [get(a + b, none) for a, b in zip(parts, parts[1:])]
        while ranks and (least := min(ranks)) < none:
            i = ranks.index(least)
            parts[i] += parts.pop(i + 1)
            del ranks[i]
            if i:
                ranks[i - 1] = get(parts[i - 1] + parts[i], none)
            if i < len(ranks):
                ranks[i] = get(parts[i] + parts[i + 1], none)
        return [self.ranks[p] for p in parts]

    def _stands_beside(self, left: int, right: int) -> bool:
        """Does BPE leave ``right`` beside ``left``? left -1: at the start."""
        tail = self.tokens[right]
        return self.merged(tail) == [right] if left < 0 else self.merged(self.tokens[left] + tail) == [left, right]

    def extend(self, data: bytes, last: list[int]) -> None:
        """Add the last tokens of the prefixes of ``data`` that ``last`` does not have yet.

        Exactly one token fits each prefix, so the order of trying does not matter; short ones are commonest.
        """
        get, memory, longest = self.ranks.get, self.memory, self.longest
        known = memory.new["pairs"].get
        for end in range(len(last), len(data) + 1):
            for start in range(end - 1, max(-1, end - longest - 1), -1):
                token = get(data[start:end])
                if token is None:
                    continue
                pair = last[start] << 24 | token
                stands = known(pair)
                if stands is None:
                    stands = memory.old["pairs"].get(pair)
                    if stands is None:
                        stands = self._stands_beside(last[start], token)
                    memory.put("pairs", pair, stands, 80)
                    known = memory.new["pairs"].get
                if stands:
                    last.append(token)
                    break
            else:
                raise ValueError("the vocabulary lacks a byte")

    def walk_back(self, data: bytes, last: list[int]) -> list[int]:
        """The encoding of a piece: a token of its own if there is one, else its last tokens from the end."""
        if (whole := self.ranks.get(data)) is not None:
            return [whole]
        found, at = [], len(data)
        while at:
            found.append(last[at])
            at -= len(self.tokens[last[at]])
        return found[::-1]


class Piece:
    """The prefix table of one piece: ``last[i]`` is the last token of the encoding of the first i bytes."""

    def __init__(self, ranks: Ranks, data: bytes = b""):
        self.of, self.data, self.last = ranks, b"", [-1]
        self.append(data)

    def append(self, more: bytes) -> None:
        """Extend the piece; what is stored about its prefixes stays as it is."""
        self.data += more
        self.of.extend(self.data, self.last)

    def replace(self, start: int, end: int, new: bytes) -> None:
        """Put ``new`` in place of bytes start..end; prefixes up to ``start`` are kept."""
        tail = self.data[end:]
        self.data, self.last = self.data[:start], self.last[: start + 1]
        self.append(new + tail)

    def ids(self) -> list[int]:
        return self.of.walk_back(self.data, self.last)


class Encoder:
    """Text to ids and back: each match of ``pattern`` is encoded by itself, special tokens are ordinary text."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.memory = Memory("pieces words heads")
        self.of, self.split = Ranks(ranks), regex.compile(pattern).findall
        #: Known of this pattern: no match goes on into a space after another character.
        self.falls_apart = pattern == PATTERN
        self._token = self.of.tokens.__getitem__

    def clear(self) -> None:
        """Forget all but the vocabulary."""
        self.memory.clear()
        self.of.memory.clear()

    def _remember(self, name: str, key: str, packed: bytes) -> bytes:
        if len(key) <= MEMO_LENGTH:
            self.memory.put(name, key, packed, 150 + len(key) + len(packed))
        return packed

    def _by_pieces(self, text: str) -> bytes:
        """Piece by piece. A piece of a space and more is remembered as the word after that space."""
        known, out = self.memory.get, []
        for piece in self.split(text):
            name, key = ("words", piece[1:]) if piece[0] == " " and not piece[-1].isspace() else ("pieces", piece)
            found = known(name, key)
            if found is None:
                data = piece.encode("utf-8", "surrogatepass")
                ids = self.of.walk_back(data, self._table(data))
                found = self._remember(name, key, struct.pack(f"<{len(ids)}I", *ids))
            out.append(found)
        return b"".join(out)

    def _table(self, data: bytes) -> list[int]:
        """The prefix table of a piece, begun with that of an earlier piece with the same first bytes."""
        if data in self.of.ranks:
            return []
        size, last, known = len(data), [-1], 0
        new, old = self.memory.new["heads"].get, self.memory.old["heads"].get
        for n in HEADS:
            if size > n:
                head = data[:n]
                found = new(head) or old(head)
                if found:
                    last, known = found.copy(), n
                    break
        self.of.extend(data, last)
        for n in HEADS:
            if known < n < size:
                self.memory.put("heads", data[:n], last[: n + 1], 200 + 9 * n)
        return last

    def packed(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers.

        A single space between two other characters always starts a match, so a text falls apart there
        and the words between such spaces are remembered. A text with other white space beside a space
        (or at an end of it) is split by the pattern as a whole.
        """
        if not self.falls_apart:
            return self._by_pieces(text)
        memory, out, lead = self.memory, [], ""
        for word in text.split(" "):
            found = memory.new["words"].get(word) if lead else None
            if found is None:
                if not word or word[0].isspace() or word[-1].isspace():
                    return self._by_pieces(text)
                found = memory.old["words"].get(word) if lead else None
                fresh = found is None
                if fresh:
                    found = self._by_pieces(lead + word)
                if lead and not (fresh and word in memory.new["words"]):
                    self._remember("words", word, found)
            out.append(found)
            lead = " "
        return b"".join(out)

    def encode(self, text: str) -> list[int]:
        packed = self.packed(text)
        return list(struct.unpack(f"<{len(packed) // 4}I", packed))

    def decode(self, ids) -> bytes:
        return b"".join(map(self._token, ids))


class EncodedText:
    """A text with its pieces, for appends and edits: pieces that end well before an edit are kept.

    ``reach`` is how many characters past its end a match of the pattern may depend on.
    """

    def __init__(self, encoder: Encoder, text: str = "", reach: int = 3):
        self.encoder, self.reach, self.text, self.pieces = encoder, reach, "", []
        self.replace(0, 0, text)

    def replace(self, start: int, end: int, new: str) -> None:
        self.text = self.text[:start] + new + self.text[end:]
        kept, at = [], 0
        for piece, ids in self.pieces:
            if at + len(piece) + self.reach > start:
                break
            kept.append((piece, ids))
            at += len(piece)
        old = dict(self.pieces[len(kept) :])
        for piece in self.encoder.split(self.text[at:]):
            kept.append((piece, old.get(piece) or self.encoder.encode(piece)))
        self.pieces = kept

    def append(self, more: str) -> None:
        self.replace(len(self.text), len(self.text), more)

    def ids(self) -> list[int]:
        return [i for _, ids in self.pieces for i in ids]


@lru_cache(maxsize=4)
def encoder(vocabulary: str, pattern: str) -> Encoder:
    """One encoder per worker; ``vocabulary`` is a rank file installed on every machine. What it remembers of
    texts goes when a task ends; what it knows of pairs of tokens is the vocabulary's and stays, in its own bound."""
    with open(vocabulary, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (x.split() for x in lines if x.strip())}
    return Encoder(ranks, pattern)


kept(encoder)


def bpe_digests(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Per input row: doc_id, n_tokens, ids_sha256, decoded_sha256, and with_ids also ids.

    The decoded bytes come from the ids alone. A null text is empty (no tokens); repeated rows and null ids
    are carried through; an empty table gives no rows; other columns are ignored. There is no shuffle.
    """

    def run(batches):
        working("byte_bpe")
        enc = encoder(vocabulary, pattern)
        try:
            yield from digests(enc, batches)
        finally:
            enc.memory.clear()
            give_back()

    def digests(enc, batches):
        for batch in batches:
            n, packed_hash, decoded_hash, all_ids = [], [], [], []
            for text in batch.column(1):
                packed = enc.packed(text.as_py() or "")
                ids = struct.unpack(f"<{len(packed) // 4}I", packed)
                n.append(len(ids))
                packed_hash.append(hashlib.sha256(packed).hexdigest())
                decoded_hash.append(hashlib.sha256(enc.decode(ids)).hexdigest())
                if with_ids:
                    all_ids.append(ids)
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(packed_hash, pa.string()), pa.array(decoded_hash, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns, names = [*columns, pa.array(all_ids, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
