"""Alignment of tokenizers against a walk over bytes."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from stemframe.llm import alignment as A
from stemframe.llm import queries

PATHS = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def by_hand():
    """doc_id -> row of the contract, from (doc_id, text) rows: by the libraries, and byte by byte."""
    a_model = Tokenizer.from_file(PATHS[0])
    a_model.encode_special_tokens = True
    b_model = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    as_byte = {chr(c): c for c in plain}
    for c in range(256):
        if c not in plain:
            as_byte[chr(256 + len(as_byte) - len(plain))] = c
    a_bytes = lambda i: bytes(as_byte[c] for c in a_model.id_to_token(i))

    def b_bytes(i):
        piece = b_model.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if len(piece) == 6 and piece.startswith("<0x") else piece.replace("▁", " ").encode()

    def run(docs):
        parts = []
        for doc_id, text in docs:
            a = a_model.encode(" " + (text or ""), add_special_tokens=False).ids if text else []
            b = b_model.encode(text) if text else []
            ta, tb = list(map(a_bytes, a)), list(map(b_bytes, b))
            if b"".join(ta) != b"".join(tb) or b"".join(ta) != (" " + (text or "")).encode():
                a = b = ta = tb = []
            of_a = [k for k, t in enumerate(ta) for _ in t]
            of_b = [k for k, t in enumerate(tb) for _ in t]
            links = sorted(set(zip(of_a, of_b)))
            groups, ga, gb = [], [], []
            for at in range(len(of_a)):
                end_a, end_b = (at + 1 == len(x) or x[at + 1] != x[at] for x in (of_a, of_b))
                ga += [a[of_a[at]]] * end_a
                gb += [b[of_b[at]]] * end_b
                if end_a and end_b:
                    groups.append(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)))
                    ga, gb = [], []
            parts.append((doc_id, len(a), len(b), groups, [(a[i], b[j]) for i, j in links]))
        df = Counter(pair for p in parts for pair in set(p[4]))
        best = {}
        for (x, _), n in df.items():
            best[x] = max(best.get(x, 0), n)
        return [
            (d, n_a, n_b, len(g), len(links), sum(df[p] == best[p[0]] for p in links), sum(df[p] for p in links), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "")
            for d, n_a, n_b, g, links in parts
        ]

    return run


def rows_of(frame):
    return sorted(map(tuple, frame.collect()), key=lambda r: (r[0] is None, r))


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r))


def test_query_equals_a_walk_over_bytes(spark, by_hand):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    frame = queries.QUERIES["op13_tokenizer_alignment"](spark, sf)
    assert frame.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert rows_of(frame) == ordered(by_hand(docs))


@pytest.mark.parametrize("chunk, fan, frequent", [(7, 2, 0), (64, 3, 50), (4096, 16, 10**6)])
def test_fragments_of_any_size_and_trees_of_any_shape(spark, by_hand, chunk, fan, frequent):
    docs = [(k, t) for k, t in enumerate(["The quick brown fox, naïve café!", "über " * 30, "日本語テキスト and text", "x" * 90, "a" * 3 + "\n\n\t b   c", "🙂🙃 emoji 🙂", "The the THE the", "<s> <|endoftext|> </s>"])]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    have = rows_of(A.align(frame, *PATHS, chunk=chunk, fan=fan, frequent=frequent))
    assert have == ordered(by_hand(docs)) and sum(r[1] > 0 for r in have) >= 5


def test_fragments_are_a_monoid():
    """However neighbours are put together, the same comes out."""
    rng = random.Random(4)
    side_a, side_b, aligner = A.sides(*PATHS)
    text = "Counting words, naïve façades und Straßenbahnen 12345 " * 6
    a, b = np.array(side_a.ids([text])[0]), np.array(side_b.ids([text])[0])
    tokens = A.Tokens(a, np.cumsum(side_a.lengths[a]), b, np.cumsum(side_b.lengths[b]))
    whole = aligner.fragment(tokens, True)
    for _ in range(40):
        cuts = sorted(rng.sample(range(len(text.encode())), rng.randrange(1, 30)))
        parts = [aligner.fragment(tokens.part(x, y), x == -1) for x, y in zip([-1, *cuts], [*cuts, 10**6])]
        while len(parts) > 1:
            k = rng.randrange(len(parts) - 1)
            parts[k : k + 2] = [aligner.joined(parts[k : k + 2])]
        got = parts[0]
        assert (got.text, got.groups, got.pairs.tolist(), got.times.tolist()) == (whole.text, whole.groups, whole.pairs.tolist(), whole.times.tolist())
        assert not got.suffix.a.size and not got.prefix.a.size


def test_awkward(spark, by_hand):
    """Nulls, empties, texts that a side changes, very long texts, repeated rows, clashing columns, no rows."""
    long = " ".join(f"word{k % 977}" for k in range(40_000))
    docs = [(1, "hello world"), (1, "hello world"), (None, "hello"), (2, None), (3, ""), (4, "▁ odd"), (5, long), (6, "ﬁne ligature"), (7, "é"), (8, " "), (9, "hello world")]
    frame = spark.createDataFrame([(*d, 7, "x") for d in docs], "doc_id long, text string, row long, pairs string").repartition(4)
    have = rows_of(A.align(frame, *PATHS))
    assert have == ordered(by_hand(docs))
    assert have[2][1:] == (0, 0, 0, 0, 0, 0, "") and [r for r in have if r[0] == 5][0][1] > 80_000
    assert A.align(frame.limit(0), *PATHS).count() == 0
