"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stemframe.llm import queries, spelling


def rows_of(frame):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in frame.collect()}


def by_hand(docs):
    """Words and counts of (id, text) rows, as the contract of op12 words it."""
    n = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{doc_id}:{word}".encode())
            if h % 31 == 0:
                word = "".join(c for i, c in enumerate(word) if i != h % len(word))
            n[word] += 1
    return {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = by_hand(docs)
    have = rows_of(queries.QUERIES["op12_spelling_variants"](spark, sf))
    assert have == spelling.brute_force(want)
    assert sum(v[0] is not None for v in have.values()) >= 5


@pytest.mark.parametrize("most_words", [2, 9, 4096])
def test_dense_words_in_lists_of_any_size(spark, most_words):
    rng = random.Random(most_words)
    words = {"".join(rng.choice("abc") for _ in range(rng.randrange(1, 9))): rng.choice((1, 2, 15, 200, 3000)) for _ in range(700)}
    words |= {"": 4, "é" * 300: 5, "é" * 299: 50, "é" * 299 + "f": 500, "yÿà": 2, "yÿ": 30}
    frame = spark.createDataFrame(list(words.items()), "word string, n long").repartition(5)
    assert rows_of(spelling.variants(frame, most_words=most_words)) == spelling.brute_force(words)


@settings(max_examples=60, deadline=None)
@given(st.sets(st.text("ab", min_size=1, max_size=7), min_size=2, max_size=40))
def test_one_list_against_brute_force(words):
    """The scan itself, over one list of words of two lengths that share nothing."""
    import numpy as np

    for length in range(1, 8):
        own = sorted(w for w in words if len(w) in (length, length + 1))
        if len(own) < 2 or not any(len(w) == length for w in own):
            continue
        grid = np.array(own, f"<U{length + 1}").view(np.uint32).reshape(len(own), length + 1)
        a, b = spelling._near(grid, length, 0, np.array([0]), np.full(len(own), 99))
        have = Counter((own[i], own[j]) for i, j in zip(a, b))
        near = spelling.brute_force(dict.fromkeys(own, 1))
        want = {(x, y) for x in own for y in own if len(x) == length and x != y and spelling.brute_force({x: 1, y: 1})[x][3]}
        assert set(have) == want and max(have.values(), default=1) == 1
        assert sum(v[3] for v in near.values()) >= len(want)


def test_a_hot_head_is_split(spark):
    """All words share head and length: lists of no more than a bound all the same, and equal results."""
    rng = random.Random(3)
    words = {"abcdef" + "".join(rng.choice("ghijk") for _ in range(6)): rng.choice((1, 40)) for _ in range(900)}
    frame = spark.createDataFrame(list(words.items()), "word string, n long")
    assert rows_of(spelling.variants(frame, most_words=50)) == spelling.brute_force(words)


def test_awkward(spark):
    """Null ids and texts, empty and very long texts, repeated rows, clashing columns, empty tables."""
    rows = [(1, "Testing tEsting testinx", "x", 9), (1, "Testing tEsting testinx", "x", 9), (None, "testing " * 30, "y", 1), (2, None, None, None), (3, "", "", 0), (4, "testing " * 60_000, "z", 2), (5, "TESTÀNG testàng", "", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, word string, n long").repartition(3)
    have = rows_of(spelling.variants(spelling.vocabulary(docs)))
    assert have["testing"] == (None, "testing", 60_034, 1, None) and have["testinx"] == ("testing", "testing", 2, 1, 60_034)
    assert set(have) == {"testing", "testinx"}, "only A-Z is lower-cased"
    assert spelling.variants(spelling.vocabulary(docs.limit(0))).count() == 0
    odd = spark.createDataFrame([("word", 1), ("word", 2), (None, 9), ("ward", 30)], "word string, n long")
    assert rows_of(spelling.variants(odd)) == {"word": ("ward", "ward", 3, 1, 30), "ward": (None, "ward", 30, 1, None)}
    with pytest.raises(ValueError):
        spelling.variants(odd, ratio=1)


def test_chains_of_forms_end_at_their_root(spark):
    words = {"aaaaaaaa"[:i] + "b" * (8 - i): 11**i for i in range(9)}
    frame = spark.createDataFrame(list(words.items()), "word string, n long")
    have = rows_of(spelling.variants(frame))
    assert have == spelling.brute_force(words) and have["b" * 8][1] == "a" * 8
