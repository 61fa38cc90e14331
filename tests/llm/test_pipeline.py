"""The pipeline against its stages written again from their definitions, on plain rows."""

import base64
import hashlib
import math
import random
import zlib
from collections import Counter

import corpus_pipeline
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

from stemframe.llm import language

SF = "/root/testdata/sf0.001"
NAMES = ["doc_id", "text", "lang", "source", "n_chars"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def trigrams(text):
    """Letter trigrams as strings; other characters are one space."""
    s = "".join(c if c.isalpha() else " " for c in (text or "").lower())
    s = f" {' '.join(s.split())} "
    return Counter(s[i : i + 3] for i in range(len(s) - 2)) if s.strip() else Counter()


def inferred(rows):
    """(row, language, score) of rows with letters: EM by hand over plain trigram counts, sets by penalised likelihood."""
    counts = {}
    for r in rows:
        if r["lang"] is not None and r["text"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1:
            counts.setdefault(r["lang"], Counter()).update(trigrams(r["text"]))
    langs = sorted(counts)
    total = {x: sum(counts[x].values()) + 0.5 * 32768 for x in langs}
    out = []
    for r in rows:
        bag = trigrams(r["text"])
        if not bag or not langs:
            continue
        n = sum(bag.values())
        p = {g: {x: (counts[x][g] + 0.5) / total[x] for x in langs} for g in bag}

        def em(some, p=p, bag=bag, n=n):
            share = {x: 1 / len(some) for x in some}
            for _ in range(120):
                new = dict.fromkeys(some, 0.0)
                for g, k in bag.items():
                    z = sum(share[x] * p[g][x] for x in some)
                    for x in some:
                        new[x] += k * share[x] * p[g][x] / z
                share = {x: v / n for x, v in new.items()}
            return share, sum(k * math.log(sum(share[x] * p[g][x] for x in some)) for g, k in bag.items())

        alone = {x: sum(k * math.log(p[g][x]) for g, k in bag.items()) for x in langs}
        value, cost = max(alone.values()), 2 * math.log(n + 1)
        score, best = 1 / sum(math.exp(max(v - value, -700)) for v in alone.values()), max(alone, key=alone.get)
        full, likely = em(langs)
        if likely - value > cost:
            order = sorted(langs, key=lambda x: -full[x])
            for k in range(2, len(langs) + 1):
                share, like = em(order[:k])
                if like - (k - 1) * cost > value:
                    value, score, best = like - (k - 1) * cost, max(share.values()), max(share, key=share.get)
        out.append((r, best, score))
    return out


def one_of_each_text(rows):
    best = {}
    for r in rows:
        t = r["text"] or ""
        if t not in best or (r["doc_id"] is not None, r["doc_id"] or 0) > (best[t]["doc_id"] is not None, best[t]["doc_id"] or 0):
            best[t] = r
    return list(best.values())


def one_of_each_group(rows):
    """All pairs by their sets of five words; the smallest id of each component stays, and rows without an id."""
    sets = []
    for r in rows:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in r["text"] or "").encode().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    where = {}
    for i, s in enumerate(sets):
        for g in s:
            where.setdefault(g, []).append(i)
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, s in enumerate(sets):
        for j in {j for g in s for j in where[g] if j < i}:
            both = len(s & sets[j])
            if rows[i]["doc_id"] is not None and rows[j]["doc_id"] is not None and (100 * both >= 80 * (len(s) + len(sets[j]) - both) or rows[i]["doc_id"] == rows[j]["doc_id"]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, r in enumerate(rows):
        if r["doc_id"] is not None:
            least[find(i)] = min(least.get(find(i), r["doc_id"]), r["doc_id"])
    return [r for i, r in enumerate(rows) if r["doc_id"] is None or r["doc_id"] == least[find(i)]]


def mixed(rows):
    """(row, copies): sources filled up to 150 % of all words, none above twice its own, in the seeded order."""
    size = [len((r["text"] or "").encode().split()) for r in rows]
    names = sorted({r["source"] for r in rows if r["source"] is not None}, key=lambda s: s.encode()) + [None] * any(r["source"] is None for r in rows)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    own = {s: sum(n for r, n in zip(rows, size) if r["source"] == s) for s in names}
    target, free = {}, list(names)
    while free:
        left = 1.5 * sum(own.values()) - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 2 * own[s]]
        target |= {s: 2.0 * own[s] for s in over} if over else share
        free = [s for s in free if s in over] and [s for s in free if s not in over] if over else []
    out = []
    for s in names:
        order = sorted((i for i in range(len(rows)) if rows[i]["source"] == s), key=lambda i: hashlib.md5(f"7:{'null' if rows[i]['doc_id'] is None else rows[i]['doc_id']}".encode()).hexdigest())
        whole = math.floor(target[s] / own[s]) if own[s] else 0
        rest, at = round(target[s] - whole * own[s]), 0
        for i in order:
            part = max(0, min(size[i], rest - at))
            at += size[i]
            out.append((rows[i], whole + (size[i] > 0 and 2 * part >= size[i])))
    return out


def brute_force(rows):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter()
    known = [r for r, _, score in inferred(rows) if score >= 0.5]
    for r, copies in mixed(one_of_each_group(one_of_each_text(known))):
        ids = enc.encode_ordinary(r["text"] or "")
        packed = b"".join(i.to_bytes(4, "little") for i in ids)
        want[r["doc_id"], len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest()] += copies
    return +want


def digests(rows):
    return Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows)


@pytest.fixture(scope="module")
def awkward(spark, tmp_path_factory):
    """The given documents with nulls in any column, empty and very long texts, ties, repeated rows and letters of no language."""
    rng = random.Random(4)
    rows = [r.asDict() for r in spark.read.parquet(f"{SF}/documents.parquet").select(*NAMES).collect()]
    text = max((r["text"] or "" for r in rows), key=len)
    more = [(None, None, None, None, None), (9001, None, "en", "a", 0), (9002, "", "en", None, 0), (9003, " \n\t", None, "a", 3), (9004, "123 ### 456", "en", "a", 11), (9004, "123 ### 456", "en", "a", 11)]
    more += [(9005, text * 6, "en", None, 1), (9006, text, None, "b", 1), (9006, text, None, "b", 1), (None, rows[3]["text"], "en", "a", 1), (None, "A text without any id at all, and of its own.", "en", "a", 1), (9007, rows[5]["text"] + " and a tail", None, None, None)]
    more += [(9008, " ".join(rng.choice(rows)["text"] or "" for _ in range(4)), "de", "z", 5)]
    rows += [dict(zip(NAMES, m)) for m in more]
    where = tmp_path_factory.mktemp("awkward")
    df = spark.createDataFrame([tuple(r[c] for c in NAMES) for r in rows], SCHEMA)
    df.withColumn("row", F.lit(1)).withColumn("digest", F.lit("x")).withColumn("kept", F.lit(True)).withColumn("component", F.lit(2)).write.parquet(f"{where}/documents.parquet")
    return str(where), rows


def test_languages_equal_em_by_hand(spark):
    """The model hashes trigrams to buckets and stops EM within its slack, so a close score may differ a little."""
    rows = [r.asDict() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {r.doc_id: r for r in language.identify(spark.createDataFrame([tuple(r[c] for c in NAMES) for r in rows], SCHEMA)).collect()}
    by_hand = inferred(rows)
    assert {r["doc_id"] for r, _, _ in by_hand} == {d for d, r in got.items() if r.lang_pred != "und"}
    assert sum(got[r["doc_id"]].lang_pred == best for r, best, _ in by_hand) >= 0.99 * len(by_hand)
    assert sum(abs(got[r["doc_id"]].score - score) < 0.05 for r, _, score in by_hand) >= 0.98 * len(by_hand)


def test_run_equals_brute_force(spark):
    rows = [r.asDict() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = digests(corpus_pipeline.run(spark, SF).collect())
    assert got == brute_force(rows) and 0 < len(got) < len(rows)


def test_run_on_awkward_rows(spark, awkward):
    where, rows = awkward
    assert digests(corpus_pipeline.run(spark, where).collect()) == brute_force(rows)


def test_run_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_keep_the_columns(spark, awkward):
    docs = spark.read.parquet(f"{awkward[0]}/documents.parquet").limit(40)
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == names, name


def test_language_stage_follows_the_model(spark, awkward, monkeypatch):
    docs = spark.read.parquet(f"{awkward[0]}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)["language ID"]
    before = stage(spark, docs, awkward[0]).count()

    class Unsure(language.Mixture):
        def infer(self, bags):
            shares, score = super().infer(bags)
            return shares, score * 0.4

    monkeypatch.setattr(language, "Mixture", Unsure)
    assert 0 == stage(spark, docs, awkward[0]).count() < before < docs.count()
