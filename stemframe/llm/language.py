"""Language identification by mixture inference.

A document is a bag of letter trigrams drawn from a mixture of languages. Expectation-maximisation finds
the mixture's proportions; which languages take part is chosen by penalised likelihood, since a further
language never lowers the likelihood by itself. Trigram counts per language are the whole model: a dense
table of ``BUCKETS`` hashed trigrams by languages, so its size does not depend on the input.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemframe.llm.common import id_crc, working

#: Hashed trigrams of the model.
BUCKETS = 1 << 15
#: Characters of the documents that are worked on together.
BATCH_CHARS = 400_000
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def trigrams(text: str | None) -> np.ndarray:
    """Hashed trigrams of the lower-case letters, with one space for whatever stands between them."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), "<u4")
    letter = _letters()[codes]
    if not letter.any():
        return np.zeros(0, np.int64)
    codes = np.concatenate(([32], np.where(letter, codes, 32), [32])).astype(np.uint32)
    codes = codes[np.concatenate(([True], (codes[1:] != 32) | (codes[:-1] != 32)))]
    h = codes[:-2] * np.uint32(0x9E3779B1) + codes[1:-1] * np.uint32(0x85EBCA6B) + codes[2:] * np.uint32(0xC2B2AE35)
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    return (h >> np.uint32(17)).astype(np.int64)


def _counted(batches):
    """Trigram counts by language of a partition: at most BUCKETS rows for each language."""
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        for text, lang in zip(batch.column(0), batch.column(1)):
            own = counts.setdefault(lang.as_py(), np.zeros(BUCKETS, np.int64))
            grams = trigrams(text.as_py())
            if grams.size:
                own += np.bincount(grams, minlength=BUCKETS)
    for lang, own in counts.items():
        at = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * at.size, pa.string()), pa.array(at, pa.int64()), pa.array(own[at], pa.int64())], names=["lang", "gram", "n"])


def _bag(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if grams.size < 1000:
        return np.unique(grams, return_counts=True)
    n = np.bincount(grams, minlength=BUCKETS)
    at = np.flatnonzero(n)
    return at, n[at]


class Mixture:
    """Trigram probabilities by language, and inference of proportions for batches of documents.

    ``slack`` is how far, in log-likelihood, EM may stop below the likeliest mixture (plus one part in a hundred
    thousand for rounding); ``most_rounds`` only bounds documents whose likelihood is all but flat.
    """

    def __init__(self, langs: list[str], counts: np.ndarray, smoothing: float = 0.5, penalty: float = 2.0, slack: float = 0.1, most_rounds: int = 800):
        self.langs, self.penalty, self.slack, self.most_rounds = langs, penalty, slack, most_rounds
        p = counts + smoothing
        self.p = p / p.sum(axis=0, keepdims=True) if langs else p

    def _em(self, p, n, lengths, share, step: int = 5):
        """EM from ``share``: (proportions, log-likelihood, room), the last by how much the best mixture of these languages may be likelier.

        Log-likelihood is concave in the proportions, so that bound holds at any of them; EM goes on for each
        document until its room is within the slack.
        """
        share, room = share.astype(float), np.zeros(len(lengths))
        p32 = p.astype(np.float32)
        todo, q, m = np.arange(len(lengths)), p32, n.astype(np.float32)
        for _ in range(self.most_rounds // step):
            own = lengths[todo]
            doc, starts = np.repeat(np.arange(todo.size), own), np.concatenate(([0], np.cumsum(own)[:-1]))
            size = np.add.reduceat(m, starts)
            now, allowed = share[todo].astype(np.float32), share[todo] > 0
            for _ in range(step):
                joint = q * now[doc]
                joint *= (m / joint.sum(axis=1))[:, None]
                now = np.add.reduceat(joint, starts) / size[:, None]
            gain = np.add.reduceat(q * (m / (q * now[doc]).sum(axis=1))[:, None], starts) / size[:, None]
            share[todo] = np.where(allowed, np.maximum(now, 1e-30), 0)
            room[todo] = size * np.log(np.maximum(np.where(allowed, gain, 0).max(axis=1), 1))
            left = room[todo] > self.slack + 1e-5 * size
            if not left.any():
                break
            if not left.all():
                rows = left[doc]
                todo, q, m = todo[left], q[rows], m[rows]
        share /= share.sum(axis=1, keepdims=True)
        doc, starts = np.repeat(np.arange(len(lengths)), lengths), np.concatenate(([0], np.cumsum(lengths)[:-1]))
        return share, np.add.reduceat(n * np.log((p * share[doc]).sum(axis=1)), starts), room

    def infer(self, bags: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(proportions, score) by document; proportions are 0 for languages that are not in its set.

        Sets of k languages are the k largest of the mixture of all; the set with the best penalised
        likelihood wins, the smaller one if two are equal.
        """
        docs, langs = len(bags), len(self.langs)
        shares, score = np.zeros((docs, langs)), np.zeros(docs)
        some = [i for i, b in enumerate(bags) if b.size]
        if not langs or not some:
            return shares, score
        unique = [_bag(bags[i]) for i in some]
        lengths = np.array([u.size for u, _ in unique])
        gram, n = np.concatenate([u for u, _ in unique]), np.concatenate([c for _, c in unique]).astype(float)
        starts, doc = np.concatenate(([0], np.cumsum(lengths)[:-1])), np.repeat(np.arange(len(some)), lengths)
        p, size = self.p[gram], np.array([bags[i].size for i in some], float)
        alone = np.add.reduceat(n[:, None] * np.log(p), starts)
        best = alone.argmax(axis=1)
        found = np.zeros((len(some), langs))
        found[np.arange(len(some)), best] = 1
        value = alone.max(axis=1)
        sure = 1 / np.exp(np.maximum(alone - value[:, None], -700)).sum(axis=1)
        if langs > 1:
            full, likely, room = self._em(p, n, lengths, np.full((len(some), langs), 1 / langs))
            cost = self.penalty * np.log(size + 1)
            order = np.argsort(-full, axis=1, kind="stable")
            limit = likely + room
            open_ = np.arange(len(some))
            for k in range(2, langs + 1):
                # No k languages are likelier than all of them at their best.
                open_ = open_[limit[open_] - (k - 1) * cost[open_] > value[open_]]
                if not open_.size:
                    break
                start = np.full((open_.size, langs), 0.0)
                np.put_along_axis(start, order[open_, :k], np.take_along_axis(full[open_], order[open_, :k], 1) + 1e-6, 1)
                start /= start.sum(axis=1, keepdims=True)
                rows = np.isin(doc, open_)
                share, likely_k, _ = self._em(p[rows], n[rows], lengths[open_], start)
                worth = likely_k - (k - 1) * cost[open_]
                won = worth > value[open_]
                at = open_[won]
                found[at], value[at] = share[won], worth[won]
                sure[at] = share[won].max(axis=1)
        shares[some], score[some] = found, np.clip(sure, 0, 1)
        return shares, score


def fit(docs: DataFrame, train_rows: int = 200_000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Mixture:
    """Learn from documents with a language whose crc32(id) mod 3 is not 1.

    At most about ``train_rows`` of them are used, chosen by a hash of the id; counts by language and
    trigram (BUCKETS rows a language) reach the driver.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter("lang IS NOT NULL AND text IS NOT NULL").filter(id_crc("id") % 3 != 1)
    there = rows.count()
    if there > train_rows:
        rows = rows.filter(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(1_000_000 * train_rows / there))
    counted = rows.select("text", "lang").mapInArrow(_counted, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(set(counted["lang"]))
    counts = np.zeros((BUCKETS, len(langs)))
    counts[counted["gram"].to_numpy(int), np.searchsorted(langs, counted["lang"].to_numpy(str)) if langs else []] = counted["n"]
    return Mixture(langs, counts)


def _chunks(texts: list[str | None]):
    start = chars = 0
    for i, t in enumerate(texts):
        chars += len(t or "")
        if chars > BATCH_CHARS:
            yield start, i + 1
            start, chars = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def identify(docs: DataFrame, model: Mixture | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Per input row: doc_id, held_out, lang_pred, score, mixture (language -> proportion).

    ``lang_pred`` is the language of the largest proportion, ``und`` (score 0, no mixture) for a null text or
    one without letters. ``score`` is that proportion, for a document of one language the posterior of it
    among single languages. Equal proportions: the first language by name. Repeated rows and null ids (not
    held out) are carried through; without a row to learn from all is ``und``; other columns are ignored.
    """
    model = model or fit(docs, id_col=id_col, text_col=text_col, lang_col=lang_col)

    def run(batches):
        working("language")
        for batch in batches:
            texts = batch.column(2).to_pylist()
            pred, score, mixture = [], [], []
            for a, b in _chunks(texts):
                shares, found = model.infer([trigrams(t) for t in texts[a:b]])
                for row, s in zip(shares, found):
                    top = int(row.argmax()) if row.size else 0
                    known = bool(row.size and row[top] > 0)
                    pred.append(model.langs[top] if known else UNKNOWN)
                    score.append(float(s) if known else 0.0)
                    mixture.append([(model.langs[i], float(row[i])) for i in np.flatnonzero(row > 0)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(mixture, pa.map_(pa.string(), pa.float64()))], names=["doc_id", "held_out", "lang_pred", "score", "mixture"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(id_crc(id_col) % 3 == 1, F.lit(False)).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, mixture map<string, double>")


def with_known_language(docs: DataFrame, model: Mixture | None = None, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """The input's rows and columns without the rows whose language can't be told.

    A row goes if it has no letters (``und``) or if no language has a proportion of ``least`` or more: neither a
    main language of a mixture, nor one that is likelier than all others together for a text of one language.

    * Null, empty and letterless texts go; without a row to learn from all rows go.
    * Repeated rows and null ids share the verdict of their text; other columns, whatever their names, stay.
    * An empty table gives no rows.
    """
    model = model or fit(docs)
    at = docs.columns.index(text_col)

    def run(batches):
        working("language")
        for batch in batches:
            texts, keep = batch.column(at).to_pylist(), []
            for a, b in _chunks(texts):
                _, score = model.infer([trigrams(t) for t in texts[a:b]])
                keep += list((score > 0) & (score >= least))
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
