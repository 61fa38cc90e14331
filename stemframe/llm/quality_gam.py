"""Quality classifier: a generalised additive model with pairwise interactions.

The log-odds of a document are a sum of lookup tables, one for each feature's bins and one for each of a
few pairs of features. The tables are learned by cyclic boosting: round after round, every feature in turn
gets a shallow tree fitted to the current residuals, and trees on one feature add up to a table. Pairs are
then ranked by what a coarse two-way table of the residuals would still gain, and the best are boosted in
the same way. Scoring is finding bins and adding table entries, for whole batches at once.
"""

from __future__ import annotations

from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemframe.llm.common import id_crc

FEATURES = ["log_words", "word_length", "upper", "symbols", "pipes", "digits", "bangs", "distinct", "repeated", "dup_lines", "ends", "line_words", "marks", "top_word", "stutter", "long_words"]
SYMBOLS = "#*$%&|<>"
GAPS = " \t\n\x0b\x0c\r"


def features(text: str | None) -> list[float]:
    """The features of a whole text; an empty or null one has zeros (and all its words distinct)."""
    text = text or ""
    words = text.split()
    n, chars = max(len(words), 1), max(len(text), 1)
    counts = Counter(words)
    windows = list(zip(words, words[1:], words[2:], words[3:], words[4:]))
    lines = [x for x in text.split("\n") if x.strip(GAPS)]
    letters = "".join(words)
    upper = sum(map(str.isupper, words))
    marks = sum(map(text.count, ".,;:!?"))
    return [
        np.log1p(len(words)),
        len(letters) / n,
        upper / n,
        sum(map(text.count, SYMBOLS)) / chars,
        counts.get("|", 0) / n,
        sum(map(text.count, "0123456789")) / chars,
        text.count("!!") / n,
        len(counts) / n if words else 1.0,
        1 - len(set(windows)) / len(windows) if windows else 0.0,
        1 - len(set(lines)) / len(lines) if lines else 0.0,
        text.count(".") / n,
        np.log1p(n / max(len(lines), 1)),
        marks / n,
        max(counts.values(), default=0) / n,
        sum(map(str.__eq__, words, words[1:])) / n,
        sum(len(w) > 20 for w in words) / n,
    ]


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _best_cut(g, h, ridge):
    """(cut, gain) of the best split of bins 0..cut against the rest; cut -1: none gains."""
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    if not left_g.size:
        return -1, 0.0
    all_g, all_h = g.sum(), h.sum()
    gain = left_g**2 / (left_h + ridge) + (all_g - left_g) ** 2 / (all_h - left_h + ridge) - all_g**2 / (all_h + ridge)
    at = int(gain.argmax())
    return (at, float(gain[at])) if gain[at] > 1e-12 else (-1, 0.0)


def _tree(g, h, ridge, depth=2):
    """Leaf values by bin of a shallow tree on one feature's binned gradients."""
    cut = _best_cut(g, h, ridge)[0] if depth else -1
    if cut < 0:
        return np.full(g.size, g.sum() / (h.sum() + ridge))
    return np.concatenate((_tree(g[: cut + 1], h[: cut + 1], ridge, depth - 1), _tree(g[cut + 1 :], h[cut + 1 :], ridge, depth - 1)))


def _pair_tree(g, h, ridge):
    """Leaf values of a tree that cuts the first feature and then, on each side, the second."""
    rows, cols = g.shape
    best, value = -np.inf, None
    for cut in range(rows - 1):
        out, gain = np.empty(g.shape), 0.0
        for part in (slice(0, cut + 1), slice(cut + 1, rows)):
            own_g, own_h = g[part].sum(axis=0), h[part].sum(axis=0)
            leaf = _tree(own_g, own_h, ridge, 1)
            out[part] = leaf[None, :]
            gain += float((leaf * own_g).sum())
        if gain > best:
            best, value = gain, out
    return value if value is not None else np.zeros(g.shape)


class Gam:
    """Lookup tables for bins of features and of pairs; ``fit`` learns them, ``score`` adds them up."""

    def __init__(self, bins: int = 32, coarse: int = 8, rounds: int = 250, pair_rounds: int = 80, pairs: int = 8, rate: float = 0.1, ridge: float = 2.0):
        self.bins, self.coarse, self.rounds, self.pair_rounds, self.n_pairs, self.rate, self.ridge = bins, coarse, rounds, pair_rounds, pairs, rate, ridge
        self.edges, self.tables, self.pairs, self.pair_tables, self.base = [], [], [], [], 0.0

    def _binned(self, x: np.ndarray) -> list[np.ndarray]:
        return [np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)]

    def _coarse(self, binned: np.ndarray, j: int) -> np.ndarray:
        return binned * self.coarse // (self.edges[j].size + 1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> "Gam":
        if not len(y) or y.min() == y.max():
            self.base = 0.0 if not len(y) else (4.0 if y[0] else -4.0)
            return self
        held = np.arange(len(y)) % 7 == 3  # boosting stops where these rows stop gaining
        use = ~held if held.any() and 0 < y[~held].mean() < 1 else np.ones(len(y), bool)
        quantiles = np.linspace(0, 1, self.bins + 1)[1:-1]
        self.edges = [np.unique(np.quantile(x[:, j], quantiles, method="higher")) for j in range(x.shape[1])]
        binned = self._binned(x)
        self.base = float(np.log(y.mean() / (1 - y.mean())))
        self.tables = [np.zeros(e.size + 1) for e in self.edges]
        z = np.full(len(y), self.base)
        loss = lambda: float(np.mean(np.logaddexp(0, np.where(y[held] > 0, -z[held], z[held])))) if held.any() else 0.0

        def boost(rounds, codes, tables, tree):
            best, kept, since = loss(), [t.copy() for t in tables], 0
            for _ in range(rounds):
                for code, t in zip(codes, tables):
                    p = _sigmoid(z[use])
                    g = np.bincount(code[use], y[use] - p, t.size).reshape(t.shape)
                    h = np.bincount(code[use], p * (1 - p), t.size).reshape(t.shape)
                    step = self.rate * tree(g, h, self.ridge)
                    t += step
                    z[:] += step.ravel()[code]
                now = loss()
                if not held.any() or now < best - 1e-6:
                    best, kept, since = now, [t.copy() for t in tables], 0
                elif (since := since + 1) >= 25:
                    break
            for code, t, k in zip(codes, tables, kept):
                z[:] += (k - t).ravel()[code]
                t[:] = k

        boost(self.rounds, binned, self.tables, _tree)
        grid = [self._coarse(b, j) for j, b in enumerate(binned)]
        p = _sigmoid(z[use])
        r, w = y[use] - p, p * (1 - p)
        size = self.coarse**2
        gains = {}
        for a, b in combinations(range(x.shape[1]), 2):
            code = (grid[a] * self.coarse + grid[b])[use]
            gains[a, b] = float((np.bincount(code, r, size) ** 2 / (np.bincount(code, w, size) + self.ridge)).sum())
        self.pairs = sorted(gains, key=lambda k: (-gains[k], k))[: self.n_pairs]
        self.pair_tables = [np.zeros((self.coarse, self.coarse)) for _ in self.pairs]
        boost(self.pair_rounds, [grid[a] * self.coarse + grid[b] for a, b in self.pairs], self.pair_tables, _pair_tree)
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.base)
        if self.edges and len(x):
            binned = self._binned(x)
            for b, t in zip(binned, self.tables):
                z += t[b]
            for (a, b), t in zip(self.pairs, self.pair_tables):
                z += t[self._coarse(binned[a], a), self._coarse(binned[b], b)]
        return _sigmoid(z)


def _matrix(texts) -> np.ndarray:
    return np.array([features(t) for t in texts], float).reshape(-1, len(FEATURES))


def _featured(batches):
    for batch in batches:
        x = _matrix(batch.column(1).to_pylist())
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x[:, j]) for j in range(x.shape[1]))], names=["y", *FEATURES])


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = 20_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", **options) -> Gam:
    """Learn from labelled rows whose crc32(id) mod 5 is not 0: at most ``train_rows``, those of smallest id hash.

    Their features (a row of 16 numbers each) reach the driver, where the tables are fitted.
    """
    few = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("y")).filter("y IS NOT NULL AND id IS NOT NULL").filter(id_crc("id") % 5 != 0)
    few = few.orderBy(F.xxhash64("id"), "id", "y").limit(train_rows)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(few), "id")  # at most train_rows small rows
    got = rows.select("y", "text").mapInArrow(_featured, ", ".join(f"{c} double" for c in ["y", *FEATURES])).toPandas()
    got = got.sort_values(["y", *FEATURES]).sample(frac=1, random_state=1)  # the same order however Spark dealt the rows
    return Gam(**options).fit(got[FEATURES].to_numpy(float), got["y"].to_numpy(float))


def score(docs: DataFrame, model: Gam, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per input row: doc_id, held_out, score (chance of label 1), predicted. No shuffle.

    A null text scores as an empty one; repeated rows and null ids (held out: false) are carried through; a
    model without both labels to learn from scores every row alike; other columns are ignored.
    """

    def run(batches):
        for batch in batches:
            s = model.score(_matrix(batch.column(2).to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32), pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(id_crc(id_col) % 5 == 0, F.lit(False)).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
