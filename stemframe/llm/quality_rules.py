"""Quality rules on documents and on hosts.

Rules look at one document; hosts add what a single document can't show. For each rule the failures are counted by
host, the hosts' failure rates are shrunk towards the mean of all hosts with a beta prior fitted to them (so a host
of two documents is not judged by two documents), and a host whose shrunk rate is above ``max_rate`` under any rule
takes its remaining documents with it: a site of nothing but symbols or copied lines falls as a whole, though no
single document of it breaks a base rule.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemframe.storage import staged


GAPS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


def measures(text: str | None) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and n_lines (with a word) of a whole text (null: none)."""
    if not text:
        return 0, 0, 0, 0, 0, 0
    words = text.encode("utf-8", "surrogatepass").split()
    lines = [x for x in text.split("\n") if x.strip(GAPS)]
    repeated = 0
    windows = list(zip(words, words[1:], words[2:], words[3:], words[4:]))
    if len(set(windows)) < len(windows):
        often = {w for w, n in Counter(windows).items() if n > 1}
        end = 0  # words before it are counted
        for i, w in enumerate(windows):
            if w in often:
                repeated += i + 5 - max(end, i)
                end = i + 5
    return len(words), len(text) - sum(map(text.count, GAPS)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated, len(lines)


MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
LINES = "n_lines"
#: Rules that hosts are judged by: the base rules, symbols beyond a tenth of the words, and repeated lines beyond three tenths.
RULES = {"base": "base_failed", "symbols": "100 * n_symbols > 10 * n_words", "lines": "100 * n_dup_lines > 30 * n_lines"}


def _measured(batches):
    for batch in batches:
        found = [measures(t.as_py()) for t in batch.column(2)]
        columns = list(zip(*found)) if found else [[]] * (len(MEASURES) + 1)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, pa.int64()) for c in columns)], names=["doc_id", "host", *MEASURES, LINES])


def document_measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(host_col).cast("string").alias("host"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_measured, "doc_id long, host string, " + ", ".join(f"{m} long" for m in [*MEASURES, LINES]))


def beta_priors(hosts: DataFrame, rules: list[str]) -> dict[str, tuple[float, float]]:
    """(a, b) of each rule's beta prior by the method of moments over hosts (n, and failures in a column by rule); one row reaches the driver."""
    n = F.col("n")
    sums = [F.sum("n").alias("n"), F.count(F.lit(1)).alias("hosts")]
    for r in rules:
        sums += [F.sum(r).alias(r), F.sum(F.col(r) * F.col(r) / n).alias(f"{r}_squares")]
    s = hosts.agg(*sums).first()
    found = {}
    for r in rules:
        if not s["n"]:
            found[r] = 1.0, 1.0
            continue
        mean = s[r] / s["n"]
        spread = s[f"{r}_squares"] / s["n"] - mean * mean  # variance of the hosts' rates, weighted by documents
        within = mean * (1 - mean) * s["hosts"] / s["n"]  # what chance alone gives
        between = max(spread - within, 1e-6)
        strength = min(max(mean * (1 - mean) / between - 1, 1.0), 1e6)
        found[r] = max(mean * strength, 1e-3), max((1 - mean) * strength, 1e-3)
    return found


def quality_rules(docs: DataFrame, max_rate: float = 0.5, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", rules: dict[str, str] = RULES) -> DataFrame:
    """Per input row: doc_id, the five measures, base_failed, host_rates (shrunk, by rule), kept.

    * A null text has no words and so fails; a null host is a host of its own.
    * Repeated rows count as documents of their own; a null id is carried through.
    * An empty table gives no rows; other columns of the input are ignored.

    A host falls only if under one rule more than ``max_rate`` of its documents would fail after shrinking; a rate
    of exactly that much stands.
    """
    base = staged(document_measures(docs, id_col, text_col, host_col).withColumn("base_failed", F.expr("n_words < 10 OR 100 * n_repeat_words > 20 * n_words")), "measures")
    base = base.withColumn("key", F.coalesce(F.concat(F.lit("="), "host"), F.lit("null")))
    hosts = base.groupBy("key").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.expr(rule).cast("long")).alias(r) for r, rule in rules.items()])
    hosts = staged(hosts, "hosts")
    priors = beta_priors(hosts, list(rules))
    rates = [((F.col(r) + priors[r][0]) / (F.col("n") + (priors[r][0] + priors[r][1]))).alias(r) for r in rules]
    judged = base.join(hosts.select("key", F.struct(*rates).alias("host_rates")), "key")
    stands = F.greatest(*[F.col(f"host_rates.{r}") for r in rules], F.lit(0.0)) <= max_rate
    return judged.select("doc_id", *MEASURES, "base_failed", "host_rates", (~F.col("base_failed") & stands).alias("kept"))


ORACLE = r"""WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
  g AS (SELECT doc_id, i, array_to_string(words[i:i + 4], ' ') AS gram FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM d)),
  r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g) WHERE n > 1),
  c AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM r CROSS JOIN (SELECT unnest(range(0, 5)) AS k) GROUP BY doc_id),
  l AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d)
    WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
  m AS (SELECT doc_id, source, len(words) AS n_words, coalesce(list_sum(list_transform(words, lambda w: length(w))), 0)::BIGINT AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines
    FROM d LEFT JOIN c USING (doc_id) LEFT JOIN l USING (doc_id)),
  b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m),
  f AS (SELECT source, 'base' AS rule, base_failed AS failed FROM b UNION ALL SELECT source, 'symbols', 100 * n_symbols > 10 * n_words FROM b
    UNION ALL SELECT source, 'lines', 100 * n_dup_lines > 30 * n_lines FROM b),
  h AS (SELECT source, rule, count(*) AS n, count(*) FILTER (failed) AS failed FROM f GROUP BY source, rule),
  s AS (SELECT rule, sum(failed) / sum(n) AS mean, sum(failed * failed / n) / sum(n) AS ff, count(*) / sum(n) AS per FROM h GROUP BY rule),
  t AS (SELECT rule, mean, least(greatest(mean * (1 - mean) / greatest(ff - mean * mean - mean * (1 - mean) * per, 1e-6) - 1, 1), 1e6) AS strength FROM s),
  v AS (SELECT source, max((failed + greatest(mean * strength, 1e-3)) / (n + greatest(mean * strength, 1e-3) + greatest((1 - mean) * strength, 1e-3))) AS host_rate
    FROM h JOIN t USING (rule) GROUP BY source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND host_rate <= 0.5 AS kept
FROM b JOIN v ON b.source IS NOT DISTINCT FROM v.source"""
