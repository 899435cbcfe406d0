"""Quality rules as a short-circuit cascade.

Each rule judges one document from shared lazily computed counts. The order comes from a sample of documents (at most
``sample`` of them and ``sample_bytes`` in all, both parameters): rules are chosen one after another, each time the one
with the most rejections per second among the documents that the rules before it have left, where counts that those
rules have made already cost nothing. A document leaves the cascade at its first rejection. The order changes the cost
and the name of the rule that rejects first; the verdict is the conjunction of all rules, so it is the same for every
sample and every order.

A null text has no words. Repeated rows are judged alike. Texts are judged whole, whatever their length. An empty table
gives an empty result. Further columns, whatever their names, are not read.
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable
from copy import copy
from functools import cached_property

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.arrow import map_batches
from palimpsest.llm.common import FILE, ROW, WHITE, table

SYMBOLS = "#*$%&|<>"


class Counts:
    """Counts of one text, each made when first asked for."""

    def __init__(self, text: str | None):
        self.text = text or ""

    @cached_property
    def words(self) -> list[bytes]:
        return self.text.encode("utf-8", "surrogatepass").split()  # bytes split on exactly space and 09 to 0D hex

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - sum(map(self.text.count, WHITE))

    @cached_property
    def n_symbols(self) -> int:
        return sum(map(self.text.count, SYMBOLS))

    @cached_property
    def lines(self) -> list[str]:
        return [x for x in self.text.split("\n") if x.strip(WHITE)]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        w = self.words
        windows = list(zip(w, w[1:], w[2:]))
        if len(set(windows)) == len(windows):
            return 0
        seen, marked = Counter(windows), bytearray(len(w))
        for k, x in enumerate(windows):
            if seen[x] > 1:
                marked[k] = marked[k + 1] = marked[k + 2] = 1
        return sum(marked)

    @property
    def base_failed(self) -> bool:
        return self.n_words < 50 or 100 * self.n_repeat_words > 50 * self.n_words

    @cached_property
    def n_capitals(self) -> int:
        return sum(1 for w in self.words if len(w) > 1 and w.isupper())


#: name -> whether the document is rejected.
RULES: dict[str, Callable[[Counts], bool]] = {
    "symbols_per_word": lambda c: 10 * c.n_symbols > c.n_words,
    "word_length": lambda c: not 2 * c.n_words <= c.word_chars <= 20 * c.n_words,
    "duplicate_lines": lambda c: c.n_dup_lines >= 3 and 2 * c.n_dup_lines > len(c.lines),
    "capital_words": lambda c: 10 * c.n_capitals > 3 * c.n_words,
    "exclamations": lambda c: 5 * c.text.count("!") > c.n_words,
    "repeated_words": lambda c: 100 * c.n_repeat_words > 50 * c.n_words,
    "too_short": lambda c: c.n_words < 50,
}


def measured_order(texts: list[str | None], rules: dict = RULES) -> list[tuple[str, float, float]]:
    """(name, cost in seconds a document, share rejected) in the cascade's order, both of the documents left; ties by name."""
    left, open_rules, found = [Counts(x) for x in texts], dict(rules), []
    while open_rules:
        tried = []
        for name, rule in sorted(open_rules.items()):
            own = [copy(c) for c in left]  # with the counts that earlier rules have made
            t = time.perf_counter()
            rejected = sum(map(rule, own))
            tried.append((name, max(time.perf_counter() - t, 1e-9) / max(1, len(left)), rejected / max(1, len(left))))
        best = min(tried, key=lambda x: (-x[2] / x[1], x[1], x[0]))
        found.append(best)
        rule = open_rules.pop(best[0])
        left = [c for c in left if not rule(c)]
    return found


def sample_order(docs: DataFrame, sample: int = 400, sample_bytes: int = 4 << 20, seed: int = 7, text_col: str = "text") -> list[str]:
    """The cascade's order, from a bounded sample of documents spread over the whole table."""
    n = docs.count()
    if not n:
        return list(RULES)
    texts, held = [], 0
    for row in docs.select(F.col(text_col).cast("string").alias("text")).sample(False, min(1.0, sample / n), seed).toLocalIterator():
        held += len(row["text"] or "")
        if len(texts) >= sample or texts and held > sample_bytes:
            break
        texts.append(row["text"])
    return [x[0] for x in measured_order(texts)]


def judge(docs: DataFrame, order: list[str] | None = None, sample: int = 400, id_col: str = "doc_id", text_col: str = "text", place: bool = False) -> DataFrame:
    """doc_id, the base counts, base_failed, kept and failed_rule (the first rule that rejected; null if kept)."""
    order = order or sample_order(docs, sample, text_col=text_col)
    where = [FILE, ROW] if place else []

    def make():
        cascade = [(name, RULES[name]) for name in order]

        def call(batch: pa.RecordBatch) -> list:
            out: list[list] = [[] for _ in range(8)]
            for text in batch.column(1).to_pylist():
                c = Counts(text)
                failed = next((name for name, rule in cascade if rule(c)), None)
                bad = c.base_failed
                for column, x in zip(out, (c.n_words, c.word_chars, c.n_symbols, c.n_dup_lines, c.n_repeat_words, bad, not bad and failed is None, failed)):
                    column.append(x)
            return [batch.column(0), *out, *(batch.column(k) for k in range(2, batch.num_columns))]

        return call

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *where)
    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, failed_rule string"
    return map_batches(narrow, schema + "".join(f", {x} long" for x in where), make)


def passing(docs: DataFrame, sample: int = 400) -> DataFrame:
    """docs that pass the whole cascade, columns unchanged; only the cascade runs, up to a document's first rejection."""
    order = sample_order(docs, sample)
    @F.pandas_udf("boolean")
    def passes(texts: pd.Series) -> pd.Series:
        cascade = [RULES[name] for name in order]

        def ok(text) -> bool:
            c = Counts(text)
            return not any(rule(c) for rule in cascade)

        return texts.map(ok).astype(bool)

    return docs.where(passes(F.col("text").cast("string")))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's base counts and verdict."""
    return judge(table(spark, sf_dir, "documents")).drop("failed_rule")


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), c AS (
  SELECT doc_id, t, w, lines, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         len(list_filter(w, lambda x: strlen(x) > 1 AND regexp_matches(x, '[A-Z]') AND NOT regexp_matches(x, '[a-z]'))) AS capitals,
         length(t) - length(replace(t, '!', '')) AS bangs
  FROM d
), g AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)
), dup AS (
  SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1
), rep AS (
  SELECT doc_id, CAST(count(DISTINCT p) AS BIGINT) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM dup) GROUP BY doc_id
), x AS (
  SELECT c.*, coalesce(rep.n, 0) AS n_repeat_words FROM c LEFT JOIN rep USING (doc_id)
), y AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM x
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT base_failed AND NOT (10 * n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 20 * n_words
         OR n_dup_lines >= 3 AND 2 * n_dup_lines > len(lines) OR 10 * capitals > 3 * n_words OR 5 * bangs > n_words) AS kept
FROM y
"""
