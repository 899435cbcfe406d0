"""Line dedup against a brute-force version, and its minimal perfect hash on its own."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import line_dedup
from tests.llm.fixtures import clashing, none, prose, rows, saved

WHITE = " \t\n\x0b\f\r"


def brute(texts, least, min_chars):
    """Rows of (doc_id, n_lines, n_dropped, digest) for rows of (doc_id, text)."""
    key = lambda line: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(WHITE))
    split = [(d, (t or "").split("\n")) for d, t in texts]
    holders = defaultdict(list)
    for d, lines in split:
        for k in {key(x) for x in lines}:
            holders[k].append(d)
    out = Counter()
    for d, lines in split:
        kept = []
        for x in lines:
            h = holders[key(x)]
            top = max((y for y in h if y is not None), default=None)
            if len(key(x)) < min_chars or len(h) < least or d == top:
                kept.append(x)
        out[(d, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())] += 1
    return out


def got(df):
    return Counter((r.doc_id, r.n_lines, r.n_dropped, hashlib.sha256(r.text.encode()).hexdigest()) for r in df.collect())


def shared_lines():
    common = [prose(900 + k, 12) for k in range(6)]
    texts = []
    for k in range(60):
        lines = [prose(2000 + 7 * k + j, 9) for j in range(4)]
        lines += [common[0], "\t " + common[0].upper() + "\r"] + [c for j, c in enumerate(common) if (k + j) % (j + 2) == 0]
        texts.append((k, "\n".join(lines) + "\n" * (k % 3)))
    return [*texts, (60, common[1] + " é"), (61, " " + common[1]), (62, "x" * 39), *[(70 + k, "x" * 39) for k in range(6)], *[(80 + k, "Ä" * 40) for k in range(6)]]


@pytest.mark.parametrize("options", [{}, {"lines_a_shard": 7, "asks_a_task": 5}])
def test_equals_brute_force(spark, options):
    texts = shared_lines()
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    assert got(line_dedup.drop_repeated_lines(df, 5, 40, **options)) == brute(texts, 5, 40)
    assert got(line_dedup.drop_repeated_lines(df, 2, 8, **options)) == brute(texts, 2, 8)


def test_awkward_inputs(spark, tmp_path):
    texts = [(r[0], r[1]) for r in rows()]
    long = "\n".join(prose(k % 50, 11) for k in range(30_000))
    for df, want in (
        (clashing(spark), texts),
        (spark.createDataFrame([(k, long) for k in range(3)] + [(None, long)] * 2, "doc_id long, text string"), [(k, long) for k in range(3)] + [(None, long)] * 2),
        (spark.createDataFrame([(None, prose(1, 20))] * 6, "doc_id long, text string"), [(None, prose(1, 20))] * 6),
        (spark.createDataFrame([(4, prose(1, 20))] * 6, "doc_id long, text string"), [(4, prose(1, 20))] * 6),
    ):
        assert got(line_dedup.drop_repeated_lines(df, 3, 40)) == brute(want, 3, 40)
    assert line_dedup.drop_repeated_lines(none(spark)).count() == 0
    df = line_dedup.op11_line_dedup(spark, saved(spark, tmp_path))
    assert df.dtypes == [("doc_id", "bigint"), ("n_lines", "bigint"), ("n_dropped", "bigint"), ("kept_sha256", "string")] and df.count() == len(texts)


@pytest.mark.parametrize("n", [0, 1, 2, 65, 20_000])
def test_the_hash_is_minimal_and_perfect(n):
    r = np.random.default_rng(n)
    h1, h2, others = (r.integers(0, 1 << 63, n, np.uint64) for _ in range(3))
    h1[: n // 10] = h1[:1]  # the same first half, told apart by the second
    index = line_dedup.LineIndex.load(line_dedup.LineIndex.build(h1, h2, np.arange(n), -np.arange(n)).dump())
    slot = index.find(h1, h2)
    assert sorted(slot.tolist()) == list(range(n))
    assert (index.documents[slot] == np.arange(n)).all() and (index.keeper[slot] == -np.arange(n)).all()
    assert (index.find(h1, others) == -1).all() and (index.find(others, others) == -1).all()
    assert sum(len(x) for x in index.levels) * 64 <= 6 * n + 2048


def test_a_line_in_every_document_is_dealt_among_copies(spark):
    lines = spark.range(5000).select(F.col("id").alias("doc_id"), F.concat(F.lit("a line that is found in each and every document\n"), F.sha2(F.col("id").cast("string"), 256)).alias("text"))
    out = line_dedup.drop_repeated_lines(lines, asks_a_task=200).groupBy("n_dropped").count().collect()
    assert {r.n_dropped: r["count"] for r in out} == {0: 1, 1: 4999}
