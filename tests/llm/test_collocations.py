"""Phrase collocations against a brute-force version, and the automaton against sets of end positions."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from palimpsest.llm import collocations
from tests.llm.fixtures import clashing, none, prose, rows

SCHEMA = "doc_id long, text string, lang string"


def brute(texts, longest=3, least=10, share=50, top=2000):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang in texts:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for k in range(1, longest + 1):
                f[lang or "und"].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        made = []
        for p, a in found.items():
            score, cut = min((10**6 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            if not any(100 * b >= share * a for q, b in found.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))):
                made.append((-score, -a, " ".join(p).encode(), counts[p[:cut]], counts[p[cut:]]))
        out += [(lang, k, p.decode(), -a, left, right, n[lang], -score) for k, (score, a, p, left, right) in enumerate(sorted(made)[:top], 1)]
    return sorted(out)


def got(df):
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect())


def texts(seed, n, langs=("en", "de", None)):
    r = random.Random(seed)
    words = [prose(seed * 100 + k, 1) for k in range(25)] + ["Ünï", "日本", "a b"]
    out = []
    for k in range(n):
        parts = [r.choice([" ", "  ", "\t", ", ", ".", "\n", "! "]) + (x.upper() if r.random() < 0.2 else x) for x in r.choices(words, weights=[1 / (j + 1) for j in range(len(words))], k=r.randrange(60))]
        out.append((k, "".join(parts) + " fixed phrase here" * (k % 3), langs[k % len(langs)]))
    return [*out, (n, None, "en"), (n, "", "fr"), (n, out[0][1], "en"), (None, out[1][1], None)]


@pytest.mark.parametrize("options", [{}, {"longest": 4, "least": 3}, {"longest": 2}, {"bits": 4}, {"words": 50}, {"least": 300}, {"top": 5, "share": 90}])
def test_equals_brute_force(spark, options):
    rows = texts(3, 150)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    want = brute(rows, **{k: v for k, v in options.items() if k not in ("bits", "words")})
    assert got(collocations.collocations(df, **{"bits": 12, **options})) == want


def test_awkward_inputs(spark):
    assert collocations.collocations(none(spark), bits=10).count() == 0
    assert got(collocations.collocations(clashing(spark), bits=16)) == brute([(r[0], r[1], r[2]) for r in rows()])
    long = [(1, "so very long a text, " * 30_000, "en"), (2, "x" * 100_000 + " y", "en"), (3, "﻿ z", "xx")]
    assert got(collocations.collocations(spark.createDataFrame(long, SCHEMA), bits=16)) == brute(long)


def test_products_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    # 4,300,000,000 occurrences of one pair: counts as a shard would hand them over.
    many = 4_300_000_000
    counts = spark.createDataFrame([("en", "a b", many), ("en", "a", many + 7), ("en", "b", many + 9), ("en", "", 3 * many)], "lang string, phrase string, f long")
    before, collocations.phrase_counts = collocations.phrase_counts, lambda *a, **b: counts.select("*", F.lit(1).alias("x")).drop("x")
    try:
        assert got(collocations.collocations(counts)) == [("en", 1, "a b", many, many + 7, many + 9, 3 * many, 10**6 * many * many // ((many + 7) * (many + 9)))]
    finally:
        collocations.phrase_counts = before


@pytest.mark.parametrize("longest", [1, 2, 3, 5])
def test_states_are_classes_of_equal_end_positions(longest):
    r = random.Random(longest)
    runs = [[r.randrange(4) for _ in range(r.randrange(1, 12))] for _ in range(40)]
    ids = np.asarray([x for run in runs for x in run])
    depth = np.asarray([min(k + 1, longest) for run in runs for k in range(len(run))])
    ends, at = defaultdict(set), 0
    for run in runs:
        for e in range(len(run)):
            for k in range(1, min(longest, e + 1) + 1):
                ends[tuple(run[e - k + 1 : e + 1])].add(at + e)
        at += len(run)
    found, classes = {}, Counter(map(frozenset, ends.values()))
    for length, end, shortest, count in collocations.PhraseAutomaton(ids, depth, longest).states():
        for e, low, n in zip(end.tolist(), shortest.tolist(), count.tolist()):
            phrases = [tuple(ids[e - k + 1 : e + 1].tolist()) for k in range(low, length + 1)]
            assert len({frozenset(ends[p]) for p in phrases}) == 1 and classes[frozenset(ends[phrases[0]])] == len(phrases)
            found |= dict.fromkeys(phrases, n)
    assert found == {p: len(e) for p, e in ends.items()}
