"""Clashing names, very long texts, large groups of near copies, and second implementations of scores and tests."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import classifier, exact_dedup, jaccard_join, packing, secrets, sharding, substring_dedup
from tests.llm.fixtures import none, prose, rows
from tests.llm.test_similarity_operators import linked, without_repeats

NAMES = ["__file", "__row", "_metadata", "__text", "__assign", "__tokens", "__candidates", "__random", "places", "marks", "bits", "component"]


def clashing(spark, texts):
    return spark.createDataFrame(texts, "doc_id long, text string").withColumns({c: F.lit("x") for c in NAMES})


@pytest.mark.parametrize("names", [["__file"], NAMES])
def test_names_of_helpers_may_be_the_callers_own(spark, tmp_path, names):
    texts = [(1, "a b c d e f"), (2, "a b c d e f"), (3, "password = abcdefgh12 and more"), (3, "password = abcdefgh12 and more")]
    made = spark.createDataFrame(texts, "doc_id long, text string").withColumns({c: F.lit("x") for c in names})
    made.write.parquet(f"{tmp_path}/t")
    for docs in (made, spark.read.parquet(f"{tmp_path}/t")):
        out = exact_dedup.dedup_exact(docs).collect()
        assert Counter((r.doc_id, r.keep_id, r.group_size) for r in out) == Counter([(1, 1, 2), (2, 1, 2), (3, 3, 2), (3, 3, 2)])
        for kept in (exact_dedup.keep_unique(docs), jaccard_join.keep_representatives(docs)):
            assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3]
        clean = secrets.redacted(docs)
        assert clean.columns == docs.columns and {r.text for r in clean.collect()} == {"a b c d e f", "[secret] and more"}
        assert sorted(r.doc_id for r in substring_dedup.cut_repeats(docs).collect()) == [1, 2, 3, 3]


def test_very_long_texts(spark):
    words = prose(1, 20_000)
    long = " ".join(f"w{k * 7919 % 100_003}" for k in range(40_000))
    texts = [(1, long), (2, long + " tail"), (3, words), (4, words[:-3] + " one two three"), (5, "short text"), (6, long[:100_000] + " other " + words)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(docs, 4, 85).collect())
    assert got == linked(texts, 4, 85)
    out = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in substring_dedup.cut_repeats(docs).collect())
    assert out == without_repeats(texts, 200)
    assert secrets.find_secrets(docs).count() == 6
    scores = {r.doc_id: r.score for r in classifier.score(docs, (np.zeros(classifier.BUCKETS + 2, np.float32), 0.5)).collect()}
    assert set(np.round(list(scores.values()), 9)) == {round(1 / (1 + math.exp(-0.5)), 9)}


def test_a_large_group_of_near_copies(spark):
    r, base = random.Random(9), prose(2, 120).split()
    texts = []
    for k in range(3000):
        w = list(base)
        w[r.randrange(len(w))] = f"edit{k}"
        texts.append((k, " ".join(w)))
    docs = spark.createDataFrame(texts + [(9000, prose(77, 100))], "doc_id long, text string")
    names = {x.doc_id: x.component_id for x in jaccard_join.near_duplicates(docs, 4, 85, early=1).collect()}
    assert names == dict.fromkeys(range(3000), 0) | {9000: 9000}


@pytest.mark.parametrize("percent", [50, 85])
def test_parities_never_rule_out_a_link(spark, percent):
    r = np.random.default_rng(3)
    pairs = []
    for n in (3, 900, 1024, 1025, 5000, 9000):
        a = r.integers(0, 1 << 63, n).astype(np.uint64)
        cut = int(n * r.uniform(0, (100 - percent) / 100))
        b = np.concatenate((a[cut:], r.integers(0, 1 << 63, int(0.5 * cut)).astype(np.uint64)))
        pairs.append((n + len(b), int(len(np.setxor1d(a, b))), jaccard_join._parity(a), jaccard_join._parity(b)))
    df = spark.createDataFrame(pairs, "n long, differ long, x array<long>, y array<long>")
    for row in df.select("differ", jaccard_join._apart(F.col("x"), F.col("y")).alias("apart")).collect():
        assert row.apart <= row.differ


def plain_features(text):
    """Features of one text, found one by one."""
    data = b"   " + (text or "").encode() + b"   "
    white = lambda c: c in b" \t\n\x0b\f\r"
    mix = lambda x: int(classifier.mix(np.asarray([x & (1 << 64) - 1], np.uint64))[0])
    size = classifier.BUCKETS
    found = [mix(int.from_bytes((data[k : k + 4] + b"    ")[:4], "little")) % (size // 2) for k in range(len(data)) if not any(white(c) for c in (data + b"    ")[k + 1 : k + 3])]
    words, seen = [], set()
    for m in re.finditer(rb"[^ \t\n\x0b\f\r]+", data):
        first, last = (data + b"    ")[m.start() : m.start() + 4], (data + b"    ")[max(0, m.end() - 4) :][:4]
        edge = int.from_bytes(first, "little") << 32 | int.from_bytes(last, "little")
        words.append(mix(sum(int(classifier._byte[c]) for c in m[0]) + mix(edge) + len(m[0])) % (size // 4) + size // 2)
    for a, b in zip(words, words[1:]):
        found += [mix(a * size + b) % (size // 4) + 3 * size // 4, size + ((a, b) in seen)]
        seen.add((a, b))
    return Counter(found + words)


def test_features_and_scores_by_a_second_implementation(spark):
    texts = [t for _, t, *_ in rows() if t is None or len(t) < 3000]
    weights = np.random.default_rng(1).normal(size=classifier.BUCKETS + 2).astype(np.float32)
    want = []
    for t in texts:
        f = plain_features(t)
        logit = sum(float(weights[k]) * c for k, c in f.items()) / max(1, sum(f.values())) + 0.25
        want.append(1 / (1 + math.exp(-logit)))
    alone = [1 / (1 + np.exp(-classifier.logits([t], weights, 0.25)[0])) for t in texts]
    assert np.allclose(alone, want)
    numbered = list(enumerate(texts))
    for order in (numbered, numbered[::-1]):
        docs = spark.createDataFrame(order, "doc_id long, text string").coalesce(1)
        got = {r.doc_id: r.score for r in classifier.score(docs, (weights, 0.25)).collect()}
        assert [got[k] for k in range(len(texts))] == alone  # whatever the neighbours


def test_training_sample_is_bounded_in_bytes(spark):
    docs = spark.createDataFrame([(k, prose(k, 30)) for k in range(50)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(50)], "doc_id long, quality int")
    a, b = classifier.fit(docs, labels, most=50), classifier.fit(docs, labels, most=50, most_bytes=500)
    assert not np.array_equal(a[0], b[0])
    assert classifier.fit(docs, labels, most_bytes=0)[1] == 0.0


def test_the_classifiers_step_is_the_gradient():
    r = np.random.default_rng(2)
    vectors, out, bias, share = r.normal(size=(5, 3)), r.normal(size=(3, 2)), r.normal(size=2), r.dirichlet(np.ones(5))
    _, *found = classifier.gradient(vectors, out, bias, share, 1)
    for part, got in zip((vectors, out, bias), found):
        for place in np.ndindex(part.shape):
            sides = []
            for step in (1e-6, -1e-6):
                part[place] += step
                sides.append(classifier.gradient(vectors, out, bias, share, 1)[0])
                part[place] -= step
            assert math.isclose((sides[0] - sides[1]) / 2e-6, got[place], rel_tol=1e-5, abs_tol=1e-8)
    none = classifier.gradient(np.zeros((0, 3)), out, bias, np.zeros(0), 0)
    assert none[1].shape == (0, 3) and math.isfinite(none[0])


def plain_battery(token):
    """(encoding, n, p) of a token, by numpy."""
    body = token.rstrip("=")
    encoding, alphabet = next((e, a) for e, (p, a) in secrets.ENCODINGS.items() if re.fullmatch(p, body))
    tail = lambda z: 1 / (1 + math.exp(min(700, max(-700, 1.5976 * z + 0.070565992 * z**3))))
    x = np.asarray([max(0, alphabet.find(c)) for c in body], float)
    n, k = len(x), len(alphabet)
    chi = k / n * (np.bincount(x.astype(int), minlength=k) ** 2).sum() - n
    z1 = (np.cbrt(max(0.0, chi / (k - 1))) - (1 - 2 / (9 * (k - 1)))) / math.sqrt(2 / (9 * (k - 1)))
    kind = lambda c: 0 if c.isupper() else 1 if c.islower() else 2 if c.isdigit() else 3
    kinds, share = [kind(c) for c in body], [sum(kind(c) == j for c in alphabet) / k for j in range(4)]
    if 1.0 in share:  # one kind: halves
        kinds, share = list(x > (k - 1) / 2), [0.5, 0.5]
    change = 1 - sum(p * p for p in share)
    spread = (n - 1) * change * (1 - change) + 2 * (n - 2) * (sum(p * (1 - p) ** 2 for p in share) - change**2)
    z2 = abs(sum(a != b for a, b in zip(kinds, kinds[1:])) - (n - 1) * change) / math.sqrt(spread)
    centred = x - (k - 1) / 2
    z3 = abs((centred[1:] * centred[:-1]).sum() / ((k * k - 1) / 12)) / math.sqrt(n - 1)
    return encoding, n, min(1.0, 3 * min(tail(z1), 2 * tail(z2), 2 * tail(z3)))


def test_battery_by_a_second_implementation(spark):
    r = random.Random(11)
    tokens = ["".join(r.choice(a) for _ in range(n)) for _, a in secrets.ENCODINGS.values() for n in (20, 33, 64, 200)] + ["a" * 40 + "1", "0123456789" * 3, "abc1" * 9 + "=="]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(tokens)], "k int, t string")
    for row in df.select("k", secrets._battery(F.col("t")).alias("b")).collect():
        encoding, n, p = plain_battery(tokens[row.k])
        assert (row.b.encoding, row.b.n) == (encoding, n) and math.isclose(row.b.p, p, rel_tol=1e-6, abs_tol=1e-12)


def plain_thresholds(found, fdr, least):
    strata = {}
    for encoding, n, p in found:
        strata.setdefault((encoding, min(8, n // 8)), []).append(p)
    text = lambda ps: sum(p < 0.01 for p in ps)
    out = {}
    for (encoding, length), own in strata.items():
        pool = own
        if text(pool) < least:
            pool = [p for (_, x), v in strata.items() if x == length for p in v]
        if text(pool) < least:
            pool = [p for v in strata.values() for p in v]
        scale = 1 if pool is own else len(own) / max(1, text(pool))
        third, second = sum(1e-4 <= p < 1e-3 for p in pool), sum(1e-3 <= p < 0.01 for p in pool)
        second = min(second, third)
        q = second / third if third else 0
        for g in secrets.GRID:
            above = sum(g <= p < 0.001 for p in pool) + second + second * (q + q * q) if g < 0.01 else second * q * (1 + q) * q ** math.log10(g / 0.01)
            if any(p >= g for p in own) and scale * above <= fdr * sum(p >= g for p in own) + 1e-12:
                out[f"{encoding}/{length}"] = g
                break
    return out


def test_thresholds_by_a_second_implementation(spark):
    r = random.Random(12)
    letters = secrets.ENCODINGS["base64"][1]
    tokens = ["".join(r.choice(letters) for _ in range(r.choice([24, 40, 41]))) + "a1B" for _ in range(150)] + ["".join(r.choice(["the", "Ing", "an"]) for _ in range(12)) + "1" for _ in range(50)]
    docs = spark.createDataFrame([(k, f"x {t} y") for k, t in enumerate(tokens)], "doc_id long, text string")
    for least in (1, 20, 120, 10_000):
        assert secrets.thresholds(secrets.scan(docs), 0.05, least) == plain_thresholds([plain_battery(t) for t in tokens], 0.05, least)


def planted(seed, words=4000):
    """(tokens of words and numbers, a random token of each encoding and length)."""
    r = random.Random(seed)
    syllables = ["an", "the", "tion", "or", "re", "st", "ou", "ing", "er", "ent", "al", "ic", "us", "pro", "con", "ver"]
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))
    text = []
    for k in range(words):
        parts = [[word(), word().title(), word().upper(), str(r.randrange(1990, 2030)), f"{r.randrange(1000):04d}"][r.randrange(5)] for _ in range(12)]
        token = "".join(x + r.choice(["", "", "-", "_", "/"]) for x in parts)[: r.choice([20, 24, 33, 42, 70])]
        text.append(token if re.search("[0-9]", token) else token + "2024")
    return text, [(e, n, "".join(r.choice(a) for _ in range(n))) for e, (_, a) in secrets.ENCODINGS.items() for n in (24, 33, 42, 64, 80) if e != "hex" or n < 32]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_one_random_token_of_each_kind_is_found_among_thousands_of_words(spark, seed):
    text, hidden = planted(seed)
    rows = [(k, f"see {t} there") for k, t in enumerate([*text, *(t for _, _, t in hidden)])]
    found = {x.doc_id: x.n_random + x.n_hex for x in secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    long = [found[len(text) + k] for k, (_, n, _) in enumerate(hidden) if n >= 33]  # shorter ones are too like words
    assert sum(long) >= 0.85 * len(long) and sum(found[k] for k in range(len(text))) <= 0.05 * sum(long) + 1


def test_many_matches_in_one_text_and_long_hosts_take_linear_time(spark):
    import time

    from palimpsest.llm import url_filters

    text = "".join(f"token = abcdefgh{k:06d} xY1{'q' * 20}{k % 7} " for k in range(30_000))
    df = spark.createDataFrame([(1, text), (2, "short")], "doc_id long, text string")
    secrets.find_secrets(df.limit(1)).count()  # compiled
    began = time.time()
    assert [r.n_assign for r in secrets.find_secrets(df).orderBy("doc_id").collect()] == [30_000, 0]
    clean = secrets.redacted(df).where("doc_id = 1").first().text
    assert clean.count("[secret]") >= 30_000 and "abcdefgh" not in clean
    host = ".".join(["a"] * 100_000)
    pages = spark.createDataFrame([(1, f"http://{host}.net/x"), (2, f"http://{host}.example.com/de/1"), (3, "http://" + host), (4, None)], "page_id long, url string")
    rules = spark.createDataFrame(url_filters.RULES, "verdict string, host string, path string")
    assert {r.page_id: r.verdict for r in url_filters.filter_urls(pages, rules).collect()} == {1: "block", 2: "block", 3: "allow", 4: "allow"}
    assert time.time() - began < 100  # hours, where each match copies the ones before


def test_packing_splits_a_row_that_is_repeated_often(spark):
    import public_tokenizers

    docs = spark.createDataFrame([(1, "the same row again")], "doc_id long, text string").crossJoin(spark.range(4000)).select("doc_id", "text")
    out = packing.pack(packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json")), in_a_partition=500)
    dealt = Counter(r.sequence_id >> 32 for r in out.collect())
    assert sum(dealt.values()) == 4000 and max(dealt.values()) < 1000


def test_sharding_query_columns(spark, tmp_path):
    spark.createDataFrame([(k, f"text {k}") for k in range(200)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = sharding.op1_sharding(spark, str(tmp_path)).collect()
    assert {r.law for r in out} == {"bytes"} and {r.grown_shard for r in out} == {None} and {r.shard for r in out} == set(range(16))


def test_pipeline_on_awkward_tables(spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    import corpus_pipeline

    secret = "d48fd8e940a86f41832370bc4dd81bc9d95bf72b"
    texts = [(1, prose(1, 80) + f' token = "{secret}" ' + prose(2, 40)), (2, prose(3, 120)), (3, None), (None, prose(3, 120))]
    for k, docs in enumerate((clashing(spark, texts), none(spark))):
        docs.write.parquet(f"{tmp_path}/{k}/documents.parquet")
    out = corpus_pipeline.run(spark, f"{tmp_path}/0").collect()
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    import zlib

    want = Counter()
    for d, x in ((1, prose(1, 80) + ' [secret]" ' + prose(2, 40)), (2, texts[1][1])):
        ids = [*t.encode(x, add_special_tokens=False).ids, 0]
        want[d, 0, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))] += 1
    assert Counter((r.doc_id, r.piece, r.length, r.ids_crc32) for r in out) == want
    assert corpus_pipeline.run(spark, f"{tmp_path}/1").count() == 0
