"""Quality classifier from supervised subword embeddings, trained by numpy stochastic gradient descent.

Features of a text are its words, its character 4-grams inside words (with the white space on either side as a
border), and its pairs of adjacent words. Each kind is hashed into a range of ``buckets`` of its own, and each bucket
has a learned vector. Two more tokens stand beside every word pair, one where the text has not had the pair before and
one where it has: hashed pairs alone cannot tell a text that repeats itself, since each repeats its own words. A document's vector is the average of its features' vectors; a softmax over two outputs follows.
Both layers are trained together by stochastic gradient descent. The step of a feature's vector is the gradient's
direction with the feature's count (at most 1) in the place of its share of the text: an average over hundreds of
features would hardly move any.

The training sample is bounded by parameters: the ``most`` labelled training rows with the smallest hash of doc_id,
as far as their texts are ``most_bytes`` in all. Training runs in one task, whose memory these bounds limit; the model
that comes back has a fixed size. Scoring sends every row, whole, through the model where it lies; a row's score depends
on its text alone.

Only the text is an input. Held out are rows whose crc32 of doc_id as text is 0 modulo 5; their labels are never
read in training. A null or empty text has no features and gets the score of the bias alone. A doc_id that is
labelled several times counts once, with its highest label; labels that are null are left out; without any label
every score is one half. A doc_id that several rows have is trained on once, with the least of its texts. Repeated
rows get equal scores. An empty table has no scores. Further columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.arrow import map_batches
from palimpsest.llm.common import table
from palimpsest.llm.shingles import in_chunks, mix

_byte = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
BUCKETS, DIMENSIONS, LONGER = 1 << 18, 12, 200.0
_white = np.zeros(256, bool)
_white[[0x20, 9, 10, 11, 12, 13]] = True


def features(texts: list[str | None], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """All features of all texts, one text after another, and the end of each text's features."""
    coded = [b"   " + (t or "").encode("utf-8", "surrogatepass") + b"   " for t in texts]  # no gram reaches another text
    data = np.frombuffer(b"".join([*coded, b"    "]), np.uint8)
    white, n = _white[data], len(data) - 3
    wide = data.astype(np.uint32)
    gram = wide[:n] | wide[1 : n + 1] << 8 | wide[2 : n + 2] << 16 | wide[3 : n + 3] << 24
    inner = np.flatnonzero(~(white[1 : n + 1] | white[2 : n + 2]))  # borders may be white, the middle not
    grams = mix(gram[inner].astype(np.uint64)) % np.uint64(buckets // 2)
    start = np.flatnonzero(white[:-1] & ~white[1:]) + 1
    stop = np.flatnonzero(~white[:-1] & white[1:]) + 1
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_byte[data])))
    # A word is hashed by its bytes' mixed sum, its first and last grams and its length.
    edge = gram[np.minimum(start, n - 1)].astype(np.uint64) << np.uint64(32) | gram[np.maximum(stop - 4, 0)].astype(np.uint64)
    words = mix(total[stop] - total[start] + mix(edge) + (stop - start).astype(np.uint64)) % np.uint64(buckets // 4) + np.uint64(buckets // 2)
    ends = np.cumsum([len(c) for c in coded])
    # Words of one text are neighbours; a pair never crosses a text's end.
    text = np.searchsorted(ends, start, "right")
    second = np.flatnonzero(text[1:] == text[:-1]) + 1
    pairs = mix(words[second - 1] * np.uint64(buckets) + words[second]) % np.uint64(buckets // 4) + np.uint64(3 * buckets // 4)
    again = np.full(len(second), buckets + 1, np.uint64)
    again[np.unique(mix(words[second - 1] * np.uint64(buckets) + words[second] + (text[second].astype(np.uint64) << np.uint64(40))), return_index=True)[1]] = buckets
    place = np.concatenate((inner, start, start[second], start[second]))
    order = np.argsort(place, kind="stable")
    return np.concatenate((grams, words, pairs, again))[order].astype(np.int64), np.searchsorted(place[order], ends)


def gradient(vectors: np.ndarray, out: np.ndarray, bias: np.ndarray, share: np.ndarray, label: int) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """(loss, gradients of a document's vectors, of the output weights and of the biases); share: each feature's part of the document."""
    mean = share @ vectors
    logits = mean @ out + bias
    p = np.exp(logits - logits.max())
    p /= p.sum()
    error = p.copy()
    error[label] -= 1
    return -float(np.log(max(p[label], 1e-30))), np.outer(share, out @ error), np.outer(mean, error), error


def train(texts: list[str | None], labels: list[int], epochs: int = 6, rate: float = 0.5, seed: int = 5, buckets: int = BUCKETS, dimensions: int = DIMENSIONS) -> tuple[np.ndarray, float]:
    """(weight of each feature, bias): a document's logit is the mean weight of its features plus the bias."""
    rng = np.random.default_rng(seed)
    rows = []
    for a, b in in_chunks(texts):
        found, ends = features(texts[a:b], buckets)
        for k, (lo, hi) in enumerate(zip(np.concatenate(([0], ends[:-1])), ends)):
            ids, counts = np.unique(found[lo:hi], return_counts=True)
            rows.append((ids.astype(np.int32), (counts / max(1, hi - lo)).astype(np.float32), labels[a + k]))
    vectors = rng.uniform(-1 / dimensions, 1 / dimensions, (buckets + 2, dimensions)).astype(np.float32)
    out, bias = np.zeros((dimensions, 2), np.float32), np.zeros(2, np.float32)
    steps, done = epochs * max(1, len(rows)), 0
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            ids, share, label = rows[k]
            lr = rate * (1 - done / steps)
            done += 1
            _, by_vector, by_weight, by_bias = gradient(vectors[ids], out, bias, share, label)
            # A feature is a small part of a document, so vectors take longer steps.
            vectors[ids] -= LONGER * lr * by_vector
            out -= lr * by_weight
            bias -= 0.1 * lr * by_bias
    side = out[:, 1] - out[:, 0]
    return (vectors @ side).astype(np.float32), float(bias[1] - bias[0])


def held_out(column: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, most: int = 6000, most_bytes: int = 64 << 20) -> tuple[np.ndarray, float]:
    """The model, from at most ``most`` labelled doc_ids that are not held out, and at most ``most_bytes`` of their texts."""
    pool = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("quality").cast("int").alias("label"))
    chosen = pool.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    # One row for each sampled doc_id, so that copies of a row take no other's place.
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label"))
    schema = pa.schema([("weights", pa.binary()), ("bias", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, labels, left = [], [], most_bytes
        for batch in batches:
            for text, label in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                left -= len((text or "").encode("utf-8", "surrogatepass"))
                if left < 0:
                    break
                texts.append(text)
                labels.append(label)
        if texts:
            weights, bias = train(texts, labels)
            yield pa.RecordBatch.from_arrays([pa.array([weights.tobytes()], pa.binary()), pa.array([bias])], schema=schema)

    ordered = rows.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id")
    model = ordered.select("doc_id", "text", "label").mapInArrow(run, "weights binary, bias double").collect()
    return (np.frombuffer(model[0]["weights"], np.float32), model[0]["bias"]) if model else (np.zeros(BUCKETS + 2, np.float32), 0.0)


def logits(texts: list[str | None], weights: np.ndarray, bias: float) -> np.ndarray:
    """Each text's mean weight of its features plus the bias; each text is summed by itself."""
    found, ends = features(texts)
    begin = np.concatenate(([0], ends[:-1]))
    total, full = np.zeros(len(texts)), np.flatnonzero(ends > begin)
    if len(full):
        total[full] = np.add.reduceat(weights[found].astype(np.float64), begin[full])
    return total / np.maximum(1, ends - begin) + bias


def score(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """doc_id and score (0 to 1) of every row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # fixed size: one number for each bucket

    def make():
        weights, bias = shared.value

        def call(batch: pa.RecordBatch) -> list:
            texts, out = batch.column(1).to_pylist(), []
            for a, b in in_chunks(texts, 1 << 19):
                logit = logits(texts[a:b], weights, bias)
                out += (1 / (1 + np.exp(-np.clip(logit, -500, 500)))).tolist()
            return [batch.column(0), out]

        return call

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), "doc_id long, score double", make)


def op8_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality score."""
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
