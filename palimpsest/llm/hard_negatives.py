"""Hard negatives for contrastive training: exact top-k by inner product, pruned after an orthogonal rotation.

A row's components become integers, floor(scale * x). Scores are integer inner products; higher ones come first, ties by
smaller vec_id. An anchor's positives are its first rows of the same label; the negatives of an anchor and a positive are
the first rows of other labels whose score lies in a range of percentages of the positive's.

1. The rotation has the principal axes of all rows, from sums of products that are added up by Spark. Any rotation keeps
   inner products; this one puts most of each in few leading components.
2. Anchors are taken in rounds of bounded bytes; each round's anchors are broadcast and all rows stream past them, in
   tiles of one label. A tile's products are accumulated over leading components, stage by stage. What is left of a
   product is at most the product of both rows' residual norms, plus a slack for rounding in proportion to their norms;
   pairs that cannot reach an anchor's k-th best score so far (or its range) are discarded before the next stage.
   Thresholds begin with the anchors' scores among themselves.
3. Survivors are verified by integer products. Each task gives every anchor's best rows, which a window merges.

Rows with a null label, vec_id or vector, or a null or non-finite component take no part. Shorter vectors count as filled
up with zeros. Every row is a row of its own, repeated ones too, and no row is its own positive. Scores are
computed exactly at any size; one beyond 64 bits counts as the nearest long. An empty table gives an empty result. Further columns, whatever their
names, are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import FILE, ROW, located, maybe_broadcast, shared_dir, table, written

LEAST, MOST = -(1 << 63) + 1, (1 << 63) - 1
#: Shares of the squared length that the stages' leading components hold.
STAGES = (0.6, 0.9)
TILE = 1024


def _matrix(lists: pa.Array, width: int, scale: int) -> np.ndarray:
    """floor(scale * x) of vectors as rows of width columns."""
    lengths = np.diff(lists.offsets.to_numpy())
    flat = np.floor(lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)
    if len(lengths) and (lengths == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(lengths), width))
    out[np.repeat(np.arange(len(lengths)), lengths), np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


class Rows:
    """Integer vectors with their rotation, the residual norms after each stage, and a slack for rounding."""

    def __init__(self, ids, labels, files, places, vectors: np.ndarray, axes: np.ndarray, stages: list[int]):
        self.ids, self.labels, self.files, self.places, self.vectors = ids, labels, files, places, vectors
        with np.errstate(all="ignore"):
            self.turned = vectors @ axes
            self.norm = np.sqrt((vectors * vectors).sum(1))
            self.rest = [np.sqrt((self.turned[:, m:] ** 2).sum(1)) for m in stages]

    @classmethod
    def of(cls, batch: pa.RecordBatch, axes: np.ndarray, stages: list[int], scale: int) -> Rows:
        ids, labels, files, places = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(4))
        return cls(ids, labels, files, places, _matrix(batch.column(4), len(axes), scale), axes, stages)


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of the rows of a and b, as longs."""
    size = a.shape[1] * max(1.0, np.abs(a).max(initial=0)) * max(1.0, np.abs(b).max(initial=0))
    if size < 2**62:
        return (a.astype(np.int64) * b.astype(np.int64)).sum(1)
    sums = (sum(int(p) * int(q) for p, q in zip(x, y)) for x, y in zip(a.tolist(), b.tolist()))
    return np.asarray([min(max(x, LEAST), MOST) for x in sums], np.int64)


def near(anchors: Rows, rows: Rows, some: np.ndarray, others: np.ndarray, low: np.ndarray, high: np.ndarray, stages: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, row, score) of all pairs of some anchors and others (rows) with low[anchor] <= score <= high[anchor]."""
    found = [(np.zeros(0, np.int64),) * 3]
    slack = 8 * (rows.vectors.shape[1] + 8) * np.finfo(float).eps
    for a in range(0, len(some), TILE):
        mine = some[a : a + TILE]
        for b in range(0, len(others), TILE):
            theirs, m = others[b : b + TILE], stages[0]
            with np.errstate(all="ignore"):
                part = anchors.turned[mine, :m] @ rows.turned[theirs, :m].T
                left = np.outer(anchors.rest[0][mine], rows.rest[0][theirs]) * (1 + slack) + slack * np.outer(anchors.norm[mine], rows.norm[theirs])
                # Written so that a sum that is no number stays.
                i, j = np.nonzero(~((part + left < low[mine, None]) | (part - left > high[mine, None])))
                part, i, j = part[i, j], mine[i], theirs[j]
                for k in range(1, len(stages)):
                    part = part + (anchors.turned[i, m : stages[k]] * rows.turned[j, m : stages[k]]).sum(1)
                    m = stages[k]
                    left = anchors.rest[k][i] * rows.rest[k][j] * (1 + slack) + slack * anchors.norm[i] * rows.norm[j]
                    ok = ~((part + left < low[i]) | (part - left > high[i]))
                    part, i, j = part[ok], i[ok], j[ok]
            for c in range(0, len(i), 1 << 16):
                x, y = i[c : c + (1 << 16)], j[c : c + (1 << 16)]
                found.append((x, y, exact(anchors.vectors[x], rows.vectors[y])))
    return tuple(np.concatenate(x) for x in zip(*found))


class Best:
    """The k best (score, vec_id) of each group; floor: the score that a newcomer needs."""

    def __init__(self, groups: int, k: int):
        self.k, self.floor = k, np.full(groups, LEAST)
        self.group = self.score = self.ids = np.zeros(0, np.int64)

    def add(self, group: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        ok = score >= self.floor[group]
        group, score, ids = (np.concatenate((x, y[ok])) for x, y in ((self.group, group), (self.score, score), (self.ids, ids)))
        order = np.lexsort((ids, -score, group))
        group, score, ids = group[order], score[order], ids[order]
        head = np.flatnonzero(np.diff(group, prepend=-1))
        rank = np.arange(len(group)) - np.repeat(head, np.diff(np.append(head, len(group))))
        last = rank == self.k - 1
        self.floor[group[last]] = np.maximum(self.floor[group[last]], score[last])
        self.group, self.score, self.ids = (x[rank < self.k] for x in (group, score, ids))

    def seeded(self) -> Best:
        """Only the thresholds of what has been added."""
        out = Best(len(self.floor), self.k)
        out.floor = self.floor
        return out


def _by_label(labels: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    for x in np.unique(labels).tolist():
        yield x, np.flatnonzero(labels == x)


def _positives(anchors: Rows, rows: Rows, best: Best, stages: list[int]) -> None:
    none = np.full(len(anchors.ids), np.inf)
    for label, others in _by_label(rows.labels):
        i, j, score = near(anchors, rows, np.flatnonzero(anchors.labels == label), others, best.floor.astype(float), none, stages)
        ok = (anchors.files[i] != rows.files[j]) | (anchors.places[i] != rows.places[j])
        best.add(i[ok], score[ok], rows.ids[j[ok]])


def _negatives(anchors: Rows, rows: Rows, best: Best, stages: list[int], lows: np.ndarray, highs: np.ndarray) -> None:
    """lows, highs: the ranges of each anchor's positives; a group is an anchor's positive."""
    width = lows.shape[1]
    for label, others in _by_label(rows.labels):
        need = np.maximum(lows, best.floor.reshape(-1, width))
        some = np.flatnonzero((anchors.labels != label) & (need <= highs).any(1))
        low, high = np.where(need <= highs, need.astype(float), np.inf).min(1), np.where(need <= highs, highs.astype(float), -np.inf).max(1)
        i, j, score = near(anchors, rows, some, others, low, high, stages)
        for k in range(width):
            ok = (score >= lows[i, k]) & (score <= highs[i, k])
            best.add(i[ok] * width + k, score[ok], rows.ids[j[ok]])


def _searched(anchors, axes: np.ndarray, stages: list[int], scale: int, groups: int, k: int, look: Callable) -> Callable:
    """A function of Arrow batches that gives (group, id, score): each group's k best of a task's rows."""
    schema = pa.schema([("group", pa.int64()), ("id", pa.int64()), ("score", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, options = anchors.value
        best = Best(groups, k)
        look(own, own, best, stages, *options)
        best = best.seeded()
        for batch in batches:
            for a in range(0, batch.num_rows, 4 * TILE):
                look(own, Rows.of(batch.slice(a, 4 * TILE), axes, stages, scale), best, stages, *options)
        for a in range(0, len(best.ids), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(x[a : a + 50_000]) for x in (best.group, best.ids, best.score)], schema=schema)

    return run


def principal_axes(rows: DataFrame, width: int, scale: int) -> tuple[np.ndarray, list[int]]:
    """Axes as columns, by falling share of the squared length, and the numbers of leading ones of each stage."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            x = _matrix(batch.column(4), width, scale)
            x = x / np.maximum(np.abs(x).max(1, keepdims=True), 1)  # of equal size, so that no square is infinite
            total += x.T @ x
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel()), pa.array(j.ravel()), pa.array(total.ravel())], names=["i", "j", "x"])

    moments = np.zeros((width, width))
    # width * width sums, however many rows there are.
    for r in rows.mapInArrow(run, "i long, j long, x double").groupBy("i", "j").agg(F.sum("x").alias("x")).collect():
        moments[r.i, r.j] = r.x
    values, axes = np.linalg.eigh(moments)
    share = np.cumsum(np.maximum(values[::-1], 0)) / max(np.maximum(values, 0).sum(), 1e-300)
    return np.ascontiguousarray(axes[:, ::-1]), sorted({min(int(np.searchsorted(share, x)) + 1, width) for x in STAGES})


def _percent(x: np.ndarray, percent: int) -> np.ndarray:
    """floor(percent * x / 100) without overflow."""
    return x // 100 * percent + x % 100 * percent // 100


def hard_negatives(vectors: DataFrame, is_anchor: Column, scale: int = 256, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, round_bytes: int = 32 << 20) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score; vectors: vec_id, label, embedding.

    A negative's score is at least low and at most high percent of the positive's.
    """
    spark = vectors.sparkSession
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = located(vectors).where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & sound)
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), FILE, ROW, F.col("embedding").cast("array<double>").alias("embedding"), is_anchor.alias("anchor"))
    anchors = written(rows.where("anchor"))
    rows = rows.drop("anchor")
    width = max(1, rows.agg(F.max(F.size("embedding"))).first()[0] or 1)
    axes, stages = principal_axes(rows, width, scale)
    rounds = math.ceil(anchors.count() * (16 * width + 64) / round_bytes)
    path = shared_dir(spark)
    top = lambda df, k: df.withColumn("rank", F.row_number().over(Window.partitionBy("group").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)
    search = lambda own, groups, k, look: rows.mapInArrow(_searched(own, axes, stages, scale, groups, k, look), "group long, id long, score long")
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    spark.createDataFrame([], schema).write.parquet(f"{path}/round=-1")
    for number in range(rounds):
        # A round's anchors, and their positives, are bounded by round_bytes.
        block = anchors.where(F.pmod(F.xxhash64(FILE, ROW), F.lit(rounds)) == number).drop("anchor").toArrow().combine_chunks()
        if not block.num_rows:
            continue
        own = Rows.of(block.to_batches()[0], axes, stages, scale)
        found = written(top(search(spark.sparkContext.broadcast((own, ())), len(own.ids), positives, _positives), positives))
        near_by = found.toArrow()
        group, slot, score = (near_by.column(x).to_numpy() for x in ("group", "rank", "score"))
        lows, highs = np.full((len(own.ids), positives), MOST), np.full((len(own.ids), positives), LEAST)
        lows[group, slot - 1], highs[group, slot - 1] = -_percent(-score, low), _percent(score, high)
        least = search(spark.sparkContext.broadcast((own, (lows, highs))), len(own.ids) * positives, negatives, _negatives)
        names = spark.createDataFrame(pa.table({"anchor": np.arange(len(own.ids)), "anchor_id": own.ids}))
        of = found.join(maybe_broadcast(names, 16), found["group"] == names["anchor"])
        of = of.select((F.col("group") * positives + F.col("rank") - 1).alias("group"), "anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
        out = top(least, negatives).join(maybe_broadcast(of, 32), "group")
        out.select("anchor_id", "positive_id", F.col("rank").cast("int"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")).write.parquet(f"{path}/round={number}")
    return spark.read.schema(schema).option("basePath", path).parquet(f"{path}/*").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three negatives for each of five positives of every 50th vector."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(located(table(spark, sf_dir, "embeddings")).withColumn("label", label), F.col("vec_id") % 50 == 0)


OP13_SQL = """
WITH sound AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, embedding FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), v AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM sound),
scores AS (
  SELECT a.vec_id AS anchor, a.label = b.label AS same, b.vec_id AS other, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
), positives AS (SELECT * FROM scores WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, other) <= 5)
SELECT p.anchor AS anchor_id, p.other AS positive_id, CAST(row_number() OVER (PARTITION BY p.anchor, p.other ORDER BY s.score DESC, s.other) AS INTEGER) AS rank,
  s.other AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM positives p JOIN scores s ON s.anchor = p.anchor AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
QUALIFY rank <= 3
"""
