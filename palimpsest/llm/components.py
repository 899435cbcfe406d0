"""Connected components: local forests first, then one bounded task or alternating stars."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import written

SCHEMA = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def _forest(batches: Iterator[pa.RecordBatch], most_nodes: int | None = None) -> Iterator[pa.RecordBatch]:
    """(u, v) for every node u of the partition's edges with the smallest node v that they connect it to.

    With most_nodes, stars leave as soon as so many nodes are held: edges on both sides of such a cut meet only if
    another pass follows.
    """
    top: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while top.setdefault(root, root) != root:
            root = top[root]
        while top[x] != root:
            top[x], x = root, top[x]
        return root

    def out() -> Iterator[pa.RecordBatch]:
        # No list of all pairs: find changes no keys here, so the nodes are read where they lie.
        pairs = ((x, v) for x in top if (v := find(x)) != x)
        while part := list(islice(pairs, 50_000)):
            yield pa.RecordBatch.from_arrays([pa.array([p[j] for p in part], pa.int64()) for j in (0, 1)], schema=SCHEMA)
        top.clear()

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = find(a), find(b)
            top[max(a, b)] = min(a, b)
        if most_nodes is not None and len(top) > most_nodes:
            yield from out()
    yield from out()


def components(edges: DataFrame, most_rounds: int = 60, in_one_task: int = 500_000, most_nodes: int = 500_000) -> DataFrame:
    """(node, component) of every node in edges (a, b); component is the smallest node of its component.

    Each partition replaces its edges by a forest of stars, and holds most_nodes nodes at a time: what that cuts meets
    again in the next step. While the stars' counted edges are within in_one_task, one task joins them; nothing follows
    it, so it holds all its nodes at once (two for each edge at most). Beyond that, alternating stars do: each round
    joins every node's larger neighbours to its smallest neighbour, then its smaller ones; partial minima keep hubs
    cheap, and rounds go through written tables, so a lost executor costs one round.
    """
    local = written(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).where("u <> v").mapInArrow(partial(_forest, most_nodes=most_nodes), "u long, v long"))
    if local.count() <= in_one_task:
        return _named(written(local.repartition(1).mapInArrow(_forest, "u long, v long")))
    now = written(local.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    for _ in range(most_rounds):
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        after = written(small)
        # Done when every node has exactly one smaller neighbour, and that neighbour has none.
        same = after.count() == now.count() and after.join(now, ["u", "v"], "left_anti").isEmpty()
        now = after
        if same:
            return _named(now)
    raise RuntimeError("components did not settle")


def _named(stars: DataFrame) -> DataFrame:
    tops = stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).union(tops)
