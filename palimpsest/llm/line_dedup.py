"""Removal of lines that many documents share, by sharded minimal perfect hashes.

A line's key is the line without white space at its ends, A-Z lower-cased. Keys of at least ``min_chars`` code points that
are found in at least ``least`` documents lose all their lines, except in the document of the largest doc_id among them.

1. Each document's distinct keys are hashed to 128 bits; counts of documents and the largest doc_id are added up by hash,
   with partial sums before the shuffle.
2. Distinct line hashes of more than one document (no other line can go) are dealt into shards by hash. A task turns each
   shard into a minimal perfect hash: levels of bits in which every line has a place of its own, whose rank is its slot,
   with arrays of 64-bit fingerprints, counts of documents and largest doc_ids by slot. A shard has bounded bytes, and the
   number of shards grows with the lines.
3. Documents send the hashes of their lines to the shards, which look them up in the arrays, a batch at a time; lines are
   not joined. A shard with frequent lines is copied: the number of its copies follows from the counts that it
   holds, and documents are dealt among them, so a line that is in every document burdens no single task.
4. The places of the lines to drop return to their documents, which are cut in one pass.

Lines are counted by 128 bits; one that is in no index is told apart by its slot's fingerprint of 64 bits. Every row is a
document, repeated rows too; rows of the same doc_id keep a line together. A null doc_id is below all others. Null and
empty texts have one empty line. Texts of any length are read whole. An empty table gives an empty result. Further
columns, whatever their names, are not read.
"""

from __future__ import annotations

import math
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.arrow import map_batches
from palimpsest.llm.common import FILE, ROW, WHITE, forget, located, maybe_broadcast, table, text_or_empty, written
from palimpsest.llm.shingles import mix

#: Bits for each line that a level still has to place.
ROOM = 2.0
NOBODY = -(1 << 63)


def _place(h1: np.ndarray, h2: np.ndarray, level: int, bits: int) -> np.ndarray:
    turn = np.uint64((level * 0x9E3779B97F4A7C15 + 0x632BE5AB) & (1 << 64) - 1)
    return (mix(h1 ^ mix(h2 + turn)) % np.uint64(bits)).astype(np.int64)


class LineIndex:
    """A minimal perfect hash of distinct (h1, h2), with fingerprint, documents and keeper in arrays by slot."""

    def __init__(self, levels: list[np.ndarray], fingerprint: np.ndarray, documents: np.ndarray, keeper: np.ndarray):
        self.levels, self.fingerprint, self.documents, self.keeper = levels, fingerprint, documents, keeper
        at, self.before = 0, []
        for words in levels:
            ones = np.cumsum(np.bitwise_count(words), dtype=np.int64)
            self.before.append(at + np.concatenate(([0], ones[:-1])))
            at += int(ones[-1])

    @classmethod
    def build(cls, h1: np.ndarray, h2: np.ndarray, documents: np.ndarray, keeper: np.ndarray) -> LineIndex:
        left, levels, order = np.arange(len(h1)), [], []
        while len(left):
            bits = max(64, 64 * math.ceil(ROOM * len(left) / 64))
            at = _place(h1[left], h2[left], len(levels), bits)
            alone = np.bincount(at, minlength=bits) == 1
            levels.append(np.packbits(alone, bitorder="little").view(np.uint64))
            placed = alone[at]
            order.append(left[placed][np.argsort(at[placed])])
            left = left[~placed]
        slots = np.concatenate([*order, np.zeros(0, np.int64)]).astype(np.int64)
        return cls(levels, h2[slots], np.minimum(documents[slots], 2**32 - 1).astype(np.uint32), keeper[slots])

    def find(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Each line's slot, -1 for those that the index does not hold."""
        out, left = np.full(len(h1), -1, np.int64), np.arange(len(h1))
        for level, (words, before) in enumerate(zip(self.levels, self.before)):
            at = _place(h1[left], h2[left], level, 64 * len(words))
            word, bit = words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            rank = before[at >> 6] + np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            out[left[hit]] = rank[hit]
            left = left[~hit]
        known = np.flatnonzero(out >= 0)
        out[known[self.fingerprint[out[known]] != h2[known]]] = -1
        return out

    def dump(self) -> bytes:
        head = np.asarray([len(self.fingerprint), *(len(x) for x in self.levels)], np.int64)
        return b"".join((np.int64(len(head)).tobytes(), head.tobytes(), *(x.tobytes() for x in self.levels), self.fingerprint.tobytes(), self.keeper.tobytes(), self.documents.tobytes()))

    @classmethod
    def load(cls, data: bytes) -> LineIndex:
        at = 8 * (1 + int(np.frombuffer(data, np.int64, 1)[0]))
        n, *sizes = np.frombuffer(data[8:at], np.int64).tolist()
        levels = []
        for size in sizes:
            levels.append(np.frombuffer(data, np.uint64, size, at))
            at += 8 * size
        return cls(levels, np.frombuffer(data, np.uint64, n, at), np.frombuffer(data, np.uint32, n, at + 16 * n), np.frombuffer(data, np.int64, n, at + 8 * n))


def _keys(text: Column, min_chars: int) -> Column:
    """The keys of all lines; null where a line is too short."""

    def key(line: Column) -> Column:
        bare = F.trim(line, F.lit(WHITE))
        return F.when(F.length(bare) >= min_chars, F.translate(bare, string.ascii_uppercase, string.ascii_lowercase))

    return F.transform(F.split(text, "\n", -1), key)


def _hashed(key: str) -> list[Column]:
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2")]


def line_counts(docs: DataFrame, min_chars: int = 40) -> DataFrame:
    """h1, h2, documents, keeper (largest doc_id) of every distinct key."""
    keys = F.explode(F.array_compact(F.array_distinct(_keys(text_or_empty(), min_chars)))).alias("key")
    lines = docs.select(F.col("doc_id").cast("long").alias("doc_id"), keys).select("doc_id", *_hashed("key"))
    return lines.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("documents"), F.max("doc_id").alias("keeper"))


def build_index(lines: DataFrame, shards: int) -> DataFrame:
    """shard, held (sum of its lines' documents), index (a LineIndex as bytes) from lines (h1, h2, documents, keeper)."""
    schema = pa.schema([("shard", pa.int64()), ("held", pa.int64()), ("index", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, []

        def close() -> pa.RecordBatch:
            h1, h2, documents, keeper = (np.concatenate(x) for x in zip(*parts))
            index = LineIndex.build(h1.view(np.uint64), h2.view(np.uint64), documents, keeper)
            return pa.RecordBatch.from_arrays([pa.array([now]), pa.array([int(documents.sum())]), pa.array([index.dump()])], schema=schema)

        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            head = np.flatnonzero(np.diff(columns[0], prepend=columns[0][:1] - 1))
            for a, b in zip(head, [*head[1:], batch.num_rows]):
                if parts and columns[0][a] != now:
                    yield close()
                    parts = []
                now = int(columns[0][a])
                parts.append([c[a:b] for c in columns[1:]])
        if parts:
            yield close()

    dealt = lines.select(_shard(shards), "h1", "h2", "documents", F.coalesce("keeper", F.lit(NOBODY)).alias("keeper"))
    return dealt.repartition("shard").sortWithinPartitions("shard").mapInArrow(run, "shard long, held long, index binary")


def _shard(shards: int) -> Column:
    return F.pmod("h1", F.lit(shards)).cast("long").alias("shard")


def _probed(asked: DataFrame, least: int) -> DataFrame:
    """FILE, ROW, at of the lines that go; asked: shard, copy, index or else (FILE, ROW, doc_id, at, h1, h2)."""
    schema = pa.schema([(FILE, pa.int64()), (ROW, pa.int64()), ("at", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, key = None, None
        for batch in batches:
            shard, copy, _, place, row, doc, at, h1, h2 = (None if k == 2 else c.fill_null(0).to_numpy(zero_copy_only=False) for k, c in enumerate(batch.columns))
            turns = np.flatnonzero((np.diff(shard, prepend=shard[:1] - 1) != 0) | (np.diff(copy, prepend=copy[:1] - 1) != 0))
            for a, b in zip(turns, [*turns[1:], batch.num_rows]):
                if (shard[a], copy[a]) != key:
                    # A shard's arrays come before the lines that ask it.
                    key, index = (shard[a], copy[a]), LineIndex.load(batch.column(2)[int(a)].as_py())
                    a += 1
                slot = index.find(h1[a:b].view(np.uint64), h2[a:b].view(np.uint64))
                known = np.flatnonzero(slot >= 0)
                slot = slot[known]
                goes = a + known[(index.documents[slot] >= least) & (index.keeper[slot] != doc[a:b][known])]
                if len(goes):
                    yield pa.RecordBatch.from_arrays([pa.array(place[goes]), pa.array(row[goes]), pa.array(at[goes].astype(np.int32))], schema=schema)

    dealt = asked.repartition("shard", "copy").sortWithinPartitions("shard", "copy", F.col("index").isNull())
    return dealt.mapInArrow(run, f"{FILE} long, {ROW} long, at int")


def repeated_lines(docs: DataFrame, least: int = 5, min_chars: int = 40, lines_a_shard: int = 1 << 16, asks_a_task: int = 1 << 18) -> DataFrame:
    """FILE, ROW and places (from 0, in any order) of the lines to drop of each located row that has any."""
    seen = Observation()
    counts = line_counts(docs, min_chars).observe(seen, F.sum("documents").alias("asks"))
    lines = written(counts.where("documents > 1"))
    shards = max(1, math.ceil(lines.count() / lines_a_shard), math.ceil((seen.get["asks"] or 0) / (4 * asks_a_task)))
    index = written(build_index(lines, shards))
    copies = F.ceil(F.col("held") / asks_a_task).cast("long")
    text = text_or_empty()
    asks = docs.select(F.col("doc_id").cast("long").alias("doc_id"), FILE, ROW, F.posexplode(_keys(text, min_chars)).alias("at", "key")).where("key is not null")
    asks = asks.select(FILE, ROW, F.coalesce("doc_id", F.lit(NOBODY)).alias("doc_id"), "at", *_hashed("key")).withColumn("shard", _shard(shards))
    asks = asks.join(maybe_broadcast(index.select("shard", copies.alias("copies")), 16), "shard").withColumn("copy", F.pmod(F.xxhash64(FILE, ROW), F.col("copies")))
    arrays = index.select("shard", F.explode(F.sequence(F.lit(0).cast("long"), copies - 1)).alias("copy"), "index")
    both = arrays.unionByName(asks.select("shard", "copy", FILE, ROW, "doc_id", "at", "h1", "h2"), allowMissingColumns=True)
    gone = written(_probed(both.select("shard", "copy", "index", FILE, ROW, "doc_id", "at", "h1", "h2"), least))
    forget(lines, index)
    return gone.groupBy(FILE, ROW).agg(F.collect_list("at").alias("places"))


def drop_repeated_lines(docs: DataFrame, least: int = 5, min_chars: int = 40, **options) -> DataFrame:
    """doc_id, n_lines, n_dropped and the text that stays of every row."""
    docs = located(docs).select("doc_id", text_or_empty().alias("text"), FILE, ROW)

    def make():
        def call(batch: pa.RecordBatch) -> list:
            n, dropped, kept = [], [], []
            for text, places in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                lines = text.split("\n")
                gone = set(places or ())
                n.append(len(lines))
                dropped.append(len(gone))
                kept.append("\n".join([x for k, x in enumerate(lines) if k not in gone]) if gone else text)
            return [batch.column(0), n, dropped, kept]

        return call

    # A merge join at every size: places grow with the documents, and texts are shuffled once.
    marked = docs.join(repeated_lines(docs, least, min_chars, **options).hint("merge"), [FILE, ROW], "left").select(F.col("doc_id").cast("long"), "text", "places")
    return map_batches(marked, "doc_id long, n_lines long, n_dropped long, text string", make)


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's lines, dropped lines and digest of what stays: keys of 40 code points in five documents go."""
    out = drop_repeated_lines(table(spark, sf_dir, "documents"), least=5, min_chars=40)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP11_SQL = r"""
WITH lines AS (
  SELECT doc_id, place, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS place FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents))
), often AS (
  SELECT key, max(doc_id) AS keeper FROM lines WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), judged AS (SELECT l.doc_id, l.place, l.line, o.key IS NOT NULL AND l.doc_id <> o.keeper AS goes FROM lines l LEFT JOIN often o ON l.key = o.key)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CAST(goes AS BIGINT)) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT goes), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
