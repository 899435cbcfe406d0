"""Phrase collocations of each language, counted in generalised suffix automata.

Texts, A-Z lower-cased, are split at ``[.,;:!?\\x0A-\\x0D]`` into pieces and those at blanks and tabs into words. f(phrase)
is the number of contiguous occurrences of a phrase of up to ``longest`` words within pieces of its language.

1. Every phrase that is counted ``least`` times has only words and shorter parts that are. Length by length,
   tasks add up hashed counts in an array of fixed size (each count up to ``least``, so nothing overflows),
   and the sums become a bitmap of 2**``bits`` bits. A phrase whose bit is unset is rarer than ``least`` for certain; a
   shared bit costs work, never a result. These bitmaps are all that is broadcast.
2. Tasks cut their share of the texts at phrases whose bits are unset, and hold the runs that remain, up to ``words``
   words at a time, in a suffix automaton of bounded depth (PhraseAutomaton). Its states are classes of phrases that end at the
   same places; the root's end positions are all words. A state leaves as its longest phrase, the length of its shortest
   one and the count, and is unfolded into all its phrases afterwards.
3. Counts are added up by language and phrase. Candidates look up the counts of their parts; a candidate's suffix link
   (its phrase without the first word), and likewise its prefix, are the phrases that it may subsume.

Scores are quotients of decimals of 38 digits, exact for counts up to 10**15. A null language counts as ``und``, a null
text as empty; repeated rows count again. Texts of any length are read whole, in stretches of bounded bytes. An empty
table gives an empty result. Further columns, whatever their names, are not read. Words are told apart by their letters
between shards and by a 64-bit hash within one.
"""

from __future__ import annotations

import hashlib
import string
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import forget, maybe_broadcast, table, text_or_empty, written
from palimpsest.llm.shingles import MULTIPLIER, _lower, _power, in_chunks, mix

#: Buckets of a sketch that travel in one row.
PIECE = 1 << 16
_kind = np.zeros(256, np.uint8)
_kind[[0x20, 9]] = 1
_kind[[*b".,;:!?", 10, 11, 12, 13]] = 2


def _words(texts: list[str], salts: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lower-cased bytes, start, stop, text, follows, hash) of all words; follows: in the piece of the word before."""
    coded = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = _lower[np.frombuffer(b"\n".join([*coded, b""]), np.uint8)]
    kind = _kind[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], kind > 0)).astype(np.int8)))
    start, stop = edge[::2], edge[1::2]  # the last byte is a line feed
    text = np.searchsorted(np.cumsum([len(c) + 1 for c in coded]), start, "right")
    piece = np.cumsum(kind == 2, dtype=np.int64)[start]
    follows = np.concatenate((np.zeros(min(1, len(start)), bool), piece[1:] == piece[:-1]))
    up, down = _power(len(data) + 1)
    total = np.empty(len(data) + 1, np.uint64)
    total[0] = 0
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    return data.tobytes(), start, stop, text, follows, mix(mix((total[stop] - total[start]) * down[start]) ^ salts[text])


def _bucket(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64)


def _back(x: np.ndarray) -> np.ndarray:
    return np.concatenate((x[:1], x[:-1]))


def _grams(hashes: np.ndarray, follows: np.ndarray, maps: list[np.ndarray], bits: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(hash, possible) of the phrase of len(maps) + 1 words that ends at each word, and for each shorter length whether
    the bits of the phrase that ends there are set. possible: no part's bit is unset."""
    grams, ok, each = hashes, np.ones(len(hashes), bool), []
    for known in maps:
        at = np.flatnonzero(ok)
        bucket = _bucket(grams[at], bits)
        ok = ok.copy()
        ok[at] = (known[bucket >> 3] >> (bucket & 7).astype(np.uint8)) & 1 == 1
        each.append(ok)
        ok = ok & _back(ok) & follows
        grams = mix(_back(grams) * MULTIPLIER + hashes)
        follows = follows & _back(follows)
    return grams, ok, each


class PhraseAutomaton:
    """Suffix automaton, to a depth of ``longest``, of words ids; depth: the words of the longest phrase that ends at each.

    Level d has the phrases of d words. end: a place where a phrase ends; link: its suffix link's row one level below;
    count: its end positions. A phrase and its link that end at the same places are one state.
    """

    def __init__(self, ids: np.ndarray, depth: np.ndarray, longest: int):
        self.ids, places, run = ids, np.arange(len(ids)), depth
        n = int(ids.max()) + 1 if len(ids) else 0
        state, self.end, self.link, tops = ids.astype(np.int64), [np.zeros(n, np.int64)], [np.zeros(n, np.int64)], []
        self.end[0][ids[::-1]] = places[::-1]
        self.count = []
        for d in range(1, longest + 1):
            if d > 1:
                at = np.flatnonzero(run >= d)
                _, first, row = np.unique(state[at - 1] * n + ids[at], return_index=True, return_inverse=True)
                self.end.append(at[first])
                self.link.append(state[at[first]])
                state = state.copy()
                state[at] = row
            # Each place counts once, at the longest phrase that ends there; links carry the counts on.
            tops = state[(run >= d) if d == longest else (run == d)]
            self.count.append(np.bincount(tops, minlength=len(self.end[-1])).astype(np.int64))
        for d in range(longest - 1, 0, -1):
            np.add.at(self.count[d - 1], self.link[d], self.count[d])

    def states(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(longest length, end of an occurrence, shortest length, count) of all states, by longest length."""
        shortest = [np.full(len(self.end[0]), 1)]
        for d in range(1, len(self.end)):
            same = self.count[d] == self.count[d - 1][self.link[d]]
            shortest.append(np.where(same, shortest[d - 1][self.link[d]], d + 1))
        for d in range(len(self.end)):
            top = np.ones(len(self.end[d]), bool)
            if d + 1 < len(self.end):  # not one with a longer phrase that ends at the same places
                top[self.link[d + 1][self.count[d + 1] == self.count[d][self.link[d + 1]]]] = False
            yield d + 1, self.end[d][top], shortest[d][top], self.count[d][top]


def _salted(salts: dict[str, int], langs: list[str]) -> np.ndarray:
    for x in set(langs) - set(salts):
        salts[x] = int.from_bytes(hashlib.blake2b(x.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
    return np.asarray([salts[x] for x in langs], np.uint64)


def _loaded(maps: list[Broadcast]) -> list[np.ndarray]:
    return [np.frombuffer(m.value, np.uint8) for m in maps]


def _sketched(least: int, bits: int, maps: list[Broadcast]) -> Callable:
    """(piece, places, counts): the task's counts of phrases of len(maps) + 1 words by bucket, up to least."""
    schema = pa.schema([("piece", pa.int64()), ("places", pa.binary()), ("counts", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, salts, known = np.zeros(1 << bits, np.uint32 if least > 255 else np.uint8), {}, _loaded(maps)
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in in_chunks(texts):
                *_, follows, hashes = _words(texts[a:b], _salted(salts, langs[a:b]))
                grams, ok, _ = _grams(hashes, follows, known, bits)
                bucket, n = np.unique(_bucket(grams[ok], bits), return_counts=True)
                counts[bucket] = np.minimum(counts[bucket] + n, least)
        for k in range(0, len(counts), PIECE):
            part = counts[k : k + PIECE]
            at = np.flatnonzero(part)
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array([k // PIECE]), pa.array([at.astype(np.uint16).tobytes()]), pa.array([part[at].tobytes()])], schema=schema)

    return run


def _summed(least: int, bits: int) -> Callable:
    """(piece, bitmap) of the buckets whose sums over all tasks reach least, from rows in the order of pieces."""
    schema = pa.schema([("piece", pa.int64()), ("bitmap", pa.binary())])
    size, kind = min(PIECE, 1 << bits), np.uint32 if least > 255 else np.uint8

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, np.zeros(size, np.uint32)

        def close() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now]), pa.array([np.packbits(total >= least, bitorder="little").tobytes()])], schema=schema)

        for batch in batches:
            for piece, places, counts in zip(*(c.to_pylist() for c in batch.columns)):
                if piece != now:
                    if now is not None:
                        yield close()
                    now, total[:] = piece, 0
                at = np.frombuffer(places, np.uint16)
                total[at] = np.minimum(total[at] + np.frombuffer(counts, kind), least)
        if now is not None:
            yield close()

    return run


def _bitmap(texts: DataFrame, least: int, bits: int, maps: list[Broadcast]) -> Broadcast:
    sums = texts.mapInArrow(_sketched(least, bits, maps), "piece long, places binary, counts binary")
    out = bytearray(1 << (bits - 3))
    for piece, part in sums.repartition("piece").sortWithinPartitions("piece").mapInArrow(_summed(least, bits), "piece long, bitmap binary").toLocalIterator():
        out[piece * PIECE // 8 : piece * PIECE // 8 + len(part)] = part
    return texts.sparkSession.sparkContext.broadcast(bytes(out))


class _Shard:
    """What a task holds of its texts: runs of words that may be in a phrase that counts."""

    def __init__(self):
        self.number: dict[int, int] = {}
        self.words: list[bytes] = []
        self.lang: list[str] = []
        self.ids: list[np.ndarray] = []
        self.depth: list[np.ndarray] = []
        self.total: dict[str, int] = {}
        self.held = self.letters = 0

    def add(self, langs: list[str], texts: list[str], salts: np.ndarray, maps: list[np.ndarray], bits: int) -> None:
        data, start, stop, text, follows, hashes = _words(texts, salts)
        for k, n in enumerate(np.bincount(text, minlength=len(texts)).tolist()):
            self.total[langs[k]] = self.total.get(langs[k], 0) + n
        # Words whose own bit is unset go; the others end phrases as long as bits are set.
        depth = sum(x.astype(np.int64) for x in _grams(hashes, follows, maps, bits)[2])
        at = np.flatnonzero(depth)
        distinct, first, row = np.unique(hashes[at], return_index=True, return_inverse=True)
        own = np.empty(len(distinct), np.int64)
        for k, (h, place) in enumerate(zip(distinct.tolist(), at[first].tolist())):
            if (got := self.number.get(h)) is None:
                self.number[h] = got = len(self.words)
                self.words.append(data[start[place] : stop[place]])
                self.lang.append(langs[text[place]])
                self.letters += len(self.words[-1])
            own[k] = got
        self.ids.append(own[row])
        self.depth.append(depth[at])
        self.held += len(at)

    def states(self, longest: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        def made(lang: pa.Array, phrase: pa.Array, shortest: np.ndarray, count: np.ndarray) -> Iterator[pa.RecordBatch]:
            for k in range(0, len(count), 20_000):
                yield pa.RecordBatch.from_arrays([lang[k : k + 20_000], phrase[k : k + 20_000], pa.array(shortest[k : k + 20_000].astype(np.int32)), pa.array(count[k : k + 20_000])], schema=schema)

        if self.total:
            yield from made(pa.array(list(self.total), pa.string()), pa.array([""] * len(self.total), pa.string()), np.zeros(len(self.total)), np.asarray(list(self.total.values()), np.int64))
        if not self.held:
            return
        words, langs = pa.array(self.words, pa.binary()).cast(pa.string()), pa.array(self.lang, pa.string())
        ids = np.concatenate(self.ids)
        for length, end, shortest, count in PhraseAutomaton(ids, np.concatenate(self.depth), longest).states():
            for k in range(0, len(end), 100_000):
                at = end[k : k + 100_000]
                parts = [words.take(pa.array(ids[at - back])) for back in range(length - 1, -1, -1)]
                phrase = pc.binary_join_element_wise(*parts, " ") if length > 1 else parts[0]
                yield from made(langs.take(pa.array(ids[at])), phrase, shortest[k : k + 100_000], count[k : k + 100_000])


def phrase_states(texts: DataFrame, longest: int, bits: int, maps: list[Broadcast], words: int = 1 << 19, letters: int = 16 << 20) -> DataFrame:
    """lang, phrase, shortest, count of the states of all shards' automata; the root has the empty phrase."""
    schema = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("shortest", pa.int32()), ("count", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, salts, known = _Shard(), {}, _loaded(maps)
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in in_chunks(texts):
                shard.add(langs[a:b], texts[a:b], _salted(salts, langs[a:b]), known, bits)
                if shard.held >= words or shard.letters >= letters:
                    yield from shard.states(longest, schema)
                    shard = _Shard()
        yield from shard.states(longest, schema)

    return texts.mapInArrow(run, "lang string, phrase string, shortest int, count long")


def _joined(words: Column) -> Column:
    return F.array_join(words, " ")


def phrase_counts(docs: DataFrame, longest: int = 3, least: int = 10, bits: int = 26, words: int = 1 << 19) -> DataFrame:
    """lang, phrase, f of every phrase of up to longest words with f >= least; the empty phrase has the number of words."""
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), text_or_empty().alias("text"))
    maps: list[Broadcast] = []
    for _ in range(longest):
        maps.append(_bitmap(texts, least, bits, maps))
    w = F.split("phrase", " ")
    inner = F.transform(F.sequence("shortest", F.size(w)), lambda k: _joined(F.slice(w, -k, k)))
    unfolded = phrase_states(texts, longest, bits, maps, words).select("lang", F.explode(F.when(F.col("phrase") == "", F.array(F.lit(""))).otherwise(inner)).alias("phrase"), "count")
    return unfolded.groupBy("lang", "phrase").agg(F.sum("count").alias("f")).where((F.col("f") >= least) | (F.col("phrase") == ""))


def collocations(docs: DataFrame, longest: int = 3, least: int = 10, share: int = 50, top: int = 2000, **options) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's first phrases of 2 to longest words.

    A candidate goes if a longer one that contains it has at least share percent of its count.
    """
    counts = written(phrase_counts(docs, longest, least, **options))
    w = F.split("phrase", " ")
    found = counts.where("phrase like '% %'").select("lang", "phrase", F.col("f").alias("a"), w.alias("w"), F.size(w).alias("k"))
    cuts = F.transform(F.sequence(F.lit(1), F.col("k") - 1), lambda c: F.struct(c.alias("cut"), _joined(F.slice("w", 1, c)).alias("left"), _joined(F.slice("w", c + 1, F.col("k") - c)).alias("right")))
    parts = found.select("lang", "phrase", "a", F.explode(cuts).alias("p")).select("lang", "phrase", "a", "p.*")
    of = lambda part, name: counts.select("lang", F.col("phrase").alias(part), F.col("f").alias(name))
    parts = parts.join(of("left", "l"), ["lang", "left"]).join(of("right", "r"), ["lang", "right"])
    big = lambda x: f"cast({x} as decimal(38,0))"
    parts = parts.withColumn("score", F.expr(f"cast((1000000 * {big('a')} * {big('a')}) div ({big('l')} * {big('r')}) as bigint)"))
    scored = parts.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct("score", "cut", "l", "r")).alias("lowest"))
    # Down the suffix link and the prefix, level by level: every contiguous part of two words and more.
    links = F.explode(F.flatten(F.transform(F.sequence(F.lit(2), F.col("k") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("k") - n + 1), lambda i: _joined(F.slice("w", i, n))))))
    over = found.where("k > 2").select("lang", links.alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = scored.join(over, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("a")))
    ranked = kept.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(32)))
    # First in 32 parts of each language, so that its last task reads 32 * top rows whatever the number of partitions.
    for within in (["lang", "part"], ["lang"]):
        order = Window.partitionBy(*within).orderBy(F.desc("lowest.score"), F.desc("a"), "phrase")
        ranked = ranked.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    totals = maybe_broadcast(counts.where("phrase = ''").select("lang", F.col("f").alias("n")), 64)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "lowest.l", "lowest.r", "n", "lowest.score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's first 2000 phrases of two and three words, by score."""
    return collocations(table(spark, sf_dir, "documents"))


OP12_SQL = rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), sentences AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
places AS (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM sentences, (VALUES (1), (2), (3)) lengths(k)),
grams AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, CAST(count(*) AS BIGINT) AS f FROM places GROUP BY ALL),
found AS (SELECT *, string_split(phrase, ' ') AS w FROM grams WHERE k >= 2 AND f >= 10),
parts AS (
  SELECT lang, phrase, f AS a, cut, array_to_string(w[1:cut], ' ') AS head, array_to_string(w[cut + 1:k], ' ') AS rest
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM found)
), cuts AS (
  SELECT p.*, l.f AS l, r.f AS r, CAST((CAST(1000000 AS HUGEINT) * p.a * p.a) // (CAST(l.f AS HUGEINT) * r.f) AS BIGINT) AS score
  FROM parts p JOIN grams l ON l.lang = p.lang AND l.phrase = p.head JOIN grams r ON r.lang = p.lang AND r.phrase = p.rest
), lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
longer AS (
  SELECT lang, phrase, max(f) AS f FROM (
    SELECT lang, array_to_string(w[1:2], ' ') AS phrase, f FROM found WHERE k = 3 UNION ALL SELECT lang, array_to_string(w[2:3], ' '), f FROM found WHERE k = 3
  ) GROUP BY ALL
), totals AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM grams WHERE k = 1 GROUP BY lang)
SELECT s.lang, row_number() OVER (PARTITION BY s.lang ORDER BY s.score DESC, s.a DESC, s.phrase) AS rank, s.phrase, s.a, s.l, s.r, t.n, s.score
FROM lowest s JOIN totals t ON t.lang = s.lang LEFT JOIN longer g ON g.lang = s.lang AND g.phrase = s.phrase
WHERE g.f IS NULL OR 100 * g.f < 50 * s.a QUALIFY rank <= 2000
"""
