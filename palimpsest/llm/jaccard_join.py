"""Exact Jaccard self-join of shingle sets, by inverted lists with set-relation skipping.

1. Rows with the same shingle set form one class (by two 64-bit sums over the set); the join runs over classes.
2. All shingles get one global order, by hash, in which frequent shingles are moved back by a fixed stretch. Two sets
   with Jaccard >= t share a shingle among the first n - ceil(t n) + 1 of each in any such order, so only those
   are indexed, and the order keeps frequent shingles out of the index wherever a set has enough rare ones. Which
   shingles count as frequent changes the cost, never the result.
3. A list is read in order of set size, in blocks of ``SKIP`` rows. A set looks at a block's bounds first: the largest
   set in it, its earliest position and its components. Blocks of sets too small, blocks whose positions rule out this
   list as the first that the sets share, and blocks of the set's own component are skipped whole; the rows of the
   others are then tested alike.
4. Answers grow in two rounds. The first takes only the first ``early`` shingles of each set, and joins each
   set to the smallest one within reach in its lists: a highly similar set, whose component it takes over. The second
   round takes all lists, and derives a set's answers from that one's: whatever is in the component already needs no
   comparison, and only pairs that would join two components are looked at. Pairs are verified on whole sets, but for
   those whose parity bits differ in too many places to be linked.
   A list with more than ``block`` sets within reach is compared in square tiles of bounded bytes, by counts of the
   places in which parity bits differ; pairs that pass and lie in two components are verified. A tile with very many of
   them is compared on whole sets instead, and only links that connect something leave it.
5. Components come from forests of verified links. Links inside a component that are not needed for it are never
   computed, so there is no number of links.

Texts are read whole. Null and empty texts, and those without words, have an empty set and are linked with nothing,
also not with one another. Repeated rows and equal texts fall in one class. A null doc_id is never a component's name
unless all its rows have none. Shingles are compared by 64-bit hash. An empty table gives an empty result. Further
columns, whatever their names, stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.arrow import map_batches
from palimpsest.llm.common import FILE, ROW, forget, located, maybe_broadcast, table, written
from palimpsest.llm.components import components
from palimpsest.llm.shingles import in_chunks, mix, shingle_sets

#: Frequent shingles move back by this share of the hash range, and so much more of each set is looked at.
BACK = 0.15
PARITY = 1024
SKIP = 16


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _needed(n: int, percent: int) -> int:
    """How many first shingles of a set of n are indexed."""
    return n - -(-percent * n // 100) + 1


def _classes(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n, s1, s2 and locator of every row: equal sets have equal n, s1 and s2."""

    def make():
        def call(batch: pa.RecordBatch) -> list:
            texts, n, s1, s2 = batch.column(1).to_pylist(), [], [], []
            for a, b in in_chunks(texts):
                for x in shingle_sets(texts[a:b], size):
                    n.append(len(x))
                    s1.append(int(_signed(x).sum()) if len(x) else 0)
                    s2.append(int(_signed(mix(x ^ np.uint64(0xA5A5A5A5))).sum()) if len(x) else 0)
            return [batch.column(0), n, s1, s2, batch.column(2), batch.column(3)]

        return call

    return map_batches(docs.select("doc_id", "text", FILE, ROW), f"doc_id long, n long, s1 long, s2 long, {FILE} long, {ROW} long", make)


def _parity_bits(x: np.ndarray, width: int) -> np.ndarray:
    """Each bit is the parity of the number of shingles that fall on it: two sets differ in at least as many shingles as
    their bits differ in."""
    return (np.bincount((x >> np.uint64(8)).astype(np.int64) % width, minlength=width) & 1).astype(np.uint8)


def _parity(x: np.ndarray) -> list[int]:
    """The bits as longs: PARITY, or for a larger set the next power of two, so that long sets too are told apart."""
    return np.packbits(_parity_bits(x, max(PARITY, 1 << (len(x) - 1).bit_length()))).view(np.int64).tolist()


def _apart(a: Column, b: Column) -> Column:
    """In how many places two sets' bits differ. The wider is folded to the narrower's width, which keeps parities."""

    def narrowed(bits: Column, n: Column) -> Column:
        xor = lambda x, y: F.zip_with(x, y, lambda p, q: p.bitwiseXOR(q))
        folded = F.aggregate(F.sequence(F.lit(1), F.floor(F.size(bits) / n).cast("int") - 1), F.slice(bits, F.lit(1), n), lambda acc, k: xor(acc, F.slice(bits, k * n + 1, n)))
        return F.when(F.size(bits) > n, folded).otherwise(bits)

    n = F.least(F.size(a), F.size(b))
    return F.aggregate(F.zip_with(narrowed(a, n), narrowed(b, n), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda acc, x: acc + x)


def _sets(texts: DataFrame, size: int, percent: int, region: bool) -> DataFrame:
    """node, n and the node's shingles: all, or those that can be among the first ones in any order with moves of BACK.

    With regions also the set's parity bits.
    """

    def make():
        def call(batch: pa.RecordBatch) -> list:
            texts, n, kept, bits = batch.column(1).to_pylist(), [], [], []
            for a, b in in_chunks(texts):
                for x in shingle_sets(texts[a:b], size):
                    n.append(len(x))
                    if region:
                        bits.append(_parity(x))
                    if region and len(x):
                        last = min(int(x[_needed(len(x), percent) - 1]) + int(BACK * 2**64) + (1 << 16), 2**64 - 1)
                        x = x[: np.searchsorted(x, np.uint64(last), "right")]
                    kept.append(_signed(x))
            return [batch.column(0), n, kept, *([bits] if region else [])]

        return call

    return map_batches(texts.select("node", "text"), "node long, n long, shingles array<long>" + ", bits array<long>" * region, make)


def _index(regions: DataFrame, hot: np.ndarray, percent: int) -> DataFrame:
    """shingle, node, n, pos: a row for each indexed shingle and its place in its set's order."""
    shared = regions.sparkSession.sparkContext.broadcast(hot)
    schema = pa.schema([(x, pa.int64()) for x in ("shingle", "node", "n", "pos")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                sizes = part.column(1).to_numpy()
                lists = part.column(2)
                flat, ends = lists.flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(np.diff(lists.offsets.to_numpy()))))
                key = flat.view(np.uint64)
                order = key.astype(np.float64)  # ties after rounding are settled by the hash itself below
                if len(often):
                    place = np.minimum(np.searchsorted(often, flat), len(often) - 1)
                    order = order + (often[place] == flat) * (BACK * 2.0**64)
                out: list[tuple[np.ndarray, int]] = []
                for k, n in enumerate(sizes.tolist()):
                    a, b = ends[k], ends[k + 1]
                    out.append((flat[a:b][np.lexsort((key[a:b], order[a:b]))[: _needed(n, percent)]], k))
                if out:
                    counts = [len(x) for x, _ in out]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate([x for x, _ in out])), pa.array(np.repeat(part.column(0).to_numpy(), counts)), pa.array(np.repeat(sizes, counts)), pa.array(np.concatenate([np.arange(c) for c in counts]))], schema=schema
                    )

    return regions.mapInArrow(run, "shingle long, node long, n long, pos long")


def _ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0] .. start[0] + count[0] - 1, start[1] .. and so on."""
    ends = np.cumsum(count)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - ends + count, count)


class _Lists:
    """Whole inverted lists, one after another: shingle, node, n, pos and component of their rows, by shingle, n and node."""

    def __init__(self, rows: np.ndarray, percent: int):
        head = np.flatnonzero(np.concatenate(([True], rows[0, 1:] != rows[0, :-1])))
        count = np.diff(np.append(head, rows.shape[1]))
        # Lists that are one component are answered already.
        mixed = np.minimum.reduceat(rows[4], head) != np.maximum.reduceat(rows[4], head)
        self.rows, self.percent = rows[:, np.repeat(mixed, count)], percent
        self.count = count[mixed]
        self.head = np.cumsum(self.count) - self.count
        self.owner = np.repeat(np.arange(len(self.count)), self.count)
        n = self.rows[2]
        key = self.owner * (1 << 34) + n
        #: For each row the first one of its list that is large enough to be linked with it.
        self.first = np.searchsorted(key, self.owner * (1 << 34) + -(-percent * n // 100))

    def stars(self) -> np.ndarray:
        """Pairs of each row with the smallest set within reach."""
        k = np.flatnonzero(self.first < np.arange(len(self.owner)))
        return self._passing(self.first[k], k)

    def split(self, block: int) -> tuple[np.ndarray, np.ndarray]:
        """(pairs of the lists in which no set has more than block sets within reach, rows of the other lists)."""
        if not len(self.owner):
            return np.zeros((2, 0), np.int64), self.rows
        at = np.arange(len(self.owner))
        long = np.maximum.reduceat(at - self.first + 1, self.head) > block
        k = at[~long[self.owner] & (self.first < at)]
        return self._pairs(k), self.rows[:, long[self.owner]]

    def _pairs(self, k: np.ndarray) -> np.ndarray:
        """Pairs of the rows k with earlier ones within reach, by blocks of SKIP rows of a list."""
        _, _, n, pos, component = self.rows
        place = np.arange(len(self.owner)) - self.head[self.owner]
        starts = np.flatnonzero(place % SKIP == 0)
        number = np.cumsum(place % SKIP == 0) - 1  # of each row's block
        largest, earliest = np.maximum.reduceat(n, starts), np.minimum.reduceat(pos, starts)
        low, high = np.minimum.reduceat(component, starts), np.maximum.reduceat(component, starts)
        ends, out = np.append(starts[1:], len(n)), []
        for part in np.array_split(k, max(1, len(k) // 4096)):
            blocks = number[part] - number[self.first[part]] + 1
            row, b = np.repeat(part, blocks), _ranges(number[self.first[part]], blocks)
            ok = self._near(pos[row] + earliest[b], n[row] + largest[b]) & ~((low[b] == high[b]) & (low[b] == component[row]))
            row, b = row[ok], b[ok]
            begin = np.maximum(starts[b], self.first[row])
            stop = np.minimum(ends[b], row)
            count = np.maximum(0, stop - begin)
            out.append(self._passing(_ranges(begin, count), np.repeat(row, count)))
        return np.concatenate(out, axis=1)

    def _near(self, positions: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        # Shingles before the first shared one differ: there may not be more of them than a link allows.
        return positions * (100 + self.percent) <= (100 - self.percent) * sizes

    def _passing(self, j: np.ndarray, k: np.ndarray) -> np.ndarray:
        _, node, n, pos, component = self.rows
        ok = self._near(pos[j] + pos[k], n[j] + n[k]) & (component[j] != component[k])
        return np.stack((node[j[ok]], node[k[ok]]))


def _list_pairs(index: DataFrame, percent: int, block: int, star: bool, most_rows: int = 50_000) -> DataFrame:
    """a, b, kind, shingle, n: kind 0 a pair to verify; kind 1 a member (a, of component b) of a list too long for pairs.

    index: shingle, node, n, pos, component. With star, each set gives a pair with the smallest one within reach in its
    list, and no members. A list of more than most_rows rows, which are not held at once, is made of members (with star:
    compared in stretches that all begin with its smallest set).
    """
    names = ("a", "b", "kind", "shingle", "n")
    schema = pa.schema([(x, pa.int64()) for x in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((5, 0), np.int64)
        pairs: list[np.ndarray] = []
        spilled = None  # the shingle of a list whose first rows have left as members

        def made(pairs: np.ndarray, members: np.ndarray) -> pa.RecordBatch:
            pairs = np.unique(pairs, axis=1)  # the same pair comes from many lists
            zero = np.zeros(pairs.shape[1], np.int64)
            columns = [np.concatenate(x) for x in zip((pairs[0], pairs[1], zero, zero, zero), (members[1], members[4], np.ones(members.shape[1], np.int64), members[0], members[2]))]
            return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], schema=schema)

        def close(rows: np.ndarray) -> np.ndarray:
            """Collects the pairs of whole lists; returns rows that leave as members."""
            cut = int(np.searchsorted(rows[0] != spilled, True)) if spilled is not None else 0  # rows of the spilled list come first
            lists = _Lists(rows[:, cut:], percent) if cut < rows.shape[1] else None
            if lists is None:
                return rows
            found, members = (lists.stars(), rows[:, :0]) if star else lists.split(block)
            pairs.append(found)
            return np.concatenate((rows[:, :cut], members), axis=1)

        for batch in batches:
            held = np.concatenate((held, np.stack([batch.column(k).to_numpy() for k in range(5)])), axis=1)
            last = int(np.searchsorted(held[0], held[0, -1]))
            if last:
                members = close(held[:, :last])
                held, spilled = held[:, last:], None if spilled != held[0, -1] else spilled
                if members.shape[1]:
                    yield made(np.zeros((2, 0), np.int64), members)
            if held.shape[1] > most_rows:
                if star:
                    pairs.append(_Lists(held, percent).stars())
                    held = held[:, :1]
                else:
                    yield made(np.zeros((2, 0), np.int64), held)
                    held, spilled = held[:, :0], int(batch.column(0)[-1].as_py())
            if sum(x.shape[1] for x in pairs) >= 50_000:
                yield made(np.concatenate(pairs, axis=1), held[:, :0])
                pairs.clear()
        members = close(held) if held.shape[1] else held
        if pairs or members.shape[1]:
            yield made(np.concatenate([*pairs, np.zeros((2, 0), np.int64)], axis=1), members)

    dealt = index.select("shingle", "node", "n", "pos", "component").repartition("shingle").sortWithinPartitions("shingle", "n", "node")
    return dealt.mapInArrow(run, ", ".join(f"{x} long" for x in names))


def _tile_pairs(rows: list[tuple], cross: bool, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of pairs of rows (node, component, n, side, bits) that may be links: of two components, within reach, and
    with parity bits that differ in few enough places. rows is put in order first."""
    rows.sort(key=lambda r: (r[3], r[2], r[0]))
    size, side = (np.asarray([r[k] for r in rows]) for k in (2, 3))
    component = np.asarray([r[1] for r in rows], np.int64)
    width = np.asarray([64 * len(r[4]) for r in rows])
    for w in np.unique(width).tolist():
        own, others = np.flatnonzero(width == w), np.flatnonzero(width >= w)
        # Wider bits are folded to this width, which keeps parities.
        bits = np.stack([np.bitwise_xor.reduce(np.reshape(rows[k][4], (-1, w // 64)), axis=0) for k in others], axis=1).view(np.uint64)
        at = np.searchsorted(others, own)
        for k in range(0, len(own), 64):
            mine, i = at[k : k + 64], own[k : k + 64, None]
            j = others[None, :]
            ok = (size[i] * 100 >= percent * size[j]) & (size[j] * 100 >= percent * size[i]) & (component[i] != component[j])
            ok &= ((width[j] > w) | (i < j)) & ((side[i] != side[j]) if cross else True)
            differ = np.zeros(ok.shape, np.int32)
            for word in bits:
                differ += np.bitwise_count(word[mine, None] ^ word[None, :])
            ok &= differ * (100 + percent) <= (100 - percent) * (size[i] + size[j])
            x, y = np.nonzero(ok)
            yield i[x, 0], others[y]


def _tile_links(rows: list[tuple], cross: bool, percent: int) -> list[tuple[int, int]]:
    """Links that connect what is not connected yet among rows (node, component, n, side, shingles), each verified."""
    rows = [(*r[:4], np.asarray(_parity(r[4].view(np.uint64)), np.int64), r[4]) for r in rows]
    names: dict[int, int] = {}
    group, out = None, []
    for left, right in _tile_pairs(rows, cross, percent):
        if group is None:  # rows have their order now
            group = np.asarray([names.setdefault(r[1], len(names)) for r in rows])
        for i, j in zip(left.tolist(), right.tolist()):
            if group[i] == group[j]:
                continue
            x, y = rows[i][5], rows[j][5]
            both = len(np.intersect1d(x, y, assume_unique=True))
            if 100 * both >= percent * (len(x) + len(y) - both):
                group[group == group[j]] = group[i]
                out.append((rows[i][0], rows[j][0]))
    return out


def _dealt_tiles(held: DataFrame, values: DataFrame, per_tile, columns: str) -> DataFrame:
    """per_tile(key, rows) of every tile (shingle, i, j) of held; a row is node, component, n, side and the node's array in values."""
    schema = pa.schema([(x.split()[0], pa.int64()) for x in columns.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: list[tuple] = []
        key = None

        def close() -> pa.RecordBatch:
            found = per_tile(key, now)
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in range(len(schema))], schema=schema)

        for batch in batches:
            arrays = batch.column(7)
            flat, ends = arrays.flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(np.diff(arrays.offsets.to_numpy()))))
            for k, r in enumerate(zip(*(batch.column(c).to_pylist() for c in range(7)))):
                if r[:3] != key:
                    if now:
                        yield close()
                    now, key = [], r[:3]
                now.append((r[3], r[4], r[5], r[6], flat[ends[k] : ends[k + 1]]))
        if now:
            yield close()

    dealt = held.join(values, "node").select("shingle", "i", "j", "node", "component", "n", "side", values.columns[1])
    return dealt.repartition("shingle", "i", "j").sortWithinPartitions("shingle", "i", "j").mapInArrow(run, columns)


def _long_lists(members: DataFrame, verify: _Verifier, percent: int, tile: int, most_pairs: int = 4) -> DataFrame:
    """a, b: links within long lists (shingle, node, component, n), by tiles that hold about tile shingles, each set
    being counted as PARITY of them at least.

    Tiles compare parity bits alone and give the pairs that remain. Only a tile with more than most_pairs of them for
    each of its rows gets whole sets, and gives no more links than connect its rows.
    """
    held = F.ceil(F.sum(F.greatest(F.col("n"), F.lit(PARITY))) / tile).cast("int").alias("blocks")
    many = members.groupBy("shingle").agg(held, F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("shingle", "blocks")
    held = members.join(many, "shingle").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    # A set meets every block: as the first side from its own block on, as the second up to it.
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    held = held.select("shingle", "node", "component", "n", "own", other.alias("other"))
    held = held.select("shingle", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", "component", "n", (F.col("own") > F.col("other")).cast("int").alias("side"))

    def pairs(key: tuple, rows: list[tuple]) -> list[tuple]:
        found: list[tuple] = []
        for left, right in _tile_pairs(rows, key[1] != key[2], percent):
            found += zip([rows[i][0] for i in left.tolist()], [rows[j][0] for j in right.tolist()], *([x] * len(left) for x in key))
            if len(found) > most_pairs * len(rows):
                return [(None, None, *key)]
        return found

    def links(key: tuple, rows: list[tuple]) -> list[tuple]:
        return _tile_links(rows, key[1] != key[2], percent)

    found = verify.kept(_dealt_tiles(held, verify.bits.select("node", "bits"), pairs, "a long, b long, shingle long, i long, j long"))
    out = verify.similar(found.where("a is not null"))
    dense = found.where("a is null").select("shingle", "i", "j")
    if not dense.isEmpty():
        rest = verify.kept(held.join(dense, ["shingle", "i", "j"]))
        out = out.union(_dealt_tiles(rest, verify.sets(rest.select("node").distinct()).select("node", "shingles"), links, "a long, b long"))
    return out


class _Verifier:
    """Jaccard numbers of pairs of nodes, from whole sets that are made only for nodes that are in a pair."""

    def __init__(self, nodes: DataFrame, docs: DataFrame, regions: DataFrame, size: int, percent: int):
        self.nodes, self.docs, self.size, self.percent = nodes, docs, size, percent
        self.bits = regions.select("node", "n", "bits")
        self.scratch: list[DataFrame] = []  # tables that the links alone are made from

    def sets(self, nodes: DataFrame) -> DataFrame:
        """node, n, shingles of the nodes."""
        wanted = self.nodes.join(nodes, "node").select("node", FILE, ROW)
        texts = self.docs.join(maybe_broadcast(wanted, 32), [FILE, ROW])
        return self.kept(_sets(texts, self.size, self.percent, region=False))

    def kept(self, df: DataFrame) -> DataFrame:
        self.scratch.append(written(df))
        return self.scratch[-1]

    def similar(self, pairs: DataFrame) -> DataFrame:
        """The pairs that are links."""
        return self(pairs).where(F.col("both") * 100 >= self.percent * F.col("either")).select("a", "b")

    def __call__(self, pairs: DataFrame, percent: int | None = None) -> DataFrame:
        """a, b, both (shingles in common), either (shingles in the union) of the pairs (a, b) that can reach the percentage.

        Pairs whose parity bits differ in more places than the percentage allows shingles to differ are left out.
        """
        least = self.percent if percent is None else percent
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
        of = lambda k: self.bits.select(F.col("node").alias(k), F.col("n").alias(f"n_{k}"), F.col("bits").alias(f"bits_{k}"))
        near = _apart(F.col("bits_a"), F.col("bits_b")) * (100 + least) <= (100 - least) * (F.col("n_a") + F.col("n_b"))
        pairs = pairs.join(of("a"), "a").join(of("b"), "b").where(near)
        pairs = self.kept(pairs.select("a", "b"))
        sets = self.sets(pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct())
        left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
        right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
        met = pairs.join(right, "b").join(left, "a")
        both = F.size(F.array_intersect("x", "y")).cast("long")
        return self.kept(met.select("a", "b", both.alias("both"), (F.size("x") + F.size("y")).cast("long").alias("sum")).select("a", "b", "both", (F.col("sum") - F.col("both")).alias("either")))


def link_classes(docs: DataFrame, size: int = 5, percent: int = 80, block: int = 64, early: int = 6, tile: int = 1 << 22, frequent: int = 32, most_frequent: int = 500_000, most_rows: int = 50_000, most_pairs: int = 4, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, nodes, links): every row's class, one node for each class, and all verified links that components need."""
    docs = located(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), FILE, ROW)
    rows = written(_classes(docs, size))
    key = ["n", "s1", "s2"]
    best = rows.where("n > 0").groupBy(*key).agg(F.min("doc_id").alias("rep"), F.min(F.struct(FILE, ROW)).alias("place"))
    nodes = written(best.select(*key, "rep", "place.*").withColumn("node", F.monotonically_increasing_id()))
    reps = nodes.select("node", FILE, ROW)
    regions = written(_sets(docs.join(maybe_broadcast(reps, 32), [FILE, ROW]), size, percent, region=True))
    first = F.slice("shingles", F.lit(1), (F.col("n") - F.ceil(F.lit(percent) * F.col("n") / 100) + 1).cast("int"))
    df = regions.select(F.explode(first).alias("shingle")).groupBy("shingle").count().where(F.col("count") >= frequent)
    hot = np.sort(np.asarray([r[0] for r in df.orderBy(F.desc("count"), "shingle").limit(most_frequent).select("shingle").collect()], np.int64))
    index = written(_index(regions, hot, percent))
    verify = _Verifier(nodes, docs, regions, size, percent)
    start = index.where(F.col("pos") < early).withColumn("component", F.col("node"))
    early_pairs = written(_list_pairs(start, percent, 0, True, most_rows))
    links = early_links = written(verify.similar(early_pairs))
    known = written(components(links))
    rest = index.join(maybe_broadcast(known, 24), "node", "left").withColumn("component", F.coalesce("component", "node"))
    listed = written(_list_pairs(rest, percent, block, False, most_rows))
    links = links.union(verify.similar(listed.where("kind = 0")))
    members = listed.where("kind = 1").select("shingle", F.col("a").alias("node"), F.col("b").alias("component"), "n")
    if not members.isEmpty():
        links = links.union(_long_lists(members, verify, percent, tile, most_pairs))
    links = written(links.distinct())
    forget(regions, index, early_pairs, early_links, known, listed, *verify.scratch)
    return rows, nodes, links


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, **options) -> DataFrame:
    """A row per row of docs: doc_id, n_shingles, component_id, group (null for an empty set), and its locator (FILE, ROW)."""
    rows, nodes, links = link_classes(docs, size, percent, **options)
    found = components(links)
    named = nodes.join(found, "node", "left").withColumn("group", F.coalesce("component", "node"))
    names = named.groupBy("group").agg(F.min("rep").alias("component_id"))
    of = named.join(names, "group").select("n", "s1", "s2", "group", "component_id")
    out = rows.join(of, ["n", "s1", "s2"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), "group", FILE, ROW)


def keep_representatives(docs: DataFrame, size: int = 5, percent: int = 80, **options) -> DataFrame:
    """docs with one row of each group of near duplicates, the one of the smallest doc_id (then the first); columns unchanged.

    Rows with an empty set are in no group and stay.
    """
    docs = located(docs)
    found = written(near_duplicates(docs, size, percent, **options).select("doc_id", "group", FILE, ROW))
    first = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col(FILE), F.col(ROW))).alias("first")
    kept = found.where("group is not null").groupBy("group").agg(first).select(F.col(f"first.{FILE}"), F.col(f"first.{ROW}"))
    kept = kept.unionByName(found.where("group is null").select(FILE, ROW))
    return docs.join(maybe_broadcast(kept, 16), [FILE, ROW], "left_semi").drop(FILE, ROW)


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shingle count and component under 4-word shingles and Jaccard of 0.85."""
    return near_duplicates(table(spark, sf_dir, "documents"), size=4, percent=85).drop("group", FILE, ROW)
