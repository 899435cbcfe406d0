"""Removal of repeated substrings of ``least`` bytes, found in suffix arrays.

A string of ``least`` bytes is here called a window. Every window has one anchor: the leftmost of its k-grams with
the smallest hash (upper half). Equal windows have equal anchors at the same distance, so they meet under the anchor's hash, and
all windows of a text that share an anchor form one segment of less than 2 * ``least`` bytes.

1. Segments whose anchor hash occurs once in the corpus hold no repeated window and are left out.
2. Segments that are equal as a whole (same anchor hash, same shape, same SHA-1 to 64 bits) are taken together with a
   count; one text of each is fetched. All windows of a segment that occurs more than once are repeated.
3. Under each anchor hash with more than one distinct segment, the suffix array of these is built by Lyndon groups
   (lyndon_sort): short collections many at a time, long ones one by one. Windows that begin at neighbouring suffixes
   and agree in all bytes are repeated. A segment that is alone under its hash but for its own copies needs no array.
4. An anchor hash with more than ``most_bytes`` of distinct segments is dealt anew: its windows are grouped by
   sixteen neighbouring distances to the anchor, and each group goes under the hash of the bytes that all its windows
   share. What is still crowded is dealt by whole windows: each window is a collection of its own, whose count alone
   decides, so that no task ever has to hold an unbounded collection.
5. Repeated windows go back to their documents, which are cut in one pass.

Texts are whole UTF-8 byte strings of any length; matches never cross texts; nulls are empty; repeated rows repeat each
other. An empty table gives an empty result. Further columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.arrow import map_batches
from palimpsest.llm.common import FILE, ROW, located, small_enough, table, written
from palimpsest.llm.lyndon_sort import suffix_order, suffix_orders
from palimpsest.llm.shingles import _power, in_chunks, mix

GRAM = 48
LOW = np.uint64(0xFFFFFFFF)


def _range_hashes(total: np.ndarray, down: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    return mix((total[stop] - total[start]) * down[start])


def anchors(texts: list[str | None], least: int = 200) -> tuple[np.ndarray, ...]:
    """(text, low, distance, span, anchor hash, segment digest) of every segment of the texts.

    A segment has the windows that start at low .. low + span; its anchor lies ``distance`` bytes after low.
    """
    coded = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    sizes = np.asarray([len(c) for c in coded], np.int64)
    joined = b"".join(coded)
    data = np.frombuffer(joined, np.uint8)
    up, down = _power(len(data) + 1)
    total = np.empty(len(data) + 1, np.uint64)
    total[0] = 0
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    n = len(data) - GRAM + 1
    width = least - GRAM + 1
    if n < width:
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    at = np.arange(n)
    grams = _range_hashes(total, down, at, at + GRAM)
    # The leftmost minimum of each run of ``width`` grams, from runs of doubling length: a gram's place under the upper
    # half of its hash, so that one comparison settles both.
    best, run = grams & ~LOW | at.astype(np.uint64), 1
    while run < width:
        step = min(run, width - run)
        best = np.minimum(best[: len(best) - step], best[step:])
        run += step
    begin = np.cumsum(sizes) - sizes
    starts = np.concatenate([np.arange(b, b + s - least + 1) for b, s in zip(begin.tolist(), sizes.tolist()) if s >= least] or [np.zeros(0, np.int64)])
    if not len(starts):
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    owner = np.repeat(np.arange(len(sizes)), np.maximum(0, sizes - least + 1))
    anchor = (best[starts] & LOW).astype(np.int64)
    head = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1]))))
    low, span = starts[head], np.diff(np.append(head, len(starts))) - 1
    distance = anchor[head] - low
    # A cryptographic digest: segments of one anchor hash and shape that agree in it count as equal in all bytes.
    segment = np.frombuffer(b"".join([hashlib.sha1(joined[a:b]).digest()[:8] for a, b in zip(low.tolist(), (low + span + least).tolist())]), "<i8")
    return owner[head], low - begin[owner[head]], distance, span, grams[anchor[head]].view(np.int64), segment


def _segments(texts: DataFrame, least: int) -> DataFrame:
    """h, s, low, shape (distance * 1024 + span) and locator of every segment."""

    def make():
        def call(batch: pa.RecordBatch) -> list:
            texts, file, row = batch.column(0).to_pylist(), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            out: list[list] = [[] for _ in range(6)]
            for a, b in in_chunks(texts):
                owner, low, distance, span, h, s = anchors(texts[a:b], least)
                for column, x in zip(out, (h, s, low, distance * 1024 + span, file[a:b][owner], row[a:b][owner])):
                    column.append(x)
            return [np.concatenate(x) if x else np.zeros(0, np.int64) for x in out]

        return call

    return map_batches(texts.select("text", FILE, ROW), f"h long, s long, low long, shape long, {FILE} long, {ROW} long", make)


def repeated_in(segments: list[bytes], least: int) -> list[np.ndarray]:
    """For each segment of one collection, which of its windows begins with the same bytes as another one of the collection."""
    return _repeated([segments], least)[0]


def _repeated(collections: list[list[bytes]], least: int) -> list[list[np.ndarray]]:
    """repeated_in for many collections at once."""
    data = b"".join(s + b"\0" for c in collections for s in c)
    raw = np.frombuffer(data, np.uint8)
    lengths = np.asarray([sum(len(s) + 1 for s in c) for c in collections], np.int64)
    ends = np.cumsum(lengths)
    text = raw.astype(np.int32) + 2
    pieces = [len(s) for c in collections for s in c]
    borders = np.cumsum(np.asarray(pieces, np.int64) + 1) - 1
    text[borders] = 1  # a border is lower than all bytes, a collection's last one lower than all borders
    text[ends - 1] = 0
    if len(collections) == 1:
        order = np.asarray(suffix_order(text.tolist()), np.int64)
    else:
        order = suffix_orders(text, lengths)
    room = np.repeat(borders, np.asarray(pieces, np.int64) + 1) - np.arange(len(raw))  # bytes up to the segment's end
    first, second = order[:-1], order[1:]
    near = np.flatnonzero((room[first] >= least) & (room[second] >= least))
    marked = np.zeros(len(raw), bool)
    if len(near):
        windows = np.lib.stride_tricks.sliding_window_view(raw, least)
        for k in range(0, len(near), 20_000):
            a, b = first[near[k : k + 20_000]], second[near[k : k + 20_000]]
            same = (windows[a] == windows[b]).all(axis=1)
            marked[a[same]] = True
            marked[b[same]] = True
    out, at = [], 0
    for c in collections:
        own = []
        for s in c:
            own.append(marked[at : at + max(0, len(s) - least + 1)])
            at += len(s) + 1
        out.append(own)
    return out


def _sorted_marks(content: DataFrame, least: int, batch_bytes: int = 2_500_000, short: int = 6_000) -> DataFrame:
    """h, s, shape, marks (packed bits, one for each window) of the segments that have a repeated window."""
    schema = pa.schema([("h", pa.int64()), ("s", pa.int64()), ("shape", pa.int64()), ("marks", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[list[tuple]]] = {}  # by size class: rounds are as many as the longest collection needs
        sizes: dict[int, int] = {}
        whole: list[tuple] = []  # lone segments, all of whose windows are repeated

        def flush(collections: list[list[tuple]]) -> pa.RecordBatch:
            rows = []
            for c, marks in zip(collections, _repeated([[x[4] for x in c] for c in collections], least)):
                for (h, s, shape, count, _), m in zip(c, marks):
                    m = np.ones(len(m), bool) if count > 1 else m
                    if m.any():
                        rows.append((h, s, shape, np.packbits(m).tobytes()))
            return batch_of(rows)

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)

        def close(c: list[tuple]) -> Iterator[pa.RecordBatch]:
            if len(c) == 1 and c[0][3] > 1:
                whole.append((*c[0][:3], np.packbits(np.ones(len(c[0][4]) - least + 1, bool)).tobytes()))
                if len(whole) >= 5_000:
                    yield batch_of(whole)
                    whole.clear()
                return
            own = sum(len(x[4]) + 1 for x in c)
            if own > short:
                yield flush([c])
                return
            kind = (own // 400).bit_length()
            held.setdefault(kind, []).append(c)
            sizes[kind] = sizes.get(kind, 0) + own
            if sizes[kind] >= batch_bytes:
                yield flush(held.pop(kind))
                sizes[kind] = 0

        now: list[tuple] = []
        for batch in batches:
            for r in zip(*(batch.column(k).to_pylist() for k in range(5))):
                if now and r[0] != now[0][0]:
                    yield from close(now)
                    now = []
                now.append(r)
        if now:
            yield from close(now)
        for c in held.values():
            yield flush(c)
        if whole:
            yield batch_of(whole)

    dealt = content.select("h", "s", "shape", "count", "segment").repartition("h").sortWithinPartitions("h", "s")
    return dealt.mapInArrow(run, "h long, s long, shape long, marks binary")


def _by_place(places: DataFrame, docs: DataFrame, *columns: str) -> tuple[DataFrame, DataFrame]:
    """(docs that are named in places, with their lists of the columns; the other docs)."""
    lists = places.groupBy(FILE, ROW).agg(F.collect_list(F.struct(*columns)).alias("places"))  # as long as one document at most
    named = places.select(FILE, ROW).distinct()
    named = F.broadcast(named) if small_enough(named, 16) else named
    key = [FILE, ROW]
    return docs.join(named, key, "left_semi").join(lists.hint("shuffle_merge"), key), docs.join(named, key, "left_anti")


def _fetched(distinct: DataFrame, docs: DataFrame, least: int) -> DataFrame:
    """distinct (h, s, shape, count, low and locator of one occurrence) with the segment's bytes."""

    def make():
        def call(batch: pa.RecordBatch) -> list:
            out: list[list] = [[] for _ in range(5)]
            for text, places in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                data = (text or "").encode("utf-8", "surrogatepass")
                for p in places:
                    for column, x in zip(out, (p["h"], p["s"], p["shape"], p["count"], data[p["low"] : p["low"] + p["shape"] % 1024 + least])):
                        column.append(x)
            return out

        return call

    named, _ = _by_place(distinct, docs, "h", "s", "shape", "count", "low")
    return map_batches(named.select("text", "places"), "h long, s long, shape long, count long, segment binary", make, rows=64)


def _window_marks(content: DataFrame, least: int) -> DataFrame:
    """_sorted_marks for crowded anchors: windows are dealt by their own bytes."""

    def make():
        def call(batch: pa.RecordBatch) -> list:
            out: list[list] = [[] for _ in range(6)]
            for h, s, shape, count, segment in zip(*(batch.column(k).to_pylist() for k in range(5))):
                for k in range(len(segment) - least + 1):
                    for column, x in zip(out, (h, s, shape, k, count, hashlib.md5(segment[k : k + least]).digest())):
                        column.append(x)
            return out

        return call

    windows = written(map_batches(content.select("h", "s", "shape", "count", "segment"), "h long, s long, shape long, k long, count long, w binary", make))
    often = windows.groupBy("h", "w").agg(F.sum("count").alias("n")).where("n > 1").select("h", "w")
    hits = windows.join(often, ["h", "w"]).groupBy("h", "s", "shape").agg(F.collect_list("k").alias("ks"))

    def pack():
        def call(batch: pa.RecordBatch) -> list:
            marks = []
            for shape, ks in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                m = np.zeros(shape % 1024 + 1, bool)
                m[ks] = True
                marks.append(np.packbits(m).tobytes())
            return [batch.column(0), batch.column(1), batch.column(2), marks]

        return call

    return map_batches(hits, "h long, s long, shape long, marks binary", pack)


def _regrouped(content: DataFrame, least: int, step: int = 16) -> DataFrame:
    """content of crowded anchors in shorter segments under new hashes, with the old keys (h0, s0, shape0) and the first window."""

    def make():
        def call(batch: pa.RecordBatch) -> list:
            out: list[list] = [[] for _ in range(9)]
            digest = lambda x: int.from_bytes(hashlib.md5(x).digest()[:8], "little", signed=True)
            for h, s, shape, count, segment in zip(*(batch.column(k).to_pylist() for k in range(5))):
                distance, span = divmod(shape, 1024)
                k = 0
                while k <= span:
                    group = (distance - k) // step
                    last = min(span, distance - group * step)
                    at = distance - group * step  # where the window nearest to the anchor begins, in this segment's bytes
                    core = segment[max(at, 0) : at + least - step + 1]
                    piece = segment[k : last + least]
                    row = (digest(core + h.to_bytes(8, "little", signed=True) + group.to_bytes(2, "little")), digest(piece), (distance - k) * 1024 + last - k, count, piece, h, s, shape, k)
                    for column, x in zip(out, row):
                        column.append(x)
                    k = last + 1
            return out

        return call

    return map_batches(content.select("h", "s", "shape", "count", "segment"), "h long, s long, shape long, count long, segment binary, h0 long, s0 long, shape0 long, k0 long", make)


def _crowded(content: DataFrame, most_bytes: int) -> DataFrame:
    found = written(content.groupBy("h").agg(F.sum(F.length("segment")).alias("bytes")).where(F.col("bytes") > most_bytes).select("h"))
    return F.broadcast(found) if small_enough(found, 16) else found


def _crowded_marks(content: DataFrame, least: int, most_bytes: int) -> DataFrame:
    """h, s, shape, marks for crowded anchors."""
    parts = written(_regrouped(content, least))
    pieces = written(parts.groupBy("h", "s", "shape").agg(F.sum("count").alias("count"), F.first("segment").alias("segment")))
    many = _crowded(pieces, most_bytes)
    marks = _sorted_marks(pieces.join(many, "h", "left_anti"), least)
    if not many.isEmpty():
        marks = marks.union(_window_marks(pieces.join(many, "h", "left_semi"), least))
    back = parts.select("h", "s", "shape", "h0", "s0", "shape0", "k0").join(written(marks), ["h", "s", "shape"])
    lists = back.groupBy("h0", "s0", "shape0").agg(F.collect_list(F.struct("k0", "shape", "marks")).alias("parts"))

    def make():
        def call(batch: pa.RecordBatch) -> list:
            out = []
            for shape, parts in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                m = np.zeros(shape % 1024 + 1, bool)
                for p in parts:
                    n = p["shape"] % 1024 + 1
                    m[p["k0"] : p["k0"] + n] |= np.unpackbits(np.frombuffer(p["marks"], np.uint8))[:n].astype(bool)
                out.append(np.packbits(m).tobytes())
            return [batch.column(0), batch.column(1), batch.column(2), out]

        return call

    return map_batches(lists, "h long, s long, shape long, marks binary", make)


def _cut(texts: list[bytes], places: pa.ListArray, least: int) -> list[tuple[int, int, bytes]]:
    """(bytes removed, spans removed, what is left) of each text with repeated windows; a text without places stays whole."""
    flat = places.flatten()
    if not len(flat):
        return [(0, 0, t) for t in texts]
    doc = np.repeat(np.arange(len(texts)), pc.fill_null(pc.list_value_length(places), 0).to_numpy(zero_copy_only=False))
    marks = flat.field("marks").to_pylist()
    size = np.fromiter(map(len, marks), np.int64, len(marks))
    bit = np.flatnonzero(np.unpackbits(np.frombuffer(b"".join(marks), np.uint8)))
    ends = np.cumsum(size)
    place = np.searchsorted(8 * ends, bit, "right")  # whose mark each bit is
    base = flat.field("low").to_numpy(zero_copy_only=False) - 8 * (ends - size)
    starts = np.unique((doc[place].astype(np.int64) << 32) + base[place] + bit)
    # Runs of windows that touch or overlap are removed as one span; texts lie further apart than any window.
    first = np.flatnonzero(np.concatenate(([True], starts[1:] - starts[:-1] > least)))
    begin, end = starts[first], starts[np.append(first[1:], len(starts)) - 1] + least
    spans = np.searchsorted(begin >> 32, np.arange(len(texts) + 1))
    begin, end, out = (begin & 0xFFFFFFFF).tolist(), (end & 0xFFFFFFFF).tolist(), []
    for k, t in enumerate(texts):
        a, b = spans[k], spans[k + 1]
        kept = b"".join(t[x:y] for x, y in zip([0, *end[a:b]], [*begin[a:b], len(t)]))
        out.append((len(t) - len(kept), int(b - a), kept))
    return out


def cut_repeats(docs: DataFrame, least: int = 200, most_bytes: int = 1 << 18, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes) of every row of docs."""
    if not GRAM <= least < 1024:
        raise ValueError(f"least must be {GRAM} to 1023")
    docs = located(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), FILE, ROW)
    every = written(_segments(docs, least))
    twice = written(every.groupBy("h").count().where("count > 1").select("h"))  # a table, so that the join can split a hot anchor
    shared = written(every.join(twice.hint("shuffle_merge"), "h"))
    distinct = shared.groupBy("h", "s", "shape").agg(F.count(F.lit(1)).alias("count"), F.min(F.struct(FILE, ROW, "low")).alias("one"))
    distinct = written(distinct.select("h", "s", "shape", "count", "one.*"))
    content = written(_fetched(distinct, docs, least))
    crowd = _crowded(content, most_bytes)
    marks = _sorted_marks(content.join(crowd, "h", "left_anti"), least)
    if not crowd.isEmpty():
        marks = marks.union(_crowded_marks(content.join(crowd, "h", "left_semi"), least, most_bytes))
    marks = written(marks)
    places = written(shared.join(marks.hint("shuffle_merge"), ["h", "s", "shape"]).select(FILE, ROW, "low", "shape", "marks"))
    named, rest = _by_place(places, docs, "low", "shape", "marks")
    both = named.select("doc_id", "text", "places").unionByName(rest.select("doc_id", "text", F.lit(None).cast("array<struct<low:long,shape:long,marks:binary>>").alias("places")))

    def make():
        def call(batch: pa.RecordBatch) -> list:
            texts = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column(1).to_pylist()]
            return [batch.column(0), [len(t) for t in texts], *zip(*_cut(texts, batch.column(2), least))]

        return call

    return map_batches(both, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary", make, rows=128)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the 200-byte strings that occur more than once."""
    out = cut_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
