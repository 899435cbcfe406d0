"""Best-two-fit packing of tokenised documents into sequences of bounded length.

A document's ids get one end id; only a document longer than a sequence is cut, into full pieces and a last shorter
one. Full pieces are sequences of their own. The others are dealt over partitions of many pieces each; every
partition packs its own pieces: a bin is filled greedily with the largest piece that still fits; then its smallest
piece is given back if two unpacked pieces fill the gap so expanded more tightly. Pieces are held as counts by
length, so a partition's memory is a few numbers for each piece and never a text.

A null text is empty: its only id is the end id. Repeated rows are packed one by one. An empty table packs nothing. Texts
are encoded whole, whatever their length. Further columns of the documents, whatever their names, are not read.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.arrow import map_batches
from palimpsest.llm.bpe import BEYOND, LETTER, NUMBER, SPACE, byte_letters
from palimpsest.llm.common import table, written

#: What sends a text to the library: characters beyond, and the capitals whose lower-case form is beyond.
LIBRARY = re.compile("[^\\x00-\\x7f" + "".join(c for c in map(chr, range(0x80, 0x250)) if not BEYOND.search(c.lower())) + "]")
#: The vocabulary's word pattern on lower-cased text below U+0250 (fixed values).
WORD = re.compile(rf"[{LETTER}]+|'s|'t|'re|'ve|'m|'ll|'d|[{NUMBER}]|[^{SPACE}{LETTER}{NUMBER}]+")


class WordIds(dict):
    """Ids by the tokenizers library, kept for each word: word -> its ids as little-endian 32-bit numbers.

    A text that is below U+0250 also in lower case and has no special tokens is lower-cased and split here; any other text
    goes to the library as a whole. Emptied when full, so memory is bounded.
    """

    def __init__(self, path: str, most: int = 400_000):
        super().__init__()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.letters = byte_letters()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.most = most

    def whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, word: str) -> bytes:
        # A single word needs the library's model alone, on the letters that stand for its bytes.
        coded = word if word.isalpha() and word.isascii() else "".join(map(self.letters.__getitem__, word.encode()))
        out = np.asarray([t.id for t in self.model.tokenize(coded)], "<u4").tobytes()
        if len(word) <= 64:
            if len(self) >= self.most:
                self.clear()
            self[word] = out
        return out

    def ids(self, text: str) -> bytes:
        if LIBRARY.search(text) or any(s in text for s in self.special):
            return self.whole(text)
        return b"".join(map(self.__getitem__, WORD.findall(text.lower())))


def pieces(docs: DataFrame, path: str, most: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 (and, on demand, the ids as little-endian bytes) for every row of docs."""

    def make():
        words, end = WordIds(path), np.asarray([end_id], "<u4").tobytes()

        def call(batch: pa.RecordBatch) -> list:
            out: list[list] = [[] for _ in range(5 + keep_ids)]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = words.ids(text or "") + end
                for k in range(0, len(ids), 4 * most):
                    piece = ids[k : k + 4 * most]
                    for column, x in zip(out, (doc, k // (4 * most), k // 4, len(piece) // 4, zlib.crc32(piece), piece)):
                        column.append(x)
            return out

        return call

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_batches(narrow, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids, make)


def best_two_fit(lengths: Iterable[int], most: int) -> list[list[int]]:
    """Bins of lengths, each of at most ``most`` in all."""
    left = np.bincount(np.asarray(list(lengths), np.int64), minlength=most + 1).tolist()
    there = 0  # bit x: a piece of length x is unpacked
    for x, n in enumerate(left):
        if n:
            there |= 1 << x
    bins = []

    def take(x: int) -> None:
        nonlocal there
        left[x] -= 1
        if not left[x]:
            there &= ~(1 << x)

    while there:
        gap, own = most, []
        while gap and (x := (there & ((2 << gap) - 1)).bit_length() - 1) > 0:
            take(x)
            own.append(x)
            gap -= x
        if gap and len(own) > 1 and there:
            small = own[-1]
            room, found = gap + small, (small, 0, 0)
            a = (there & ((1 << room) - 1)).bit_length() - 1  # the larger of the two
            while 2 * a > small and a > 0 and 2 * a >= found[0]:
                b = (there & ((2 << min(a, room - a)) - 1)).bit_length() - 1
                if b == a and left[a] < 2:
                    b = (there & ((1 << a) - 1)).bit_length() - 1
                if b > 0 and a + b > found[0]:
                    found = (a + b, a, b)
                    if a + b == room:
                        break
                a = (there & ((1 << a) - 1)).bit_length() - 1
            if found[1]:
                own.pop()
                left[small] += 1
                there |= 1 << small
                for x in found[1:]:
                    take(x)
                    own.append(x)
        bins.append(own)
    return bins


def pack(parts: DataFrame, most: int = 2048, in_a_partition: int = 16_000) -> DataFrame:
    """parts (doc_id, piece, length, ...) with sequence_id and offset, gapless from 0 in each sequence."""
    parts = written(parts)
    n = max(1, -(-parts.count() // in_a_partition))
    columns = parts.columns
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in parts.schema) + ", sequence_id long, offset long"
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        rows = pa.Table.from_batches(list(batches), schema=pa.schema(list(arrow)[: len(columns)]))  # numbers only, about in_a_partition rows
        if not rows.num_rows:
            return
        length = rows.column("length").to_numpy()
        order = np.lexsort((rows.column("piece").to_numpy(), rows.column("doc_id").to_pandas().fillna(-1).to_numpy(), length))
        sequence, offset = np.empty(len(order), np.int64), np.zeros(len(order), np.int64)
        base = TaskContext.get().partitionId() << 32
        next_of = np.searchsorted(length[order], np.arange(most + 2)).tolist()
        for k, own in enumerate(best_two_fit(length, most)):
            at = 0
            for x in own:
                row = order[next_of[x]]
                next_of[x] += 1
                sequence[row], offset[row] = base + k, at
                at += x
        out = rows.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset)).cast(arrow)
        yield from out.to_batches(max_chunksize=10_000)

    # A random deal of single pieces gives every partition the same mix of lengths, also of one row that is repeated often.
    deal = f"__deal_{uuid.uuid4().hex}"
    dealt = parts.withColumn(deal, F.xxhash64(F.monotonically_increasing_id())).repartition(n, deal).drop(deal)
    return dealt.mapInArrow(run, schema)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    import public_tokenizers

    return pack(pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))
