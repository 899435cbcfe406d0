"""Byte-level BPE encoding and decoding with forced boundaries.

A text is first cut at special tokens and by the vocabulary's word pattern. Within a word, every adjacent byte pair
that occurs inside no vocabulary token marks a certain cut: no merge can ever bridge it. The fragments between cuts
are encoded independently (lowest rank first, leftmost among equals; a heap for long fragments) and their ids
concatenated. Words repeat, so each task keeps the ids of the words it has met, up to a bounded number.

A null text counts as empty; an empty text has no ids. A text of any length is encoded whole. Repeated rows get equal
ids, and an empty table gives an empty result. Further columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.arrow import map_batches
from palimpsest.llm.common import table

#: Unicode white space (fixed values).
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Letters and numbers below U+0250, where Python's own engine can split (fixed values).
LETTER, NUMBER = r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f", r"0-9\xb2\xb3\xb9\xbc-\xbe"


def word_pattern(letter: str, number: str) -> str:
    """The vocabulary's word pattern; contractions, which start with a quote, may be tried after words and numbers."""
    return rf" ?[{letter}]+| ?[{number}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[^{SPACE}{letter}{number}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"


LATIN = re.compile(word_pattern(LETTER, NUMBER))
ANY = regex.compile(word_pattern(r"\p{L}", r"\p{N}"))
BEYOND = re.compile(r"[^\x00-\u024f]")


def split_words(text: str) -> list[str]:
    return (ANY if BEYOND.search(text) else LATIN).findall(text)


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in plain}
    rest = [b for b in range(256) if b not in out]
    return out | {b: chr(256 + k) for k, b in enumerate(rest)}


class ByteBPE:
    """A byte-level BPE vocabulary in the tokenizers library's JSON format."""

    def __init__(self, path: str, words: int = 400_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        of = {letter: b for b, letter in byte_letters().items()}
        raw = lambda token: bytes(of[c] for c in token)
        self.ids = {raw(t): i for t, i in spec["model"]["vocab"].items()}
        self.ranks = {(raw(a), raw(b)): k for k, (a, b) in enumerate(spec["model"]["merges"])}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.bytes_of = {str(i): t for t, i in self.ids.items()} | {str(i): t.encode() for t, i in self.special.items()}
        inside = bytearray(65536)
        for t in self.ids:
            for a, b in zip(t, t[1:]):
                inside[a << 8 | b] = 1
        self.inside = bytes(inside)
        self.single = [bytes([b]) for b in range(256)]
        self.known = _Words(self, words)

    def fragments(self, word: bytes) -> list[bytes]:
        """word, cut wherever its byte pair lies inside no token."""
        cuts = [k for k in range(1, len(word)) if not self.inside[word[k - 1] << 8 | word[k]]]
        return [word[a:b] for a, b in zip([0, *cuts], [*cuts, len(word)])] if cuts else [word]

    def encode_fragment(self, fragment: bytes) -> list[int]:
        if fragment in self.ids and len(fragment) == 1:
            return [self.ids[fragment]]
        parts = [self.single[b] for b in fragment]
        return [self.ids[p] for p in (self._merge_short(parts) if len(parts) <= 48 else self._merge_long(parts))]

    def _merge_short(self, parts: list[bytes]) -> list[bytes]:
        get, never = self.ranks.get, 1 << 30
        rank = [get(p, never) for p in zip(parts, parts[1:])]
        while rank and (best := min(rank)) != never:
            k = rank.index(best)
            joined = parts[k] = parts[k] + parts.pop(k + 1)
            del rank[k]
            if k:
                rank[k - 1] = get((parts[k - 1], joined), never)
            if k < len(rank):
                rank[k] = get((joined, parts[k + 1]), never)
        return parts

    def _merge_long(self, parts: list[bytes]) -> list[bytes]:
        n, ranks = len(parts), self.ranks
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(r, k, parts[k], parts[k + 1]) for k in range(n - 1) if (r := ranks.get((parts[k], parts[k + 1]))) is not None]
        heapq.heapify(heap)
        alive = [True] * n
        while heap:
            _, k, a, b = heapq.heappop(heap)
            j = after[k] if alive[k] else -1
            if j < 0 or parts[k] != a or parts[j] != b:
                continue
            parts[k], alive[j], after[k] = a + b, False, after[j]
            if after[j] >= 0:
                before[after[j]] = k
            for left, right in ((before[k], k), (k, after[k])):
                if left >= 0 and right >= 0 and (r := ranks.get((parts[left], parts[right]))) is not None:
                    heapq.heappush(heap, (r, left, parts[left], parts[right]))
        return [p for p, ok in zip(parts, alive) if ok]

    def encode_word(self, word: str) -> list[int]:
        return [i for f in self.fragments(word.encode("utf-8", "surrogatepass")) for i in self.encode_fragment(f)]

    def encode_joined(self, text: str) -> str:
        """The text's ids in decimal, joined by commas."""
        if not self.special_split or "<" not in text and not any(s in text for s in self.special):
            return ",".join(map(self.known.__getitem__, split_words(text)))
        parts = self.special_split.split(text)
        return ",".join(str(self.special[p]) if k % 2 else ",".join(map(self.known.__getitem__, split_words(p))) for k, p in enumerate(parts) if p)

    def encode(self, text: str) -> list[int]:
        return [int(i) for i in self.encode_joined(text).split(",") if i]

    def decode_joined(self, ids: str) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids.split(","))).decode("utf-8", "replace") if ids else ""

    def decode(self, ids: list[int]) -> str:
        return self.decode_joined(",".join(map(str, ids)))


class _Words(dict):
    """Word to joined ids; emptied when full, and not filled with long words, so its memory is bounded."""

    def __init__(self, bpe: ByteBPE, most: int):
        super().__init__()
        self.bpe, self.most = bpe, most

    def __missing__(self, word: str) -> str:
        out = ",".join(map(str, self.bpe.encode_word(word)))
        if len(word) <= 64:
            if len(self) >= self.most:
                self.clear()
            self[word] = out
        return out


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (decimal, joined by commas) and decoded for every row of docs."""

    def make():
        bpe = ByteBPE(path)

        def call(batch: pa.RecordBatch) -> list:
            ids = [bpe.encode_joined(t or "") for t in batch.column(1).to_pylist()]
            return [batch.column(0), ids, [bpe.decode_joined(i) for i in ids]]

        return call

    return map_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), "doc_id long, ids string, decoded string", make, rows=64)


def encode_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256: encode_documents with digests taken where the ids are made."""

    def make():
        bpe = ByteBPE(path)
        sha = lambda x: hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest()

        def call(batch: pa.RecordBatch) -> list:
            n, ids_sha, text_sha = [], [], []
            for t in batch.column(1).to_pylist():
                ids = bpe.encode_joined(t or "")
                n.append(ids.count(",") + 1 if ids else 0)
                ids_sha.append(sha(ids))
                text_sha.append(sha(bpe.decode_joined(ids)))
            return [batch.column(0), n, ids_sha, text_sha]

        return call

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_batches(narrow, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", make)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded with the byte-level vocabulary and decoded again."""
    import public_tokenizers

    return encode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
