"""The corpus pipeline: quality rules, exact dedup, near duplicates, secrets, packing.

Each stage takes the documents that its predecessor kept, with their columns, and its decisions take effect: rejected
documents and surplus copies go, secrets are replaced in the text, and what remains is packed into sequences. Stages
hand over Parquet tables in the shared folder.

A null or empty text is too short for the quality rules and goes. Of repeated rows and equal texts one stays, of a group
of near copies the one of the smallest doc_id; a null doc_id stays only where its group has no other. Texts of any length
are treated whole, up to the last stage, which cuts them into pieces. An empty table gives an empty result. Further
columns, whatever their names, reach the last stage unchanged.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from palimpsest.llm.common import table, written
from palimpsest.llm.exact_dedup import keep_unique
from palimpsest.llm.jaccard_join import keep_representatives
from palimpsest.llm.packing import pack, pieces
from palimpsest.llm.quality_rules import passing
from palimpsest.llm.secrets import redacted


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that pass every rule."""
    return passing(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each normalised text."""
    return keep_unique(docs)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by 5-word shingles at a Jaccard similarity of 0.8 or more."""
    return keep_representatives(docs, size=5, percent=80)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets replaced."""
    return redacted(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 2048 tokens."""
    import public_tokenizers

    return pack(pieces(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_dedup),
    ("jaccard_join", jaccard_join),
    ("secret_scan", secret_scan),
    ("packing", packing),
]

#: Subword tokens cannot be made in SQL; tests/llm holds the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs)
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
