"""The queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from palimpsest.llm.bpe import op2_bpe
from palimpsest.llm.classifier import op8_classifier
from palimpsest.llm.collocations import OP12_SQL, op12_collocations
from palimpsest.llm.exact_dedup import OP6_SQL, op6_exact_dedup
from palimpsest.llm.hard_negatives import OP13_SQL, op13_hard_negatives
from palimpsest.llm.jaccard_join import op7_jaccard_join
from palimpsest.llm.line_dedup import OP11_SQL, op11_line_dedup
from palimpsest.llm.packing import op9_packing
from palimpsest.llm.quality_rules import OP4_SQL, op4_quality_rules
from palimpsest.llm.secrets import op5_secrets
from palimpsest.llm.sharding import op1_sharding
from palimpsest.llm.substring_dedup import op3_substring_dedup
from palimpsest.llm.url_filters import OP10_SQL, op10_url_filters


def queries() -> dict:
    return {
        "op1_sharding": op1_sharding,
        "op2_bpe": op2_bpe,
        "op3_substring_dedup": op3_substring_dedup,
        "op4_quality_rules": op4_quality_rules,
        "op5_secrets": op5_secrets,
        "op6_exact_dedup": op6_exact_dedup,
        "op7_jaccard_join": op7_jaccard_join,
        "op8_classifier": op8_classifier,
        "op9_packing": op9_packing,
        "op10_url_filters": op10_url_filters,
        "op11_line_dedup": op11_line_dedup,
        "op12_collocations": op12_collocations,
        "op13_hard_negatives": op13_hard_negatives,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_quality_rules": OP4_SQL, "op6_exact_dedup": OP6_SQL, "op10_url_filters": OP10_SQL, "op11_line_dedup": OP11_SQL, "op12_collocations": OP12_SQL, "op13_hard_negatives": OP13_SQL}
