"""Queries of this subpackage for __spark_entry__, and their DuckDB SQL."""

from __future__ import annotations

from .bloom_lm import op4_bloom_lm
from .bpe import op5_bpe
from .decontamination import OP8_SQL, op8_decontamination
from .language_id import op3_language_id
from .near_dedup import OP9_SQL, op9_near_dedup
from .preference import OP10_SQL, op10_preference_format
from .substring_dedup import OP1_SQL, op1_substring_dedup
from .token_files import op2_token_files
from .topk import OP6_SQL, op6_topk
from .toxicity import op7_toxicity

QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_token_files": op2_token_files,
    "op3_language_id": op3_language_id,
    "op4_bloom_lm": op4_bloom_lm,
    "op5_bpe": op5_bpe,
    "op6_topk": op6_topk,
    "op7_toxicity": op7_toxicity,
    "op8_decontamination": op8_decontamination,
    "op9_near_dedup": op9_near_dedup,
    "op10_preference_format": op10_preference_format,
}

ORACLES = {
    "op1_substring_dedup": OP1_SQL,
    "op6_topk": OP6_SQL,
    "op8_decontamination": OP8_SQL,
    "op9_near_dedup": OP9_SQL,
    "op10_preference_format": OP10_SQL,
}
