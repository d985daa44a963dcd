"""Registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from patternfold.llm import licences
from patternfold.llm.attention_lm import op5_attention_lm
from patternfold.llm.content_store import op3_content_store
from patternfold.llm.jaccard_regions import op6_jaccard_regions
from patternfold.llm.language_bits import op4_language_bits
from patternfold.llm.ogg import op1_ogg
from patternfold.llm.ordinal_quality import op9_ordinal_quality
from patternfold.llm.packing import op10_packing
from patternfold.llm.rank_bpe import op7_rank_bpe
from patternfold.llm.weak_rules import op2_weak_rules

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ogg": op1_ogg,
    "op2_weak_rules": op2_weak_rules,
    "op3_content_store": op3_content_store,
    "op4_language_bits": op4_language_bits,
    "op5_attention_lm": op5_attention_lm,
    "op6_jaccard_regions": op6_jaccard_regions,
    "op7_rank_bpe": op7_rank_bpe,
    "op8_licences": licences.op8_licences,
    "op9_ordinal_quality": op9_ordinal_quality,
    "op10_packing": op10_packing,
}

ORACLE_SQL: dict[str, str] = {"op8_licences": licences.SQL}
