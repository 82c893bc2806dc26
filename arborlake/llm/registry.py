"""The queries of the corpus operators and the SQL that restates them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from arborlake.llm import decontaminate, language, packing, permutation_index, quality, sharding, simhash, substring_dedup, suffix_dedup, token_files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": substring_dedup.op1_substring_dedup,
    "op2_token_files": token_files.op2_token_files,
    "op3_simhash": simhash.op3_simhash,
    "op4_quality": quality.op4_quality,
    "op5_sharding": sharding.op5_sharding,
    "op6_decontamination": decontaminate.op6_decontamination,
    "op7_suffix_dedup": suffix_dedup.op7_suffix_dedup,
    "op8_packing": packing.op8_packing,
    "conversation_packing": packing.conversation_packing,
    "op9_permutation_index": permutation_index.op9_permutation_index,
    "op10_language": language.op10_language,
}

ORACLES: dict[str, str] = {"op1_substring_dedup": substring_dedup.ORACLE}
