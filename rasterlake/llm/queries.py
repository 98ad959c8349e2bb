"""The queries of this subpackage, by name, and their DuckDB SQL where SQL can say what they do."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rasterlake.llm.byte_bpe import op9_byte_bpe
from rasterlake.llm.language import op10_language
from rasterlake.llm.license_scan import LICENSE_SCAN_SQL, op8_license_scan
from rasterlake.llm.line_dedup import op2_line_dedup
from rasterlake.llm.line_rules import LINE_RULES_SQL, op4_line_rules
from rasterlake.llm.ngram_join import op7_ngram_join
from rasterlake.llm.quality import op3_quality
from rasterlake.llm.source_mix import SOURCE_MIX_SQL, op1_source_mix
from rasterlake.llm.toxicity import op6_toxicity
from rasterlake.llm.vector_search import op5_nearest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_source_mix": op1_source_mix,
    "op2_line_dedup": op2_line_dedup,
    "op3_quality": op3_quality,
    "op4_line_rules": op4_line_rules,
    "op5_nearest": op5_nearest,
    "op6_toxicity": op6_toxicity,
    "op7_ngram_join": op7_ngram_join,
    "op8_license_scan": op8_license_scan,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_language": op10_language,
}

SQL: dict[str, str] = {
    "op1_source_mix": SOURCE_MIX_SQL,
    "op4_line_rules": LINE_RULES_SQL,
    "op8_license_scan": LICENSE_SCAN_SQL,
}
