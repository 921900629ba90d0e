"""The training-data queries by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quartzite.llm import licences
from quartzite.llm.compression import op8_quality_classifier
from quartzite.llm.decontaminate import op4_benchmark_decontamination
from quartzite.llm.extract import op9_html_extraction
from quartzite.llm.licences import op5_license_scan
from quartzite.llm.linededup import op1_line_dedup
from quartzite.llm.pieces import op10_sentencepiece
from quartzite.llm.rules import op3_quality_rules
from quartzite.llm.simhash import op6_simhash_near_dedup
from quartzite.llm.substrings import op7_suffix_array_dedup
from quartzite.llm.warc import op2_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_warc": op2_warc,
    "op3_quality_rules": op3_quality_rules,
    "op4_benchmark_decontamination": op4_benchmark_decontamination,
    "op5_license_scan": op5_license_scan,
    "op6_simhash_near_dedup": op6_simhash_near_dedup,
    "op7_suffix_array_dedup": op7_suffix_array_dedup,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_html_extraction": op9_html_extraction,
    "op10_sentencepiece": op10_sentencepiece,
}

ORACLES: dict[str, str] = {"op5_license_scan": licences.oracle()}
