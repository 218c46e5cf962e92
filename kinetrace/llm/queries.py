"""Registry of the text operators' queries and of the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kinetrace.llm import decontaminate, language_id, suffix_dedup
from kinetrace.llm.ann import op7_nearest_neighbours
from kinetrace.llm.decontaminate import op2_benchmark_decontamination
from kinetrace.llm.html_extract import op10_html_extraction
from kinetrace.llm.language_id import op5_language_id
from kinetrace.llm.near_dedup import op6_near_dedup
from kinetrace.llm.packing import op1_best_fit_packing
from kinetrace.llm.secret_scan import op8_secret_scan
from kinetrace.llm.sharding import op9_sharding
from kinetrace.llm.suffix_dedup import op3_suffix_dedup
from kinetrace.llm.token_count import op4_token_count

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_benchmark_decontamination": op2_benchmark_decontamination,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_token_count": op4_token_count,
    "op5_language_id": op5_language_id,
    "op6_near_dedup": op6_near_dedup,
    "op7_nearest_neighbours": op7_nearest_neighbours,
    "op8_secret_scan": op8_secret_scan,
    "op9_sharding": op9_sharding,
    "op10_html_extraction": op10_html_extraction,
}

#: The others are sequential, heuristic or made of hashes; tests/llm holds them against brute force.
ORACLE_SQL: dict[str, str] = {
    "op2_benchmark_decontamination": decontaminate.SQL,
    "op3_suffix_dedup": suffix_dedup.SQL,
    "op5_language_id": language_id.SQL,
}
