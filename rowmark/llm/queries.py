"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rowmark.llm import (
    bpe, decontamination, exact_dedup, html_text, lexical_search, near_dedup, sharding, spelling_variants,
    substring_dedup, suffix_dedup, toxicity, url_filter, vector_search,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": suffix_dedup.op1_suffix_dedup,
    "op2_exact_dedup": exact_dedup.op2_exact_dedup,
    "op3_near_dedup": near_dedup.op3_near_dedup,
    "op4_html_extraction": html_text.op4_html_extraction,
    "op5_bpe": bpe.op5_bpe,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_benchmark_decontamination": decontamination.op7_benchmark_decontamination,
    "op8_rendezvous_shards": sharding.op8_rendezvous_shards,
    "op9_substring_dedup": substring_dedup.op9_substring_dedup,
    "op10_url_filter": url_filter.op10_url_filter,
    "op11_ranked_search": lexical_search.op11_ranked_search,
    "op12_vector_search": vector_search.op12_vector_search,
    "op13_spelling_variants": spelling_variants.op13_spelling_variants,
}

SQL: dict[str, str] = {
    "op2_exact_dedup": exact_dedup.SQL,
    "op7_benchmark_decontamination": decontamination.SQL,
    "op9_substring_dedup": substring_dedup.SQL,
    "op11_ranked_search": lexical_search.SQL,
}
