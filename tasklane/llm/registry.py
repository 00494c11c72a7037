"""Queries of the subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tasklane.llm import hard_negatives, licenses, mixing, url_filter
from tasklane.llm.best_fit import op13_best_fit_packing
from tasklane.llm.conversation_repair import op12_conversation_repair
from tasklane.llm.decontaminate import op3_benchmark_decontamination
from tasklane.llm.hard_negatives import op11_hard_negative_mining
from tasklane.llm.html_extract import op2_html_extract
from tasklane.llm.licenses import op6_license_scan
from tasklane.llm.mixing import op7_mixing_sources
from tasklane.llm.quality_rules import op10_quality_rules
from tasklane.llm.secret_scan import op8_secret_scan
from tasklane.llm.simhash import op9_simhash_near_dedup
from tasklane.llm.token_counts import op4_token_counts
from tasklane.llm.token_output import op5_token_output
from tasklane.llm.url_filter import op1_url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_url_filter, op2_html_extract, op3_benchmark_decontamination,
        op4_token_counts, op5_token_output, op6_license_scan,
        op7_mixing_sources, op8_secret_scan, op9_simhash_near_dedup,
        op10_quality_rules, op11_hard_negative_mining,
        op12_conversation_repair, op13_best_fit_packing)}

ORACLES: dict[str, str] = {
    "op1_url_filter": url_filter.oracle_sql(),
    "op6_license_scan": licenses.oracle_sql(),
    "op7_mixing_sources": mixing.oracle_sql(),
    "op11_hard_negative_mining": hard_negatives.oracle_sql()}
