"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .chat import op8_chat_format
from .decontaminate import OP5_SQL, op5_benchmark_matches
from .language import op2_lm_score
from .lines import OP3_SQL, op3_line_dedup
from .near import OP10_ALL_SQL, OP10_SQL, op10_near_classes, op10_near_pairs_all
from .packing import op6_best_fit_packing
from .quality import op4_quality_rules
from .secrets import op1_secret_scan
from .toxicity import op7_toxicity
from .warc import op9_warc_derivatives

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_secret_scan, op2_lm_score, op3_line_dedup, op4_quality_rules, op5_benchmark_matches, op6_best_fit_packing, op7_toxicity, op8_chat_format, op9_warc_derivatives, op10_near_classes, op10_near_pairs_all)}
ORACLE_SQL: dict[str, str] = {"op3_line_dedup": OP3_SQL, "op5_benchmark_matches": OP5_SQL, "op10_near_classes": OP10_SQL, "op10_near_pairs_all": OP10_ALL_SQL}
