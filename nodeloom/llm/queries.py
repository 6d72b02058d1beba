"""The queries of this subpackage: opN_<name>, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import exact_dedup, html_extract, mixing, near_dedup, passages, pieces, tool_calls, topk, toxicity, url_filter
from .common import table


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_exact_dedup": lambda s, d: exact_dedup.op1_exact_dedup(table(s, d, "documents")),
        "op2_toxicity": lambda s, d: toxicity.op2_toxicity(table(s, d, "documents"), table(s, d, "labels")),
        "op3_near_dedup": lambda s, d: near_dedup.op3_near_dedup(table(s, d, "documents")),
        "op4_tool_calls": lambda s, d: tool_calls.op4_tool_calls(table(s, d, "conversations")),
        "op5_html_extract": lambda s, d: html_extract.op5_html_extract(table(s, d, "pages")),
        "op6_mixing": lambda s, d: mixing.op6_mixing(table(s, d, "documents")),
        "op7_url_filter": lambda s, d: url_filter.op7_url_filter(table(s, d, "pages")),
        "op8_substring_dedup": lambda s, d: passages.op8_substring_dedup(table(s, d, "documents")),
        "op9_sentencepiece": lambda s, d: pieces.op9_sentencepiece(table(s, d, "documents")),
        "op10_topk": lambda s, d: topk.op10_topk(table(s, d, "embeddings")),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_exact_dedup": exact_dedup.OP1_SQL,
        "op4_tool_calls": tool_calls.OP4_SQL,
        "op7_url_filter": url_filter.op7_sql(),
        "op10_topk": topk.OP10_SQL,
    }
