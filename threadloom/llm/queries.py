"""The subpackage's entries for the query registry, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from threadloom.llm import decontaminate, html_text, line_dedup, media, mixing, ngram_join, quality, token_count, token_file, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality": quality.op1_quality,
        "op2_token_file": token_file.op2_token_file,
        "op3_html_text": html_text.op3_html_text,
        "op4_ngram_join": ngram_join.op4_ngram_join,
        "op5_mix": mixing.op5_mix,
        "op6_token_counts": token_count.op6_token_counts,
        "op7_media": media.op7_media,
        "op8_toxicity": toxicity.op8_toxicity,
        "op9_line_dedup": line_dedup.op9_line_dedup,
        "op10_decontaminate": decontaminate.op10_decontaminate,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_mix": mixing.OP5_SQL}
