"""Queries of the corpus operators and, where SQL can express them, the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontaminate, huffman, html_text, language_id, licenses, media, near_duplicates, quality, recurrent_lm


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_license_scan": licenses.op1,
        "op2_quality_classifier": quality.op2,
        "op3_token_huffman": huffman.op3,
        "op4_html_text": html_text.op4,
        "op5_language_id": language_id.op5,
        "op6_recurrent_lm": recurrent_lm.op6,
        "op7_ngram_jaccard_join": near_duplicates.op7,
        "op8_media_clips": media.op8,
        "op9_decontamination": decontaminate.op9,
        "op10_bpe": bpe.op10,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_license_scan": licenses.SQL,
        "op4_html_text": html_text.SQL,
        "op7_ngram_jaccard_join": near_duplicates.SQL,
        "op8_media_clips": media.SQL,
        "op9_decontamination": decontaminate.SQL,
    }
