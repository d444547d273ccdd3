"""The queries of this folder and their SQL, for ``__spark_entry__.py``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, class_lm, decontaminate, embedding_dedup, html_extract, language_id, line_dedup, ngram_join, token_counts


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_html_extraction": html_extract.query,
        "op2_decontamination": decontaminate.query,
        "op3_token_counts": token_counts.query,
        "op4_lm_scoring": class_lm.query,
        "op5_bpe": bpe.query,
        "op6_ngram_jaccard_join": ngram_join.query,
        "op7_embedding_dedup": embedding_dedup.query,
        "op8_line_dedup": line_dedup.query,
        "op9_chat_formatting": chat.query,
        "op10_language_id": language_id.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op8_line_dedup": line_dedup.ORACLE_SQL, "op9_chat_formatting": chat.ORACLE_SQL}
