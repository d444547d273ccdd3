"""The whole path: files to Markdown, normalised, metadata dropped, detected and cleaned."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import unicode as U
from . import redact


def prepare(files: DataFrame, include_metadata: bool = False) -> DataFrame:
    """(doc_id, path, text) of readable files; a text is normalised before metadata goes."""
    text = T.normalize_markdown(F.col("text"))
    kept = files.filter("error IS NULL").withColumn("text", text)
    if not include_metadata:
        kept = kept.withColumn("text", U.remove_document_metadata("text"))
    return kept.withColumn("doc_id", F.xxhash64("path"))


def clean(files: DataFrame, detect: Callable[[DataFrame], DataFrame], mode: str = "replace", scope: str = "document", include_metadata: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(cleaned documents, detections, failed files with their typed error)."""
    docs = prepare(files, include_metadata)
    cleaned, found = redact.anonymise(docs, detect, mode, scope)
    return cleaned, found, files.filter("error IS NOT NULL").select("path", F.lit("extract").alias("stage"), "error")
