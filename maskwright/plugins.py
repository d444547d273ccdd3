"""Plug-in interfaces: model detectors, OCR, PDF reading and local language models.

None of these comes with the package. A plug-in is built once in each Python
worker from a picklable factory; a missing library is a clear error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import spans as S

SPANS = "doc_id long, start int, end int, entity_type string, score double"


class MissingPlugin(RuntimeError):
    """A plug-in's library or factory is not there."""


class Detector(Protocol):
    def detect(self, text: str, language: str) -> list: ...


class Reader(Protocol):
    """OCR or PDF: file bytes to text."""

    def read(self, content: bytes, language: str) -> str: ...


FACTORIES: dict[str, Callable[[], object]] = {}


def provide(name: str, factory: Callable[[], object]) -> None:
    FACTORIES[name] = factory


def require(name: str) -> Callable[[], object]:
    if name not in FACTORIES:
        raise MissingPlugin(f"no plug-in {name!r}: call maskwright.plugins.provide({name!r}, factory) first")
    return FACTORIES[name]


_built: dict[str, object] = {}


def span_fields(item) -> tuple:
    """(start, end, type, score) of a plug-in's span, an object or a mapping."""
    get = item.get if isinstance(item, dict) else lambda k: getattr(item, k)
    return get("start"), get("end"), get("entity_type"), float(get("score"))


def model_spans(docs: DataFrame, name: str, windows=None, language_col: str = "language") -> DataFrame:
    """Spans of a plug-in detector over documents (doc_id, text, language).

    ``windows``: a function of the text column to array<struct<offset, piece>>;
    then spans are shifted and of equal ones the best score stays.
    """
    factory = require(name)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if name not in _built:
            _built[name] = factory()
        for frame in frames:
            rows = [(d, int(o), *span_fields(s)) for d, o, t, lang in zip(frame["doc_id"], frame["offset"], frame["text"], frame["language"], strict=True) if t for s in _built[name].detect(t, lang)]
            yield pd.DataFrame(rows, columns=["doc_id", "offset", "start", "end", "entity_type", "score"])

    rows = docs.select("doc_id", F.col(language_col).alias("language"), "text")
    if windows is None:
        parts = rows.withColumn("offset", F.lit(0))
    else:
        parts = rows.withColumn("_w", F.explode(windows(F.col("text")))).select("doc_id", "language", F.col("_w.piece").alias("text"), F.col("_w.offset").alias("offset"))
    found = parts.mapInPandas(run, "doc_id long, offset int, start int, end int, entity_type string, score double")
    return S.dedup_max_score(S.shift(found))
