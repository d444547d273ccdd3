"""Functions that need Unicode normal forms or case folding, which Spark has not: Arrow-batched UDFs."""

from __future__ import annotations

import itertools
import re
import unicodedata

import numpy as np
import pandas as pd
import regex
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _each(s: pd.Series, fn) -> pd.Series:
    return s.map(fn, na_action="ignore")


@F.pandas_udf(T.StringType())
def normalize_layout(text: pd.Series) -> pd.Series:
    """NFC, <br> as space, escaped pipes as pipes, white space runs as one space."""
    return _each(text, lambda t: " ".join(unicodedata.normalize("NFC", t).replace("<br>", " ").replace(r"\|", "|").split()))


@F.pandas_udf(T.StringType())
def normalize_ocr(text: pd.Series) -> pd.Series:
    return _each(text, lambda t: " ".join(unicodedata.normalize("NFC", t).split()))


@F.pandas_udf(T.StringType())
def normalize_answer(text: pd.Series) -> pd.Series:
    """NFC, case folded, white space runs as one space, dots, quotes and spaces off the ends."""
    return _each(text, lambda t: " ".join(unicodedata.normalize("NFC", t).casefold().split()).strip('. "'))


@F.pandas_udf(T.StringType())
def normalize_compat(text: pd.Series) -> pd.Series:
    """NFKC, case folded, no white space."""
    return _each(text, lambda t: "".join(unicodedata.normalize("NFKC", t).casefold().split()))


@F.pandas_udf(T.StringType())
def fold_whitespace(text: pd.Series) -> pd.Series:
    return _each(text, lambda t: " ".join(t.casefold().split()))


#: What becomes one piece of a layout-normalised text: white space and breaks, an escaped pipe, a character with its combining marks.
PIECE = regex.compile(r"(?P<gap>(?:[\s\x1c-\x1f]|<br>)+)|\\(?P<pipe>\|)|(?s:.)\P{ccc=0}*")


def offsets_of(text: str) -> tuple[str, list[tuple[int, int]]]:
    """The layout-normalised text and the source range of each of its characters; combining marks belong to their base."""
    made = [(" " if m["gap"] else m["pipe"] or unicodedata.normalize("NFC", m[0]), m.span()) for m in PIECE.finditer(text)]
    first, last = (made and made[0][0] == " "), (made and made[-1][0] == " ")
    made = made[bool(first) : len(made) - bool(last)]
    return "".join(x for x, _ in made), [span for x, span in made for _ in x]


@F.udf(T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])), useArrow=True)
def source_ranges(text: str, value: str):
    """Where a layout-normalised value stands in the source text, overlapping places included."""
    if not text or not value:
        return []
    norm, ranges = offsets_of(text)
    want, _ = offsets_of(value)
    found, at = [], norm.find(want) if want else -1
    while at >= 0:
        found.append((ranges[at][0], ranges[at + len(want) - 1][1]))
        at = norm.find(want, at + 1)
    return found


# What opens and closes fenced code, a heading, and the title of the section that goes.
FENCE_OPENS = re.compile(r" {0,3}(?:(`{3,})[^`]*|(~{3,}).*)", re.S)
FENCE_CLOSES = re.compile(r"(?: {1,3}(?:\t[ \t]*)?)?(`+|~+)[ \t]*")
HEADING = re.compile(r" {0,3}(#{1,6})[ \t]+(.+?)[ \t]*#*[ \t]*", re.S)
METADATA = "document metadata"


def headings(lines: list[str]) -> list[tuple[int, int, str]]:
    """(line, level, title) of the headings outside fenced code."""
    found, mark = [], ""
    for i, line in enumerate(lines):
        if mark:
            closing = FENCE_CLOSES.fullmatch(line)
            mark = "" if closing and closing[1].startswith(mark) else mark
        elif opening := FENCE_OPENS.fullmatch(line):
            mark = opening[1] or opening[2]
        elif title := HEADING.fullmatch(line):
            found.append((i, len(title[1]), title[2].strip().casefold()))
    return found


def without_metadata(text: str) -> str:
    """The text without its document metadata sections, each of which ends where a heading of its level or a higher one stands."""
    lines = text.splitlines(keepends=True)
    table = headings([x.rstrip("\r\n") for x in lines])
    gone = np.zeros(len(lines), bool)
    for k, (at, level, title) in enumerate(table):
        if title == METADATA and not gone[at]:
            end = next((i for i, other, _ in itertools.islice(table, k + 1, None) if other <= level), len(lines))
            gone[at:end] = True
    return "".join(x for x, drop in zip(lines, gone, strict=True) if not drop)


@F.pandas_udf(T.StringType())
def remove_document_metadata(text: pd.Series) -> pd.Series:
    return _each(text, without_metadata)
