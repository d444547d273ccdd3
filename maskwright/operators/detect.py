"""Detectors: documents to spans.

Patterns run in the JVM. Offsets come from the text between the matches, which
counts code points whatever the characters. Word boundaries and classes are
Unicode's. Model detectors are plug-ins, see ``maskwright.plugins``.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import spans as S

#: The project's identifier shapes and scores.
PLATE = (r"(?U)\b[ABCDEFGHIJKLMNOPRSTUVXYZ]{3}-\d{3}\b", "PLATE", 0.85)
INVOICE = (r"(?U)\bINV-\d{5}\b", "INVOICE", 0.95)
PERSONAL_ID = (r"(?U)\b\d{6}[-+A]\d{3}[0-9ABCDEFHJKLMNPRSTUVWXY]\b", "PERSONAL_ID", 0.85)
BUSINESS_ID = (r"(?U)(?=\d)(?<![\w-])\d{7}-\d(?![\w-])", "FI_BUSINESS_ID", 0.85)
VAT = (r"(?iuU)(?<!\w)FI\s?\d{8}(?!\w)", "FI_VAT_NUMBER", 0.85)
#: Public formats. An address starts where its run of characters does, or after the match before, so a run is read once, not from each of its characters; a look at a first digit spares the test of a boundary everywhere else.
EMAIL = (r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}", "EMAIL_ADDRESS", 1.0)
IPV4 = (r"(?=\d)\b(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\b", "IP_ADDRESS", 0.6)
CARD = (r"(?=\d)\b\d{4}(?:[ -]?\d{4}){3}\b", "CREDIT_CARD", 0.5)
IBAN = (r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b", "IBAN_CODE", 0.5)
PHONE = (r"\+\d{1,3}(?:[ -]?\d{2,7}){2,4}\b", "PHONE_NUMBER", 0.4)
URL = (r"\bhttps?://[^\s<>\"]+", "URL", 0.5)
DATE = (r"(?=\d)\b\d{4}-\d{2}-\d{2}\b", "DATE_TIME", 0.6)
PROJECT = (PLATE, INVOICE, PERSONAL_ID)


#: Set around matches; a text that holds it itself takes the slower way.
MARK = "\x01"
#: Up to so many gaps and matches every offset is summed from the text's start; it gives the same and costs least.
FEW = 64


def match_array(text: Column, pattern: str) -> Column:
    """array<struct<start, end, value>> of the non-empty matches of a pattern.

    One pass of the regex engine puts marks around the matches; a split at the
    marks then gives gap, match, gap, … and sums of their lengths the offsets.
    """
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")

    def match(v, at):
        return F.struct(at.alias("start"), (at + F.length(v)).alias("end"), v.alias("value"))

    def each(parts):
        before = lambda k: F.aggregate(F.slice(parts, F.lit(1), 2 * k - 1), F.lit(0), lambda s, x: s + F.length(x))
        few = F.transform(F.sequence(F.lit(1), F.floor(F.size(parts) / 2).cast("int")), lambda k: T.let(before(k), lambda at: match(parts[2 * k - 1], at)))
        many = F.filter(F.zip_with(parts, T.starts(F.transform(parts, F.length)), match), lambda _, i: i % 2 == 1)
        return F.when(F.size(parts) <= 1, none).when(F.size(parts) <= FEW, few).otherwise(many)

    marked = F.split(F.regexp_replace(text, F.lit(pattern), F.lit(f"{MARK}$0{MARK}")), MARK, -1)
    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    woven = F.flatten(F.zip_with(gaps, F.concat(hits, F.array(F.lit(""))), lambda g, h: F.array(g, h)))
    slow = F.slice(woven, F.lit(1), F.size(woven) - 1)
    return T.let(F.when(F.contains(text, F.lit(MARK)), slow).otherwise(marked), each)


def _typed(matches: Column, entity_type: str, score: float) -> Column:
    return F.transform(matches, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.lit(entity_type).alias("entity_type"), F.lit(float(score)).alias("score"), m["value"].alias("value")))


def pattern_spans(docs: DataFrame, patterns=PROJECT, text_col: str = "text", keep_value: bool = False) -> DataFrame:
    """The spans of all patterns from one scan: the arrays of the patterns are joined and exploded once."""
    kept = docs.select("doc_id", F.col(text_col).alias("_t"))
    found = [_typed(match_array(F.col("_t"), p), t, s) for p, t, s in patterns]
    empty = F.array().cast("array<struct<start:int,end:int,entity_type:string,score:double,value:string>>")
    rows = kept.select("doc_id", F.explode(F.concat(*(F.coalesce(f, empty) for f in found))).alias("m")).select("doc_id", "m.*")
    return rows if keep_value else rows.drop("value")


def valid_cards(spans: DataFrame) -> DataFrame:
    """Card spans (with their value) whose digits pass the Luhn check."""
    return spans.filter(F.col("entity_type").isin("CREDIT_CARD") & F.call_function("luhn_check", F.regexp_replace("value", r"[^0-9]", "")))


def glossary_spans(docs: DataFrame, terms: list[str], text_col: str = "text") -> DataFrame:
    """Organisation names given by the operator: literal, trimmed, between word boundaries, in any case."""
    if isinstance(terms, str) or any(not isinstance(t, str) or not t.strip() for t in terms):
        raise ValueError("the glossary is a list of nonempty strings")
    patterns = [(r"(?iuU)(?<!\w)" + re.sub(r"([^\w\s])", r"\\\1", t.strip()) + r"(?!\w)", "ORGANIZATION", 1.0) for t in terms]
    return pattern_spans(docs, patterns, text_col) if patterns else pattern_spans(docs.limit(0), PROJECT, text_col)


def business_spans(docs: DataFrame, terms: list[str] = (), text_col: str = "text") -> DataFrame:
    found = pattern_spans(docs, (BUSINESS_ID, VAT), text_col)
    return found.unionByName(glossary_spans(docs, list(terms), text_col)) if terms else found


def detect_long(docs: DataFrame, detect: Callable[[DataFrame], DataFrame], limit: int = 100_000, overlap: int = 1000) -> DataFrame:
    """Detects long texts by overlapping pieces; of equal spans the best score stays."""
    short = docs.filter(F.length("text") <= limit)
    long = docs.filter(F.length("text") > limit).withColumn("_w", F.explode(T.line_windows(F.col("text"), limit, min(overlap, limit // 4))))
    parts = long.select(F.struct("doc_id", F.col("_w.offset").alias("offset")).alias("doc_id"), F.col("_w.piece").alias("text"))
    local = detect(parts).select(F.col("doc_id.doc_id").alias("doc_id"), F.col("doc_id.offset").alias("offset"), *S.SPAN)
    return detect(short).select("doc_id", *S.SPAN).unionByName(S.dedup_max_score(S.shift(local)).select("doc_id", *S.SPAN))


def mask_spans(docs: DataFrame, spans: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the characters of spans blacked out; offsets and line ends stay."""
    ranges = S.merge_touching(spans.select("doc_id", "start", "end")).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("_s"))
    masked = T.replaced(F.col(text_col), F.coalesce("_s", F.array().cast("array<struct<start:int,end:int>>")), lambda piece, _: T.mask(piece))
    return docs.join(ranges.hint("merge"), "doc_id", "left").withColumn(text_col, masked).drop("_s")


def final_pass(docs: DataFrame, base: DataFrame, second: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What the second detector finds where the base spans are blacked out, with the base spans."""
    return base.unionByName(second(mask_spans(docs, base)))


def union(*spans: DataFrame) -> DataFrame:
    """All spans of several detectors that read the same text, repeats included; one that is named several times runs once."""
    parts = [(s, sum(s is x for x in spans)) for i, s in enumerate(spans) if not any(s is x for x in spans[:i])]
    out, *rest = (s.select("*", F.explode(F.array_repeat(F.lit(0), n)).alias("_n")).drop("_n") if n > 1 else s for s, n in parts)
    for s in rest:
        out = out.unionByName(s)
    return out


def expand_returned(docs: DataFrame, found: DataFrame, strict: bool = True, size: int = 4000, overlap: int = 400) -> DataFrame:
    """Spans from a language model's answers (doc_id, offset, text, entity_type): every place of the text in its piece.

    Strict: an answer whose text its piece lacks fails the query; otherwise it is dropped.
    """
    parts = docs.select("doc_id", F.explode(T.pieces(F.col("text"), size, overlap)).alias("_p")).select("doc_id", F.col("_p.offset").alias("offset"), F.col("_p.piece").alias("piece"))
    met = found.withColumnRenamed("text", "value").join(parts, ["doc_id", "offset"], "left").withColumn("at", S.occurrences(F.col("piece"), F.col("value")))
    if strict:
        met = met.filter(F.assert_true(F.coalesce(F.size("at") > 0, F.lit(False)), "the model returned text that is not in the document").isNull())
    rows = met.withColumn("start", F.explode("at") + F.col("offset")).withColumn("end", F.col("start") + F.length("value"))
    return rows.select("doc_id", "start", "end", "entity_type", F.lit(1.0).alias("score")).distinct()


@dataclass(frozen=True)
class Method:
    """A named detector; those made of patterns alone share one scan when several run."""

    name: str
    run: Callable[[DataFrame], DataFrame]
    patterns: tuple = ()


#: Built-in methods. Others are added with ``register``.
METHODS: dict[str, Method] = {}


def register(name: str, run: Callable[[DataFrame], DataFrame] | None = None, patterns: tuple = ()) -> None:
    METHODS[name] = Method(name, run or (lambda docs: pattern_spans(docs, patterns)), patterns)


def get_method(name: str) -> Method:
    if name not in METHODS:
        raise ValueError(f"unknown method {name!r}; known: {', '.join(sorted(METHODS))}")
    return METHODS[name]


BASIC = (EMAIL, IPV4, DATE, PHONE)
register("basic", patterns=BASIC)
register("rules", patterns=BASIC + PROJECT)
register("rules-business", patterns=(*BASIC, *PROJECT, BUSINESS_ID, VAT))


def run_methods(docs: DataFrame, names: list[str]) -> DataFrame:
    """spans(method, doc_id, …) of several methods."""
    chosen = [get_method(n) for n in names]
    parts = [m.run(docs).select(F.lit(m.name).alias("method"), "doc_id", *S.SPAN) for m in chosen if not m.patterns]
    shared = [m for m in chosen if m.patterns]
    if shared:
        every = tuple(dict.fromkeys(p for m in shared for p in m.patterns))
        # by pattern, not by type: two methods may know one type by different patterns
        owners = F.array(*(F.array(*(F.lit(m.name) for m in shared if p in m.patterns)) for p in every))
        numbered = [(p, f"{i} {t}", s) for i, (p, t, s) in enumerate(every)]
        found = pattern_spans(docs, numbered).withColumn("_k", F.substring_index("entity_type", " ", 1).cast("int")).withColumn("entity_type", F.substring_index("entity_type", " ", -1))
        parts.append(found.select(F.explode(owners[F.col("_k")]).alias("method"), "doc_id", *S.SPAN))
    return union(*parts)
