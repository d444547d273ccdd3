"""Evaluations by named groups (images, stages, policies, tools) and checks that frozen inputs are unchanged."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import redact as R
from . import spans as S
from .report import ratio

#: The entity types that each prompt of a local model asks for.
PROFILES = {
    "identifiers": ["PERSON", "ORGANIZATION", "LOCATION", "EMAIL_ADDRESS", "PHONE_NUMBER", "IBAN_CODE", "DATE_TIME", "PERSONAL_ID", "CREDIT_CARD", "PLATE", "INVOICE", "QUASI_IDENTIFIER"],
    "contextual": ["IDENTIFIER_CODE", "ORGANIZATION", "PROJECT_OR_PRODUCT", "SYSTEM_NAME", "PERSON", "QUASI_IDENTIFIER"],
}
#: Candidate types that count as another.
CANDIDATE_TYPES = {"AGE": "DATE_TIME"}
PRESERVE = "preserve_detection"


def by_sets(rows: DataFrame, sets: list[list[str]], *measures) -> DataFrame:
    """One aggregate over several sets of keys in a single pass; ``all`` stands where a set lacks a key."""
    keys = list(dict.fromkeys(k for s in sets for k in s))
    names = [F.when(F.grouping(k) == 1, "all").otherwise(F.col(k)).alias(f"_{k}") for k in keys]
    out = rows.groupingSets([[F.col(k) for k in s] for s in sets], *map(F.col, keys)).agg(*measures, *names)
    return out.drop(*keys).withColumnsRenamed({f"_{k}": k for k in keys})


def _or_zero(a, b):
    return F.coalesce(ratio(a, b), F.lit(0.0))


def in_profile(spans: DataFrame, profile: str) -> DataFrame:
    """Spans of the types that a prompt asks for."""
    return spans.filter(F.col("entity_type").isin(PROFILES[profile]))


def word_occurrences(words: DataFrame, values: DataFrame) -> DataFrame:
    """words(doc_id, idx, text, line), values(doc_id, value): one row for each place of a value with the numbers of its words.

    A value may run across lines: a line's end counts as a space. The ends of a
    place may lie within words.
    """
    laid = R.layout(words).select("doc_id", "idx", "text", "start", "end")
    spoken = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "text"))), lambda w: w["text"]), " ")
    places = S.label_places(values.distinct(), laid.groupBy("doc_id").agg(spoken.alias("text"))).filter("start IS NOT NULL").select("doc_id", "value", "start", "end")
    met = places.alias("p").join(laid.select("doc_id", "idx", "start", "end").alias("w"), (F.col("p.doc_id") == F.col("w.doc_id")) & S.overlaps("p", "w"))
    return met.groupBy("p.doc_id", "p.value", "p.start").agg(F.array_sort(F.collect_list("idx")).alias("words"))


def image_summary(documents: DataFrame, entities: DataFrame, *keys: str) -> DataFrame:
    """documents(doc_id, word counts, seconds), entities(doc_id, state, text_hidden) by the keys.

    Shares of nothing are 0, those of no planted value null.
    """
    counted = ("words", "words_blacked", "other_words", "other_words_blacked")
    states = ("unread", "hidden", "partial", "leaked")
    each = entities.groupBy("doc_id").agg(F.count("*").alias("planted"), *(F.count_if(F.col("state") == s).alias(s) for s in states), F.count_if("text_hidden").alias("text_hidden"))
    added = ("planted", *states, "text_hidden")
    met = documents.join(each, "doc_id", "left").fillna(0, list(added))
    out = met.groupBy(*keys).agg(F.count("*").alias("documents"), *(F.sum(c).alias(c) for c in (*added, *counted)), F.avg("seconds").alias("seconds_per_image"))
    c = F.col
    return out.withColumn("readable_before", c("planted") - c("unread")).withColumns({
        "image_recall": _or_zero(c("hidden"), c("readable_before")), "hidden_of_planted": ratio(c("hidden"), c("planted")), "text_recall": ratio(c("text_hidden"), c("planted")),
        "over_redaction": _or_zero(c("words_blacked"), c("words")), "other_words_redacted": _or_zero(c("other_words_blacked"), c("other_words")),
    })


def stage_summary(scored: DataFrame, sets: list[list[str]]) -> DataFrame:
    """Labels scored in each stage of the path, with their occurrences, over several sets of keys."""
    flags, sums = ("extracted", "extraction_incomplete", "whole", "partial"), ("whole_occurrences", "partial_occurrences", "missed_occurrences", "missing_occurrences_minimum")
    out = by_sets(scored, sets, F.count("*").alias("labels"), *(F.count_if(f).alias(f) for f in flags), *(F.sum(s).alias(s) for s in sums))
    return out.withColumn("occurrences", sum((F.col(s) for s in sums[:3]), F.lit(0))).withColumn("missed", F.col("labels") - F.col("whole") - F.col("partial")).withColumn("whole_recall", ratio(F.col("whole"), F.col("labels")))


def candidate_type(column):
    """The type that a candidate counts as, whatever is expected of it."""
    known = F.create_map(*[F.lit(x) for pair in CANDIDATE_TYPES.items() for x in pair])
    return F.coalesce(known[column], column)


def policy_comparison(candidates: DataFrame, baseline: DataFrame, current: DataFrame) -> DataFrame:
    """candidates(case_id, language, category, start, end, entity_type, expect) against what two policies retained, over every combination of language and category."""
    key = ["case_id", "start", "end", "entity_type"]
    met = candidates.withColumn("entity_type", candidate_type(F.col("entity_type")))
    for name, kept in (("baseline", baseline), ("current", current)):
        own = kept.withColumn("entity_type", candidate_type(F.col("entity_type"))).select(*key).distinct().withColumn(name, F.lit(True))
        met = met.join(own, key, "left").fillna(False, [name])
    keep, b, c = F.col("expect") == PRESERVE, F.col("baseline"), F.col("current")
    measures = [F.count_if(keep).alias("preserve_total"), F.count_if(~keep).alias("discard_total")]
    for name, held in (("baseline", b), ("current", c)):
        measures += [F.count_if(keep & held).alias(f"{name}_preserve_retained"), F.count_if(~keep & ~held).alias(f"{name}_discard_dropped")]
    measures += [F.count_if(keep & b & ~c).alias("new_sensitive_losses"), F.count_if(keep & ~b & c).alias("recovered_sensitive_candidates")]
    return by_sets(met, [["language", "category"], ["language"], ["category"], []], *measures)


def context_scores(labels: DataFrame) -> DataFrame:
    """labels(split, category, state) by split and category, with ``all`` splits and ``contextual``: every category but STANDARD."""
    counts = labels.groupBy("split", "category").agg(F.count("*").alias("planted"), F.count_if(F.col("state") == "covered").alias("covered"), F.count_if(F.col("state") == "partial").alias("partial"))
    # a handful of counts: each is added to all that it belongs to
    named = F.when(F.col("category") == "STANDARD", F.array("category")).otherwise(F.array("category", F.lit("contextual")))
    spread = counts.withColumn("split", F.explode(F.array("split", F.lit("all")))).withColumn("category", F.explode(named))
    return spread.groupBy("split", "category").agg(*(F.sum(c).alias(c) for c in ("planted", "covered", "partial")))


def status_summary(rows: DataFrame, sets: list[list[str]]) -> DataFrame:
    """Statuses of another tool's values over several sets of keys; the rate, in per cent, is of those extracted."""
    s = F.col("status")
    out = by_sets(rows, sets, F.count("*").alias("total"), F.count_if(s == "NOT_EXTRACTED").alias("not_extracted"), F.count_if(s == "MISSED").alias("missed"), F.count_if(s == "CHANGED_REVIEW").alias("changed_review"))
    return out.withColumn("changed_rate_percent", F.round(_or_zero(F.col("changed_review"), F.col("total") - F.col("not_extracted")) * 100, 2))


def tool_counters(rows: DataFrame) -> DataFrame:
    """full, partial and missed values overall, by format, by language and by type."""
    return by_sets(rows, [[], ["format"], ["language"], ["type"]], F.count("*").alias("planted"), *(F.count_if(F.col("state") == s).alias(s) for s in ("full", "partial", "missed")))


def masking_summary(rows: DataFrame) -> DataFrame:
    """rows(language, outside, characters, orphans), one a document: what was hidden outside labels, by language and over all."""
    out = by_sets(rows, [["language"], []], F.sum("outside").alias("outside"), F.sum("characters").alias("characters"), F.sum("orphans").alias("orphans"))
    return out.withColumn("share", _or_zero(F.col("outside"), F.col("characters")))


def answer_validity(rows: DataFrame, *keys: str) -> DataFrame:
    """rows(error_type, provider_valid): answers, errors and those that a provider returned in a valid form."""
    return rows.groupBy(*keys).agg(F.count("*").alias("answers"), F.count("error_type").alias("errors"), F.count_if(F.col("error_type").isNull() & F.col("provider_valid")).alias("valid"))


def smoke_matrix(spark: SparkSession, sizes: list[int], languages: list[str], scales: list[int]) -> DataFrame:
    """Every size, language and scale: stated lists, one row each."""
    each = [F.explode(F.array(*map(F.lit, v))).alias(n) for n, v in (("size", sizes), ("language", languages), ("scale", scales))]
    out = spark.range(1)
    for e in each:
        out = out.select("*", e)
    return out.drop("id")


def unchanged(files: DataFrame, frozen: DataFrame) -> DataFrame:
    """files(path, content) whose digests are those of frozen(path, sha256); a changed, missing or new file fails the query."""
    now = files.select("path", F.sha2("content", 256).alias("_now"))
    met = now.join(frozen.select("path", F.col("sha256").alias("_then")), "path", "full")
    same = F.coalesce(F.col("_now") == F.col("_then"), F.lit(False))
    return met.filter(F.assert_true(same, "a file differs from the frozen ones").isNull()).select("path", F.col("_now").alias("sha256"))


def span_cache(docs: DataFrame, spans: DataFrame, method: str, corpus: str, source: str) -> DataFrame:
    """One row for each language and text with its spans and what made them; texts that occur again share a row."""
    listed = spans.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("start", "end", "entity_type", "score"))).alias("spans"))
    keyed = docs.select("doc_id", F.concat("language", F.lit(":"), F.sha2("text", 256)).alias("key")).join(listed, "doc_id", "left")
    none = F.array().cast(listed.schema["spans"].dataType)
    return keyed.groupBy("key").agg(F.coalesce(F.max("spans"), none).alias("spans")).withColumns({"method": F.lit(method), "corpus": F.lit(corpus), "source": F.lit(source)})


def cached_spans(docs: DataFrame, cache: DataFrame, method: str, corpus: str, source: str) -> DataFrame:
    """Spans of documents from a cache; another method, corpus or detector source, and an unknown text, fail the query."""
    made = (F.col("method") == method) & (F.col("corpus") == corpus) & (F.col("source") == source)
    checked = cache.withColumn("_same", F.coalesce(made, F.lit(False)))
    met = docs.select("doc_id", F.concat("language", F.lit(":"), F.sha2("text", 256)).alias("key")).join(checked, "key", "left")
    sure = met.filter(F.assert_true(F.coalesce("_same", F.lit(False)), "the cache's method, corpus or source differs, or it lacks a text").isNull())
    # the outer form: a plain one lets the optimizer drop rows without spans, and so unknown texts, before they are checked
    return sure.select("doc_id", F.inline_outer("spans")).filter("start IS NOT NULL")
