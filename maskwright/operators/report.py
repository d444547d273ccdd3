"""Aggregations of scored labels, spans and answers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .score import GOOD

RESULT_KEYS = ["entity_type", "language", "location", "identifier_type", "format"]


def ratio(a, b):
    """a / b as a double, null where b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def tally(states: DataFrame, *keys: str) -> DataFrame:
    """planted, covered and partial by the keys."""
    return states.groupBy(*keys).agg(F.count("*").alias("planted"), F.count_if(F.col("state") == "covered").alias("covered"), F.count_if(F.col("state") == "partial").alias("partial"))


def with_recall(counts: DataFrame) -> DataFrame:
    return counts.withColumn("recall", ratio(F.col("covered"), F.col("planted")))


def totals(counts: DataFrame, *keys: str) -> DataFrame:
    """Re-aggregates a tally over fewer keys."""
    return counts.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in ("planted", "covered", "partial")))


def recall_cube(states: DataFrame, *keys: str) -> DataFrame:
    """planted, covered, partial and recall of every combination of the keys; ``all`` stands for any value."""
    names = [F.when(F.grouping(k) == 1, "all").otherwise(F.col(k)).alias(f"_{k}") for k in keys]
    out = states.cube(*keys).agg(F.count("*").alias("planted"), F.count_if(F.col("state") == "covered").alias("covered"), F.count_if(F.col("state") == "partial").alias("partial"), *names)
    return with_recall(out.drop(*keys).withColumnsRenamed({f"_{k}": k for k in keys}))


def recall_rollup(states: DataFrame, *keys: str) -> DataFrame:
    names = [F.when(F.grouping(k) == 1, "all").otherwise(F.col(k)).alias(f"_{k}") for k in keys]
    out = states.rollup(*keys).agg(F.count("*").alias("planted"), F.count_if(F.col("state") == "covered").alias("covered"), F.count_if(F.col("state") == "partial").alias("partial"), *names)
    return with_recall(out.drop(*keys).withColumnsRenamed({f"_{k}": k for k in keys}))


def grouping_sets(states: DataFrame, sets: list[list[str]], measures: list) -> DataFrame:
    """One aggregate over several sets of keys in a single pass."""
    keys = list(dict.fromkeys(k for s in sets for k in s))
    return states.groupingSets([[F.col(k) for k in s] for s in sets], *map(F.col, keys)).agg(*measures)


def precision(judged: DataFrame, *keys: str) -> DataFrame:
    counts = judged.groupBy(*keys).agg(F.count("*").alias("detections"), F.count_if(F.col("judgement") == "correct").alias("correct"), F.count_if(F.col("judgement") == "other").alias("other_type"), F.count_if(F.col("judgement") == "").alias("unlabelled"))
    return counts.withColumn("precision", ratio(F.col("correct"), F.col("detections")))


def extraction(returned: DataFrame, *keys: str) -> DataFrame:
    """labels with ``returned`` (boolean): distinct documents, planted, returned, missing and recall."""
    out = returned.groupBy(*keys).agg(F.countDistinct("doc_id").alias("documents"), F.count("*").alias("planted"), F.count_if("returned").alias("returned"))
    return out.withColumn("missing", F.col("planted") - F.col("returned")).withColumn("recall", ratio(F.col("returned"), F.col("planted")))


def gate(counts: DataFrame, min_recall: float, **selected: list[str]) -> DataFrame:
    """One row: whether all selected groups reach the recall. A selection that matches no group fails the query."""
    kept = reduce(lambda d, s: d.filter(F.col(s[0]).isin(*s[1])), selected.items(), counts)
    out = kept.agg(F.count("*").alias("groups"), F.min("recall").alias("least"), F.bool_and(F.col("recall") >= min_recall).alias("passed"))
    return out.filter(F.assert_true(F.col("groups") > 0, "no group matches the selection").isNull())


def missing_required(observed: DataFrame, column: str, required: list[str]) -> DataFrame:
    wanted = observed.sparkSession.createDataFrame([(r,) for r in required], f"{column} string")
    return wanted.join(observed.select(column).distinct(), column, "left_anti")


def best_method(counts: DataFrame) -> DataFrame:
    """counts(dataset, method, planted, covered): the method of the best mean recall over datasets; one that lacks a dataset can't win."""
    each = counts.groupBy("dataset", "method").agg(ratio(F.sum("covered"), F.sum("planted")).alias("recall"))
    every = each.agg(F.countDistinct("dataset").alias("datasets"))
    means = each.groupBy("method").agg(F.avg("recall").alias("score"), F.count("recall").alias("n")).join(F.broadcast(every), F.col("n") == F.col("datasets"))
    return means.agg(F.min(F.struct((-F.col("score")).alias("s"), "method")).alias("b")).select("b.method", (-F.col("b.s")).alias("score")).filter("method IS NOT NULL")


def summary_pivot(counts: DataFrame, key: str, methods: list[str]) -> DataFrame:
    return with_recall(totals(counts, key, "method")).groupBy(key).pivot("method", methods).agg(F.first("recall"))


def type_breakdown(counts: DataFrame) -> DataFrame:
    """By type and method, the worst first; types without labels last."""
    return with_recall(totals(counts, "entity_type", "method")).orderBy(F.asc_nulls_last("recall"), F.desc("planted"), "entity_type", "method")


def recall_table(counts: DataFrame) -> DataFrame:
    """(dataset, method) recall; not a number where nothing was planted."""
    t = totals(counts, "dataset", "method")
    return t.withColumn("recall", F.when(F.col("planted") == 0, F.lit(float("nan"))).otherwise(ratio(F.col("covered"), F.col("planted"))))


def misses(states: DataFrame) -> DataFrame:
    """Found, total and the missed values of each type; labels whose value isn't in the text don't count."""
    present = states.filter("occurrences > 0")
    hit = F.col("state") == "covered"
    return present.groupBy("type").agg(F.count_if(hit).alias("found"), F.count("*").alias("total"), F.array_sort(F.collect_set(F.when(~hit, F.col("value")))).alias("missed"))


def headline(states: DataFrame) -> DataFrame:
    """Found of all labels; an absent value counts as missed here."""
    return states.agg(F.count_if(F.col("state") == "covered").alias("found"), F.count("*").alias("labels"))


def detection_counts(spans: DataFrame) -> DataFrame:
    return spans.groupBy("doc_id", "entity_type").agg(F.count("*").alias("detections"))


def type_colours(spans: DataFrame, colours: int = 12) -> DataFrame:
    """The place of each type in a cyclic palette, in the order of their names."""
    ranked = spans.agg(F.array_sort(F.collect_set("entity_type")).alias("t")).select(F.posexplode("t").alias("colour", "entity_type"))
    return ranked.select("entity_type", (F.col("colour") % colours).alias("colour"))


def confusion(cases: DataFrame, *keys: str) -> DataFrame:
    """cases(expect, retained): counters of expected against actual decisions."""
    keep, drop = F.col("expect") == "preserve_detection", F.col("expect") == "discard_detection"
    return cases.groupBy(*keys).agg(
        F.count_if(keep & F.col("retained")).alias("preserve_retained"), F.count_if(keep & ~F.col("retained")).alias("preserve_dropped"),
        F.count_if(drop & F.col("retained")).alias("discard_retained"), F.count_if(drop & ~F.col("retained")).alias("discard_dropped"),
    )


def policy_changes(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Spans kept by one policy only: ``lost`` or ``recovered``."""
    a, b = old.select(*keys, F.lit(True).alias("_o")), new.select(*keys, F.lit(True).alias("_n"))
    both = a.join(b, keys, "full").filter("_o IS NULL OR _n IS NULL")
    return both.withColumn("change", F.when(F.col("_n").isNull(), "lost").otherwise("recovered")).drop("_o", "_n")


def regression_gate(before: DataFrame, after: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    """One row: whether any measure of any key fell."""
    met = before.select(*keys, *(F.col(m).alias(f"b_{m}") for m in measures)).join(after.select(*keys, *(F.col(m).alias(f"a_{m}") for m in measures)), keys, "left")
    worse = reduce(lambda x, y: x | y, [F.coalesce(F.col(f"a_{m}"), F.lit(0)).cast("double") < F.col(f"b_{m}").cast("double") for m in measures])
    return met.agg(F.coalesce(F.bool_or(worse), F.lit(False)).alias("regressed"), F.count_if(worse).alias("losses"))


def ocr_summary(read: DataFrame, *keys: str) -> DataFrame:
    """read(reference, text, values, error, seconds): value recall, character error rate, seconds a document and errors."""
    text = F.coalesce("text", F.lit(""))
    edits = F.levenshtein(text, F.col("reference"))
    hits = F.size(F.filter("values", lambda v: F.contains(text, v)))
    out = read.groupBy(*keys).agg(F.count("*").alias("documents"), F.sum(F.size("values")).alias("labels"), F.sum(hits).alias("found"), F.sum(edits).alias("edits"), F.sum(F.length("reference")).alias("characters"), F.avg("seconds").alias("seconds"), F.count("error").alias("errors"))
    return out.withColumn("recall", ratio(F.col("found"), F.col("labels"))).withColumn("cer", ratio(F.col("edits"), F.col("characters")))


def score_pivot(scored: DataFrame, keys: list[str], scores: tuple[str, ...] = ("correct", "wrong", "refused", "invalid", "unanswered")) -> DataFrame:
    """Counts of each score by the keys, with their total and the correct rate."""
    out = scored.groupBy(*keys).pivot("score", list(scores)).agg(F.count(F.lit(1))).na.fill(0, list(scores))
    out = out.withColumn("requests", reduce(lambda a, b: a + b, [F.col(s) for s in scores]))
    return out.withColumn("correct_rate", ratio(F.col("correct"), F.col("requests")))


def paired_retention(scored: DataFrame) -> DataFrame:
    """scored(document_id, question_id, variant, score) with variants raw, redacted and pseudonymized: what each keeps of raw success."""
    wide = scored.groupBy("document_id", "question_id").pivot("variant", ["raw", "redacted", "pseudonymized"]).agg(F.first("score"))
    long = wide.select("document_id", "question_id", "raw", F.explode(F.create_map(F.lit("redacted"), "redacted", F.lit("pseudonymized"), "pseudonymized")).alias("variant", "score"))
    done = lambda c: F.col(c).isin("correct", "wrong", "refused")
    ok = F.col("score") == "correct"
    raw = F.col("raw") == "correct"
    out = long.groupBy("variant").agg(
        F.count_if(raw & done("score")).alias("raw_correct"), F.count_if(raw & ok).alias("retained"), F.count_if(raw & done("score") & ~ok).alias("lost"),
        F.count_if(done("raw") & ~raw & ok).alias("gained"), F.count_if(~F.coalesce(done("raw") & done("score"), F.lit(False))).alias("incomplete"),
    )
    return out.withColumn("retention", ratio(F.col("retained"), F.col("raw_correct")))


def worst_first(counts: DataFrame) -> DataFrame:
    """Types sorted by how bad their verdict is."""
    from .score import verdict

    rank = {v: i for i, v in enumerate(["not found", "partial only", "misses", "often partial", "good", "not tested"])}
    out = counts.withColumn("verdict", verdict(F.col("planted"), F.col("covered"), F.col("partial")))
    return out.withColumn("rank", F.create_map(*[F.lit(x) for p in rank.items() for x in p])[F.col("verdict")]).orderBy("rank", "entity_type").drop("rank")


def matrix_upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key was not run again stay, new ones come."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


__all__ = [n for n in dir() if not n.startswith("_")] + ["GOOD"]
