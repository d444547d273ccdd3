"""The span algebra: spans(doc_id, start, end, entity_type, score), half-open code point ranges.

There are several merges on purpose: adjacent ranges stay apart in ``resolve``
and join in ``merge_touching``; ``merge_display`` keeps the first label on ties.
Each is one sort and one aggregation by document, so a document's spans meet in
one place and nothing else moves. Joins by document are merge joins: sizes of
exploded rows are estimated far too low, and a table that is broadcast by
mistake fills the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

SPAN = ["start", "end", "entity_type", "score"]


def keys_of(spans: DataFrame) -> list[str]:
    return [c for c in ("dataset", "method", "doc_id") if c in spans.columns]


def is_valid(length: Column) -> Column:
    good = (F.col("start") >= 0) & (F.col("start") < F.col("end")) & (F.col("end") <= length) & F.col("entity_type").rlike(r"^[A-Z][A-Z0-9_]*\z") & ~F.isnan("score") & F.col("score").between(0, 1)
    return F.coalesce(good, F.lit(False))


def validate(spans: DataFrame, docs: DataFrame, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(distinct valid spans, rejected ones): a span of an unknown document is rejected."""
    sized = spans.join(docs.select("doc_id", F.length(text_col).alias("_len")).hint("merge"), "doc_id", "left")
    marked = sized.withColumn("_ok", is_valid(F.coalesce("_len", F.lit(-1))))
    return marked.filter("_ok").drop("_ok", "_len").distinct(), marked.filter("NOT _ok").drop("_ok", "_len")


def require_valid(spans: DataFrame, docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The distinct spans; the query fails on an invalid one instead of dropping it."""
    sized = spans.join(docs.select("doc_id", F.length(text_col).alias("_len")).hint("merge"), "doc_id", "left")
    return sized.filter(F.assert_true(is_valid(F.coalesce("_len", F.lit(-1))), "invalid span").isNull()).drop("_len").distinct()


def _grouped(spans: DataFrame, order: list, touching: bool) -> DataFrame:
    keys = keys_of(spans)
    w = Window.partitionBy(*keys).orderBy(*order)
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = reach.isNull() | (F.col("start") > reach if touching else F.col("start") >= reach)
    return spans.withColumn("_new", new.cast("int")).withColumn("_group", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def resolve(spans: DataFrame) -> DataFrame:
    """Overlapping spans become their union; the label is that of the best score, then the longest, then by type and start."""
    keys = keys_of(spans)
    grouped = _grouped(spans, ["start", "end", "entity_type", F.desc("score")], touching=False)
    best = F.min(F.struct((-F.col("score")).alias("s"), (F.col("start") - F.col("end")).alias("l"), "entity_type", "start"))
    out = grouped.groupBy(*keys, "_group").agg(F.min("start").alias("start"), F.max("end").alias("end"), best.alias("_b"))
    return out.select(*keys, "start", "end", F.col("_b.entity_type").alias("entity_type"), (-F.col("_b.s")).alias("score"))


def merge_touching(spans: DataFrame) -> DataFrame:
    """Unions of overlapping or adjacent spans, whatever their types."""
    keys = keys_of(spans)
    grouped = _grouped(spans, ["start", "end"], touching=True)
    return grouped.groupBy(*keys, "_group").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_group")


def merge_display(spans: DataFrame) -> DataFrame:
    """Unions for display: longer spans first, a label gives way to a strictly better score only."""
    keys = keys_of(spans)
    grouped = _grouped(spans, ["start", F.desc("end"), "entity_type", "score"], touching=False)
    first = F.row_number().over(Window.partitionBy(*keys, "_group").orderBy("start", F.desc("end"), "entity_type", "score"))
    best = F.min(F.struct((-F.col("score")).alias("s"), "_at", "entity_type"))
    out = grouped.withColumn("_at", first).groupBy(*keys, "_group").agg(F.min("start").alias("start"), F.max("end").alias("end"), best.alias("_b"))
    return out.select(*keys, "start", "end", F.col("_b.entity_type").alias("entity_type"), (-F.col("_b.s")).alias("score"))


def dedup_max_score(spans: DataFrame) -> DataFrame:
    return spans.groupBy(*keys_of(spans), "start", "end", "entity_type").agg(F.max("score").alias("score"))


def shift(spans: DataFrame, offset: str = "offset") -> DataFrame:
    """Offsets within a window as offsets within the text."""
    return spans.withColumn("start", F.col("start") + F.col(offset)).withColumn("end", F.col("end") + F.col(offset)).drop(offset)


def route(rules: DataFrame, model: DataFrame, types: tuple[str, ...] = ("PERSON", "ORGANIZATION", "LOCATION")) -> DataFrame:
    """All spans of the model and those of the rules whose type the model does not own."""
    return rules.filter(~F.col("entity_type").isin(*types)).unionByName(model)


def overlaps(a: str, b: str) -> Column:
    return (F.col(f"{a}.start") < F.col(f"{b}.end")) & (F.col(f"{a}.end") > F.col(f"{b}.start"))


def same(a: Column, b: Column) -> Column:
    """Equality that is no key of a join: rows that are dealt by document alone meet without being dealt again."""
    return (a <= b) & (a >= b)


def covers(a: str, b: str) -> Column:
    return (F.col(f"{a}.start") <= F.col(f"{b}.start")) & (F.col(f"{a}.end") >= F.col(f"{b}.end"))


def unlabelled(spans: DataFrame, annotated: DataFrame) -> DataFrame:
    """Spans that overlap no annotated range of their document, of any type."""
    return spans.alias("s").join(annotated.alias("a").hint("merge"), (F.col("s.doc_id") == F.col("a.doc_id")) & overlaps("s", "a"), "left_anti")


def outside(spans: DataFrame, annotated: DataFrame, orphans: bool = True) -> DataFrame:
    """Per document and method: masked characters, those outside annotated ranges, and (``orphans``) spans wholly outside."""
    keys = keys_of(spans)
    merged = merge_touching(spans)
    ranges = merge_touching(annotated.select("doc_id", "start", "end"))
    met = merged.alias("s").join(ranges.alias("a").hint("merge"), (F.col("s.doc_id") == F.col("a.doc_id")) & overlaps("s", "a"), "left")
    inside = F.when(F.col("a.start").isNotNull(), F.least("s.end", "a.end") - F.greatest("s.start", "a.start")).otherwise(0)
    per = met.groupBy(*(F.col(f"s.{k}").alias(k) for k in keys), F.col("s.start").alias("start"), F.col("s.end").alias("end")).agg(F.sum(inside).alias("inside"))
    chars = per.groupBy(*keys).agg(F.sum(F.col("end") - F.col("start")).alias("masked_chars"), F.sum(F.col("end") - F.col("start") - F.col("inside")).alias("outside_chars"))
    if not orphans:
        return chars
    lone = unlabelled(spans, annotated).groupBy(*keys).agg(F.count("*").alias("orphans"))
    return chars.join(lone.hint("merge"), keys, "left").withColumn("orphans", F.coalesce("orphans", F.lit(0)))


def coverage(targets: DataFrame, spans: DataFrame, typed: bool = False) -> DataFrame:
    """Covered characters of each target: those that any span (of its type) covers, as interval arithmetic on unions."""
    keys = [c for c in targets.columns if c not in ("start", "end")]
    groups = ["doc_id", "entity_type"] if typed else ["doc_id"]
    union = spans
    if typed:
        w = Window.partitionBy(*groups).orderBy("start", "end")
        reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
        union = spans.withColumn("_g", F.sum((reach.isNull() | (F.col("start") > reach)).cast("int")).over(w)).groupBy(*groups, "_g").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    else:
        union = merge_touching(spans.select("doc_id", "start", "end"))
    on = (F.col("t.doc_id") == F.col("s.doc_id")) & overlaps("t", "s")
    if typed:
        on = on & same(F.col("t.entity_type"), F.col("s.entity_type"))
    met = targets.alias("t").join(union.alias("s").hint("merge"), on, "left")
    got = F.when(F.col("s.start").isNotNull(), F.least("t.end", "s.end") - F.greatest("t.start", "s.start")).otherwise(0)
    return met.groupBy(*(F.col(f"t.{k}").alias(k) for k in keys), F.col("t.start").alias("start"), F.col("t.end").alias("end")).agg(F.sum(got).alias("covered_chars"))


MARK = "\x01"


def occurrences(text: Column, value: Column) -> Column:
    """The starts of a value in a text, overlapping ones included.

    One or two occurrences, which are most, are found by plain searches. Of more,
    a value no end of which is also its beginning can't overlap itself: it is
    replaced by a mark and the text is split there. Any other is found by a
    split at every place where it follows. Lengths of the pieces add up to the
    starts.
    """
    none = F.array().cast("array<int>")
    n = F.length(value)
    quoted = F.concat(F.lit("(?=\\Q"), F.replace(value, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E)"))
    first = F.when(F.startswith(text, value), F.array(F.lit(0))).otherwise(none)

    def followed(parts):
        later = F.slice(T.starts(F.transform(parts, F.length)), F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))
        return F.when(F.size(parts) > 1, F.concat(first, later)).otherwise(first)

    def marked(parts):
        ends = F.transform(F.zip_with(parts, T.starts(F.transform(parts, F.length)), lambda p, at: at + F.length(p)), lambda x, i: x + i * n)
        return F.when(F.size(parts) > 1, F.slice(ends, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(none)

    overlaps_itself = F.exists(F.sequence(F.lit(1), n - 1), lambda k: value.substr(F.lit(1), k) == value.substr(n - k + 1, k))
    slow = T.let(F.split(text, quoted, -1), followed)
    fast = T.let(F.split(F.replace(text, value, F.lit(MARK)), MARK, -1), marked)
    many = F.when((F.coalesce(n, F.lit(0)) == 0) | ~F.contains(text, value), none).when((n > 1) & ~F.contains(text, F.lit(MARK)) & ~F.when(n > 1, overlaps_itself), fast).otherwise(slow)
    after = lambda at: F.position(value, text, at + 1)
    two = lambda a, b: T.let(after(b), lambda c: F.when(c == 0, F.array(a - 1, b - 1)).otherwise(many))
    one = lambda a: T.let(after(a), lambda b: F.when(b == 0, F.array(a - 1)).otherwise(two(a, b)))
    return F.when(F.coalesce(n, F.lit(0)) == 0, none).otherwise(T.let(F.position(value, text), lambda a: F.when(a == 0, none).otherwise(one(a))))


def label_places(labels: DataFrame, docs: DataFrame, text_col: str = "text") -> DataFrame:
    """labels x their occurrences: one row (…, start, end) a place; a label without one has a null place.

    A document's labels are gathered first, so its text meets them once. Where
    labels and text are one row to begin with, ``nested_places`` moves no text.
    """
    kept = [c for c in labels.columns if c != "doc_id"]
    listed = labels.groupBy("doc_id").agg(F.collect_list(F.struct(*kept)).alias("labels"))
    return nested_places(docs.select("doc_id", text_col).join(listed.hint("merge"), "doc_id"), text_col=text_col).select(*labels.columns, "start", "end")


def nested_places(docs: DataFrame, labels: str = "labels", text_col: str = "text") -> DataFrame:
    """As above from documents that hold an array of label structs, each with a value: places are found in the row, and the text stays where it is."""
    text = F.col(text_col)
    placed = F.transform(labels, lambda x: F.struct(x.alias("l"), occurrences(text, x["value"]).alias("at")))
    kept = [c for c in docs.columns if c not in (labels, text_col)]
    rows = docs.select(*kept, F.explode(placed).alias("_p")).select(*kept, "_p.l.*", F.explode_outer("_p.at").alias("start"))
    return rows.withColumn("end", F.col("start") + F.length("value"))


def places_of(labels: DataFrame, docs: DataFrame | None) -> DataFrame:
    """Labels with their places: found in ``docs``, or as they are if they have them already."""
    return labels if "start" in labels.columns else label_places(labels, docs)
