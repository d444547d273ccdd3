"""Scores of spans against labelled values: one state a label.

States: ``covered`` (hidden whole), ``partial`` (touched) and ``''``. Labels
drive every join, so a document without spans keeps its labels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import spans as S

#: The detectors' types and the label types they stand for.
TYPE_MAP = {
    "PERSON": "PERSON", "EMAIL_ADDRESS": "EMAIL", "PHONE_NUMBER": "PHONE", "IBAN_CODE": "IBAN", "ACCOUNT_NUMBER": "IBAN", "LOCATION": "ADDRESS",
    "ORGANIZATION": "COMPANY", "DATE_TIME": "DATE", "FI_PERSONAL_IDENTITY_CODE": "PERSONAL_ID", "PLATE": "PLATE", "INVOICE": "INVOICE", "PERSONAL_ID": "PERSONAL_ID",
}
#: Label types and the detector types that count for them; a type that isn't listed accepts any.
ACCEPT = {
    "PERSON": ["PERSON"], "COMPANY": ["ORGANIZATION"], "ADDRESS": ["LOCATION"], "CITY": ["LOCATION"], "STREET": ["LOCATION"], "DATE": ["DATE_TIME"],
    "EMAIL": ["EMAIL_ADDRESS"], "PHONE": ["PHONE_NUMBER"], "IBAN": ["IBAN_CODE", "ACCOUNT_NUMBER"], "CREDITCARD": ["CREDIT_CARD", "ACCOUNT_NUMBER"],
}


def _lookup(mapping: dict):
    return F.create_map(*[F.lit(x) if not isinstance(x, list) else F.array(*map(F.lit, x)) for pair in mapping.items() for x in pair])


def mapped(detected, mapping: dict = TYPE_MAP):
    """The label type of a detector type; one without an entry keeps its own name."""
    return F.coalesce(_lookup(mapping)[detected], detected)


def accepts(label_type, detected, accept: dict = ACCEPT):
    allowed = _lookup(accept)[label_type]
    return allowed.isNull() | F.array_contains(allowed, detected)


def _label_keys(places: DataFrame) -> list[str]:
    return [c for c in places.columns if c not in ("start", "end", "_doc")]


def _per_place(places: DataFrame, spans: DataFrame, typed, methods: list[str] | None = None) -> DataFrame:
    """places (label columns, start, end) with the method and whether one span holds or touches the place.

    Spans of several methods need their names: a method without spans misses every label.
    """
    if (methods is None) == ("method" in spans.columns):
        raise ValueError("name the methods of the spans, and only if they have any")
    by = ["method"] if methods else []
    if methods:
        places = places.withColumn("method", F.explode(F.array(*map(F.lit, methods))))
    p = places.alias("p")
    on = (F.col("p.doc_id") == F.col("s.doc_id")) & S.overlaps("p", "s")
    for b in by:
        on = on & S.same(F.col(f"p.{b}"), F.col(f"s.{b}"))
    if typed is not None:
        on = on & typed
    keys = [F.col(f"p.{c}").alias(c) for c in places.columns]
    hold, touch = F.coalesce(F.bool_or(S.covers("s", "p")), F.lit(False)), F.coalesce(F.bool_or(F.col("s.start").isNotNull()), F.lit(False))
    return p.join(spans.alias("s").hint("merge"), on, "left").groupBy(*keys).agg(hold.alias("held"), touch.alias("touched"))


def value_states(labels: DataFrame, docs: DataFrame | None, spans: DataFrame, mapping: dict | None = TYPE_MAP, methods: list[str] | None = None) -> DataFrame:
    """labels(doc_id, label_id, type, value, …) with a state over all occurrences of the value.

    Covered: one span of the right type holds each occurrence whole; partial: any is held or touched.
    Labels may come with their places (``spans.nested_places``); then no text is read here.
    Places meet spans once, by document, and the methods are told apart in the
    counts of a place and of a label, so nothing is read or joined twice.
    """
    if (methods is None) == ("method" in spans.columns):
        raise ValueError("name the methods of the spans, and only if they have any")
    names = methods or [""]
    keys = [c for c in labels.columns if c not in ("start", "end")]
    p = S.places_of(labels, docs).select(*keys, "start").withColumn("end", F.col("start") + F.length("value")).alias("p")
    s = (spans if methods else spans.withColumn("method", F.lit(""))).select("doc_id", "method", "start", "end", "entity_type" if mapping is not None else F.lit(None).cast("string").alias("entity_type")).alias("s")
    on = (F.col("p.doc_id") == F.col("s.doc_id")) & S.overlaps("p", "s")
    if mapping is not None:
        on = on & S.same(mapped(F.col("s.entity_type"), mapping), F.col("p.type"))
    own, of = [F.col("s.method") == n for n in names], [F.col(f"p.{c}").alias(c) for c in keys]
    each = p.join(s.hint("merge"), on, "left").groupBy(*of, "p.start").agg(*(F.bool_or(m & S.covers("s", "p")).alias(f"_h{i}") for i, m in enumerate(own)), *(F.bool_or(m).alias(f"_t{i}") for i, m in enumerate(own)))
    told = each.groupBy(*keys).agg(F.count("start").alias("occurrences"), *(F.count_if(f"_h{i}").alias(f"_h{i}") for i in range(len(names))), *(F.bool_or(f"_t{i}").alias(f"_t{i}") for i in range(len(names))))
    listed = F.array(*(F.struct(F.lit(n).alias("method"), F.col(f"_h{i}").alias("held"), F.col(f"_t{i}").alias("touched")) for i, n in enumerate(names)))
    wide = told.select(*keys, "occurrences", F.explode(listed).alias("_m"))
    state = F.when((F.col("occurrences") > 0) & (F.col("_m.held") == F.col("occurrences")), "covered").when(F.col("_m.touched"), "partial").otherwise("")
    kept = [c for c in keys if c != "doc_id"]
    return wide.select("doc_id", *kept, *([F.col("_m.method").alias("method")] if methods else []), state.alias("state"), "occurrences")


def union_states(labels: DataFrame, docs: DataFrame | None, spans: DataFrame, methods: list[str] | None = None) -> DataFrame:
    """As ``value_states``, against the unions of touching spans of any type."""
    return value_states(labels, docs, S.merge_touching(spans), None, methods)


def mention_states(mentions: DataFrame, spans: DataFrame, accept: dict = ACCEPT, methods: list[str] | None = None) -> DataFrame:
    """mentions(doc_id, mention_id, type, start, end, …) with a state for that one place."""
    met = _per_place(mentions, spans, accepts(F.col("p.type"), F.col("s.entity_type"), accept), methods)
    return met.withColumn("state", F.when(F.col("held"), "covered").when(F.col("touched"), "partial").otherwise("")).drop("held", "touched")


def judge(spans: DataFrame, labels: DataFrame, docs: DataFrame | None, mapping: dict = TYPE_MAP) -> DataFrame:
    """spans with what they overlap: ``correct`` type, ``other`` type, or ``''``."""
    places = S.places_of(labels, docs).filter("start IS NOT NULL").select("doc_id", "type", "start", "end")
    keys = [F.col(f"s.{c}").alias(c) for c in spans.columns]
    met = spans.alias("s").join(places.alias("p").hint("merge"), (F.col("p.doc_id") == F.col("s.doc_id")) & S.overlaps("p", "s"), "left")
    right = F.bool_or(mapped(F.col("s.entity_type"), mapping) == F.col("p.type"))
    return met.groupBy(*keys).agg(F.when(right, "correct").when(F.bool_or(F.col("p.type").isNotNull()), "other").otherwise("").alias("judgement"))


#: Recall from which a type counts as good.
GOOD = 0.95


def verdict(planted, covered, partial):
    """A word for a type's result."""
    rate = covered / planted
    return (
        F.when(planted == 0, "not tested").when(rate >= GOOD, "good").when(covered + partial == 0, "not found")
        .when(covered == 0, "partial only").when((covered + partial) / planted >= GOOD, "often partial").otherwise("misses")
    )


def located_states(labels: DataFrame, docs: DataFrame | None, regions: DataFrame, spans: DataFrame, mapping: dict = TYPE_MAP) -> DataFrame:
    """labels (with location and expected, the least number of places) against spans, within regions(doc_id, location, start, end).

    whole: every expected place was found in the label's own location and one span holds each.
    """
    places = S.places_of(labels, docs)
    kept = places.join(regions.select(F.col("doc_id").alias("_r"), F.col("location").alias("_l"), F.col("start").alias("r0"), F.col("end").alias("r1")).hint("merge"), (F.col("doc_id") == F.col("_r")) & S.same(F.col("location"), F.col("_l")), "left").drop("_r", "_l")
    kept = kept.withColumn("_in", F.coalesce((F.col("start") >= F.col("r0")) & (F.col("end") <= F.col("r1")), F.lit(False))).drop("r0", "r1")
    columns = [c for c in kept.columns if c not in ("start", "end", "_in")]
    once = kept.groupBy(*columns, "start", "end").agg(F.bool_or("_in").alias("_in"))
    placed = once.withColumn("start", F.when(F.col("_in"), F.col("start"))).withColumn("end", F.when(F.col("_in"), F.col("end"))).drop("_in").distinct()
    met = _per_place(placed, spans, S.same(mapped(F.col("s.entity_type"), mapping), F.col("p.type")))
    keys = [c for c in met.columns if c not in ("start", "end", "held", "touched")]
    matches = F.count("start")
    whole = F.count_if(F.col("start").isNotNull() & F.col("held"))
    out = met.groupBy(*keys).agg(matches.alias("matches"), whole.alias("whole_places"), F.bool_or("touched").alias("_t"))
    missing = F.greatest(F.lit(0), F.col("expected") - F.col("matches"))
    done = (missing == 0) & (F.col("matches") > 0) & (F.col("whole_places") == F.col("matches"))
    return out.withColumn("missing", missing).withColumn("whole", done).withColumn("partial", ~done & F.col("_t")).drop("_t")


def tristate(before, after, value):
    """Whether a value was extracted and whether it still stands after redaction (white space and case folded)."""
    return F.when(~F.contains(before, value), "NOT_EXTRACTED").when(F.contains(after, value), "MISSED").otherwise("CHANGED_REVIEW")


def hidden_items(items: DataFrame, spans: DataFrame) -> DataFrame:
    """items(doc_id, start, end, …): all or any of their characters hidden by the union of spans."""
    got = S.coverage(items, spans)
    return got.withColumn("hidden", F.col("covered_chars") == F.col("end") - F.col("start")).withColumn("touched", F.col("covered_chars") > 0)


def piece_state(value, pieces):
    """A value against the texts a tool returned: full if one holds it or the pieces it holds cover it, else partial or missed."""
    within = F.filter(pieces, lambda p: (F.length(p) > 0) & F.contains(value, p))
    rest = F.aggregate(F.array_sort(within, lambda a, b: F.length(b) - F.length(a)), value, lambda v, p: F.replace(v, p, F.lit("")))
    return F.when(F.exists(pieces, lambda p: F.contains(p, value)), "full").when((F.size(within) > 0) & (F.length(rest) == 0), "full").when(F.size(within) > 0, "partial").otherwise("missed")


def quote_state(value, quotes, least: int = 3):
    """As above for quoting tools: partial from ``least`` common characters on."""
    part = F.exists(quotes, lambda q: ((F.length(q) >= least) & F.contains(value, q)) | ((F.length(value) >= least) & F.contains(q, value)))
    return F.when(F.exists(quotes, lambda q: F.contains(q, value)), "full").when(part, "partial").otherwise("missed")


def answer_state(answer, refused, accepted):
    """A recorded answer (normalised) against the accepted ones; only an exact match counts."""
    blank = F.coalesce(F.length(F.trim(answer)), F.lit(0)) == 0
    return F.when(refused.isNull(), "invalid").when(refused & ~blank, "invalid").when(refused, "refused").when(blank, "invalid").when(F.array_contains(accepted, answer), "correct").otherwise("wrong")


def image_state(read, leaked, blacked, words):
    """A value in an image: not read at all, still readable, all of its words black, or some."""
    return F.when(~read, "unread").when(leaked & (blacked == 0), "leaked").when(blacked == words, "hidden").otherwise("partial")


def display_state(present, state):
    return F.when(~present, "absent").when(state == "", "missed").otherwise(state)
