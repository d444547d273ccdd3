"""Redaction: spans to cleaned text, pseudonyms, word layouts and boxes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import spans as S


def replace_spans(docs: DataFrame, resolved: DataFrame, token: str = "token", text_col: str = "text") -> DataFrame:
    """``docs`` with each resolved span replaced by its token; a document without spans keeps its text."""
    ranges = resolved.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", F.col(token).alias("token")))).alias("_s"))
    done = T.replaced(F.col(text_col), F.coalesce("_s", F.array().cast(ranges.schema["_s"].dataType)), lambda _, r: r["token"])
    return docs.join(ranges.hint("merge"), "doc_id", "left").withColumn(text_col, done).drop("_s")


def redact(docs: DataFrame, spans: DataFrame, text_col: str = "text") -> DataFrame:
    """``[TYPE]`` in place of every resolved span."""
    return replace_spans(docs, S.resolve(spans).withColumn("token", F.concat(F.lit("["), "entity_type", F.lit("]"))), text_col=text_col)


def aliases(docs: DataFrame, spans: DataFrame, scope: str = "document", text_col: str = "text") -> DataFrame:
    """Resolved spans with their value and alias number, by first occurrence within the type.

    ``scope``: numbers per document, or over the corpus in the order of doc_id.
    The corpus scope ranks distinct values, not their occurrences: each value
    is one row before anything is ordered.
    """
    resolved = S.resolve(spans).join(docs.select("doc_id", text_col).hint("merge"), "doc_id")
    valued = resolved.withColumn("value", F.col(text_col).substr(F.col("start") + 1, F.col("end") - F.col("start"))).drop(text_col)
    if scope == "document":
        first = F.min("start").over(Window.partitionBy("doc_id", "entity_type", "value"))
        return valued.withColumn("_f", first).withColumn("n", F.dense_rank().over(Window.partitionBy("doc_id", "entity_type").orderBy("_f"))).drop("_f")
    if scope != "corpus":
        raise ValueError("scope: document or corpus")
    return valued.join(alias_table(valued), ["entity_type", "value"]).select(*valued.columns, "n")


def alias_table(valued: DataFrame) -> DataFrame:
    """(entity_type, value, n) of the corpus scope. It holds the original values: don't keep it by default.

    Ranks are made in ranges: values are sorted by range partitions, counted
    by partition, and each adds the counts before it, so that no task holds a
    whole type.
    """
    first = valued.groupBy("entity_type", "value").agg(F.min(F.struct("doc_id", "start")).alias("f"))
    dealt = first.repartitionByRange("entity_type", "f").withColumn("_p", F.spark_partition_id()).persist()
    sizes = dealt.groupBy("entity_type", "_p").agg(F.count("*").alias("k"))
    before = sizes.withColumn("b", F.coalesce(F.sum("k").over(Window.partitionBy("entity_type").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("k")
    local = F.row_number().over(Window.partitionBy("entity_type", "_p").orderBy("f"))
    return dealt.withColumn("r", local).join(before, ["entity_type", "_p"]).select("entity_type", "value", (F.col("r") + F.col("b")).cast("long").alias("n"))


def pseudonymise(docs: DataFrame, spans: DataFrame, scope: str = "document", text_col: str = "text") -> DataFrame:
    """``[TYPE_n]`` in place of every resolved span; equal spellings of a type share their number."""
    token = F.concat(F.lit("["), "entity_type", F.lit("_"), F.col("n").cast("string"), F.lit("]"))
    return replace_spans(docs, aliases(docs, spans, scope, text_col).withColumn("token", token), text_col=text_col)


def anonymise(docs: DataFrame, detect, mode: str = "replace", scope: str = "document") -> tuple[DataFrame, DataFrame]:
    """(cleaned documents, the original detections): detector and redactor read the same text."""
    found = S.require_valid(detect(docs).select("doc_id", *S.SPAN), docs)
    if mode not in ("replace", "pseudonymize"):
        raise ValueError("mode: replace or pseudonymize")
    return (redact(docs, found) if mode == "replace" else pseudonymise(docs, found, scope)), found


def replace_values(docs: DataFrame, values: DataFrame, text_col: str = "text") -> DataFrame:
    """The naive rule of simple tools: every occurrence of each value, the longest first, as plain text."""
    order = F.array_sort(F.collect_list(F.struct((-F.length("value")).alias("l"), "value", F.concat(F.lit("["), "entity_type", F.lit("]")).alias("t"))))
    listed = values.groupBy("doc_id").agg(order.alias("_v"))
    done = F.aggregate("_v", F.col(text_col), lambda a, x: F.replace(a, x["value"], x["t"]))
    return docs.join(listed.hint("merge"), "doc_id", "left").withColumn(text_col, F.when(F.col("_v").isNull(), F.col(text_col)).otherwise(done)).drop("_v")


def layout(words: DataFrame) -> DataFrame:
    """words(doc_id, idx, text, line) with the range of each in the document's text: a space joins words of a line, a line feed lines."""
    w = Window.partitionBy("doc_id").orderBy("idx")
    start = F.coalesce(F.sum(F.length("text") + 1).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return words.withColumn("start", start.cast("int")).withColumn("end", (F.col("start") + F.length("text")).cast("int")).withColumn("breaks", F.coalesce(~F.lag("line").over(w).eqNullSafe(F.col("line")), F.lit(False)) & (F.row_number().over(w) > 1))


def layout_text(laid: DataFrame) -> DataFrame:
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", F.concat(F.when(F.col("idx") == F.col("first"), "").when(F.col("breaks"), "\n").otherwise(" "), "text").alias("x")))), lambda s: s["x"]), "")
    return laid.withColumn("first", F.min("idx").over(Window.partitionBy("doc_id"))).groupBy("doc_id").agg(joined.alias("text"))


def words_in_spans(laid: DataFrame, spans: DataFrame) -> DataFrame:
    return laid.alias("w").join(spans.alias("s"), (F.col("w.doc_id") == F.col("s.doc_id")) & S.overlaps("w", "s"), "left_semi")


def expand_to_lines(laid: DataFrame, hit: DataFrame) -> DataFrame:
    """All words of the lines that hold a hit word."""
    return laid.join(hit.select("doc_id", "line").distinct(), ["doc_id", "line"], "left_semi")


def boxes(words: DataFrame) -> DataFrame:
    return words.withColumn("box", T.expand_box(F.col("left"), F.col("top"), F.col("width"), F.col("height")))


def valid_selection(chosen, count):
    """Sorted distinct word numbers of a hand-edited mask; null if one is out of range."""
    fine = F.forall(chosen, lambda i: i.isNotNull() & (i >= 0) & (i < count))
    return F.when(fine, F.array_sort(F.array_distinct(chosen)))
