"""Where a Markdown document's lines come from: body, metadata, comments and other parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Headings and the location they open.
EXACT = {
    "## Document metadata": "metadata", "## Document content": "body", "### Speaker notes": "notes", "## Footnotes": "notes", "## Endnotes": "notes",
    "### Embedded image text": "embedded_image", "## Review comments": "comment", "## Tracked changes": "tracked_change",
}


def line_location(line, hidden):
    """The location a line opens, null if it opens none. ``hidden``: array of hidden sheet names."""
    at = F.when(line.rlike(r"^## (Slide|Page) \d+"), "body")
    at = at.when(line.rlike(r"(?i)^## (first page |even page )?header \(section \d+\)$"), "header").when(line.rlike(r"(?i)^## (first page |even page )?footer \(section \d+\)$"), "footer")
    at = at.when(F.startswith(line, F.lit("## Sheet: ")), F.when(F.array_contains(F.coalesce(hidden, F.array().cast("array<string>")), line.substr(11, 1_000_000)), "hidden_sheet").otherwise("body"))
    for heading, location in EXACT.items():
        at = at.when(line == heading, location)
    return at


def locations(docs: DataFrame, text_col: str = "text", hidden_col: str | None = None) -> DataFrame:
    """(doc_id, location, start, end): runs of lines of one location that cover the whole text."""
    hidden = F.col(hidden_col) if hidden_col else F.lit(None).cast("array<string>")
    lines = docs.select("doc_id", hidden.alias("_h"), F.posexplode(F.split(text_col, "(?<=\n)", -1)).alias("pos", "line")).filter("line <> ''")
    w = Window.partitionBy("doc_id").orderBy("pos")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    bare = F.regexp_replace("line", r"[\r\n]+\z", "")
    placed = lines.withColumn("end", F.sum(F.length("line")).over(upto)).withColumn("start", F.col("end") - F.length("line"))
    placed = placed.withColumn("location", F.coalesce(F.last(line_location(bare, F.col("_h")), True).over(upto), F.lit("body")))
    run = F.sum((~F.col("location").eqNullSafe(F.lag("location").over(w))).cast("int")).over(upto)
    return placed.withColumn("_r", run).groupBy("doc_id", "_r", "location").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_r")


def split_sections(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(doc_id, n, title, body): the preamble ``(start)`` and each ## or ### section in order."""
    parts = F.split(F.col(text_col), r"(?m)^(?=#{2,3} )", -1)
    rows = docs.select("doc_id", F.posexplode(parts).alias("n", "part")).filter("part <> ''")
    head = F.regexp_extract("part", r"\A#{2,3} +([^\n]*)", 1)
    return rows.select("doc_id", "n", F.when(F.col("part").rlike(r"\A#{2,3} "), F.trim(head)).otherwise("(start)").alias("title"), F.regexp_replace("part", r"\A#{2,3} [^\n]*\n?", "").alias("body"))


def text_by_location(docs: DataFrame, regions: DataFrame, text_col: str = "text") -> DataFrame:
    """(doc_id, location, text): the regions of each location in order."""
    cut = regions.join(docs.select("doc_id", text_col).hint("merge"), "doc_id").withColumn("part", F.col(text_col).substr((F.col("start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int")))
    return cut.groupBy("doc_id", "location").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "part"))), lambda x: x["part"]), "\n").alias("text"))
