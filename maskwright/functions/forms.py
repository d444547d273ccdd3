"""Forms of records and rows: canonical JSON, run signatures, ranges of table cells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Stands for a character that doesn't count; never part of a result.
HIDDEN = ""
SPACES = r"[\s\x1c-\x1f]+"


def canonical_json(text: Column) -> Column:
    """JSON with sorted keys and no white space; null for a null, an error for what is no JSON."""
    return F.to_json(F.parse_json(text))


def signature(*columns: Column) -> Column:
    """A key of an input and its options; a null and an empty option differ."""
    return F.sha2(F.to_json(F.array(*(c.cast("string") for c in columns))), 256)


def table_cells(line: Column) -> Column:
    """array<struct<start, end>>: the trimmed cells of a Markdown row.

    Pipes after a backslash or within code don't part cells. A blank cell before
    the first or after the last pipe is none. Null if no pipe parts the line or
    nothing is left.
    """
    escaped = F.regexp_replace(line, r"(?s)\\.", HIDDEN + HIDDEN)
    outside = F.transform(F.split(escaped, "`", -1), lambda x, i: F.when(i % 2 == 1, F.replace(x, F.lit("|"), F.lit(HIDDEN))).otherwise(x))
    sizes = F.transform(F.split(F.array_join(outside, "`"), r"\|", -1), F.length)
    empty = F.struct(F.lit(0).alias("at"), F.lit(None).cast("array<struct<start:int,end:int>>").alias("out"))

    def step(state, size):
        own = F.array(F.struct(state["at"].alias("start"), (state["at"] + size).alias("end")))
        return F.struct((state["at"] + size + 1).alias("at"), F.concat(F.coalesce(state["out"], F.array().cast("array<struct<start:int,end:int>>")), own).alias("out"))

    def trimmed(cell):
        text = line.substr(cell["start"] + 1, cell["end"] - cell["start"])
        start = cell["end"] - F.length(F.regexp_replace(text, rf"(?U)\A{SPACES}", ""))
        return F.struct(start.alias("start"), F.greatest(start, cell["start"] + F.length(F.regexp_replace(text, rf"(?U){SPACES}\z", ""))).alias("end"))

    cells = F.transform(F.aggregate(sizes, empty, step)["out"], trimmed)
    last = F.size(sizes) - 1
    kept = F.filter(cells, lambda c, i: ~(i.isin(0) | (i == last)) | (c["end"] > c["start"]))
    return F.when((last > 0) & (F.size(kept) > 0), kept)
