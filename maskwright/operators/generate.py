"""A deterministic labelled corpus: records from hashes, labels from what is visible, and its verifier."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .detect import PERSONAL_ID

FIRST = ("Aino", "Eero", "Helmi", "Ilmari", "Lumi", "Onni", "Saga", "Toivo")
LAST = ("Aalto", "Berg", "Halla", "Koski", "Lehto", "Niemi", "Salo", "Vuori")
CHECKS = "0123456789ABCDEFHJKLMNPRSTUVWXY"


def _pick(values: tuple[str, ...], *key):
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(F.xxhash64(*key), F.lit(len(values))) + 1).cast("int"))


def _digits(n: int, *key):
    return F.lpad(F.pmod(F.xxhash64(*key), F.lit(10**n)).cast("string"), n, "0")


def records(spark: SparkSession, n: int, seed: int = 42) -> DataFrame:
    """n records of identifiers; the personal id has a check character that is always wrong."""
    s, i = F.lit(seed), F.col("id")
    ident = F.concat(F.lpad((F.pmod(F.xxhash64(s, i, F.lit("d")), F.lit(28)) + 1).cast("string"), 2, "0"), F.lpad((F.pmod(F.xxhash64(s, i, F.lit("m")), F.lit(12)) + 1).cast("string"), 2, "0"), _digits(2, s, i, F.lit("y")))
    number = _digits(3, s, i, F.lit("n"))
    right = F.pmod(F.concat(ident, number).cast("long"), F.lit(31))
    wrong = F.substring(F.lit(CHECKS), F.pmod(right + 1, F.lit(31)).cast("int") + 1, F.lit(1))
    return spark.range(n).select(
        "id", F.concat_ws(" ", _pick(FIRST, s, i, F.lit("f")), _pick(LAST, s, i, F.lit("l"))).alias("PERSON"), F.concat(ident, F.lit("-"), number, wrong).alias("PERSONAL_ID"),
        F.concat(F.lit("INV-"), _digits(5, s, i, F.lit("i"))).alias("INVOICE"), F.concat(F.lit("user"), i.cast("string"), F.lit("@example.com")).alias("EMAIL"),
        F.date_add(F.lit("2020-01-01").cast("date"), F.pmod(F.xxhash64(s, i, F.lit("t")), F.lit(1500)).cast("int")).cast("string").alias("DATE"),
    )


def render(rows: DataFrame, template: str) -> DataFrame:
    """(id, text, labels): ``{{TYPE}}`` places filled in, labels with exact offsets.

    The template is fixed, so every place's offset is the length of the text
    before it: no search, and a value that also stands elsewhere can't mislead.
    """
    import re

    parts = re.split(r"\{\{(\w+)\}\}", template)
    text, labels = F.lit(parts[0]), []
    for kind, after in zip(parts[1::2], parts[2::2], strict=True):
        start = F.length(text)
        labels.append(F.struct(F.lit(kind).alias("type"), F.col(kind).alias("value"), start.alias("start"), (start + F.length(kind)).alias("end")))
        text = F.concat(text, F.col(kind), F.lit(after))
    return rows.select("id", text.alias("text"), F.array(*labels).alias("labels"))


def visible_labels(rows: DataFrame, types: list[str]) -> DataFrame:
    """(id, type, value) of the record values that stand in the text, each once."""
    listed = F.array(*(F.struct(F.lit(t).alias("type"), F.col(t).alias("value")) for t in types))
    return rows.select("id", F.explode(F.array_distinct(F.filter(listed, lambda x: F.contains("text", x["value"])))).alias("l")).select("id", "l.*")


def split_dev(docs: DataFrame, dev: int, group: str, key: str = "id") -> DataFrame:
    """``dev`` documents of each group, by hash order, are ``dev`` and the others ``test``."""
    from pyspark.sql import Window

    return docs.withColumn("split", F.when(F.row_number().over(Window.partitionBy(group).orderBy(F.xxhash64(key), key)) <= dev, "dev").otherwise("test"))


def problems(docs: DataFrame) -> DataFrame:
    """(id, problem) where a label's offsets don't hold its value, labels overlap, or a value repeats unlabelled."""
    from .spans import occurrences

    each = docs.select("id", "text", F.explode("labels").alias("l")).select("id", "text", "l.*")
    wrong = each.filter(F.col("text").substr(F.col("start") + 1, F.col("end") - F.col("start")) != F.col("value")).select("id", F.lit("offsets").alias("problem"))
    a, b = each.alias("a"), each.alias("b")
    over = a.join(b, (F.col("a.id") == F.col("b.id")) & (F.struct("a.start", "a.end", "a.type") < F.struct("b.start", "b.end", "b.type")) & (F.col("a.end") > F.col("b.start"))).select(F.col("a.id").alias("id"), F.lit("overlap").alias("problem"))
    counts = each.groupBy("id", "text", "value").agg(F.count("*").alias("n")).filter(F.size(occurrences(F.col("text"), F.col("value"))) > F.col("n"))
    return wrong.union(over).union(counts.select("id", F.lit("unlabelled repeat").alias("problem"))).distinct()


def personal_id_shape():
    return PERSONAL_ID[0]
