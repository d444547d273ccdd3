"""Labelled corpora: manifests and the external formats, as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import ordered as O

# The external corpora's label types and the scored types; what isn't listed is not scored.
COURT_TYPES = {"PERSON": "PERSON", "ORG": "COMPANY", "LOC": "ADDRESS", "DATETIME": "DATE", "CODE": "CODE", "DEM": "DEM", "QUANTITY": "QUANTITY", "MISC": "MISC"}
NER_TYPES = {"PER": "PERSON", "ORG": "COMPANY", "LOC": "ADDRESS", "DATE": "DATE"}
PII_TYPES = {
    "GIVENNAME": "PERSON", "SURNAME": "PERSON", "EMAIL": "EMAIL", "TELEPHONENUM": "PHONE", "DATE": "DATE", "CITY": "CITY", "STREET": "STREET", "ZIPCODE": "ZIPCODE", "BUILDINGNUM": "BUILDINGNUM", "AGE": "AGE",
    "CREDITCARDNUMBER": "CREDITCARD", "IDCARDNUM": "IDCARDNUM", "PASSPORTNUM": "PASSPORTNUM", "DRIVERLICENSENUM": "DRIVERLICENSENUM", "TAXNUM": "TAXNUM", "SOCIALNUM": "SOCIALNUM",
}
MANIFEST = "file string, language string, format string, entities int, hidden int, quality string"
LABEL = "file string, language string, format string, quality string, entities array<struct<type:string,value:string,location:string>>"
COURT = "doc_id string, text string, annotations map<string,struct<entity_mentions:array<struct<start_offset:int,end_offset:int,entity_type:string,identifier_type:string>>>>"
PII = "uid string, source_text string, language string, privacy_mask array<struct<label:string,start:int,end:int>>"


def _map(types: dict[str, str], key):
    return F.create_map(*[F.lit(x) for p in types.items() for x in p])[key]


def manifest_labels(spark: SparkSession, folder: str) -> DataFrame:
    """(file, language, format, quality, label_id, type, value, location) of the labels that ``index.csv`` names.

    The manifest decides which files count and in what order. A label file that
    differs from it in format, language, quality or count fails the query.
    """
    index = spark.read.schema(MANIFEST).option("header", True).csv(f"{folder}/index.csv").withColumn("quality", F.coalesce("quality", F.lit("standard")))
    files = spark.read.schema(LABEL).option("multiLine", True).json(f"{folder}/labels")
    made = files.select("file", F.col("language").alias("l"), F.col("format").alias("f"), F.coalesce("quality", F.lit("standard")).alias("q"), F.col("entities").alias("e"))
    met = index.join(made, "file", "left")
    fine = F.coalesce((F.col("l") == F.col("language")) & (F.col("f") == F.col("format")) & (F.col("q") == F.col("quality")) & (F.size("e") == F.col("entities")), F.lit(False))
    checked = met.filter(F.assert_true(fine, F.concat(F.lit("manifest and labels differ: "), "file")).isNull())
    return checked.select("file", "language", "format", "quality", F.posexplode("e").alias("label_id", "x")).select("file", "language", "format", "quality", "label_id", "x.type", "x.value", F.coalesce("x.location", F.lit("body")).alias("location"))


def with_texts(labels: DataFrame, texts: DataFrame, key: str = "file") -> DataFrame:
    """Labels with their document's text; a document that could not be read has an empty text and keeps its labels."""
    return labels.join(texts.select(key, "text"), key, "left").withColumn("text", F.coalesce("text", F.lit("")))


def court(records: DataFrame, documents: int = 40, every: int = 3) -> DataFrame:
    """Court judgments in COURT's schema: (doc_id, text, mentions, annotated).

    Every third document in the order of doc_id, then the first ``documents``
    (0: all). The annotator of the least name counts; of repeated ranges the
    last does. NO_MASK is no mention but still annotated.
    """
    kept = O.every_nth(records, ["doc_id"], every)
    if documents:
        kept = O.row_numbers(kept, ["doc_id"], "_n").filter(F.col("_n") <= documents).drop("_n")
    mine = kept.withColumn("_m", F.col("annotations")[F.array_min(F.map_keys("annotations"))]["entity_mentions"])
    rows = mine.select("doc_id", "text", F.posexplode_outer("_m").alias("_at", "m")).select("doc_id", "text", "_at", F.col("m.start_offset").alias("start"), F.col("m.end_offset").alias("end"), F.col("m.entity_type").alias("raw"), "m.identifier_type")
    last = rows.withColumn("_r", F.row_number().over(Window.partitionBy("doc_id", "start", "end").orderBy(F.desc("_at")))).filter("_r = 1").withColumn("type", _map(COURT_TYPES, F.col("raw")))
    mention = F.struct("start", "end", "type", "identifier_type")
    return last.groupBy("doc_id", "text").agg(
        F.array_sort(F.collect_list(F.when(F.col("type").isNotNull() & (F.col("identifier_type") != "NO_MASK"), mention))).alias("mentions"),
        F.array_sort(F.collect_list(F.when(F.col("start").isNotNull(), F.struct("start", "end")))).alias("annotated"),
    )


def standoff(files: DataFrame, sentences: int = 300) -> DataFrame:
    """Standoff NER files (doc_id, text, ann): documents until the sentence budget is reached, the crossing one included."""
    lines = F.size(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")).cast("long")
    kept = O.budget(files, ["doc_id"], lines, sentences)
    pattern = r"(?m)^T\d+\t(\S+) (\d+) (\d+)\t"
    part = lambda g: F.regexp_extract_all("ann", F.lit(pattern), F.lit(g))
    zipped = F.transform(F.arrays_zip(part(1).alias("k"), part(2).alias("s"), part(3).alias("e")), lambda x: F.struct(x["s"].cast("int").alias("start"), x["e"].cast("int").alias("end"), _map(NER_TYPES, x["k"]).alias("type")))
    return kept.withColumn("annotated", F.transform(zipped, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end")))).withColumn("mentions", F.filter(zipped, lambda m: m["type"].isNotNull())).drop("ann")


def pii(records: DataFrame, rows: int = 300) -> DataFrame:
    """PII records in PII's schema: the same hash-ordered sample each time, ``rows`` a language."""
    kept = O.hash_sample(records, "uid", rows, "language")
    found = F.filter(F.transform("privacy_mask", lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), _map(PII_TYPES, m["label"]).alias("type"))), lambda m: m["type"].isNotNull())
    return kept.select(F.col("uid").alias("doc_id"), F.col("source_text").alias("text"), "language", found.alias("mentions"), F.transform("privacy_mask", lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"))).alias("annotated"))


def truncated(docs: DataFrame, most: int = 400_000) -> DataFrame:
    return docs.withColumn("text", F.expr(f"substring(text, 1, {int(most)})"))


def contextual(spark: SparkSession, folder: str) -> DataFrame:
    """The contextual corpus: (id, language, split, text, labels, decoys); texts keep their line ends."""
    kind = "id string, language string, split string, labels array<struct<value:string,category:string,start:int,end:int>>, decoys array<struct<value:string,kind:string,start:int,end:int>>"
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").load(folder)
    texts = files.select(F.regexp_extract("path", r"([^/]+)\.md$", 1).alias("id"), F.decode("content", "UTF-8").alias("text"))
    index = spark.read.schema("id string, language string, split string").option("multiLine", True).json(f"{folder}/index.json").select("id")
    records = spark.read.schema(kind).option("multiLine", True).option("pathGlobFilter", "*.json").json(folder).filter("labels IS NOT NULL")
    met = index.join(records, "id").join(texts, "id")
    good = F.forall("labels", lambda x: F.col("text").substr(x["start"] + 1, x["end"] - x["start"]) == x["value"])
    return met.filter(F.assert_true(good, "a label's offsets don't hold its value").isNull())


def replay(docs: DataFrame, *logs: DataFrame) -> DataFrame:
    """Spans of logs (text_sha256, start, end, entity_type, score) for documents; a text that no log knows fails the query."""
    from functools import reduce

    every = reduce(DataFrame.unionByName, logs)
    keyed = docs.select("doc_id", F.sha2("text", 256).alias("text_sha256"))
    known = keyed.join(every.select("text_sha256", F.lit(True).alias("_k")).distinct(), "text_sha256", "left")
    sure = known.filter(F.assert_true(F.col("_k").isNotNull(), "a document is in no span log").isNull())
    return sure.join(every.filter("start IS NOT NULL"), "text_sha256").select("doc_id", "start", "end", "entity_type", "score")


def combined_tables(spark: SparkSession, paths: list[str]) -> DataFrame:
    """CSV files joined by column name with ``source_file``; anonymised copies are left out."""
    from functools import reduce

    frames = [spark.read.option("header", True).csv(p).withColumn("source_file", F.regexp_extract(F.input_file_name(), "[^/]*$", 0)) for p in paths]
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return out.filter(~F.startswith("source_file", F.lit("anonymized_")))


def tool_sections(logs: DataFrame, names: list[str]) -> DataFrame:
    """logs(file, text) of other tools cut at their section titles, which must come in order; rulers of = signs go."""
    at = [F.locate(f"\n{n}\n", F.concat(F.lit("\n"), F.col("text"), F.lit("\n"))) for n in names]
    from functools import reduce

    ordered = reduce(lambda a, b: a & b, [x > 0 for x in at] + [x < y for x, y in zip(at, at[1:], strict=False)])
    checked = logs.filter(F.assert_true(ordered, F.concat(F.lit("sections are missing or out of order: "), "file")).isNull())
    ends = [*at[1:], F.length("text") + 2]
    cut = lambda a, e, n: F.trim(F.regexp_replace(F.col("text").substr(a + len(n) + 1, e - a - len(n) - 1), r"(?m)^=+$", ""))
    return checked.select("file", *(cut(a, e, n).alias(n) for a, e, n in zip(at, ends, names, strict=True)))
