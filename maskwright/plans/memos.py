"""A labelled memo corpus made of the ``orders`` table.

The expressions are plain SQL that Spark and the test oracle both read, so both
make the same texts and know the planted values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import spans as S

LETTERS = "ABCDEFGHIJKLMNOPRSTUVXYZ"
CHECKS = "0123456789ABCDEFHJKLMNPRSTUVWXY"
COMPANIES = ("Acme Oy", "Nordic Steel Ltd", "Blue Rose Inc", "Delta Works", "Kivi Group")
GLOSSARY = ["Acme Oy", "Blue Rose Inc", "Delta Works"]


def _pad(x: str, n: int) -> str:
    return f"lpad(CAST({x} AS STRING), {n}, '0')"


K, C = "o_orderkey", "o_custkey"
FIELDS = {
    "language": f"CASE {K} % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'fi' ELSE 'de' END",
    "format": f"CASE {K} % 4 WHEN 0 THEN 'docx' WHEN 1 THEN 'md' WHEN 2 THEN 'csv' ELSE 'xlsx' END",
    "split": f"CASE WHEN {K} % 12 < 3 THEN 'dev' ELSE 'test' END",
    "invoice": f"CASE WHEN {K} % 7 = 0 THEN 'INV ' ELSE 'INV-' END || {_pad(f'{K} % 100000', 5)}",
    "plate": f"CASE WHEN {K} % 11 = 0 THEN 'Q' ELSE substr('{LETTERS}', CAST({K} % 24 + 1 AS INT), 1) END || substr('{LETTERS}', CAST({C} % 24 + 1 AS INT), 1) || substr('{LETTERS}', CAST(({K} + {C}) % 24 + 1 AS INT), 1) || '-' || {_pad(f'({K} * 7) % 1000', 3)}",
    "person": f"{_pad(f'({K} * 13) % 1000000', 6)} || CASE WHEN {K} % 5 = 0 THEN 'A' ELSE '-' END || {_pad(f'{K} % 1000', 3)} || substr('{CHECKS}', CAST({K} % 31 + 1 AS INT), 1)",
    "email": f"CASE WHEN {K} % 5 = 1 THEN 'a+b' ELSE 'clerk.' END || CAST({C} AS STRING) || '@example.com'",
    "author": f"'author' || CAST({C} % 97 AS STRING) || '@example.org'",
    "company": f"CASE {K} % 5 " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(COMPANIES[:-1])) + f" ELSE '{COMPANIES[-1]}' END",
    "phone": f"'040 ' || {_pad(f'({K} * 17) % 10000000', 7)}",
    "business": f"{_pad(f'({K} * 31) % 10000000', 7)} || '-' || CAST({K} % 10 AS STRING)",
    "vat": f"'FI' || {_pad(f'({K} * 37) % 100000000', 8)}",
    "day": "CAST(CAST(o_orderdate AS DATE) AS STRING)",
    "address": f"'10.' || CAST({K} % 256 AS STRING) || '.' || CAST({C} % 256 AS STRING) || '.7'",
}
TEXT = " || chr(10) || ".join(
    [
        "'# Order memo ' || CAST(doc_id AS STRING)", "''", "'## Document metadata'", "'- author: ' || author", "''", "'## Document content'",
        "'Invoice ' || invoice || ' of ' || day || ' for ' || company || '.'", "'Vehicle ' || plate || ', driver ' || person || ', again ' || plate || '.'",
        "'Mail ' || email || ' from ' || address || '.'", "'Company ' || business || ' under ' || vat || '.'", "''", "'## Review comments'", "'Call ' || phone || ' about ' || invoice || '.'",
    ]
)
#: label type, value column, location
LABELS = [("INVOICE", "invoice", "body"), ("PLATE", "plate", "body"), ("PERSONAL_ID", "person", "body"), ("EMAIL", "email", "body"), ("EMAIL", "author", "metadata"), ("COMPANY", "company", "body"), ("PHONE", "phone", "comment"), ("DATE", "day", "body")]


#: Texts that the context filter is asked about: before, the detected part, after, its type, whether it stays.
CONTEXT_CASES = [
    ("The warranty lasts for ", "24 months", ".", "DATE_TIME", False),
    ("She is ", "24 months", " old.", "DATE_TIME", True),
    ("Complies with ISO 9001:", "2015", " fully", "DATE_TIME", False),
    ("Ask the ", "Project Manager", " today", "PERSON", False),
    ("Ask Project Manager ", "Ann", " today", "PERSON", True),
    ("Goods arrive at ", "the warehouse", ".", "LOCATION", False),
    ("Goods arrive at her ", "warehouse", ".", "LOCATION", True),
    ("Takuu on voimassa ", "2 vuotta", "", "DATE_TIME", False),
    ("Hours: ", "12", "", "DATE_TIME", False),
    ("The agreement runs for ", "6 months", ".", "DATE_TIME", False),
    ("Her agreement runs for ", "6 months", ".", "DATE_TIME", True),
    ("It rained for ", "6 months", ".", "DATE_TIME", True),
    ("Patient stays, duration: ", "3 weeks", ".", "DATE_TIME", True),
    ("Kesto: ", "3 viikkoa", "", "DATE_TIME", False),
    ("EN ", "2024-01-15", " was the day", "DATE_TIME", True),
    ("Standard EN ", "2024-01", " applies", "DATE_TIME", False),
    ("Born under ISO 9001:", "2015", " rules", "DATE_TIME", True),
    ("ASTM A36/", "A36M-19", " steel", "US_DRIVER_LICENSE", False),
    ("", "Laatupäällikkö", " vastaa", "PERSON", False),
    ("Tavarat saapuvat ", "varastoon", ".", "LOCATION", False),
    ("Pallets go to ", "depot", " 4.", "LOCATION", True),
    ("Stock moved into ", "the storeroom", ", but the trucks wait.", "LOCATION", False),
    ("She lives near ", "the warehouse", ".", "LOCATION", True),
    ("Stock left Riverton for ", "the depot", ".", "LOCATION", True),
    ("EN ", "1234567", "-2", "DATE_TIME", True),
    ("Allocated hours: ", "40", "", "DATE_TIME", False),
    ("Toimitus on voimassa ", "kolme päivää", "", "DATE_TIME", False),
    ("Pay the sales ", "director Ann", "", "PERSON", True),
]


def spread(df: DataFrame) -> DataFrame:
    """Rows of an input of few partitions over all cores, before work that is heavy for its size; larger inputs stay as they are read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


#: Rows a task makes texts of.
ROWS = 20_000


def dealt(df: DataFrame, key: str) -> DataFrame:
    """The rows of a Parquet table dealt by a key, ``ROWS`` a task or less where there are more cores.

    More rows make more tasks, not larger ones, and what is grouped, ordered or
    joined by the key later on moves no row again. The count reads footers only.
    """
    n = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // ROWS))
    return df.repartition(n, key)


def memos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, language, format, split, the planted values, text), one memo an order."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(K, C, "o_orderdate")
    return dealt(orders, K).select(F.col(K).alias("doc_id"), *(F.expr(e).alias(n) for n, e in FIELDS.items())).withColumn("text", F.expr(TEXT))


def listed_labels():
    return F.array(*(F.struct(F.lit(i).cast("long").alias("label_id"), F.lit(t).alias("type"), F.col(c).alias("value"), F.lit(loc).alias("location")) for i, (t, c, loc) in enumerate(LABELS)))


def labels(memo: DataFrame) -> DataFrame:
    """(doc_id, language, format, split, label_id, type, value, location)"""
    return memo.select("doc_id", "language", "format", "split", F.explode(listed_labels()).alias("l")).select("doc_id", "language", "format", "split", "l.*")


def places(memo: DataFrame) -> DataFrame:
    """The labels with their places, found where text and labels are one row."""
    return S.nested_places(memo.select("doc_id", "language", "format", "split", "text", listed_labels().alias("labels")))


MEMO_SQL = f"memo AS (SELECT *, {TEXT} AS text FROM (SELECT {K} AS doc_id, " + ", ".join(f"{e} AS {n}" for n, e in FIELDS.items()) + " FROM orders))"
LABEL_SQL = "label AS (" + " UNION ALL ".join(f"SELECT doc_id, language, format, split, {i} AS label_id, '{t}' AS type, {c} AS value, '{loc}' AS location FROM memo" for i, (t, c, loc) in enumerate(LABELS)) + ")"
CONTEXT_VALUES = ", ".join("({}, '{}', '{}', '{}', '{}', {})".format(i, a, p, z, t, str(stays).lower()) for i, (a, p, z, t, stays) in enumerate(CONTEXT_CASES))
#: Two of the cases an order, in lines of their own; the mark keeps a number at the end of one apart from a word of the next.
CONTEXT_SQL = f"""context_case AS (SELECT * FROM (VALUES {CONTEXT_VALUES}) AS t(k, a, p, z, kind, stays)),
context_doc AS (SELECT o_orderkey AS doc_id, x.a || x.p || x.z || ' ## ' || chr(10) || y.a || y.p || y.z AS text, length(x.a) AS s1, length(x.a || x.p) AS e1, x.kind AS t1, x.stays AS stays1,
  length(x.a || x.p || x.z || ' ## ' || chr(10) || y.a) AS s2, length(x.a || x.p || x.z || ' ## ' || chr(10) || y.a || y.p) AS e2, y.kind AS t2, y.stays AS stays2
  FROM orders JOIN context_case x ON x.k = o_orderkey % {len(CONTEXT_CASES)} JOIN context_case y ON y.k = o_custkey % {len(CONTEXT_CASES)})"""


def context_cases(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(documents, spans) of the context cases."""
    dealt(spark.read.parquet(f"{sf_dir}/orders.parquet").select(K, C), K).createOrReplaceTempView("_context_orders")
    made = spark.sql(f"WITH {CONTEXT_SQL.replace('FROM orders', 'FROM _context_orders')} SELECT * FROM context_doc")
    one = lambda n: F.struct(F.col(f"s{n}").cast("int").alias("start"), F.col(f"e{n}").cast("int").alias("end"), F.col(f"t{n}").alias("entity_type"), F.lit(0.9).alias("score"))
    return made.select("doc_id", "text"), made.select("doc_id", F.explode(F.array(one(1), one(2))).alias("s")).select("doc_id", "s.*")
