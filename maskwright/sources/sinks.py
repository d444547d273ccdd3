"""Writers that never overwrite, and the upsert of partial reruns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.report import matrix_upsert


def output_names(files: DataFrame, taken: DataFrame) -> DataFrame:
    """files(path) with ``output``: <name>_anonymized.md, or with the next free number where that name is taken."""
    stem = F.regexp_extract("path", r"[^/]*$", 0)
    used = taken.select(F.regexp_replace("output", r"_anonymized(_\d+)?\.md$", "").alias("stem"), F.coalesce(F.try_to_number(F.regexp_extract("output", r"_anonymized_(\d+)\.md$", 1), F.lit("999999")).cast("int"), F.lit(1)).alias("n")).groupBy("stem").agg(F.max("n").alias("last"))
    ranked = files.withColumn("stem", stem).withColumn("_r", F.row_number().over(Window.partitionBy("stem").orderBy("path"))).join(used, "stem", "left")
    n = F.col("_r") + F.coalesce("last", F.lit(0))
    return ranked.withColumn("output", F.concat("stem", F.lit("_anonymized"), F.when(n > 1, F.concat(F.lit("_"), n.cast("string"))).otherwise(""), F.lit(".md"))).drop("stem", "_r", "last")


def write_new(df: DataFrame, path: str, fmt: str = "parquet", **options) -> None:
    """Writes to a path that must not be there yet."""
    df.write.format(fmt).options(**options).mode("errorifexists").save(path)


def write_reports(tables: dict[str, DataFrame], folder: str) -> None:
    """Each table as CSV and JSON in a folder of its own."""
    for name, df in tables.items():
        write_new(df, f"{folder}/{name}.csv", "csv", header=True)
        write_new(df, f"{folder}/{name}.json", "json")


def markdown_report(df: DataFrame, most: int = 1000) -> str:
    """A small aggregate as a Markdown table; fails on more than ``most`` rows."""
    rows = df.take(most + 1)
    if len(rows) > most:
        raise ValueError(f"a report has {most} rows at most")
    show = lambda v: "–" if v is None else f"{v:.4g}" if isinstance(v, float) else str(v).replace("|", "\\|")
    return "\n".join(["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns), *("| " + " | ".join(map(show, r)) + " |" for r in rows)])


def upsert(spark: SparkSession, path: str, new: DataFrame, keys: list[str], target: str) -> None:
    """Results at ``path`` with the rerun keys replaced, as a new table at ``target``."""
    write_new(matrix_upsert(spark.read.parquet(path), new, keys), target)


def write_span_log(docs: DataFrame, spans: DataFrame, path: str) -> None:
    """Spans keyed by the text's digest; raw texts may only go under a folder named outputs."""
    if "/outputs/" not in f"{path}/":
        raise ValueError("span logs go under a folder named outputs")
    keyed = docs.select("doc_id", F.sha2("text", 256).alias("text_sha256"))
    write_new(keyed.join(spans, "doc_id", "left").drop("doc_id"), path, "json")
