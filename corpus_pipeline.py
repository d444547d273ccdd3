"""A cleaning pipeline over ``documents`` made of operators of maskwright.llm.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before
kept. Its result is written as Parquet and reread as the next one's docs; all
other tables that a stage writes are deleted, and so is the stage's input.

Defined results: documents whose text is null, empty or without a letter go in
the first stage; very long texts pass every stage whole; rows that share a doc_id
are documents of their own for language, copies and encoding, and one document
for repeated lines; of near copies (ties too) one row of the least doc_id stays;
a row without an id is never a copy of another; an empty table passes as an empty
table. Stages return the columns of ``documents`` alone, so extra columns, also
such as are named like an operator's result, end in the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.llm import bpe, decontaminate, language_id, line_dedup, ngram_join
from maskwright.llm.common import discard, settled, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A text of several languages is still clean; one below this has no clear one.
LEAST_SCORE = 0.2
#: Least share of a text's trigrams that the learned languages explain better than chance.
LEAST_FIT = 1 / 3


def reject_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter, those of no clear language and those that no learned language explains."""
    model = language_id.fit_documents(docs)
    found = language_id.identify_language(docs, model)
    return found.filter((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_SCORE) & (F.col("lang_fit") >= LEAST_FIT)).select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines that three documents or more hold from all but the largest doc_id; documents left without a word go."""
    out = line_dedup.dedup_lines(docs)
    gone = (F.col("n_dropped") > 0) & ~F.col("text").rlike(decontaminate.SQL_WORD)
    return out.filter(~F.coalesce(gone, F.lit(False))).withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the least doc_id of each group of near-duplicates."""
    return ngram_join.drop_near_duplicates(docs).select(*COLUMNS)


def remove_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents with windows of two benchmark items or more and cuts one item's passage out of the others; documents left without a word go."""
    out = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), remove="leaks")
    cut = F.col("n_cut") > 0
    return out.filter(~cut | F.col("text").rlike(decontaminate.SQL_WORD)).withColumn("n_chars", F.when(cut, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds the token ids, their number and whether they decode to the text; it is the last stage, so its columns differ."""
    encoded = bpe.encode_documents(docs.select(*COLUMNS))
    same = F.col("decoded_text") == F.coalesce("text", F.lit(""))
    return encoded.select(*COLUMNS, "token_ids", F.size("token_ids").cast("long").alias("n_tokens"), same.alias("round_trip"))


STAGES = [
    ("language ID", reject_unknown_language),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("benchmark decontamination", remove_benchmark_leaks),
    ("BPE encoding and decoding", encode),
]

#: Several stages have no SQL form; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        kept = settled(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), name.replace(" ", "-"))
        discard(docs)
        docs = kept
    return docs
