"""What fails and what is empty in evaluations; their figures are held to SQL in test_catalog."""

import pytest
from pyspark.sql import functions as F

from maskwright.functions import forms as T
from maskwright.operators import evaluate as E


def test_unchanged(spark):
    files = spark.createDataFrame([("a", b"1"), ("b", b"2")], "path string, content binary")
    frozen = files.select("path", F.sha2("content", 256).alias("sha256"))
    assert E.unchanged(files, frozen).count() == 2
    for bad in (frozen.filter("path = 'a'"), frozen.withColumn("sha256", F.lit("0")), frozen.unionByName(frozen.limit(1).withColumn("path", F.lit("c")))):
        with pytest.raises(Exception, match="differs"):
            E.unchanged(files, bad).collect()


def test_cache(spark):
    docs = spark.createDataFrame([(1, "en", "x y"), (2, "en", "x y"), (3, "fi", "x y")], "doc_id long, language string, text string")
    spans = spark.createDataFrame([(1, 0, 1, "PERSON", 0.5), (2, 0, 1, "PERSON", 0.5)], "doc_id long, start int, end int, entity_type string, score double")
    cache = E.span_cache(docs, spans, "m", "c", "s")
    assert cache.count() == 2
    assert sorted(tuple(r) for r in E.cached_spans(docs, cache, "m", "c", "s").collect()) == [(1, 0, 1, "PERSON", 0.5), (2, 0, 1, "PERSON", 0.5)]
    for args in (("n", "c", "s"), ("m", "d", "s"), ("m", "c", "t")):
        with pytest.raises(Exception, match="differs"):
            E.cached_spans(docs, cache, *args).collect()
    with pytest.raises(Exception, match="lacks a text"):
        E.cached_spans(docs.withColumn("text", F.lit("new")), cache, "m", "c", "s").collect()


def test_word_occurrences_across_lines(spark):
    words = spark.createDataFrame([(1, 0, "aa", 0), (1, 1, "aa", 0), (1, 2, "aa", 1), (2, 0, "b", 0)], "doc_id long, idx int, text string, line int")
    values = spark.createDataFrame([(1, "aa aa"), (1, "a a"), (2, "c"), (3, "b")], "doc_id long, value string")
    got = sorted((r.doc_id, r.value, r.start, r.words) for r in E.word_occurrences(words, values).collect())
    assert got == [(1, "a a", 1, [0, 1]), (1, "a a", 4, [1, 2]), (1, "aa aa", 0, [0, 1]), (1, "aa aa", 3, [1, 2])]


def test_forms(spark):
    lines = ["| a |  b\\|c | `x|y` |", "no pipe", "|", "", None, "a||b", "\\| | z", "|\u3000å |"]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "id int, line string")
    cut = F.transform(T.table_cells(F.col("line")), lambda c: F.col("line").substr(c["start"] + 1, c["end"] - c["start"]))
    got = [r.cells for r in rows.select("id", cut.alias("cells")).orderBy("id").collect()]
    assert got == [["a", "b\\|c", "`x|y`"], None, None, None, None, ["a", "", "b"], ["\\|", "z"], ["å"]]
    one = spark.range(1).select(T.canonical_json(F.lit(' {"b":1.5, "a":{"z":[ ], "y":"\\u00e5"}}')).alias("j"), T.signature(F.lit(None)).alias("n"), T.signature(F.lit("")).alias("e")).first()
    assert one.j == '{"a":{"y":"å","z":[]},"b":1.5}' and one.n != one.e


def test_empty_groups(spark):
    documents = spark.createDataFrame([(1, "m", 0, 0, 0, 0, 1.0)], "doc_id long, method string, words long, words_blacked long, other_words long, other_words_blacked long, seconds double")
    entities = spark.createDataFrame([], "doc_id long, state string, text_hidden boolean")
    row = E.image_summary(documents, entities, "method").first()
    assert (row.planted, row.image_recall, row.hidden_of_planted, row.over_redaction) == (0, 0.0, None, 0.0)
