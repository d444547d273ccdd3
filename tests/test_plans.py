"""What the plans of queries over memos may hold, whatever the size of the table."""

import random
import re

import pytest

from maskwright.operators import detect as D
from maskwright.operators import score as Q
from maskwright.operators import spans as S
from maskwright.plans import catalog as K
from maskwright.plans import memos as M
from maskwright.plans import wider as W


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["over_masking", "typed_recall", "typed_precision", "unlabelled_detections", "mention_recall", "text_tristate", "hidden_characters", "located_recall", "pseudonymised_text", "clause_bounds", "extraction_recall"])
def test_no_table_of_documents_is_broadcast(spark, sf, name):
    assert "Broadcast" not in plan(K.QUERIES[name](spark, sf))


@pytest.mark.parametrize("name", ["resolved_spans", "merged_touching", "merged_display", "dedup_max_score", "detection_counts"])
def test_more_rows_make_more_tasks(spark, sf, name, monkeypatch):
    monkeypatch.setattr(M, "ROWS", 100)
    df = K.QUERIES[name](spark, sf)
    dealt = re.findall(r"Exchange (\w+)\((.*?)\), (\w+)", plan(df))
    assert len(dealt) == 1 and re.fullmatch(r"o_orderkey#\d+L?, 15", dealt[0][1])  # 1,500 orders
    monkeypatch.setattr(M, "ROWS", 10)
    assert ", 150), REPARTITION" in plan(K.QUERIES[name](spark, sf))


def test_files_and_context_cases_are_dealt(spark, sf):
    for df in (W.QUERIES["extracted_files"](spark, sf), M.context_cases(spark, sf)[0]):
        assert "REPARTITION_BY_NUM" in plan(df)


def test_states_read_places_once(spark, sf):
    found = plan(K.typed(spark, sf))
    assert found.count("FileScan parquet") == 2  # places and spans
    assert len(re.findall("[^t]Exchange hash", found)) <= 2


def test_repeats_of_a_label_row_count_once(spark):
    labels = spark.createDataFrame([(1, 0, "A", "xy", 0), (1, 0, "A", "xy", 0)], "doc_id long, label_id long, type string, value string, start int")
    spans = spark.createDataFrame([("m", 1, 0, 2, "A", 1.0)], "method string, doc_id long, start int, end int, entity_type string, score double")
    got = Q.value_states(labels, None, spans, {"A": "A"}, ["m", "n"]).collect()
    assert sorted((r.method, r.state, r.occurrences) for r in got) == [("m", "covered", 1), ("n", "", 1)]


def test_union_runs_a_repeated_detector_once(spark):
    docs = spark.createDataFrame([(1, "ABC-123"), (2, "INV-12345 ABC-123")], "doc_id long, text string")
    once, other = D.pattern_spans(docs), D.pattern_spans(docs, [D.INVOICE])
    both = D.union(once, other, once)
    assert both.count() == 2 * once.count() + other.count() and both.columns == once.columns
    assert plan(both).count("Generate explode(concat") == 2


OLD = {
    "EMAIL": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}", "IPV4": r"\b(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\b",
    "CARD": r"\b\d{4}(?:[ -]?\d{4}){3}\b", "DATE": r"\b\d{4}-\d{2}-\d{2}\b", "BUSINESS_ID": r"(?U)(?<![\w-])\d{7}-\d(?![\w-])",
}


def test_faster_patterns_match_the_same(spark):
    deal = random.Random(1)
    bits = ["a", "b.c", "@", "@", ".", "com", "c", "%", "-", "1", "12", "255", "1.2.3.4", "0001", "4111", "2024-01-02", "1234567-8", " ", "\n", "é", "٣", "😀", "_", "\x01"]
    texts = ["".join(deal.choice(bits) for _ in range(deal.randrange(1, 30))) for _ in range(3000)] + ["a@b.com.c@d.org", "a" * 3000, "x@y.zz" * 50]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for name, old in OLD.items():
        assert df.filter(~D.match_array(df.text, getattr(D, name)[0]).eqNullSafe(D.match_array(df.text, old))).select("text").limit(3).collect() == []


def test_occurrences_of_any_number(spark):
    deal = random.Random(2)
    rows = [("".join(deal.choice("ab😀") for _ in range(deal.randrange(0, 14))), "".join(deal.choice("ab😀") for _ in range(deal.randrange(0, 4)))) for _ in range(2000)]
    df = spark.createDataFrame([*rows, (None, "a"), ("a", None)], "t string, v string")
    want = [[i for i in range(len(t)) if t.startswith(v, i)] if v else [] for t, v in rows]
    assert [r.at for r in df.select(S.occurrences(df.t, df.v).alias("at")).collect()][: len(rows)] == want
