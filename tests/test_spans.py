"""The span kernel against plain Python on random documents and against small vectors."""

import random

import pytest
from pyspark.sql import functions as F

from maskwright.operators import detect as D
from maskwright.operators import redact as R
from maskwright.operators import score as Q
from maskwright.operators import spans as S

SCHEMA = "doc_id long, start int, end int, entity_type string, score double"
ALPHABET = "ab Å😀\nÄ-1"


def corpus(seed, n=120):
    rng = random.Random(seed)
    docs, spans = [], []
    for d in range(n):
        text = "".join(rng.choices(ALPHABET, k=rng.randint(0, 40)))
        docs.append((d, text))
        for _ in range(rng.randint(0, 8) if text else 0):
            a = rng.randrange(len(text))
            spans.append((d, a, rng.randint(a + 1, min(len(text), a + 9)), rng.choice(["A", "B_1", "C"]), rng.choice([0.1, 0.5, 0.9])))
    return docs, spans


def resolve(spans):
    out = []
    for d in sorted({s[0] for s in spans}):
        group, reach = [], -1
        for s in sorted((x for x in spans if x[0] == d), key=lambda x: (x[1], x[2], x[3], -x[4])) + [(d, 10**9, 0, "", 0)]:
            if group and s[1] >= reach:
                best = min(group, key=lambda x: (-x[4], x[1] - x[2], x[3], x[1]))
                out.append((d, group[0][1], reach, best[3], best[4]))
                group, reach = [], -1
            group.append(s)
            reach = max(reach, s[2])
    return sorted(out)


def frames(spark, docs, spans):
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(spans, SCHEMA)


def test_resolve_redact_and_pseudonymise(spark):
    docs, spans = corpus(1)
    df, sp = frames(spark, docs, spans)
    want = resolve(spans)
    assert sorted(map(tuple, S.resolve(sp).collect())) == want
    redacted, named = {}, {}
    for d, t in docs:
        at, out, alias, numbers = 0, ["", ""], {}, {}
        for _, a, b, kind, _ in (x for x in want if x[0] == d):
            key = (kind, t[a:b])
            if key not in alias:
                alias[key] = numbers[kind] = numbers.get(kind, 0) + 1
            out = [out[0] + t[at:a] + f"[{kind}]", out[1] + t[at:a] + f"[{kind}_{alias[key]}]"]
            at = b
        redacted[d], named[d] = out[0] + t[at:], out[1] + t[at:]
    assert dict(map(tuple, R.redact(df, sp).collect())) == redacted
    assert dict(map(tuple, R.pseudonymise(df, sp).collect())) == named
    alias, numbers = {}, {}
    for d, a, b, kind, _ in want:
        key = (kind, docs[d][1][a:b])
        if key not in alias:
            alias[key] = numbers[kind] = numbers.get(kind, 0) + 1
    got = {(r.entity_type, r.value): r.n for r in R.aliases(df, sp, "corpus").collect()}
    assert got == alias


def test_touching_and_coverage(spark):
    docs, spans = corpus(2)
    df, sp = frames(spark, docs, spans)
    hidden = {d: {i for s in spans if s[0] == d for i in range(s[1], s[2])} for d, _ in docs}
    got = {}
    for r in S.merge_touching(sp).collect():
        assert r.start - 1 not in hidden[r.doc_id] and r.end not in hidden[r.doc_id]
        got.setdefault(r.doc_id, set()).update(range(r.start, r.end))
    assert got == {d: h for d, h in hidden.items() if h}
    targets = sp.limit(60).select("doc_id", "entity_type", "start", "end").distinct()
    few = sp.filter("score < 0.3")
    for typed in (False, True):
        for r in S.coverage(targets, few, typed).collect():
            cover = {i for s in spans if s[0] == r.doc_id and s[4] < 0.3 and (not typed or s[3] == r.entity_type) for i in range(s[1], s[2])}
            assert r.covered_chars == len(cover & set(range(r.start, r.end)))


def test_vectors(spark):
    sp = spark.createDataFrame([(1, 0, 17, "PERSON", 0.8), (1, 7, 24, "LOCATION", 0.8), (1, 7, 17, "PERSON", 0.9), (2, 0, 5, "A", 0.5), (2, 5, 8, "A", 0.5)], SCHEMA)
    assert sorted(map(tuple, S.resolve(sp).collect())) == [(1, 0, 24, "PERSON", 0.9), (2, 0, 5, "A", 0.5), (2, 5, 8, "A", 0.5)]
    assert sorted(map(tuple, S.merge_touching(sp).collect())) == [(1, 0, 24), (2, 0, 8)]
    assert sorted((r.doc_id, r.start, r.end, r.entity_type) for r in S.merge_display(sp).collect()) == [(1, 0, 24, "PERSON"), (2, 0, 5, "A"), (2, 5, 8, "A")]


def test_occurrences_overlap_and_escape(spark):
    rng = random.Random(4)
    rows = [("aaa", "aa"), ("a\\Eb\\Eb", "\\Eb"), ("😀a😀", "😀"), ("", "a"), ("abc", ""), ("x.x", ".")]
    rows += [("".join(rng.choices("aÅ😀\n.", k=rng.randint(0, 30))), "".join(rng.choices("aÅ😀\n.", k=rng.randint(1, 3)))) for _ in range(400)]
    df = spark.createDataFrame(rows, "t string, v string")
    for r in df.select("t", "v", S.occurrences(F.col("t"), F.col("v")).alias("o")).collect():
        assert r.o == [i for i in range(len(r.t)) if r.v and r.t.startswith(r.v, i)]


def test_invalid_spans_are_rejected(spark):
    docs = spark.createDataFrame([(1, "abcdef")], "doc_id long, text string")
    bad = [(1, -1, 2, "A", 0.5), (1, 2, 2, "A", 0.5), (1, 0, 7, "A", 0.5), (1, 0, 1, "a", 0.5), (1, 0, 1, "A", 1.5), (1, 0, 1, "A", float("nan")), (2, 0, 1, "A", 0.5), (1, 0, 1, "A", None)]
    good, rejected = S.validate(spark.createDataFrame([*bad, (1, 0, 1, "A", 1.0), (1, 0, 1, "A", 1.0)], SCHEMA), docs)
    assert good.count() == 1 and rejected.count() == len(bad)
    with pytest.raises(Exception, match="invalid span"):
        S.require_valid(spark.createDataFrame(bad[:1], SCHEMA), docs).collect()


def test_pattern_offsets_are_code_points(spark):
    texts = ["Åsa 😀 ABC-123 INV-12345", "ÄABC-123 ABC-123x QBC-123", "010190-123A 1234567-8 x1234567-8 FI12345678 fi 12345678", "", None, "ABC-123" * 2 + " ABC-123", "\x01ABC-123\x01 x ABC-124"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = D.pattern_spans(df, (*D.PROJECT, D.BUSINESS_ID, D.VAT), keep_value=True).collect()
    assert got and all(texts[r.doc_id][r.start : r.end] == r.value for r in got)
    assert sorted((r.doc_id, r.value) for r in got) == sorted([(0, "ABC-123"), (0, "INV-12345"), (2, "010190-123A"), (2, "1234567-8"), (2, "FI12345678"), (2, "fi 12345678"), (5, "ABC-123"), (6, "ABC-123"), (6, "ABC-124")])
    with pytest.raises(ValueError):
        D.glossary_spans(df, "Acme")
    found = D.glossary_spans(spark.createDataFrame([(1, "ACME oy (x) acme oyx")], "doc_id long, text string"), [" Acme Oy "]).collect()
    assert [(r.start, r.end) for r in found] == [(0, 7)]


def test_states(spark):
    docs = spark.createDataFrame([(1, "aaa x"), (2, "ab ab")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0, "A", "aa"), (2, 1, "A", "ab"), (2, 2, "A", "zz")], "doc_id long, label_id long, type string, value string")
    state = lambda rows: {r.label_id: r.state for r in Q.value_states(labels, docs, spark.createDataFrame(rows, SCHEMA)).collect()}
    assert state([(1, 0, 2, "A", 1.0), (2, 0, 2, "A", 1.0)]) == {0: "partial", 1: "partial", 2: ""}
    assert state([(1, 0, 3, "A", 1.0), (2, 0, 5, "A", 1.0)]) == {0: "covered", 1: "covered", 2: ""}
    assert state([(1, 0, 3, "B", 1.0)]) == {0: "", 1: "", 2: ""}
    split = spark.createDataFrame([(1, 0, 1, "B", 1.0), (1, 1, 3, "C", 1.0)], SCHEMA)
    assert {r.label_id: r.state for r in Q.union_states(labels, docs, split).collect()}[0] == "covered"


def test_long_texts_keep_spans_at_cuts(spark):
    text = ("word " * 17 + "ABC-123 \n") * 30
    df = spark.createDataFrame([(1, text), (2, "ABC-123")], "doc_id long, text string")
    whole = sorted(map(tuple, D.pattern_spans(df).collect()))
    assert sorted(map(tuple, D.detect_long(df, D.pattern_spans, limit=200, overlap=20).collect())) == whole
