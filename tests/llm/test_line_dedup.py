from conftest import same
from pyspark.sql import functions as F

from maskwright.llm import line_dedup

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, min_docs=3):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    where = {}
    for d, t in docs:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 20 and d is not None:
                where.setdefault(key(x), set()).add(d)
    out = []
    for d, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if d is None or len(where.get(key(x), ())) < min_docs or d == max(where[key(x)])]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def test_query_is_its_sql(spark, sf, duck):
    same(line_dedup.query(spark, sf), duck, line_dedup.ORACLE_SQL)


def test_batches_ties_and_odd_rows(spark, odd_docs, no_docs):
    a, b, c = "A line of over twenty code points", "  a LINE of over twenty code points\t", "ÄÖÜ äöü ÄÖÜ äöü ÄÖÜ é"
    docs = [(i, "\n".join([a if i % 2 else b, f"own line {i}", c if i % 3 else c.lower(), "short"] + [a] * (i == 7))) for i in range(20)]
    docs += [(5, "\n".join([a, "x"])), (None, a), (None, a), (None, a), (100, "two documents only, this line\n"), (101, "Two documents only, this line"), (101, "Two documents only, this line"), (-9_000_000_000, a)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for batches in (1, 3, 4):
        out = line_dedup.dedup_lines(df, batches=batches)
        assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text or "") for r in out.collect()), key=str) == brute(docs)
    odd = line_dedup.dedup_lines(odd_docs)
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text or "") for r in odd.collect()), key=str) == brute([(r.doc_id, r.text) for r in odd_docs.collect()])
    assert line_dedup.dedup_lines(no_docs).count() == 0 and odd.filter(F.col("doc_id") == 1).first().text is None
