import duckdb
import pytest

#: Awkward rows: nulls, empty, ties, repeats, a very long text and columns named like the operators' results.
DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_words int, n_tokens string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    long = "Word " * 30_000 + "end\nof the very long text.\n" * 200
    rows = [
        (1, None, None, None, None), (2, "", "en", "a", 0), (3, " ", "en", "a", 1), (None, "no id here", "en", "a", 10), (5, "\n\n \t x", "en", "a", 6),
        (6, "Zażółć gęślą ÅÄÖ ’s 'S 日本語 😀😀 é x y　", "pl", "b", 40), (6, "Zażółć gęślą ÅÄÖ ’s 'S 日本語 😀😀 é x y　", "pl", "b", 40),
        (8, "a <|endoftext|> b<|endoftext|>", "en", "b", 20), (9, long, "en", "b", len(long)), (10, "▁▁ a▁b \n c  d   \n\n\n e ", "en", "c", 20), (11, "\x00\x01\x7f\x85 x's it''s !'s 12's\r\n\r\n\tz", "en", "c", 20),
        (12, "1,234.56 -- ((x)) {y} ///", None, None, None),
    ]
    return spark.createDataFrame([(*r, 1, "clash") for r in rows], DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def duck(sf):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def same(df, con, sql):
    columns = sorted(df.columns)
    left = sorted(map(str, ([r[c] for c in columns] for r in df.collect())))
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    right = sorted(str([r[names.index(c)] for c in columns]) for r in found.fetchall())
    assert left == right
