import random

from maskwright.llm import token_counts


def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=token_counts.default_model())


def test_query_is_the_library(spark, sf):
    sp = library()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in token_counts.query(spark, sf).collect():
        n = len(sp.encode(texts[r.doc_id] or ""))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((texts[r.doc_id] or "").encode()), n, n > 4096)


def test_random_texts():
    sp, rng = library(), random.Random(2)
    own = token_counts.Lengths(token_counts.default_model(), [" the", " of"], most=500)
    alphabet = list("abcXYZ019 .,'!\n\t\r▁éß日  😀\x00\x85") + ["  ", "\n\n", " the", "<s>", "</s>", "<unk>", "<0x0A>"]
    for _ in range(20_000):
        t = "".join(rng.choices(alphabet, k=rng.randint(0, 40)))
        assert own.count(t) == len(sp.encode(t)), repr(t)


def test_odd_rows(odd_docs, no_docs):
    sp = library()
    out = token_counts.count_tokens(odd_docs)
    assert out.count() == 12 and out.columns.count("n_tokens") == 1
    for r in out.collect():
        assert r.n_tokens == len(sp.encode(r.text or "")) and r.n_bytes == len((r.text or "").encode())
    assert token_counts.count_tokens(no_docs).count() == 0


def test_summary_keeps_heavy_hitters():
    counts = {"a": 50, "b": 30} | {str(i): 1 for i in range(20)}
    assert set(token_counts.pruned(counts, 9)) >= {"a", "b"} and len(token_counts.pruned(counts, 9)) <= 9
