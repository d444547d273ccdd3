import random
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))

import test_decontaminate
import test_line_dedup
import test_ngram_join
from pyspark.sql import functions as F

import corpus_pipeline
from maskwright.llm import bpe, language_id


def brute(docs, items, model):
    """The stages one by one in plain Python; the language model is the operator's own, as it is learned."""
    kept = [(d, t) for (d, t), f in zip(docs, language_id.identify([t or "" for _, t in docs], *model), strict=True) if f[0] != "und" and f[1] >= corpus_pipeline.LEAST_SCORE]
    kept = [(d, t) for d, _, dropped, t in test_line_dedup.brute(kept) if not (dropped and not t.strip(" "))]
    least = {d: c for d, _, c in test_ngram_join.brute(kept)}
    kept = [(d, t) for d, t in kept if least[d] == d]
    hit = [x for x, (_, _, n_hit, _) in zip(kept, test_decontaminate.brute(kept, items), strict=True) if n_hit]
    gone = {d for d, _ in hit}
    left = test_decontaminate.brute_leaks(hit, items)
    assert not any(x[2] for x in test_decontaminate.brute([x[:2] for x in left], items))
    return {d: t for d, t in kept if d not in gone} | {d: t for d, t, n in left if not n or test_decontaminate.WORD.search(t.lower())}


def test_run_is_brute_force(spark, sf):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(bpe.default_vocabulary())
    source = spark.read.parquet(f"{sf}/documents.parquet")
    docs = sorted(tuple(r) for r in source.select("doc_id", "text").collect())
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    names, logs = language_id.fit_documents(source)
    want = brute(docs, items, (names, logs.astype("float32")))
    out = corpus_pipeline.run(spark, sf)
    assert out.columns == [*corpus_pipeline.COLUMNS, "token_ids", "n_tokens", "round_trip"]
    got = out.collect()
    assert {r.doc_id: r.text for r in got} == want and len(got) == len(want) < len(docs)
    assert all(r.token_ids == tok.encode(r.text, add_special_tokens=False).ids and r.n_chars == len(r.text) and r.round_trip for r in got)


def test_odd_rows_pass_every_stage(spark, odd_docs, sf):
    docs = odd_docs.select(*corpus_pipeline.COLUMNS)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf).select(*corpus_pipeline.COLUMNS)
    assert {r.doc_id for r in docs.collect()} <= {r.doc_id for r in odd_docs.collect()}
    empty = odd_docs.limit(0).select(*corpus_pipeline.COLUMNS)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf).count() == 0


def test_texts_of_no_learned_language_go(spark, sf):
    draw, docs = random.Random(5), spark.read.parquet(f"{sf}/documents.parquet").select(*corpus_pipeline.COLUMNS)
    alphabets = ["abcdefghijklmnopqrstuvwxyz", "абвгдежзийклмнопрстуфхцчшщъыьэюя", "".join(map(chr, range(0x4E00, 0x9000)))]
    planted = [(-1 - k, " ".join("".join(draw.choices(alphabets[k % 3], k=draw.randint(3, 9))) for _ in range(draw.choice([20, 100, 1000]))), None, "p", None) for k in range(60)]
    planted += [(-100, "Съешь же ещё этих мягких французских булок да выпей чаю", None, "p", None)]
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    held = ids(docs.filter(F.col("text").rlike(r"\p{L}")))
    kept = ids(corpus_pipeline.reject_unknown_language(spark, docs.unionByName(spark.createDataFrame(planted, docs.schema)), sf))
    assert not {d for d in kept if d < 0} and kept == held


def test_copies_left_with_blank_lines_go(spark, sf):
    text = "A line that is copied.\n\n\t\n---\nAnother line that is copied."
    rows = [(k, text, "en", "p", len(text)) for k in range(5)]
    kept = corpus_pipeline.drop_repeated_lines(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), sf).collect()
    assert [r.doc_id for r in kept] == [4] and kept[0].text == text
