import hashlib
import random

from maskwright.llm import bpe


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_vocabulary())


def test_query_is_the_library(spark, sf):
    tok = library()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in bpe.query(spark, sf).collect():
        ids = tok.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_random_texts():
    tok, own, rng = library(), bpe.ForcedBoundaryBPE(bpe.default_vocabulary()), random.Random(1)
    alphabet = list("abcXYZ019 .,'!-_\n\t\r  s t re ll\x0b\x1c\x85éÄß日  　😀́/\\") + ["'s", "'re", "<|endoftext|>", "  ", "\n\n", "the", " of"]
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 60))) for _ in range(20_000)]
    got = own.encode_batch([t.encode() for t in texts])
    import numpy as np

    for t, g in zip(texts, got, strict=True):
        ids = tok.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(g, np.int32).tolist() == ids, repr(t)
        assert own.decode(g).decode() == tok.decode(ids, skip_special_tokens=False), repr(t)


def test_odd_rows(spark, odd_docs, no_docs):
    tok = library()
    out = bpe.encode_documents(odd_docs)
    assert out.columns == [*odd_docs.columns, "token_ids", "decoded_text"] and out.count() == 12
    for r in out.collect():
        assert r.token_ids == tok.encode(r.text or "", add_special_tokens=False).ids and r.decoded_text == (r.text or "")
    assert bpe.encode_documents(no_docs).count() == 0
    again = bpe.encode_documents(out)
    assert again.columns == out.columns


def test_fragments_go_to_the_library_in_slices():
    own, rng, given = bpe.ForcedBoundaryBPE(bpe.default_vocabulary()), random.Random(2), []
    tok = own.library

    class Spy:
        def encode_batch(self, texts, **options):
            given.append(len(texts))
            return tok.encode_batch(texts, **options)

    own.library = Spy()
    texts = [" ".join("".join(rng.choices("abcdefghij", k=8)) for _ in range(2000)) for _ in range(5)]
    got = own.encode_batch([t.encode() for t in texts])
    assert sum(given) > 5000 and max(given) <= 2048
    import numpy as np

    for t, g in zip(texts, got, strict=True):
        assert np.frombuffer(g, np.int32).tolist() == tok.encode(t, add_special_tokens=False).ids
