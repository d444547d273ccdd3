import binascii
import math
import re
from collections import Counter

import numpy as np

from maskwright.llm import class_lm

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))


def test_base_counts_and_held_out_gain(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    out_of = lambda d: binascii.crc32(str(d).encode()) % 7 == 2
    counts = Counter(w for d, t in docs.items() if not out_of(d) for w in [*words(t), None])
    n, v = sum(counts.values()), len(counts)
    out = class_lm.query(spark, sf).collect()
    assert len(out) == len(docs)
    for r in out:
        own = [*words(docs[r.doc_id]), None]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out_of(r.doc_id), len(own), sum(counts[w] > 0 for w in own), n)
        assert math.isclose(r.base_score, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own), rel_tol=1e-9)
        assert r.score < 0
    held = [r for r in out if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_probabilities_sum_to_one_and_tiers_agree(spark):
    texts = ["a b c a b.", "b c d", "a A\x85a é b", "", None]
    train = spark.createDataFrame([(t,) for t in texts], "text string")
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate([*texts, "zz a q", "a b c a b.", "a b c a b."])], "doc_id long, text string, score int")
    results = []
    for options in ({}, {"frequent": 2, "suffixes": 3, "classes": 2}, {"frequent": 2, "suffixes": 3, "classes": 2, "broadcast_words": 3}):
        model = class_lm.train(train, **options)
        assert np.allclose((10**model.transition).sum(1), 1)
        units, mass = class_lm.Units(model.frequent, model.suffixes), np.zeros(len(model.emission))
        for r in model.counts.collect():
            mass[model.class_of[units.of([bytes(r.word)])[0]]] += r.n + 1
        assert np.allclose((mass + 1) / 10**model.emission, 1)
        out = class_lm.score_documents(docs, model)
        assert out.columns == ["doc_id", "n_tokens", "n_known", "base_score", "score"]
        results.append({r.doc_id: (r.n_tokens, r.n_known, round(r.base_score, 9), round(r.score, 9)) for r in out.collect()})
        assert results[-1][6] == results[-1][7] == results[-1][0] and results[-1][4][0] == 1 and results[-1][5][1] == 2
    assert results[1] == results[2]


def test_nothing_to_learn_from(odd_docs, no_docs):
    model = class_lm.train(no_docs)
    assert model.n_tokens == 0
    out = class_lm.score_documents(odd_docs, model).collect()
    assert len(out) == 12 and all(r.n_known == 0 and np.isfinite(r.score) for r in out)
    assert class_lm.score_documents(no_docs, model).count() == 0


def test_exchange_finds_planted_classes():
    rng, n = np.random.default_rng(0), 30
    kinds = np.arange(n) % 3
    big = np.where((kinds[:, None] + 1) % 3 == kinds[None, :], rng.integers(50, 90, (n, n)), 1)
    bigrams = np.zeros((n + 1, n + 1), np.int64)
    bigrams[:n, :n] = big
    own = class_lm.exchange(bigrams, 3)
    assert own[n] == 3 and len({(int(a), int(b)) for a, b in zip(kinds, own[:n], strict=True)}) == 3


def test_words_beyond_the_first_units_are_clustered(spark):
    rng, n = np.random.default_rng(1), 40
    # words of three kinds that follow one another in turn; endings say nothing of the kind
    word = lambda kind: f"{'abc'[kind]}{rng.integers(n)}end"
    texts = spark.createDataFrame([(" ".join(word(k % 3) for k in range(60)),) for _ in range(400)], "text string")
    options = {"frequent": 12, "suffixes": 4, "classes": 3}
    model, few = class_lm.train(texts, **options), class_lm.train(texts, **options, least=10**9)
    assert len(model.frequent) == 3 * n and len(few.frequent) == 12
    kinds = [(w[:1], int(c)) for w, c in zip(model.frequent, model.class_of, strict=False)]
    assert len(set(kinds)) == len(dict(kinds)) == 3
    assert np.allclose((10**model.transition).sum(1), 1)
    total = lambda m: sum(r.score for r in class_lm.score_documents(texts, m).collect())
    assert total(model) > total(few)


def test_scores_are_brute_force(spark, sf):
    """Given the classes of the words, every probability is made again from the texts in plain Python."""
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()] + [(-1, None), (-2, "Q" * 50_000 + " new words here"), (-3, "")]
    learn = [t for d, t in docs if d % 3]
    model = class_lm.train(spark.createDataFrame([(t,) for t in learn], "text string"), frequent=60, suffixes=16, classes=8, least=20, broadcast_words=900)
    units, end, classes = class_lm.Units(model.frequent, model.suffixes), 8, 9
    kind = lambda w: int(model.class_of[units.of([w.encode()])[0]])
    counts, tokens, distinct, pairs = Counter(w for t in learn for w in words(t)), Counter(), Counter(), Counter()
    for w, n in counts.items():
        tokens[kind(w)] += n
        distinct[kind(w)] += 1
    for t in learn:
        path = [end, *map(kind, words(t)), end]
        pairs.update(zip(path, path[1:], strict=False))
    total, into, out = sum(pairs.values()), Counter(), Counter()
    for (a, b), n in pairs.items():
        into[b] += n
        out[a] += n
    follows = lambda a, b: (pairs[a, b] + 5.0 * (into[b] + 1) / (total + classes)) / (out[a] + 5.0)
    got = {r.doc_id: r.score for r in class_lm.score_documents(spark.createDataFrame(docs, "doc_id long, text string"), model).collect()}
    for d, t in docs:
        path = [end, *map(kind, words(t)), end]
        want = sum(math.log10(follows(a, b)) for a, b in zip(path, path[1:], strict=False))
        want += sum(math.log10((counts[w] + 1) / (tokens[kind(w)] + distinct[kind(w)] + 1)) for w in words(t))
        assert math.isclose(got[d], want, rel_tol=1e-9, abs_tol=1e-9), d
