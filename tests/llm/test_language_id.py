import binascii
import math

import numpy as np

from maskwright.llm import language_id


def test_held_out_accuracy(spark, sf):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    out = language_id.query(spark, sf).collect()
    assert len(out) == len(docs)
    assert all(r.held_out == (binascii.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in out)
    tested = [r for r in out if r.held_out]
    assert np.mean([r.lang_pred == docs[r.doc_id].lang for r in tested]) > 0.9


def test_mixtures_and_odd_rows(spark, odd_docs, no_docs):
    en, fr = "the cat and the dog were in the house with the other animals " * 20, "le chat et le chien sont dans la maison avec les autres animaux " * 20
    model = language_id.train(spark.createDataFrame([(en, "en"), (fr, "fr"), (None, "de"), ("x", None)], "text string, lang string"))
    assert model[0] == ["en", "fr"]
    got = language_id.identify([en, fr, en + fr[: len(fr) // 3], "", "12 !", "the house"], *model)
    assert [g[0] for g in got] == ["en", "fr", "en", "und", "und", "en"] and got[0][2] == {"en": 1.0}
    assert set(got[2][2]) == {"en", "fr"} and 0.6 < got[2][2]["en"] < 0.9
    rows = {r.doc_id: r for r in language_id.identify_language(odd_docs, model).collect()}
    assert rows[1].lang_pred == rows[2].lang_pred == rows[3].lang_pred == "und" and rows[9].lang_pred == "en"
    assert language_id.identify_language(no_docs, model).count() == 0
    none = language_id.fit_documents(no_docs)
    assert {r.lang_pred for r in language_id.identify_language(odd_docs, none).collect()} == {"und"}


def test_texts_do_not_depend_on_their_neighbours():
    texts = ["the cat and the dog", "", "le chien   et le chat!", "a", "the"]
    model = (["en", "fr"], np.log(np.random.default_rng(0).dirichlet(np.ones(language_id.BUCKETS), 2).T + 1e-12))
    assert language_id.identify(texts, *model) == [language_id.identify([t], *model)[0] for t in texts]


def plain_identify(text, names, logs, penalty=3.0, rounds=6):
    """The mixture written out trigram by trigram."""
    low = lambda c: (c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else " "
    letters = "".join(map(low, text or ""))
    padded = " " + " ".join(letters.split(" ")).strip() + " "
    padded = " " + " ".join(padded.split()) + " "
    grams = {}
    for a, b, d in zip(padded, padded[1:], padded[2:], strict=False):
        if b != " ":
            h = (((ord(a) * 0x9E3779B1 & 0xFFFFFFFF) ^ ord(b)) * 0x85EBCA77 & 0xFFFFFFFF) ^ ord(d)
            bucket = (h * 0xC2B2AE3D & 0xFFFFFFFF) >> 16
            grams[bucket] = grams.get(bucket, 0) + 1
    if not grams or not names:
        return "und", 0.0
    n, rows = sum(grams.values()), [(w, [float(x) for x in logs[g]]) for g, w in grams.items()]
    kinds = range(len(names))

    def em(shares):
        for _ in range(rounds):
            new = [0.0] * len(names)
            for w, lp in rows:
                joint = [s * math.exp(x - max(lp)) for s, x in zip(shares, lp, strict=True)]
                for k in kinds:
                    new[k] += w * joint[k] / sum(joint)
            shares = [x / n for x in new]
        return shares, sum(w * (max(lp) + math.log(sum(s * math.exp(x - max(lp)) for s, x in zip(shares, lp, strict=True)))) for w, lp in rows)

    alone = [sum(w * lp[k] for w, lp in rows) for k in kinds]
    best = max(kinds, key=lambda k: alone[k])
    shares, likelihood = [float(k == best) for k in kinds], alone[best]
    full = em([1 / len(names)] * len(names))[0]
    for _ in range(len(names) - 1):
        other = max((k for k in kinds if not shares[k]), key=lambda k: full[k])
        trial = [full[k] if shares[k] else 0.0 for k in kinds]
        trial[other] = max(full[other], 1e-3)
        got, gained = em([x / sum(trial) for x in trial])
        if gained - likelihood <= penalty * math.log(n + 1):
            break
        shares, likelihood = got, gained
    first, second = sorted(alone, reverse=True)[:2]
    win = max(kinds, key=lambda k: shares[k])
    return names[win], min(1.0, shares[win] / (1 + math.exp(-min(50, (first - second) / math.sqrt(n)))))


def test_predictions_are_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names, logs = language_id.fit_documents(docs)
    texts = {r.doc_id: r.text for r in docs.collect()}
    picked = sorted(texts, key=lambda d: len(texts[d] or ""))[:150]
    mixed = [(-k - 1, (texts[a] or "")[:400] + " " + (texts[b] or "")[:300]) for k, (a, b) in enumerate(zip(sorted(texts)[:30], sorted(texts)[30:60], strict=True))]
    rows = [(d, texts[d]) for d in picked] + mixed + [(-100, None), (-101, "12 !"), (-102, "x"), (-102, "x"), (-103, "ab " * 40_000)]
    frame = spark.createDataFrame([(*r, "clash", 0.5) for r in rows], "doc_id long, text string, lang_pred string, score double")
    out = language_id.identify_language(frame, (names, logs)).collect()
    assert len(out) == len(rows)
    for (d, t), r in zip(sorted(rows, key=lambda x: (x[0], str(x[1]))), sorted(out, key=lambda r: (r.doc_id, str(r.text))), strict=True):
        want = plain_identify(t, names, logs.astype("float32"))
        assert r.lang_pred == want[0] and abs(r.score - want[1]) < 1e-4, (d, want, r.lang_pred, r.score)
