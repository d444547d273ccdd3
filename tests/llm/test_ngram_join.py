import random
import re

import numpy as np
import pyarrow as pa

from maskwright.llm import ngram_join

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, threshold=0.8, n=5):
    def sets(t):
        w = WORD.findall((t or "").translate(LOWER))
        k = min(n, len(w))
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()

    own = [sets(t) if d is not None else set() for d, t in docs]
    where = {}
    for i, s in enumerate(own):
        for x in s:
            where.setdefault(x, []).append(i)
    links = []
    for i, s in enumerate(own):
        common = {}
        for x in s:
            for j in where[x]:
                common[j] = common.get(j, 0) + 1
        links.append([j for j, c in common.items() if j != i and c / (len(s) + len(own[j]) - c) >= threshold])
    out = []
    for i in range(len(docs)):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        out.append((docs[i][0], len(links[i]), min(docs[j][0] for j in seen) if docs[i][0] is not None else None))
    return sorted(out, key=str)


def rows(df):
    return sorted(((r.doc_id, r.n_links, r.component_id) for r in df.collect()), key=str)


def test_query_is_brute_force(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want = brute(docs)
    assert rows(ngram_join.query(spark, sf)) == want and any(x[1] for x in want)


def test_groups_blocks_and_odd_rows(spark, odd_docs, no_docs):
    rng = random.Random(5)
    word = lambda: rng.choice("abcdefghij") + str(rng.randint(0, 400))
    docs = []
    for g in range(25):
        base = [word() for _ in range(rng.choice([3, 6, 40, 150, 300]))]
        for _ in range(rng.choice([1, 2, 3, 60])):
            own = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 40))):
                own[rng.randrange(len(own))] = word()
            docs.append((len(docs), " ".join(own)))
            if rng.random() < 0.1:
                docs += [(len(docs), docs[-1][1]), (len(docs) + 1, docs[-1][1].upper())]
    passage = " ".join(word() for _ in range(60))
    docs += [(len(docs) + i, passage + " " + " ".join(word() for _ in range(150))) for i in range(60)]
    rng.shuffle(docs)
    docs += [(None, docs[0][1]), (90_001, None), (90_002, ""), (90_003, "!!"), (90_004, "?")]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, n_links int")
    want = brute(docs)
    for options in ({"block": 7, "block_shingles": 900}, {}):
        assert rows(ngram_join.near_duplicates(df, **options)) == want
    odd = rows(ngram_join.near_duplicates(odd_docs))
    assert len(odd) == 12 and (6, 1, 6) in odd
    assert ngram_join.near_duplicates(no_docs).count() == 0
    kept = ngram_join.drop_near_duplicates(odd_docs)
    assert kept.columns == odd_docs.columns and sorted((r.doc_id or -1) for r in kept.collect()) == [-1, 1, 2, 3, 5, 6, 8, 9, 10, 11, 12]


def test_rows_that_share_an_id_are_documents_of_their_own(spark):
    rng = random.Random(8)
    words = lambda k: [f"w{rng.randint(0, 10**6)}" for _ in range(k)]
    near = lambda w: " ".join([*w[:-1], "other"])
    a, b = words(80), words(80)
    docs = [(7, " ".join(a)), (20, " ".join(a)), (21, " ".join(a)), (7, " ".join(b)), (8, near(a)), (9, near(b)), (7, " ".join(b)), (-5, near(b))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    out = rows(ngram_join.near_duplicates(df))
    assert out == brute(docs) and (8, 3, 7) in out and (9, 3, -5) in out
    kept = [tuple(r) for r in ngram_join.drop_near_duplicates(df).collect()]
    assert sorted(kept) == sorted([(7, " ".join(a)), (-5, near(b))])


def test_recall_at_the_threshold(spark):
    """Many pairs exactly at the threshold: the recall that the README states."""
    rng = random.Random(11)
    docs = []
    for g in range(1500):
        base = [f"v{rng.randint(0, 10**7)}" for _ in range(94)]
        changed = list(base)
        for k in rng.sample(range(5, 89, 6), 2):  # each changed word changes five of 90 shingles: 80 of 100 are common
            changed[k] = f"u{g}x{k}"
        docs += [(2 * g, " ".join(base)), (2 * g + 1, " ".join(changed))]
    got = rows(ngram_join.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")))
    want = brute(docs)
    links = sum(x[1] for x in want)
    assert links == 3000 and sum(x[1] for x in got) >= 0.999 * links


def test_components_of_hubs_and_chains(spark):
    from maskwright.llm.components import connected_components

    edges = [(1, k) for k in range(2, 3000)] + [(k, k + 1) for k in range(5000, 5030)] + [(5030, 2999), (9000, 9000), (9001, 9002), (9002, 9001)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {k: 1 for k in [*range(2, 3000), *range(5000, 5031)]} | {9002: 9001}


def test_parts():
    assert ngram_join.depth_for(0.8, 24, 6, 0.9999) == 5 and ngram_join.depth_for(0.8, 2, 6, 0.9999) == 1
    sets = [np.unique(np.random.default_rng(i).integers(0, 60, 30).astype(np.uint64)) for i in range(12)]
    got = ngram_join.intersections(sets, np.arange(9), np.arange(4, 12))
    assert got.tolist() == [[len(set(sets[i]) & set(sets[j])) for j in range(4, 12)] for i in range(9)]
    table = pa.table({"a": [1, 1, 2, 2, 2, 3, 4, 4], "b": [0, 0, 0, 0, 1, 1, 1, 1]})
    for size in (1, 2, 3, 8):
        found = [g.num_rows for g in ngram_join.groups(iter(table.to_batches(max_chunksize=size)), ["a", "b"])]
        assert found == [2, 2, 1, 1, 2]


def groups_of_copies(spark, many=700, others=1500):
    rng = random.Random(9)
    base = [f"w{rng.randint(0, 999)}" for _ in range(120)]
    near = [(i, " ".join([*base[: 40 + i % 7], f"x{i}", *base[41 + i % 7 :]])) for i in range(many)]
    alone = [(1000 + i, " ".join(f"u{rng.randint(0, 10**9)}" for _ in range(30))) for i in range(others)]
    return spark.createDataFrame([*near, *alone, (None, "w1 w2"), (5000, None)], "doc_id long, text string")


def test_classes_meet_signature_and_text_once(spark, monkeypatch):
    made, passed, real, filtered = {}, [], ngram_join.written, ngram_join.perhaps_in

    def keep(df, name):
        made[name] = out = real(df, name)
        return out

    def count(df, keys, columns, name):
        out = filtered(df, keys, columns, name)
        passed.append((out.filter(name).count(), keys.count(), out.count()))
        return out

    docs = groups_of_copies(spark)
    monkeypatch.setattr(ngram_join, "written", keep)
    monkeypatch.setattr(ngram_join, "perhaps_in", count)
    ngram_join.linked_rows(docs, block=64).count()
    # a node of eleven blocks and 24 trees, but one row a class
    assert made["members"].count() == made["members"].select("cid").distinct().count() == made["signatures"].count() == 700
    # only the rows of candidates, and few others, go into the join with their texts
    assert passed[0][1] == 700 <= passed[0][0] <= 710 and passed[0][2] == docs.count()


def test_rows_that_match_pass_the_filter(spark):
    from maskwright.llm.common import perhaps_in

    df = spark.createDataFrame([(i, f"t{i}") for i in range(50_000)] + [(None, "t"), (1, None)], "a long, b string")
    keys = df.filter("a % 10 = 3 OR a IS NULL OR b IS NULL")
    out = perhaps_in(df, keys, ["a", "b"], "met")
    assert out.columns == ["a", "b", "met"] and out.count() == 50_002
    assert out.filter("NOT met").join(keys, (out.a.eqNullSafe(keys.a)) & (out.b.eqNullSafe(keys.b)), "left_semi").count() == 0
    assert 5002 <= out.filter("met").count() <= 5100
    assert perhaps_in(df, keys.limit(0), ["a", "b"], "met").filter("met").count() == 0
    assert spark.createDataFrame([], df.schema).transform(perhaps_in, keys, ["a", "b"], "met").count() == 0


def test_only_groups_are_joined_when_copies_go(spark, monkeypatch):
    passed, filtered = [], ngram_join.perhaps_in

    def count(df, keys, columns, name):
        out = filtered(df, keys, columns, name)
        if name == "_perhaps":
            passed.append(out.filter(name).count())
        return out

    docs = groups_of_copies(spark, 50, 100)
    monkeypatch.setattr(ngram_join, "perhaps_in", count)
    kept = ngram_join.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    left = [r.doc_id for r in kept.collect()]
    assert sorted(left, key=str) == sorted([0, None, 5000, *range(1000, 1100)], key=str)
    assert 50 <= passed[0] <= 55
