import hashlib
import re

from maskwright.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, items, n=8):
    words = lambda t: WORD.findall((t or "").translate(LOWER))
    windows = {}
    for i, t in items:
        w = words(t)
        if w and i is not None:
            size = min(n, len(w))
            for k in range(len(w) - size + 1):
                windows.setdefault(tuple(w[k : k + size]), set()).add(i)
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                if tuple(w[k : k + size]) in windows:
                    hit.update(range(k, k + size))
                    found |= windows[tuple(w[k : k + size])]
        out.append((d, len(w), len(hit), sorted(found)))
    return out


def brute_leaks(docs, items, n=8):
    """What ``remove="leaks"`` keeps: (doc_id, text, spans cut out)."""
    kept = []
    for d, t in docs:
        if len(brute([(d, t)], items, n)[0][3]) >= 2:
            continue
        places = list(WORD.finditer((t or "").translate(LOWER)))
        hit = [False] * len(places)
        for i, item in items:
            w = WORD.findall((item or "").translate(LOWER)) if i is not None else []
            size = min(n, len(w))
            own = [m.group() for m in places]
            wanted = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if w else ()
            for k in range(len(own) - size + 1) if w else ():
                if tuple(own[k : k + size]) in wanted:
                    hit[k : k + size] = [True] * size
        cuts, k = [], 0
        while k < len(hit):
            z = k
            while z < len(hit) and hit[z]:
                z += 1
            if z - k >= n:
                cuts.append((places[k].start(), places[z - 1].end()))
            k = max(z, k + 1)
        out = t
        for a, z in reversed(cuts):
            out = out[:a] + out[z:]
        kept.append((d, out, len(cuts)))
    return kept


def key(rows):
    return sorted(rows, key=str)


def test_query_is_brute_force(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    want = {d: (n, h, len(i), hashlib.sha256(",".join(sorted(map(str, i))).encode()).hexdigest(), len(i) >= 2) for d, n, h, i in brute(docs, items)}
    got = {r.doc_id: tuple(r)[1:] for r in decontaminate.query(spark, sf).collect()}
    assert got == want and any(x[1] for x in want.values())


def test_short_items_blocks_and_spans(spark, odd_docs, no_docs):
    items = [(1, "no id"), (1, "no id"), (2, None), (3, "!!!"), (None, "x"), (4, "of the very LONG text end of the"), (10, "text"), (5, "ÅÄÖ"), (6, "word " * 9)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = [(r.doc_id, r.text) for r in odd_docs.collect()]
    want = key(brute(docs, items))
    for most in (1000, 2):
        out = decontaminate.find_contamination(odd_docs, bench, max_windows=most)
        rows = out.collect()
        assert key((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in rows) == want
        for r in rows:
            assert sum(len(WORD.findall((r.text or "")[s.start : s.end].translate(LOWER))) for s in r.hit_spans) == r.n_hit
    assert decontaminate.find_contamination(no_docs, bench).count() == 0
    assert decontaminate.find_contamination(odd_docs, bench.limit(0)).filter("n_hit > 0").count() == 0
    kept = decontaminate.decontaminate(odd_docs, bench)
    assert kept.columns == odd_docs.columns and {r.doc_id for r in kept.collect()} == {d for d, _, _, i in want if len(i) < 2}
    cut = {r.doc_id: r.text for r in decontaminate.decontaminate(odd_docs, bench, remove="spans").collect()}
    assert len(cut[9]) < 60_000 and cut[2] == ""


def test_leaks_are_cut_and_clean_documents_stay(spark, odd_docs, no_docs):
    item, other = "one two three four five six seven eight nine ten", "ÅÄÖ b c d e f g h i j k"
    rows = [
        (1, f"Before 😀, {item.upper()}! After it."), (2, item), (3, f"{item} {other}"), (4, "clean text of no item"), (5, "say no id twice: no id"), (6, f"x {item} y {item}"),
        (7, "one two three four five six seven"), (8, None), (9, ""), (10, f"w {item[:39]} z"), (4, "clean text of no item"),
    ]
    items = [(1, item), (2, other), (3, "no id"), (4, None), (None, "clean text of no item at all, never mind"), (1, item)]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = brute_leaks(rows, items)
    for most in (1000, 2):
        got = decontaminate.decontaminate(docs, bench, remove="leaks", max_windows=most)
        assert key(tuple(r) for r in got.collect()) == key(want)
    cut = {d: t for d, t, _ in want}
    assert 3 not in cut and cut[1] == "Before 😀, ! After it." and cut[2] == "" and cut[5] == rows[4][1] and cut[6] == "x  y "
    odd = decontaminate.decontaminate(odd_docs.withColumnRenamed("n_words", "N_CUT"), bench, remove="leaks")
    assert odd.columns[-1] == "n_cut" and odd.count() == odd_docs.count()
    assert decontaminate.decontaminate(no_docs, bench, remove="leaks").count() == 0
