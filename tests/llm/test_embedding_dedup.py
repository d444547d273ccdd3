import numpy as np
from pyspark.sql import functions as F

from maskwright.llm import embedding_dedup


def brute(rows, threshold=0.93):
    good = lambda v, l: l is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)
    n = len(rows)
    unit = [np.array(v, float) / np.linalg.norm(v) if i is not None and good(v, l) else None for i, v, l in rows]
    links = [[j for j in range(n) if j != i and unit[i] is not None and unit[j] is not None and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold] for i in range(n)]
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        out.append((rows[i][0], len(links[i]), min((rows[j][0] for j in seen), default=None) if rows[i][0] is not None else None))
    return sorted(out, key=str)


def test_query_is_brute_force(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    out = embedding_dedup.query(spark, sf).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in out), key=str) == brute(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in out)


def test_cells_blocks_and_odd_rows(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(60, 6))
    vectors = [(base[i % 60] + rng.normal(scale=0.15, size=6)).astype(np.float32).tolist() for i in range(500)]
    rows = [(i, v, i % 2) for i, v in enumerate(vectors)] + [(1000 + i, vectors[0], 0) for i in range(30)]
    rows += [(2000, None, 0), (2001, [], 0), (2002, [0.0] * 6, 0), (2003, [float("nan")] * 6, 0), (2004, [1.0, None, 0.0, 0.0, 0.0, 0.0], 0), (2005, vectors[0], None), (2006, vectors[0][:5], 0), (None, vectors[0], 0), (1000, vectors[0], 0), (3, vectors[8], 0), (3, vectors[9], 1), (3, [9.0, 1.0, 0.0, 0.0, 0.0, 0.0], 0), (2, [9.0, 1.0, 0.0, 0.0, 0.0, 0.0], 0), (2007, [x * 1e30 for x in vectors[0]], 0)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, label int, n_links int").withColumn("Kept", F.lit("clash")).withColumn("extra", F.col("vec_id") + 1)
    for options in ({"cell_size": 40, "sample_size": 200, "block": 16, "centre_bytes": 400}, {"cell_size": 40, "sample_size": 200, "block": 16}, {}):
        out = embedding_dedup.link_vectors(df, **options).collect()
        assert out[0].__fields__ == ["vec_id", "embedding", "label", "extra", "n_links", "component_id", "kept"] and all(r.extra == (None if r.vec_id is None else r.vec_id + 1) for r in out)
        assert sorted(((r.vec_id, r.n_links, r.component_id) for r in out), key=str) == brute(rows)
    assert embedding_dedup.link_vectors(df.limit(0)).count() == 0
