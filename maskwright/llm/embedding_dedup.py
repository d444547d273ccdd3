"""Embedding near-dedup: spherical k-means cells, blocked cosine products, one representative a group.

Equal vectors of one label are one class with a count, named by a 128-bit hash.
Centroids are fitted for all labels in one grouped pass, each on a bounded
sample of ``sample_size`` classes of its label, so that a cell holds about
``cell_size`` of them (or, beyond sample_size / 4 cells, more); every class is
assigned. Centroids are broadcast in parts of at most ``centre_bytes``; labels
pass one part after another where there are more.

Two unit vectors of cosine t or more lie within sqrt(2 - 2t) of each other, so
a vector must meet a foreign cell only if it lies within that distance of the
plane between its own centroid and the other: it visits those cells, and no
pair is lost. Members of a cell are dealt into blocks of about ``block`` rows
and a task compares two blocks, so that no group meets in one task; a task
returns a count and a link to a root for each vector, never the pairs. Classes
that hold more than 1/HOT of all rows are fewer than HOT and are broadcast to
their copies, so copies of one vector never meet in one task.

Defined results: a vector that is null, empty, zero or holds a null or
non-finite component links with nothing and is kept; so is one without a label.
Vectors of unlike lengths never link; long ones are compared whole. A row whose
vec_id is null links with nothing, has a null component and is not kept. Rows
that repeat a vec_id, with one vector or several, are vectors of their own;
ties go to the least vec_id. An empty table gives an empty result. Input columns
named n_links, component_id or kept are replaced, all others stay.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import number_of, ordered_key, settled, table, without, written
from .components import connected_components, joined

HOT = 1000
MADE = ["n_links", "component_id", "kept"]
GOOD = "label IS NOT NULL AND vec_id IS NOT NULL AND embedding IS NOT NULL AND size(embedding) > 0 AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity')) AND exists(embedding, x -> x <> 0)"


def unit(rows) -> np.ndarray:
    x = np.array([np.asarray(r, np.float64) for r in rows])
    x /= np.abs(x).max(1, keepdims=True)  # no under- or overflow in the norm
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Unit centroids of unit vectors; fewer than ``k`` where cells stay empty."""
    centres = x[np.random.default_rng(seed).choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        own = (x @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        norm = np.linalg.norm(sums, axis=1)
        centres = sums[norm > 1e-9] / norm[norm > 1e-9, None]
    return centres


def fit_cells(classes: DataFrame, cell_size: int, sample_size: int) -> DataFrame:
    """(label, dim, centres): the unit centroids, one after another, of each label and dimension of more than two cells' classes."""
    sizes = classes.groupBy("label", "dim").agg(F.count("*").alias("n")).filter(F.col("n") > 2 * cell_size)
    # a bounded sample: each class is taken with the probability that gives sample_size / 2 of its label on average
    picked = classes.join(sizes, ["label", "dim"]).filter(F.pmod(F.col("k1"), F.col("n")) < sample_size // 2)

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("k1").head(sample_size)
        n = int(frame["n"].iloc[0])
        centres = spherical_kmeans(unit(frame["embedding"]), min(math.ceil(n / cell_size), max(1, len(frame) // 4)))
        return pd.DataFrame({"label": frame["label"].iloc[:1], "dim": frame["dim"].iloc[:1], "centres": [centres.ravel()]})

    return picked.select("label", "dim", "k1", "n", "embedding").groupBy("label", "dim").applyInPandas(fit, "label long, dim int, centres array<double>")


def keyed(vectors: DataFrame) -> DataFrame:
    """``vectors`` with a 128-bit hash (k1, k2) of label and vector, null where the row links with nothing."""
    good = F.coalesce(F.expr(GOOD), F.lit(False))
    plain = F.col("embedding").cast("array<double>")
    return vectors.withColumn("k1", F.when(good, F.xxhash64("label", plain))).withColumn("k2", F.when(good, F.xxhash64(F.lit(2), plain, "label")))


def classes_of(rows: DataFrame) -> DataFrame:
    """(k1, k2, label, dim, embedding, m, cid): the distinct valid vectors of each label."""
    own = rows.filter("k1 IS NOT NULL").select("k1", "k2", F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("vec_id").cast("long").alias("vec_id"))
    found = own.groupBy("k1", "k2").agg(F.any_value("label").alias("label"), F.any_value("embedding").alias("embedding"), F.min("vec_id").alias("rep"), F.count("*").alias("m"))
    return found.withColumn("dim", F.size("embedding")).withColumn("cid", ordered_key(F.col("rep"), F.col("k1"))).drop("rep")


def parts_of(sizes: list[tuple[int, int, int]], most: int) -> list[list[tuple[int, int]]]:
    """(label, dim, bytes) dealt into parts of at most ``most`` bytes, or a single one."""
    parts: list[list[tuple[int, int]]] = []
    held = most + 1
    for label, dim, size in sizes:
        if held + size > most:
            parts.append([])
            held = 0
        parts[-1].append((label, dim))
        held += size
    return parts


def place(classes: DataFrame, centres: DataFrame, reach: float, centre_bytes: int) -> DataFrame:
    """``classes`` with their cell and the cells they visit."""
    spark = classes.sparkSession
    sizes = [(r.label, r.dim, r.bytes) for r in centres.select("label", "dim", (F.size("centres") * 8).alias("bytes")).orderBy("label", "dim").toLocalIterator()]
    for part in parts_of(sizes, centre_bytes):
        wanted = spark.createDataFrame(part, "label long, dim int")
        cells = spark.sparkContext.broadcast({(r.label, r.dim): np.array(r.centres).reshape(-1, r.dim) for r in centres.join(F.broadcast(wanted), ["label", "dim"]).collect()})

        def assign(batches: Iterator[pa.RecordBatch], cells=cells) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                frame = batch.to_pandas()
                home = frame["cell"].to_numpy(np.int32).copy()
                visits = [list(v) for v in frame["visits"]]
                for key, rows in frame.groupby(["label", "dim"]).indices.items():
                    centres = cells.value.get((int(key[0]), int(key[1])))
                    if centres is None or len(centres) < 2:
                        continue
                    step = max(1, (1 << 20) // len(centres))
                    for a in range(0, len(rows), step):
                        at = rows[a : a + step]
                        near = unit(frame["embedding"].iloc[at]) @ centres.T
                        mine = near.argmax(1)
                        home[at] = mine
                        apart = np.sqrt(np.maximum(0, 2 - 2 * (centres[mine] @ centres.T)))
                        meets = near[np.arange(len(at)), mine][:, None] - near <= reach * apart + 1e-9
                        for i, row, h in zip(at, meets, mine, strict=True):
                            visits[i] = [int(c) for c in np.flatnonzero(row[:h])]  # of two cells the vector of the later one visits
                columns = [c for c, n in zip(batch.columns, batch.schema.names, strict=True) if n not in ("cell", "visits")]
                names = [n for n in batch.schema.names if n not in ("cell", "visits")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(home, pa.int32()), pa.array(visits, pa.list_(pa.int32()))], [*names, "cell", "visits"])

        classes = classes.mapInArrow(assign, classes.schema)
    return classes


def link_vectors(vectors: DataFrame, threshold: float = 0.93, cell_size: int = 4096, sample_size: int = 20_000, block: int = 2048, centre_bytes: int = 64 << 20) -> DataFrame:
    """``vectors`` (with vec_id, embedding, label) with n_links, component_id and kept."""
    rows = keyed(without(vectors, *MADE, "k1", "k2"))
    classes = written(classes_of(rows), "vectors")
    reach = math.sqrt(2 - 2 * threshold) + 1e-9
    centres = written(fit_cells(classes, cell_size, sample_size), "centres")
    start = classes.select("label", "dim", "cid", "m", "embedding", F.lit(0).alias("cell"), F.array().cast("array<int>").alias("visits"))
    placed = written(place(start, centres, reach, centre_bytes), "placed")
    blocks = placed.groupBy("label", "dim", "cell").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    members = placed.join(blocks, ["label", "dim", "cell"]).withColumn("blk", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    # each vector goes to its own cell and to those it visits, and there to every block; in its own cell to those up to its own
    gone = members.select("label", "dim", "cid", "m", "embedding", F.col("cell").alias("u_cell"), F.col("blk").alias("u_blk"), F.explode(F.concat(F.array("cell"), "visits")).alias("cell"))
    gone = gone.join(blocks, ["label", "dim", "cell"]).withColumn("blk", F.explode(F.sequence(F.lit(0), F.when(F.col("cell") == F.col("u_cell"), F.col("u_blk")).otherwise(F.col("blocks") - 1))))
    key = ["label", "dim", "cell", "blk", "u_cell", "u_blk"]
    gone = gone.select(*key, "cid", "m", "embedding", F.lit(0).alias("side"))
    tasks = gone.select(*key).distinct().filter((F.col("cell") != F.col("u_cell")) | (F.col("blk") != F.col("u_blk")))
    there = members.select("label", "dim", "cell", "blk", "cid", "m", "embedding").join(tasks, ["label", "dim", "cell", "blk"]).select(*key, "cid", "m", "embedding", F.lit(1).alias("side"))

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["cid", "side"])
        cids, m = frame["cid"].to_numpy(), frame["m"].to_numpy(np.int64)
        x = unit(frame["embedding"])
        left = np.flatnonzero(frame["side"].to_numpy() == 0)
        right = np.flatnonzero(frame["side"].to_numpy() == 1)
        alone = not len(right)
        if alone:
            right = left
        links, labels = np.zeros(len(frame), np.int64), np.arange(len(frame))
        for a in range(0, len(left), 512):
            rows = left[a : a + 512]
            near = x[rows] @ x[right].T >= threshold
            if alone:
                near[np.arange(len(rows)), np.arange(a, a + len(rows))] = False
            links[rows] += near @ m[right]
            if not alone:
                links[right] += near.T @ m[rows]
            joined(labels, near, rows, right)
        some = np.flatnonzero(links)
        return pd.DataFrame({"cid": cids[some], "links": links[some], "root": cids[labels[some]]})

    found = written(gone.union(there).groupBy(*key).applyInPandas(compare, "cid binary, links long, root binary"), "vector-links")
    labels = connected_components(found.select(F.col("cid").alias("u"), F.col("root").alias("v")))
    counts = found.groupBy("cid").agg(F.sum("links").alias("links"))
    met = classes.select("k1", "k2", "m", "cid").join(counts, "cid", "left").join(labels.withColumnRenamed("node", "cid"), "cid", "left")
    result = met.select("k1", "k2", "m", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"), number_of(F.coalesce("component", "cid")).alias("component_id")).filter("n_links > 0")
    total = classes.agg(F.sum("m")).first()[0] or 0
    hot = result.filter(F.col("m") > F.lit(total / HOT)).drop("m")
    cold = result.filter(F.col("m") <= F.lit(total / HOT)).drop("m")
    of_hot = rows.join(F.broadcast(hot), ["k1", "k2"])
    others = rows.join(F.broadcast(hot.select("k1", "k2")), ["k1", "k2"], "left_anti").join(cold, ["k1", "k2"], "left")
    own = F.col("vec_id").cast("long")
    out = of_hot.unionByName(others).withColumn("n_links", F.coalesce("n_links", F.lit(0)).cast("long")).withColumn("component_id", F.coalesce("component_id", own))
    return out.withColumn("kept", F.coalesce(own == F.col("component_id"), F.lit(False))).select(*(c for c in rows.columns if c not in ("k1", "k2")), *MADE)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settled(lambda: link_vectors(table(spark, sf_dir, "embeddings")).select("vec_id", "n_links", "component_id", "kept"), "embedding-dedup")
