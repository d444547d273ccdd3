"""N-gram Jaccard join by a MinHash LSH forest with exact verification.

A document is its set of word shingles: ``n`` consecutive words, or all its
words where there are fewer. The steps:

1. One pass makes each row's set fingerprint and its MinHash signature of
   ``trees`` x ``max_depth`` values. Rows of equal sets are one class with a
   count, named by its set; copies are never compared with one another.
2. Every tree is a prefix trie: the class's values of that tree, big-endian,
   sort as the trie does. Only classes that share a node at the last depth go on.
3. From ``max_depth`` the matched prefixes are shortened one value at a time. At
   each depth nodes with an open class are visited, sorted and in blocks, and
   signatures tell near pairs. A pair belongs to the depth of its longest common
   prefix in any tree, and to the first tree that has it, so each is met once.
   A class closes when its partners so far, each weighted by the probability
   that this depth would have found it, show that ``target_recall`` of them is
   reached. No class goes on beyond the last depth, the one at which a pair at
   the threshold itself is found with ``target_recall``:
   1 - (1 - threshold^depth)^trees. A node returns a row for each class that
   has a near pair in it, never the pairs.
4. Only these candidate pairs are verified exactly, block by block, on the
   shingle sets of the whole texts: links are counted and each block returns a
   root for each class.

Nodes of any size are dealt into blocks, so no task holds a whole hot group and
nothing is capped. Defined results: each row is a document of its own, also
where rows share a doc_id or a text; a row without a word (null and empty texts
too), or whose id is null, links with nothing (the component of a null id is
null); columns other than the id and the text don't matter and may have any
name; texts of any length are read whole; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import number_of, ordered_key, perhaps_in, settled, table, without, written
from .components import connected_components, joined

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
MIX = np.uint64(0x9E3779B97F4A7C15)
#: A pair below the threshold by this much in its estimate is left out before the exact step: five standard errors.
ERRORS = 5.0


def depth_for(threshold: float, trees: int, max_depth: int, target_recall: float) -> int:
    """The longest prefix that still reaches the target recall at the threshold."""
    for depth in range(max_depth, 1, -1):
        if 1 - (1 - threshold**depth) ** trees >= target_recall:
            return depth
    return 1


class WordHashes(dict):
    """64-bit hashes of words, kept as met."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 300_000:
            self.clear()
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 32:
            self[word] = h
        return h


_hashes = WordHashes()


def shingles(text: bytes | None, n: int) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    words = WORD.findall(text.lower()) if text else []
    if not words:
        return np.zeros(0, np.uint64)
    ids = np.array([_hashes[w] for w in words], np.uint64)
    size = min(n, len(ids))
    value = np.full(len(ids) - size + 1, size, np.uint64)
    for k in range(size):
        value = (value ^ ids[k : k + len(value)]) * MIX
        value ^= value >> np.uint64(31)
    return np.unique(value)


def fingerprint(own: np.ndarray) -> tuple[int, int]:
    """Two 64-bit sums over a set of shingles."""
    return int(own.sum().astype(np.int64)), int(np.bitwise_xor.reduce((own ^ (own >> np.uint64(29))) * MIX).astype(np.int64))


def permutations(count: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_240_229)
    return rng.integers(1, 2**63, count, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, count, np.uint64)


def signature(own: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The upper 32 bits of the least value of each permutation."""
    least = np.full(len(a), 2**64 - 1, np.uint64)
    for k in range(0, len(own), 1024):
        np.minimum(least, (own[k : k + 1024, None] * a + b).min(0), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def sketches(docs: DataFrame, n: int, trees: int, max_depth: int, text_col: str = "text") -> DataFrame:
    """(doc_id, h, f1, f2, size, sig): each row with its text's hash, set fingerprint, set size and signature; size 0 links with nothing."""
    kinds = "doc_id long, h long, f1 long, f2 long, size int, sig binary"

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = permutations(trees * max_depth)
        for batch in batches:
            f1, f2, sizes, sigs = [], [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist(), strict=True):
                own = shingles(text, n) if doc is not None else ()
                sizes.append(len(own))
                if len(own):
                    x, y = fingerprint(own)
                    f1.append(x)
                    f2.append(y)
                    sigs.append(signature(own, a, b).astype(">u4").tobytes())
                else:
                    f1.append(None)
                    f2.append(None)
                    sigs.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array(sizes, pa.int32()), pa.array(sigs, pa.binary())], ["doc_id", "h", "f1", "f2", "size", "sig"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("h"), F.col(text_col).alias("text")).mapInArrow(sketch, kinds)


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The groups of a partition that is sorted by ``keys``; a group may span batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [np.asarray(batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False)) for k in keys]
        new = np.zeros(batch.num_rows, bool)
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        first = tuple(c[0] for c in columns)
        new[0] = last is not None and first != last
        last = tuple(c[-1] for c in columns)
        at = np.flatnonzero(new).tolist()
        begins = set(at)
        for a, z in zip([0, *at], [*at, batch.num_rows], strict=True):
            if a in begins and held:
                yield pa.Table.from_batches(held)
                held = []
            if z > a:
                held.append(batch.slice(a, z - a))
    if held:
        yield pa.Table.from_batches(held)


class Block:
    """The classes of one pair of blocks of a node, in the order of their ids."""

    def __init__(self, group: pa.Table, trees: int, max_depth: int):
        self.cids = group["cid"].to_pylist()
        self.order = sorted(range(len(self.cids)), key=self.cids.__getitem__)
        self.cids = [self.cids[i] for i in self.order]
        sigs = group["sig"].to_pylist()
        self.sigs = np.frombuffer(b"".join(sigs[i] for i in self.order), ">u4").astype(np.uint32).reshape(len(sigs), trees, max_depth)
        own = self.column(group, "own")
        self.left, self.right = np.flatnonzero(own == group["bi"][0].as_py()), np.flatnonzero(own == group["bj"][0].as_py())
        self.tree = group["tree"][0].as_py()

    def column(self, group: pa.Table, name: str) -> np.ndarray:
        return group[name].to_numpy()[self.order]

    def candidates(self, depth: int, least_equal: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(left positions, equal values of each with the right ones), 0 for those that are no candidates of this node, which is one of ``depth``."""
        flat = self.sigs.reshape(len(self.sigs), -1)
        step = max(1, (1 << 22) // (flat.shape[1] * max(1, len(self.right))))
        for a in range(0, len(self.left), step):
            rows = self.left[a : a + step]
            equal = (flat[rows][:, None, :] == flat[self.right][None]).sum(2, dtype=np.int32)
            equal[(equal < least_equal) | (rows[:, None] == self.right[None])] = 0
            i, j = np.nonzero(equal)
            for p in range(0, len(i), 1 << 14):
                x, y = i[p : p + (1 << 14)], j[p : p + (1 << 14)]
                common = np.cumprod(self.sigs[rows[x]] == self.sigs[self.right[y]], axis=2, dtype=np.int8).sum(2)
                mine = (common.max(1) == depth) & (common.argmax(1) == self.tree)
                equal[x[~mine], y[~mine]] = 0
            yield rows, equal


def dealt_blocks(members: DataFrame, key: list[str]) -> DataFrame:
    """Each member (with ``blocks``, the number of its node) once for every pair of blocks that its own takes part in: columns bi <= bj and own."""
    own = members.withColumn("own", F.pmod(F.xxhash64("cid"), "blocks").cast("int"))
    spread = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = spread.withColumn("bi", F.least("own", "other")).withColumn("bj", F.greatest("own", "other")).drop("other", "blocks")
    return pairs.repartition(*key, "bi", "bj").sortWithinPartitions(*key, "bi", "bj")


NODE = ["tree", "node"]


def climb(classes: DataFrame, trees: int, max_depth: int, last: int, threshold: float, target_recall: float, least_equal: int, block: int, block_shingles: int) -> DataFrame:
    """(depth, tree, node, bi, bj, own, cid) of the classes that have a candidate pair in a node's pair of blocks."""
    width = 4 * max_depth
    paths = classes.select("cid", "size", "sig", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree")).select("cid", "size", "tree", F.col("sig").substr(F.col("tree") * width + 1, F.lit(width)).alias("path"))
    upto = lambda d: F.substring("path", 1, 4 * d)
    stem = F.xxhash64("tree", upto(last)).alias("stem")
    shared = paths.groupBy("tree", stem).agg(F.count("*").alias("n")).filter("n > 1").select("tree", "stem")
    paths = written(paths.withColumn("stem", stem).join(shared, ["tree", "stem"], "left_semi").drop("stem"), "forest")
    sigs = written(classes.select("cid", "sig").join(paths.select("cid").distinct(), "cid", "left_semi"), "signatures")
    found: list[DataFrame] = []
    for depth in range(max_depth, last - 1, -1):
        placed = paths.withColumn("node", F.xxhash64("tree", upto(depth)))
        opened = placed.withColumn("open", F.lit(1))
        if found:
            parts = [f.groupBy("cid").agg(F.sum("met").alias("met"), F.sum("expected").alias("expected")) for f in found]
            closed = reduce(DataFrame.unionByName, parts).groupBy("cid").agg(F.sum("met").alias("met"), F.sum("expected").alias("expected")).filter(F.col("met") >= F.col("expected") * target_recall)
            opened = placed.join(closed.select("cid", F.lit(0).alias("open")), "cid", "left").withColumn("open", F.coalesce("open", F.lit(1)))
        own, after = F.xxhash64("cid"), F.xxhash64(F.substring("path", 4 * depth + 1, 4))
        nodes = opened.groupBy(*NODE).agg(
            F.count("*").alias("n"), F.sum("open").alias("n_open"), F.sum("size").alias("total"), F.min(own).alias("low"), F.bit_xor(F.xxhash64(F.lit(depth), "cid")).alias("x"), F.min(after).alias("first"), F.max(after).alias("final")
        ).filter("n > 1 AND n_open > 0")
        if depth < max_depth:  # else all its classes share the next value as well: the node below it has met its pairs
            nodes = nodes.filter("first <> final")
        # of nodes of the same classes only the first tree's can have candidates
        once = nodes.groupBy("n", "low", "x").agg(F.min(F.struct("tree", "node", "total")).alias("k"))
        size = F.greatest(F.ceil(F.col("n") / block), F.ceil(F.col("k.total") / block_shingles)).cast("int").alias("blocks")
        places = placed.select("cid", *NODE).join(once.select("k.tree", "k.node", size), NODE)
        # a class meets its signature once, not once a tree
        members = places.groupBy("cid").agg(F.collect_list(F.struct(*NODE, "blocks")).alias("places")).join(sigs, "cid").select("cid", "sig", F.inline("places"))

        def compare(batches: Iterator[pa.RecordBatch], depth=depth) -> Iterator[pa.RecordBatch]:
            held: list[list] = [[] for _ in range(9)]

            def made():
                kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.float64()]
                return pa.RecordBatch.from_arrays([pa.array(h, k) for h, k in zip(held, kinds, strict=True)], ["depth", "tree", "node", "bi", "bj", "own", "cid", "met", "expected"])

            # what one over the chance of having been found by now is, for each number of equal values
            alike = np.arange(trees * max_depth + 1) / (trees * max_depth)
            weight = 1 / np.maximum(1 - (1 - alike**depth) ** trees, 1e-9)
            weight[:least_equal] = 0
            for group in groups(batches, [*NODE, "bi", "bj"]):
                if group.num_rows < 2:
                    continue
                here = Block(group, trees, max_depth)
                met, expected = np.zeros(group.num_rows, np.int64), np.zeros(group.num_rows)
                for rows, equal in here.candidates(depth, least_equal):
                    near, w = equal > 0, weight[equal] * (equal > 0)
                    np.add.at(met, rows, near.sum(1))
                    np.add.at(expected, rows, w.sum(1))
                    if group["bi"][0] != group["bj"][0]:
                        met[here.right] += near.sum(0)
                        expected[here.right] += w.sum(0)
                own = here.column(group, "own")
                for i in np.flatnonzero(met).tolist():
                    for h, x in zip(held, (depth, here.tree, group["node"][0].as_py(), group["bi"][0].as_py(), group["bj"][0].as_py(), int(own[i]), here.cids[i], int(met[i]), float(expected[i])), strict=True):
                        h.append(x)
                if len(held[0]) > 50_000:
                    yield made()
                    held = [[] for _ in range(9)]
            yield made()

        kinds = "depth int, tree int, node long, bi int, bj int, own int, cid binary, met long, expected double"
        found.append(written(dealt_blocks(members, NODE).select(*NODE, "bi", "bj", "own", "cid", "sig").mapInArrow(compare, kinds), f"candidates-{depth}"))
    return reduce(DataFrame.unionByName, found).drop("met", "expected")


def intersections(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The sizes of the intersections of left with right sets."""
    if len(left) * len(right) <= 16:
        return np.array([[len(np.intersect1d(sets[i], sets[j], True)) for j in right] for i in left], np.int64).reshape(len(left), len(right))
    used = np.unique(np.concatenate([left, right]))
    values, column, times = np.unique(np.concatenate([sets[i] for i in used]), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(used)), [len(sets[i]) for i in used])
    shared = times[column] > 1
    kept = np.cumsum(times > 1) - 1
    row, column = row[shared], kept[column[shared]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    total = int(column[-1]) + 1 if len(column) else 0
    out = np.zeros((len(left), len(right)), np.float32)
    l_at, r_at = np.searchsorted(used, left), np.searchsorted(used, right)
    step = max(64, (1 << 22) // max(1, len(used)))
    for a in range(0, total, step):
        lo, hi = np.searchsorted(column, [a, a + step])
        dense = np.zeros((len(used), min(step, total - a)), np.float32)
        dense[row[lo:hi], column[lo:hi] - a] = 1
        out += dense[l_at] @ dense[r_at].T
    return np.rint(out).astype(np.int64)


def verify(docs: DataFrame, classes: DataFrame, found: DataFrame, trees: int, max_depth: int, least_equal: int, threshold: float, n: int, text_col: str = "text") -> DataFrame:
    """(cid, links, root) from the exact Jaccard similarities of the candidate pairs of ``found``."""
    key = ["depth", *NODE, "bi", "bj"]
    # one row a class, so it meets its signature and its text once, not once for each pair of blocks
    places = found.groupBy("cid").agg(F.collect_list(F.struct(*key, "own")).alias("places"))
    members = written(places.join(classes.select("cid", "rep", "m", "sig"), "cid").select("*", "rep.*").drop("rep"), "members")
    # a class is found again by the id and the text of its first row; rows that repeat both serve as well
    first = ["doc_id", "h"]
    wanted = members.select(*first).distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("h"), F.col(text_col).alias("text"))
    texts = perhaps_in(texts, wanted, first, "perhaps").filter("perhaps").drop("perhaps").join(wanted, first).dropDuplicates(first)
    dealt = members.join(texts, first).select("cid", "sig", "m", "text", F.inline("places")).repartition(*key).sortWithinPartitions(*key)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, key):
            here = Block(group, trees, max_depth)
            m, texts = here.column(group, "m"), group["text"].cast(pa.binary())
            sets = [shingles(texts[i].as_py(), n) for i in here.order]
            sizes = np.array([len(s) for s in sets])
            links, labels = np.zeros(len(sets), np.int64), np.arange(len(sets))
            two = group["bi"][0] != group["bj"][0]
            for rows, equal in here.candidates(group["depth"][0].as_py(), least_equal):
                i, j = np.flatnonzero(equal.any(1)), np.flatnonzero(equal.any(0))
                if not len(i):
                    continue
                left, right = rows[i], here.right[j]
                common = intersections(sets, left, right)
                near = common / np.maximum(1, sizes[left][:, None] + sizes[right][None] - common) >= threshold
                near &= equal[np.ix_(i, j)] > 0
                links[left] += near @ m[right]
                if two:
                    links[right] += near.T @ m[left]
                joined(labels, near, left, right)
            some = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays([pa.array([here.cids[i] for i in some], pa.binary()), pa.array(links[some], pa.int64()), pa.array([here.cids[labels[i]] for i in some], pa.binary())], ["cid", "links", "root"])

    return dealt.select(*key, "own", "cid", "sig", "m", "text").mapInArrow(check, "cid binary, links long, root binary")


def linked_rows(
    docs: DataFrame, threshold: float = 0.8, n: int = 5, trees: int = 24, max_depth: int = 7, target_recall: float = 0.9999, block: int = 512, block_shingles: int = 200_000, text_col: str = "text"
) -> DataFrame:
    """One row (doc_id, h, n_links, component_id, kept) for each row of ``docs``; h is xxhash64 of its text, kept marks what stands for its group."""
    last = depth_for(threshold, trees, max_depth, target_recall)
    width = trees * max_depth
    least_equal = max(1, int(np.floor(width * threshold - ERRORS * np.sqrt(width * threshold * (1 - threshold)))))
    rows = written(sketches(docs, n, trees, max_depth, text_col), "sketches")
    sets = rows.filter("size > 0").groupBy("f1", "f2", "size").agg(F.min(F.struct("doc_id", "h")).alias("rep"), F.count("*").alias("m"), F.min_by("sig", "doc_id").alias("sig"))
    classes = written(sets.withColumn("cid", ordered_key(F.col("rep.doc_id"), F.col("f1"))), "classes")
    found = climb(classes, trees, max_depth, last, threshold, target_recall, least_equal, block, block_shingles)
    links = written(verify(docs, classes, found, trees, max_depth, least_equal, threshold, n, text_col), "links")
    labels = connected_components(links.select(F.col("cid").alias("u"), F.col("root").alias("v")))
    counts = links.groupBy("cid").agg(F.sum("links").alias("links"))
    met = classes.drop("sig").join(counts, "cid", "left").join(labels.withColumnRenamed("node", "cid"), "cid", "left").withColumn("n_links", F.col("m") - 1 + F.coalesce("links", F.lit(0)))
    of_class = met.filter("n_links > 0").select("f1", "f2", "size", "n_links", number_of(F.coalesce("component", "cid")).alias("component_id"), F.when(F.col("component").isNull(), F.col("rep")).alias("rep"))
    out = rows.select("doc_id", "h", "f1", "f2", "size").join(of_class, ["f1", "f2", "size"], "left")
    kept = F.col("n_links").isNull() | F.coalesce(F.struct("doc_id", "h") == F.col("rep"), F.lit(False))
    return out.select("doc_id", "h", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "doc_id").alias("component_id"), kept.alias("kept"))


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """One row (doc_id, n_links, component_id) for each row of ``docs``.

    n_links: other rows of a Jaccard similarity of ``threshold`` or more;
    component_id: the least doc_id that links reach, its own included. Options
    as in ``linked_rows``.
    """
    return settled(lambda: linked_rows(docs, **options).drop("h", "kept"), "near-duplicates")


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one row of each group, one of the least doc_id; rows without an id or a word stay."""
    found = settled(lambda: linked_rows(docs, **options).filter("n_links > 0"), "near-duplicates").select(F.col("doc_id").alias("_near_id"), F.col("h").alias("_near_h"), "kept")
    key = ["_near_id", "_near_h"]
    # rows that repeat id and text stand or go together; of those that stand one is enough
    told = found.groupBy(*key).agg(F.bool_or("kept").alias("_kept"), F.count("*").alias("_rows"))
    marked = without(docs, *key, "_kept", "_rows", "_perhaps", "_bucket", "_bits").select("*", F.col("doc_id").cast("long").alias("_near_id"), F.xxhash64(F.col(options.get("text_col", "text"))).alias("_near_h"))
    met = perhaps_in(marked, told, key, "_perhaps")
    alone = met.filter("NOT _perhaps").drop("_perhaps", *key)
    left = met.filter("_perhaps").drop("_perhaps").join(told, key, "left").filter("_kept IS NULL OR _kept")
    once = left.filter("_rows > 1").dropDuplicates(key)
    return left.filter("_rows IS NULL OR _rows = 1").unionByName(once).drop(*key, "_kept", "_rows").unionByName(alone)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
