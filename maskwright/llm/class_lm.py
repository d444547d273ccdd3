"""LM scoring with Brown class-based n-grams.

Words are mapped to units: the ``frequent`` most frequent training words are
units of their own, all others share ``suffixes`` units by their last
characters, and the end of a text is one. Exchange clustering on the unit
bigrams of all training texts assigns units, and so every word that can occur,
to classes. Then every other broadcast word that occurs ``least`` times or more
becomes a unit too, at first in its suffix's class, and is exchanged in
``passes`` over the texts by its own bigrams with classes; so the clustered vocabulary grows with
the corpus. Transitions are counted with the final classes. A word's
probability is

    P(w | history) = P(class(w) | class of the word before) * P(w | class(w)),

with the transition smoothed towards the class's share and the emission by one
for each known word and one for all unknown words of the class, so that both
sum to one. The class before the first word is that of an end.

Word counts cover all training texts and stay in a table. Scoring is two-tier:
counts of at most ``broadcast_words`` frequent words are broadcast and looked
up in place; the other words of a document, with their number, meet the table
in a join. The bigrams gathered are those of the first units, bounded by their
number, and for each word exchanged later those with the classes.

Defined results: a null text is empty, it has one token, its end; a document
without an id is held out; repeated rows are learned from and scored each; texts
of any length are read whole; of equally frequent words either all are broadcast
or none, and they stand in byte order; with nothing to learn from every word is
unknown; an empty table gives an empty result. Input columns named like a result
column are replaced; others stay but the text.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, settled, table, without, written

FLUSH = 300_000
CHUNK_BYTES = 2 << 20


def words_of(text: bytes | None) -> list[bytes]:
    """bytes.lower() changes A-Z alone and bytes.split() splits at exactly 0x20 and 0x09-0x0D."""
    return text.lower().split() if text else []


class Units(dict):
    """The unit of a word; suffixes are kept as met."""

    def __init__(self, frequent: list[bytes], suffixes: int):
        super().__init__({w: i for i, w in enumerate(frequent)})
        self.first, self.suffixes = len(frequent), suffixes
        self.end = self.first + suffixes
        self.tails: dict[bytes, int] = {}

    def of_tail(self, word: bytes) -> int:
        tail = word[-3:]
        unit = self.tails.get(tail)
        if unit is None:
            if len(self.tails) > 200_000:
                self.tails.clear()
            unit = self.tails[tail] = self.first + crc32(tail) % self.suffixes
        return unit

    def of(self, words: list[bytes]) -> np.ndarray:
        get, tail = self.get, self.of_tail
        return np.array([u if (u := get(w)) is not None else tail(w) for w in words], np.int64)


def _move(counts: np.ndarray, c: int, out: np.ndarray, into: np.ndarray, loop: float, classes: int) -> int:
    """Moves a unit of class c to the class that raises the likelihood most, in ``counts`` too, and returns that class."""
    f = lambda x: x * np.log(np.maximum(x, 1))
    counts[c] -= out
    counts[:, c] -= into
    counts[c, c] -= loop
    rows, columns = counts.sum(1), counts.sum(0)
    gain = (f(counts + out[None, :]) - f(counts)).sum(1) + (f(counts + into[:, None]) - f(counts)).sum(0)
    # the diagonal gets what goes out to, comes in from and stays in the class at once
    d = np.diag(counts)
    gain += f(d + out + into + loop) - f(d + out) - f(d + into) + f(d)
    gain -= f(rows + out.sum() + loop) - f(rows) + f(columns + into.sum() + loop) - f(columns)
    best = int(np.argmax(gain[:classes]))
    if gain[best] <= gain[c] + 1e-9:
        best = c
    counts[best] += out
    counts[:, best] += into
    counts[best, best] += loop
    return best


def exchange(bigrams: np.ndarray, classes: int, rounds: int = 10) -> np.ndarray:
    """The class of each unit; the last unit, the end, keeps a class of its own, the last.

    Units move one by one to the class that raises the bigram likelihood most,
    sum N(c,d) log N(c,d) - 2 sum N(c) log N(c), until none moves.
    """
    n = len(bigrams)
    total = bigrams.sum(0) + bigrams.sum(1)
    own = np.zeros(n, int)
    order = [u for u in np.argsort(-total, kind="stable") if u != n - 1]
    for k, u in enumerate(order):
        own[u] = k % classes
    own[n - 1] = classes
    size = classes + 1
    b = bigrams.astype(float)
    counts = np.zeros((size, size))
    np.add.at(counts, (own[:, None], own[None, :]), b)
    for _ in range(rounds):
        moved = 0
        for u in order:
            if not total[u]:
                continue
            out = np.bincount(own, b[u], size)
            into = np.bincount(own, b[:, u], size)
            loop, c = b[u, u], own[u]
            out[c] -= loop
            into[c] -= loop
            best = _move(counts, c, out, into, loop, classes)
            moved += best != c
            own[u] = best
        if not moved:
            break
    return own


def _sequences(batches: Iterator[pa.RecordBatch], own: Units) -> Iterator[np.ndarray]:
    """The units of the texts in pieces of some million; each piece begins and ends with an end."""
    for batch in batches:
        held: list[np.ndarray] = [np.array([own.end])]
        length = 0
        for text in batch.column(0).cast(pa.binary()).to_pylist():
            held += [own.of(words_of(text)), np.array([own.end])]
            length += len(held[-2]) + 1
            if length > 2_000_000:
                yield np.concatenate(held)
                held, length = [np.array([own.end])], 0
        if length:
            yield np.concatenate(held)


def _summed(texts: DataFrame, count) -> tuple[np.ndarray, np.ndarray]:
    found = texts.mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    return found["key"].to_numpy(), found["n"].to_numpy()


def _sparse(total: np.ndarray) -> pa.RecordBatch:
    some = np.flatnonzero(total)
    return pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], ["key", "n"])


def _exchange_more(texts: DataFrame, units, suffixes: int, class_of: np.ndarray, first: int, classes: int) -> np.ndarray:
    """``class_of`` after each word from unit ``first`` on was moved once, most frequent first."""
    n_more, size = len(units.value) - first, classes + 1
    width = 2 * size + 1  # classes after the word, classes before it, the word itself
    base = n_more * width  # from here on the bigrams of classes

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(base + size * size, np.int64)
        for seq in _sequences(batches, Units(units.value, suffixes)):
            word, kind = seq - first, class_of[seq]
            mine = (word >= 0) & (word < n_more)
            same = word[:-1] == word[1:]
            a, b = mine[:-1] & ~same, mine[1:] & ~same
            keys = [word[:-1][a] * width + kind[1:][a], word[1:][b] * width + size + kind[:-1][b], word[:-1][mine[:-1] & same] * width + 2 * size, base + kind[:-1] * size + kind[1:]]
            found, n = np.unique(np.concatenate(keys), return_counts=True)
            total[found] += n
        yield _sparse(total)

    key, n = _summed(texts, count)
    order = np.argsort(key)
    key, n = key[order], n[order]
    bounds = np.searchsorted(key, np.arange(n_more + 1) * width)
    counts, own = np.zeros(size * size), class_of.copy()
    counts[key[bounds[-1] :] - base] = n[bounds[-1] :]
    counts = counts.reshape(size, size)
    for w in range(n_more):
        at = slice(bounds[w], bounds[w + 1])
        vector = np.zeros(width)
        vector[key[at] - w * width] = n[at]
        own[first + w] = _move(counts, int(own[first + w]), vector[:size], vector[size : 2 * size], vector[-1], classes)
    return own


def _class_bigrams(texts: DataFrame, units, suffixes: int, class_of: np.ndarray, size: int) -> np.ndarray:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size * size, np.int64)
        for seq in _sequences(batches, Units(units.value, suffixes)):
            kind = class_of[seq]
            total += np.bincount(kind[:-1] * size + kind[1:], minlength=size * size)
        yield _sparse(total)

    key, n = _summed(texts, count)
    joint = np.zeros(size * size)
    joint[key] = n
    return joint.reshape(size, size)


@dataclass
class Model:
    counts: DataFrame  # (word binary, n): all training words
    known: list[tuple[bytes, int]]  # the broadcast ones
    frequent: list[bytes]
    suffixes: int
    class_of: np.ndarray
    transition: np.ndarray  # log10 P(class | class before)
    emission: np.ndarray  # log10 of each class's denominator
    n_tokens: int
    n_distinct: int
    n_docs: int

    @property
    def base_log(self) -> float:
        return math.log10(self.n_tokens + self.n_distinct + 1)


def _counted(texts: DataFrame) -> DataFrame:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(c):
            return pa.RecordBatch.from_arrays([pa.array(list(c), pa.binary()), pa.array(list(c.values()), pa.int64())], ["word", "n"])

        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).cast(pa.binary()).to_pylist():
                counts.update(words_of(text))
                if len(counts) > FLUSH:
                    yield made(counts)
                    counts.clear()
        if counts:
            yield made(counts)

    return texts.mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _most_frequent(counts: DataFrame, most: int) -> list[tuple[bytes, int]]:
    """The words of the highest counts, ``most`` or fewer: a count that would go beyond is left out whole."""
    step = F.floor(F.log2("n") * 32).cast("int")
    found = sorted(((r[0], r[1]) for r in counts.groupBy(step.alias("step")).count().collect()), reverse=True)
    least, total = None, 0
    for s, k in found:
        if total + k > most:
            break
        least, total = s, total + k
    if least is None:
        return []
    rows = counts.filter(step >= least).toArrow()
    return sorted(zip(rows["word"].to_pylist(), rows["n"].to_pylist(), strict=True), key=lambda r: (-r[1], r[0]))


def train(training: DataFrame, text_col: str = "text", frequent: int = 511, suffixes: int = 256, classes: int = 48, broadcast_words: int = 150_000, pull: float = 5.0, least: int = 100, passes: int = 2) -> Model:
    """Learns from all rows of ``training``. ``pull``: weight of a class's share in its transitions."""
    texts = training.select(F.col(text_col).alias("text"))
    counts = written(_counted(texts), "word-counts")
    known = _most_frequent(counts, broadcast_words)
    top = [w for w, _ in known[:frequent]]
    spark = training.sparkSession
    units = spark.sparkContext.broadcast(top)
    size = len(top) + suffixes + 1

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Units(units.value, suffixes)
        total = np.zeros(size * size, np.int64)
        n_docs = 0
        for seq in _sequences(batches, own):
            total += np.bincount(seq[:-1] * size + seq[1:], minlength=size * size)
            n_docs += int((seq == own.end).sum()) - 1
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1), pa.int32()), pa.array(np.append(total[some], n_docs), pa.int64())], ["pair", "n"])

    found = texts.mapInArrow(pairs, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    at, n = found["pair"].to_numpy(), found["n"].to_numpy()
    n_docs = int(n[at == -1].sum())
    bigrams = np.zeros(size * size, np.int64)
    bigrams[at[at >= 0]] = n[at >= 0]
    bigrams = bigrams.reshape(size, size)
    class_of = exchange(bigrams, classes)
    joint = np.zeros((classes + 1, classes + 1))
    np.add.at(joint, (class_of[:, None], class_of[None, :]), bigrams)
    more = [w for w, k in known[len(top) :] if k >= least]
    if more:
        first = len(top)
        tails = Units([], suffixes).of(more)
        class_of = np.concatenate([class_of[:first], class_of[first + tails], class_of[first:]])
        top = top + more
        units = spark.sparkContext.broadcast(top)
        for _ in range(passes):
            class_of = _exchange_more(texts, units, suffixes, class_of, first, classes)
        joint = _class_bigrams(texts, units, suffixes, class_of, classes + 1)
    share = (joint.sum(0) + 1) / (joint.sum() + classes + 1)
    transition = np.log10((joint + pull * share) / (joint.sum(1, keepdims=True) + pull))
    shared = spark.sparkContext.broadcast(class_of)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, tokens, distinct = Units(units.value, suffixes), np.zeros(classes + 1, np.int64), np.zeros(classes + 1, np.int64)
        for batch in batches:
            c = shared.value[own.of(batch.column(0).to_pylist())] if batch.num_rows else np.zeros(0, int)
            np.add.at(tokens, c, batch.column(1).to_numpy())
            distinct += np.bincount(c, minlength=classes + 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(classes + 1), pa.int32()), pa.array(tokens), pa.array(distinct)], ["class", "tokens", "words"])

    tokens, words = np.zeros(classes + 1), np.zeros(classes + 1)
    for r in counts.mapInArrow(sums, "class int, tokens long, words long").groupBy("class").agg(F.sum("tokens").alias("tokens"), F.sum("words").alias("words")).collect():
        tokens[r["class"]], words[r["class"]] = r.tokens, r.words
    return Model(counts, known, top, suffixes, class_of, transition, np.log10(tokens + words + 1), int(tokens.sum()) + n_docs, int(words.sum()) + (n_docs > 0), n_docs)


MADE = ["n_tokens", "n_known", "base_score", "score"]


def score_documents(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with n_tokens, n_known, base_score and score (log10 probabilities of the whole text)."""
    docs = without(docs, *MADE, "_row", "_rare")
    spark = docs.sparkSession
    # words hold no white space: one string and one array are far smaller in the workers than a list of pairs
    packed = (b" ".join(w for w, _ in model.known), np.log10(np.array([n for _, n in model.known], np.float64) + 1))
    shared = spark.sparkContext.broadcast((*packed, model.frequent, model.suffixes, model.class_of, model.transition, model.emission))
    end_known, base_log = int(model.n_docs > 0), model.base_log
    end_base = math.log10(model.n_docs + 1)
    at = docs.columns.index(text_col)
    rare_type = pa.list_(pa.struct([pa.field("word", pa.binary()), pa.field("times", pa.int32())]))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, values, frequent, suffixes, class_of, transition, emission = shared.value
        logs = dict(zip(known.split(), values.tolist(), strict=True))
        units, get = Units(frequent, suffixes), logs.get
        end = class_of[-1]
        for batch in (b.slice(a, z - a) for b in batches for a, z in chunks(pc.binary_length(b.column(at)).fill_null(0).to_pylist(), CHUNK_BYTES)):
            n_tokens, n_known, path, sums, rare = [], [], [], [], []
            for text in batch.column(at).cast(pa.binary()).to_pylist():
                words = words_of(text)
                found = [get(w) for w in words]
                other = Counter(w for w, x in zip(words, found, strict=True) if x is None)
                seq = np.concatenate([[end], class_of[units.of(words)], [end]]) if words else np.array([end, end])
                n_tokens.append(len(words) + 1)
                n_known.append(len(words) - sum(other.values()) + end_known)
                path.append(float(transition[seq[:-1], seq[1:]].sum() - emission[seq[1:-1]].sum()))
                sums.append(math.fsum(x for x in found if x is not None))
                rare.append([{"word": w, "times": k} for w, k in other.items()])
            columns = [pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()), pa.array(path, pa.float64()), pa.array(sums, pa.float64()), pa.array(rare, rare_type)]
            yield pa.RecordBatch.from_arrays([*(c for i, c in enumerate(batch.columns) if i != at), *columns], [*(x for i, x in enumerate(batch.schema.names) if i != at), "n_tokens", "n_known", "_path", "_sum", "_rare"])

    kinds = [T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()), T.StructField("_path", T.DoubleType()), T.StructField("_sum", T.DoubleType())]
    kinds.append(T.StructField("_rare", T.ArrayType(T.StructType([T.StructField("word", T.BinaryType()), T.StructField("times", T.IntegerType())]))))
    partial = docs.mapInArrow(first, T.StructType([*(f for f in docs.schema.fields if f.name != text_col), *kinds]))
    # written once: the row numbers stay what they are, whatever is recomputed later
    partial = written(partial.withColumn("_row", F.monotonically_increasing_id()), "partial-scores")
    rare = partial.select("_row", F.inline("_rare"))
    met = rare.join(model.counts, "word").groupBy("_row").agg(F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("_more"), F.sum("times").alias("_met"))
    joined = partial.drop("_rare").join(met, "_row", "left")
    total = F.col("_sum") + F.coalesce("_more", F.lit(0.0))
    scored = joined.select(
        *(c for c in docs.columns if c != text_col), "n_tokens", (F.col("n_known") + F.coalesce("_met", F.lit(0))).alias("n_known"),
        (total + F.lit(end_base) - F.col("n_tokens") * F.lit(base_log)).alias("base_score"), (F.col("_path") + total).alias("score"),
    )
    return scored


def held_out():
    """Whether crc32 of the doc_id as text leaves the remainder 2 of 7; a null id does."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(True))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")

    def scored() -> DataFrame:
        model = train(docs.filter(~held_out()))
        return score_documents(docs, model).select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", F.lit(model.n_tokens).cast("long").alias("train_tokens"), "base_score", "score")

    return settled(scored, "lm-scores")
