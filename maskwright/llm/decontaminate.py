"""Benchmark decontamination: a broadcast hash set of normalised test n-grams.

Words are ``[0-9a-z]`` and every code point above U+007F after lower-casing
A-Z. A window is ``n`` consecutive words of a benchmark item; an item of fewer
words, but not none, is one window. The driver lays the windows of one block out
in flat arrays and broadcasts them: word ids for exact verification, their
rolling hashes in order and a table of bits. A worker keeps the block from task
to task. Document texts are scanned in place: no shuffle.

The broadcast is bounded: the windows are counted first and are dealt into
blocks of at most ``max_windows``; where there is more than one block the
documents pass them one after another, each block adding to what the previous
ones found, so results are exact for a benchmark of any size.

Defined results: a null or wordless text has no words and no hits; a null or
wordless item has no windows; an item whose id is null is left out; repeated
items count once; repeated documents each get their own row; texts of any length
are scanned whole; without items, or documents, nothing is hit; input columns
that have a result column's name are replaced, others stay.
"""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, shared_folder, table, without

#: Words of UTF-8 bytes after bytes.lower(), which lower-cases A-Z alone.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: The same words in a string, for code point offsets.
WORD_TEXT = re.compile(r"[0-9A-Za-z\x80-\U0010ffff]+")
#: The same for Spark's regular expressions.
SQL_WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
CHUNK_BYTES = 4 << 20

FOUND = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("items", T.ArrayType(T.LongType(), False)),
        T.StructField("hit_spans", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType(), False), T.StructField("end", T.IntegerType(), False)]), False)),
    ]
)


def words_of(text: str | bytes | None) -> list[bytes]:
    if text is None:
        return []
    return WORD.findall((text.encode() if isinstance(text, str) else text).lower())


def windows_of(words: list[bytes], n: int) -> list[tuple[bytes, ...]]:
    if not words:
        return []
    size = min(n, len(words))
    return [tuple(words[i : i + size]) for i in range(len(words) - size + 1)]


def benchmark_windows(benchmark: DataFrame, n: int = 8, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """One row ``(item_id, window)`` for each distinct window of an item; a window is its words joined by spaces."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, found = [], []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for w in windows_of(words_of(text), n) if item is not None else ():
                    ids.append(item)
                    found.append(b" ".join(w))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.binary())], ["item_id", "window"])

    rows = benchmark.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(explode, "item_id long, window binary").distinct()


class Windows:
    """The windows of one block in flat arrays, ready to be looked up.

    About 60 bytes a window and 100 a distinct word: word ids, a sorted 64-bit
    hash, one bit in a table of 64 bits a window, and the items of each.
    """

    def __init__(self, rows: pa.Table):
        windows, items = rows["window"].combine_chunks(), rows["item_id"].to_numpy()
        self.words = b" ".join(set(b" ".join(windows.to_pylist()).split(b" ")) - {b""})
        self.vocabulary: dict[bytes, int] | None = None
        get = self._ids().get
        sizes = np.array([w.as_py().count(b" ") + 1 for w in windows], np.int64)
        self.of: dict[int, tuple[np.ndarray, ...]] = {}
        bits = max(16, math.ceil(math.log2(64 * max(1, len(windows)))))
        self.shift = np.uint64(64 - bits)
        for size in np.unique(sizes).tolist():
            at = np.flatnonzero(sizes == size)
            ids = np.array([[get(w) for w in windows[i].as_py().split(b" ")] for i in at.tolist()], np.int32).reshape(len(at), size)
            hashes = self._hash(list(ids.astype(np.uint64).T))
            order = np.lexsort((items[at], *ids.T, hashes))
            ids, hashes, own = ids[order], hashes[order], items[at][order]
            new = np.r_[True, (ids[1:] != ids[:-1]).any(1)]
            table_of = np.zeros((1 << bits) // 8, np.uint8)
            slots = np.unique(hashes >> self.shift)
            np.bitwise_or.at(table_of, (slots >> np.uint64(3)).astype(np.int64), np.uint8(1) << (slots & np.uint64(7)).astype(np.uint8))
            self.of[size] = (table_of, hashes[new], ids[new], np.r_[np.flatnonzero(new), len(new)], own)
        self.vocabulary = None  # made again where it is used: words alone travel in a broadcast

    def _ids(self) -> dict[bytes, int]:
        if self.vocabulary is None:
            self.vocabulary = {w: i + 1 for i, w in enumerate(self.words.split(b" "))} if self.words else {}
        return self.vocabulary

    @staticmethod
    def _hash(columns) -> np.ndarray:
        value = np.zeros(len(columns[0]), np.uint64)
        for c in columns:
            value = (value ^ c) * MULTIPLIER
            value ^= value >> np.uint64(29)
        return value * MULTIPLIER

    def scan(self, ids: np.ndarray) -> list[tuple[int, int, list[int]]]:
        """Occurrences ``(start, length, items)``; 0 is a word outside the vocabulary or a document's end."""
        found = []
        wide = ids.astype(np.uint64)
        for size, (table_of, hashes, windows, begins, items) in self.of.items():
            count = len(ids) - size + 1
            if count <= 0:
                continue
            own = self._hash([wide[i : i + count] for i in range(size)])
            slots = own >> self.shift
            hits = np.flatnonzero(table_of[slots >> np.uint64(3)] >> (slots & np.uint64(7)).astype(np.uint8) & 1)
            for i, k in zip(hits.tolist(), np.searchsorted(hashes, own[hits]).tolist(), strict=True):
                while k < len(hashes) and hashes[k] == own[i]:
                    if (windows[k] == ids[i : i + size]).all():
                        found.append((i, size, items[begins[k] : begins[k + 1]].tolist()))
                        break
                    k += 1
        return found


_worker: dict[str, Windows] = {}


def _shared(token: str, broadcast) -> Windows:
    """A block's windows, kept in the worker from task to task; one block at a time."""
    if token not in _worker:
        _worker.clear()
        _worker[token] = broadcast.value
        _worker[token]._ids()
    return _worker[token]


def _scan(texts: list[bytes | None], windows: Windows) -> list[tuple[int, np.ndarray, set[int]]]:
    """For each text: its number of words, which words are hit (empty if none) and the items found."""
    get = windows._ids().get
    parts, starts, total, counts = [], [], 0, []
    gap = np.zeros(1, np.int32)
    for text in texts:
        words = WORD.findall(text.lower()) if text else ()
        parts += [np.array([get(w, 0) for w in words], np.int32), gap]
        counts.append(len(words))
        starts.append(total)
        total += len(words) + 1
    out = [(n, np.zeros(0, bool), set()) for n in counts]
    for i, size, items in windows.scan(np.concatenate(parts)) if parts else ():
        k = int(np.searchsorted(starts, i, "right")) - 1
        n, mask, ids = out[k]
        if not len(mask):
            mask = np.zeros(n, bool)
            out[k] = (n, mask, ids)
        mask[i - starts[k] : i - starts[k] + size] = True
        ids.update(items)
    return out


def _spans(text: str, mask: np.ndarray) -> list[dict[str, int]]:
    """Runs of hit words as half-open code point ranges of the text."""
    spans, last = [], -2
    for k, m in enumerate(WORD_TEXT.finditer(text)):
        if mask[k]:
            if last == k - 1:
                spans[-1]["end"] = m.end()
            else:
                spans.append({"start": m.start(), "end": m.end()})
            last = k
    return spans


def _mask_of(text: str, spans: list[dict[str, int]], n: int) -> np.ndarray:
    mask = np.zeros(n, bool)
    at = 0
    for k, m in enumerate(WORD_TEXT.finditer(text)):
        while at < len(spans) and spans[at]["end"] <= m.start():
            at += 1
        mask[k] = at < len(spans) and spans[at]["start"] <= m.start()
    return mask


def find_contamination(docs: DataFrame, benchmark: DataFrame, n: int = 8, text_col: str = "text", max_windows: int = 500_000) -> DataFrame:
    """``docs`` with n_words, n_hit, items (sorted ids) and hit_spans (runs of hit words, code points)."""
    spark = docs.sparkSession
    docs = without(docs, *FOUND.fieldNames())
    grams = benchmark_windows(benchmark, n).persist()
    total = grams.count()
    blocks = max(1, math.ceil(1.25 * total / max_windows)) if total > max_windows else 1
    kinds = T.StructType(docs.schema.fields + FOUND.fields)
    for b in range(blocks):
        part = grams if blocks == 1 else grams.filter(F.pmod(F.xxhash64("item_id", "window"), F.lit(blocks)) == b)
        windows = spark.sparkContext.broadcast(Windows(part.toArrow()))
        token = uuid.uuid4().hex
        first = b == 0
        source = docs
        text_at = source.columns.index(text_col)

        def scan(batches: Iterator[pa.RecordBatch], windows=windows, token=token, text_at=text_at, first=first) -> Iterator[pa.RecordBatch]:
            table_of = _shared(token, windows)
            for batch in batches:
                column = batch.column(text_at)
                raw = column.cast(pa.binary()).to_pylist()
                for a, z in chunks([len(t or b"") for t in raw], CHUNK_BYTES):
                    piece = batch.slice(a, z - a)
                    old = [None] * (z - a) if first else [dict(zip(FOUND.fieldNames(), r, strict=True)) for r in zip(*(piece.column(piece.schema.get_field_index(c)).to_pylist() for c in FOUND.fieldNames()), strict=True)]
                    n_words, n_hit, items, spans = [], [], [], []
                    for text, (count, mask, ids), before in zip(raw[a:z], _scan(raw[a:z], table_of), old, strict=True):
                        if before and before["items"]:
                            ids |= set(before["items"])
                            was = _mask_of(text.decode(), before["hit_spans"], count)
                            mask = was | mask if len(mask) else was
                        n_words.append(count)
                        n_hit.append(int(mask.sum()))
                        items.append(sorted(ids))
                        spans.append(_spans(text.decode(), mask) if len(mask) else [])
                    kept = [piece.column(i) for i in range(piece.num_columns) if piece.schema.field(i).name not in FOUND.fieldNames()]
                    names = [f.name for f in piece.schema if f.name not in FOUND.fieldNames()]
                    span = pa.struct([pa.field("start", pa.int32(), False), pa.field("end", pa.int32(), False)])
                    made = [pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(items, pa.list_(pa.field("element", pa.int64(), False))), pa.array(spans, pa.list_(pa.field("element", span, False)))]
                    yield pa.RecordBatch.from_arrays(kept + made, names + FOUND.fieldNames())

        docs = source.mapInArrow(scan, kinds)
        if b + 1 < blocks:
            shared_folder(spark)
            docs = docs.checkpoint()
    grams.unpersist()
    return docs


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", min_items: int = 2, n: int = 8, **options) -> DataFrame:
    """``docs`` without contaminated documents, or without their hit spans, or without both.

    A document is contaminated if windows of ``min_items`` items or more occur in it. ``remove``:

    * ``documents``: contaminated documents go.
    * ``spans``: the hit spans of contaminated documents are cut out.
    * ``leaks``: contaminated documents go; of the others, runs of at least ``n`` hit words are
      cut out (an item of fewer words may well be a common phrase). ``n_cut`` counts them.
    """
    if remove not in ("documents", "spans", "leaks"):
        raise ValueError("remove: documents, spans or leaks")
    if remove == "leaks":
        docs = without(docs, "n_cut")
    columns = docs.columns
    found = find_contamination(docs, benchmark, n, **options)
    text = options.get("text_col", "text")
    many = F.size("items") >= min_items
    if remove == "documents":
        return found.filter(~many).select(*columns)
    cut = F.expr(
        f"aggregate(hit_spans, named_struct('p', 0, 'o', ''), "
        f"(a, x) -> named_struct('p', x.end, 'o', concat(a.o, substring({text}, a.p + 1, x.start - a.p))), "
        f"a -> concat(a.o, substring({text}, a.p + 1)))"
    )
    if remove == "spans":
        return found.withColumn(text, F.when(many, cut).otherwise(F.col(text))).select(*columns)
    words = f"size(regexp_extract_all(substring({text}, x.start + 1, x.end - x.start), r'{SQL_WORD}', 0))"
    long = found.filter(~many).withColumn("hit_spans", F.expr(f"filter(hit_spans, x -> {words} >= {int(n)})"))
    n_cut = F.size("hit_spans").cast("long")
    return long.withColumn("n_cut", n_cut).withColumn(text, F.when(F.col("n_cut") > 0, cut).otherwise(F.col(text))).select(*columns, "n_cut")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    listed = F.concat_ws(",", F.sort_array(F.col("items").cast("array<string>")))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(listed, 256).alias("items_sha256"), (F.size("items") >= 2).alias("contaminated"),
    )
