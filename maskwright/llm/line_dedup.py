"""Line dedup with levelled sorted runs of line hashes.

A line's key is the line without white space at its ends and with A-Z in lower
case; keys of fewer than ``min_chars`` code points never count. Documents come
in batches of descending doc_id ranges. A batch is first combined to one row a
key: (line, n documents, largest doc_id). It then merge-anti-joins the runs:
keys that a run already holds in ``min_docs`` documents are settled (their
largest doc_id is in an earlier batch) and need no new entry. The other keys
are added as a run of their own. When a level has ``fanout`` runs they are
compacted into one of the next level. A key that the last compaction shows in
``min_docs`` documents or more loses all its lines but those in the largest
doc_id.

A run is a table bucketed and sorted by line hash, so anti-joins and
compactions merge bucket with bucket, without an exchange of the runs.

Hashes are 128 bits wide. Hot lines: combining happens on the map side before
the first shuffle by line, so a key meets a task at most once per task of the
stage before. Where the documents of repeated keys are looked up, keys that make
up more than 1/HOT of all (document, line) rows are fewer than HOT, whatever the
input; they are broadcast, so no task holds all rows of such a key.

Defined results: a null or empty text is one empty line; a text of any length
is read whole, its lines being the largest unit held; the lines of a document
whose id is null neither count nor go; rows that share a doc_id, repeats
included, are one document; a null text stays null; an empty table gives an
empty result; input columns named n_lines or n_dropped are replaced, others stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, discard, settled, sorted_run, table, without, written

SPACE = b" \t\n\x0b\x0c\r"
CHUNK_BYTES = 4 << 20
HOT = 1000


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """The 16-byte hash of a line's key, None if the key is too short to count."""
    import xxhash

    key = line.strip(SPACE).lower()  # bytes.lower() changes A-Z alone
    if len(key) < min_chars or len(key) < 4 * min_chars and not key.isascii() and len(key.decode()) < min_chars:
        return None
    return xxhash.xxh3_128_digest(key)


def line_hashes(docs: DataFrame, min_chars: int = 20, text_col: str = "text") -> DataFrame:
    """(doc_id, line): the distinct line hashes of each row."""

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lines = [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                own = {line_key(x, min_chars) for x in text.split(b"\n")} - {None}
                ids += [doc] * len(own)
                lines += own
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(lines, pa.binary())], ["doc_id", "line"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text_col).alias("text")).dropna()
    return rows.mapInArrow(hashes, "doc_id long, line binary")


class LineRuns:
    """The levels of sorted runs; each run is a table (line, n, top) bucketed and sorted by line."""

    def __init__(self, min_docs: int = 3, fanout: int = 2):
        self.min_docs, self.fanout = min_docs, fanout
        self.levels: list[list[DataFrame]] = []

    def add(self, batch: DataFrame) -> None:
        """``batch``: (doc_id, line) of documents whose ids are below those of all batches before."""
        new = batch.distinct().groupBy("line").agg(F.count("*").alias("n"), F.max("doc_id").alias("top"))
        for level in self.levels:
            for run in level:
                new = new.join(run.filter(F.col("n") >= self.min_docs).select("line").hint("merge"), "line", "left_anti")
        made = sorted_run(new, "line", "run")
        level = 0
        while True:
            if len(self.levels) == level:
                self.levels.append([])
            self.levels[level].append(made)
            if len(self.levels[level]) < self.fanout:
                return
            made = self._merge(self.levels[level])
            self.levels[level] = []
            level += 1

    def _merge(self, runs: list[DataFrame]) -> DataFrame:
        """Runs merged two by two: a full outer merge join keeps the bucketing, which a union would lose."""
        both = runs[0]
        for run in runs[1:]:
            other = run.select("line", F.col("n").alias("_n"), F.col("top").alias("_top")).hint("merge")
            zero = F.lit(0).cast("long")
            both = both.join(other, "line", "full").select("line", (F.coalesce("n", zero) + F.coalesce("_n", zero)).alias("n"), F.greatest("top", "_top").alias("top"))
        merged = sorted_run(both, "line", "run")
        for r in runs:
            discard(r)
        return merged

    def repeated(self) -> DataFrame:
        """(line, n, top) of the keys found in ``min_docs`` documents or more; compacts what is left."""
        runs = [r for level in self.levels for r in level]
        if len(runs) > 1:
            runs = [self._merge(runs)]
            self.levels = [runs]
        return runs[0].filter(F.col("n") >= self.min_docs)


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, batches: int = 4, fanout: int = 2, text_col: str = "text") -> DataFrame:
    """``docs`` with the text's repeated lines gone, and n_lines (before) and n_dropped."""
    docs = without(docs, "n_lines", "n_dropped")
    lines = written(line_hashes(docs, min_chars, text_col), "lines")
    low, high, rows = lines.agg(F.min("doc_id"), F.max("doc_id"), F.count("*")).first()
    runs = LineRuns(min_docs, fanout)
    if low is not None:
        width = (high - low) // batches + 1
        for b in reversed(range(batches)):
            runs.add(lines.filter((F.col("doc_id") >= low + b * width) & (F.col("doc_id") < low + (b + 1) * width)) if b + 1 < batches else lines.filter(F.col("doc_id") >= low + b * width))
        again = runs.repeated()
        hot = again.filter(F.col("n") > F.lit(rows / HOT)).select("line", "top")
        cold = lines.join(F.broadcast(hot.select("line")), "line", "left_anti").join(again.filter(F.col("n") <= F.lit(rows / HOT)).select("line", "top"), "line")
        met = lines.join(F.broadcast(hot), "line").unionByName(cold)
        gone = met.filter(F.col("doc_id") < F.col("top")).groupBy("doc_id").agg(F.collect_set("line").alias("_gone"))
    else:
        gone = lines.groupBy("doc_id").agg(F.collect_set("line").alias("_gone"))
    own = F.col("doc_id").cast("long")
    joined = docs.withColumn("_id", own).join(gone.withColumnRenamed("doc_id", "_id"), "_id", "left").drop("_id")
    at = docs.columns.index(text_col)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(at).cast(pa.binary()).to_pylist()
            for a, z in chunks([len(t or b"") for t in raw], CHUNK_BYTES):
                piece = batch.slice(a, z - a)
                texts, n_lines, n_dropped = [], [], []
                for text, gone in zip(raw[a:z], piece.column(piece.num_columns - 1).to_pylist(), strict=True):
                    n_lines.append(1 + (text or b"").count(b"\n"))
                    if gone:
                        gone = set(gone)
                        kept = [x for x in text.split(b"\n") if line_key(x, min_chars) not in gone]
                        n_dropped.append(n_lines[-1] - len(kept))
                        text = b"\n".join(kept)
                    else:
                        n_dropped.append(0)
                    texts.append(text)
                columns = [*piece.columns[:-1], pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())]
                columns[at] = pa.array(texts, pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays(columns, [*piece.schema.names[:-1], "n_lines", "n_dropped"])

    return joined.mapInArrow(cut, T.StructType([*docs.schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())]))


ORACLE_SQL = r"""
WITH lines AS (
  SELECT doc_id, pos, s AS line, translate(regexp_replace(s, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS s, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents)
), hot AS (
  SELECT key, max(doc_id) AS top FROM lines WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT l.*, coalesce(h.top IS NOT NULL AND l.doc_id <> h.top, false) AS gone FROM lines l LEFT JOIN hot h ON l.key = h.key
)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return settled(lambda: dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256")), "line-dedup")
