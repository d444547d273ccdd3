"""Token counts by a map-side two-tier lookup.

A text is cut into pre-tokens that no piece of the vocabulary crosses: a run of
spaces with what follows it up to the next space or line feed, a run of line
feeds, or a run of trailing spaces. Tier one is a broadcast table of the
lengths of frequent pre-tokens; tier two is a cache in each Python worker that
encodes what it has not met. Pre-tokens are never shuffled.

The frequent table comes from all rows: each partition keeps a Misra-Gries
summary of ``table_size`` counters and the summaries are merged in two levels,
which keeps every pre-token that makes up more than 1/table_size of all. The
table only saves time, results never depend on it.

Defined results: a null text counts as empty, with 0 bytes and 0 tokens;
repeated rows are counted each; ties in the summaries decide only what is kept
in the table; texts of any length are counted whole; an empty table gives an
empty result; input columns named n_bytes or n_tokens are replaced, others stay.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table, without

PRETOKEN = re.compile(r" *[^ \n]+|\n+| +")
#: What a piece begins a word with; the library takes it for a space.
SPACE = "▁"
#: Pieces that lie within one pre-token: spaces come first or not at all.
WHOLE = re.compile(f"{SPACE}*[^{SPACE}]*")
#: Pre-tokens of more characters are encoded each time and not kept.
LONG = 64


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def pretokens(text: str) -> list[str]:
    """The pre-tokens of a text with the dummy space that the library puts before it."""
    return PRETOKEN.findall(" " + text.replace(SPACE, " ")) if text else []


def pruned(counts: dict[str, int], size: int) -> dict[str, int]:
    """A Misra-Gries summary of ``size`` counters at most."""
    if len(counts) <= size:
        return counts
    cut = sorted(counts.values(), reverse=True)[size]
    return {w: c - cut for w, c in counts.items() if c > cut}


class Lengths(dict):
    """Pre-token lengths: the frequent ones always, others as met, up to ``most``."""

    def __init__(self, model: str, frequent: list[str] = (), most: int = 400_000):
        import sentencepiece

        super().__init__()
        library = sentencepiece.SentencePieceProcessor(model_file=model)
        self.encode = library.encode
        if not all(WHOLE.fullmatch(library.id_to_piece(i)) for i in range(library.get_piece_size())):
            raise ValueError("this vocabulary has pieces that cross a space; the cuts are not exact for it")
        # the line feed keeps the dummy space apart; both count as one token
        self.base = len(self.encode("\n"))
        pieces = [self.encode(p) for p in ("\n ", "\na", "\n\n")]
        if any(len(p) != self.base + 1 for p in pieces):
            raise ValueError("this vocabulary joins line feeds to what follows; the cuts are not exact for it")
        self.most = most
        self.frequent = {w: self.length(w) for w in frequent}
        self.update(self.frequent)

    def length(self, pretoken: str) -> int:
        return len(self.encode("\n" + pretoken)) - self.base

    def __missing__(self, pretoken: str) -> int:
        n = self.length(pretoken)
        if len(pretoken) <= LONG:
            if len(self) >= self.most:
                self.clear()
                self.update(self.frequent)
            self[pretoken] = n
        return n

    def count(self, text: str | None) -> int:
        return sum(map(self.__getitem__, pretokens(text))) if text else 0


_workers: dict[str, Lengths] = {}


def frequent_pretokens(docs: DataFrame, text_col: str = "text", table_size: int = 8192) -> list[str]:
    """The frequent pre-tokens of all texts, at most ``table_size``."""
    kinds = "part int, tokens array<string>, counts array<long>"

    def rows(part: int, counts: dict[str, int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([list(counts)], pa.list_(pa.string())), pa.array([list(counts.values())], pa.list_(pa.int64()))], ["part", "tokens", "counts"])

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    counts.update(w for w in pretokens(text) if len(w) <= LONG)
                    if len(counts) > 16 * table_size:
                        counts = Counter(pruned(counts, 4 * table_size))
        if counts:
            yield rows(TaskContext.get().partitionId(), pruned(counts, table_size))

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for tokens, n in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                counts.update(dict(zip(tokens, n, strict=True)))
                counts = Counter(pruned(counts, table_size))
        if counts:
            yield rows(0, counts)

    source = docs.select(F.col(text_col).alias("text"))
    width = max(1, math.isqrt(source.rdd.getNumPartitions()))
    found = source.mapInArrow(summarise, kinds).repartition(width, "part").mapInArrow(merged, kinds).repartition(1).mapInArrow(merged, kinds).collect()
    return [w for r in found for w in r["tokens"]]


def count_tokens(docs: DataFrame, model: str | None = None, text_col: str = "text", table_size: int = 8192) -> DataFrame:
    """``docs`` with n_bytes (UTF-8) and n_tokens."""
    docs = without(docs, "n_bytes", "n_tokens")
    model = model or default_model()
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_pretokens(docs, text_col, table_size))
    at, token = docs.columns.index(text_col), uuid.uuid4().hex

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if token not in _workers:  # a worker keeps the table of one query
            _workers.clear()
            _workers[token] = Lengths(model, frequent.value)
        lengths = _workers[token]
        for batch in batches:
            counts = [lengths.count(t.as_py()) for t in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(counts, pa.int64())], [*batch.schema.names, "n_tokens"])

    counted = docs.mapInArrow(count, T.StructType([*docs.schema.fields, T.StructField("n_tokens", T.LongType())]))
    return counted.withColumn("n_bytes", F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"))
