"""Language identification by multilingual mixture inference.

A model holds, for every language, the smoothed probabilities of hashed
character trigrams, counted over all labelled documents that may be learned
from. A text is taken for a mixture of languages: expectation-maximisation
estimates the proportions from its trigrams' likelihoods. The set of languages
starts with the one likeliest alone and grows while the log likelihood gains
more than a penalty. The prediction is the set's largest share. How far the set
explains the text at all is its fit: the share of trigrams that it takes when it
is mixed with a source of no language, which gives every bucket alike.

Defined results: a null text or one without a letter is ``und`` with score 0
and fit 0, and so is every text where nothing was learned. A document whose id is null is
never learned from and counts as held out. Ties go to the language that sorts
first. Repeated rows count, and are predicted, each; texts of any length are read
whole, in chunks of rows that hold one very long text at least; an empty table
gives an empty result. Input columns named lang_pred, score, lang_mix or lang_fit
are replaced, others stay. What is gathered and broadcast is BUCKETS numbers a
language: its bound is the number of distinct lang values times that.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, table, without

BUCKETS = 1 << 16
UNKNOWN = "und"
CHUNK_CHARS = 1 << 20
_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """For each code point its lower-case letter, or a space for what is no letter."""
    if not _letters:
        table_of = np.full(0x110000, 32, np.uint32)
        for c in range(0x110000):
            if not 0xD800 <= c < 0xE000 and (ch := chr(c)).isalpha():
                low = ch.lower()
                table_of[c] = ord(low) if len(low) == 1 else c
        _letters.append(table_of)
    return _letters[0]


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text index, bucket) of every trigram; words stand between single spaces."""
    points = np.frombuffer("\n".join(["", *texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(texts) + 1), [len(t) + 1 for t in texts] + [1]) if texts else np.zeros(0, int)
    c = letters()[points]
    keep = np.ones(len(c), bool)
    keep[1:] = ~((c[1:] == 32) & (c[:-1] == 32))
    starts = np.cumsum([0] + [len(t) + 1 for t in texts])
    keep[starts] = True  # each text begins and ends with a space of its own
    c, owner = c[keep], owner[keep]
    a, b, d = c[:-2], c[1:-1], c[2:]
    hashed = (a * np.uint32(0x9E3779B1) ^ b) * np.uint32(0x85EBCA77) ^ d
    hashed = (hashed * np.uint32(0xC2B2AE3D)) >> np.uint32(16)
    mine = (owner[:-2] == owner[1:-1]) & (b != 32)
    return owner[:-2][mine], hashed[mine]


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """The languages, sorted, and the log probabilities (bucket, language) from all rows of ``labelled``.

    What is gathered is bounded by BUCKETS rows a language.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            by: dict[str, list[str]] = {}
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by.setdefault(lang, []).append(text)
            for lang, texts in by.items():
                for a, z in chunks([len(t) for t in texts], CHUNK_CHARS):
                    found = np.bincount(trigrams(texts[a:z])[1], minlength=BUCKETS)
                    totals[lang] = totals[lang] + found if lang in totals else found
        for lang, found in totals.items():
            some = np.flatnonzero(found)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some, pa.int32()), pa.array(found[some], pa.int64())], ["lang", "bucket", "n"])

    rows = labelled.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).dropna()
    found = rows.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    names = sorted(set(found["lang"].to_pylist()))
    counts = np.zeros((BUCKETS, len(names)))
    if names:
        place = {n: i for i, n in enumerate(names)}
        counts[found["bucket"].to_numpy(), [place[x] for x in found["lang"].to_pylist()]] = found["n"].to_numpy()
    # a bucket never met in a language still has a little mass: add 1/2 and share by what all languages have
    return names, np.log((counts + 0.5) / (counts.sum(0) + 0.5 * BUCKETS))


def mixture(owner: np.ndarray, weight: np.ndarray, probs: np.ndarray, shares: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """EM from ``shares`` (text, language); zero shares stay zero. Returns the shares and each text's log likelihood."""
    starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    total = np.add.reduceat(weight, starts)[:, None]
    which = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(owner)]))
    for _ in range(rounds):
        joint = probs * shares[which]
        joint *= (weight / joint.sum(1))[:, None]
        shares = np.add.reduceat(joint, starts) / total
    likelihood = np.add.reduceat(weight * np.log((probs * shares[which]).sum(1)), starts)
    return shares, likelihood


def explained(owner: np.ndarray, weight: np.ndarray, likely: np.ndarray, uniform: np.ndarray, rounds: int = 10) -> np.ndarray:
    """EM for each text's share of trigrams that ``likely`` explains and ``uniform`` does not; one more on each side keeps very short texts in doubt."""
    starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    lengths = np.diff(np.r_[starts, len(owner)])
    total = np.add.reduceat(weight, starts)
    share = np.full(len(starts), 0.5)
    for _ in range(rounds):
        each = np.repeat(share, lengths)
        mine = each * likely
        share = (np.add.reduceat(weight * mine / (mine + (1 - each) * uniform), starts) + 1) / (total + 2)
    return share


def identify(texts: list[str], names: list[str], logs: np.ndarray, penalty: float = 3.0, rounds: int = 6) -> list[tuple[str, float, dict[str, float], float]]:
    """(language, score, proportions of the selected set, fit) of each text."""
    out: list[tuple[str, float, dict[str, float], float]] = [(UNKNOWN, 0.0, {}, 0.0)] * len(texts)
    if not names:
        return out
    owner, bucket = trigrams(texts)
    if not len(owner):
        return out
    key, weight = np.unique(owner.astype(np.int64) * BUCKETS + bucket, return_counts=True)
    owner, logp, weight = key // BUCKETS, logs[key % BUCKETS], weight.astype(float)
    starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    docs = owner[starts]
    # each trigram's probabilities may be scaled alike: nothing underflows and no decision changes
    top = logp.max(1)
    probs = np.exp(logp - top[:, None])
    alone = np.add.reduceat(weight[:, None] * logp, starts)
    shift = np.add.reduceat(weight * top, starts)
    n = np.add.reduceat(weight, starts)
    best = alone.argmax(1)
    likelihood = alone.max(1)
    shares = np.zeros_like(alone)
    shares[np.arange(len(docs)), best] = 1
    if len(names) > 1:
        full, _ = mixture(owner, weight, probs, np.full_like(alone, 1 / len(names)), rounds)
        active = np.arange(len(docs))
        for _ in range(len(names) - 1):
            outside = np.where(shares[active] > 0, -1.0, full[active])
            new = outside.argmax(1)
            trial = np.where(shares[active] > 0, full[active], 0.0)
            trial[np.arange(len(active)), new] = np.maximum(outside.max(1), 1e-3)
            trial /= trial.sum(1, keepdims=True)
            chosen = np.zeros(len(docs), bool)
            chosen[active] = True
            mine = np.repeat(chosen, np.diff(np.r_[starts, len(owner)]))
            got, gained = mixture(owner[mine], weight[mine], probs[mine], trial, rounds)
            better = gained + shift[active] - likelihood[active] > penalty * np.log(n[active] + 1)
            shares[active[better]] = got[better]
            likelihood[active[better]] = (gained + shift[active])[better]
            active = active[better]
            if not len(active):
                break
    # how clearly the best language alone beats the next, per square root of evidence
    order = np.sort(alone, 1)
    margin = (order[:, -1] - order[:, -2]) / np.sqrt(n) if len(names) > 1 else np.full(len(docs), np.inf)
    sure = 1 / (1 + np.exp(-np.minimum(margin, 50)))
    which = np.repeat(np.arange(len(docs)), np.diff(np.r_[starts, len(owner)]))
    # what a language gives an unmet bucket is smoothing, which explains nothing
    floor = logs.min(0)
    met = np.maximum(probs - np.exp(floor - top[:, None]), 0) / np.maximum(1 - BUCKETS * np.exp(floor), 1e-9)
    fit = explained(owner, weight, (met * shares[which]).sum(1), np.exp(-np.log(BUCKETS) - top))
    for k, d in enumerate(docs):
        win = int(shares[k].argmax())
        out[d] = (names[win], float(min(1.0, shares[k][win] * sure[k])), {names[i]: float(shares[k][i]) for i in np.flatnonzero(shares[k] > 0)}, float(fit[k]))
    return out


_probs: dict[str, tuple] = {}


def identify_language(docs: DataFrame, model: tuple[list[str], np.ndarray], text_col: str = "text", **options) -> DataFrame:
    """``docs`` with lang_pred, score, lang_mix, the map of the selected languages' proportions, and lang_fit."""
    made = ["lang_pred", "score", "lang_mix", "lang_fit"]
    docs = without(docs, *made)
    shared = docs.sparkSession.sparkContext.broadcast((model[0], model[1].astype(np.float32)))
    at = docs.columns.index(text_col)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, logs = shared.value
        for batch in batches:
            texts = [t or "" for t in batch.column(at).to_pylist()]
            for a, z in chunks([len(t) for t in texts], CHUNK_CHARS):
                found = identify(texts[a:z], names, logs, **options)
                columns = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array([list(f[2].items()) for f in found], pa.map_(pa.string(), pa.field("value", pa.float64(), False))), pa.array([f[3] for f in found], pa.float64())]
                piece = batch.slice(a, z - a)
                yield pa.RecordBatch.from_arrays([*piece.columns, *columns], [*piece.schema.names, *made])

    kinds = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("lang_mix", T.MapType(T.StringType(), T.DoubleType(), False)), T.StructField("lang_fit", T.DoubleType())]
    return docs.mapInArrow(predict, T.StructType([*docs.schema.fields, *kinds]))


def held_out():
    """Whether crc32 of the doc_id as text leaves the remainder 1 of 3; a null id does."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(True))


def fit_documents(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    return train(docs.filter(~held_out()))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_documents(docs.select("doc_id", "text", "lang"))
    out = identify_language(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
