"""BPE encoding and decoding by forced-boundary splitting.

A pair of bytes that occurs inside no token of the vocabulary can never be
merged across, so a text may be cut there and its fragments encoded one by one.
The pre-tokeniser must also cut alike on either side, so a cut is kept only
where it provably does: never inside a code point, before an apostrophe, next
to white space beyond ASCII or a control character, between two white space
characters, or after white space that follows white space. Fragments recur, so
each worker keeps the ids of those it has met.

Defined results: a null text counts as empty, with no ids and an empty decoded
text; special strings in a text become their special token, as the library has
it by default; repeated rows are encoded each; texts of any length are encoded
whole, in chunks of rows that hold one very long text at least; an empty table
gives an empty result; input columns named token_ids or decoded_text are
replaced, others stay.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, table, without

CHUNK_BYTES = 2 << 20
LONG = 64
#: Fragments given to the library at once: it returns some KB for each, of which only the ids are kept.
SLICE = 2048
#: White space beyond ASCII in UTF-8 and control characters that some libraries take for white space.
ODD = re.compile(rb"[\x00-\x08\x0e-\x1f\x7f]|\xc2[\x80-\xa0]|\xe1\x9a\x80|\xe1\xa0\x8e|\xe2\x80[\x80-\xaf]|\xe2\x81[\x9f-\xaf]|\xe3\x80\x80|\xef\xbb\xbf")
ASCII_SPACE = np.zeros(256, bool)
ASCII_SPACE[[9, 10, 11, 12, 13, 32]] = True


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_of_character() -> dict[str, int]:
    """Byte-level BPE writes printable Latin-1 bytes as themselves and the others, in order, from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


class ForcedBoundaryBPE:
    """Encodes and decodes whole texts with one vocabulary file."""

    def __init__(self, path: str, most: int = 250_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec.get("normalizer") or spec["pre_tokenizer"].get("type") != "ByteLevel" or spec["pre_tokenizer"].get("add_prefix_space"):
            raise ValueError("a byte-level vocabulary without normaliser and prefix space is needed")
        special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        if any(a["lstrip"] or a["rstrip"] or a["single_word"] for a in spec["added_tokens"]):
            raise ValueError("special tokens that take their surroundings are not supported")
        bytes_of = byte_of_character()
        self.bytes: list[bytes] = [b""] * (max([*spec["model"]["vocab"].values(), *special.values()]) + 1)
        inside = np.zeros(65536, bool)
        for token, i in spec["model"]["vocab"].items():
            raw = bytes(bytes_of[c] for c in token)
            self.bytes[i] = raw
            for a, b in zip(raw, raw[1:], strict=False):
                inside[a * 256 + b] = True
        for token, i in special.items():
            self.bytes[i] = token.encode()
        self.special = {t.encode(): np.array([i], np.int32).tobytes() for t, i in special.items()}
        self.split = re.compile(b"(" + b"|".join(re.escape(t) for t in sorted(self.special, key=len, reverse=True)) + b")") if special else None
        self.inside = inside
        self.kept: dict[bytes, bytes] = {}
        self.most = most

    def cuts(self, buffer: bytes) -> np.ndarray:
        """For each byte whether a fragment may begin there; texts' starts are for the caller to add."""
        b = np.frombuffer(buffer, np.uint8)
        cut = np.zeros(len(b), bool)
        if len(b) < 2:
            return cut
        space = ASCII_SPACE[b]
        odd = np.zeros(len(b), bool)
        for m in ODD.finditer(buffer):
            odd[m.start() : m.end()] = True
        left, right = b[:-1], b[1:]
        ok = ~self.inside[left.astype(np.uint16) * np.uint16(256) + right]
        ok &= (right & 0xC0) != 0x80
        ok &= right != 39
        ok &= ~(odd[:-1] | odd[1:])
        doubled = np.zeros(len(b), bool)
        doubled[1:] = space[1:] & space[:-1]
        doubled[1:] |= space[1:] & odd[:-1]
        ok &= ~doubled[:-1]
        ok &= ~(space[:-1] & space[1:])
        cut[1:] = ok
        return cut

    def encode_batch(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit integers."""
        units, plan = [], []
        for t in texts:
            parts = self.split.split(t) if self.split and any(s in t for s in self.special) else [t]
            plan.append(len(parts))
            units += parts
        plain = [u for u in units if u not in self.special]
        buffer = b"".join(plain)
        cut = self.cuts(buffer)
        starts = np.cumsum([0] + [len(u) for u in plain])
        if len(cut):
            cut[starts[:-1][starts[:-1] < len(buffer)]] = True
        begins = np.flatnonzero(cut)
        ends = np.append(begins[1:], len(buffer)) if len(begins) else begins
        pieces = [buffer[i:j] for i, j in zip(begins.tolist(), ends.tolist(), strict=True)]
        first = np.searchsorted(begins, starts).tolist()
        kept = self.kept
        new = list(set(pieces).difference(kept))
        if len(kept) + len(new) > self.most:
            kept.clear()
            new = list(set(pieces))
        long = [p for p in new if len(p) > LONG]
        for a in range(0, len(new), SLICE):
            part = new[a : a + SLICE]
            for p, e in zip(part, self.library.encode_batch([p.decode() for p in part], add_special_tokens=False), strict=True):
                kept[p] = np.array(e.ids, np.int32).tobytes()
        whole = iter([b"".join([kept[p] for p in pieces[i:j]]) for i, j in zip(first, first[1:], strict=False)])
        for p in long:
            del kept[p]
        at, out = 0, []
        for n in plan:
            out.append(b"".join([self.special[u] if u in self.special else next(whole) for u in units[at : at + n]]))
            at += n
        return out

    def decode(self, ids: bytes) -> bytes:
        """The text of ids as UTF-8, as the library decodes it with special tokens kept."""
        raw = b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, np.int32).tolist()))
        return raw.decode("utf-8", "replace").encode()


_workers: dict[str, ForcedBoundaryBPE] = {}


def worker(path: str) -> ForcedBoundaryBPE:
    if path not in _workers:
        _workers[path] = ForcedBoundaryBPE(path)
    return _workers[path]


def encode_documents(docs: DataFrame, vocabulary: str | None = None, text_col: str = "text", decode: bool = True) -> DataFrame:
    """``docs`` with token_ids and, if asked for, decoded_text made from these ids."""
    made = ["token_ids", "decoded_text"][: 1 + decode]
    docs = without(docs, *made)
    path = vocabulary or default_vocabulary()
    at = docs.columns.index(text_col)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = worker(path)
        for batch in batches:
            raw = batch.column(at).cast(pa.binary())
            for a, z in chunks(pc.fill_null(pc.binary_length(raw), 0).to_pylist(), CHUNK_BYTES):
                ids = bpe.encode_batch([t or b"" for t in raw.slice(a, z - a).to_pylist()])
                offsets = pa.array(np.cumsum([0] + [len(x) // 4 for x in ids]).astype(np.int32))
                values = pa.array(np.frombuffer(b"".join(ids), np.int32))
                columns = [pa.ListArray.from_arrays(offsets, values, type=pa.list_(pa.field("element", pa.int32(), False)))]
                if decode:
                    columns.append(pa.array([bpe.decode(x) for x in ids], pa.binary()).cast(pa.string()))
                piece = batch.slice(a, z - a)
                yield pa.RecordBatch.from_arrays([*piece.columns, *columns], [*piece.schema.names, *made])
            pa.default_memory_pool().release_unused()

    kinds = [T.StructField("token_ids", T.ArrayType(T.IntegerType(), False)), T.StructField("decoded_text", T.StringType())]
    return docs.mapInArrow(encode, T.StructType([*docs.schema.fields, *kinds[: len(made)]]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = encode_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return encoded.select(
        "doc_id", F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("token_ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded_text"), 256).alias("decoded_sha256"),
    )
