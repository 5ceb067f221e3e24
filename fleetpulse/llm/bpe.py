"""Byte-level BPE encoding by forced boundaries, and decoding.

A pair of bytes that stands inside no vocabulary token can never be merged across, so a text may
be cut between the two bytes. Every fragment is encoded by itself and the ids are concatenated;
fragments repeat, so most come from a table that each task keeps.

A cut must also leave the pre-tokenizer's view unchanged. It looks back at nothing but white
space runs and contractions, so no cut is made after a byte that can end a white space character,
before an apostrophe, or inside a character. Added tokens are split off first.

Defined results: null text is empty, and an empty text has no ids; very long texts without cuts
are one fragment; every row gives a row, ties and repeated rows included.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fragments kept by a task: at most so many, of at most so many bytes
KEPT_FRAGMENTS, KEPT_BYTES = 400_000, 48

# last bytes of white space characters beyond ASCII (U+0085, U+00A0, U+1680, U+2000-200A, U+2028, U+2029, U+202F, U+205F, U+3000)
_SPACE_ENDS = (*range(0x80, 0x8B), 0xA0, 0xA8, 0xA9, 0xAF, 0x9F)


def byte_alphabet() -> dict[str, int]:
    """The printable character of every byte in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    chars = {chr(b): b for b in plain}
    for i, b in enumerate(b for b in range(256) if b not in plain):
        chars[chr(256 + i)] = b
    return chars


class _Table(dict):
    """bytes of a fragment -> its ids as little-endian 32-bit integers."""

    def __init__(self, tokenizer):
        self.encode = tokenizer.encode

    def __missing__(self, fragment: bytes) -> bytes:
        ids = np.array(self.encode(fragment.decode("utf-8"), add_special_tokens=False).ids, "<u4").tobytes()
        if len(fragment) <= KEPT_BYTES:
            if len(self) >= KEPT_FRAGMENTS:
                self.clear()
            self[fragment] = ids
        return ids


class Codec:
    """Encoder and decoder of one tokenizer file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        chars = byte_alphabet()
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        vocab = {i: bytes(chars[c] for c in t) for t, i in spec["model"]["vocab"].items() if t not in self.added}
        self.tokens = vocab | {i: t.encode() for t, i in self.added.items()}
        inside = np.zeros((256, 256), bool)
        for token in vocab.values():
            raw = np.frombuffer(token, np.uint8)
            inside[raw[:-1], raw[1:]] = True
        self.cuts = self._safe(~inside)
        longest_first = sorted(self.added, key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, longest_first))) if self.added else None
        self.table = _Table(tokenizer)

    @staticmethod
    def _safe(cuts: np.ndarray) -> np.ndarray:
        cuts = cuts.copy()
        cuts[[*range(0x09, 0x0E), *range(0x1C, 0x21), *_SPACE_ENDS], :] = False
        cuts[:, 0x27] = False
        cuts[:, 0x80:0xC0] = False
        return cuts.reshape(-1)

    def fragments(self, raw: bytes) -> list[bytes]:
        """`raw` cut at every forced boundary."""
        b = np.frombuffer(raw, np.uint8)
        if len(b) < 2:
            return [raw] if raw else []
        at = (np.flatnonzero(self.cuts[b[:-1].astype(np.uint16) * np.uint16(256) + b[1:]]) + 1).tolist()
        return [raw[i:j] for i, j in zip([0, *at], [*at, len(raw)], strict=True)]

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if self.special is None or not self.special.search(text):
            return b"".join(map(self.table.__getitem__, self.fragments(text.encode("utf-8"))))
        out, at = [], 0
        for m in self.special.finditer(text):
            out += [self.encode_plain(text[at : m.start()]), np.array([self.added[m.group()]], "<u4").tobytes()]
            at = m.end()
        return b"".join([*out, self.encode_plain(text[at:])])

    def encode_plain(self, text: str) -> bytes:
        return b"".join(map(self.table.__getitem__, self.fragments(text.encode("utf-8"))))

    def decode(self, ids: bytes) -> str:
        """The text of the ids; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One codec per Python worker and file."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encoded(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(`key`, ids array<int>) of every row; `path` is a byte-level BPE file that every executor can open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            for part in _slices(batch):
                rows = [c.encode(t or "") for t in part.column(1).to_pylist()]
                yield pa.record_batch([part.column(0), _id_lists(rows)], names=[key, "ids"])

    return docs.select(key, text).mapInArrow(run, f"{_typed(docs, key)}, ids array<int>")


def decoded(ids: DataFrame, path: str, key: str = "doc_id") -> DataFrame:
    """(`key`, text) of every row of (`key`, ids); null ids are none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            texts = [c.decode(np.array(x or [], "<u4").tobytes()) for x in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    return ids.select(key, "ids").mapInArrow(run, f"{_typed(ids, key)}, text string")


def round_trip(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(`key`, n_tokens, ids_sha256, decoded_sha256): digests of the ids and of the text decoded from them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            counts, ids_sha, text_sha = [], [], []
            for t in batch.column(1).to_pylist():
                ids = c.encode(t or "")
                counts.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                text_sha.append(hashlib.sha256(c.decode(ids).encode("utf-8")).hexdigest())
            yield pa.record_batch(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha), pa.array(text_sha)],
                names=[key, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select(key, text).mapInArrow(
        run, f"{_typed(docs, key)}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )


def tokens(docs: DataFrame, path: str, keep: list[str]) -> DataFrame:
    """The columns `keep` of every row with n_tokens, ids and whether the ids decode to the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            for part in _slices(batch):
                texts = [t or "" for t in part.column(len(keep)).to_pylist()]
                rows = [c.encode(t) for t in texts]
                exact = [c.decode(r) == t for r, t in zip(rows, texts, strict=True)]
                made = [pa.array([len(r) // 4 for r in rows], pa.int64()), _id_lists(rows), pa.array(exact, pa.bool_())]
                yield pa.record_batch([*part.columns[: len(keep)], *made], names=[*keep, "n_tokens", "ids", "exact"])

    fields = ", ".join(_typed(docs, k) for k in keep)
    given = docs.select(*keep, F.col("text").alias("__text"))
    return given.mapInArrow(run, f"{fields}, n_tokens long, ids array<int>, exact boolean")


def _typed(df: DataFrame, key: str) -> str:
    return f"`{key}` {df.schema[key].dataType.simpleString()}"


def _slices(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    for i in range(0, batch.num_rows, rows):
        yield batch.slice(i, rows)


def _id_lists(rows: list[bytes]) -> pa.Array:
    ends = np.cumsum([0] + [len(r) // 4 for r in rows])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(rows), "<i4")))
