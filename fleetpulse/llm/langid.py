"""Language identification with a string kernel.

The blended-spectrum kernel counts the character n-grams (n = 1 to 3, hashed into FEATURES) that
two texts share, over the root of the product of their numbers. It is not taken between all
texts: a Nystroem map through LANDMARKS example texts (one for each language at least) gives every text a short vector, on which
one-versus-rest kernel ridge regressions are solved. Scoring is two matrix products per batch.

The model is fitted on a bounded sample, at most PER_LANGUAGE learn rows of each language by
hash of the id, of which only hashed n-gram sets reach the driver.

Defined results: null texts and texts without a letter are `und` with score 0; rows whose lang is
null are not learned from; without any learn row everything is `und`; every row gives a row, also
for null and repeated ids; other columns are ignored. Texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PER_LANGUAGE = 300
LANDMARKS = 128
FEATURES = 8192
RIDGE = 1e-2
UNKNOWN = "und"
_BATCH = 128
_MULTIPLIERS = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))


def ngram_set(text: str, out: np.ndarray) -> None:
    """Marks the hashed 1- to 3-grams of a text in `out`."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    total = np.zeros(len(c), np.uint32)
    for n, by in enumerate(_MULTIPLIERS):
        if len(c) <= n:
            break
        total = total[: len(c) - n] * np.uint32(31) + c[n:] * by
        h = total ^ (total >> np.uint32(15))
        out[(h * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - FEATURES.bit_length() + 1)] = 1


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


@dataclass(frozen=True)
class KernelModel:
    """Landmark n-gram sets and the ridge solution, as two matrices."""

    languages: list[str]
    landmarks: np.ndarray  # FEATURES x landmarks, columns scaled by 1 / root of their size
    weights: np.ndarray  # landmarks x languages

    def scores(self, grams: np.ndarray) -> np.ndarray:
        """Shares of the languages, rows summing to 1, for rows of n-gram sets."""
        kernel = grams @ self.landmarks / np.sqrt(np.maximum(grams.sum(axis=1, keepdims=True), 1))
        raw = np.clip((kernel @ self.weights + 1) / 2, 1e-3, 1)
        return raw / raw.sum(axis=1, keepdims=True)


def fit(grams: np.ndarray, langs: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> KernelModel:
    """Kernel ridge regression on Nystroem features; languages weigh alike.

    Every language has a landmark: with more languages than `landmarks` there are as many as languages.
    """
    languages = sorted(set(langs))
    which = np.array([languages.index(x) for x in langs])
    turn = np.zeros(len(which), int)
    for c in range(len(languages)):
        turn[which == c] = np.arange(np.sum(which == c))
    chosen = np.lexsort((which, turn))[: max(landmarks, len(languages))]
    scaled = grams / np.sqrt(np.maximum(grams.sum(axis=1, keepdims=True), 1))
    base = scaled[chosen].T.astype(np.float32)
    value, vector = np.linalg.eigh((scaled[chosen] @ base).astype(np.float64))
    keep = value > 1e-6 * value[-1]
    root = vector[:, keep] / np.sqrt(value[keep])
    phi = (scaled @ base).astype(np.float64) @ root
    w = (1 / np.bincount(which))[which]
    target = np.where(which[:, None] == np.arange(len(languages)), 1.0, -1.0)
    left = phi.T @ (phi * w[:, None]) + ridge * np.eye(phi.shape[1])
    solved = np.linalg.solve(left, phi.T @ (target * w[:, None]))
    return KernelModel(languages, base, (root @ solved).astype(np.float32))


def _gram_batches(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for whole in batches:
        for at in range(0, whole.num_rows, _BATCH):
            batch = whole.slice(at, _BATCH)
            grams = np.zeros((batch.num_rows, FEATURES), np.float32)
            known = np.zeros(batch.num_rows, bool)
            for i, text in enumerate(batch.column(column).to_pylist()):
                known[i] = has_letter(text)
                if known[i]:
                    ngram_set(text, grams[i])
            yield batch, grams, known


def train(docs: DataFrame, learn: Column, per_language: int = PER_LANGUAGE) -> KernelModel | None:
    """Model of the rows of (doc_id, text, lang) that `learn` marks; None if there are none."""
    text = F.xxhash64("text").alias("mark")
    rows = docs.filter(learn & F.col("lang").isNotNull()).select("doc_id", "lang", text).distinct()
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "mark")
    chosen = rows.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= per_language).drop("nth")
    # at most per_language rows for each language, equal ones once
    given = docs.filter(learn & F.col("lang").isNotNull()).select("doc_id", "lang", "text", text)
    sample = given.join(F.broadcast(chosen), ["doc_id", "lang", "mark"], "left_semi").dropDuplicates(["doc_id", "lang", "mark"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, grams, known in _gram_batches(batches, 2):
            packed = [g.tobytes() for g in np.packbits(grams.astype(bool), axis=1)]
            out = pa.record_batch([batch.column(0), batch.column(1), pa.array(packed)], names=["tie", "lang", "grams"])
            yield out.filter(pa.array(known))

    made = sample.select(F.xxhash64("doc_id", "text").alias("tie"), "lang", "text").mapInArrow(
        run, "tie long, lang string, grams binary"
    )
    rows = sorted(made.toArrow().to_pylist(), key=lambda r: (r["lang"], r["tie"], r["grams"]))
    if not rows:
        return None
    bits = np.frombuffer(b"".join(r["grams"] for r in rows), np.uint8).reshape(len(rows), -1)
    return fit(np.unpackbits(bits, axis=1).astype(np.float32), [r["lang"] for r in rows])


def predicted(
    docs: DataFrame, model: KernelModel | None, keep: list[str], named: tuple[str, str] = ("lang_pred", "score")
) -> DataFrame:
    """The columns `keep` of every row with the predicted language and its share, under the names `named`."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    given = docs.select(*keep) if "text" in keep else docs.select(*keep, F.col("text").alias("__text"))
    at = keep.index("text") if "text" in keep else len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch, grams, known in _gram_batches(batches, at):
            lang, score = [UNKNOWN] * batch.num_rows, np.zeros(batch.num_rows)
            if model is not None:
                shares = model.scores(grams).astype(float)
                best = shares.argmax(axis=1)
                lang = [model.languages[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)]
                score = np.where(known, shares.max(axis=1), 0.0)
            columns = [batch.column(i) for i in range(len(keep))]
            yield pa.record_batch([*columns, pa.array(lang, pa.string()), pa.array(score)], names=[*keep, *named])

    schema = given.select(*keep).schema.add(named[0], "string").add(named[1], "double")
    return given.mapInArrow(run, schema)
