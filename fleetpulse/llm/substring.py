"""Removal of repeated passages by difference-cover anchors.

A window of `window` consecutive words is repeated if the same words start anywhere else. Only
positions p with p mod 21 in {0, 1, 4, 14, 16} carry an anchor, a hash of the next window - 20
words. The residues are a difference cover: two equal windows, wherever they start, hold an anchor
at the same place inside both. Repeated anchors are extended to both sides:

1. by all 20 words on either side at once: if anchor and context occur twice, all of it is repeated;
2. where that fails (the ends of a repeated passage), window by window. Places of the same anchor
   that step 1 took add their windows without a place, so that a short quote meets them.

Texts are identified by a hash (128 bits tell them apart, 64 are carried), so exact copies are worked
on together; a text that several rows have is repeated as a whole. Groups of equal anchors, contexts or windows are never gathered: the
least and the greatest place of a group, from map-side aggregates, tell whether there are two.
Bitmaps of repeated hashes, sized by their count, keep single anchors out of the later shuffles; those
that pass are left out by the repeated anchors themselves before anything is stored.

Defined results: null and empty texts have no words; texts shorter than the window lose nothing;
every row gives a row, also for repeated or null ids; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Bitmap, Rows, as_bytes, forget, settled, texts_of, told_apart, window_hashes, word_bounds, word_hashes

WINDOW = 35
# fixed values: a perfect difference set modulo 21
PERIOD = 21
COVER = (0, 1, 4, 14, 16)
_IN_COVER = np.isin(np.arange(PERIOD), COVER)
_CONTEXT, _FIRST, _SECOND = 0x5851F42D4C957F2D, 0x14057B7EF767814F, 0x2545F4914F6CDD1D
_PLACE = 0x3504F335


def _anchors(words: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the anchors of one text; a text shorter than the window has none."""
    if len(words) < window:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    hashes = window_hashes(words, window - PERIOD + 1)
    at = np.flatnonzero(_IN_COVER[np.arange(len(hashes)) % PERIOD])
    return at, hashes[at]


def _place(text: int, at: np.ndarray) -> np.ndarray:
    return text ^ (at.astype(np.uint64) * np.uint64(_PLACE))


def _words(raw: np.ndarray) -> np.ndarray:
    return word_hashes(raw, *word_bounds(raw))


def _rows(names: list[str], emit):
    """mapInArrow function over (text hash, text) batches: `emit(rows, text hash, word hashes)` for every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = Rows(names)
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for i, raw in texts_of(batch, 1):
                emit(rows, keys[i], _words(raw))
                if rows.full():
                    yield from rows.take()
        yield from rows.take()

    return run


def _twice(rows: DataFrame, *keys: str) -> DataFrame:
    """Keys that stand at two different places at least."""
    place = F.struct("text", "at")
    both = rows.groupBy(*keys).agg(F.min(place).alias("low"), F.max(place).alias("high"))
    return both.filter(F.col("low") != F.col("high")).select(*keys)


def repeated_spans(docs: DataFrame, key: Column, text: str = "text", window: int = WINDOW) -> DataFrame:
    """(text, spans array<struct<start, end>>): word spans covered by repeated windows, for each text that has some.

    `key` tells texts apart, see `text_key`, and stands for them in the result.
    """
    if window < PERIOD + 1:
        raise ValueError(f"a window has {PERIOD + 1} words at least")
    spark = docs.sparkSession
    reach = PERIOD - 1
    keyed = docs.select(key.alias("key"), F.col(text).alias("text")).filter("text is not null")
    anchor = window - reach

    def all_anchors(rows: Rows, key: np.uint64, words: np.ndarray) -> None:
        rows.add(_anchors(words, window)[1])

    seen = keyed.mapInArrow(_rows(["anchor"], all_anchors), "anchor long")
    again = settled(seen.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1").select("anchor"), "repeated")
    repeated = spark.sparkContext.broadcast(Bitmap.of("anchor", again))

    def repeated_anchors(rows: Rows, key: np.uint64, words: np.ndarray) -> None:
        at, hashes = _anchors(words, window)
        keep = Bitmap.has(repeated.value, hashes)
        at, hashes = at[keep], hashes[keep]
        if not len(at):
            return
        around = window_hashes(words, anchor + 2 * reach, _CONTEXT)
        inside = (at >= reach) & (at - reach < len(around))
        context = np.zeros(len(at), np.uint64)
        context[inside] = around[at[inside] - reach]
        rows.add(hashes, np.full(len(at), key, np.uint64), at, context, inside.astype(np.int64))

    names = ["anchor", "text", "at", "context", "inside"]
    found = keyed.mapInArrow(_rows(names, repeated_anchors), ", ".join(f"{n} long" for n in names))
    # copies of a text give the same rows
    found = settled(found.distinct().join(again, "anchor", "left_semi"), "anchors")
    whole = settled(_twice(found.filter("inside = 1"), "anchor", "context"), "contexts")
    wide = found.filter("inside = 1").join(whole, ["anchor", "context"], "left_semi")
    wide = wide.select("text", (F.col("at") - reach).alias("start"), (F.col("at") + anchor + reach).alias("end"))

    rest = found.join(whole.withColumn("inside", F.lit(1).cast("long")), ["anchor", "context", "inside"], "left_anti")
    rest = rest.join(_twice(found, "anchor"), "anchor", "left_semi").select("anchor", "text", "at")
    rest = settled(rest, "ends")
    place = F.col("text").bitwiseXOR(F.col("at") * _PLACE)
    ends = spark.sparkContext.broadcast(Bitmap.of(place, rest))
    # a window of such a place may stand, under the same anchor, where the context is repeated
    partial = spark.sparkContext.broadcast(Bitmap.of("anchor", rest))
    forget(rest)

    def around(at: np.ndarray, n: int) -> np.ndarray:
        """Which of the `n` windows of a text hold one of the anchors."""
        wanted = np.zeros(n + 1, np.int64)
        np.add.at(wanted, np.maximum(at - reach, 0), 1)
        np.add.at(wanted, np.minimum(at + 1, n), -1)
        return np.cumsum(wanted[:n]) > 0

    def windows(rows: Rows, key: np.uint64, words: np.ndarray) -> None:
        at, hashes = _anchors(words, window)
        keep = Bitmap.has(partial.value, hashes)
        at = at[keep]
        if not len(at):
            return
        n = len(words) - window + 1
        mine = around(at[Bitmap.has(ends.value, _place(key, at))], n)
        at = np.flatnonzero(mine | around(at, n))
        mine = mine[at]
        first, second = (window_hashes(words, window, seed)[at] for seed in (_FIRST, _SECOND))
        # windows that step 1 has removed count as one more place, the same for all of them
        rows.add(first, second, np.where(mine, key, np.uint64(0)), np.where(mine, at, -1))

    names = ["first", "second", "text", "at"]
    single = keyed.mapInArrow(_rows(names, windows), ", ".join(f"{n} long" for n in names)).distinct()
    single = settled(single, "windows")
    narrow = single.filter("at >= 0").join(_twice(single, "first", "second"), ["first", "second"], "left_semi")
    narrow = narrow.select("text", F.col("at").alias("start"), (F.col("at") + window).alias("end"))
    spans = settled(wide.unionByName(narrow).distinct(), "spans")
    forget(again, found, whole, single)
    return spans.groupBy("text").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))


def text_key(docs: DataFrame, text: str = "text") -> Column:
    """A 64-bit hash under which no two different texts of `docs` meet."""
    given = docs.filter(F.col(text).isNotNull())
    return told_apart(given, _short_hash(F.col(text)), F.xxhash64(F.lit(1), F.col(text)))


def _short_hash(text: Column) -> Column:
    return F.xxhash64(text)


def _kept(raw: np.ndarray, spans, everything: bool, window: int) -> tuple[int, int, bytes]:
    """Number of words, number of removed words, kept words joined by a space."""
    starts, ends = word_bounds(raw)
    n = len(starts)
    gone = np.zeros(n + 1, np.int64)
    if everything and n >= window:
        gone[0] = 1
    for s in spans or ():
        gone[s["start"]] += 1
        gone[s["end"]] -= 1
    stay = np.cumsum(gone[:n]) == 0
    data = raw.tobytes()
    return n, n - int(stay.sum()), b" ".join([data[i:j] for i, j in zip(starts[stay].tolist(), ends[stay].tolist(), strict=True)])


def without_repeats(
    docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, digest: bool = False
) -> DataFrame:
    """(`key`, n_words, n_removed, kept): every row without its repeated passages.

    kept is the kept words joined by one space, or with `digest` the SHA-256 of that as kept_sha256.
    """
    told = text_key(docs, text)
    spans = repeated_spans(docs, told, text, window)
    copied = docs.groupBy(told.alias("text")).agg(F.count("*").alias("n")).filter("n > 1")
    spans = spans.join(copied, "text", "full").select("text", "spans", F.col("n").isNotNull().alias("copied"))
    mine = docs.select(F.col(key).alias("id"), F.col(text).alias("body"), told.alias("text"))
    both = mine.join(spans, "text", "left").select("id", "body", "spans", F.coalesce("copied", F.lit(False)).alias("copied"))
    column = "kept_sha256" if digest else "kept"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for body, found, copied in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                n, gone, kept = _kept(as_bytes(body), found, copied, window)
                out.append((n, gone, hashlib.sha256(kept).hexdigest() if digest else kept.decode("utf-8")))
            n, gone, kept = zip(*out, strict=True) if out else ((), (), ())
            yield pa.record_batch(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())],
                names=[key, "n_words", "n_removed", column],
            )

    kind = docs.schema[key].dataType.simpleString()
    return both.mapInArrow(run, f"`{key}` {kind}, n_words long, n_removed long, {column} string")
