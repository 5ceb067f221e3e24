"""Periodic runs: stretches of words that repeat with a period, found in overlapping tiles per scale.

A run of period q and at least 2 q words is an interval of at least q places i where word i equals
word i + q. Periods are taken by octave [step, 2 step): such an interval holds a multiple of `step`,
a boundary. Around a boundary, Z-functions of the words after and before it give, for all periods of
the octave at once, how far the equality goes to both sides. It is followed for `step` places only,
so that a tile of a few steps around its boundaries answers by itself; the next boundary goes on.

A document is cut into overlapping tiles, one set for the octaves up to BASE_OCTAVES and one for
each octave above, whose tiles are as wide as its periods need. Tiles are dealt to tasks alone, so
one long document is the work of many. What they find is shuffled by document and period, and
touching pieces are stitched to whole intervals.

Most documents have no run, which a necessary condition shows before any tile is cut: along a run of
period q every group of words occurs again within q words. Octaves and stretches that miss it hold no run.

Defined results: null and empty texts, and texts without words, have no words, no runs and the empty
collapsed text; repeated rows and null keys are handled row by row; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORDS, settled

MIN_WORDS = 12
BASE_OCTAVES = 11
_GRAM_BITS = 3
_SLICE = 256


def word_codes(words: list[str]) -> np.ndarray:
    """A number for every word, the same for equal words."""
    seen: dict[str, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))


def next_same(codes: np.ndarray) -> np.ndarray:
    """Distance to the next equal value; the array's length where there is none."""
    out = np.full(len(codes), len(codes), np.int64)
    order = np.argsort(codes, kind="stable")
    same = codes[order[1:]] == codes[order[:-1]]
    at = order[:-1][same]
    out[at] = order[1:][same] - at
    return out


def least_overlap(octave: int, min_words: int) -> int:
    """Fewest places at which word i equals word i + q, for a run with a period of the octave."""
    step = 1 << octave
    return min(max(q, min_words - q) for q in range(step, min(2 * step, max(step + 1, min_words))))


def boundaries(codes: np.ndarray, min_words: int = MIN_WORDS) -> list[tuple[int, np.ndarray]]:
    """(octave, places to look from) for all octaves; no run of the octave is without one.

    Along a run all groups of k words but the last k - 1 occur again within a period, so places are
    looked at only in stretches of such groups that are long enough.
    """
    out, n = [], len(codes)
    grams, distance, k = codes, next_same(codes), 1
    octave = 0
    while 2 << octave <= n:
        step = 1 << octave
        if 0 < octave <= _GRAM_BITS and len(grams) > k:
            pairs = grams[:-k] * np.int64(n + 1) + grams[k:]
            grams = np.unique(pairs, return_inverse=True)[1].astype(np.int64)
            distance, k = next_same(grams), 2 * k
        near = np.concatenate([[False], distance < min(2 * step, len(grams)), [False]])
        edges = np.flatnonzero(near[1:] != near[:-1])
        first, last = edges[::2], edges[1::2]
        long = last - first >= least_overlap(octave, min_words) - k + 1
        # boundaries from the first place to the one after the last, both included
        low, high = -(-first[long] // step), (last[long] + k - 1) // step
        if len(low):
            at = np.unique(np.concatenate([np.arange(a, b + 1) for a, b in zip(low, high, strict=True)])) * step
            at = at[at + step <= n]
            if len(at):
                out.append((octave, at))
        octave += 1
    return out


def tiles(codes: np.ndarray, min_words: int = MIN_WORDS, base_octaves: int = BASE_OCTAVES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(scale, first word, words, octaves, boundaries): overlapping tiles that can be solved by themselves.

    Tiles of a scale have bodies of four of its widest steps, one step before and three after them.
    """
    by_scale: dict[int, list[tuple[int, np.ndarray]]] = {}
    for octave, at in boundaries(codes, min_words):
        by_scale.setdefault(max(octave, base_octaves - 1), []).append((octave, at))
    for scale, tests in by_scale.items():
        step = 1 << scale
        octave = np.concatenate([np.full(len(at), o) for o, at in tests])
        at = np.concatenate([at for _, at in tests])
        body = at // (4 * step)
        order = np.argsort(body, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(body[order])) + 1):
            start = int(body[part[0]]) * 4 * step
            first = max(0, start - step)
            yield scale, first, codes[first : start + 7 * step], octave[part], at[part]


def z_function(s: list[int]) -> list[int]:
    """At every place, the number of values there that equal those from the beginning."""
    z = [0] * len(s)
    left = right = 0
    for i in range(1, len(s)):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < len(s) and s[k] == s[i + k]:
            k += 1
        if i + k > right:
            left, right = i, i + k
        z[i] = k
    return z


def around(words: list[int], b: int, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(periods, places before, places after) boundary `b` at which words a period apart are equal, up to `step`."""
    end = min(b + 2 * step - 1, len(words))
    periods = np.arange(step, end - b + 1)
    ahead = z_function(words[b : b + 3 * step])
    forward = np.array([*ahead, 0], np.int64)[periods]
    before = words[max(0, b - step) : b][::-1]
    behind = z_function([*before, -1, *words[max(0, b - step) : end][::-1]])[len(before) + 1 :]
    backward = np.array(behind, np.int64)[end - b - periods]
    return periods, np.minimum(backward, step), np.minimum(forward, step)


def tile_pieces(
    first: int, words: np.ndarray, octaves: np.ndarray, at: np.ndarray, min_words: int = MIN_WORDS
) -> Iterator[tuple[int, int, int]]:
    """(period, low, high) of a tile: words low to high - 1 equal those a period later.

    Left out are intervals that end on both sides and are too short for a run.
    """
    listed = words.tolist()
    found: dict[int, list[list[int]]] = {}
    for octave, b in sorted(zip(octaves.tolist(), at.tolist(), strict=True)):
        step = 1 << octave
        periods, back, ahead = around(listed, b - first, step)
        long = back + ahead >= np.maximum(periods, min_words - periods)
        open_ended = (back == step) | (ahead == step)
        for i in np.flatnonzero(long | open_ended).tolist():
            low, high = b - int(back[i]), b + int(ahead[i])
            pieces = found.setdefault(int(periods[i]), [])
            if pieces and low <= pieces[-1][1]:
                pieces[-1][1] = max(high, pieces[-1][1])
            else:
                pieces.append([low, high])
    for period, pieces in found.items():
        for low, high in pieces:
            yield period, low, high


def _screened(docs: DataFrame, key: str, text: str, min_words: int, digest: bool) -> DataFrame:
    """(row, key, n_words, kept, text, tiles): `kept` is the collapsed text of rows without tiles, `text` that of the others."""
    kind = docs.schema[key].dataType.simpleString()
    docs = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), F.col(text).alias("text"))
    tile = pa.struct([("scale", pa.int32()), ("first", pa.int64()), ("words", pa.binary()), ("octaves", pa.binary()), ("at", pa.binary())])

    base_octaves = BASE_OCTAVES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, _SLICE):
                batch = whole.slice(at, _SLICE)
                n, kept, left, cut = [], [], [], []
                for t in batch.column(2).to_pylist():
                    words = WORDS.findall(t or "")
                    pieces = [
                        {"scale": s, "first": f, "words": w.astype("<i4").tobytes(), "octaves": o.astype("<i4").tobytes(), "at": b.astype("<i8").tobytes()}
                        for s, f, w, o, b in tiles(word_codes(words), min_words, base_octaves)
                    ]
                    n.append(len(words))
                    kept.append(None if pieces else _shown(words, digest))
                    left.append(t if pieces else None)
                    cut.append(pieces)
                yield pa.record_batch(
                    [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(kept, pa.string()), pa.array(left, pa.string()), pa.array(cut, pa.list_(tile))],
                    names=["row", "key", "n_words", "kept", "text", "tiles"],
                )

    return docs.mapInArrow(
        run,
        f"row long, key {kind}, n_words long, kept string, text string, "
        "tiles array<struct<scale: int, first: long, words: binary, octaves: binary, at: binary>>",
    )


def _shown(words: list[str], digest: bool) -> str:
    text = " ".join(words)
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest() if digest else text


def _pieces(rows: DataFrame, min_words: int) -> DataFrame:
    """(row, period, low, high) of all tiles, each solved by itself."""
    dealt = rows.select("row", F.explode("tiles").alias("tile")).select("row", "tile.*").repartition("row", "scale", "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in range(batch.num_rows):
                row, _, first, words, octaves, at = (batch.column(i)[r].as_py() for i in range(6))
                tests = np.frombuffer(octaves, "<i4"), np.frombuffer(at, "<i8")
                out += [(row, *p) for p in tile_pieces(first, np.frombuffer(words, "<i4"), *tests, min_words)]
            yield pa.record_batch([pa.array([o[i] for o in out], pa.int64()) for i in range(4)], names=["row", "period", "low", "high"])

    return dealt.mapInArrow(run, "row long, period long, low long, high long")


def _stitched(pieces: DataFrame, min_words: int) -> DataFrame:
    """(row, start, length, period) of whole runs, each with its smallest period.

    A document's pieces of one period are at most two for every tile. Where several periods give the
    same words, the others are multiples of the smallest.
    """
    along = Window.partitionBy("row", "period").orderBy("low", "high")
    reached = F.max("high").over(along.rowsBetween(Window.unboundedPreceding, -1))
    opened = pieces.withColumn("opens", (F.col("low") > F.coalesce(reached, F.lit(-1))).cast("int"))
    whole = (
        opened.withColumn("island", F.sum("opens").over(along))
        .groupBy("row", "period", "island")
        .agg(F.min("low").alias("start"), (F.max("high") + F.first("period")).alias("end"))
        .filter(F.col("end") - F.col("start") >= F.greatest(F.lit(min_words), 2 * F.col("period")))
    )
    least = whole.groupBy("row", "start", "end").agg(F.min("period").alias("period"))
    return least.select("row", "start", (F.col("end") - F.col("start")).alias("length"), "period")


def collapsed(
    docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, digest: bool = False
) -> DataFrame:
    """(`key`, n_words, runs, collapsed) of every row.

    `runs` are (start, period, length) by start and period; `collapsed` is the text without the words
    that a run has after its first period, words joined by one space, or its sha256 with `digest`.
    """
    rows = settled(_screened(docs, key, text, min_words, digest), "screened")
    runs = _stitched(_pieces(rows, min_words), min_words)
    runs = runs.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "period", "length"))).alias("runs"))
    empty = F.array().cast(runs.schema["runs"].dataType)
    kind = docs.schema[key].dataType.simpleString()
    run_type = "array<struct<start: bigint, period: bigint, length: bigint>>"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for t, found in zip(batch.column(3).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words = WORDS.findall(t)
                change = np.zeros(len(words) + 1, np.int64)
                for r in found:
                    change[r["start"] + r["period"]] += 1
                    change[r["start"] + r["length"]] -= 1
                stays = np.cumsum(change[:-1]) == 0
                kept.append(_shown([w for w, s in zip(words, stays.tolist(), strict=True) if s], digest))
            yield pa.record_batch([*batch.columns[:3], pa.array(kept, pa.string())], names=["key", "n_words", "runs", "collapsed"])

    some = rows.filter("text is not null").join(runs, "row", "left")
    some = some.select("key", "n_words", F.coalesce("runs", empty).alias("runs"), "text")
    some = some.mapInArrow(cut, f"key {kind}, n_words long, runs {run_type}, collapsed string")
    free = rows.filter("text is null").select("key", "n_words", empty.alias("runs"), F.col("kept").alias("collapsed"))
    return free.unionByName(some).withColumnRenamed("key", key)
