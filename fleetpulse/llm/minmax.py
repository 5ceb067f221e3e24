"""Near-duplicate groups by min-max hashing: banded signatures of word shingles, links confirmed on whole sets.

A document's set holds its distinct three-word shingles. For each of PERMUTATIONS orders of all
shingles a signature keeps the first and the last shingle of the set, two values for one evaluation.
Two sets of resemblance J agree in each value with probability J, and the two values of an order
disagree together more seldom than apart, so the share of equal values is an unbiased estimate of
smaller variance than as many single minima give. Values are banded, BAND_ROWS of different orders to a
band and minima apart from maxima; sets that share a band are compared. With 36 bands of 5 values
a pair at the threshold 0.85 is missed with probability (1 - 0.85^5)^36, less than 1 in 10^9.

Equal sets, told by 128 bits, are one point. Only groups are wanted, so no bucket is expanded
into all its pairs: points are compared with the hub of one of their buckets, then with the hubs of
their other buckets from which they are still apart, then points of one bucket that belong to
different components with one another, in blocks. There the shingles that a point has in common with any
other component, and the slots that both sets fill, bound what two points can share, and the signatures'
estimate leaves out pairs that are no links (below 0.85 by eight standard errors). A text moves once for
each pair that is confirmed.

Defined results: null and empty texts, and texts without words, have an empty set, link with nothing
and are their own component; fewer than three words are one shingle; repeated rows link unless empty;
null ids take part, and a component's id is its least non-null id; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import distinct, forget, mixed, settled, texts_of, window_hashes, word_bounds, word_hashes
from .graph import components

SHINGLE_WORDS = 3
PERCENT = 85
BAND_ROWS = 5
PERMUTATIONS = 90
BANDS = 2 * PERMUTATIONS // BAND_ROWS
PAGE_ROWS = 2048
HUB_ROWS = 512
_STRIP = 256
_SLICE = 512

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
# odd multipliers, each an order of all 64-bit hashes
_ORDERS = mixed(np.arange(1, PERMUTATIONS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_MARKS = mixed(np.arange(1, BAND_ROWS + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) | np.uint64(1)


def shingle_set(raw: np.ndarray) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a UTF-8 text, A-Z in lower case."""
    raw = np.take(_LOWER, raw)
    words = word_hashes(raw, *word_bounds(raw))
    return distinct(window_hashes(words, min(SHINGLE_WORDS, len(words)))) if len(words) else words


def set_marks(shingles: np.ndarray) -> tuple[int, int]:
    """Two independent 64-bit hashes of a whole set."""
    n = np.uint64(len(shingles))
    first = mixed(np.sum(mixed(shingles), keepdims=True) + n)
    second = mixed(np.sum(mixed(shingles ^ np.uint64(0x5851F42D4C957F2D)), keepdims=True) ^ n)
    return int(first.view(np.int64)[0]), int(second.view(np.int64)[0])


def signature(shingles: np.ndarray) -> np.ndarray:
    """The least and then the greatest value of the set in each order, upper halves of 64 bits."""
    low = np.full(PERMUTATIONS, np.iinfo(np.uint64).max, np.uint64)
    high = np.zeros(PERMUTATIONS, np.uint64)
    for at in range(0, len(shingles), _STRIP):
        placed = shingles[at : at + _STRIP, None] * _ORDERS
        np.minimum(low, placed.min(axis=0), out=low)
        np.maximum(high, placed.max(axis=0), out=high)
    return (np.concatenate([low, high]) >> np.uint64(32)).astype(np.uint32)


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of each signature (row)."""
    bands = signatures.reshape(len(signatures), BANDS, BAND_ROWS).astype(np.uint64)
    keys = mixed(bands + _MARKS) * _MARKS
    return mixed(keys.sum(axis=2) + np.arange(BANDS, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal values of signatures."""
    return (a == b).mean(axis=-1)


def least_estimate() -> float:
    """Eight standard errors below the threshold."""
    p = PERCENT / 100
    return p - 8 * (p * (1 - p) / (2 * PERMUTATIONS)) ** 0.5


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    if 100 * min(len(a), len(b)) < PERCENT * max(len(a), len(b)):
        return False
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * shared >= PERCENT * (len(a) + len(b) - shared)


def slots(shingles: np.ndarray) -> np.ndarray:
    """Bits of the slots that a set fills, 16 to 32 slots for each shingle; half as many by `folded`."""
    count = 1 << (max(4, len(shingles)) * 16 - 1).bit_length()
    filled = np.zeros(count, np.uint8)
    filled[(mixed(shingles) & np.uint64(count - 1)).astype(np.int64)] = 1
    return np.packbits(filled).view(np.uint64)


def folded(filled: np.ndarray, words: int) -> np.ndarray:
    """Slots of a set or of many (rows) brought to so many 64-bit words."""
    while filled.shape[-1] > words:
        half = filled.shape[-1] // 2
        filled = filled[..., :half] | filled[..., half:]
    return filled


def most_shared(a: np.ndarray, n_a: int, b: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Most shingles that a set shares with each of many, by their slots: slots filled by both, and the lesser of
    the shingles that stand in a slot beside another."""
    words = min(a.shape[-1], b.shape[-1])
    a, b = folded(a, words), folded(b, words)
    beside = np.minimum(n_a - int(np.bitwise_count(a).sum()), n_b - np.bitwise_count(b).sum(axis=1, dtype=np.int64))
    return np.bitwise_count(a & b).sum(axis=1, dtype=np.int64) + beside


def _profiles(docs: DataFrame) -> DataFrame:
    """(row, id, n, mark1, mark2, signature, text) of every row; signature and text are null for empty sets."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, _SLICE):
                batch = whole.slice(at, _SLICE)
                n, marks = np.zeros(batch.num_rows, np.int64), np.zeros((batch.num_rows, 2), np.int64)
                signed, there = [None] * batch.num_rows, [None] * batch.num_rows
                for i, raw in texts_of(batch, 2):
                    shingles = shingle_set(raw)
                    if len(shingles):
                        n[i], marks[i] = len(shingles), set_marks(shingles)
                        signed[i], there[i] = signature(shingles).tobytes(), i
                text = batch.column(2).take(pa.array(there, pa.int64()))
                yield pa.record_batch(
                    [batch.column(0), batch.column(1), *(pa.array(x) for x in (n, marks[:, 0], marks[:, 1])), pa.array(signed, pa.binary()), text],
                    names=["row", "id", "n", "mark1", "mark2", "signature", "text"],
                )

    return docs.select(F.monotonically_increasing_id().alias("row"), "id", "text").mapInArrow(
        run, f"row long, id {kind}, n long, mark1 long, mark2 long, signature binary, text string"
    )


def _signatures(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, 2 * PERMUTATIONS)


def _buckets(points: DataFrame) -> DataFrame:
    """(key, point) of all buckets with two points at least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, _SLICE):
                batch = whole.slice(at, _SLICE)
                keys = band_keys(_signatures(batch.column(1)))
                point = batch.column(0).to_numpy().repeat(BANDS)
                yield pa.record_batch([pa.array(keys.ravel().view(np.int64)), pa.array(point)], names=["key", "point"])

    keys = points.select("point", "signature").mapInArrow(run, "key long, point long")
    shared = keys.groupBy("key").agg(F.min("point").alias("low"), F.max("point").alias("high")).filter("low < high")
    return keys.join(shared.select("key"), "key", "left_semi")


def _stars(buckets: DataFrame) -> DataFrame:
    """(point, hub, met): every point with the hubs of its buckets, and how many buckets they share so.

    The hub of a bucket is its point that meets the most others in all its buckets: what many copies
    were made from meets more of them than any of the copies.
    """
    sizes = buckets.groupBy("key").agg(F.count("*").alias("size"))
    degree = buckets.join(sizes, "key").groupBy("point").agg(F.sum("size").alias("degree"))
    hubs = buckets.join(degree, "point").groupBy("key").agg(F.max(F.struct("degree", F.negative("point").alias("back"))).alias("of"))
    hubs = hubs.select("key", (-F.col("of.back")).alias("hub"))
    return buckets.join(hubs, "key").filter("point != hub").groupBy("point", "hub").agg(F.count("*").alias("met"))


def _confirmed(pairs: DataFrame, points: DataFrame) -> DataFrame:
    """(a, b) of the pairs whose whole sets are similar. A text moves once for each pair as `a`; the text
    of `b` once for every HUB_ROWS pairs it stands in, which are dealt apart."""
    hubs = pairs.groupBy("b").agg(F.ceil(F.count("*") / HUB_ROWS).cast("int").alias("parts"))
    texts = points.select("point", "text")
    part = F.pmod(F.xxhash64("a"), F.col("parts")).cast("int")
    dealt = pairs.join(hubs, "b").select("a", "b", part.alias("part")).join(texts, F.col("a") == F.col("point"))
    other = hubs.join(texts, F.col("b") == F.col("point")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    columns = ["b", "part", "a", "text"]
    # the text of `b` comes before those of its pairs
    dealt = other.withColumn("a", F.lit(None).cast("long")).select(columns).unionByName(dealt.select(columns))
    dealt = dealt.repartition("b", "part").sortWithinPartitions("b", "part", F.col("a").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub = None
        for batch in batches:
            b, a = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            out = []
            for i, raw in texts_of(batch, 3):
                if a[i] is None:
                    hub = shingle_set(raw)
                elif similar(shingle_set(raw), hub):
                    out.append((a[i], b[i]))
            yield pa.record_batch([pa.array([x[c] for x in out], pa.int64()) for c in (0, 1)], names=["a", "b"])

    return dealt.mapInArrow(run, "a long, b long")


def _apart(pairs: DataFrame, label: DataFrame) -> DataFrame:
    """The pairs (a, b) that `label` does not join."""
    for c in ("a", "b"):
        mine = label.select(F.col("node").alias(c), F.col("label").alias(f"label_{c}"))
        pairs = pairs.join(mine, c, "left").withColumn(f"label_{c}", F.coalesce(f"label_{c}", c))
    return pairs.filter("label_a != label_b").select("a", "b")


def _able(mixed: DataFrame, points: DataFrame, held: DataFrame) -> DataFrame:
    """(point, n, shared, signature, slots) of those points of (key, point, label) that a link to another label can have.

    `shared` counts the shingles of a point that also stand under another label; two sets of different
    labels have no more in common than the lesser of their counts.
    """
    spots = mixed.select("point", "label").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            point, label = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for i, raw in texts_of(batch, 2):
                shingles = shingle_set(raw).view(np.int64)
                columns = (shingles, np.full(len(shingles), point[i]), np.full(len(shingles), label[i]))
                yield pa.record_batch([pa.array(c) for c in columns], names=["shingle", "point", "label"])

    parts = held.join(spots, "point").select("point", "label", "text").mapInArrow(run, "shingle long, point long, label long")
    spread = parts.groupBy("shingle").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high")
    shared = parts.join(spread.select("shingle"), "shingle", "left_semi").groupBy("point").agg(F.count("*").alias("shared"))
    able = shared.join(points.select("point", "n", "signature"), "point").filter(100 * F.col("shared") >= PERCENT * F.col("n"))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = [None] * batch.num_rows
            for i, raw in texts_of(batch, 4):
                marks[i] = slots(shingle_set(raw)).tobytes()
            yield pa.record_batch([*batch.columns[:4], pa.array(marks, pa.binary())], names=[*batch.schema.names[:4], "slots"])

    able = able.join(held, "point").select("point", "n", "shared", "signature", "text")
    return able.mapInArrow(mark, "point long, n long, shared long, signature binary, slots binary")


def _bucket_pairs(buckets: DataFrame, points: DataFrame, held: DataFrame, label: DataFrame) -> DataFrame:
    """(a, b) of points of one bucket and different components that may be links: by the shingles they can
    have in common, and by the estimate of their signatures.

    In each bucket the component with the most points is the base; all other points, in pages, meet
    all points of the bucket, in pages too. A pair is given in the first band it shares.
    """
    known = buckets.join(label, F.col("point") == F.col("node"), "left").select("key", "point", F.coalesce("label", "point").alias("label"))

    def several(df: DataFrame) -> DataFrame:
        # in a bucket of two both met already
        of = df.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("all_points"))
        return df.join(of.filter("low < high and all_points > 2").select("key", "all_points"), "key")

    mixed = settled(several(known).drop("all_points"), "mixed")
    able = settled(_able(mixed, points, held), "able")
    known = several(mixed.join(able.select("point", "n", "shared"), "point"))
    # a partner has as many shingles as the least set of the bucket at least
    least = known.groupBy("key").agg(F.min("n").alias("least"))
    known = known.join(least, "key").filter(100 * F.col("shared") >= PERCENT * (F.col("n") + F.greatest("least", "shared") - F.col("shared")))
    known = settled(known.select("key", "point", "label"), "known")
    counts = known.groupBy("key", "label").agg(F.count("*").alias("n"))
    of = counts.groupBy("key").agg(F.max(F.struct("n", "label")).alias("base"), F.sum("n").alias("all_points"), F.count("*").alias("labels"))
    of = of.filter("labels > 1").select(
        "key",
        F.col("base.label").alias("base"),
        F.ceil(F.col("all_points") / PAGE_ROWS).cast("int").alias("pages"),
        F.ceil((F.col("all_points") - F.col("base.n")) / PAGE_ROWS).cast("int").alias("stray_pages"),
    )
    known = known.join(of, "key").withColumn("mark", F.xxhash64("point"))
    all_pages = F.explode(F.sequence(F.lit(0), F.col("pages") - 1))
    stray_pages = F.explode(F.sequence(F.lit(0), F.col("stray_pages") - 1))
    strays = known.filter("label != base").select(
        "key", F.expr("cast(pmod(mark, stray_pages) as int)").alias("i"), all_pages.alias("j"), F.lit(True).alias("stray"), "point", "label"
    )
    whole = known.select(
        "key", stray_pages.alias("i"), F.expr("cast(pmod(mark, pages) as int)").alias("j"), F.lit(False).alias("stray"), "point", "label"
    )
    dealt = strays.unionByName(whole).join(able, "point")
    dealt = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    floor = least_estimate()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, ("key", "i", "j")):
            stray, point, label, n, shared = (t.column(c).to_numpy() for c in ("stray", "point", "label", "n", "shared"))
            signed, rest = _signatures(t.column("signature")), np.flatnonzero(~stray)
            keys, bucket = band_keys(signed), t.column("key")[0].as_py()
            filled = [np.frombuffer(x, np.uint64) for x in t.column("slots").to_pylist()]
            for i in np.flatnonzero(stray):
                most = np.minimum(shared[rest], shared[i])
                at = rest[(label[rest] != label[i]) & (100 * most >= PERCENT * (n[rest] + n[i] - most))]
                at = at[estimate(signed[at], signed[i]) >= floor]
                for words in {len(filled[j]) for j in at}:
                    part = np.array([j for j in at if len(filled[j]) == words])
                    most = most_shared(filled[i], n[i], np.stack([filled[j] for j in part]), n[part])
                    at = np.setdiff1d(at, part[100 * most < PERCENT * (n[part] + n[i] - most)], assume_unique=True)
                same = keys[at] == keys[i]
                at = at[keys[i].view(np.int64)[np.argmax(same, axis=1)] == bucket]
                if len(at):
                    yield pa.record_batch(
                        [pa.array(np.maximum(point[at], point[i])), pa.array(np.minimum(point[at], point[i]))], names=["a", "b"]
                    )

    return dealt.mapInArrow(run, "a long, b long").distinct()


def _groups(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...]) -> Iterator[pa.Table]:
    """Rows with equal `columns` of a sorted partition, as one table each."""
    left = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = t if left is None else pa.concat_tables([left, t])
        keys = np.stack([t.column(c).to_numpy() for c in columns])
        cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist()]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield t.slice(a, b - a)
        left = t.slice(cuts[-1])
    if left is not None and left.num_rows:
        yield left


def linked(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(`key`, n_shingles, component_id) of every row; component_id is the least id of the row's component."""
    rows = settled(_profiles(docs.select(F.col(key).alias("id"), F.col(text).alias("text"))), "profiles")
    points = rows.filter("n > 0").groupBy("mark1", "mark2").agg(F.min(F.struct("row", "n", "signature")).alias("of"), F.min("id").alias("id"))
    points = settled(points.select("mark1", "mark2", "id", F.col("of.row").alias("point"), "of.n", "of.signature"), "points")
    buckets = settled(_buckets(points), "buckets")
    some = buckets.select("point").distinct()
    held = settled(rows.select(F.col("row").alias("point"), "text").join(some, "point", "left_semi"), "held")

    # first the hub that a point meets most often, then those of its other buckets
    stars = settled(_stars(buckets), "stars")
    best = stars.groupBy("point").agg(F.max(F.struct("met", F.negative("hub").alias("back"))).alias("best"))
    first = settled(best.select(F.col("point").alias("a"), (-F.col("best.back")).alias("b")), "first")
    links = settled(_confirmed(first, held), "links")
    stars = stars.select(F.col("point").alias("a"), F.col("hub").alias("b"))
    second = settled(_apart(stars.join(first, ["a", "b"], "left_anti"), components(links)), "second")
    links = links.unionByName(settled(_confirmed(second, held), "links"))
    tried = first.unionByName(second).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    third = _bucket_pairs(buckets, points, held, settled(components(links), "label")).join(tried, ["a", "b"], "left_anti")
    links = links.unionByName(settled(_confirmed(settled(third, "third"), held), "links"))
    label = settled(components(links), "label")
    forget(buckets, held, first, second)

    named = points.join(label, F.col("point") == F.col("node"), "left")
    named = named.select("mark1", "mark2", "id", F.coalesce("label", "point").alias("label"))
    least = named.groupBy("label").agg(F.min("id").alias("component_id"))
    named = named.join(least, "label").select("mark1", "mark2", "component_id")
    full = rows.filter("n > 0").join(named, ["mark1", "mark2"]).select("id", "n", "component_id")
    empty = rows.filter("n = 0").select("id", "n", F.col("id").alias("component_id"))
    return full.unionByName(empty).select(F.col("id").alias(key), F.col("n").alias("n_shingles"), "component_id")
