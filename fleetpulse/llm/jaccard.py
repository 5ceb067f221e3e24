"""Near-duplicate groups: Jaccard join of word shingles through count-vector R-trees.

A document's set holds its distinct five-word shingles. Hashing shingles into GROUPS groups gives a
point of group counts, and the overlap of two sets is at most the sum of coordinate minima of their
points. Points are packed into R-trees whose nodes keep the greatest counts, and pairs of nodes
whose bound is too small are dropped with all that is below them. Surviving pairs are verified on
the whole sets.

One tree over all documents does not prune (in tens of dimensions its upper nodes overlap), so
documents are first dealt, without loss, to the trees in which a partner can be: sets that are
similar enough share one of their `n - ceil(0.8 n) + 1` first shingles in any common order. The
order puts shingles of rare corpus groups first, so that wide-spread passages do not deal documents
together. Documents with the same set are one point, whatever their number.

Whole links are many within a group of copies, and only groups are wanted. So each tree first
tries its members against the two of them that stand in the most trees; what these links connect needs no
further pairs, and trees within one component are left out. All other pairs go through the trees.
Trees with the same members are one tree. Trees of more than PAGE_ROWS points are dealt out in parts: each
with the middle in the first round, as pairs of parts in the second, where only trees of several components are left.

Sets are told apart by 128 bits, of which 64 are carried as their `point`.

Defined results: null and empty texts, and texts without words, have an empty set, link with nothing
and are their own component; fewer than five words are one shingle; repeated rows link unless empty;
null ids take part, and a component's id is its least non-null id; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import (
    Bitmap,
    Rows,
    distinct,
    forget,
    mixed,
    settled,
    texts_of,
    tidied,
    told_apart,
    window_hashes,
    word_bounds,
    word_hashes,
)
from .graph import components

SHINGLE_WORDS = 5
PERCENT = 80
GROUPS = 256
PAGE_ROWS = 4096
BLOCK_ROWS = 512
_MARK = np.uint64(0xC2B2AE3D27D4EB4F)
# of two different sets that link, the larger has one shingle in five at most for itself
_LEAST = -(-100 // (100 - PERCENT))
_CORPUS_BITS = 14
_LEAF, _FAN = 32, 8

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingle_set(raw: np.ndarray) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a UTF-8 text, A-Z in lower case."""
    return distinct(_all_shingles(raw))


def set_mark(shingles: np.ndarray, raw: np.ndarray) -> np.uint64:
    """A second hash for a whole set; that of a single shingle comes from its words, not from its own hash."""
    if len(shingles) == 1:
        raw = np.take(_LOWER, raw)
        words = [raw[i:j].tobytes() for i, j in zip(*(x[:SHINGLE_WORDS] for x in word_bounds(raw)), strict=True)]
        return np.uint64(int.from_bytes(hashlib.blake2b(b" ".join(words), digest_size=8).digest(), "little"))
    return set_hash(mixed(shingles ^ _MARK))


def set_hash(shingles: np.ndarray) -> np.uint64:
    """One hash for a whole set."""
    if not len(shingles):
        return np.uint64(0)
    return mixed(np.sum(mixed(shingles), keepdims=True) + np.uint64(len(shingles)))[0]


def count_vector(shingles: np.ndarray) -> np.ndarray:
    """Counts of GROUPS groups, each up to 255; what goes beyond is lost to the bound, see `excess`."""
    return np.minimum(_group_counts(shingles), 255).astype(np.uint8)


def excess(shingles: np.ndarray) -> int:
    """Shingles beyond 255 of their group. Two sets share at most the lesser excess besides the vectors' minima."""
    return int(np.maximum(_group_counts(shingles) - 255, 0).sum())


def _group_counts(shingles: np.ndarray) -> np.ndarray:
    return np.bincount((shingles >> np.uint64(25)).astype(np.int64) % GROUPS, minlength=GROUPS)


def prefix(shingles: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The first shingles by (place of their corpus group, hash) of which similar sets share one."""
    n = len(shingles)
    keep = n - (PERCENT * n + 99) // 100 + 1
    # shingles are sorted, so a stable sort by the place is enough
    order = np.argsort(place[(shingles >> np.uint64(64 - _CORPUS_BITS)).astype(np.int64)], kind="stable")
    return shingles[order[:keep]]


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * shared >= PERCENT * (len(a) + len(b) - shared)


class _Tree:
    """Packed R-tree over points sorted by (label, size): levels of nodes with size range, label range and greatest counts."""

    def __init__(self, size: np.ndarray, label: np.ndarray, over: np.ndarray, counts: np.ndarray):
        self.levels = [(size, size, label, label, over, counts)]
        step = _LEAF
        while len(self.levels[-1][0]) > 1:
            low, high, first, last, over, top = self.levels[-1]
            cut = np.arange(0, len(low), step)
            self.levels.append(
                (
                    np.minimum.reduceat(low, cut),
                    np.maximum.reduceat(high, cut),
                    np.minimum.reduceat(first, cut),
                    np.maximum.reduceat(last, cut),
                    np.maximum.reduceat(over, cut),
                    np.maximum.reduceat(top, cut, axis=0),
                )
            )
            step = _FAN

    def may_hold(self, level: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        low, high, first, last, over, top = self.levels[level]
        ok = (100 * high[i] >= PERCENT * low[j]) & (100 * high[j] >= PERCENT * low[i])
        ok &= (first[i] != last[i]) | (first[j] != last[j]) | (first[i] != first[j])
        at = np.flatnonzero(ok)
        for part in np.array_split(at, len(at) // 32_768 + 1):
            bound = np.minimum(top[i[part]], top[j[part]]).sum(axis=1, dtype=np.int64)
            bound += np.minimum(over[i[part]], over[j[part]])
            # overlap / (|a| + |b| - overlap) >= p needs overlap (100 + p) >= p (|a| + |b|)
            ok[part] = bound * (100 + PERCENT) >= PERCENT * (low[i[part]] + low[j[part]])
        return ok

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of points i < j that the bound allows."""
        stack = [(len(self.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        while stack:
            level, i, j = stack.pop()
            keep = self.may_hold(level, i, j)
            i, j = i[keep], j[keep]
            if not len(i):
                continue
            if level == 0:
                yield i, j
                continue
            fan, below = (_LEAF if level == 1 else _FAN), len(self.levels[level - 1][0])
            for part in np.array_split(np.arange(len(i)), len(i) * fan * fan // 500_000 + 1):
                a = (i[part, None] * fan + np.arange(fan)).repeat(fan, axis=1).ravel()
                b = np.tile(j[part, None] * fan + np.arange(fan), (1, fan)).ravel()
                real = (a < below) & (b < below) & ((a < b) if level == 1 else (a <= b))
                stack.append((level - 1, a[real], b[real]))


def tree_pairs(size: np.ndarray, label: np.ndarray, over: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows with different labels whose sum of coordinate minima allows the similarity."""
    order = np.lexsort((size, label))
    points = (size[order], label[order], over[order], counts[order])
    if len(order) <= _LEAF:
        i, j = np.triu_indices(len(order), 1)
        keep = _leaf(*points).may_hold(0, i, j)
        found = [(i[keep], j[keep])]
    else:
        found = list(_Tree(*points).pairs())
    i = np.concatenate([f[0] for f in found]) if found else np.zeros(0, np.int64)
    j = np.concatenate([f[1] for f in found]) if found else np.zeros(0, np.int64)
    return order[i], order[j]


def _leaf(size: np.ndarray, label: np.ndarray, over: np.ndarray, counts: np.ndarray) -> _Tree:
    """Points alone, without nodes above."""
    tree = _Tree.__new__(_Tree)
    tree.levels = [(size, size, label, label, over, counts)]
    return tree


def star_pairs(
    point: np.ndarray, size: np.ndarray, over: np.ndarray, counts: np.ndarray, degree: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that the bound allows of each row with the two rows that stand in the most trees.

    What many copies were made from shares more first shingles than any of the copies.
    """
    rows = np.arange(len(point))
    tree = _leaf(size, point, over, counts)
    i = np.concatenate([rows, rows])
    j = np.repeat(np.lexsort((point, -degree))[:2], len(rows))
    keep = tree.may_hold(0, i, j)
    return i[keep], j[keep]


def _all_shingles(raw: np.ndarray) -> np.ndarray:
    raw = np.take(_LOWER, raw)
    words = word_hashes(raw, *word_bounds(raw))
    return window_hashes(words, min(SHINGLE_WORDS, len(words))) if len(words) else words


def _corpus_order(docs: DataFrame) -> np.ndarray:
    """Place of every corpus group of shingles, those with the fewest shingles in all texts first.

    One row for each of the 2^_CORPUS_BITS groups reaches the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros(1 << _CORPUS_BITS, np.int64)
        for batch in batches:
            for _, raw in texts_of(batch, 0):
                group = (_all_shingles(raw) >> np.uint64(64 - _CORPUS_BITS)).astype(np.int64)
                totals += np.bincount(group, minlength=len(totals))
        at = np.flatnonzero(totals)
        yield pa.record_batch([pa.array(at), pa.array(totals[at])], names=["group", "n"])

    sums = docs.select("text").mapInArrow(run, "group long, n long").groupBy("group").agg(F.sum("n").alias("n"))
    with tidied(docs.sparkSession):
        sums = sums.toArrow()
    totals = np.zeros(1 << _CORPUS_BITS, np.int64)
    totals[sums["group"].to_numpy()] = sums["n"].to_numpy()
    place = np.empty(len(totals), np.uint16)
    place[np.argsort(totals, kind="stable")] = np.arange(len(totals))
    return place


def _first_shingles(docs: DataFrame, place) -> DataFrame:
    """(key, point): the first shingles of every set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = Rows(["key", "point"])
        for batch in batches:
            for _, raw in texts_of(batch, 0):
                shingles = shingle_set(raw)
                if len(shingles):
                    first = prefix(shingles, place.value)
                    rows.add(first, np.full(len(first), set_hash(shingles)))
                    if rows.full():
                        yield from rows.take()
        yield from rows.take()

    return docs.select("text").mapInArrow(run, "key long, point long")


def _profiles(docs: DataFrame, place, shared) -> DataFrame:
    """(id, hash, mark, n, keys, over, counts, text) of every row; the last four only where a first shingle may be shared."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                size = batch.num_rows
                hashes, marks, n = np.zeros(size, np.uint64), np.zeros(size, np.uint64), np.zeros(size, np.int64)
                keys, over, counts = [None] * size, [None] * size, [None] * size
                raws = dict(texts_of(batch, 1))
                sets = {i: s for i, s in ((i, shingle_set(raw)) for i, raw in raws.items()) if len(s)}
                firsts = [prefix(s, place.value) for s in sets.values()] or [np.zeros(0, np.uint64)]
                hits = Bitmap.has(shared.value, np.concatenate(firsts))
                cuts = np.cumsum([len(f) for f in firsts])[:-1]
                for (i, shingles), first, hit in zip(sets.items(), firsts, np.split(hits, cuts), strict=False):
                    hashes[i], marks[i], n[i] = set_hash(shingles), set_mark(shingles, raws[i]), len(shingles)
                    if hit.any():
                        keys[i], over[i] = first[hit].view(np.int64), excess(shingles)
                        counts[i] = count_vector(shingles).tobytes()
                text = batch.column(1).take(pa.array([None if k is None else i for i, k in enumerate(keys)], pa.int64()))
                yield pa.record_batch(
                    [
                        batch.column(0),
                        pa.array(hashes.view(np.int64)),
                        pa.array(marks.view(np.int64)),
                        pa.array(n),
                        pa.array(keys, pa.list_(pa.int64())),
                        pa.array(over, pa.int64()),
                        pa.array(counts, pa.binary()),
                        text,
                    ],
                    names=["id", "hash", "mark", "n", "keys", "over", "counts", "text"],
                )

    return docs.select("id", "text").mapInArrow(
        run, f"id {kind}, hash long, mark long, n long, keys array<bigint>, over long, counts binary, text string"
    )


def _blocks(pairs: DataFrame, group: DataFrame) -> DataFrame:
    """(label, i, j, a, b): the pairs, dealt to blocks that are verified together; group: (node, label).

    Pairs that connect up to BLOCK_ROWS points are one block. In a larger group with few pairs, these go
    with the one of their two points that has more of them, up to about BLOCK_ROWS at a time, so the texts
    of a block are that point's and one for each pair. Where pairs are many, blocks are pairs of parts.
    """
    placed = pairs.join(group.select(F.col("node").alias("a"), "label"), "a")
    sizes = group.groupBy("label").agg(F.count("*").alias("n")).filter(F.col("n") > BLOCK_ROWS)
    sizes = sizes.join(placed.groupBy("label").agg(F.count("*").alias("links")), "label")
    parts = F.ceil(F.col("n") / BLOCK_ROWS).cast("int")
    sizes = sizes.select("label", parts.alias("parts"), (F.col("links") <= F.col("n") * parts).alias("few"))
    ends = placed.join(sizes.filter("few"), "label", "left_semi").select(F.explode(F.array("a", "b")).alias("node"))
    hubs = ends.groupBy("node").agg(F.count("*").alias("degree")).filter(F.col("degree") > BLOCK_ROWS)
    wanted = placed.join(sizes, "label", "left")
    for c in ("a", "b"):
        wanted = wanted.join(hubs.select(F.col("node").alias(c), F.col("degree").alias(f"degree_{c}")), c, "left")
    by_a = F.coalesce("degree_a", F.lit(0)) > F.coalesce("degree_b", F.lit(0))
    hub, other = F.when(by_a, F.col("a")).otherwise(F.col("b")), F.when(by_a, F.col("b")).otherwise(F.col("a"))
    chunks = F.ceil(F.coalesce(F.greatest("degree_a", "degree_b"), F.lit(1)) / BLOCK_ROWS)
    part_a, part_b = (F.pmod(F.xxhash64(c), F.col("parts")) for c in ("a", "b"))
    i = F.when(F.col("parts").isNull(), F.lit(0)).when(F.col("few"), hub).otherwise(F.least(part_a, part_b))
    j = F.when(F.col("parts").isNull(), F.lit(0)).when(F.col("few"), F.pmod(F.xxhash64(other), chunks)).otherwise(F.greatest(part_a, part_b))
    return wanted.select("label", i.cast("long").alias("i"), j.cast("long").alias("j"), "a", "b")


def _needed(blocks: DataFrame) -> DataFrame:
    """(label, i, j, point) of the texts that blocks read."""
    return blocks.select("label", "i", "j", F.explode(F.array("a", "b")).alias("point")).distinct()


def _verified(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """(a, b) of the pairs whose whole sets are similar; rows: (point, text), a point may have several."""
    pairs = settled(pairs, "pairs")
    group = settled(components(pairs), "groups")
    blocks = settled(_blocks(pairs, group), "blocks")
    texts = rows.select("point", "text").join(group.select("node"), F.col("point") == F.col("node"), "left_semi")
    texts = texts.dropDuplicates(["point"]).join(_needed(blocks), "point")
    texts = texts.select("label", "i", "j", F.col("point").alias("a"), F.lit(None).cast("long").alias("b"), "text")
    wanted = blocks.withColumn("text", F.lit(None).cast("string"))
    # texts of a block come before its pairs
    dealt = texts.unionByName(wanted).repartition("label", "i", "j").sortWithinPartitions("label", "i", "j", F.col("b").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, sets = None, {}
        for batch in batches:
            names = batch.schema.names
            keys = list(zip(*(batch.column(names.index(c)).to_pylist() for c in ("label", "i", "j")), strict=True))
            a, b = (batch.column(names.index(c)).to_pylist() for c in ("a", "b"))
            raw = dict(texts_of(batch, names.index("text")))
            out = []
            for r, key in enumerate(keys):
                if key != block:
                    block, sets = key, {}
                if b[r] is None:
                    sets[a[r]] = shingle_set(raw[r])
                elif max(len(sets[a[r]]), len(sets[b[r]])) >= _LEAST and similar(sets[a[r]], sets[b[r]]):
                    out.append((a[r], b[r]))
            yield pa.record_batch([pa.array([x[c] for x in out], pa.int64()) for c in (0, 1)], names=["a", "b"])

    out = settled(dealt.mapInArrow(run, "a long, b long"), "links")
    forget(pairs, group, blocks)
    return out


def _tree_candidates(members: DataFrame, points: DataFrame, star: bool) -> DataFrame:
    """(a, b) that the trees leave of (key, point, label); with `star` only pairs with the middle of each tree."""
    sizes = members.groupBy("key").agg(F.ceil(F.count("*") / PAGE_ROWS).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("point"), F.col("parts")).cast("int")
    dealt = members.join(sizes, "key").withColumn("part", part)
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    if star:
        # every part gets its members and the middle
        most = Window.partitionBy("key").orderBy(F.desc("degree"), "point")
        middle = dealt.filter("parts > 1").join(points.select("point", "degree"), "point")
        middle = middle.withColumn("nth", F.row_number().over(most)).filter("nth <= 2").withColumn("other", other).filter("other != part")
        dealt = dealt.withColumn("other", F.col("part")).unionByName(middle.select("key", "point", "label", "parts", "part", "other"))
        i = j = F.col("other")
    else:
        dealt = dealt.withColumn("other", other)
        i, j = F.least("part", "other"), F.greatest("part", "other")
    dealt = dealt.select("key", i.alias("i"), j.alias("j"), "part", "point", "label")
    dealt = dealt.join(points, "point").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, left = Rows(["a", "b"]), None

        def solve(group: pa.Table) -> None:
            columns = ("part", "point", "n", "label", "over", "degree")
            part, point, n, label, over, degree = (group.column(c).to_numpy() for c in columns)
            counts = np.frombuffer(b"".join(group.column("counts").to_pylist()), np.uint8).reshape(-1, GROUPS)
            i, j = star_pairs(point, n, over, counts, degree) if star else tree_pairs(n, label, over, counts)
            if not star and group.column("i")[0] != group.column("j")[0]:
                apart = part[i] != part[j]
                i, j = i[apart], j[apart]
            rows.add(np.minimum(point[i], point[j]), np.maximum(point[i], point[j]))

        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = pa.concat_tables([left, t]) if left is not None else t
            keys = np.stack([t.column(c).to_numpy() for c in ("key", "i", "j")])
            cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist()]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if b - a > 1:
                    solve(t.slice(a, b - a))
                if rows.full():
                    yield from rows.take()
            left = t.slice(cuts[-1])
        if left is not None and left.num_rows > 1:
            solve(left)
        yield from rows.take()

    return dealt.mapInArrow(run, "a long, b long").distinct()


def _distinct_trees(members: DataFrame) -> DataFrame:
    """One key of all that have the same members, of those with two labels at least."""
    of = members.groupBy("key").agg(
        F.min("label").alias("low"),
        F.max("label").alias("high"),
        F.count("*").alias("n"),
        F.bit_xor(F.xxhash64("point")).alias("mark"),
    )
    same = of.filter("low != high").groupBy("low", "high", "n", "mark").agg(F.min("key").alias("key"))
    return members.join(same.select("key"), "key", "left_semi")


def linked(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(`key`, n_shingles, point, component, component_id, hash, mark) of every row.

    Rows with the same `point` have the same set, rows with the same `component` are connected
    (both 0 for empty sets); component_id is the least id of the component; hash and mark are two
    hashes of the set.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    place = spark.sparkContext.broadcast(_corpus_order(docs))

    # a first shingle deals documents into a tree; those of one set alone are left out
    firsts = _first_shingles(docs, place)
    shared = firsts.groupBy("key").agg(F.min("point").alias("low"), F.max("point").alias("high")).filter("low != high")
    shared = settled(shared.select("key"), "shared")
    bitmap = spark.sparkContext.broadcast(Bitmap.of("key", shared))
    forget(shared)
    rows = settled(_profiles(docs, place, bitmap), "profiles")
    point = told_apart(rows.filter("n > 0"), F.col("hash"), F.col("mark"))
    rows = rows.withColumn("point", point)
    some = rows.filter("keys is not null")
    points = settled(some.select("point", "n", "over", "counts", F.size("keys").alias("degree")).dropDuplicates(["point"]), "points")
    members = some.select("point", F.explode("keys").alias("key")).distinct().withColumn("label", F.col("point"))
    members = settled(_distinct_trees(members), "members")

    # every member against the middle of its tree, then all pairs in trees that hold several components
    links = _verified(_tree_candidates(members, points, star=True), some)
    first = settled(components(links), "labels")
    known = members.drop("label").join(first, F.col("point") == F.col("node"), "left")
    known = _distinct_trees(known.select("key", "point", F.coalesce("label", "point").alias("label")))
    more = _verified(_tree_candidates(known, points, star=False), some)
    label = settled(components(links.unionByName(more)), "components")
    forget(points, members, links, more)

    full = rows.filter("n > 0").join(label, F.col("point") == F.col("node"), "left")
    full = full.select("id", "n", "point", F.coalesce("label", "point").alias("label"), "hash", "mark")
    least = full.groupBy("label").agg(F.min("id").alias("component_id"))
    full = full.join(least, "label").select("id", "n", "point", F.col("label").alias("component"), "component_id", "hash", "mark")
    empty = rows.filter("n = 0").select(
        "id", "n", "point", F.col("point").alias("component"), F.col("id").alias("component_id"), "hash", "mark"
    )
    return full.unionByName(empty).select(
        F.col("id").alias(key), F.col("n").alias("n_shingles"), "point", "component", "component_id", "hash", "mark"
    )


def _with_hashes(docs: DataFrame) -> DataFrame:
    """`docs` with the two hashes of each text's set as __hash and __mark."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, marks = np.zeros(batch.num_rows, np.uint64), np.zeros(batch.num_rows, np.uint64)
            for i, raw in texts_of(batch, at):
                shingles = shingle_set(raw)
                hashes[i], marks[i] = set_hash(shingles), set_mark(shingles, raw)
            yield pa.record_batch(
                [*batch.columns, pa.array(hashes.view(np.int64)), pa.array(marks.view(np.int64))],
                names=[*batch.schema.names, "__hash", "__mark"],
            )

    added = [T.StructField(c, T.LongType()) for c in ("__hash", "__mark")]
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *added]))


def representatives(docs: DataFrame) -> DataFrame:
    """One whole row of `docs` for each component: the one with the least doc_id.

    Rows without words all stay. Where ids repeat or are null, the set tells the rows apart, and of equal
    ids in one component the least text stays.
    """
    rows = settled(linked(docs), "linked")
    counts = rows.groupBy("doc_id").agg(F.count("*").alias("n"))
    single = rows.join(counts.filter("n = 1"), "doc_id").filter("doc_id = component_id").select("doc_id")
    kept = docs.join(single, "doc_id", "left_semi").select(docs.columns)
    again = counts.filter("n > 1 and doc_id is not null").select("doc_id")
    others = _with_hashes(docs.join(again, "doc_id", "left_semi").select(docs.columns).unionByName(docs.filter("doc_id is null")))
    wordless = others.filter("__hash = 0 and __mark = 0")
    mine = rows.filter(F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("n_shingles") > 0))
    names = {"doc_id": "__id", "hash": "__first", "mark": "__second", "component": "__component"}
    mine = mine.select(*(F.col(c).alias(n) for c, n in names.items())).distinct()
    same = (F.col("__hash") == F.col("__first")) & (F.col("__mark") == F.col("__second"))
    both = others.join(mine, F.col("doc_id").eqNullSafe(F.col("__id")) & same)
    first = Window.partitionBy("__component").orderBy("text")
    both = both.withColumn("__nth", F.row_number().over(first)).filter("__nth = 1")
    return kept.unionByName(both.select(docs.columns)).unionByName(wordless.select(docs.columns))
