"""Approximate nearest neighbours with a forest of random-projection trees.

A tree splits at hyperplanes between two random sample vectors, at the sample's median. A query
keeps one priority queue over all trees, ordered by the margin at which a branch was passed, and takes
leaves from it until they hold `share` times the rows of the table (rows count once per tree).
Every vector of those leaves is ranked by its exact inner product in double precision.

The forest is fitted on SAMPLE rows by hash; all rows are indexed. Leaves have a sixteenth of the rows
or LEAF_ROWS, whichever is less, if the sample allows. Equal vectors are one entry with their `k` + 1
least ids, of which no result can need more; equal queries are searched once. Members and queries
of a leaf meet in blocks of bounded size.

`share` is the price of recall: vectors without structure (as most of the test table, which fill a
64-dimensional sphere evenly) need more than half of the table, clustered ones a few leaves.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components take no
part, nor do rows without an id or of another dimension than the commonest of the sample; rows that
repeat an id are one item, as near as its nearest row; ties go to the lesser id; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = 20
TREES = 4
SAMPLE = 20_000
LEAF_ROWS = 16_384
SHARE = 1.25
_LEAST_LEAVES = 16
_MEMBER_BLOCK, _QUERY_BLOCK = 4096, 256


@dataclass
class Forest:
    """Trees as arrays; children below zero are leaves (leaf = -1 - child), numbered through all trees."""

    normals: list[np.ndarray]
    limits: list[np.ndarray]
    children: list[np.ndarray]
    leaf_share: np.ndarray  # share of its tree's rows in each leaf

    @property
    def dimension(self) -> int:
        return self.normals[0].shape[1] if self.normals else 0

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """Leaf of every vector in every tree: rows x trees."""
        out = np.zeros((len(x), len(self.normals)), np.int64)
        for t, (normal, limit, child) in enumerate(zip(self.normals, self.limits, self.children, strict=True)):
            at = np.zeros(len(x), np.int64)
            while (inner := np.flatnonzero(at >= 0)).size:
                node = at[inner]
                above = np.einsum("ij,ij->i", x[inner], normal[node]) > limit[node]
                at[inner] = child[node, above.astype(int)]
            out[:, t] = -1 - at
        return out

    def search(self, q: np.ndarray, share: float) -> list[int]:
        """Leaves for a query, nearest first, from one queue over all trees."""
        queue = [(0.0, t, 0) for t in range(len(self.normals))]
        found, seen = [], 0.0
        while queue and seen < share:
            margin, t, node = heapq.heappop(queue)
            if node < 0:
                found.append(-1 - node)
                seen += self.leaf_share[-1 - node]
                continue
            d = float(q @ self.normals[t][node] - self.limits[t][node])
            near, far = (1, 0) if d > 0 else (0, 1)
            heapq.heappush(queue, (margin, t, int(self.children[t][node, near])))
            heapq.heappush(queue, (max(margin, abs(d)), t, int(self.children[t][node, far])))
        return found


def grow(sample: np.ndarray, trees: int, leaf: int, seed: int = 0) -> Forest:
    """Forest over the sample with leaves of at most `leaf` sample rows, where the rows can be told apart."""
    draw = np.random.default_rng(seed)
    forest = Forest([], [], [], np.zeros(0))
    shares: list[float] = []

    def leaf_of(rows: np.ndarray) -> int:
        shares.append(len(rows) / len(sample))
        return -len(shares)

    for _ in range(trees):
        normals, limits, children = [], [], []
        waiting = [(np.arange(len(sample)), -1, 0)]
        while waiting:
            rows, parent, side = waiting.pop()
            me = None
            if len(rows) > leaf or parent < 0:
                a, b = sample[draw.choice(rows, 2)]
                normal = a - b
                if not normal.any():
                    normal = draw.normal(size=sample.shape[1])
                normal = normal / np.linalg.norm(normal)
                at = sample[rows] @ normal
                limit = np.median(at)
                above = at > limit
                if above.any() or parent < 0:
                    me = len(normals)
                    normals.append(normal)
                    limits.append(limit)
                    children.append([0, 0])
                    waiting += [(rows[~above], me, 0), (rows[above], me, 1)]
            if parent >= 0:
                children[parent][side] = me if me is not None else leaf_of(rows)
        forest.normals.append(np.array(normals))
        forest.limits.append(np.array(limits))
        forest.children.append(np.array(children))
    forest.leaf_share = np.array(shares)
    return forest


def usable(vector: Column) -> Column:
    """False for vectors that take no part."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def fit(vectors: DataFrame, trees: int = TREES, sample: int = SAMPLE, leaf_rows: int = LEAF_ROWS) -> tuple[Forest | None, int]:
    """Forest fitted on at most `sample` of (vec_id, vector), None without any, and the number of rows."""
    some = vectors.orderBy(F.xxhash64("vec_id", "vector"), "vec_id").limit(sample).toArrow()
    if not some.num_rows:
        return None, 0
    rows = some["vector"].to_pylist()
    size = Counter(map(len, rows)).most_common(1)[0][0]
    x = np.array([r for r in rows if len(r) == size], np.float64)
    total = vectors.count()
    return grow(x, trees, max(8, min(len(x) // _LEAST_LEAVES, leaf_rows * len(x) // max(1, total)))), total


def _placed(rows: DataFrame, forest, names: str, place) -> DataFrame:
    """(leaf, names..., body) for each leaf that `place(forest, matrix)` gives for each row of (names..., vector)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                x = _matrix(batch.column(batch.num_columns - 1))
                row, leaf = place(forest.value, x)
                take = pa.array(row)
                body = [v.tobytes() for v in x]
                columns = [batch.column(i).take(take) for i in range(batch.num_columns - 1)]
                out = [pa.array(leaf, pa.int64()), *columns, pa.array([body[i] for i in row], pa.binary())]
                yield pa.record_batch(out, names=["leaf", *batch.schema.names[:-1], "body"])

    return rows.mapInArrow(run, f"leaf long, {names}, body binary")


def _blocks(placed: DataFrame, tie: str, block: int) -> DataFrame:
    """Rows of a leaf packed into blocks of about `block` rows."""
    sizes = placed.groupBy("leaf").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    dealt = placed.join(sizes, "leaf").withColumn("block", F.pmod(F.xxhash64(tie), F.col("blocks")))
    fields = [c for c in placed.columns if c != "leaf"]
    return dealt.groupBy("leaf", "block").agg(F.collect_list(F.struct(*fields)).alias("rows")).select("leaf", "rows")


def nearest(
    table: DataFrame,
    is_query: Column,
    key: str = "vec_id",
    vector: str = "embedding",
    k: int = K,
    trees: int = TREES,
    share: float = SHARE,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows found of largest inner product for each query row."""
    spark = table.sparkSession
    body = F.col(vector).cast("array<double>")
    queries = table.filter(is_query & F.col(key).isNotNull() & usable(body))
    queries = queries.select(F.col(key).cast("long").alias("query_id"), body.alias("vector"))
    rows = table.filter(F.col(key).isNotNull() & usable(body)).select(F.col(key).cast("long").alias("vec_id"), body.alias("vector"))
    model, total = fit(rows, trees)
    if model is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    forest = spark.sparkContext.broadcast(model)
    same = F.size("vector") == model.dimension
    # a row is met in `trees` leaves at most, so this many places hold k candidates
    share = max(share, trees * (k + 2) / total)

    # of equal vectors the k + 1 least ids; the window keeps no more than that per map task
    order = Window.partitionBy("vector").orderBy("vec_id")
    least = rows.filter(same).withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= k + 1)
    members = least.groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).select("ids", "vector")

    def leaves(forest: Forest, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        leaf = forest.leaves(x)
        return np.repeat(np.arange(len(x)), leaf.shape[1]), leaf.ravel()

    def probes(forest: Forest, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found = [forest.search(q, share) for q in x]
        return np.repeat(np.arange(len(x)), [len(f) for f in found]), np.array([f for one in found for f in one], np.int64)

    keyed = queries.filter(same).select(F.xxhash64("vector").alias("query"), "query_id", "vector")
    distinct = keyed.groupBy("query").agg(F.min("vector").alias("vector"))
    entries = _blocks(_placed(members, forest, "ids array<bigint>", leaves), "body", _MEMBER_BLOCK)
    asked = _blocks(_placed(distinct, forest, "query long", probes), "query", _QUERY_BLOCK)
    pairs = entries.select("leaf", F.col("rows").alias("members")).join(asked.select("leaf", F.col("rows").alias("queries")), "leaf")

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                some, asked = (batch.column(c)[i].values for c in (0, 1))
                x, q = (np.frombuffer(b"".join(s.field("body").to_pylist()), np.float64) for s in (some, asked))
                x, q = x.reshape(len(some), -1), q.reshape(len(asked), -1)
                ids = some.field("ids").to_pylist()
                near = q @ x.T
                # all that rounding may put among the first k + 1, then exact sums that do not depend on the place in the block
                nth = min(k + 1, len(x))
                least = np.partition(near, len(x) - nth, axis=1)[:, len(x) - nth]
                margin = 4e-16 * x.shape[1] * np.linalg.norm(q, axis=1) * np.linalg.norm(x, axis=1).max()
                out = []
                for key, one, products, border in zip(asked.field("query").to_pylist(), q, near, least - 2 * margin, strict=True):
                    top = np.flatnonzero(products >= border)
                    exact = np.einsum("j,kj->k", one, x[top])
                    found = heapq.nsmallest(k + 1, ((-s, n) for p, s in zip(top.tolist(), exact.tolist(), strict=True) for n in ids[p]))
                    out += [(key, n, -s) for s, n in found]
                columns = zip(*out, strict=True)
                kinds = (pa.int64(), pa.int64(), pa.float64())
                yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["query", "vec_id", "score"])

    found = pairs.select("members", "queries").mapInArrow(rank, "query long, vec_id long, score double")
    found = found.groupBy("query", "vec_id").agg(F.max("score").alias("score"))
    by_score = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    found = found.withColumn("nth", F.row_number().over(by_score)).filter(F.col("nth") <= k + 1)
    # equal queries share the list; each leaves out itself
    own = keyed.select("query", "query_id").join(found, "query").filter("query_id != vec_id")
    own = own.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    final = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        own.withColumn("rank", F.row_number().over(final))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
