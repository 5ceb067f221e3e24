"""Divergence of sources: smoothed word shares compared between all sources of a language.

Counts of kept terms by source are a sparse matrix. Its columns are dealt to blocks of about
BLOCK_TERMS terms, common ones first, its rows to blocks of GROUP_ROWS sources, and each cut is held
as a quadtree: a quadrant is stored only where a count stands, quadrants of LEAF x LEAF cells are
dense. Two blocks of sources go down their trees together, for all pairs at once: where neither has
a quadrant nothing is read, since all its cells have the pair's zero price, and only leaves of one
or both are compared cell by cell. What no leaf showed of a pair's columns is priced in one product.

With count c of a term, N occurrences of all V kept terms and `p = 1 + floor(10^9 (c + 1) / (N + V))`,
the divergence from a share q is `floor((p - q)^2 / q)`. All arithmetic is in whole numbers.

Defined results: null text, language and source count as empty ones; a source without terms has
zero counts; in a language without kept terms all values of pairs are 0 and there are no terms; rows are
counted as they are, ids and other columns are ignored; no rows give no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import settled, texts_of

# the UTF-8 bytes of a to z and of all that is not ASCII; A to Z are lower-cased before
TERMS = re.compile(rb"[a-z\x80-\xff]+")
LEAST_DOCUMENTS = 3
TOP_TERMS = 200
BLOCK_TERMS = 2048
GROUP_ROWS = 256
LEAF = 8
_HELD = 1 << 18
_PAIRS = 1 << 12


def share(count: Column, words: Column, terms: Column) -> Column:
    """1 + floor(10^9 (count + 1) / (words + terms)), for counts of any size."""
    scaled = F.lit(1_000_000_000).cast("decimal(10,0)") * (count + 1).cast("decimal(19,0)")
    return 1 + F.call_function("div", scaled, (words + terms).cast("decimal(19,0)"))


def divergence(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def term_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(lang, source, term, n, docs) with possibly several rows for a term: occurrences, and rows that hold it."""

    limit = _HELD

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, rows) in groups.items():
                terms = [t.decode("utf-8", "surrogatepass") for t in n]
                counts = [pa.array(list(n.values()), pa.int64()), pa.array([rows[t] for t in n], pa.int64())]
                named = [pa.array([x] * len(terms), pa.string()) for x in (lang, source)]
                yield pa.record_batch([*named, pa.array(terms, pa.string()), *counts], names=["lang", "source", "term", "n", "docs"])
            groups.clear()

        for batch in batches:
            langs, sources = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i, raw in texts_of(batch, 2):
                n, rows = groups.setdefault((langs[i], sources[i]), (Counter(), Counter()))
                words = TERMS.findall(raw.tobytes().lower())
                held -= len(n)
                n.update(words)
                rows.update(set(words))
                held += len(n)
                if held >= limit:
                    yield from flush()
                    held = 0
        yield from flush()

    named = [F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")]
    return docs.select(*named, F.col(text).alias("text")).mapInArrow(
        run, "lang string, source string, term string, n long, docs long"
    )


def kept_cells(docs: DataFrame, text: str = "text") -> DataFrame:
    """(lang, source, term, n, total, first) of all terms in enough documents of their language.

    `total` counts the term in its language; `first` is 1 in one row of each term.
    """
    # dealt by term alone, the sums by source and those over all sources need one shuffle
    cells = term_counts(docs, text).repartition("lang", "term").groupBy("lang", "term", "source")
    cells = cells.agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")
    cells = cells.withColumn("total", F.sum("n").over(term)).withColumn("spread", F.sum("docs").over(term))
    cells = cells.withColumn("first", (F.row_number().over(term.orderBy("source")) == 1).cast("long"))
    return cells.filter(F.col("spread") >= LEAST_DOCUMENTS).select("lang", "source", "term", "n", "total", "first")


def source_totals(docs: DataFrame, cells: DataFrame) -> DataFrame:
    """(lang, source, words, terms, lang_words, sources, row) of every source of every language."""
    counts = cells.groupBy("lang", "source").agg(F.sum("n").alias("words"), F.sum("first").alias("firsts"))
    named = [F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")]
    groups = docs.select(*named).distinct().join(counts, ["lang", "source"], "left").fillna(0, ["words", "firsts"])
    lang = Window.partitionBy("lang")
    return groups.select(
        "lang",
        "source",
        "words",
        F.sum("firsts").over(lang).alias("terms"),
        F.sum("words").over(lang).alias("lang_words"),
        F.count("*").over(lang).alias("sources"),
        (F.row_number().over(lang.orderBy(F.desc("words"), "source")) - 1).cast("long").alias("row"),
    )


class Quadtree:
    """Cells of a sparse matrix: by level the quadrants that hold one, and dense leaves.

    A leaf, also one that is not stored, has the shares of its cells; `base` are the rows' shares of count zero.
    """

    def __init__(self, row: np.ndarray, col: np.ndarray, value: np.ndarray, base: np.ndarray, levels: int):
        self.quads = -(-len(base) // LEAF)
        self.width = [1 << level for level in range(levels + 1)]
        leaf = (row // LEAF) * self.width[-1] + col // LEAF
        self.levels = [None] * levels + [np.unique(leaf)]
        for level in range(levels - 1, -1, -1):
            at, width = self.levels[level + 1], self.width[level + 1]
            self.levels[level] = np.unique((at // width // 2) * self.width[level] + at % width // 2)
        padded = np.ones(self.quads * LEAF, np.int64)
        padded[: len(base)] = base
        rows = padded.reshape(self.quads, LEAF, 1)
        stored = self.levels[-1]
        self.values = np.concatenate([rows[stored // self.width[-1]], rows]).repeat(LEAF, axis=2)
        self.held = np.zeros(self.values.shape, bool)
        at = np.searchsorted(stored, leaf), row % LEAF, col % LEAF
        self.values[at], self.held[at] = value, True

    def find(self, level: int, i: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Place of quadrant (i, c) among the stored ones of its level; -1 for a uniform one."""
        stored, key = self.levels[level], i * self.width[level] + c
        if not len(stored):
            return np.full(len(key), -1)
        at = np.minimum(np.searchsorted(stored, key), len(stored) - 1)
        return np.where(stored[at] == key, at, -1)

    def leaves(self, i: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Index of each leaf in `values`, a uniform one being that of its rows."""
        at = self.find(len(self.levels) - 1, i, c)
        return np.where(at < 0, len(self.levels[-1]) + i, at)


def joint_pairs(a: Quadtree, b: Quadtree) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ahead, back, seen), each by rows of `a` and of `b`: divergences of a's row from b's and of b's from a's
    over the columns where either has a count, and how many these are. Of one tree with itself, quadrants of
    rows below the diagonal are left empty."""
    shape = (a.quads, b.quads, LEAF, LEAF)
    ahead, back, seen = (np.zeros(shape, np.int64) for _ in range(3))
    i = j = c = np.zeros(1, np.int64)
    for level in range(len(a.levels)):
        if level:
            di, dj, dc = (np.tile(d.ravel(), len(i)) for d in np.meshgrid([0, 1], [0, 1], [0, 1], indexing="ij"))
            i, j, c = 2 * i.repeat(8) + di, 2 * j.repeat(8) + dj, 2 * c.repeat(8) + dc
        # rows of a quadrant of this level are LEAF << left many
        left = len(a.levels) - 1 - level
        real = ((i << left) < a.quads) & ((j << left) < b.quads)
        if a is b:
            real &= i <= j
        i, j, c = i[real], j[real], c[real]
        some = (a.find(level, i, c) >= 0) | (b.find(level, j, c) >= 0)
        i, j, c = i[some], j[some], c[some]
    for at in range(0, len(i), _PAIRS):
        part = slice(at, at + _PAIRS)
        x, y = a.leaves(i[part], c[part]), b.leaves(j[part], c[part])
        p, q = a.values[x][:, :, None, :], b.values[y][:, None, :, :]
        held = a.held[x][:, :, None, :] | b.held[y][:, None, :, :]
        square = np.where(held, (p - q) ** 2, 0)
        np.add.at(ahead, (i[part], j[part]), (square // q).sum(axis=3))
        np.add.at(back, (i[part], j[part]), (square // p).sum(axis=3))
        np.add.at(seen, (i[part], j[part]), held.sum(axis=3))
    flat = (a.quads * LEAF, b.quads * LEAF)
    return tuple(x.transpose(0, 2, 1, 3).reshape(flat) for x in (ahead, back, seen))


def block_pairs(row: np.ndarray, col: np.ndarray, p: np.ndarray, a: int, b: int, group_rows: int) -> dict[str, np.ndarray]:
    """Ordered pairs of the sources of row blocks `a` and `b`; a cell with column -1 gives its source's zero share."""
    levels = max(0, int(np.ceil(np.log2(max(group_rows, int(col.max()) + 1) / LEAF))))
    zero = col < 0
    bases, trees = {}, {}
    for k in {a, b}:
        mine = row // group_rows == k
        base = np.ones(int((mine & zero).sum()), np.int64)
        base[row[mine & zero] - k * group_rows] = p[mine & zero]
        cells = mine & ~zero
        bases[k], trees[k] = base, Quadtree(row[cells] - k * group_rows, col[cells], p[cells], base, levels)
    ahead, back, seen = (x[: len(bases[a]), : len(bases[b])] for x in joint_pairs(trees[a], trees[b]))
    if a == b:
        quad = np.arange(len(ahead)) // LEAF
        upper = quad[:, None] <= quad[None, :]
        ahead, seen = np.where(upper, ahead, back.T), np.where(upper, seen, seen.T)
    ways = [(a, b, ahead, seen)] if a == b else [(a, b, ahead, seen), (b, a, back.T, seen.T)]
    out: dict[str, list[np.ndarray]] = {n: [] for n in ("row", "other", "value", "seen", "zero")}
    for i, j, value, shown in ways:
        s, t = np.indices(value.shape).reshape(2, -1)
        x, y = bases[i][s], bases[j][t]
        columns = (s + i * group_rows, t + j * group_rows, value.ravel(), shown.ravel(), (x - y) ** 2 // y)
        apart = columns[0] != columns[1]
        for n, v in zip(out, columns, strict=True):
            out[n].append(v[apart])
    return {n: np.concatenate(v) for n, v in out.items()}


def _pair_values(cells: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, row, other, value) of all ordered pairs of sources of a language."""
    blocks = F.greatest(F.lit(1), F.ceil(F.col("terms") / BLOCK_TERMS)).cast("int")
    row_blocks = F.ceil(F.col("sources") / GROUP_ROWS).cast("int")

    def met(df: DataFrame) -> DataFrame:
        """Each row for every pair of row blocks that its source belongs to."""
        own = F.floor(F.col("row") / GROUP_ROWS).cast("int")
        df = df.withColumn("met", F.explode(F.sequence(F.lit(0), row_blocks - 1)))
        return df.select("lang", "block", F.least(own, "met").alias("a"), F.greatest(own, "met").alias("b"), "row", "col", "p")

    dealt = cells.withColumn("block", F.pmod(F.xxhash64("lang", "term"), blocks).cast("int"))
    place = Window.partitionBy("lang", "block").orderBy(F.desc("total"), "term")
    dealt = met(dealt.withColumn("col", F.dense_rank().over(place) - 1))
    zeros = groups.withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1)))
    zeros = met(zeros.withColumn("col", F.lit(-1)).withColumn("p", share(F.lit(0), F.col("words"), F.greatest("terms", F.lit(1)))))

    group_rows = GROUP_ROWS

    def solve(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        row, col, p = (t.column(n).to_numpy().astype(np.int64) for n in ("row", "col", "p"))
        out = block_pairs(row, col, p, key[2].as_py(), key[3].as_py(), group_rows)
        return pa.table({"lang": pa.array([key[0].as_py()] * len(out["row"]), pa.string()), **{n: pa.array(v) for n, v in out.items()}})

    pairs = dealt.unionByName(zeros).groupBy("lang", "block", "a", "b").applyInArrow(
        solve, "lang string, row long, other long, value long, seen long, zero long"
    )
    return pairs.groupBy("lang", "row", "other").agg(F.sum("value").alias("value"), F.sum("seen").alias("seen"), F.first("zero").alias("zero"))


def audited(docs: DataFrame, text: str = "text") -> DataFrame:
    """(lang, source, part, item, value, rank): how far each source is from every other of its language
    (part `pair`), and its TOP_TERMS terms that are most above their share in the language (part `term`)."""
    cells = settled(kept_cells(docs, text), "cells")
    groups = settled(source_totals(docs, cells), "groups")
    priced = cells.join(groups, ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("words"), F.col("terms")))

    pairs = _pair_values(priced, groups)
    mine = groups.select("lang", "row", "source", "terms")
    other = groups.select("lang", F.col("row").alias("other"), F.col("source").alias("item"))
    pairs = pairs.join(mine, ["lang", "row"]).join(other, ["lang", "other"])
    pairs = pairs.select("lang", "source", "item", (F.col("value") + (F.col("terms") - F.col("seen")) * F.col("zero")).alias("value"))

    terms = priced.withColumn("q", share(F.col("total"), F.col("lang_words"), F.col("terms"))).filter("p > q")
    terms = terms.select("lang", "source", F.col("term").alias("item"), divergence(F.col("p"), F.col("q")).alias("value"))

    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    pairs = pairs.withColumn("rank", rank).withColumn("part", F.lit("pair")).select(columns)
    terms = terms.withColumn("rank", rank).filter(F.col("rank") <= TOP_TERMS).withColumn("part", F.lit("term")).select(columns)
    return pairs.unionByName(terms)
