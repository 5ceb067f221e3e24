"""Exact quantiles by narrowing histograms, all columns and row sets together.

A double is placed on a line of 64-bit integers that grows with it. Each pass counts the rows
in CELLS even cells of every interval that still holds a wanted rank, in the tasks, so that only
counts are shuffled and no value is; the next intervals are the cells that hold the ranks. An interval
with at most FINISH_ROWS rows gives its distinct values instead, and one whose least and greatest values are
equal needs no more. Ten bits are won by each pass, so six passes are the most for any values, and two do for a
million rows. All sums are made by numpy: as Spark expressions, hundreds of them make a method that the JVM does not compile.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import c, cols

CELLS = 1024
FINISH_ROWS = 4096


def present(df: DataFrame, name: str) -> Column:
    """The value, with NaN counted as missing."""
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(c(name)), c(name))
    return c(name)


def on_line(values: np.ndarray) -> np.ndarray:
    """Doubles as 64-bit integers in the same order."""
    bits = (values + 0.0).view(np.int64)
    return bits ^ ((bits >> np.int64(63)) & np.int64(0x7FFFFFFFFFFFFFFF))


def off_line(place: int) -> float:
    bits = np.array([place], np.int64)
    return float((bits ^ ((bits >> np.int64(63)) & np.int64(0x7FFFFFFFFFFFFFFF))).view(np.float64)[0])


@dataclass
class _Interval:
    """Places low to high of one column and set, the rows below them, and the ranks wanted within."""

    column: int
    set: int
    low: int
    high: int
    before: int
    rows: int
    ranks: list[int] = field(default_factory=list)

    def shift(self, cells: int) -> int:
        return max(0, (self.high - self.low).bit_length() - (cells - 1).bit_length())


def _inside(batch: pa.RecordBatch, n_columns: int) -> list[np.ndarray]:
    """Which rows are in each set."""
    return [batch.column(n_columns + j).to_numpy(zero_copy_only=False) == 1 for j in range(batch.num_columns - n_columns)]


def _limits(table: DataFrame, n_columns: int, n_sets: int) -> dict[tuple[int, int], tuple[int, int, int]]:
    """(rows with a value, places of the least and greatest) of every column and set with values, from one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int], list[int]] = {}
        for batch in batches:
            inside = _inside(batch, n_columns)
            for i in range(n_columns):
                values = batch.column(i)
                place, given = on_line(values.to_numpy(zero_copy_only=False).astype(float)), ~np.asarray(values.is_null())
                for j, in_set in enumerate(inside):
                    mine = place[given & in_set]
                    if len(mine):
                        at = found.setdefault((i, j), [0, int(mine[0]), int(mine[0])])
                        at[:] = at[0] + len(mine), min(at[1], int(mine.min())), max(at[2], int(mine.max()))
        columns = list(zip(*[(i, j, *at) for (i, j), at in found.items()])) or [()] * 5
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        yield pa.record_batch([pa.array(v, k) for v, k in zip(columns, kinds)], names=["column", "set", "n", "low", "high"])

    found = table.mapInArrow(run, "column int, set int, n long, low long, high long").groupBy("column", "set")
    found = found.agg(F.sum("n"), F.min("low"), F.max("high"))
    return {(i, j): (n, low, high) for i, j, n, low, high in found.collect()}  # columns x sets rows


def _counted(
    table: DataFrame, n_columns: int, intervals: list[_Interval], cells: int, finish_rows: int
) -> dict[int, tuple[list[tuple[int, int]], int, int]]:
    """(place or cell, rows) of every interval in order, and its least and greatest place, from one pass.

    Intervals x cells rows reach the driver.
    """
    asked = [(t.column, t.set, t.low, t.high, t.shift(cells), t.rows <= finish_rows) for t in intervals]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        spans: dict[int, list[int]] = {}

        def rows_of(i: int, kind: int, place, n) -> pa.RecordBatch:
            same = [pa.array(np.full(len(place), v, np.int32)) for v in (i, kind)]
            return pa.record_batch([*same, pa.array(place, pa.int64()), pa.array(n, pa.int64())], names=["interval", "kind", "place", "n"])

        for batch in batches:
            inside = _inside(batch, n_columns)
            places, members = {}, {}
            for i, (column, in_set, low, high, shift, finish) in enumerate(asked):
                if column not in places:
                    values = batch.column(column)
                    places[column] = on_line(values.to_numpy(zero_copy_only=False).astype(float)), ~np.asarray(values.is_null())
                place, given = places[column]
                if (column, in_set) not in members:
                    members[column, in_set] = place[given & inside[in_set]]
                mine = members[column, in_set]
                mine = mine[(mine >= low) & (mine <= high)]
                if not len(mine):
                    continue
                span = spans.setdefault(i, [high, low])
                span[:] = min(span[0], int(mine.min())), max(span[1], int(mine.max()))
                if finish:
                    yield rows_of(i, 0, *np.unique(mine, return_counts=True))
                else:
                    cell = (mine.view(np.uint64) - np.uint64(low & 0xFFFFFFFFFFFFFFFF)) >> np.uint64(shift)
                    found = np.bincount(cell.astype(np.int64), minlength=cells)
                    totals[i] = totals[i] + found if i in totals else found
        for i, found in totals.items():
            at = np.flatnonzero(found)
            yield rows_of(i, 0, at, found[at])
        for i, span in spans.items():
            yield rows_of(i, 1, span, [0, 0])

    sums = table.mapInArrow(run, "interval int, kind int, place long, n long").groupBy("interval", "kind", "place")
    out: dict[int, tuple[list, list]] = {}
    for i, kind, place, n in sums.agg(F.sum("n")).collect():
        out.setdefault(i, ([], []))[kind].append((place, n))
    return {i: (sorted(found), min(spans)[0], max(spans)[0]) for i, (found, spans) in out.items()}


def _narrowed(
    t: _Interval, found: list[tuple[int, int]], least: int, greatest: int, cells: int, finish_rows: int
) -> tuple[dict[int, int], list[_Interval]]:
    """Places of the ranks that are known now, and the intervals that hold the others."""
    if least == greatest:
        return {rank: least for rank in t.ranks}, []
    known: dict[int, int] = {}
    left: dict[int, _Interval] = {}
    before, at, shift = t.before, iter(found), t.shift(cells)
    place, n = next(at)
    for rank in sorted(t.ranks):
        while rank >= before + n:
            before += n
            place, n = next(at)
        if t.rows <= finish_rows:
            known[rank] = place
        elif shift == 0:
            known[rank] = t.low + place
        else:
            low = t.low + (place << shift)
            high = min(t.high, low + (1 << shift) - 1, greatest)
            part = left.setdefault(place, _Interval(t.column, t.set, max(low, least), high, before, n))
            part.ranks.append(rank)
    return known, list(left.values())


def exact_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probabilities: Sequence[float],
    sets: dict[str, Column] | None = None,
    cells: int = CELLS,
    finish_rows: int = FINISH_ROWS,
) -> DataFrame:
    """Linear-interpolated quantiles: one row (set, column, quantiles array); columns without values have none.

    `sets` are named row conditions evaluated in the same passes, for instance one per
    cross-validation fold. Runs a few passes over `df` when called.
    """
    sets = sets or {"all": F.lit(True)}
    tags = list(sets)
    values = [present(df, n).cast("double").alias(f"x{i}") for i, n in enumerate(columns)]
    table = df.select(*values, *[F.coalesce(s, F.lit(False)).cast("int").alias(f"in{j}") for j, s in enumerate(sets.values())])
    pairs = [(i, j) for i in range(len(columns)) for j in range(len(tags))]
    limits = _limits(table, len(columns), len(tags))

    wanted, known, todo = {}, {}, []
    for i, j in pairs:
        n, low, high = limits.get((i, j), (0, 0, 0))
        known[i, j] = {}
        wanted[i, j] = [(math.floor(h), math.ceil(h), h - math.floor(h)) for h in ((n - 1) * float(q) for q in probabilities)] if n else []
        ranks = sorted({r for a, b, _ in wanted[i, j] for r in (a, b)})
        if ranks and low == high:
            known[i, j] = {r: low for r in ranks}
        elif ranks:
            todo.append(_Interval(i, j, low, high, 0, n, ranks))
    while todo:
        found = _counted(table, len(columns), todo, cells, finish_rows)
        after = []
        for k, t in enumerate(todo):
            places, left = _narrowed(t, *found[k], cells, finish_rows)
            known[t.column, t.set] |= places
            after += left
        todo = after

    rows = []
    for i, j in pairs:
        if not any((i, k) in limits for k in range(len(tags))):
            continue
        at = {r: float(off_line(p)) for r, p in known[i, j].items()}
        found = [at[a] + (at[b] - at[a]) * f if f else at[a] for a, b, f in wanted[i, j]]
        rows.append((tags[j], columns[i], found or [None] * len(probabilities)))
    return df.sparkSession.createDataFrame(rows, "set string, column string, quantiles array<double>")


def robust_scale_stats(
    df: DataFrame,
    features: Sequence[str],
    sets: dict[str, Column] | None = None,
    exact: bool = True,
) -> DataFrame:
    """Median and inter-quartile range per feature (and set): (set, column, center, scale).

    A constant feature has range 0 and is divided by 1.
    """
    probabilities = (0.25, 0.5, 0.75)
    if exact:
        q = exact_quantiles(df, features, probabilities, sets)
    else:
        chosen = sets or {"all": F.lit(True)}
        picked = df.agg(
            *[
                F.percentile_approx(F.when(s, present(df, n).cast("double")), list(probabilities)).alias(f"__{i}_{j}")
                for i, s in enumerate(chosen.values())
                for j, n in enumerate(features)
            ]
        )
        q = picked.select(
            F.inline(
                F.array(
                    *[
                        F.struct(
                            F.lit(tag).alias("set"), F.lit(n).alias("column"), F.col(f"__{i}_{j}").alias("quantiles")
                        )
                        for i, tag in enumerate(chosen)
                        for j, n in enumerate(features)
                    ]
                )
            )
        )
    iqr = F.col("quantiles")[2] - F.col("quantiles")[0]
    return q.select(
        *cols(["set", "column"]),
        F.col("quantiles")[1].alias("center"),
        F.when(iqr == 0, F.lit(1.0)).otherwise(iqr).alias("scale"),
    )


def robust_scaled(df: DataFrame, features: Sequence[str], exact: bool = True) -> DataFrame:
    """`df` with its features as (x - median) / inter-quartile range; NaN becomes NULL."""
    stats = {r["column"]: (r["center"], r["scale"]) for r in robust_scale_stats(df, features, exact=exact).collect()}
    return df.select(
        *[
            ((present(df, n).cast("double") - F.lit(stats[n][0])) / F.lit(stats[n][1])).alias(n) if n in stats else c(n)
            for n in df.columns
        ]
    )
