"""Train/test splits and folds without sorting or shuffling the table.

A split "first n rows in this order" only needs the order value of row n. That cut is
found by counting rows per cell of the value range and narrowing down to the cell that
holds it, so only histograms move; the split itself is then a filter. The cut is kept as
literal values, which makes the split repeatable when a stage is recomputed. Classes with more
than `hot_rows` rows are split at such cuts too; only rows that are equal in all sort columns
and share a cut are numbered.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import Series
from ..functions.columns import c, cols
from .series import axis, drop_slices, may_be_hot, row_index, settled

CELLS = 4096
FINISH_ROWS = 100_000
CUT_CLASSES = 32
TRAIN, TEST = "train", "test"


def _place(df: DataFrame, name: str, lo) -> Column:
    """A double that grows with the column, measured from its least value `lo`, so that a narrow range is told apart exactly."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.IntegralType):
        return (c(name).cast("decimal(38,0)") - F.lit(lo).cast("decimal(38,0)")).cast("double")
    return axis(df, name)


def cut_point(df: DataFrame, columns: Sequence[str], rank: int, finish_rows: int = FINISH_ROWS) -> tuple:
    """Values of `columns` in the row at 1-based `rank` of the table sorted by them.

    Any sortable type; NULLs sort first, NaN last. Ranges are halved where values share their
    place on the axis (long common beginnings of texts). At most CELLS counts or one final row
    reach the driver.
    """
    rest = df.select(*cols(columns))
    values: list = []
    for name in columns:
        kind = df.schema[name].dataType
        floating = isinstance(kind, (T.DoubleType, T.FloatType))
        while True:
            x = c(name)
            n, given, lo, hi = rest.agg(F.count(F.lit(1)), F.count(x), F.min(x), F.max(x)).first()
            if n <= finish_rows:
                return tuple(values) + _finish(rest, columns[len(values) :], rank)
            if rank <= n - given:
                rest = rest.where(x.isNull())
                values.append(None)
                break
            if given < n:
                rank -= n - given
                rest = rest.where(x.isNotNull())
                continue
            if lo == hi or (floating and math.isnan(lo)):
                values.append(lo)
                break
            if floating and not (math.isfinite(lo) and math.isfinite(hi)):
                # -inf, numbers, +inf and NaN are ranges of their own, in this order
                groups = F.when(F.isnan(x), 3).when(x == float("inf"), 2).when(x == float("-inf"), 0).otherwise(1)
                rank, rest = _narrowed(rest, groups, rank)
                continue
            at = _place(rest, name, lo)
            low, high = rest.agg(F.min(at), F.max(at)).first()
            if low == high:
                # equal on the axis, not in fact: split at a value of the column itself
                middle = rest.where(x < F.lit(hi).cast(kind)).agg(F.max(x)).first()[0]
                rank, rest = _narrowed(rest, F.when(x <= F.lit(middle).cast(kind), 0).otherwise(1), rank)
                continue
            share = (at - F.lit(low)) / F.lit(high - low) * F.lit(float(CELLS))
            rank, rest = _narrowed(rest, F.least(F.floor(share), F.lit(CELLS - 1)), rank)
    return tuple(values)


def _narrowed(rest: DataFrame, cell: Column, rank: int) -> tuple[int, DataFrame]:
    """The cell that holds the row at `rank`, and the rank in it."""
    for at, count in sorted(map(tuple, rest.groupBy(cell.alias("cell")).count().collect())):
        if rank <= count:
            return rank, rest.where(cell == at)
        rank -= count
    raise ValueError("rank beyond the table")


def _finish(rest: DataFrame, columns: Sequence[str], rank: int) -> tuple:
    """The row at `rank` among at most `finish_rows` rows."""
    if not columns:
        return ()
    ranked = rest.select(*cols(columns), F.row_number().over(Window.orderBy(*cols(columns))).alias("__rank"))
    return tuple(ranked.where(F.col("__rank") == rank).drop("__rank").first())


def _literal(df: DataFrame, name: str, v) -> Column:
    """A value that was read from the column. Times without zone go by their text, whatever the time zones."""
    kind = df.schema[name].dataType
    return F.lit(str(v) if isinstance(kind, T.TimestampNTZType) else v).cast(kind)


def _equal(df: DataFrame, columns: Sequence[str], values: Sequence) -> Column:
    return reduce(lambda a, b: a & b, [c(n).eqNullSafe(_literal(df, n, v)) for n, v in zip(columns, values)])


def not_after(df: DataFrame, columns: Sequence[str], values: Sequence) -> Column:
    """(columns) <= (values) in sort order, NULLs first."""
    result = F.lit(True)
    for name, v in reversed(list(zip(columns, values))):
        if v is None:
            result = c(name).isNull() & result
        else:
            at = _literal(df, name, v)
            result = c(name).isNull() | (c(name) < at) | ((c(name) == at) & result)
    return F.coalesce(result, F.lit(False))


def chronological_split(
    df: DataFrame, series: Series, train_fraction: float = 0.8, name: str = "split", finish_rows: int = FINISH_ROWS
) -> DataFrame:
    """First int(fraction * n) rows in time order train, the rest test."""
    columns = [series.order, *series.tiebreak]
    n_train = int(train_fraction * df.count())
    if n_train == 0:
        return df.withColumn(name, F.lit(TEST))
    cut = cut_point(df, columns, n_train, finish_rows)
    return df.withColumn(name, F.when(not_after(df, columns, cut), TRAIN).otherwise(TEST))


def spread_key(id_column: str, seed: int) -> Column:
    """52 pseudo-random bits per id, the same in every engine that has md5."""
    text = F.concat(c(id_column).cast("string"), F.lit(f"-{seed}"))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")


def _placed(df: DataFrame, label: str, order: str, tiebreak: Sequence[str], hot_rows: int | None) -> DataFrame:
    """Add __place, the 1-based position of a row in its class. Large classes are cut into slices."""
    return drop_slices(row_index(df, Series((label,), order, tuple(tiebreak), hot_rows), "__place"))


def _few_hot_classes(df: DataFrame, label: str, hot_rows: int | None) -> bool:
    """Whether a class is too large for one task, and the classes are so few that each can have its cuts."""
    if hot_rows is None or not may_be_hot(df, Series((), label, (), hot_rows)):
        return False
    sizes = df.where(c(label).isNotNull()).groupBy(c(label).alias("__class")).count()
    largest = sizes.orderBy(F.col("count").desc()).limit(CUT_CLASSES + 1).collect()
    return 0 < len(largest) <= CUT_CLASSES and largest[0]["count"] > hot_rows


def _blocks(
    df: DataFrame, label: str, columns: Sequence[str], ends: dict, hot_rows: int | None, finish_rows: int = FINISH_ROWS
) -> DataFrame:
    """Add __block: how many of the `ends` of its class are before the 1-based place of a row in the order of `columns`.

    `ends` has a list of places per class. Each place becomes a cut value, so that blocks are
    conditions on the shortest list of columns that tells them apart. Rows equal in all columns that share a cut
    are numbered among themselves.
    """
    wanted = sorted({(y, e) for y, places in ends.items() for e in places}, key=str)
    sizes = df.agg(*[F.count_if(c(label) == F.lit(y)).alias(f"n{i}") for i, (y, _) in enumerate(wanted)]).first()
    inner = [(y, e) for i, (y, e) in enumerate(wanted) if 0 < e < sizes[i]]
    cuts = {(y, e): cut_point(df.where(c(label) == F.lit(y)), columns, e, finish_rows) for y, e in inner}
    counted = [(y, e, k, v[:k]) for (y, e), v in cuts.items() for k in range(1, len(columns) + 1)]
    sums = [F.count_if((c(label) == F.lit(y)) & not_after(df, columns, v)).alias(f"c{i}") for i, (y, _, _, v) in enumerate(counted)]
    sums += [F.count_if((c(label) == F.lit(y)) & _equal(df, columns, v)).alias(f"e{i}") for i, ((y, _), v) in enumerate(cuts.items())]
    found = df.agg(*sums).first() if sums else ()
    upto = {(y, e, k): found[i] for i, (y, e, k, _) in enumerate(counted)}
    equal = {at: found[len(counted) + i] for i, at in enumerate(cuts)}

    block = F.lit(None).cast("int")
    shared: dict = {}  # (class, place) whose cut falls among equal rows -> rows before those
    for y, places in ends.items():
        beyond = []
        for e in places:
            if (y, e) not in cuts:
                beyond.append(F.lit(int(e <= 0)))
                continue
            exact = next((k for k in range(1, len(columns) + 1) if upto[y, e, k] == e), None)
            if exact is None:
                shared[y, e] = upto[y, e, len(columns)] - equal[y, e]
            beyond.append((~not_after(df, columns, cuts[y, e][:exact])).cast("int"))
        block = F.when(c(label) == F.lit(y), reduce(lambda a, b: a + b, beyond)).otherwise(block)
    if not shared:
        return df.select("*", block.alias("__block"))
    groups = {at: F.coalesce((c(label) == F.lit(at[0])) & _equal(df, columns, cuts[at]), F.lit(False)) for at in shared}
    in_group = reduce(lambda a, b: a | b, groups.values())
    order, *tiebreak = columns
    tied = drop_slices(row_index(df.where(in_group), Series((label, *columns), order, tuple(tiebreak), hot_rows), "__place"))
    block_of = F.lit(None).cast("int")
    for (y, e), inside in groups.items():
        place = F.col("__place") + F.lit(shared[y, e])
        block_of = F.when(inside, reduce(lambda a, b: a + b, [(place > end).cast("int") for end in ends[y]])).otherwise(block_of)
    # settled, as equal rows may be numbered otherwise when a stage is recomputed
    numbered = settled(tied.select(*cols(df.columns), block_of.alias("__block")))
    return df.where(~in_group).select("*", block.alias("__block")).unionByName(numbered)


def _of_class(df: DataFrame, classes: DataFrame, label: str) -> DataFrame:
    """Join one row per class (__class, ...); rows without a label keep NULLs."""
    return df.join(classes, c(label) == F.col("__class"), "left")


def stratified_split(
    df: DataFrame,
    label: str,
    id_column: str,
    test_fraction: float = 0.2,
    seed: int = 42,
    name: str = "split",
    hot_rows: int | None = 1_000_000,
    spread: str | None = None,
    finish_rows: int = FINISH_ROWS,
) -> DataFrame:
    """Random split with exact per-class counts: per class, the rows of lowest hash train.

    Training rows are shared out to the classes in proportion, by largest remainder. Rows
    without a label get no split. `spread` names a column that already has the hash, `spread_key` of the id and seed.
    """
    sizes = df.where(c(label).isNotNull()).groupBy(c(label).alias("__class")).agg(F.count(F.lit(1)).alias("__n"))
    # windows over one row per class
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("__n").over(whole)
    draws = total - F.ceil(F.lit(test_fraction) * total)
    exact = F.col("__n") * draws / total
    shares = sizes.select("*", draws.alias("__draws"), exact.alias("__exact"), F.floor(exact).alias("__floor"))
    by_remainder = Window.orderBy((F.col("__floor") - F.col("__exact")).asc(), "__class")
    more = F.row_number().over(by_remainder) <= F.col("__draws") - F.sum("__floor").over(whole)
    train = shares.select("__class", (F.col("__floor") + more.cast("long")).alias("__train"))
    order = spread or "__h"
    hashed = df if spread else df.withColumn("__h", spread_key(id_column, seed))
    if _few_hot_classes(df, label, hot_rows):
        ends = {y: [n] for y, n in train.collect()}  # CUT_CLASSES rows at most
        side = F.when(F.col("__block") == 0, TRAIN).when(F.col("__block") == 1, TEST)
        return _blocks(hashed, label, [order, id_column], ends, hot_rows, finish_rows).select(*cols(df.columns), side.alias(name))
    placed = _placed(hashed, label, order, [id_column], hot_rows)
    side = F.when(F.col("__place") <= F.col("__train"), TRAIN).when(F.col("__train").isNotNull(), TEST)
    return _of_class(placed, train, label).select(*cols(df.columns), side.alias(name))


def stratified_folds(
    df: DataFrame,
    label: str,
    series: Series,
    folds: int = 3,
    name: str = "fold",
    hot_rows: int | None = 1_000_000,
    finish_rows: int = FINISH_ROWS,
) -> DataFrame:
    """Unshuffled stratified folds: per class, consecutive blocks in time order.

    Classes are laid end to end in order of first appearance and dealt out to the
    folds one by one; a class gives each fold as many rows as it was dealt. Rows without a
    label get no fold.
    """
    columns = [series.order, *series.tiebreak]
    classes = (
        df.where(c(label).isNotNull())
        .groupBy(c(label).alias("__class"))
        .agg(F.count(F.lit(1)).alias("__n"), F.min(F.struct(*cols(columns))).alias("__first"))
    )
    before = Window.orderBy("__first").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("__n").over(before), F.lit(0))
    classes = classes.select("__class", "__n", offset.alias("__offset"))
    # fold i was dealt every folds-th place from (i - offset) mod folds on
    dealt = [F.ceil((F.col("__n") - F.pmod(F.lit(i) - F.col("__offset"), F.lit(folds))) / folds) for i in range(folds)]
    ends = [sum(dealt[1 : i + 1], dealt[0]) for i in range(folds - 1)]
    if ends and _few_hot_classes(df, label, hot_rows):
        by_class = {y: places for y, *places in classes.select("__class", *ends).collect()}  # CUT_CLASSES rows at most
        return _blocks(df, label, columns, by_class, hot_rows, finish_rows).select(*cols(df.columns), F.col("__block").alias(name))
    placed = _of_class(_placed(df, label, series.order, series.tiebreak, hot_rows), classes, label)
    fold = sum(((F.col("__place") > end).cast("int") for end in ends), F.lit(0))
    return placed.select(*cols(df.columns), F.when(F.col("__n").isNotNull(), fold).alias(name))
