"""Ordered computations over series of any size.

A plain ``Window.partitionBy(key)`` puts a whole series into one task, which
fails when one device (or the only device) holds a third of the data. Here a
series with more than ``Series.hot_rows`` rows is cut into slices of its time
axis, each slice is windowed on its own, and what crosses a slice border is
carried over exactly:

* bounded look-back (rolling features, smoothing): the last rows before a slice
  are copied into it as a halo and dropped again afterwards;
* unbounded prefixes (row number, running sums, streaks): every slice is reduced
  to one small record, the records are scanned in order, and the carried-in value
  is joined back.

Slice limits come from min, max and count and are kept as literal rows, so a
recomputed stage finds the same slices.

Size of what is broadcast: a series or slice is hot only when it holds more than
max(hot_rows, total / MAX_HOT) rows, so each level has fewer than MAX_HOT hot groups
and adds at most 4 * MAX_HOT slices, whatever the table size. The rows are counted before
they are broadcast, and joined without a broadcast beyond BROADCAST_ROWS.
"""

from __future__ import annotations

import itertools
import re
import tempfile
from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import Series
from ..functions.columns import c, cols

SLICE, HOT, HALO = "__slice", "__hot", "__halo"
MAX_HOT = 50_000
BROADCAST_ROWS = 1_000_000
OVERSPLIT = 2
# slice numbers stay below this; beyond it they are dealt anew, without gaps
SLICE_NUMBERS = 1 << 62


def axis(df: DataFrame, name: str) -> Column:
    """The order column as a double that never decreases along the order."""
    dtype = df.schema[name].dataType
    col = c(name)
    if isinstance(dtype, T.NumericType):
        return col.cast("double")
    if isinstance(dtype, T.DateType):
        return F.unix_date(col).cast("double")
    if isinstance(dtype, T.TimestampType):
        return F.unix_micros(col).cast("double")
    if isinstance(dtype, T.TimestampNTZType):
        # as the distance from a fixed point, so the session time zone plays no part
        since = col - F.lit("1970-01-01").cast("timestamp_ntz")
        return since.cast("interval second").cast("decimal(20,6)").cast("double")
    if isinstance(dtype, (T.StringType, T.BinaryType)):
        # the first bytes; texts sort by their bytes
        return F.conv(F.rpad(F.hex(F.substring(col.cast("binary"), 1, 6)), 12, "0"), 16, 10).cast("double")
    if isinstance(dtype, T.BooleanType):
        return col.cast("int").cast("double")
    raise ValueError(f"order column {name!r} has type {dtype.simpleString()}; use a number, text, date or time")


def partition_columns(df: DataFrame, series: Series) -> list[str]:
    return [*series.keys, *([SLICE] if SLICE in df.columns else [])]


def window(df: DataFrame, series: Series) -> WindowSpec:
    """The series window, by slice where the table has been sliced."""
    return Window.partitionBy(*cols(partition_columns(df, series))).orderBy(
        *cols((series.order, *series.tiebreak))
    )


def join_small(df: DataFrame, small: DataFrame, keys: list[str], how: str = "left", few: bool = False) -> DataFrame:
    """Join on NULL-safe keys, broadcasting the small side if it has BROADCAST_ROWS at most.

    `few` says that the caller knows it is a handful of rows; else they are counted.
    """
    if not few:
        small = settled(small)
        few = small.count() <= BROADCAST_ROWS
    renamed = small.select(
        *[c(k).alias(f"__k{i}") for i, k in enumerate(keys)],
        *[c(n) for n in small.columns if n not in keys],
    )
    condition = reduce(
        lambda a, b: a & b, [c(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)]
    )
    joined = df.join(F.broadcast(renamed) if few else renamed, condition, how)
    return joined.drop(*[f"__k{i}" for i in range(len(keys))])


def _axes(df: DataFrame, series: Series) -> tuple[Column, Column]:
    """The order axis, and the first tie-break axis for rows of equal order."""
    x = axis(df, series.order)
    try:
        y = axis(df, series.tiebreak[0]) if series.tiebreak else F.lit(None).cast("double")
    except ValueError:
        y = F.lit(None).cast("double")
    return x, y


def _finite(x: Column) -> Column:
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)


def may_be_hot(df: DataFrame, series: Series) -> bool:
    """Whether the table is large enough to hold a hot series (a count, no shuffle)."""
    return series.hot_rows is not None and df.count() > series.hot_rows


def settled(df: DataFrame) -> DataFrame:
    """The table written once to the shared checkpoint folder, so that several passes
    over it do not repeat what computed it and lost executors cost no recomputation."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder, which all executors share. Only local runs get one of their own."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="fleetpulse-"))
    return context.getCheckpointDir().rstrip("/")


def slice_series(df: DataFrame, series: Series) -> DataFrame:
    """Add SLICE (place of the slice in its series) and HOT, if any series is hot.

    One small aggregate job finds out. Tables without a hot series come back as they
    are. Slices are equally wide in time; a slice that is still too full (a burst) is
    cut again by the same rule, along the tie-break column where all times are equal.
    """
    if SLICE in df.columns or not may_be_hot(df, series):
        return df
    x, y = _axes(df, series)
    counts = df.groupBy(*cols(series.keys)).count()
    total, largest = counts.agg(F.sum("count"), F.max("count")).first()
    limit = max(float(series.hot_rows), (total or 0.0) / MAX_HOT)
    if (largest or 0.0) <= limit:
        return df
    out = df.withColumn(SLICE, F.lit(0).cast("long")).withColumn(HOT, F.lit(False))
    slices = 1
    for level in itertools.count():
        keys = [*series.keys, *([SLICE] if level else [])]
        sizes = (out.where(F.col(HOT)) if level else out).groupBy(*cols(keys)).agg(
            F.count(F.lit(1)).cast("double").alias("__n"),
            F.count(x).alias("__given"),
            F.count(_finite(x)).alias("__finite"),
            (F.min(c(series.order)) == F.max(c(series.order))).alias("__one"),
            *[f(_finite(a)).alias(n) for f, a, n in (
                (F.min, x, "__lo"), (F.max, x, "__hi"), (F.min, y, "__lo2"), (F.max, y, "__hi2"))],
        )
        mixed = (F.col("__finite") > 0) & (F.col("__finite") < F.col("__n"))
        by_order = F.coalesce(F.col("__hi") > F.col("__lo"), F.lit(False)) | mixed
        # equal on the axis is not enough: texts and large integers may still differ
        equal_order = ((F.col("__finite") == F.col("__n")) & F.col("__one")) | (F.col("__given") == 0)
        by_tie = ~by_order & equal_order & F.coalesce(F.col("__hi2") > F.col("__lo2"), F.lit(False))
        full = sizes.where((F.col("__n") > limit) & (by_order | by_tie)).select(
            *cols(keys),
            F.when(by_order, F.col("__lo")).otherwise(F.col("__lo2")).alias("__from"),
            F.when(by_order, F.col("__hi")).otherwise(F.col("__hi2")).alias("__to"),
            (F.ceil(F.col("__n") / limit) * OVERSPLIT).cast("double").alias("__parts"),
            by_tie.alias("__tie"),
        )
        rows = full.collect()  # fewer than MAX_HOT rows, see above
        if not rows:
            break
        parts = int(max(r["__parts"] for r in rows))
        if level and slices * parts >= SLICE_NUMBERS:
            # few: a level makes at most OVERSPLIT parts for each `limit` rows, and `limit` is a part of all rows
            used = sorted(r[0] for r in out.where(F.col(HOT)).select(SLICE).distinct().collect())
            nth = {old: new for new, old in enumerate(used)}
            numbers = df.sparkSession.createDataFrame(list(nth.items()), f"{SLICE} long, __nth long")
            out = join_small(out, numbers, [SLICE], few=len(nth) <= BROADCAST_ROWS)
            out = out.withColumn(SLICE, F.coalesce("__nth", F.lit(0).cast("long"))).drop("__nth")
            rows = [{**r.asDict(), SLICE: nth[r[SLICE]]} for r in rows]
            slices = len(nth)
        slices *= parts
        found = df.sparkSession.createDataFrame(rows, full.schema)
        if keys:
            out = join_small(out, found, keys, few=len(rows) <= BROADCAST_ROWS)
        else:
            one = rows[0]
            out = out.select(
                "*", *[F.lit(one[n]).cast(full.schema[n].dataType).alias(n) for n in full.columns]
            )
        # part 0 takes NULL and -inf, the last part NaN and +inf, as in the sort order
        value = F.when(F.col("__tie"), y).otherwise(x)
        width = F.col("__to") - F.col("__from")
        inner = F.col("__parts") - 2
        place = F.when(
            width > 0, F.least(F.floor((_finite(value) - F.col("__from")) / width * inner).cast("double"), inner - 1)
        ).otherwise(F.lit(0.0))
        part = (
            F.when(F.col("__parts").isNull() | value.isNull() | (value == F.lit(float("-inf"))), F.lit(0.0))
            .when(_finite(value).isNull(), F.col("__parts") - 1)
            .otherwise(place + 1)
            .cast("long")
        )
        hot = F.col(HOT) if level else F.col("__parts").isNotNull()
        out = out.select(
            *cols(df.columns), (F.col(SLICE) * F.lit(parts) + part).alias(SLICE), hot.alias(HOT)
        )
    return out


def decided(df: DataFrame, series: Series) -> tuple[DataFrame, Series]:
    """Slice once for a chain of operators: the table, and the series to pass them."""
    sliced = slice_series(df, series)
    return sliced, series if SLICE in sliced.columns else replace(series, hot_rows=None)


def drop_slices(df: DataFrame) -> DataFrame:
    return df.drop(SLICE, HOT)


def with_lookback(
    df: DataFrame,
    series: Series,
    rows: int,
    add: Callable[[DataFrame, WindowSpec], DataFrame],
) -> DataFrame:
    """Apply ``add(table, window)``, which may look at ``rows`` preceding rows.

    The result keeps the slice columns for operators that follow; remove them with
    ``drop_slices``.
    """
    df = slice_series(df, series)
    if SLICE not in df.columns:
        return add(df, window(df, series))

    keys = list(series.keys)
    latest_first = Window.partitionBy(*cols([*keys, SLICE])).orderBy(
        *[c(n).desc() for n in (series.order, *series.tiebreak)]
    )
    # The filter on row_number becomes a top-k per slice inside the map tasks.
    tails = (
        df.where(F.col(HOT))
        .withColumn("__back", F.row_number().over(latest_first))
        .where(F.col("__back") <= rows)
    )
    packed = tails.groupBy(*cols([*keys, SLICE])).agg(
        F.sort_array(
            F.collect_list(
                F.struct((-F.col("__back")).alias("at"), F.struct(*cols(df.columns)).alias("row"))
            )
        ).alias("__tail")
    )
    # Each earlier slice holds at least one row, so `rows` slices back are enough.
    before = Window.partitionBy(*cols(keys)).orderBy(SLICE).rowsBetween(-rows, -1)
    carried = packed.select(
        *cols([*keys, SLICE]), F.flatten(F.collect_list("__tail").over(before)).alias("__rows")
    ).select(
        F.col(SLICE).alias("__target"),
        F.explode(F.slice("__rows", F.greatest(F.size("__rows") - rows + 1, F.lit(1)), rows)).alias("__h"),
    )
    halo = carried.select(
        *[
            (F.col("__target") if n == SLICE else F.col("__h.row")[n]).alias(n)
            for n in df.columns
        ],
        F.lit(True).alias(HALO),
    )
    both = df.withColumn(HALO, F.lit(False)).unionByName(halo)
    return add(both, window(both, series)).where(~F.col(HALO)).drop(HALO)


def running_sums(df: DataFrame, series: Series, sums: dict[str, Column]) -> DataFrame:
    """Add inclusive running sums along each series (two levels for cut series)."""
    df = slice_series(df, series)
    running = window(df, series).rowsBetween(Window.unboundedPreceding, 0)
    out = df.select("*", *[F.sum(e).over(running).alias(n) for n, e in sums.items()])
    if SLICE not in df.columns:
        return out

    # read twice: the slice totals and the result
    out = settled(out)
    keys = [*series.keys, SLICE]
    added = {n: f"__added{i}" for i, n in enumerate(sums)}
    totals = out.where(F.col(HOT)).select(*cols(keys), *[e.alias(added[n]) for n, e in sums.items()])
    totals = totals.groupBy(*cols(keys)).agg(*[F.sum(a).alias(n) for n, a in added.items()])
    earlier = (
        Window.partitionBy(*cols(series.keys)).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = totals.select(*cols(keys), *[F.sum(c(n)).over(earlier).alias(f"__before_{n}") for n in sums])
    joined = join_small(out, offsets, keys)
    return joined.select(
        *cols(df.columns),
        *[(c(n) + F.coalesce(c(f"__before_{n}"), F.lit(0))).alias(n) for n in sums],
    )


def row_index(df: DataFrame, series: Series, name: str = "step") -> DataFrame:
    """1-based position of every row in its series."""
    return running_sums(df, series, {name: F.lit(1).cast("long")})


def _counter(at: Column, island: Column, best: Column) -> Column:
    """Counter value from the best start known in the current island.

    Before the first reset the counter also grows from 0 at position 0.
    """
    started = best["value"] + at
    return F.when(island == 0, F.greatest(F.coalesce(started, at), at)).otherwise(started)


def streaks(
    df: DataFrame, series: Series, reset: Column, floor: Column, name: str = "streak", step: str | None = None
) -> DataFrame:
    """Counter that restarts at 0 on `reset`, else grows by one, and is raised to
    at least `floor` where that is not NULL (after the reset or step).

    Every step maps s to max(s + a, b); such maps compose, so the counter at row t is
    ``t + max(b_j - j)`` over the rows j since the last reset. Comparing
    (number of resets, b - position) as a struct keeps only the current island, in the
    same window and sort as everything else. `step` also adds the row number, which
    needs no carry of its own.
    """
    df = slice_series(df, series)
    steps = [step] if step else []
    ordered = window(df, series)
    running = ordered.rowsBetween(Window.unboundedPreceding, 0)
    start = F.greatest(F.when(reset, F.lit(0)), floor).cast("long")

    counted = df.select(
        "*",
        F.row_number().over(ordered).cast("long").alias("__at"),
        F.sum(F.when(reset, F.lit(1)).otherwise(F.lit(0))).over(running).alias("__island"),
        start.alias("__start"),
    )
    counted = counted.select(
        "*",
        F.max(
            F.struct(F.col("__island").alias("island"), (F.col("__start") - F.col("__at")).alias("value"))
        ).over(running).alias("__best"),
    )
    local = counted.select(
        *cols(df.columns),
        F.col("__at"),
        F.col("__island"),
        (F.col("__best.value") + F.col("__at")).alias("__local"),
        _counter(F.col("__at"), F.col("__island"), F.col("__best")).alias(name),
    )
    if SLICE not in df.columns:
        return local.select(*cols(df.columns), c(name), *[F.col("__at").alias(n) for n in steps])

    # read twice: the slice records and the result; what computed the rows runs once
    local = settled(local)
    keys = [*series.keys, SLICE]
    reduced = local.where(F.col(HOT)).groupBy(*cols(keys)).agg(
        F.count(F.lit(1)).alias("__n"),
        F.max("__island").alias("__resets"),
        F.max_by("__local", "__at").alias("__out"),
    )
    by_slice = Window.partitionBy(*cols(series.keys)).orderBy(SLICE)
    so_far = by_slice.rowsBetween(Window.unboundedPreceding, 0)
    scanned = reduced.select(
        *cols(keys),
        F.col("__out"),
        F.sum("__n").over(so_far).alias("__end"),
        F.sum(F.when(F.col("__resets") > 0, 1).otherwise(0)).over(so_far).alias("__isl"),
    )
    scanned = scanned.select(
        *cols(keys),
        "__end",
        "__isl",
        F.max(
            F.struct(F.col("__isl").alias("island"), (F.col("__out") - F.col("__end")).alias("value"))
        ).over(so_far).alias("__b"),
    )
    carry = scanned.select(
        *cols(keys),
        F.lag(_counter(F.col("__end"), F.col("__isl"), F.col("__b")), 1).over(by_slice).alias("__carry"),
        F.lag("__end", 1).over(by_slice).alias("__before"),
    )
    joined = join_small(local, carry, keys)
    open_start = (F.col("__island") == 0) & F.col("__carry").isNotNull()
    return joined.select(
        *cols(df.columns),
        F.when(open_start, F.greatest(c(name), F.col("__carry") + F.col("__at")))
        .otherwise(c(name))
        .alias(name),
        *[(F.col("__at") + F.coalesce("__before", F.lit(0))).alias(n) for n in steps],
    )
