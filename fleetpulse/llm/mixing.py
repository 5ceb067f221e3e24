"""Mixing sources to target weights by balanced sampling with the cube method.

Every document of a source is wanted r = target / size of the source times. It is taken
floor(r) times for certain; the rest r - floor(r) is its inclusion probability in a balanced
sample. The cube method moves the probabilities of a few documents at a time along a direction
that changes neither the expected number of documents nor the expected number of words, until
one of them is 0 or 1. Blocks of documents do this independently; the two or so undecided
documents of each block meet in the next, smaller level, down to one block per source, where
the last ones are rounded to the nearest word total.

All draws come from hashes of the rows, so reruns agree.

Defined results: null or empty text has size 0 and is taken 0 words; a null source is a source
of its own, last; rows that repeat (same id, source and size) are one unit with a multiplicity;
a table without words has targets 0; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, settled

WEIGHTS = (5.0, 2.0, 1.0)
MAX_REPEATS = 3
BLOCK = 512
_SURE = 1e-9


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def source_targets(
    sized: DataFrame, weights: Sequence[float] = WEIGHTS, max_repeats: float = MAX_REPEATS
) -> DataFrame:
    """(source, source_size, target): one row per source of (source, size).

    Sources in code point order, null last, take the weights in turn and share all sizes. A target
    stops at max_repeats times its source's size and the excess is shared anew by weight: the water
    level L with sum(min(cap, weight * L)) = all sizes, found by running sums along cap / weight.
    Windows here run over one row per source.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cap = F.col("source_size") * float(max_repeats)
    ranked = totals.withColumn(
        "weight", F.element_at(cycle, (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    ).withColumns({"cap": cap, "fills_at": cap / F.col("weight")})
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_fill = Window.orderBy("fills_at", F.col("source").asc_nulls_last())
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    levels = ranked.withColumn(
        "level",
        (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        / F.sum("weight").over(onward),
    )
    # the first source that is not filled sets the level for itself and all after it
    open_level = F.when(F.col("fills_at") > F.col("level"), F.col("level"))
    levels = levels.withColumn("water", F.first(open_level, ignorenulls=True).over(everything.orderBy("fills_at")))
    return levels.select(
        "source",
        "source_size",
        F.coalesce(F.least("cap", F.col("weight") * F.col("water")), F.col("cap")).alias("target"),
    )


def _uniform(seed: int, level: int, step: np.ndarray) -> np.ndarray:
    return np.random.Generator(np.random.Philox(key=[seed & (2**63 - 1), level])).random(len(step))


def flight(p: np.ndarray, size: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """Flight phase: probabilities moved to 0 or 1 but for at most two, keeping sum(p) and sum(p * size).

    Three undecided units span a plane through both constraints with one free direction.
    """
    p = p.copy()
    waiting = [i for i in range(len(p)) if _SURE < p[i] < 1 - _SURE]
    x, s = p.tolist(), size.tolist()
    at, held = 0, []
    for draw in draws.tolist():
        while len(held) < 3 and at < len(waiting):
            held.append(waiting[at])
            at += 1
        if len(held) < 3:
            break
        a, b, c = held
        # null vector of ((1, 1, 1), sizes)
        u = (s[b] - s[c], s[c] - s[a], s[a] - s[b])
        if u == (0, 0, 0):
            u = (1, -1, 0)
        top = max(abs(v) for v in u)
        u = [v / top for v in u]
        up = min((1 - x[i]) / v if v > 0 else x[i] / -v for i, v in zip(held, u, strict=True) if v)
        down = min(x[i] / v if v > 0 else (1 - x[i]) / -v for i, v in zip(held, u, strict=True) if v)
        move = up if draw * (up + down) < down else -down
        for i, v in zip(held, u, strict=True):
            x[i] = min(1.0, max(0.0, x[i] + move * v))
            if x[i] <= _SURE or x[i] >= 1 - _SURE:
                x[i] = round(x[i])
        held = [i for i in held if 0 < x[i] < 1]
    return np.array(x)


def landing(p: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Undecided units rounded so that the words come as near as they can, the largest first."""
    out = np.where(p >= 1 - _SURE, 1.0, np.where(p <= _SURE, 0.0, p))
    owed = float(np.sum((p - np.floor(p + _SURE)) * size * ((out > 0) & (out < 1))))
    for i in sorted(np.flatnonzero((out > 0) & (out < 1)), key=lambda i: (-size[i], i)):
        take = abs(owed - size[i]) < abs(owed) or (size[i] == 0 and p[i] >= 0.5)
        out[i] = float(take)
        owed -= take * size[i]
    return out


def _level(units: DataFrame, level: int, block: int) -> DataFrame:
    """One round of independent flights; where a source is one block, its landing too."""

    def fly(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["tie", "doc_id", "size"], kind="stable", na_position="first")
        p, size = rows["p"].to_numpy(float), rows["size"].to_numpy(float)
        seed = int(rows["tie"].iloc[0])
        p = flight(p, size, _uniform(seed, level, p))
        if rows["blocks"].iloc[0] == 1:
            p = landing(p, size)
        return rows.assign(p=p)[["source", "doc_id", "size", "copies", "sure", "tie", "p"]]

    per_source = units.groupBy("source").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    place = F.pmod(F.xxhash64("tie", F.lit(level)), F.col("blocks"))
    counted = units.alias("u").join(per_source.alias("s"), F.col("u.source").eqNullSafe(F.col("s.source")))
    counted = counted.select("u.*", "s.blocks").withColumn("block", place)
    return counted.groupBy("source", "block").applyInPandas(
        fly, "source string, doc_id string, size long, copies long, sure long, tie long, p double"
    )


def copies(sized: DataFrame, targets: DataFrame, max_repeats: int = MAX_REPEATS, block: int = BLOCK) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies): how often the mix takes each row of (doc_id, source, size)."""
    units = sized.groupBy("source", "doc_id", "size").agg(F.count("*").alias("copies"))
    u, t = units.alias("u"), targets.alias("t")
    wanted = u.join(t, F.col("u.source").eqNullSafe(F.col("t.source"))).select("u.*", "t.source_size", "t.target")
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(max_repeats))))
    # copies of one row: whole repeats for each, then whole rows of what is left, then one fraction
    rate = F.coalesce(rate, F.lit(0.0))
    whole = F.floor(rate + _SURE)
    rest = F.greatest(F.lit(0.0), rate - whole) * F.col("copies")
    units = wanted.select(
        "source",
        F.col("doc_id").cast("string").alias("doc_id"),  # pandas would turn null ids into floats
        "size",
        "copies",
        F.floor(rest + _SURE).cast("long").alias("sure"),
        F.xxhash64("source", "doc_id", "size").alias("tie"),
        F.greatest(F.lit(0.0), rest - F.floor(rest + _SURE)).alias("p"),
    )
    done, level = [], 0
    while True:
        moved = settled(_level(units, level, block), f"cube-{level}")
        undecided = (F.col("p") > _SURE) & (F.col("p") < 1 - _SURE)
        done.append(moved.filter(~undecided))
        units, level = moved.filter(undecided), level + 1
        # at most two units of a block are left, so a few levels end it
        if units.isEmpty():
            break
    chosen = done[0]
    for part in done[1:]:
        chosen = chosen.unionByName(part)
    chosen = chosen.withColumn("extra", F.col("sure") + F.round("p").cast("long"))
    d, t = chosen.alias("d"), targets.alias("t")
    chosen = d.join(t, F.col("d.source").eqNullSafe(F.col("t.source"))).select("d.*", "t.source_size", "t.target")
    each = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(max_repeats))))
    whole = F.floor(F.coalesce(rate, F.lit(0.0)) + _SURE).cast("long")
    return chosen.select("*", each.alias("nth")).select(
        F.col("doc_id").cast(sized.schema["doc_id"].dataType).alias("doc_id"),
        "source",
        "size",
        "source_size",
        "target",
        (whole + (F.col("nth") <= F.col("extra")).cast("long")).alias("copies"),
    )


def mix(
    docs: DataFrame, weights: Sequence[float] = WEIGHTS, max_repeats: int = MAX_REPEATS, block: int = BLOCK
) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies) of every document; its words are taken `copies` times."""
    sized = settled(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "sizes")
    targets = settled(source_targets(sized, weights, max_repeats), "targets")
    return copies(sized, targets, max_repeats, block)


def mixed_documents(
    docs: DataFrame, weights: Sequence[float] = WEIGHTS, max_repeats: int = MAX_REPEATS, block: int = BLOCK
) -> DataFrame:
    """The rows of `docs`, each as often as the mix takes it; rows that it does not take are left out."""
    unit = F.xxhash64("source", "doc_id", "__size")
    taken = mix(docs, weights, max_repeats, block).withColumnRenamed("size", "__size")
    # rows of one unit are told apart by their place among its texts
    per_unit = taken.groupBy(unit.alias("__unit")).agg(F.min("copies").alias("__each"), F.sum("copies").alias("__all"), F.count("*").alias("__rows"))
    sized = docs.withColumn("__size", word_count(F.col("text"))).withColumn("__unit", unit)
    place = Window.partitionBy("__unit").orderBy("text")
    both = sized.withColumn("__nth", F.row_number().over(place)).join(per_unit, "__unit")
    extra = (F.col("__nth") <= F.col("__all") - F.col("__each") * F.col("__rows")).cast("long")
    times = F.col("__each") + extra
    return both.filter(times > 0).select(*docs.columns, F.explode(F.sequence(F.lit(1).cast("long"), times)).alias("__copy")).select(docs.columns)
