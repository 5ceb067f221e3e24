"""First look at a sensor table: counts, moments, quantiles, missing values, classes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import c, numeric_columns, ratio
from .quantiles import exact_quantiles, present


def _tall(row: DataFrame, columns: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Turn one wide row of `{field}{i}` columns into one row per profiled column."""
    return row.select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(n).alias("column"), *[F.col(f"{f}{i}").alias(f) for f in fields])
                    for i, n in enumerate(columns)
                ]
            )
        )
    )


def non_null_counts(df: DataFrame) -> DataFrame:
    row = df.agg(*[F.count(present(df, n)).alias(f"count{i}") for i, n in enumerate(df.columns)])
    return _tall(row, df.columns, ["count"])


def missing_fractions(df: DataFrame) -> DataFrame:
    """Share of missing values per column, largest first."""
    row = df.agg(
        *[
            F.avg(present(df, n).isNull().cast("int")).alias(f"missing{i}")
            for i, n in enumerate(df.columns)
        ]
    )
    return _tall(row, df.columns, ["missing"]).orderBy(F.desc("missing"), "column")


def describe(df: DataFrame, columns: Sequence[str] | None = None, approx: bool = False) -> DataFrame:
    """count, mean, std, min, quartiles and max of numeric columns.

    Quartiles are exact with linear interpolation; approx=True takes them from a
    sketch in the same single pass.
    """
    columns = list(columns or numeric_columns(df))
    fields = ["count", "mean", "std", "min", "max", *(["q"] if approx else [])]
    aggregates = []
    for i, n in enumerate(columns):
        x = present(df, n).cast("double")
        aggregates += [
            F.count(x).alias(f"count{i}"),
            F.avg(x).alias(f"mean{i}"),
            F.stddev_samp(x).alias(f"std{i}"),
            F.min(x).alias(f"min{i}"),
            F.max(x).alias(f"max{i}"),
        ]
        if approx:
            aggregates.append(F.percentile_approx(x, [0.25, 0.5, 0.75]).alias(f"q{i}"))
    tall = _tall(df.agg(*aggregates), columns, fields)
    if not approx:
        quartiles = exact_quantiles(df, columns, (0.25, 0.5, 0.75)).select("column", F.col("quantiles").alias("q"))
        tall = tall.join(quartiles, "column", "left")
    return tall.select(
        "column", "count", "mean", "std", "min",
        F.col("q")[0].alias("p25"), F.col("q")[1].alias("p50"), F.col("q")[2].alias("p75"), "max",
    )


def column_types(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame(df.dtypes, "column string, dtype string")


def class_frequency(df: DataFrame, label: str, dropna: bool = True) -> DataFrame:
    """Rows per class, most frequent first."""
    kept = df.where(c(label).isNotNull()) if dropna else df
    return (
        kept.groupBy(c(label).alias("class")).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "class")
    )


def shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("rows")).select("rows", F.lit(len(df.columns)).cast("long").alias("columns"))


def imbalance(df: DataFrame, label: str) -> DataFrame:
    """Negatives, positives and their ratio."""
    return df.agg(
        F.count_if(c(label) == 0).alias("negatives"), F.count_if(c(label) == 1).alias("positives")
    ).select("negatives", "positives", ratio(F.col("negatives"), F.col("positives")).alias("ratio"))


def feature_manifest(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Ordered feature names of a model, to be stored beside its metrics."""
    rows = [(i + 1, n, df.schema[n].dataType.simpleString()) for i, n in enumerate(features)]
    return df.sparkSession.createDataFrame(rows, "position long, feature string, dtype string")
