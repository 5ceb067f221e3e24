"""Small column helpers shared by every operator."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def c(name: str) -> Column:
    """Reference a column whose name may hold spaces, brackets or dots."""
    return F.col("`" + name.replace("`", "``") + "`")


def cols(names: Iterable[str]) -> list[Column]:
    return [c(n) for n in names]


def rounded(value: Column, digits: int) -> Column:
    """Round and turn -0.0 into 0.0, so equal results compare equal."""
    return F.round(value, digits) + F.lit(0.0)


def sigmoid(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def logit(p: Column) -> Column:
    return F.ln(p / (F.lit(1.0) - p))


def ratio(num: Column, den: Column) -> Column:
    """num / den, NULL when the denominator is 0."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_numeric(f.dataType)]


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN poisons avg/stddev in Spark, while NULL is skipped."""
    return df.select(
        *[
            F.when(~F.isnan(c(f.name)), c(f.name)).alias(f.name)
            if isinstance(f.dataType, (T.DoubleType, T.FloatType))
            else c(f.name)
            for f in df.schema.fields
        ]
    )


def linspace(start: float, stop: float, num: int) -> list[float]:
    """`num` evenly spaced values with both ends included."""
    if num == 1:
        return [float(start)]
    step = (stop - start) / (num - 1)
    return [start + i * step for i in range(num - 1)] + [float(stop)]


def logspace(start: float, stop: float, num: int) -> list[float]:
    return [10.0**e for e in linspace(start, stop, num)]
