"""Linear risk scores as column expressions (no Python in the tasks)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .columns import c, sigmoid

TABLE_SCHEMA = "model string, position long, feature string, coefficient double, center double, scale double, intercept double"


@dataclass(frozen=True)
class LinearModel:
    """Logistic model over robust-scaled features: z = b0 + sum b * (x - center) / scale."""

    name: str
    features: tuple[str, ...]
    coefficients: tuple[float, ...]
    centers: tuple[float, ...]
    scales: tuple[float, ...]
    intercept: float

    def logit(self) -> Column:
        # a missing input, NULL or NaN, counts as 0, as everywhere at serving time
        terms = [
            F.lit(b) * (F.coalesce(F.nanvl(c(n).cast("double"), F.lit(0.0)), F.lit(0.0)) - F.lit(m)) / F.lit(s)
            for n, b, m, s in zip(self.features, self.coefficients, self.centers, self.scales)
            if b != 0.0
        ]
        return reduce(lambda a, t: a + t, terms, F.lit(self.intercept))

    def probability(self) -> Column:
        return sigmoid(self.logit())

    def rows(self) -> list[tuple]:
        return [
            (self.name, i, n, b, m, s, self.intercept)
            for i, (n, b, m, s) in enumerate(zip(self.features, self.coefficients, self.centers, self.scales))
        ]


def coefficient_table(spark: SparkSession, models: Sequence[LinearModel]) -> DataFrame:
    return spark.createDataFrame([r for m in models for r in m.rows()], TABLE_SCHEMA)


def models_from_table(table: DataFrame) -> list[LinearModel]:
    """Read models back; the table has one row per model and feature."""
    found: dict[str, list] = {}
    for r in sorted(table.collect(), key=lambda r: (r["model"], r["position"])):
        found.setdefault(r["model"], []).append(r)
    return [
        LinearModel(
            name,
            tuple(r["feature"] for r in rows),
            tuple(r["coefficient"] for r in rows),
            tuple(r["center"] for r in rows),
            tuple(r["scale"] for r in rows),
            rows[0]["intercept"],
        )
        for name, rows in found.items()
    ]
