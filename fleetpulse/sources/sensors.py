"""Reading and writing sensor tables."""

from __future__ import annotations

import os
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..config import MACHINE_MODES, MACHINE_SENSORS, MACHINE_TARGET
from ..functions.columns import nan_to_null
from ..operators.series import shared_folder

_INTEGER_SENSORS = ("Rotational speed [rpm]", "Tool wear [min]")

MACHINE_SCHEMA = T.StructType(
    [
        T.StructField("UDI", T.LongType()),
        T.StructField("Product ID", T.StringType()),
        T.StructField("Type", T.StringType()),
        *[
            T.StructField(n, T.IntegerType() if n in _INTEGER_SENSORS else T.DoubleType())
            for n in MACHINE_SENSORS
        ],
        T.StructField(MACHINE_TARGET, T.IntegerType()),
        *[T.StructField(n, T.IntegerType()) for n in (*MACHINE_MODES, "RNF")],
    ]
)


def read_sensor_table(
    spark: SparkSession, path: str, fmt: str = "csv", schema: T.StructType | str | None = None
) -> DataFrame:
    """Read CSV (with header), parquet or any other Spark source; NaN becomes NULL.

    A schema avoids the extra pass that infers one.
    """
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True)
        if schema is None:
            reader = reader.option("inferSchema", True)
    if schema is not None:
        reader = reader.schema(schema)
    return nan_to_null(reader.load(path))


def write_feature_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Write features beside, never over, the raw table they were read from."""
    sources = {_plain(f) for f in df.inputFiles()}
    target = _plain(path).rstrip("/")
    if any(s == target or s.startswith(target + "/") for s in sources):
        raise ValueError(f"{path!r} is an input of this table; write the features elsewhere")
    writer = df.write.mode("overwrite").format(fmt)
    (writer.option("header", True) if fmt == "csv" else writer).save(path)


def _plain(path: str) -> str:
    if path.startswith("file:"):
        return os.path.abspath("/" + path[5:].lstrip("/"))
    return path if "://" in path else os.path.abspath(path)


def snapshot_once(df: DataFrame, path: str) -> None:
    """Keep the first raw copy; later calls change nothing."""
    df.write.mode("ignore").parquet(path)


def inline_readings(
    spark: SparkSession, rows: Sequence[Sequence], sensors: Sequence[str], step: str = "step"
) -> DataFrame:
    """A small table typed in by hand; the row order becomes the `step` column."""
    fields = [T.StructField(step, T.LongType()), *[T.StructField(n, T.DoubleType()) for n in sensors]]
    data = [(i + 1, *[float(v) for v in row]) for i, row in enumerate(rows)]
    return spark.createDataFrame(data, T.StructType(fields))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder of the session, removed when the application ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path
