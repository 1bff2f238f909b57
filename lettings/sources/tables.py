"""Writers and catalogue listings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F


def write_replace(df: DataFrame, path: str, partition: Sequence[str] = ()) -> None:
    """The whole table anew."""
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "static")
    writer.partitionBy(*partition).parquet(path) if partition else writer.parquet(path)


def write_append(df: DataFrame, path: str, partition: Sequence[str] = ()) -> None:
    writer = df.write.mode("append")
    writer.partitionBy(*partition).parquet(path) if partition else writer.parquet(path)


def replace_keys(df: DataFrame, path: str, keys: Sequence[str]) -> None:
    """The rows of the keys that occur in ``df``; all other keys stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def list_tables(spark: SparkSession, like: str) -> DataFrame:
    """Names of tables and views that match a SQL LIKE pattern in any case."""
    names = [(t.name,) for t in spark.catalog.listTables()]
    frame = spark.createDataFrame(names, "table_name string")
    return frame.where(F.upper("table_name").like(like.upper()))


def list_columns(df: DataFrame) -> DataFrame:
    """Name, type and position of the columns of a frame."""
    rows = [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields, 1)]
    return df.sparkSession.createDataFrame(rows, "ordinal_position int, column_name string, data_type string")
