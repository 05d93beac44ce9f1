"""Partitioned tables: reading fields of all or one partition, writing one partition."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nodelake.errors import Validation


def fields_of(text: str | None) -> list[str] | None:
    """``a, b`` as a list; nothing means all."""
    names = [x.strip() for x in (text or "").split(",") if x.strip()]
    return names or None


def read(table: DataFrame, fields: Sequence[str] | None = None, partition_col: str = "partition") -> DataFrame:
    """All partitions, with the given fields (all but the partition's number, if none are given)."""
    fields = list(fields) if fields else [c for c in table.columns if c != partition_col]
    missing = [f for f in fields if f not in table.columns]
    if missing:
        raise Validation(f"no such fields: {missing}")
    return table.select(*fields)


def read_partition(table: DataFrame, number: int = 0, fields: Sequence[str] | None = None, partition_col: str = "partition") -> DataFrame:
    if number < 0:
        raise Validation("a partition's number is at least 0")
    return read(table.where(F.col(partition_col) == number), fields, partition_col)


def partitioned(table: DataFrame, by: str, count: int, partition_col: str = "partition") -> DataFrame:
    """The table with a partition number from the hash-free remainder of an integer column."""
    return table.withColumn(partition_col, F.pmod(F.col(by), F.lit(count)).cast("int"))


def write(table: DataFrame, where: str, partition_col: str = "partition") -> None:
    table.write.mode("overwrite").partitionBy(partition_col).parquet(where)


def write_partition(rows: DataFrame, where: str, number: int, partition_col: str = "partition") -> None:
    """Replace one partition of a written table."""
    own = rows.drop(partition_col).withColumn(partition_col, F.lit(number))
    own.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition_col).parquet(where)
