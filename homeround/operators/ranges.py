"""Numbering by ranges: rows of a large group are numbered by many tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from homeround.storage import written


def numbered(rows: DataFrame, by: list[str], order: list[str | Column], name: str) -> DataFrame:
    """``rows`` with ``name``, from 1, in each group of ``by`` in the given order.

    A sort by ranges deals a large group to many tasks; each numbers its part, and the parts before it are counted. Rows that are equal in
    ``by`` and ``order`` are numbered in any order.
    """
    part = [*by, "__part"]
    ranged = written(rows.repartitionByRange(*by, *order).withColumn("__part", F.spark_partition_id()), "ranged")
    earlier = F.sum("__n").over(Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    before = ranged.groupBy(*part).agg(F.count("*").alias("__n")).withColumn("__before", F.coalesce(earlier, F.lit(0)))
    keys = [F.col(f"`{c}`").eqNullSafe(F.col(f"__{i}")) for i, c in enumerate(part)]
    before = before.select(*[F.col(f"`{c}`").alias(f"__{i}") for i, c in enumerate(part)], "__before")
    here = F.row_number().over(Window.partitionBy(*part).orderBy(*order))
    joined = ranged.withColumn("__here", here).join(before, keys)
    return joined.select(*rows.columns, (F.col("__before") + F.col("__here")).cast("int").alias(name))
