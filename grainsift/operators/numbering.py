"""Dense numbers in an order, without sorting everything in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grainsift.functions.lineage import cut


def dense_ids(rows: DataFrame, key: str, name: str = "doc_id", per_part: int = 100_000) -> DataFrame:
    """``rows`` with a first column counting from 0 in order of ``key`` (unique).

    Rows are split into ranges of the key; a row's number is its place in its range
    after the sizes of the ranges before. The ranges are checkpointed: both uses see
    the same bounds, also after the loss of an executor.
    """
    parts = max(1, -(-rows.count() // per_part))
    ranged = cut(rows.repartitionByRange(parts, key).withColumn("part", F.spark_partition_id()))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    base = ranged.groupBy("part").agg(F.count("*").alias("c")).select(F.col("part").alias("pp"), F.coalesce(F.sum("c").over(before), F.lit(0)).alias("base"))
    placed = ranged.withColumn("r", F.row_number().over(Window.partitionBy("part").orderBy(key)) - 1).join(base, F.col("part") == F.col("pp"))
    return placed.select((F.col("base") + F.col("r")).cast("long").alias(name), *rows.columns)
