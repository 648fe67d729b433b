"""Dense row numbers over a global order, without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import materialise


def with_dense_index(df: DataFrame, *order: str, name: str = "pos") -> DataFrame:
    """``df`` with 0, 1, 2, ... in the order given, which must be total. Rows are range-partitioned and numbered in
    their partition; the partitions' sizes (one number each) give the offsets."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    numbered = ranged.withColumn("__id", F.monotonically_increasing_id())
    low = (1 << 33) - 1
    kept = materialise(numbered.withColumn("__part", F.shiftright("__id", 33)).withColumn("__nth", F.col("__id").bitwiseAND(F.lit(low))).drop("__id"), "numbered")
    sizes = kept.groupBy("__part").count()
    before = F.coalesce(F.sum("count").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("__part", before.alias("__before"))  # as many rows as partitions
    return kept.join(F.broadcast(offsets), "__part").withColumn(name, F.col("__before") + F.col("__nth")).drop("__part", "__nth", "__before")


def best(df: DataFrame, k: int, by: list[str], *order: Column, rank: str = "rank") -> DataFrame:
    """The first k rows of each group of ``by``, with their rank. Spark cuts each task's rows to k a group first."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= k)


def spread(df: DataFrame, key: str) -> DataFrame:
    """``df`` over at least as many partitions as there are cores: for narrow rows that much is computed from."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, key)
