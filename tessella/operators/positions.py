"""Positions of rows in an order, without bringing them together in one task."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.sources.workspace import written


def numbered(df: DataFrame, order: list[str], name: str = "no", start: int = 0) -> DataFrame:
    """df with the position of each row, from start. Rows are dealt by ranges of the order and sorted there; a range's first
    position is the number of rows in the ranges before it, of which there are as many as partitions. Equal rows follow
    each other in any order."""
    local = F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33)
    placed = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"_range": F.spark_partition_id(), "_at": local}), "positions")
    sizes = sorted((r[0], r[1]) for r in placed.groupBy("_range").count().collect())
    firsts = list(zip([r for r, _ in sizes], accumulate([start, *(n for _, n in sizes[:-1])]), strict=True)) if sizes else []
    offsets = df.sparkSession.createDataFrame(firsts, "_range int, _first long")
    return placed.join(F.broadcast(offsets), "_range").withColumn(name, F.col("_at") + F.col("_first")).drop("_range", "_at", "_first")
