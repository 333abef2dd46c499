"""Joins of a large side in which one key may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hot_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner join on `key`, which is unique in `right`.

    Keys with more than a shuffle partition's share of the left rows are, by their size, at most as many as there are
    partitions; their right rows are broadcast and their left rows stay where they are. All others are joined by a shuffle.
    """
    spark = left.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counts = left.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n")).first()[0] or 0
    hot = counts.filter(F.col("_n") > max(total // parts, 1)).select(key)
    if hot.isEmpty():
        return left.join(right, key)
    hot = F.broadcast(hot)
    return left.join(F.broadcast(right.join(hot, key)), key).unionByName(left.join(hot, key, "left_anti").join(right, key))
