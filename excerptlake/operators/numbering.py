"""Row numbers over all rows of a table, without a window in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import work_folder, written


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with __k, the place in that order from 0 on, and __n, the number of rows.

    Rows are sorted in range partitions and written once with their partition's number and their
    place in it; starts are added up over the partitions of that one copy. Planned twice, the two
    sides could be dealt to partitions differently (AQE merges each shuffle by its own size).
    """
    if not order:
        raise ValueError("an order is needed")
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ordered = rows.orderBy(*order).withColumns({"__p": F.spark_partition_id(), "__i": place})
    stored = written(ordered, work_folder(rows.sparkSession))
    total = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    sizes = stored.groupBy("__p").agg(F.count("*").alias("__s"))
    starts = sizes.select(  # a row per partition, as small as the plan
        F.col("__p").alias("__q"),
        F.coalesce(F.sum("__s").over(total), F.lit(0)).alias("__start"),
        F.sum("__s").over(Window.partitionBy()).alias("__n"),
    )
    joined = stored.join(F.broadcast(starts), F.col("__p") == F.col("__q"))
    return joined.withColumn("__k", F.col("__start") + F.col("__i")).drop("__p", "__i", "__q", "__start")
