"""Dense numbers over sorted rows, without a task that sees them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import stored


def numbered(df: DataFrame, *order: Column, name: str = "number", first: int = 0) -> DataFrame:
    """Rows with a number: first, first + 1 ... in the given order.

    Sorted ranges are numbered on their own, then moved on by the rows of the ranges before them;
    only the count of each range is gathered. Rows that are equal in the order get different
    numbers in any order; so equal rows give the same result whichever comes first. The rows are
    kept in the shared folder in between.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    rows = stored(placed, "numbered").withColumns({"__range": F.shiftright("__at", 33), "__in": F.col("__at").bitwiseAND((1 << 33) - 1)})
    # one row for each range
    sizes = rows.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("__range", before.alias("__before"))
    out = rows.join(F.broadcast(offsets), "__range").withColumn(name, F.col("__before") + F.col("__in") + first)
    return out.drop("__range", "__at", "__in", "__before")
