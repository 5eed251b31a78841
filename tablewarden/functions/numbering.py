"""Numbers of rows in an order, without a sort of all rows in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewarden.functions.scratch import materialise


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df with name: each row's place (from 0) in the order of the columns order, as row_number less one gives it.

    Rows are dealt out by ranges of the order and sorted within them; what a range's first row stands behind is a sum over ranges.
    """
    ranges = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(name, F.monotonically_increasing_id())
    rows = materialise(ranges, "numbered").withColumn("_range", F.shiftright(F.col(name), 33))
    ahead, places = 0, []
    for r in sorted(rows.groupBy("_range").count().collect()):  # a row per range
        places.append((r["_range"], ahead - (r["_range"] << 33)))
        ahead += r["count"]
    shift = df.sparkSession.createDataFrame(places, "_range long, _shift long")
    return rows.join(F.broadcast(shift), "_range").withColumn(name, F.col(name) + F.col("_shift")).drop("_range", "_shift")
