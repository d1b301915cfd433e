"""Numbers of rows in one order of a whole table, without one task that sorts it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandline.sources.shared import written


def numbered(df: DataFrame, name: str, *order: str | Column) -> DataFrame:
    """Add ``name``, the number of each row from 1 on in the given order, which must have no ties.

    Rows are dealt to ranges of the order and written with the number of their range, so
    that a range's bounds hold. Each range is numbered by itself, and what the ranges
    before it hold, a row for each range, is added.
    """
    dealt = written(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy("_range").agg(F.count("*").alias("_n"))
    before = sizes.select("_range", (F.sum("_n").over(W.orderBy("_range")) - F.col("_n")).alias("_before"))
    own = dealt.withColumn("_row", F.row_number().over(W.partitionBy("_range").orderBy(*order)))
    return own.join(F.broadcast(before), "_range").withColumn(name, F.col("_row") + F.col("_before")).drop("_range", "_row", "_before")
