"""Row numbers over a whole table without gathering it in one task."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch


def row_numbers(df: DataFrame, name: str, *order: str) -> DataFrame:
    """df with `name`: 1, 2, ... in the order of the columns `order`.

    Rows are dealt out by range and sorted; the counts of the ranges, a row for
    each, give every range its first number.  Rows that are equal in `order`
    get their numbers in any order.
    """
    spark, path = df.sparkSession, scratch(df.sparkSession, "numbered-" + uuid.uuid4().hex)
    at = F.monotonically_increasing_id()
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged.select("*", F.shiftright(at, 33).alias("_part"), at.bitwiseAND((1 << 33) - 1).alias("_at")).write.parquet(path)
    d = spark.read.parquet(path)
    sizes = d.groupBy("_part").agg(F.count("*").alias("_n"))
    first = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_first"))
    return d.join(F.broadcast(first), "_part").select(*df.columns, (F.col("_first") + F.col("_at") + 1).alias(name))
