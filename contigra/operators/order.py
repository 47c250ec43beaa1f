"""Numbers and running sums in one order of all rows, without a task that holds all of them; rows by key in tasks of a bounded
number of rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import stored

#: Rows that a task of `dealt` gets, on average.
ROWS = 1 << 18


def dealt(rows: DataFrame, n: int, *keys: str) -> DataFrame:
    """rows by the keys, in tasks whose number follows n, that of the rows (or a bound of it).

    Spark joins the parts of a shuffle of its own up to a number of compressed bytes. Genes in their order take about twelve of
    them each and hundreds in the memory of sorts and windows, so that a task's memory would grow with the table."""
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, -(-n // ROWS)), *keys)


def numbered(rows: DataFrame, order: Sequence[Column | str], name: str = "rank", sums: Sequence[str] = ()) -> DataFrame:
    """rows with their number from 1 in the order, and with the running sums of some columns in their place.

    Rows are cut into ranges of the order, of even sizes whatever the values, and written, as ranges come from samples; numbers
    and sums go by range and then within it. One row a range meets in one task."""
    cut = stored(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    before = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    whole = cut.groupBy("_range").agg(F.count("*").alias("_rows"), *[F.sum(c).alias(f"_sum_{c}") for c in sums])
    whole = whole.select("_range", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in ("_rows", *(f"_sum_{c}" for c in sums))])
    within = W.partitionBy("_range").orderBy(*order)
    upto = within.rowsBetween(W.unboundedPreceding, 0)
    out = cut.join(whole, "_range").withColumn(name, (F.col("_rows") + F.row_number().over(within)).cast("long"))
    out = out.withColumns({c: F.col(f"_sum_{c}") + F.sum(c).over(upto) for c in sums})
    return out.drop("_range", "_rows", *(f"_sum_{c}" for c in sums))
