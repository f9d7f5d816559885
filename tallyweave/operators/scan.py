"""Running sums, places and neighbours over all rows in an order, without a window over all rows.

Rows are dealt to ranges of the order (ties are broken by further columns of it, so no range is one value's) and
written with the number of their range. Windows are over a range; what ranges before add, or the rows next to their
edges, are a row for each range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.work import cut

RANGE = "_range"


def ranges(df: DataFrame, order: list[Column]) -> DataFrame:
    """df, written, with the number of each row's range."""
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return cut(df.repartitionByRange(n, *order).withColumn(RANGE, F.spark_partition_id()))


def running(df: DataFrame, order: list[Column], sums: dict[str, Column] | None = None, place: str | None = None) -> DataFrame:
    """df with the running sum of each of `sums`, the row itself included, and with its place from 1."""
    values = {name: f"_{name}_" for name in sums or {}}
    d = ranges(df.withColumns({values[name]: c for name, c in (sums or {}).items()}), order)
    if place:
        values[place] = "_one_"
        d = d.withColumn("_one_", F.lit(1).cast("long"))
    total = d.groupBy(RANGE).agg(*[F.sum(v).alias(v) for v in values.values()])
    before = Window.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    lower = total.select(RANGE, *[F.coalesce(F.sum(v).over(before), F.lit(0)).alias(f"{v}b") for v in values.values()])
    upto = Window.partitionBy(RANGE).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return d.join(F.broadcast(lower), RANGE).select(*df.columns, *[(F.col(f"{v}b") + F.sum(v).over(upto)).alias(name) for name, v in values.items()])


def neighbour(df: DataFrame, order: list[Column], value: Column, name: str, ahead: bool) -> DataFrame:
    """df with the value of the next row in the order (`ahead`) or of the one before; null at the end."""
    d = ranges(df.withColumn("_v", value), order)
    inside = Window.partitionBy(RANGE).orderBy(*order)
    shift = F.lead if ahead else F.lag
    d = d.withColumns({"_near": shift("_v").over(inside), "_edge": shift(F.lit(True)).over(inside).isNull(), "_other": (F.lag if ahead else F.lead)(F.lit(True)).over(inside).isNull()})
    # Of each range the row at the other edge, which is next to the range on that side.
    edge = d.where("_other").select(RANGE, "_v")
    across = edge.select(F.lag(RANGE).over(Window.orderBy(RANGE)).alias(RANGE), F.col("_v").alias("_across")) if ahead else edge.select(F.lead(RANGE).over(Window.orderBy(RANGE)).alias(RANGE), F.col("_v").alias("_across"))
    return d.join(F.broadcast(across.where(F.col(RANGE).isNotNull())), RANGE, "left").select(*df.columns, F.when(F.col("_edge"), F.col("_across")).otherwise(F.col("_near")).alias(name))
