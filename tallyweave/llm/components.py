"""Connected components of links, distributed (no link or label reaches the driver), and an order of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.llm.common import partitions, written


def components(links: DataFrame) -> DataFrame:
    """links (a, b: long) to (node, root) for every node that has a link; root is the smallest node
    of its component. Each round hooks every node to its smallest neighbour, jumps once, and
    contracts the links; the nodes that are left at least halve."""
    edges = written(links.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    mapped: DataFrame | None = None
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("up"))
        nxt = hook.select(F.col("node").alias("up"), F.col("up").alias("upper"))
        step = written(hook.join(nxt, "up", "left").select("node", F.coalesce("upper", "up").alias("root")), "hooks")
        mapped = step if mapped is None else written(mapped.withColumnRenamed("root", "was").join(step.select(F.col("node").alias("was"), F.col("root")), "was", "left").select("node", F.coalesce("root", "was").alias("root")), "roots")
        left = edges.join(step.select(F.col("node").alias("a"), F.col("root").alias("x")), "a").join(step.select(F.col("node").alias("b"), F.col("root").alias("y")), "b")
        edges = written(left.where(F.col("x") != F.col("y")).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "links")
    if mapped is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return mapped


def ordered(docs: DataFrame, id_col: str, text_col: str, name: str = "_doc") -> DataFrame:
    """docs with a column `name`, a number that orders them: the id where ids are unique, or else the
    place in a written copy that is sorted by id and text."""
    ids = docs.select(F.col(f"`{id_col}`").cast("long").alias("i"))
    if ids.groupBy("i").count().where("count > 1 or i is null").isEmpty():
        return docs.withColumn(name, F.col(f"`{id_col}`").cast("long"))
    n = max(partitions(docs.sparkSession), 2)
    by = [F.col(f"`{id_col}`").asc_nulls_first(), F.col(f"`{text_col}`").asc_nulls_first()]
    return written(docs.repartitionByRange(n, *by).sortWithinPartitions(*by).withColumn(name, F.monotonically_increasing_id()), "ordered")
