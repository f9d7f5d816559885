"""Labelled ledgers (columns of `sources.ledger.EDGES`, and `pos`, the order of a file): who belongs to a
ring, a split's feature table, and what a view of the graph shows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.functions import contract
from tallyweave.operators import graph
from tallyweave.operators.partition import numbered
from tallyweave.work import cut


def payments(edges: DataFrame) -> DataFrame:
    """The four columns that features are made of."""
    return edges.select("sender", "receiver", F.col("amount").cast("decimal(18,4)").alias("amount"), F.col("timestamp").alias("ts"))


def _ends(edges: DataFrame, *columns: str) -> DataFrame:
    return edges.select(F.explode(F.array("sender", "receiver")).alias("node"), *columns)


def ring_labels(edges: DataFrame) -> DataFrame:
    """Accounts that pay or are paid inside a ring (feeders don't count): the ring of their first payment by
    time and place in the file, and all rings and kinds of rings, sorted and joined by a bar."""
    first = F.struct("timestamp", "pos")
    e = _ends(edges.where("edge_role = 'ring'"), "ring_id", "ring_type", "timestamp", "pos")
    return e.groupBy("node").agg(
        F.min_by("ring_id", first).alias("ring_id"), F.min_by("ring_type", first).alias("ring_type"),
        F.array_join(F.array_sort(F.collect_set("ring_id")).cast("array<string>"), "|").alias("rings_attributed"), F.array_join(F.array_sort(F.collect_set("ring_type")), "|").alias("ring_types_attributed"),
    )


def labelled(features: DataFrame, edges: DataFrame) -> DataFrame:
    """features (node, ...) with the target and the label's columns; accounts of no ring have -1, organic and
    empty sets."""
    fill = {"ring_id": -1, "ring_type": "organic", "rings_attributed": "", "ring_types_attributed": ""}
    out = features.join(ring_labels(edges), "node", "left").withColumn(contract.TARGET, F.col("ring_id").isNotNull().cast("int"))
    return out.na.fill(fill)


def process(edges: DataFrame, split: str, partition: DataFrame | None = None, rounds: int = 200, tolerance: float | None = 1e-4) -> DataFrame:
    """A split's payments to its feature table, in the order of the contract. A partition may be given; else
    the split's graph is partitioned, and communities are numbered by their smallest members."""
    own = edges.where(F.col("split") == split)
    ledger = cut(payments(own))
    if partition is None:
        partition = cut(numbered(graph.partitioned(graph.undirected(graph.pairs(ledger)))))
    made = graph.features(ledger, partition, rounds, tolerance).withColumnRenamed("community", "louvain_community")
    return contract.ordered(labelled(made, own).withColumn("split", F.lit(split)))


def pair_frame(edges: DataFrame) -> DataFrame:
    """One row per ordered pair: payments, total, mean, whether one of them is a ring's, and their roles."""
    return edges.groupBy("sender", "receiver").agg(F.count("*").alias("weight"), F.sum("amount").alias("total"), F.avg(F.col("amount").cast("double")).alias("mean"), F.max("is_mule").alias("is_mule"), F.array_join(F.array_sort(F.collect_set("edge_role")), ", ").alias("roles"))


def shown_graph(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Every node once with its pairs out and in; a node without any is there too."""
    out = pairs.groupBy(F.col("sender").alias("node")).agg(F.count("*").alias("n_out"))
    into = pairs.groupBy(F.col("receiver").alias("node")).agg(F.count("*").alias("n_in"))
    zero = F.lit(0).cast("long")
    return nodes.select("node").distinct().join(out, "node", "left").join(into, "node", "left").select("node", F.coalesce("n_out", zero).alias("n_out"), F.coalesce("n_in", zero).alias("n_in"))


def victims(edges: DataFrame) -> DataFrame:
    """Accounts at an end of a ring's or feeder's payment that belong to no ring."""
    return _ends(edges.where("is_mule = 1")).distinct().join(ring_labels(edges).select("node"), "node", "left_anti")


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The payments between these nodes."""
    keep = nodes.select("node")
    return edges.join(keep.withColumnRenamed("node", "sender"), "sender", "left_semi").join(keep.withColumnRenamed("node", "receiver"), "receiver", "left_semi").select(edges.columns)
