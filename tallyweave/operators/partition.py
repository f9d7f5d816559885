"""Frozen partitions (node, community int): numbering, extension to new accounts, fingerprint; cycles."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.operators import scan
from tallyweave.operators.graph import MAX_CYCLE, MIN_CYCLE, closing_edges, core, repeated
from tallyweave.work import cut


def numbered(partition: DataFrame) -> DataFrame:
    """Communities renamed to the rank of their smallest member, from 0."""
    least = partition.groupBy("community").agg(F.min("node").alias("least"))
    rank = scan.running(least, [F.col("least")], place="place").select("community", (F.col("place") - 1).alias("rank"))
    return partition.join(rank, "community").select("node", F.col("rank").alias("community"))


def components(edges: DataFrame, members: DataFrame) -> DataFrame:
    """The smallest node reachable by edges (x, y, both directions) among members (node)."""
    inner = cut(edges.join(members.toDF("x"), "x", "left_semi").join(members.toDF("y"), "y", "left_semi").select("x", "y"))
    label = cut(members.select("node", F.col("node").alias("root")))
    while True:
        heard = inner.join(label.toDF("x", "root"), "x").groupBy("y").agg(F.min("root").alias("other")).withColumnRenamed("y", "node")
        new = label.join(heard, "node", "left").select("node", F.least("root", F.coalesce("other", "root")).alias("root"))
        # A root's own label is a shortcut: the labels of labels halve the distance each round.
        jump = new.select(F.col("node").alias("root"), F.col("root").alias("far"))
        new = cut(new.join(jump, "root").select("node", F.col("far").alias("root")))
        if new.exceptAll(label).isEmpty():
            return new
        label = new


def extend(undirected: DataFrame, partition: DataFrame) -> DataFrame:
    """Places the accounts of undirected (a, b, weight) that partition lacks.

    An account joins the community of its heaviest placed neighbour (ties: the smaller name). Accounts are
    placed in the order of their names, and earlier ones count for later ones; rounds repeat until none
    is placed. The order is kept without a serial loop: in each wave those accounts decide whose
    best placed neighbour beats all smaller neighbours that are undecided. What touches no placed account gets a new community per
    connected component, numbered by smallest member."""
    both = cut(undirected.select("a", "b", "weight").union(undirected.select("b", "a", "weight")).toDF("x", "y", "w"))
    placed = cut(partition.select("node", F.col("community").cast("long").alias("community")))
    remaining = cut(both.select(F.col("x").alias("node")).distinct().join(placed, "node", "left_anti"))
    while not remaining.isEmpty():
        undecided, grew = remaining, False
        while not undecided.isEmpty():
            order = F.struct((-F.col("w")).alias("w"), F.col("y").alias("y"))
            mine = both.join(undecided.toDF("x"), "x", "left_semi")
            best = mine.join(placed.toDF("y", "community"), "y").groupBy("x").agg(F.min(order).alias("best"), F.min_by("community", order).alias("community"))
            rival = mine.where("y < x").join(undecided.toDF("y"), "y", "left_semi").groupBy("x").agg(F.min(order).alias("rival"))
            state = undecided.toDF("x").join(best, "x", "left").join(rival, "x", "left")
            # Nothing that a smaller neighbour may still become beats the best placed one.
            ready = cut(state.where("rival is null or best < rival").select(F.col("x").alias("node"), "community"))
            chosen = ready.where("community is not null")
            grew = grew or not chosen.isEmpty()
            placed = cut(placed.union(chosen))
            undecided = cut(undecided.join(ready, "node", "left_anti"))
        remaining = cut(remaining.join(placed, "node", "left_anti"))
        if not grew:
            break
    if remaining.isEmpty():
        return placed
    first = partition.agg(F.coalesce(F.max("community") + 1, F.lit(0))).first()[0]
    roots = components(both.select("x", "y"), remaining)
    fresh = scan.running(roots.select("root").distinct(), [F.col("root")], place="place").select("root", (F.col("place") - 1 + first).cast("long").alias("community"))
    return placed.union(roots.join(fresh, "root").select("node", "community"))


def fingerprint(partition: DataFrame) -> DataFrame:
    """One row: twelve hexadecimal digits over the membership in order of names, whatever the labels, and the
    counts. Ranges of names make up their piece of the text in parallel; one task digests the pieces as they
    stream past it, for a digest is sequential."""
    named = numbered(partition)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for i, batch in enumerate(batches):
            text = "".join(f";{node}:{community}" for node, community in zip(*(c.to_pylist() for c in batch.columns), strict=True))
            yield pa.RecordBatch.from_pydict({"part": [part], "place": [i], "text": [text], "n": [batch.num_rows], "top": [max(batch.column(1).to_pylist(), default=-1)]})

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha, n, top = hashlib.sha256(), 0, -1
        for batch in batches:
            for text, m, most in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True):
                sha.update(text[0 if n else 1 :].encode())
                n, top = n + m, max(top, most)
        yield pa.RecordBatch.from_pydict({"fingerprint": [f"{sha.hexdigest()[:12]}/{top + 1}c/{n}n"]})

    made = named.select("node", F.col("community").cast("long")).orderBy("node").mapInArrow(pieces, "part long, place long, text string, n long, top long")
    nothing = partition.sparkSession.range(1).select(F.lit(-1).cast("long").alias("part"), F.lit(0).cast("long").alias("place"), F.lit("").alias("text"), F.lit(0).cast("long").alias("n"), F.lit(-1).cast("long").alias("top"))
    return made.union(nothing).repartition(1).sortWithinPartitions("part", "place").mapInArrow(digest, "fingerprint string")


def cycles(ledger: DataFrame, most: int = 15, budget: int = 200_000) -> DataFrame:
    """The first `most` simple cycles of 3 to 8 accounts over repeated payments, each once from its smallest
    account, in the order of their paths; `truncated` tells that a limit was reached, either `most` or
    the budget of paths. Paths only follow edges that lie on some short closed walk, and of each round only
    the budget's first paths go on: what follows them in order comes after all that they lead to."""
    e = cut(closing_edges(core(repeated(ledger))))
    step = e.select(F.col("u").alias("at"), F.col("v").alias("to"))
    paths = e.where("u < v").select(F.array("u", "v").alias("path"), F.col("v").alias("at"))
    found, bound, cut_off = paths.where("false").select("path"), None, False
    for size in range(2, MAX_CYCLE + 1):
        paths = cut(paths)
        n = paths.count()
        if not n:
            break
        if n > budget:
            paths = cut(paths.orderBy("path").limit(budget))
            last = paths.agg(F.max("path").alias("p")).first()["p"]
            bound, cut_off = last if bound is None or last < bound else bound, True
        on = paths.join(step, "at")
        if size >= MIN_CYCLE:
            found = found.union(on.where("to = path[0]").select("path"))
        if size == MAX_CYCLE:
            break
        paths = on.where("to > path[0] and not array_contains(path, to)").select(F.concat("path", F.array("to")).alias("path"), F.col("to").alias("at"))
    if bound is not None:  # beyond the first path that wasn't followed, the order isn't known
        found = found.where(F.slice("path", 1, len(bound)) <= F.array(*map(F.lit, bound)))
    shown = found.orderBy("path").limit(most)
    return shown.crossJoin(F.broadcast(shown.agg(((F.count("*") >= most) | F.lit(cut_off)).alias("truncated")))).select(F.array_join("path", ">").alias("cycle"), F.size("path").cast("long").alias("n"), "truncated")
