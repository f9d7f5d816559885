"""Operator 1, best-fit packing of token sequences.

Best-fit decreasing over all pieces of the corpus at once. A segment tree over the remaining
capacities 0..L counts the open bins of each capacity and finds the tightest one that takes a piece
in logarithmic time. Pieces of one length are interchangeable and so are bins of one capacity, so
one step places a whole run of them, which fills bin after bin; the plan is a list of runs (length,
ranks, bins, offset) whose size depends on L alone: at most one run for each pair of length and
capacity, and each length splits one interval of bins at most. That bounds what the driver holds (the counts of L lengths) and what
is broadcast, whatever the corpus holds. Each piece then finds its run by its length and its rank
among the pieces of its length; ranks are counted in hashed buckets of bounded size first, so a
length of a third of all pieces is spread like any other.

Defined cases: a null text is an empty one, which is the end id alone; repeated rows are documents
of their own; only documents longer than L are cut; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from tallyweave.llm.common import lean, table, text_pieces, written
from tallyweave.llm.tokens import encoder

LENGTH, END, TOKENIZER = 2048, 0, "word_bpe_49k.json"
#: Pieces of a rank bucket, about.
BUCKET = 20_000


class CapacityTree:
    """A segment tree over capacities 0..most: each leaf has the number of open bins."""

    def __init__(self, most: int):
        self.n = 1 << most.bit_length()
        self.count = [0] * (2 * self.n)

    def add(self, capacity: int, bins: int) -> None:
        i = capacity + self.n
        while i:
            self.count[i] += bins
            i >>= 1

    def tightest(self, need: int) -> int | None:
        """The smallest capacity of at least `need` that has an open bin."""
        i = need + self.n
        if self.count[i]:
            return need
        while i > 1:
            if not i & 1 and self.count[i + 1]:
                i += 1
                while i < self.n:
                    i = 2 * i if self.count[2 * i] else 2 * i + 1
                return i - self.n
            i >>= 1
        return None


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> np.ndarray:
    """The runs of best-fit decreasing for counts of lengths: columns length, first rank (from 0),
    ranks, first bin, offset in the bins, pieces of a bin.

    A bin that takes a piece of a length is from then on the tightest one for that length, so it takes
    the next pieces too until none fits any more; a run fills whole bins of one capacity that way."""
    tree, bins, made, runs = CapacityTree(capacity), {}, 0, []

    def put_back(rest: int, first: int, n: int) -> None:
        tree.add(rest, n)
        bins.setdefault(rest, deque()).appendleft((first, n))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        if length <= 0 or length > capacity:
            raise ValueError(f"no bin takes the length {length}")
        while left:
            c = tree.tightest(length)
            if c is None:  # new bins, no more than these pieces fill
                c, first, n = capacity, made, -(-left // (capacity // length))
                made += n
            else:
                first, n = bins[c].popleft()
                tree.add(c, -n)
            per = c // length
            full = min(n, left // per)
            for m, each in ((full, per), (int(n > full), left - full * per)):  # the last bin in part
                if m and each:
                    runs.append((length, rank, m * each, first, capacity - c, each))
                    put_back(c - each * length, first, m)
                    first, n, rank, left = first + m, n - m, rank + m * each, left - m * each
            if n:
                put_back(c, first, n)
    return np.array(runs, np.int64).reshape(-1, 6)


PIECE = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("_at", pa.int32())])


def pieces(docs: DataFrame, tokenizer: str = TOKENIZER, length: int = LENGTH, end: int | None = END, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece of each tokenized document: doc_id, piece, start, length, ids_crc32."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail, at = b"" if end is None else np.array([end], "<u4").tobytes(), 0
        enc = encoder(tokenizer)
        for batch in batches:
            docs = batch.column(0).to_pylist()
            for a, b, data, offsets in text_pieces(batch, "text"):
                rows = []
                every, bounds = enc.batch(data, offsets)
                for doc, i, j in zip(docs[a:b], bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    ids = every[i:j].tobytes() + tail
                    for k, s in enumerate(range(0, len(ids), 4 * length)):
                        own = ids[s : s + 4 * length]
                        rows.append((doc, k, s // 4, len(own) // 4, zlib.crc32(own), at))
                        at += 1
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), PIECE, strict=True)], schema=PIECE)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(lean(stream), "doc_id long, piece int, start long, length long, ids_crc32 long, _at int")


def pack(made: DataFrame, capacity: int = LENGTH) -> DataFrame:
    """made (with a column length of 1..capacity) plus sequence_id and offset, best-fit decreasing."""
    spark = made.sparkSession
    made = written(made.withColumn("_row", F.monotonically_increasing_id()), "pieces")
    n = made.count()
    bucketed = made.withColumn("_bucket", F.pmod(F.xxhash64("_row"), F.lit(max(1, n // BUCKET))))
    each = written(bucketed.groupBy("length", "_bucket").count(), "lengths")
    before = each.withColumn("_before", F.sum("count").over(Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))).select("length", "_bucket", F.coalesce("_before", F.lit(0)).alias("_before"))
    # One row per length, so at most `capacity` rows.
    counts = {r["length"]: r["n"] for r in each.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    plan = best_fit_decreasing(counts, capacity)
    shared = spark.sparkContext.broadcast(plan)
    ranked = bucketed.withColumn("_in", F.row_number().over(Window.partitionBy("length", "_bucket").orderBy("_row")) - 1).join(before.hint("merge"), ["length", "_bucket"])
    ranked = ranked.withColumn("_rank", F.col("_in") + F.col("_before")).drop("_in", "_before", "_bucket", "_row")
    names = [c for c in ranked.columns if c != "_rank"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = shared.value
        order = np.lexsort((runs[:, 1], -runs[:, 0]))
        runs = runs[order]
        key = (capacity - runs[:, 0]).astype(np.float64) * 2.0**40 + runs[:, 1]
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "_rank"))
            i = np.searchsorted(key, (capacity - length).astype(np.float64) * 2.0**40 + rank, "right") - 1
            bins, nth = np.divmod(rank - runs[i, 1], runs[i, 5])
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in names), pa.array(runs[i, 3] + bins), pa.array(runs[i, 4] + nth * length)], names=[*names, "sequence_id", "offset"])

    return ranked.mapInArrow(lean(place), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema if f.name != "_rank") + ", sequence_id long, offset long")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(pieces(table(spark, sf_dir, "documents"))).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
