"""Operator 2, exact top-k inner products with a KD-tree per shard.

Vectors are dealt to shards of bounded size by a hash of their row. In each shard a KD-tree is built
by median splits along the widest dimension, each node with its tight bounding box. A query visits
the nodes best first by the bound that the box gives for its inner product with any vector inside
(per dimension the larger of the products with the two ends), and stops when the best bound left is
below its k-th score. A first round over one shard for each query finds a k-th score, which the
second round, over all other shards, starts from. In each round a shard's candidates are shuffled
once and make one tree; the queries stream past it, so a task holds one shard and one batch of
queries. The k best of each query are reduced afterwards.

Scores are exact whatever the size of the components: sums that stay below 2**53 are made of
doubles, those below 2**62 of 64-bit integers, and beyond that doubles with their error bounds
choose the rows whose scores are computed with whole numbers of any size.

Defined cases: vectors that are null or hold null or non-finite components take no part; a vector
has scores only with vectors of its own length; rows that repeat an id are candidates of their own,
and a row isn't compared with any row of its own id; ties go to the smaller id; a score beyond 64
bits is ranked as it is and returned as the nearest 64-bit number.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from tallyweave.llm.common import lean, partitions, table, written

SHARD, LEAF = 16384, 128
EXACT, LONG = 2.0**53, 2.0**62
LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1


def whole(x: float) -> int:
    """floor(256 * x) of any finite double."""
    return math.floor(256.0 * x) if abs(x) < EXACT else 256 * int(x)


def in_order(score: int) -> bytes:
    """A key with which scores near or beyond 64 bits sort as they are; empty for all others."""
    if abs(score) < 1 << 62:
        return b""
    raw = abs(score).to_bytes((abs(score).bit_length() + 7) // 8, "big")
    raw = len(raw).to_bytes(2, "big") + raw
    return b"\1" + raw if score > 0 else b"\0" + bytes(255 - b for b in raw)


class KDTree:
    """Median splits with tight boxes over vectors (rows of x, ids alongside)."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, leaf: int = LEAF):
        order = np.argsort(ids, kind="stable")
        with np.errstate(over="ignore"):
            v = np.floor(x[order] * 256.0)
        at, self.span, self.kids, self.boxes = np.arange(len(v)), [], [], []
        self._split(at, v, 0, len(v), leaf)
        self.ids, self.x, self.v = ids[order][at], x[order][at], np.ascontiguousarray(v[at])
        self.most = float(np.abs(self.v).max(initial=0.0))
        self.whole: np.ndarray | None = None
        # Both ends of the two kids of each inner node.
        self.ends = [None if k is None else tuple(np.stack([self.boxes[i][j] for i in k]) for j in (0, 1)) for k in self.kids]

    def _split(self, at: np.ndarray, v: np.ndarray, a: int, b: int, leaf: int) -> int:
        own = v[at[a:b]]
        lo, hi = own.min(0), own.max(0)
        node = len(self.span)
        self.boxes.append((lo, hi))
        self.span.append((a, b))
        self.kids.append(None)
        if b - a > leaf and own.shape[1] and (hi > lo).any():
            with np.errstate(invalid="ignore", over="ignore"):
                axis, m = int(np.nanargmax(np.where(hi > lo, hi - lo, -1.0))), (a + b) // 2
            at[a:b] = at[a:b][np.argpartition(own[:, axis], m - a)]
            self.kids[node] = (self._split(at, v, a, m, leaf), self._split(at, v, m, b, leaf))
        return node

    def search(self, x: np.ndarray, q_ids: np.ndarray, kth: np.ndarray, k: int) -> list[list[tuple[int, int]]]:
        """For each query the k best (score, id) with scores of at least kth."""
        with np.errstate(over="ignore", invalid="ignore"):
            q = np.floor(x * 256.0)
            reach = float(np.abs(q).max(initial=0.0)) * self.most * max(1, q.shape[1])
        if reach < LONG:
            if reach >= EXACT:
                q = q.astype(np.int64)
                if self.whole is None:
                    self.whole = self.v.astype(np.int64)
            v = self.v if reach < EXACT else self.whole
            return [self._one(v, q[i], int(q_ids[i]), int(kth[i]), k) for i in range(len(q))]
        return [self._large(x[i], q[i], int(q_ids[i]), int(kth[i]), k) for i in range(len(q))]

    def _one(self, v: np.ndarray, q: np.ndarray, own: int, least: int, k: int) -> list[tuple[int, int]]:
        best: list[tuple[int, int]] = []  # heap of (score, -id), the worst first
        up, down = np.maximum(q, 0), np.minimum(q, 0)
        todo = [(LOWEST, 0)]
        while todo:
            bound, node = heapq.heappop(todo)
            if -bound < least:
                break
            if kids := self.kids[node]:
                lo, hi = self.ends[node]
                if v is self.whole:
                    lo, hi = lo.astype(np.int64), hi.astype(np.int64)
                for i, b in zip(kids, (hi @ up + lo @ down).tolist(), strict=True):
                    if b >= least:
                        heapq.heappush(todo, (-int(b), i))
                continue
            a, b = self.span[node]
            s = v[a:b] @ q
            keep = np.flatnonzero(s >= least)
            for score, i in zip(s[keep].tolist(), self.ids[a + keep].tolist(), strict=True):
                if i != own:
                    item = (int(score), -i)
                    if len(best) < k:
                        heapq.heappush(best, item)
                    elif item > best[0]:
                        heapq.heapreplace(best, item)
            if len(best) == k:
                least = max(least, best[0][0])
        return [(s, -i) for s, i in best]

    def _large(self, x: np.ndarray, q: np.ndarray, own: int, least: int, k: int) -> list[tuple[int, int]]:
        with np.errstate(over="ignore", invalid="ignore"):
            s, size = self.v @ q, np.abs(self.v) @ np.abs(q)
            off = size * ((len(q) + 2) * 2.0**-52)
            low, high = s - off, s + off
        other = np.flatnonzero(self.ids != own)
        sure = low[other]
        sure = np.sort(sure[~np.isnan(sure)])[::-1]
        bar = max(-math.inf if least == LOWEST else float(least), float(sure[k - 1]) if len(sure) >= k else -math.inf)
        exact = [whole(y) for y in x.tolist()]
        floor, found = -math.inf if least == LOWEST else least, []
        for j in other[~(high[other] < bar * (1 - math.copysign(1e-9, bar)))].tolist():
            score = sum(a * whole(y) for a, y in zip(exact, self.x[j].tolist(), strict=True))
            if score >= floor:
                found.append((-score, int(self.ids[j])))
        return [(-s, i) for s, i in heapq.nsmallest(k, found)]


def finite_vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id and x, the components as doubles, of the vectors that take part."""
    x = F.transform(F.col(f"`{vector_col}`"), lambda y: y.cast("double"))
    good = F.col("x").isNotNull() & ~F.exists("x", lambda y: y.isNull() | F.isnan(y) | (F.abs(y) == float("inf")))
    return df.select(F.col(f"`{id_col}`").cast("long").alias("id"), x.alias("x")).where(good & F.col("id").isNotNull())


HITS = "query_id long, vec_id long, score long, big binary"
_HITS = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()), ("big", pa.binary())])
ORDER = ("dim", "shard", "kind", "id", "x", "kth")


def _hits(candidates: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """candidates (kind 0) and queries (kind 1, with kth) of each dim and shard to their hits."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, tree = None, [], None
        for batch in batches:
            dim, shard, kind, ids = (batch.column(i).to_numpy() for i in range(4))
            if not len(ids):
                continue
            heads = np.flatnonzero(np.concatenate(([True], (dim[1:] != dim[:-1]) | (shard[1:] != shard[:-1]) | (kind[1:] != kind[:-1]))))
            for a, b in zip(heads.tolist(), [*heads[1:].tolist(), len(ids)], strict=True):
                if now != (now := (int(dim[a]), int(shard[a]))):
                    held, tree = [], None
                x = np.asarray(batch.column(4).slice(a, b - a).flatten()).reshape(b - a, now[0])
                if kind[a] == 0:
                    held.append((ids[a:b], x))
                    continue
                if tree is None:
                    if not held:
                        continue
                    tree = KDTree(*(np.concatenate(c) for c in zip(*held, strict=True)))
                    held = []
                rows = []
                for own, hits in zip(ids[a:b].tolist(), tree.search(x, ids[a:b], batch.column(5).slice(a, b - a).to_numpy(), k), strict=True):
                    rows += [(own, i, min(max(s, LOWEST), HIGHEST), in_order(s)) for s, i in hits]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _HITS, strict=True)], schema=_HITS)

    both = candidates.select(*ORDER).union(asked.select(*ORDER))
    dealt = both.repartition(max(partitions(both.sparkSession), 2), "dim", "shard").sortWithinPartitions("dim", "shard", "kind")
    return dealt.mapInArrow(lean(stream), HITS)


def top_k(vectors: DataFrame, queries: DataFrame | str, k: int, shard: int = SHARD) -> DataFrame:
    """The k rows of vectors (id, x) with the largest inner products for each row of them that the
    condition `queries` selects: query_id, rank from 1, vec_id, score."""
    spark = vectors.sparkSession
    shards = max(1, -(-vectors.count() // shard))
    row = F.monotonically_increasing_id()
    dealt = written(vectors.select("id", "x", F.size("x").alias("dim"), row.alias("row")).withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int")), "vectors")
    least = F.lit(LOWEST).cast("long")
    c = dealt.select("dim", "shard", F.lit(0).alias("kind"), "id", "x", least.alias("kth"))
    q = dealt.where(queries).select("dim", F.pmod(F.xxhash64("row", F.lit(1)), F.lit(shards)).cast("int").alias("home"), F.lit(1).alias("kind"), "id", "x")
    first = written(_hits(c, q.withColumn("shard", F.col("home")).withColumn("kth", least), k), "topk-first")
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("big"), "vec_id")
    if shards > 1:
        # A k-th score that was cut to 64 bits from below bounds nothing.
        kth = first.withColumn("r", F.row_number().over(by)).where(F.col("r") == k).select(F.col("query_id").alias("id"), F.col("score").alias("kth"))
        rest = q.join(kth, "id", "left").withColumn("kth", F.coalesce("kth", least)).withColumn("shard", F.explode(F.filter(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: s != F.col("home"))))
        first = first.union(_hits(c, rest, k))
    return first.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(finite_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding"), "id % 50 = 0", 5)


SQL = """
with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, cast(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) as bigint) as score
  from v q, v c where q.vec_id % 50 = 0 and q.vec_id <> c.vec_id and len(q.v) = len(c.v)),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, cast(rank as integer) as rank, vec_id, score from r where rank <= 5
"""
