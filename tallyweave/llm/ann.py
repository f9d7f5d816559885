"""Operator 11, approximate nearest neighbours by an adaptive dimension scan of probed lists.

The largest inner product is the smallest distance once each vector has a further component that
brings it to the length of the longest one. Lists are the cells of k-means centroids, fitted on a sample
of at most ``SAMPLE`` bytes of vectors; every vector is indexed. A query probes as many lists as hold
``COVERED`` of the true neighbours of sample vectors within the sample, which lie further off than those
in the whole table do. Vectors are turned by a random rotation and kept by blocks of columns; after each
block a candidate whose distance so far is too long for its full distance to be likely below the k-th
one (by ``SURE`` deviations of the test) is given up, so most candidates cost a block or two. A
first round over the list nearest to each query gives the k-th distance that the others begin with.
What is left is scored on the original vectors, component by component in double precision.

A list of more than its share of rows, such as one of copies, is split into parts of bounded size; a task
holds one part and streams the queries that probe it. Centroids and rotation are bounded by ``CENTROIDS``
bytes for each length of vectors, the sample by its own bound, and no row else reaches the driver.

Defined cases: vectors that are null, zero or hold null or non-finite components take no part; a vector
is compared with vectors of its own length, each of which has an index of its own; rows that repeat an
id are candidates and queries of their own, and a row isn't compared with any row of its own id; ties go to the
smaller id; an empty table gives an empty result; other columns don't matter, whatever their names.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyweave.llm.common import lean, partitions, table, written
from tallyweave.llm.topk import finite_vectors

#: Bytes of the sample that is fitted and of the centroids; rows of a part of a list.
SAMPLE, CENTROIDS, PART, LEAST_PART = 16 << 20, 8 << 20, 16384, 256
#: Columns of a block; deviations of the test; share of the sample's neighbours that the probed lists hold.
COLUMNS, SURE, COVERED = 16, 2.1, 0.96


@functools.lru_cache(4)
def rotation(dim: int) -> np.ndarray:
    """A random rotation, the same wherever it is made."""
    q, r = np.linalg.qr(np.random.default_rng(dim).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


class Index:
    """Centroids for n vectors of one length, of which no component is larger than `most` and none is longer
    than `longest` times that."""

    def __init__(self, sample: np.ndarray, n: int, most: float, longest: float, k: int):
        self.most, self.longest = most, longest
        dim = sample.shape[1] + 1
        lists = max(1, min(round(math.sqrt(n)), CENTROIDS // (8 * dim), len(sample) // 8 or 1))
        data = self.raised(sample)
        self.centroids = self._fit(data, lists)
        self.probes = self._probes(sample, data, k)

    def raised(self, x: np.ndarray) -> np.ndarray:
        """Stored vectors in units of the longest, with the component that evens their lengths."""
        x = x / self.most / self.longest
        return np.column_stack((x, np.sqrt(np.maximum(0.0, 1.0 - (x * x).sum(1)))))

    def asked(self, x: np.ndarray) -> np.ndarray:
        """Queries as unit vectors; their inner products with stored vectors keep their order."""
        x = x / np.abs(x).max(1, keepdims=True)
        return np.column_stack((x / np.sqrt((x * x).sum(1, keepdims=True)), np.zeros(len(x))))

    def far(self, x: np.ndarray) -> np.ndarray:
        """Squared distances to the centroids, but for the square of x."""
        return (self.centroids * self.centroids).sum(1) - 2.0 * (x @ self.centroids.T)

    def nearest(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self.far(x[a : a + 4096]).argmin(1) for a in range(0, len(x), 4096)]) if len(x) else np.empty(0, np.int64)

    def _fit(self, data: np.ndarray, lists: int, rounds: int = 8) -> np.ndarray:
        rng = np.random.default_rng(lists)
        self.centroids = data[rng.choice(len(data), lists, replace=False)].copy()
        for _ in range(rounds if lists > 1 else 0):
            at = self.nearest(data)
            size = np.bincount(at, minlength=lists)
            order = np.argsort(at, kind="stable")
            sums = np.add.reduceat(data[order], np.minimum(np.cumsum(size) - size, len(data) - 1), 0)
            self.centroids = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], data[rng.integers(0, len(data), lists)])
        return self.centroids

    def _probes(self, sample: np.ndarray, data: np.ndarray, k: int) -> int:
        """The fewest lists, nearest first, that hold COVERED of the k nearest of sample vectors."""
        lists = len(self.centroids)
        rows = np.random.default_rng(k).choice(len(sample), min(256, len(sample)), replace=False)
        q, at = self.asked(sample[rows]), self.nearest(data)
        score = q @ data.T
        score[np.arange(len(rows)), rows] = -np.inf
        best = np.argsort(-score, 1)[:, : min(k, len(sample) - 1)]
        place = np.empty((len(rows), lists), np.int64)
        np.put_along_axis(place, np.argsort(self.far(q), 1), np.arange(lists)[None, :].repeat(len(rows), 0), 1)
        need = np.sort(np.take_along_axis(place, at[best], 1).ravel())
        return lists if not len(need) else int(need[min(len(need) - 1, math.ceil(COVERED * len(need)))]) + 1


class Part:
    """Some vectors of a list: ids, the vectors themselves, and rotated by blocks of columns."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, index: Index):
        order = np.argsort(ids, kind="stable")
        self.ids, self.x = ids[order], np.ascontiguousarray(x[order])
        turned = index.raised(self.x) @ rotation(x.shape[1] + 1)
        self.blocks = [np.ascontiguousarray(turned[:, a : a + COLUMNS]) for a in range(0, turned.shape[1], COLUMNS)]
        self.dim = turned.shape[1]

    def search(self, q: np.ndarray, turned: np.ndarray, own: int, kth: float, k: int) -> list[tuple[float, int, float]]:
        """The k nearest (score, id, distance) whose squared distance is at most kth, up to rounding."""
        left = np.flatnonzero(self.ids != own)
        found: list[tuple[float, int, float]] = []
        step = max(4 * k, 64) if kth == math.inf else len(left)
        at = 0
        while at < len(left):  # the first rows give a k-th distance to begin with
            rows = left[at : at + step]
            at, step = at + step, max(step, 2048)
            far, seen = np.zeros(len(rows)), 0
            for block in self.blocks:
                part = block[rows] - turned[seen : seen + block.shape[1]]
                far += np.einsum("ij,ij->i", part, part)
                seen += block.shape[1]
                if kth < math.inf:
                    bound = kth * (1.0 + SURE / math.sqrt(seen)) ** 2 * seen / self.dim if seen < self.dim else kth
                    stay = far <= bound + 1e-9
                    if not stay.all():
                        rows, far = rows[stay], far[stay]
                if not len(rows):
                    break
            if not len(rows):
                continue
            score = np.zeros(len(rows))
            own_x = self.x[rows]
            for j in range(own_x.shape[1]):
                score += own_x[:, j] * q[j]
            found += zip(score.tolist(), self.ids[rows].tolist(), far.tolist(), strict=True)
            found.sort(key=lambda h: (-h[0], h[1]))
            del found[k:]
            if len(found) == k:
                kth = min(kth, max(h[2] for h in found))
        return found


HITS = "query long, query_id long, vec_id long, score double, far double"
_HITS = pa.schema([("query", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64()), ("far", pa.float64())])
ORDER = ("dim", "list", "part", "kind", "id", "row", "x", "kth")


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), dim)


def nearest(vectors: DataFrame, queries: str, k: int) -> DataFrame:
    """The k rows of vectors (id, x) found nearest to each row of them that the condition `queries` selects:
    query_id, rank from 1, vec_id, score."""
    spark = vectors.sparkSession
    dim = F.size("x")
    dealt = written(vectors.where(F.exists("x", lambda y: y != 0)).select("id", "x", dim.alias("dim"), F.monotonically_increasing_id().alias("row")), "vectors")
    models: dict[int, Index] = {}
    top = F.array_max(F.transform("x", F.abs))
    length = F.log(top) + 0.5 * F.log(F.aggregate(F.transform("x", lambda y: y / top), F.lit(0.0), lambda a, y: a + y * y))
    for d, n, most, longest in dealt.groupBy("dim").agg(F.count("*"), F.max(top), F.exp(F.max(length) - F.log(F.max(top)))).collect():  # a row for each length
        some = dealt.where(F.col("dim") == d).orderBy(F.xxhash64("id"), "id", "row").limit(max(64, SAMPLE // (8 * d))).select("x").toArrow()
        models[d] = Index(_vectors(some.column(0).combine_chunks(), d), n, most, longest, k)
    held = spark.sparkContext.broadcast(models)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, at = batch.column(2).to_numpy(), np.zeros(batch.num_rows, np.int32)
            for d in np.unique(dims).tolist():
                own = np.flatnonzero(dims == d)
                index = held.value[d]
                at[own] = index.nearest(index.raised(_vectors(batch.column(1).take(pa.array(own)), d)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at)], names=[*batch.schema.names, "list"])

    given = "id long, x array<double>, dim int, row long"
    listed = written(dealt.mapInArrow(lean(assign), given + ", list int"), "lists")
    sizes = {d: np.zeros(len(m.centroids), np.int64) for d, m in models.items()}
    for d, at, n in listed.groupBy("dim", "list").count().collect():  # at most a row for each centroid
        sizes[d][at] = n
    most = max(LEAST_PART, min(PART, sum(int(x.sum()) for x in sizes.values()) // (4 * partitions(spark))))
    parts = F.broadcast(spark.createDataFrame([(d, at, -(-n // most)) for d, x in sizes.items() for at, n in enumerate(x.tolist()) if n], "dim int, list int, parts int"))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, lists = batch.column(2).to_numpy(), [None] * batch.num_rows
            for d in np.unique(dims).tolist():
                own = np.flatnonzero(dims == d)
                index = held.value[d]
                order = np.argsort(index.far(index.asked(_vectors(batch.column(1).take(pa.array(own)), d))), 1)
                enough = (np.cumsum(sizes[d][order], 1) <= k).sum(1) + 1  # k rows beside the query's own
                for i, row, n in zip(own.tolist(), order.tolist(), enough.tolist(), strict=True):
                    lists[i] = row[: max(n, index.probes)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lists, pa.list_(pa.int32()))], names=[*batch.schema.names, "lists"])

    c = listed.join(parts, ["dim", "list"]).select("dim", "list", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int").alias("part"), F.lit(0).alias("kind"), "id", "row", "x", F.lit(0.0).alias("kth"))
    q = written(dealt.where(queries).mapInArrow(lean(probe), given + ", lists array<int>"), "probes")

    def hits(candidates: DataFrame, asked: DataFrame) -> DataFrame:
        def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, some, part = None, [], None
            for batch in batches:
                keys = [batch.column(i).to_numpy() for i in range(4)]
                if not batch.num_rows:
                    continue
                heads = np.flatnonzero(np.concatenate(([True], np.logical_or.reduce([x[1:] != x[:-1] for x in keys]))))
                for a, b in zip(heads.tolist(), [*heads[1:].tolist(), batch.num_rows], strict=True):
                    if now != (now := tuple(int(x[a]) for x in keys[:3])):
                        some, part = [], None
                    ids, x = batch.column(4).slice(a, b - a).to_numpy(), _vectors(batch.column(6).slice(a, b - a), now[0])
                    if keys[3][a] == 0:
                        some.append((ids, x))
                        continue
                    if part is None:
                        if not some:
                            continue
                        part, some = Part(*(np.concatenate(v) for v in zip(*some, strict=True)), held.value[now[0]]), []
                    turned, rows = held.value[now[0]].asked(x) @ rotation(now[0] + 1), []
                    for i, (own, row, kth) in enumerate(zip(ids.tolist(), batch.column(5).slice(a, b - a).to_pylist(), batch.column(7).slice(a, b - a).to_pylist(), strict=True)):
                        rows += [(row, own, vec, score, far) for score, vec, far in part.search(x[i], turned[i], own, kth, k)]
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*rows, strict=True), _HITS, strict=True)], schema=_HITS)

        both = candidates.select(*ORDER).union(asked.join(parts, ["dim", "list"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("kind", F.lit(1)).select(*ORDER))
        return both.repartition(max(partitions(spark), 2), "dim", "list", "part").sortWithinPartitions("dim", "list", "part", "kind").mapInArrow(lean(stream), HITS)

    by = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    none = F.lit(float("inf"))
    home = written(hits(c, q.withColumn("list", F.col("lists")[0]).withColumn("kth", none)), "nearest")
    best = home.withColumn("r", F.row_number().over(by)).where(F.col("r") <= k).groupBy("query").agg(F.count("*").alias("n"), F.max("far").alias("far"))
    kth = best.where(F.col("n") == k).select(F.col("query").alias("row"), "far")
    rest = q.join(kth, "row", "left").withColumn("kth", F.coalesce("far", none)).withColumn("list", F.explode(F.slice("lists", 2, F.greatest(F.size("lists") - 1, F.lit(1)))))
    found = home.union(hits(c, rest))
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op11_adaptive_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(finite_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding"), "id % 20 = 0", 20)
