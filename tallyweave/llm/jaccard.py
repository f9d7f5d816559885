"""Operator 8, exact n-gram Jaccard join with R-trees of count vectors.

A document's set is that of its distinct word shingles, as 64-bit hashes. Equal sets are one class.
Classes are brought together by the prefix rule: in one order of all shingles, two sets of Jaccard
similarity t or more share a shingle among the first n - ceil(t n) + 1 of each. The order puts up to
``HEAVY`` of the most frequent shingles last (any order is exact; this one keeps groups small). In the group of
a shingle each class is a point: how many of its shingles hash to each of ``DIMS`` cells. An R-tree
over the points bounds the overlap of a set with all below a node by the summed coordinate minima
with the node's upper corner, and with the size rule prunes what can't link; surviving pairs are
verified on the whole sets.

Only components are asked for, so not all pairs of a group are: a first round verifies for each
class its best survivor. For a second one the classes that still have survivors in other components
are brought together, each once, and all those pairs are verified where they meet, without being
sent anywhere; each link between different components is found then. Groups of more than ``GROUP``
members are dealt to pairs of blocks, each pair of members in one task at least. Links and labels
stay distributed.

Defined cases: texts without words, empty or null, have empty sets and link with nothing; with fewer
words than a shingle the whole sequence is the one shingle; repeated rows are one class.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.llm.common import Polynomial, forget, lean, mix, partitions, table, text_pieces, unused, written
from tallyweave.llm.components import components, ordered

DIMS, HEAVY, GROUP, LEAF, PARTNERS = 256, 1 << 16, 2048, 32, 64
#: Bytes of text that are hashed together, and shingles that are counted together.
PIECE, COUNTED = (1 << 19) - 1, 2_000_000
_WHITE = np.zeros(256, bool)
_WHITE[[32, 9, 10, 11, 12, 13]] = True
_TIMES = mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)
_hash = Polynomial(8)
#: Bytes of the longest word that is hashed as a polynomial.
LONG = 128


def shingles(data: np.ndarray, offsets: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """Of each text its sorted distinct shingle hashes."""
    low = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    word = ~_WHITE[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    heads = offsets[:-1][offsets[:-1] < len(data)]
    first[heads] = word[heads]
    last = word.copy()
    last[:-1] &= ~word[1:]
    tails = offsets[1:] - 1
    tails = tails[tails >= 0]
    last[tails] = word[tails]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    sums = _hash.prefix(low)
    h = mix(_hash.of(sums, start, end) + (end - start).astype(np.uint64))
    for i in np.flatnonzero(end - start > LONG).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(low[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    s = np.zeros(max(0, len(h) - k + 1), np.uint64)
    for i in range(k):
        s += h[i : len(h) - k + 1 + i] * _TIMES[i]
    s = mix(s)
    bounds = np.searchsorted(start, offsets).tolist()
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a >= k:
            yield np.unique(s[a : b - k + 1])
        elif b > a:
            yield mix((h[a:b] * _TIMES[: b - a]).sum(keepdims=True) + np.uint64(b - a))
        else:
            yield h[:0]


def class_of(u: np.ndarray) -> int:
    """The 64-bit name of a set."""
    return int(mix((mix(u ^ np.uint64(0x5851F42D4C957F2D)).sum(keepdims=True) + np.uint64(len(u))))[0].astype(np.int64)) if len(u) else 0


def prefix_length(n: int, per_cent: int) -> int:
    return n - -(-per_cent * n // 100) + 1


def point(u: np.ndarray) -> bytes:
    return np.minimum(np.bincount((u & np.uint64(DIMS - 1)).astype(np.int64), minlength=DIMS), 255).astype(np.uint8).tobytes()


def _sets(docs: DataFrame, k: int) -> DataFrame:
    """Per row (kind 0): id, n, class and point; and (kind 1) shingles that are frequent in a task."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, seen = [], 0, set()

        def often() -> pa.RecordBatch:
            t, n = np.unique(np.concatenate(held), return_counts=True)
            t, n = t[n >= 8].view(np.int64), n[n >= 8]
            return pa.RecordBatch.from_arrays([pa.array(np.ones(len(t), np.int32)), pa.nulls(len(t), pa.int64()), pa.array(n.astype(np.int64)), pa.array(t), pa.nulls(len(t), pa.binary())], names=["kind", "doc_id", "n", "c", "point"])

        for batch in batches:
            ids = batch.column(0).to_pylist()
            for a, b, data, offsets in text_pieces(batch, "text", PIECE):
                rows = []
                for doc, u in zip(ids[a:b], shingles(data, offsets, k), strict=True):
                    rows.append((0, doc, len(u), c := class_of(u), point(u)))
                    if c not in seen:
                        held.append(u)
                        size += len(u)
                        seen.add(c)
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["kind", "doc_id", "n", "c", "point"])
                if size > COUNTED:
                    yield often()
                    held, size, seen = [], 0, set()
        if held:
            yield often()

    return docs.mapInArrow(lean(stream), "kind int, doc_id long, n long, c long, point binary")


def _prefixes(docs: DataFrame, k: int, per_cent: int, heavy) -> DataFrame:
    """(t, n, c): the prefix shingles of each row's set; a task sends one class once, as far as it
    remembers."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        often = heavy.value
        for batch in batches:
            for _, _, data, offsets in text_pieces(batch, "text", PIECE):
                ts, ns, cs = [], [], []
                for u in shingles(data, offsets, k):
                    if not len(u) or (c := class_of(u)) in seen:
                        continue
                    if len(seen) < 1_000_000:
                        seen.add(c)
                    if len(often):
                        is_often = often[np.minimum(np.searchsorted(often, u), len(often) - 1)] == u
                        u = np.concatenate((u[~is_often], u[is_often]))
                    ts.append(u[: prefix_length(len(u), per_cent)])
                    ns.append(len(u))
                    cs.append(c)
                if ts:
                    each = [len(x) for x in ts]
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ts).view(np.int64)), pa.array(np.repeat(np.array(ns, np.int64), each)), pa.array(np.repeat(np.array(cs, np.int64), each))], names=["t", "n", "c"])

    return docs.mapInArrow(lean(stream), "t long, n long, c long")


def grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Batches sorted by key as tables that hold whole groups, of one batch's size where groups allow."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        k = batch.column(batch.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
        cut = int(np.searchsorted(k, k[-1]))  # where the last group starts
        if held and cut or held and held[-1].column(key)[0].as_py() != k[-1]:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        elif not held and cut:
            yield pa.Table.from_batches([batch.slice(0, cut)])
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def _groups(prefixes: DataFrame, per_cent: int) -> DataFrame:
    """(g, n, c): the groups of classes that share a prefix shingle, those with the same members once."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in grouped(batches, "t"):
            tok, n, c = (t.column(x).to_numpy() for x in ("t", "n", "c"))
            new = np.ones(len(tok), bool)
            new[1:] = (tok[1:] != tok[:-1]) | (c[1:] != c[:-1]) | (n[1:] != n[:-1])
            tok, n, c = tok[new], n[new], c[new]
            near = np.zeros(len(tok), bool)  # of a size with the next in the group
            near[:-1] = (tok[1:] == tok[:-1]) & (100 * n[:-1] >= per_cent * n[1:])
            keep = near.copy()
            keep[1:] |= near[:-1]
            chain = np.cumsum(~np.concatenate(([False], near[:-1])))[keep]  # runs of sizes that may link
            tok, n, c = tok[keep], n[keep], c[keep]
            if not len(tok):
                continue
            heads = np.flatnonzero(np.concatenate(([True], chain[1:] != chain[:-1])))
            sizes = np.diff(np.append(heads, len(tok)))
            g = np.repeat(np.add.reduceat(mix(c.view(np.uint64)), heads), sizes).view(np.int64)
            small = np.repeat(sizes <= GROUP, sizes)
            out = [(g[small], n[small], c[small])]
            for a, m in zip(heads[sizes > GROUP].tolist(), sizes[sizes > GROUP].tolist(), strict=True):
                blocks = -(-m // (GROUP // 2))
                own = np.arange(m) * blocks // m
                for i in range(blocks):
                    for j in range(i + 1, blocks):
                        at = a + np.flatnonzero((own == i) | (own == j))
                        if 100 * n[a + np.searchsorted(own, i, "right") - 1] < per_cent * n[a + np.searchsorted(own, j)]:
                            break  # sorted by size, so no later block fits either
                        out.append((np.full(len(at), int(mix(np.array([g[a] + i * 1_000_003 + j]).view(np.uint64)).view(np.int64)[0])), n[at], c[at]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=["g", "n", "c"])

    spark = prefixes.sparkSession
    dealt = prefixes.repartition(max(partitions(spark), 2), "t").sortWithinPartitions("t", "n", "c")
    return dealt.mapInArrow(lean(stream), "g long, n long, c long").distinct()


class RTree:
    """Count vectors packed top down: nodes split at the median of their widest coordinate; each has
    its upper corner and its smallest and largest set size."""

    def __init__(self, v: np.ndarray, n: np.ndarray):
        self.v, self.n, self.nodes = v, n, []
        self._pack(np.arange(len(v)))

    def _pack(self, at: np.ndarray) -> int:
        own = self.v[at]
        i = len(self.nodes)
        self.nodes.append([own.max(0), self.n[at].min(), self.n[at].max(), at, ()])
        if len(at) > LEAF:
            spread = own.max(0) - own.min(0)
            order = np.argsort(own[:, int(spread.argmax())], kind="stable")
            m = len(at) // 2
            self.nodes[i][4] = (self._pack(at[order[:m]]), self._pack(at[order[m:]]))
        return i

    def survivors(self, q: np.ndarray, n: int, per_cent: int) -> tuple[np.ndarray, np.ndarray]:
        """Points that may link with a set of size n and vector q, and the bounds of the overlaps."""
        todo, found, bounds = [0], [], []
        while todo:
            top, least, most, at, kids = self.nodes[todo.pop()]
            if 100 * most < per_cent * n or 100 * n < per_cent * least:
                continue
            if kids:
                if (100 + per_cent) * int(np.minimum(q, top).sum(dtype=np.int64)) >= per_cent * (n + max(int(least), -(-per_cent * n // 100))):
                    todo += kids
                continue
            b = np.minimum(self.v[at], q).sum(1, dtype=np.int64)
            ok = (100 + per_cent) * b >= per_cent * (n + self.n[at])
            found.append(at[ok])
            bounds.append(b[ok])
        return (np.concatenate(found), np.concatenate(bounds)) if found else (np.empty(0, int), np.empty(0, int))


def _survivors(members: DataFrame, per_cent: int, every: bool) -> DataFrame:
    """members (g, n, c, point, label) to (a, b, gain): pairs of a group that may link and have
    different labels; a comes before b by (n, c). For each b and group the best one; or, with
    `every`, instead of all pairs a star that joins the members of a group that are in any."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in grouped(batches, "g"):
            g, n, c, label = (t.column(x).to_numpy() for x in ("g", "n", "c", "label"))
            v = np.frombuffer(b"".join(t.column("point").to_pylist()), np.uint8).reshape(-1, DIMS)
            heads = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))
            sizes = np.diff(np.append(heads, len(g)))
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            two = heads[sizes == 2]
            full = (v == 255).any(1)
            if len(two):
                i, j = two, two + 1
                b = np.minimum(v[i], v[j]).sum(1, dtype=np.int64)
                ok = (label[i] != label[j]) & (((100 + per_cent) * b >= per_cent * (n[i] + n[j])) | full[i] | full[j]) & (100 * n[i] >= per_cent * n[j])
                out.append((c[i][ok], c[j][ok], b[ok] / (n[i] + n[j])[ok]))
            for a, m in zip(heads[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
                s = slice(a, a + m)
                if (label[s] == label[a]).all():
                    continue
                own, size, who, names = v[s].astype(np.int16), n[s], label[s], c[s]
                own[full[s]] = 32767  # a cell that may hold more than it can say bounds nothing
                tree, involved = RTree(own, size), np.zeros(m, bool)
                for j in range(1, m):
                    i, b = tree.survivors(own[j], int(size[j]), per_cent)
                    ok = (i < j) & (who[i] != who[j])
                    i, b = i[ok], b[ok]
                    if len(i):
                        gain = b / (size[i] + size[j])
                        if every:
                            involved[i] = involved[j] = True
                        else:
                            best = np.lexsort((i, -gain))[:1]
                            out.append((names[i[best]], names[j : j + 1], gain[best]))
                if involved.any():
                    star = names[involved]
                    out.append((np.full(len(star) - 1, star[0]), star[1:], np.zeros(len(star) - 1)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=["a", "b", "gain"])

    spark = members.sparkSession
    dealt = members.repartition(max(partitions(spark), 2), "g").sortWithinPartitions("g", "n", "c")
    return dealt.mapInArrow(lean(stream), "a long, b long, gain double")


def _verified(pairs: DataFrame, texts: DataFrame, k: int, per_cent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets link. a's partners are dealt to parts of some PARTNERS; its text goes
    to each of these, and the partners stream past it."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own = None, np.empty(0, np.uint64)
        for batch in batches:
            a, b = (batch.column(i).to_pylist() for i in (0, 1))
            out = []
            for x, y, data, offsets in text_pieces(batch, "text", PIECE):
                for p, q, u in zip(a[x:y], b[x:y], shingles(data, offsets, k), strict=True):
                    if q is None:
                        now, own = p, u
                    elif p == now:
                        both = len(np.intersect1d(own, u, assume_unique=True))
                        if 100 * both >= per_cent * (len(own) + len(u) - both):
                            out.append((p, q))
                    else:
                        raise RuntimeError("a pair without its first text")
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in zip(*out, strict=True)], names=["a", "b"])

    partners = pairs.groupBy("a").agg(F.ceil(F.count("*") / PARTNERS).alias("parts"))
    salted = written(pairs.join(partners, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).alias("s")), "salted")
    second = salted.join(texts.select(F.col("c").alias("b"), "text"), "b").select("a", "b", "s", "text")
    first = salted.select("a", "s").distinct().join(texts.select(F.col("c").alias("a"), "text"), "a").select("a", F.lit(None).cast("long").alias("b"), "s", "text")
    dealt = first.union(second).repartition(max(partitions(pairs.sparkSession), 2), "a", "s").sortWithinPartitions("a", "s", F.col("b").asc_nulls_first()).select("a", "b", "text")
    return dealt.mapInArrow(lean(stream), "a long, b long")


def _within(routed: DataFrame, k: int, per_cent: int) -> DataFrame:
    """routed (key, c, label, text) to links (a, b) that join all labels which links between members
    of one key join: R-tree survivors of different labels are verified until they are joined."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in grouped(batches, "key"):
            t = t.combine_chunks()
            key, c, label = (t.column(x).to_numpy() for x in ("key", "c", "label"))
            sets = [u for b in t.to_batches() for _, _, data, offsets in text_pieces(b, "text", PIECE) for u in shingles(data, offsets, k)]
            heads = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            out = []
            for x, y in zip(heads.tolist(), np.append(heads[1:], len(key)).tolist(), strict=True):
                order = sorted(range(x, y), key=lambda i: (len(sets[i]), c[i]))
                own, size = [sets[i] for i in order], np.array([len(sets[i]) for i in order])
                up = {int(label[i]): int(label[i]) for i in order}
                who = [int(label[i]) for i in order]

                def root(v: int, up=up) -> int:
                    while up[v] != v:
                        up[v] = v = up[up[v]]
                    return v

                v = np.stack([np.frombuffer(point(u), np.uint8).astype(np.int16) for u in own])
                v[(v == 255).any(1)] = 32767
                tree = RTree(v, size)
                for j in range(1, len(own)):
                    i, bound = tree.survivors(v[j], int(size[j]), per_cent)
                    i, bound = i[i < j], bound[i < j]
                    for i in i[np.argsort(-bound / (size[i] + size[j]), kind="stable")].tolist():
                        if root(who[i]) != root(who[j]):
                            both = len(np.intersect1d(own[i], own[j], assume_unique=True))
                            if 100 * both >= per_cent * (int(size[i]) + int(size[j]) - both):
                                up[root(who[i])] = root(who[j])
                                out.append((int(c[order[i]]), int(c[order[j]])))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in zip(*out, strict=True)], names=["a", "b"])

    dealt = routed.repartition(max(partitions(routed.sparkSession), 2), "key").sortWithinPartitions("key", "c")
    return dealt.mapInArrow(lean(stream), "a long, b long")


def _routed(stars: DataFrame, labels: DataFrame, texts: DataFrame) -> DataFrame:
    """(key, c, label, text): members of the stars that hang together have one key; more than GROUP
    of them are dealt to pairs of blocks, each with a key, in which every pair of members meets."""
    route = written(components(stars), "routes")
    sizes = route.groupBy("root").count().select("root", F.when(F.col("count") > GROUP, F.ceil(F.col("count") / (GROUP // 2))).otherwise(1).cast("int").alias("blocks"))
    m = route.join(sizes, "root").select("root", F.col("node").alias("c"), "blocks", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("own"))
    other = F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: o != F.col("own")))
    m = m.withColumn("other", F.explode(other)).select(F.xxhash64("root", F.least("own", "other"), F.greatest("own", "other")).alias("key"), "c")
    return m.join(labels.select("c", "label"), "c").join(texts, "c").select("key", "c", "label", "text")


def _least_of_heavy(counts: DataFrame) -> int:
    """The least count from which on at most HEAVY shingles are left. Counts are told apart by a
    sixteenth of a power of two, so what the driver gets is a thousand rows at most."""
    step = F.floor(16 * F.log2("n"))
    left, least = HEAVY, 1 << 62
    for r in sorted(counts.groupBy(step.alias("step")).agg(F.count("*").alias("m"), F.min("n").alias("least")).collect(), key=lambda r: -r["step"]):
        left -= r["m"]
        if left < 0:
            break
        least = r["least"]
    return least


def jaccard_join(docs: DataFrame, *, k: int = 4, per_cent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id (the smallest id that links reach)."""
    spark = docs.sparkSession
    d = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    made = written(_sets(d, k), "sets")
    rows = made.where("kind = 0").drop("kind")
    counts = made.where("kind = 1").groupBy("c").agg(F.sum("n").alias("n"))
    often = counts.where(F.col("n") >= _least_of_heavy(counts)).select("c").toArrow()
    heavy = spark.sparkContext.broadcast(np.sort(often.column("c").to_numpy().view(np.uint64)))
    groups = written(_groups(_prefixes(d, k, per_cent, heavy), per_cent), "groups")
    needed = groups.select("c").distinct()
    classes = written(rows.where("n > 0").groupBy("c").agg(F.min("doc_id").alias("doc_id"), F.first("point").alias("point")).join(needed, "c", "left_semi"), "classes")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            want = batch.column(1).to_numpy(zero_copy_only=False)
            found = [class_of(u) for _, _, data, offsets in text_pieces(batch, "text", PIECE) for u in shingles(data, offsets, k)]
            ok = pa.array(np.array(found, np.int64) == want)
            yield pa.RecordBatch.from_arrays([batch.column(1).filter(ok), batch.column(0).filter(ok)], names=["c", "text"])

    by_id = classes.select(F.col("doc_id").alias("_d"), "c")
    found = d.join(by_id, F.col("doc_id").eqNullSafe(F.col("_d"))).select("text", "c").mapInArrow(lean(whole), "c long, text string")
    repeated = rows.groupBy("doc_id").count().where("count > 1").isEmpty()
    texts = written(found if repeated else found.dropDuplicates(["c"]), "texts")

    points = classes.select("c", "point")
    members = groups.join(points.withColumn("label", F.col("c")), "c")
    best = _survivors(members, per_cent, every=False).groupBy("b").agg(F.max_by("a", F.struct("gain", "a")).alias("a"))
    links = written(_verified(best, texts, k, per_cent), "verified")
    roots = components(links)
    labels = points.join(roots.select(F.col("node").alias("c"), "root"), "c", "left").select("c", "point", F.coalesce("root", "c").alias("label"))
    labels = written(labels, "labels")
    stars = _survivors(groups.join(labels, "c"), per_cent, every=True)
    more = written(_within(_routed(stars, labels, texts), k, per_cent), "verified")
    forget(groups, classes, texts, labels)  # the texts are most of what would be left on disk while the result is used
    if not more.isEmpty():
        roots = components(links.union(more))
    named = rows.join(roots.select(F.col("node").alias("c"), "root"), "c", "left").withColumn("root", F.coalesce("root", "c"))
    least = named.where("n > 0").groupBy("root").agg(F.min("doc_id").alias("least"))
    return named.join(least, "root", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))


def without_near_duplicates(docs: DataFrame, *, k: int = 5, per_cent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group of near duplicates, that with the smallest id (of equal ids,
    the first by text); rows without words all stay."""
    place = unused(docs, "_place")
    d = ordered(docs, id_col, text_col, place)
    linked = jaccard_join(d.select(F.col(place).alias("doc_id"), F.col(f"`{text_col}`").alias("text")), k=k, per_cent=per_cent)
    gone = linked.where("doc_id <> component_id").select(F.col("doc_id").alias(place))
    return d.join(gone, place, "left_anti").select(*[f"`{c}`" for c in docs.columns])


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"))
