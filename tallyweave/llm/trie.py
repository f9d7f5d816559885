"""Operator 12, the trie of conversation prefixes, screened by a count-min sketch.

Conversations are rebuilt in one sorted stream per family (a conversation whose id is a multiple of
``family`` and those that begin with its turns), which makes a chained digest of each prefix; texts stay
where they are read, their digests and word counts go on. A count-min sketch of all prefix digests is
made by tasks, merged by blocks of cells, and of it one bit a cell, "counted more than once", is handed
to all tasks. It is ``ROWS * WIDTH`` bits (8 MB) at most, whatever the input; where the prefixes are many
more than its cells it proves less and more rows go the exact way, with the same result. A prefix with
a cell that was counted once belongs to one conversation; such tails, and what follows them, are nodes as
they stand. Only prefixes that may be shared are shuffled, and grouped exactly.

Subtrees need no walk. A node is known by its smallest member and its depth, and along a conversation
the nodes whose smallest member it is are all from some depth on. So a conversation knows, from its shared
rows alone, from where on it stands for its nodes, and what it adds to each node above: a leaf, a child, and
the words that are saved up to there. All figures of a node are sums over its members, made before they are
shuffled. Lists of members that end at a node are cut into chunks by ranges of (node, id) before they are
hashed in order.

Defined cases: rows with a null conv_id take no part; turns that are equal come in the order of role, then of
the SHA-256 of the text; a repeated row is a turn of its own; null role or text is empty; an empty table has
no root and gives an empty result; a conversation without turns ends at the root; other columns don't matter,
whatever their names; a long conversation is one stream of turns, of which a task holds one batch.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyweave.llm.common import lean, partitions, table, written

FAMILY, SHARED = 20, 4
#: The sketch: rows, most cells of a row, cells of a block.
ROWS, WIDTH, BLOCK = 4, 1 << 24, 1 << 13
#: Ids of one chunk of a list of members; shared nodes that may be broadcast (about 100 bytes each).
CHUNK, SMALL = 4096, 100_000
NOTHING = hashlib.sha256().hexdigest()

_PREFIX = pa.schema([("c", pa.int64()), ("d", pa.int64()), ("hi", pa.int64()), ("lo", pa.int64()), ("up_hi", pa.int64()), ("up_lo", pa.int64()), ("words", pa.int64()), ("before", pa.int64()), ("last", pa.bool_())])
PREFIX = "c long, d long, hi long, lo long, up_hi long, up_lo long, words long, before long, last boolean"


def begun(conv_id: int) -> int:
    """How many turns a conversation takes over."""
    return zlib.crc32(str(conv_id).encode()) % SHARED


class _Conversation:
    """The rows of one rebuilt conversation; a row is given out when it is known whether another follows."""

    def __init__(self, c: int):
        self.c, self.skip, self.digest, self.before = c, begun(c), bytes(16), 0
        self.row = (c, 0, 0, 0, 0, 0, 0, 0)

    def turn(self, role: str, text: bytes, words: int) -> tuple:
        done, r = (*self.row, False), role.encode()
        up = self.row[2:4]
        self.digest = hashlib.blake2b(self.digest + len(r).to_bytes(8, "big") + r + text, digest_size=16).digest()
        hi, lo = (int.from_bytes(self.digest[i : i + 8], "big", signed=True) for i in (0, 8))
        self.row = (self.c, self.row[1] + 1, hi, lo, *up, words, self.before)
        self.before += words
        return done

    def end(self) -> tuple:
        return (*self.row, True)


def prefixes(conversations: DataFrame) -> DataFrame:
    """A row per conversation and depth (0 too): digest of the prefix and of the one above, words of its last
    turn and of all before, whether it is the conversation's last."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, first, now, skipped, out = None, [], None, 0, []
        for batch in batches:
            for base, c, role, text, words in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if now is None or c != now.c:
                    if now is not None:
                        out.append(now.end())
                    if base != at:
                        at, first = base, []
                    now, skipped = _Conversation(c), 0
                    if c != base:
                        out += [now.turn(*x) for x in first[: now.skip]]
                if c == base and len(first) < SHARED - 1:
                    first.append((role, text, words))
                if c == base or skipped >= now.skip:
                    out.append(now.turn(role, text, words))
                else:
                    skipped += 1
                if len(out) > 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), _PREFIX, strict=True)], schema=_PREFIX)
                    out = []
        if now is not None:
            out.append(now.end())
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), _PREFIX, strict=True)], schema=_PREFIX)

    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    t = conversations.select(F.col("conv_id").cast("long").alias("c"), F.col("turn").alias("turn"), text("role").alias("role"), text("text").alias("text")).where("c is not null")
    words = F.size(F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("long")
    t = t.select((F.col("c") - F.col("c") % FAMILY).alias("base"), "c", "turn", "role", F.unhex(F.sha2("text", 256)).alias("digest"), words.alias("words"))
    n = max(partitions(t.sparkSession), 2)
    dealt = t.repartition(n, "base").sortWithinPartitions("base", F.col("c") != F.col("base"), "c", F.col("turn").asc_nulls_first(), "role", "digest")
    return dealt.select("base", "c", "role", "digest", "words").mapInArrow(lean(stream), PREFIX)


def cells(hi: np.ndarray, lo: np.ndarray, width: int) -> list[np.ndarray]:
    """The cell of each digest in each row of the sketch."""
    parts = [x.astype(np.uint64) for x in (lo, lo >> 32, hi, hi >> 32)]
    return [(x & np.uint64(width - 1)).astype(np.int64) + k * width for k, x in enumerate(parts)]


def sketch(prefixes: DataFrame, width: int) -> np.ndarray:
    """For each cell whether more than one digest was counted there."""
    blocks = ROWS * width // BLOCK

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(ROWS * width, np.uint8)
        for batch in batches:
            for x in cells(batch.column(0).to_numpy(), batch.column(1).to_numpy(), width):
                u, n = np.unique(x, return_counts=True)
                seen[u] = np.minimum(2, seen[u] + n)
        found = np.flatnonzero(seen)
        ends = np.searchsorted(found, np.arange(1, blocks + 1) * BLOCK)
        rows, a = [], 0
        for k, b in enumerate(ends.tolist()):
            if b > a:
                own = found[a:b]
                once, twice = ((own[seen[own] == m] - k * BLOCK).astype("<u2").tobytes() for m in (1, 2))
                rows.append((k, once, twice))
            a = b
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f) for c, f in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["block", "once", "twice"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, seen = None, np.zeros(BLOCK, np.uint8)
        closed = lambda: pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([np.packbits(seen > 1).tobytes()])], names=["block", "bits"])
        for batch in batches:
            for block, once, twice in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if block != at:
                    if at is not None:
                        yield closed()
                    at, seen = block, np.zeros(BLOCK, np.uint8)
                one = np.frombuffer(once, "<u2")
                seen[one] = np.minimum(2, seen[one] + 1)
                seen[np.frombuffer(twice, "<u2")] = 2
        if at is not None:
            yield closed()

    parts = prefixes.where("d > 0").select("hi", "lo").mapInArrow(lean(count), "block int, once binary, twice binary")
    merged = parts.repartition(min(blocks, max(partitions(prefixes.sparkSession), 2)), "block").sortWithinPartitions("block").mapInArrow(merge, "block int, bits binary")
    bits = np.zeros(ROWS * width // 8, np.uint8)
    for block, part in merged.collect():  # ROWS * WIDTH bits at most
        bits[block * BLOCK // 8 : (block + 1) * BLOCK // 8] = np.frombuffer(part, np.uint8)
    return bits


def screened(prefixes: DataFrame, n: int) -> DataFrame:
    """The rows below the root with `kind`: 2 for a prefix that may be shared, 1 for one of a single
    conversation below one that may be shared, 0 for one below such a one."""
    spark = prefixes.sparkSession
    width = BLOCK
    while width < min(2 * n, WIDTH):
        width *= 2
    bits = spark.sparkContext.broadcast(sketch(prefixes, width))

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        twice = bits.value

        def may(hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
            out = np.ones(len(hi), bool)
            for x in cells(hi, lo, width):
                out &= (twice[x >> 3] >> (7 - (x & 7)).astype(np.uint8) & 1).astype(bool)
            return out

        for batch in batches:
            d, hi, lo, up_hi, up_lo = (batch.column(i).to_numpy() for i in range(1, 6))
            above = may(up_hi, up_lo) | (d == 1)
            kind = np.where(above, np.where(may(hi, lo), 2, 1), 0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(kind, pa.int32())], names=[*batch.schema.names, "kind"])

    return written(prefixes.where("d > 0").mapInArrow(lean(stream), PREFIX + ", kind int"), "screened")


def _ends(rows: DataFrame) -> DataFrame:
    """rows (hi, lo, c) to the SHA-256 of the ids of each (hi, lo), ascending and joined by commas."""

    def chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        closed = lambda: pa.RecordBatch.from_pylist([{"hi": at[0], "lo": at[1], "first": held[0], "ids": ",".join(map(str, held))}], pa.schema([("hi", pa.int64()), ("lo", pa.int64()), ("first", pa.int64()), ("ids", pa.string())]))
        for batch in batches:
            for hi, lo, c in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if held and (at != (hi, lo) or len(held) == CHUNK):
                    yield closed()
                    held = []
                at = (hi, lo)
                held.append(c)
        if held:
            yield closed()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sha, out = None, None, []
        made = lambda: pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.string()), strict=True)], names=["hi", "lo", "sha"])
        for batch in batches:
            for hi, lo, ids in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if at == (hi, lo):
                    sha.update(b",")
                else:
                    if at is not None:
                        out.append((*at, sha.hexdigest()))
                    at, sha = (hi, lo), hashlib.sha256()
                sha.update(ids.encode())
            if out:
                yield made()
                out = []
        if at is not None:
            out.append((*at, sha.hexdigest()))
            yield made()

    n = max(partitions(rows.sparkSession), 2)
    chunks = rows.repartitionByRange(n, "hi", "lo", "c").sortWithinPartitions("hi", "lo", "c").mapInArrow(chunk, "hi long, lo long, first long, ids string")
    return chunks.repartition(n, "hi", "lo").sortWithinPartitions("hi", "lo", "first").select("hi", "lo", "ids").mapInArrow(digest, "hi long, lo long, sha string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """conversations (conv_id, turn, role, text) to the nodes of the trie of rebuilt conversations."""
    p = written(prefixes(conversations), "prefixes")
    n, turns, root = p.agg(F.count_if(F.col("d") == 0), F.count_if(F.col("d") > 0), F.min("c")).first()
    s = screened(p, turns)
    maybe = s.where("kind = 2")
    nodes = written(maybe.groupBy("hi", "lo").agg(F.count("*").alias("n_convs"), F.min("c").alias("rep"), F.min("last").alias("ends")).where("n_convs > 1"), "shared")
    near = F.broadcast(nodes) if nodes.count() <= SMALL else nodes
    found = maybe.drop("kind", "up_hi", "up_lo").join(near, ["hi", "lo"], "left").withColumns({"n_convs": F.coalesce("n_convs", F.lit(1)), "rep": F.coalesce("rep", "c"), "ends": F.coalesce("ends", "last")})
    own = Window.partitionBy("c")
    far = F.max(F.when(F.col("rep") != F.col("c"), F.struct("d", "rep", (F.col("before") + F.col("words")).alias("upto")))).over(own)
    leaf = F.coalesce(F.max(F.when(F.col("last"), (F.col("rep") == F.col("c")) & F.col("ends"))).over(own), F.lit(True))
    members = found.withColumns({"far": far, "leaf": leaf}).select("*", (F.coalesce("far.d", F.lit(0)) + 1).alias("since"), F.coalesce("far.rep", F.lit(root)).alias("over"), F.coalesce("far.upto", F.lit(0)).alias("upto"))
    members = written(members.drop("far"), "members")

    whole = lambda x: x.cast("long")
    mine = F.col("rep") == F.col("c")
    parent = F.when(F.col("since") < F.col("d"), F.col("c")).otherwise(F.col("over"))
    shared = members.where("n_convs > 1").groupBy("hi", "lo").agg(
        F.min("rep").alias("conv_id"), F.min("d").alias("depth"), F.max(F.when(mine, parent)).alias("parent_conv_id"), F.count("*").alias("n_convs"),
        F.sum(whole(~F.col("last") & (F.col("since") <= F.col("d") + 1))).alias("n_children"), F.sum(whole(F.col("leaf"))).alias("n_leaves"),
        F.sum(F.when(mine, 0).otherwise(F.col("upto") - F.col("before"))).alias("saved_tokens"),
    )
    ending = members.where("n_convs > 1 and last").select("hi", "lo", "c").union(p.where("d = 0 and last").select("hi", "lo", "c"))
    hashes = written(_ends(ending), "ends")
    shared = shared.join(hashes, ["hi", "lo"], "left").withColumn("ends_sha256", F.coalesce("sha", F.lit(NOTHING))).drop("hi", "lo", "sha")
    # One conversation's nodes: found so by exact grouping, below a prefix that may be shared, and further below.
    exact = members.where("n_convs = 1").select("c", "d", "last", parent.alias("parent_conv_id"))
    turned = members.where(F.col("d") == F.col("since") - 1).select("c", "since", F.col("rep").alias("over"))
    edge = s.where("kind = 1").select("c", "d", "last").join(turned, "c", "left").withColumns({"since": F.coalesce("since", F.lit(1)), "over": F.coalesce("over", F.lit(root))}).select("c", "d", "last", parent.alias("parent_conv_id"))
    tails = s.where("kind = 0").select("c", "d", "last", F.col("c").alias("parent_conv_id"))
    one = exact.union(edge).union(tails)
    one = one.select(F.col("c").alias("conv_id"), F.col("d").alias("depth"), "parent_conv_id", F.lit(1).cast("long").alias("n_convs"), whole(~F.col("last")).alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"), F.when(F.col("last"), F.sha2(F.col("c").cast("string"), 256)).otherwise(F.lit(NOTHING)).alias("ends_sha256"))
    below = written(shared.select(*one.columns).union(one), "nodes")
    ends = hashes.where("hi = 0 and lo = 0").agg(F.max("sha").alias("sha"))
    top = below.where("depth = 1").agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens")).join(F.broadcast(ends))
    top = top.where(F.lit(n > 0)).select(F.lit(root).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), F.lit(n).cast("long").alias("n_convs"), "n_children", F.coalesce("n_leaves", F.lit(1)).cast("long").alias("n_leaves"), F.coalesce("saved_tokens", F.lit(0)).cast("long").alias("saved_tokens"), F.coalesce("sha", F.lit(NOTHING)).alias("ends_sha256"))
    return below.union(top)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))


#: The polynomial of CRC-32, bits reversed.
_POLYNOMIAL = 0xEDB88320
SQL = rf"""
with t as (select conv_id as c, coalesce(role, '') as role, coalesce(text, '') as text, turn from conversations where conv_id is not null),
ids as (select c, c - c % {FAMILY} as base, xor(list_reduce(list_concat([4294967295::bigint], list_transform(string_split(cast(c as varchar), ''), lambda x: ascii(x)::bigint)),
  lambda a, x: list_reduce(list_concat([xor(a, x)], [0::bigint, 0, 0, 0, 0, 0, 0, 0]), lambda y, z: case when y & 1 = 1 then xor(y >> 1, {_POLYNOMIAL}::bigint) else y >> 1 end)), 4294967295::bigint) % {SHARED} as h
  from (select distinct c from t)),
o as (select *, row_number() over (partition by c order by turn nulls first, role, sha256(text)) as n from t),
r as (select i.c, 0 as part, n, role, text from ids i join o on o.c = i.base and n <= h union all select i.c, 1, n, role, text from ids i join o on o.c = i.c and n > h),
s as (select c, row_number() over (partition by c order by part, n) as d, sha256(sha256(role) || sha256(text)) as x, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) as words from r),
m as (select c, d, words, string_agg(x, '') over (partition by c order by d) as k from s union all select c, 0, 0, '' from ids),
z as (select *, max(d) over (partition by c) as n from m),
v as (select k, min(d) as depth, min(c) as conv_id, count(*) as n_convs, min(words) as words, sha256(coalesce(string_agg(cast(c as varchar), ',' order by c) filter (d = n), '')) as ends_sha256 from z group by k),
kids as (select left(k, length(k) - 64) as k, count(*) as n_children from v where depth > 0 group by 1),
w as (select v.*, coalesce(n_children, 0) as n_children from v left join kids using (k)),
up as (select left(k, 64 * i) as k, n_children, (n_convs - 1) * words as saved from w, unnest(range(0, depth + 1)) as u(i)),
sums as (select k, count(*) filter (n_children = 0) as n_leaves, sum(saved) as saved_tokens from up group by k)
select w.conv_id, cast(w.depth as bigint) as depth, case when w.depth > 0 then v.conv_id end as parent_conv_id, w.n_convs, w.n_children, n_leaves, cast(saved_tokens as bigint) as saved_tokens, w.ends_sha256
from w join sums using (k) left join v on w.depth > 0 and v.k = left(w.k, length(w.k) - 64)
"""
