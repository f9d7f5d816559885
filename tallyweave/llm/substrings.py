"""Operator 3, removal of repeated byte strings with suffix arrays by external induced sorting.

A window of ``LENGTH`` bytes is a repeat when the same string starts earlier (in a smaller document,
or earlier in the same one); every byte that a repeat covers goes. Suffixes have to be sorted across
documents, so what may be equal is brought to one shard first: each window has an anchor, the
``GRAM`` bytes in it with the smallest hash, and equal windows have equal anchors. Neighbouring
windows with one anchor form a block. Blocks that are equal as a whole get one name, and all but
the first of them are repeats; of each block's first occurrence the rest is decided by suffix and
common-prefix arrays over all different blocks with its anchor (see ``induced``), in which the runs
of suffixes that share ``LENGTH`` bytes have one first start and otherwise repeats.

Blocks are named in each batch before they are shuffled, so a passage of a third of all rows is
sent once by each batch; blocks with an anchor of their own, most of them, go no further.

An anchor whose different blocks have more than ``HOT`` bytes (a common phrase in many surroundings) is
split: windows are dealt by where the anchor stands in them, in more and more parts, and the bytes that
all windows of such a part share, anchor included, name a smaller group. With one part for each place
the group's name is the whole window, and its first occurrence is a plain aggregate. So no suffix array
is over much more than ``HOT`` bytes, whatever the corpus repeats; the naming before it takes the rows of all
blocks of one anchor (places and hashes, not texts) in one task.

Names are 64-bit hashes of blocks within one anchor's 64-bit hash. Defined cases: a null text is
empty; documents with equal ids are ordered by their texts; texts under ``LENGTH`` bytes stay whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.llm.common import Polynomial, lean, lean_group, mix, partitions, table, text_pieces, written
from tallyweave.llm.components import ordered
from tallyweave.llm.induced import suffix_array
from tallyweave.llm.jaccard import grouped

LENGTH, GRAM, SHARD = 100, 28, 2 << 20
#: Bytes of different blocks of one anchor that are split, and the numbers of parts to split into.
HOT, PARTS = 4 << 20, (2, 8, LENGTH - GRAM + 1)
#: Window starts of one long text that are looked at together (their places take 24 bits).
SEGMENT = 1 << 23
_grams, _blocks = Polynomial(31), Polynomial(32)


def sliding_least(key: np.ndarray, width: int) -> np.ndarray:
    """Minimum of key[i : i + width] for each i (the last windows are short)."""
    n = len(key)
    m = -(-n // width) * width
    padded = np.full(m + width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = key
    square = padded.reshape(-1, width)
    to_end = np.minimum.accumulate(square[:, ::-1], 1)[:, ::-1].ravel()
    from_start = np.minimum.accumulate(square, 1).ravel()
    return np.minimum(to_end[:n], from_start[width - 1 : n + width - 1])


def blocks(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Of each block: the row, its first window's start in the row, its windows, the anchor's hash,
    the block's name, and the anchor's place in the first window."""
    n = len(data)
    none = np.empty(0, np.int64)
    if n < length:
        return none, none, none, none.view(np.uint64), none.view(np.uint64), none
    if n >= SEGMENT + length and len(offsets) == 2:  # one long text, by ranges of window starts
        found = [(blocks(own := data[a : a + SEGMENT + length - 1], np.array([0, len(own)]), length, gram), a) for a in range(0, n - length + 1, SEGMENT)]
        return tuple(np.concatenate([x[i] + a * (i == 1) for x, a in found]) for i in range(6))
    at = np.arange(n - gram + 1)
    sums = _grams.prefix(data)
    h = mix(_grams.of(sums, at, at + gram))
    low = np.uint64((1 << 24) - 1)
    least = sliding_least(h & ~low | at.astype(np.uint64), length - gram + 1)
    anchor = (least & low).astype(np.int64)
    room = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(n)
    ok = room[: n - length + 1] >= length
    anchor = anchor[: n - length + 1]
    start = ok.copy()
    start[1:] &= (anchor[1:] != anchor[:-1]) | ~ok[:-1] | (room[1 : n - length + 1] > room[: n - length])
    first = np.flatnonzero(start)
    stop = ok.copy()
    stop[:-1] &= start[1:] | ~ok[1:]
    last = np.flatnonzero(stop)
    b = _blocks.prefix(data)
    name = mix(_blocks.of(b, first, last + length) + ((last - first) * 1009 + anchor[first] - first).astype(np.uint64))
    row = np.searchsorted(offsets, first, "right") - 1
    return row, first - offsets[row], last - first + 1, h[anchor[first]], name, anchor[first] - first


def joined_runs(doc: np.ndarray, s: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows of a document that follow each other, as one: document, start, windows."""
    if not len(doc):
        return doc, s, n
    order = np.lexsort((s, doc))
    doc, s, n = doc[order], s[order], n[order]
    heads = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (s[1:] != s[:-1] + n[:-1])))
    return doc[heads], s[heads], np.add.reduceat(n.astype(np.int64), heads)


BLOCKS = "kind int, h long, c long, doc long, s int, n int"
BLOCK_NAMES = ("kind", "h", "c", "doc", "s", "n")
_BLOCKS = pa.schema([("kind", pa.int32()), ("h", pa.int64()), ("c", pa.int64()), ("doc", pa.int64()), ("s", pa.int32()), ("n", pa.int32())])


def _found(docs: DataFrame) -> DataFrame:
    """docs (doc, text) to their blocks (kind 0), and those known to be repeats by an earlier one of
    the same batch (kind 1)."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            out = []
            for a, b, data, offsets in text_pieces(batch, "text", (1 << 20) - 1):
                row, s, n, h, c, _ = blocks(data, offsets)
                out.append((h.view(np.int64), c.view(np.int64), ids[a:b][row], s, n))
            h, c, doc, s, n = (np.concatenate(x) for x in zip(*out, strict=True))
            order = np.lexsort((s, doc, c, h))
            h, c, doc, s, n = (x[order] for x in (h, c, doc, s, n))
            again = np.zeros(len(h), bool)
            again[1:] = (h[1:] == h[:-1]) & (c[1:] == c[:-1])
            d, x, y = joined_runs(doc[again], s[again], n[again])
            spread = mix(d.astype(np.uint64)).view(np.int64)
            kind = np.concatenate((np.zeros(int((~again).sum()), np.int32), np.ones(len(d), np.int32)))
            columns = kind, np.concatenate((h[~again], spread)), np.concatenate((c[~again], spread)), np.concatenate((doc[~again], d)), np.concatenate((s[~again], x)).astype(np.int32), np.concatenate((n[~again], y)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(columns, _BLOCKS, strict=True)], schema=_BLOCKS)

    return docs.mapInArrow(lean(stream), BLOCKS)


def _named(found: DataFrame) -> DataFrame:
    """Blocks by anchor: repeats as a whole (kind 1), and first occurrences that other blocks with
    their anchor may repeat in part (kind 2)."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in grouped(batches, "h"):
            known, h, c, doc, s, n = (t.column(x).to_numpy() for x in BLOCK_NAMES)
            out = [(known[known == 1], h[known == 1], c[known == 1], doc[known == 1], s[known == 1], n[known == 1])]
            h, c, doc, s, n = (x[known == 0] for x in (h, c, doc, s, n))
            order = np.lexsort((s, doc, c, h))
            h, c, doc, s, n = (x[order] for x in (h, c, doc, s, n))
            if len(h):
                new_h = np.append(True, h[1:] != h[:-1])
                new_c = new_h | np.append(True, c[1:] != c[:-1])
                names = np.add.reduceat(new_c.astype(np.int64), np.flatnonzero(new_h))
                several = names[np.cumsum(new_h) - 1] > 1
                d, x, y = joined_runs(doc[~new_c], s[~new_c], n[~new_c])
                out.append((np.ones(len(d), np.int32), d, d, d, x, y))
                keep = new_c & several
                out.append((np.full(int(keep.sum()), 2, np.int32), *(x[keep] for x in (h, c, doc, s, n))))
            columns = [np.concatenate(x) for x in zip(*out, strict=True)]
            if len(columns[0]):
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type, safe=False) for x, f in zip(columns, _BLOCKS, strict=True)], schema=_BLOCKS)

    dealt = found.repartition(max(partitions(found.sparkSession), 2), "h").sortWithinPartitions("h")
    return dealt.mapInArrow(lean(stream), BLOCKS)


SPANS = "doc long, s int, e int"


def parts_of(place: int, windows: int, parts: int) -> Iterator[tuple[int, int, int, int, int]]:
    """The windows of a block by where the anchor stands in them (`place` in the first one, one less in
    each that follows): part, first window, windows, and the bytes from and to that all of them and all
    others of that part share, counted from the block's start."""
    width = -(-(LENGTH - GRAM + 1) // parts)
    least = place - windows + 1
    for part in range(least // width, place // width + 1):
        low, high = max(least, part * width), min(place, part * width + width - 1)
        yield part, place - high, high - low + 1, place - part * width, place + LENGTH - min(part * width + width - 1, LENGTH - GRAM)


PIECES = "key binary, doc long, s int, n int, bytes binary"
_PIECES = pa.schema([("key", pa.binary()), ("doc", pa.int64()), ("s", pa.int32()), ("n", pa.int32()), ("bytes", pa.binary())])


def split(rows: list[tuple[bytes, int, int, int, bytes]], parts: int) -> Iterator[tuple[bytes, int, int, int, bytes]]:
    """Pieces (blocks or parts of them) dealt to that many parts."""
    at = 0
    while at < len(rows):
        end, size = at, 0
        while end < len(rows) and (size == 0 or size + len(rows[end][4]) < 1 << 22):
            size += len(rows[end][4])
            end += 1
        offsets = np.cumsum([0, *(len(r[4]) for r in rows[at:end])])
        row, _, n, _, _, place = blocks(np.frombuffer(b"".join(r[4] for r in rows[at:end]), np.uint8), offsets, LENGTH, GRAM)
        for i, windows, where in zip((row + at).tolist(), n.tolist(), place.tolist(), strict=True):
            _, doc, s, _, raw = rows[i]
            for part, first, own, a, b in parts_of(where, windows, parts):
                key = hashlib.blake2b(raw[a:b], digest_size=16, person=part.to_bytes(2, "little")).digest()
                yield key, doc, s + first, own, raw[first : first + own + LENGTH - 1]
        at = end


def _pieces(rows: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), _PIECES, strict=True)], schema=_PIECES)


def _split(pieces: DataFrame, parts: int) -> DataFrame:
    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = []
            for row in split(list(zip(*(c.to_pylist() for c in batch.columns), strict=True)), parts):
                held.append(row)
                if len(held) == 20_000:
                    yield _pieces(held)
                    held = []
            if held:
                yield _pieces(held)

    return pieces.select("key", "doc", "s", "n", "bytes").mapInArrow(lean(stream), PIECES)


def _larger(pieces: DataFrame) -> DataFrame:
    return pieces.groupBy("key").agg(F.sum(F.col("n") + LENGTH).alias("b")).where(F.col("b") > HOT).select("key")


def _partial(edges: DataFrame, texts: DataFrame, shards: int) -> DataFrame:
    """The repeats among the windows of different blocks with one anchor: doc, first and last start."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, text, own in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                raw = (text or "").encode()
                out += [(x["h"].to_bytes(8, "little", signed=True), doc, x["s"], x["n"], raw[x["s"] : x["s"] + x["n"] + LENGTH - 1]) for x in own]
            if out:
                yield _pieces(out)

    def one(t):
        t = t.sort_by([("doc", "ascending"), ("s", "ascending")]).combine_chunks()
        doc, s, raw = t.column("doc").to_numpy(), t.column("s").to_numpy(), t.column("bytes").to_pylist()
        sizes = np.array([len(x) for x in raw])
        ends = np.cumsum(sizes + 1)
        text = np.zeros(int(ends[-1]) + 1, np.uint16)
        # 0 ends the whole text, 1 each block, and bytes follow.
        joined = np.frombuffer(b"\0".join(raw) + b"\0", np.uint8)
        text[:-1] = joined.astype(np.uint16) + 2
        text[ends - 1] = 1
        pos, lcp = suffix_array(text, 258, LENGTH)
        group = np.cumsum(lcp < LENGTH)
        block = np.searchsorted(ends, pos, "right")
        inside = block < len(raw)
        pos, group, block = pos[inside], group[inside], block[inside]
        whole = ends[block] - 1 - pos >= LENGTH
        pos, group, block = pos[whole], group[whole], block[whole]
        if not len(pos):
            return pa.table({"doc": pa.array([], pa.int64()), "s": pa.array([], pa.int32()), "e": pa.array([], pa.int32())})
        heads = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        least = np.repeat(np.minimum.reduceat(pos, heads), np.diff(np.append(heads, len(pos))))
        again = np.sort(pos[pos != least])
        if not len(again):
            return pa.table({"doc": pa.array([], pa.int64()), "s": pa.array([], pa.int32()), "e": pa.array([], pa.int32())})
        # Starts that follow each other are one run.
        a = again[np.append(True, np.diff(again) != 1)]
        b = again[np.append(np.diff(again) != 1, True)]
        k = np.searchsorted(ends, a, "right")
        base = ends[k] - sizes[k] - 1
        return pa.table({"doc": pa.array(doc[k]), "s": pa.array((s[k] + a - base).astype(np.int32)), "e": pa.array((s[k] + b - base).astype(np.int32))})

    def pieces(some: DataFrame) -> DataFrame:
        by_doc = some.groupBy("doc").agg(F.collect_list(F.struct("h", "s", "n")).alias("own"))
        return texts.join(by_doc, "doc").select("doc", "text", "own").mapInArrow(lean(cut), PIECES)

    hot = edges.groupBy("h").agg(F.sum(F.col("n") + LENGTH).alias("b")).where(F.col("b") > HOT).select("h")
    if hot.isEmpty():
        small, singles = pieces(edges), None
    else:
        hot = written(hot, "hot")
        small = pieces(edges.join(hot, "h", "left_anti"))
        rest = pieces(edges.join(hot, "h", "left_semi"))
        for parts in PARTS:
            rest = written(_split(rest, parts), "split")
            larger = written(_larger(rest), "hot")
            small = small.union(rest.join(larger, "key", "left_anti"))
            rest = rest.join(larger, "key", "left_semi")
            if larger.isEmpty():
                break
        # Where one window alone has that many bytes, its first occurrence is all there is to find.
        firsts = rest.groupBy("key").agg(F.min(F.struct("doc", "s")).alias("first"))
        singles = rest.join(firsts, "key").where(F.struct("doc", "s") != F.col("first")).select("doc", "s", F.col("s").alias("e"))
    found = small.groupBy(F.pmod(F.xxhash64("key"), F.lit(shards)).alias("shard")).applyInArrow(lean_group(one), SPANS)
    return found if singles is None else found.union(singles)


def repeats(texts: DataFrame) -> DataFrame:
    """texts (doc, text), doc unique, to (doc, spans): the runs of starts of repeated windows."""
    named = written(_named(_found(texts)), "named")
    edges = named.where("kind = 2")
    size = edges.agg(F.sum(F.col("n") + LENGTH).alias("b")).first()["b"] or 0
    partial = _partial(edges, texts, size // SHARD + 1)
    whole = named.where("kind = 1").select("doc", "s", (F.col("s") + F.col("n") - 1).alias("e"))
    return whole.union(partial).groupBy("doc").agg(F.collect_list(F.struct("s", "e")).alias("spans"))


def removed(n: int, spans: list[dict] | None, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """The maximal runs of removed bytes, as starts and ends."""
    if not spans:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    s = np.array([x["s"] for x in spans], np.int64)
    e = np.array([x["e"] for x in spans], np.int64) + length
    order = np.argsort(s, kind="stable")
    s, e = s[order], np.maximum.accumulate(e[order])
    new = np.append(True, s[1:] > e[:-1])
    return s[new], e[np.append(new[1:], True)]


OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])


def deduplicate(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    d = ordered(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "doc_id", "text")
    spans = repeats(d.select(F.col("_doc").alias("doc"), "text"))

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text, own in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                raw = (text or "").encode()
                a, b = removed(len(raw), own)
                keep, at = hashlib.sha256(), 0
                for x, y in zip(a.tolist(), b.tolist(), strict=True):
                    keep.update(raw[at:x])
                    at = y
                keep.update(raw[at:])
                rows.append((doc, len(raw), int((b - a).sum()), len(a), keep.hexdigest()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), OUT, strict=True)], schema=OUT)

    joined = d.join(spans, d["_doc"] == spans["doc"], "left").select(F.col("doc_id").cast("long"), "text", "spans")
    return joined.mapInArrow(lean(stream), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the repeats taken out of their texts; of a character that a run covers in part all
    bytes stay. All other columns and rows stay as they are."""
    names = docs.columns
    others = [F.col(f"`{c}`") for c in names if c != text_col] or [F.lit(0)]
    kept = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text"), F.struct(*others).alias("_all"))
    d = ordered(kept, "_id", "_text")
    spans = repeats(d.select(F.col("_doc").alias("doc"), F.col("_text").alias("text")))

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if text is None or not own:
                    out.append(text)
                    continue
                raw, parts, at = text.encode(), [], 0
                for x, y in zip(*(v.tolist() for v in removed(len(raw), own)), strict=True):
                    while x < len(raw) and raw[x] & 0xC0 == 0x80:
                        x += 1
                    while y < len(raw) and y > x and raw[y] & 0xC0 == 0x80:
                        y -= 1
                    if y > x:
                        parts.append(raw[at:x])
                        at = y
                out.append(b"".join([*parts, raw[at:]]).decode())
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), batch.column(2)], names=["_new", "_all"])

    joined = d.join(spans, d["_doc"] == spans["doc"], "left").select("_text", "spans", "_all")
    schema = "_new string, _all " + d.schema["_all"].dataType.simpleString()
    return joined.mapInArrow(lean(stream), schema).select(*[F.col("_new").alias(c) if c == text_col else F.col(f"_all.`{c}`").alias(c) for c in names])


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(table(spark, sf_dir, "documents"))
