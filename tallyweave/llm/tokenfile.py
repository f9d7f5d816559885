"""Operator 6, token ids in files of patched frame-of-reference blocks.

A file is a run of records, stored as rows of a Parquet table (which gives commit, retry and any
file system), one record for each run of about `RECORD` ids of consecutive documents:

    magic "PFR1", u32 ids, u32 documents, u32 blocks
    i64 doc_id, u8 known and u32 ids of each document, column by column
    u32 start of each block in the payload (the block index), u32 payload bytes
    payload: for each block of 1,024 ids: u32 minimum, u8 width, u16 exceptions,
             packed differences from the minimum, u16 positions and u32 values of the exceptions

The width is the smallest that holds 90 % of a block's differences; those beyond it are exceptions,
stored with a zero in their place. Any block can be read alone through the index, which `slices` does
to fetch runs of ids from anywhere in the corpus.

Documents are dealt by ranges of doc_id before they are tokenized (so the sampling reads ids only),
sorted, encoded and written; each part's records are in order and so are the parts.

Defined cases: null text is empty; rows with equal ids are kept, in the order of their texts; null
ids come first and are kept as such; an empty table gives an empty result.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from tallyweave.llm.common import lean, partitions, table, text_pieces, written
from tallyweave.llm.tokens import encoder

TOKENIZER, END, BLOCK, RECORD, PERCENTILE = "byte_bpe_50k.json", 0, 1024, 1 << 18, 90
HEAD = struct.Struct("<4sIII")


def pack_bits(v: np.ndarray, width: int) -> bytes:
    if not width:
        return b""
    return np.packbits((v[:, None] >> np.arange(width, dtype=np.uint32) & 1).astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack_bits(data: np.ndarray, n: int, width: int) -> np.ndarray:
    if not width:
        return np.zeros(n, np.uint32)
    if width == 16:
        return data.view("<u2")[:n].astype(np.uint32)
    bits = np.unpackbits(data, count=n * width, bitorder="little").reshape(n, width)
    return (bits.astype(np.uint32) << np.arange(width, dtype=np.uint32)).sum(1, dtype=np.uint32)


def write_block(ids: np.ndarray) -> bytes:
    low = int(ids.min())
    d = ids - np.uint32(low)
    bound = int(np.partition(d, i := max(0, -(-len(d) * PERCENTILE // 100) - 1))[i])
    width = bound.bit_length()
    out = np.flatnonzero(d >> np.uint32(width)) if width < 32 else np.empty(0, np.int64)
    rest = d[out].astype("<u4")
    d[out] = 0
    packed = d.astype("<u2").tobytes() if width == 16 else pack_bits(d, width)
    return struct.pack("<IBH", low, width, len(out)) + packed + out.astype("<u2").tobytes() + rest.tobytes()


def read_block(data: np.ndarray, n: int) -> np.ndarray:
    low, width, k = struct.unpack_from("<IBH", data)
    a = 7 + (n * width + 7) // 8
    d = unpack_bits(data[7:a].copy(), n, width)
    d[data[a : a + 2 * k].copy().view("<u2")] = data[a + 2 * k : a + 6 * k].copy().view("<u4")
    return d + np.uint32(low)


def write_record(docs: list[int | None], ids: list[bytes]) -> bytes:
    every = np.frombuffer(b"".join(ids), "<u4").astype(np.uint32)
    blocks = [write_block(every[a : a + BLOCK].copy()) for a in range(0, len(every), BLOCK)]
    starts = np.cumsum([0, *map(len, blocks)]).astype("<u4")
    known = np.array([x is not None for x in docs], np.uint8)
    return b"".join((HEAD.pack(b"PFR1", len(every), len(docs), len(blocks)), np.array([x or 0 for x in docs], "<i8").tobytes(), known.tobytes(), (np.array([len(x) for x in ids], "<i8") // 4).astype("<u4").tobytes(), starts.tobytes(), *blocks))


def read_record(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """The documents' ids, their numbers of token ids, and all token ids."""
    magic, n, docs, blocks = HEAD.unpack_from(data)
    if magic != b"PFR1":
        raise ValueError("not a record of token ids")
    raw, at = np.frombuffer(data, np.uint8), HEAD.size
    take = lambda size, kind: raw[at : at + size].copy().view(kind)
    doc = take(8 * docs, "<i8")
    at += 8 * docs
    known = take(docs, np.uint8)
    at += docs
    lengths = take(4 * docs, "<u4")
    at += 4 * docs
    starts = take(4 * (blocks + 1), "<u4")
    at += 4 * (blocks + 1)
    ids = [read_block(raw[at + a : at + b], min(BLOCK, n - i * BLOCK)) for i, (a, b) in enumerate(zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True))]
    return [x if k else None for x, k in zip(doc.tolist(), known.tolist(), strict=True)], lengths, np.concatenate(ids) if ids else np.empty(0, np.uint32)


def read_ids(data: bytes, start: int, end: int) -> np.ndarray:
    """Token ids start..end of a record (as far as it has them), of whose blocks only those that hold
    them are read."""
    _, n, docs, blocks = HEAD.unpack_from(data)
    end = min(end, n)
    if start >= end:
        return np.empty(0, np.uint32)
    index = HEAD.size + 13 * docs
    payload, raw = index + 4 * (blocks + 1), np.frombuffer(data, np.uint8)
    first, last = start // BLOCK, (end - 1) // BLOCK
    starts = raw[index + 4 * first : index + 4 * (last + 2)].copy().view("<u4").tolist()
    ids = [read_block(raw[payload + a : payload + b], min(BLOCK, n - i * BLOCK)) for i, (a, b) in enumerate(zip(starts[:-1], starts[1:], strict=True), first)]
    return np.concatenate(ids)[start - first * BLOCK : end - first * BLOCK]


FILE = "part int, seq int, before long, n_ids long, payload binary"


def write_tokens(docs: DataFrame, tokenizer: str = TOKENIZER, end: int | None = END, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The written files as a table: part, seq, ids of the part before the record, ids, record."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, before = TaskContext.get().partitionId(), 0, 0
        tail, enc = b"" if end is None else np.array([end], "<u4").tobytes(), encoder(tokenizer)
        held: tuple[list, list] = ([], [])
        size = 0

        def record() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([before]), pa.array([size]), pa.array([write_record(*held)], pa.binary())], names=["part", "seq", "before", "n_ids", "payload"])

        for batch in batches:
            docs = batch.column(0).to_pylist()
            for a, b, data, offsets in text_pieces(batch, "text"):
                every, bounds = enc.batch(data, offsets)
                for doc, i, j in zip(docs[a:b], bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    held[0].append(doc)
                    held[1].append(every[i:j].tobytes() + tail)
                    size += len(held[1][-1]) // 4
                    if size >= RECORD:
                        yield record()
                        held, seq, before, size = ([], []), seq + 1, before + size, 0
        if held[0]:
            yield record()

    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ordered = d.repartitionByRange(partitions(docs.sparkSession), F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    return written(ordered.mapInArrow(lean(stream), FILE), "tokens")


def placed(files: DataFrame) -> DataFrame:
    """The records with `start`, the number of ids before each."""
    # One row for each part, of which there are as many as shuffle partitions when the files were
    # written, a setting of the session: a bounded table.
    totals = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    first = totals.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_first"))
    return files.join(F.broadcast(first), "part").select((F.col("_first") + F.col("before")).alias("start"), "n_ids", "payload")


def slices(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (key, start, n: runs of token ids of the whole corpus, n bounded) to (key, ids); ids beyond
    the end are missing. Runs and records meet by ranges of places, and only the blocks of a run
    are read."""
    cells = lambda a, n: F.sequence(F.floor(a / RECORD), F.floor((a + F.greatest(n, F.lit(1)) - 1) / RECORD))
    records = placed(files).select(F.col("start").alias("_from"), "n_ids", "payload")
    records = records.withColumn("_cell", F.explode(cells(F.col("_from"), F.col("n_ids"))))
    asked = wanted.select("key", "start", "n").withColumn("_cell", F.explode(cells(F.col("start"), F.col("n"))))
    # A run and a record may meet in several cells; the first one counts.
    first = F.floor(F.greatest(F.col("start"), F.col("_from")) / RECORD)
    both = asked.join(records, "_cell").where((F.col("start") < F.col("_from") + F.col("n_ids")) & (F.col("_from") < F.col("start") + F.col("n")) & (F.col("_cell") == first)).select("key", "start", "n", "_from", "payload")

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for start, n, before, payload in zip(*(batch.column(i).to_pylist() for i in range(1, 4)), batch.column(4), strict=True):
                out.append(read_ids(payload.as_py(), max(0, start - before), max(0, start + n - before)).astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3), pa.array(out, pa.list_(pa.int64()))], names=["key", "_from", "ids"])

    found = both.mapInArrow(lean(stream), f"key {wanted.schema['key'].dataType.simpleString()}, _from long, ids array<long>")
    joined = found.groupBy("key").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_from", "ids"))), lambda x: x["ids"])).alias("ids"))
    return wanted.select("key").join(joined, "key", "left").select("key", F.coalesce("ids", F.array().cast("array<long>")).alias("ids"))


def read_tokens(files: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32."""
    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, payload in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                docs, lengths, ids = read_record(payload.as_py())
                ends = np.cumsum(lengths.astype(np.int64))
                raw = ids.astype("<u4").tobytes()
                crc = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(start + ends - lengths), pa.array(lengths.astype(np.int64)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return placed(files).select("start", "payload").mapInArrow(lean(stream), "doc_id long, start long, n_tokens long, ids_crc32 long")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_tokens(write_tokens(table(spark, sf_dir, "documents")))
