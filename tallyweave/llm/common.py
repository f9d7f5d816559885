"""What the operators share: the shared work folder, written intermediate tables, text batches."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The bytes that separate words: space, tab, line feed, vertical tab, form feed, carriage return.
WHITE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def work_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir of the session. Where it is unset, a
    temporary folder is made and set on one machine, as in tests; on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="tallyweave-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Folders that written() made in this process, in order.
_folders: list[str] = []


#: Seconds between two sweeps, and when the last one ended.
SWEEP = 3.0
_swept = [0.0]


def swept(spark: SparkSession) -> None:
    """Lets shuffle files go that no query needs any more. They stay until the driver's JVM collects what refers to
    them; it does so by its own heap, which is the slower to fill the more each task has to do."""
    if time.monotonic() - _swept[0] >= SWEEP:
        gc.collect()
        for pause in (0.2, 0):  # the first one frees what refers to shuffles, the second one the shuffles
            spark.sparkContext._jvm.System.gc()
            time.sleep(pause)
        _swept[0] = time.monotonic()


def written(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again. It cuts the lineage, so a lost
    executor costs no more than the tasks it ran, and a table that is used twice is made once. What
    was shuffled for earlier tables goes before."""
    spark = df.sparkSession
    swept(spark)
    path = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _folders.append(path)
    df.write.parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    made._folder = path
    return made


def _deleted(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def forget(*tables: DataFrame) -> None:
    """Deletes tables that written() has made and nothing reads any more, the caller's result neither."""
    for table in tables:
        _folders.remove(table._folder)
        _deleted(table.sparkSession, table._folder)


def discard(spark: SparkSession, keep: int) -> None:
    """Deletes what written() has made since it had made `keep` tables, but for the last one. For a caller
    that has written its result, which then needs none of the others."""
    while len(_folders) > keep + 1:
        _deleted(spark, _folders.pop(keep))


def made() -> int:
    """How many tables written() has made and discard() hasn't deleted."""
    return len(_folders)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def unused(df: DataFrame, name: str) -> str:
    """The name, with underscores added until no column of df has it in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def ascii_lower(col):
    return F.translate(col, UPPER, LOWER)


def text_pieces(batch: pa.RecordBatch, column: str, most: int = (1 << 21) - 1) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of a batch with about `most` bytes of text each (one row at least): first row,
    row after the last, the UTF-8 bytes of all of them, and where each starts and the last ends.
    Null texts are empty."""
    texts = pc.fill_null(batch.column(batch.schema.get_field_index(column)), "").cast(pa.large_string())
    n = len(texts)
    if not n:
        return
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        end = min(end, n)
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        if offsets[end] - offsets[at] > 2 * most:  # a very long text
            released()
        at = end


def bit_set(cells: DataFrame, bits: int, block: int = 1 << 13) -> np.ndarray:
    """A set of `bits` bits, packed, in which the cells (long, 0 to bits - 1) are one. Tasks pack their own
    cells by blocks, which are merged by block; what comes to the driver is `bits` bits at most."""
    block = min(block, bits)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.empty(0, np.int64)
        for batch in batches:
            found = np.union1d(found, batch.column(0).to_numpy())
        if not len(found):
            return
        heads = np.flatnonzero(np.diff(found // block, prepend=-1))
        rows = [(int(found[a]) // block, (found[a:b] % block).astype("<u2").tobytes()) for a, b in zip(heads.tolist(), [*heads[1:].tolist(), len(found)], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.binary()), strict=True)], names=["block", "cells"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, seen = None, np.zeros(block, bool)
        closed = lambda: pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([np.packbits(seen).tobytes()])], names=["block", "bits"])
        for batch in batches:
            for k, own in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if k != at:
                    if at is not None:
                        yield closed()
                    at, seen = k, np.zeros(block, bool)
                seen[np.frombuffer(own, "<u2")] = True
        if at is not None:
            yield closed()

    n = max(2, min(bits // block, partitions(cells.sparkSession)))
    merged = cells.mapInArrow(lean(pack), "block int, cells binary").repartition(n, "block").sortWithinPartitions("block").mapInArrow(merge, "block int, bits binary")
    out = np.zeros(bits // 8, np.uint8)
    for k, part in merged.collect():
        out[k * block // 8 : (k + 1) * block // 8] = np.frombuffer(part, np.uint8)
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (in place where possible)."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


class Powers:
    """Powers of one odd base and of its inverse modulo 2**64, as far as the longest batch needs them;
    one table for all hashes of a worker, and no more than ``KEPT`` powers of it outlive a batch."""

    KEPT, base = 1 << 21, 0x5851F42D4C957F2D
    up = down = np.ones(1, np.uint64)

    @classmethod
    def grow(cls, n: int) -> None:
        if len(cls.up) < n:
            n = 1 << (n - 1).bit_length()
            steps = np.full(n, cls.base, np.uint64)
            steps[0] = 1
            cls.up = np.multiply.accumulate(steps)
            steps[1:] = pow(cls.base, -1, 1 << 64)
            cls.down = np.multiply.accumulate(steps, out=steps)

    @classmethod
    def shrink(cls) -> None:
        if len(cls.up) > cls.KEPT:
            cls.up, cls.down = cls.up[: cls.KEPT].copy(), cls.down[: cls.KEPT].copy()


class Polynomial:
    """64-bit hashes of any substrings of a byte array, all computed at once: prefix sums of byte
    values times powers of an odd base, modulo 2**64; powers of the inverse align each substring. For
    substrings of up to some 200 bytes: longer ones with the pattern of the Thue-Morse word have equal
    hashes whatever the base and the values."""

    def __init__(self, seed: int):
        self.values = np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def prefix(self, data: np.ndarray) -> np.ndarray:
        Powers.grow(len(data) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        terms = self.values[data]
        terms *= Powers.up[: len(data)]
        np.cumsum(terms, out=sums[1:])
        return sums

    def of(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        out = sums[end]
        out -= sums[start]
        out *= Powers.down[start]
        return out


def released() -> None:
    """Gives memory that a task no longer needs back to the system: workers outlive their tasks."""
    Powers.shrink()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def lean(stream: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The stream, with its memory released when it ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from stream(batches)
        finally:
            released()

    return run


def lean_group(f: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """The function of a group, with its memory released after each group."""

    def run(table: pa.Table) -> pa.Table:
        try:
            return f(table)
        finally:
            released()

    return run
