"""Operator 5, language-model scores by context-tree weighting over bytes.

Each byte is eight binary decisions along a tree of 255 nodes; each node has a context tree over the
preceding bytes, from depth 0 to ``DEPTH``. In each context the Krichevsky-Trofimov estimator gives
the probability of the decisions seen there, and the weighted probability is half of that plus half
of the product over the contexts one byte longer. A text's score is the sum of the log10 of the
predictive probabilities, each a mixture over all depths of its context by those weights; the model
learns from the training rows alone. Texts have A-Z lower-cased; an end symbol follows each.

How it is distributed. Rows are dealt to parts of about ``PART`` bytes of text. A part sends its
distinct grams (context and next byte) with their training counts, and its distinct words, as one
block for each bucket; grams are bucketed by the last three bytes of context, so each tree below
depth 3 lies in one bucket. The buckets add up the counts, weigh their trees and pass the sums for
depth 2, of which there are at most 256**2 times 255, to the driver, which weighs the top of the
tree; then the buckets answer each block with its grams' log probabilities and its words' counts,
and each part sums them by row. What is broadcast doesn't grow with the corpus. A bucket holds the
distinct grams of its contexts once for each part, so the bucket of a common context grows with the
number of parts. Training texts are scored by counts that hold themselves.

Defined cases: a null text is empty (one end token); a null id counts as the empty text for the
split; repeated rows are rows of their own; with no training rows every decision has probability
1/2 and the base score is that of a lone unseen token.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.llm.common import discard, made, mix, table, text_pieces, written

DEPTH, TOP, PART, ROWS, MODULUS, HELD = 5, 3, 8 << 20, 1 << 16, 7, 2
PAD = 255  # no byte of UTF-8
LOG_HALF = math.log(0.5)
_K = np.arange(1 << 14)
_HALVES = np.concatenate(([0.5 * math.log(math.pi)], 0.5 * math.log(math.pi) + np.cumsum(np.log(_K + 0.5))))
_FACTS = np.concatenate(([0.0], np.cumsum(np.log(_K + 1.0))))


def _stirling(x: np.ndarray) -> np.ndarray:
    return (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3)


def log_gamma_half(n: np.ndarray) -> np.ndarray:
    """log Gamma(n + 1/2) of whole numbers."""
    return np.where(n < len(_HALVES), _HALVES[np.minimum(n, len(_HALVES) - 1)], _stirling(np.maximum(n, 1000) + 0.5))


def log_factorial(n: np.ndarray) -> np.ndarray:
    return np.where(n < len(_FACTS), _FACTS[np.minimum(n, len(_FACTS) - 1)], _stirling(np.maximum(n, 1000) + 1.0))


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """log of the Krichevsky-Trofimov probability of any sequence with these counts."""
    return log_gamma_half(zeros) + log_gamma_half(ones) - math.log(math.pi) - log_factorial(zeros + ones)


def weigh(kt: np.ndarray, below: np.ndarray) -> np.ndarray:
    return LOG_HALF + np.logaddexp(kt, below)


def held_out(ids: list) -> np.ndarray:
    return np.array([zlib.crc32(b"" if x is None else str(x).encode()) % MODULUS == HELD for x in ids], bool)


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The gram of every byte and every end, as context from its last byte back and then the byte,
    and the row of each."""
    n, sizes = len(offsets) - 1, np.diff(offsets)
    row = np.repeat(np.arange(n), sizes)
    spot = np.arange(len(data)) + DEPTH * (row + 1)
    x = np.full(len(data) + DEPTH * (n + 1), PAD, np.uint8)
    x[spot] = np.where((data >= 65) & (data <= 90), data + 32, data)
    ends = offsets[1:] + DEPTH * np.arange(1, n + 1)
    at = np.concatenate((spot, ends))
    two = np.zeros(len(x) + 1, np.uint16)  # two[i]: the bytes before i and before that
    two[1:] = x
    two[1:] <<= np.uint16(8)
    two[2:] |= x[:-1]
    code = two[:-1].astype(np.uint64)
    code <<= np.uint64(32)
    low = np.zeros(len(x), np.uint32)
    low[2:] = two[:-3]
    low <<= np.uint32(16)
    last = x.astype(np.uint16)
    last[DEPTH:] |= x[:-DEPTH].astype(np.uint16) << np.uint16(8)
    low |= last
    code |= low
    return code[at], np.concatenate((row, np.arange(n)))


class Part:
    """The rows of a part: their grams sorted with the row, the distinct grams, and their words."""

    def __init__(self, t: pa.Table):
        t = t.combine_chunks()
        self.ids = t.column("doc_id").to_pylist()
        self.held = held_out(self.ids)
        # Grams have 48 bits; they are sorted with 16 bits of the row, for about 2 MB of text at once.
        self.words, self.runs, us = [], [], []
        for b in t.to_batches():
            base = len(self.words)
            for first, end, data, offsets in text_pieces(b, "text"):
                for a in range(0, end - first, ROWS):
                    some = offsets[a : a + ROWS + 1]
                    code, row = grams(data[some[0] : some[-1]], some - some[0])
                    code <<= np.uint64(16)
                    code |= row.astype(np.uint64)
                    code.sort()
                    c = code >> np.uint64(16)
                    heads = np.flatnonzero(np.concatenate(([True], c[1:] != c[:-1])))
                    us.append(c[heads])
                    self.runs.append((base + first + a, len(some) - 1, (code & np.uint64(0xFFFF)).astype(np.uint16), heads.astype(np.int32), us[-1]))
                raw = data.tobytes().lower()
                self.words += [raw[i:j].split() for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        self.u = np.unique(np.concatenate(us)) if us else np.empty(0, np.uint64)

    def train_counts(self) -> np.ndarray:
        out = np.zeros(len(self.u), np.int64)
        for a, n, row, heads, codes in self.runs:
            train = ~self.held[a : a + n][row]
            out[np.searchsorted(self.u, codes)] += np.add.reduceat(train, heads, dtype=np.int64)
        return out

    def sums(self, value: np.ndarray) -> np.ndarray:
        """The sum of value (of each distinct gram) by row."""
        out = np.zeros(len(self.ids))
        for a, n, row, heads, codes in self.runs:
            own = np.repeat(value[np.searchsorted(self.u, codes)], np.diff(np.append(heads, len(row))))
            out[a : a + n] += np.bincount(row, own, n)
        return out


def bucket_of(codes: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(codes >> np.uint64(8 * (DEPTH + 1 - TOP))) % np.uint64(buckets)).astype(np.int64)


def word_bucket(word: bytes, buckets: int) -> int:
    return zlib.crc32(word) % buckets


def by_bucket(words, buckets: int) -> dict[int, list[bytes]]:
    """The words of each bucket that has any, in order."""
    lists: dict[int, list[bytes]] = {}
    for w in sorted(words):
        lists.setdefault(word_bucket(w, buckets), []).append(w)
    return lists


def squeeze(*arrays: np.ndarray) -> bytes:
    """The arrays (64-bit, of one length), the first as differences, compressed."""
    n = len(arrays[0])
    raw = b"".join([np.diff(arrays[0], prepend=arrays[0].dtype.type(0)).tobytes(), *(a.tobytes() for a in arrays[1:])])
    return n.to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unsqueeze(data: bytes, *kinds) -> list[np.ndarray]:
    n = int.from_bytes(data[:8], "little")
    raw = pa.decompress(data[8:], 8 * n * len(kinds), codec="zstd", asbytes=True)
    first, *rest = (np.frombuffer(raw[8 * n * i : 8 * n * (i + 1)], k) for i, k in enumerate(kinds))
    return [np.cumsum(first, dtype=first.dtype), *rest]


BLOCK = "bucket int, part int, grams binary, words binary, counts binary"


def ask(buckets: int):
    """Of a part: its blocks for the buckets."""

    def one(key, t):
        part = Part(t)
        counts, b = part.train_counts(), bucket_of(part.u, buckets)
        order = np.argsort(b, kind="stable")
        names, at = np.unique(b[order], return_index=True)
        spans = dict(zip(names.tolist(), zip(at.tolist(), [*at[1:].tolist(), len(b)], strict=True), strict=True))
        seen: Counter = Counter()
        for held, words in zip(part.held, part.words, strict=True):
            if not held:
                seen.update(words)
        for held, words in zip(part.held, part.words, strict=True):
            if held:
                for w in words:
                    if w not in seen:
                        seen[w] = 0
        lists = by_bucket(seen, buckets)
        rows = []
        for k in sorted(spans.keys() | lists.keys()):  # a bucket that has nothing of this part gets no block
            own, words = order[slice(*spans.get(k, (0, 0)))], lists.get(k, [])
            rows.append((k, key[0].as_py(), squeeze(part.u[own], counts[own]), pa.compress(b" ".join(words), codec="zstd", asbytes=True) if words else b"", np.array([len(b" ".join(words)), *(seen[w] for w in words)], np.int64).tobytes()))
        return pa.Table.from_pydict(dict(zip(("bucket", "part", "grams", "words", "counts"), zip(*rows, strict=True), strict=True)), pa.schema([("bucket", pa.int32()), ("part", pa.int32()), ("grams", pa.binary()), ("words", pa.binary()), ("counts", pa.binary())]))

    return one


class Bucket:
    """All blocks of a bucket: grams with their counts over the corpus, and the words'."""

    def __init__(self, t: pa.Table):
        self.parts = t.column("part").to_pylist()
        self.blocks = [unsqueeze(x, np.uint64, np.int64) for x in t.column("grams").to_pylist()]
        every = np.concatenate([c for c, _ in self.blocks])
        self.codes, which = np.unique(every, return_inverse=True)
        self.counts = np.bincount(which, np.concatenate([n for _, n in self.blocks]), len(self.codes)).astype(np.int64)
        self.words: list[list[bytes]] = []
        self.total: Counter = Counter()
        for w, c in zip(t.column("words").to_pylist(), t.column("counts").to_pylist(), strict=True):
            own = np.frombuffer(c, np.int64)
            words = pa.decompress(w, int(own[0]), codec="zstd", asbytes=True).split(b" ") if w else []
            self.words.append(words)
            for x, n in zip(words, own[1:].tolist(), strict=True):
                self.total[x] += n

    def trees(self) -> tuple[list, np.ndarray, np.ndarray]:
        """For depths TOP..DEPTH: node of each gram and bit, counts, log KT, log weighted;
        and the bits and the nodes of each gram."""
        byte = (self.codes & np.uint64(255)).astype(np.int64)
        bits = byte[:, None] >> np.arange(7, -1, -1) & 1
        node = (byte[:, None] | 256) >> np.arange(8, 0, -1)
        levels, lower = [], None
        for d in range(DEPTH, TOP - 1, -1):
            ctx = self.codes >> np.uint64(8 * (DEPTH + 1 - d))
            group = np.cumsum(np.concatenate(([0], ctx[1:] != ctx[:-1]))) if len(ctx) else ctx.astype(np.int64)
            key, which = np.unique((group[:, None] << 8 | node).ravel(), return_inverse=True)
            n = np.repeat(self.counts, 8)
            ones = np.bincount(which, n * bits.ravel(), len(key)).astype(np.int64)
            zeros = np.bincount(which, n, len(key)).astype(np.int64) - ones
            kt = log_kt(zeros, ones)
            if lower is None:
                weighted = kt
            else:
                parent = np.zeros(len(lower[2]), np.int64)
                parent[lower[0]] = which
                weighted = weigh(kt, np.bincount(parent, lower[2], len(key)))
            levels.append((which, (zeros, ones), kt, weighted))
            lower = (which, None, weighted)
        return levels, bits, node


SUMS = "kind int, key long, zeros long, ones long, below double"


def add_up(t: pa.Table) -> pa.Table:
    """Of a bucket: what the top of the tree needs, by context of depth 2 and node; and the words."""
    b = Bucket(t)
    levels, _, node = b.trees()
    which, (zeros, ones), _, weighted = levels[-1]
    key3 = np.zeros(len(weighted), np.int64)
    key3[which] = ((b.codes >> np.uint64(8 * (DEPTH + 1 - TOP + 1))).astype(np.int64)[:, None] << 8 | node).ravel()
    key, at = np.unique(key3, return_inverse=True)
    add = lambda v: np.bincount(at, v, len(key))
    seen = [n for n in b.total.values() if n]
    n = len(key)
    return pa.table({"kind": pa.array([0] * n + [1], pa.int32()), "key": pa.array([*key.tolist(), 0], pa.int64()), "zeros": pa.array([*add(zeros).astype(np.int64).tolist(), sum(seen)], pa.int64()), "ones": pa.array([*add(ones).astype(np.int64).tolist(), len(seen)], pa.int64()), "below": pa.array([*add(weighted).tolist(), 0.0], pa.float64())})


class Top:
    """The tree above depth TOP: for each context of two bytes and node, a and c, with which the
    predictive probability of a one is a + c * (that of the deeper tree)."""

    def __init__(self, key: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray):
        order = np.argsort(key)
        self.key, zeros, ones, below = key[order], zeros[order], ones[order], below[order]
        k, parts = self.key, []
        for shift in (0, 8, 16):  # depths 2, 1 and 0; k holds both bytes of context throughout
            at, which = np.unique((k >> 8 >> shift) << 8 | k & 255, return_inverse=True)
            z, o, s = (np.bincount(which, x, len(at)) for x in (zeros, ones, below))
            z, o = z.astype(np.int64), o.astype(np.int64)
            kt = log_kt(z, o)
            weighted = weigh(kt, s)
            parts.append((at, np.exp(LOG_HALF + kt - weighted), (o + 0.5) / (z + o + 1)))
            k, zeros, ones, below = (at >> 8) << (8 + shift) | at & 255, z, o, weighted
        self.parts = parts

    def mix(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """a and c for keys of two context bytes and a node; nodes not seen count as unvisited."""
        a, c = np.zeros(len(key)), np.ones(len(key))
        for (at, beta, p), shift in zip(self.parts[::-1], (16, 8, 0), strict=True):
            k = (key >> 8 >> shift) << 8 | key & 255
            i = np.minimum(np.searchsorted(at, k), max(len(at) - 1, 0))
            there = at[i] == k if len(at) else np.zeros(len(k), bool)
            b = np.where(there, beta[i], 0.0) if len(at) else np.zeros(len(k))
            a += np.where(there, c * b * (p[i] if len(at) else 0), 0.5 * c)
            c = np.where(there, c * (1 - b), 0.0)
        return a, c


def answer(top) -> object:
    """Of a bucket: for each block, the log10 probability of its grams and the counts of its words."""

    def one(t: pa.Table) -> pa.Table:
        b = Bucket(t)
        levels, bits, node = b.trees()
        q = None
        for which, (zeros, ones), kt, weighted in levels:
            p = (ones + 0.5) / (zeros + ones + 1)
            beta = np.exp(LOG_HALF + kt - weighted)
            q = p[which] if q is None else beta[which] * p[which] + (1 - beta[which]) * q
        key = ((b.codes >> np.uint64(8 * (DEPTH + 1 - TOP + 1))).astype(np.int64)[:, None] << 8 | node).ravel()
        u, back = np.unique(key, return_inverse=True)
        a, c = top.value.mix(u)
        one_is = a[back] + c[back] * q
        logs = np.log10(np.where(bits.ravel() == 1, one_is, 1 - one_is)).reshape(-1, 8).sum(1).astype(np.float32)
        rows = [(part, k, logs[np.searchsorted(b.codes, codes)].tobytes(), np.array([b.total[w] for w in words], np.int64).tobytes()) for part, k, (codes, _), words in zip(b.parts, t.column("bucket").to_pylist(), b.blocks, b.words, strict=True)]
        return pa.Table.from_pydict(dict(zip(("part", "bucket", "logs", "counts"), zip(*rows, strict=True), strict=True)), pa.schema([("part", pa.int32()), ("bucket", pa.int32()), ("logs", pa.binary()), ("counts", pa.binary())]))

    return one


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def finish(buckets: int, n: int, v: int, ends: int):
    """Of a part and its answers: the scores of its rows."""

    def one(t, answers):
        part = Part(t)
        got = {k: (x, c) for k, x, c in zip(answers.column("bucket").to_pylist(), answers.column("logs").to_pylist(), answers.column("counts").to_pylist(), strict=True)}
        value, b = np.zeros(len(part.u)), bucket_of(part.u, buckets)
        order = np.argsort(b, kind="stable")
        value[order] = np.concatenate([np.frombuffer(got[k][0], np.float32) for k in sorted(got)])
        score = part.sums(value)
        count = {w: c for k, words in by_bucket(set().union(*part.words), buckets).items() for w, c in zip(words, np.frombuffer(got[k][1], np.int64).tolist(), strict=True)}
        total = math.log10(n + v + 1)
        log = {w: math.log10(c + 1) - total for w, c in count.items()}
        end = math.log10(ends + 1) - total
        rows = len(part.ids)
        base = [sum(map(log.__getitem__, words)) + end for words in part.words]
        new = {w for w, c in count.items() if not c}  # no word of a training row is one
        known = [len(words) - (sum(map(new.__contains__, words)) if held else 0) + (ends > 0) for held, words in zip(part.held, part.words, strict=True)]
        return pa.table({"doc_id": pa.array(part.ids, pa.int64()), "held_out": pa.array(part.held), "n_tokens": pa.array([len(w) + 1 for w in part.words], pa.int64()), "n_known": pa.array(known, pa.int64()), "train_tokens": pa.array([n] * rows, pa.int64()), "base_score": pa.array(base, pa.float64()), "score": pa.array(score)})

    return one


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score
    (log10 probability; the code length in bits per byte is -score * log2(10) over the bytes)."""
    spark = docs.sparkSession
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size = d.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
    parts = size // PART + 1
    buckets = int(max(parts, 16))
    d = d.withColumn("part", F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts)).cast("int"))
    before = made()
    blocks = written(d.groupBy("part").applyInArrow(ask(buckets), BLOCK), "lm-blocks")
    sums = blocks.groupBy("bucket").applyInArrow(add_up, SUMS).groupBy("kind", "key").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("below").alias("below")).toArrow()
    kind = sums.column("kind").to_numpy()
    col = lambda c: sums.column(c).to_numpy()
    words = kind == 1
    ends = d.select("doc_id").where(F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(MODULUS)) != HELD).count()
    n, v = int(col("zeros")[words].sum()) + ends, int(col("ones")[words].sum()) + (ends > 0)
    top = spark.sparkContext.broadcast(Top(*(col(c)[~words] for c in ("key", "zeros", "ones", "below"))))
    answers = written(blocks.groupBy("bucket").applyInArrow(answer(top), "part int, bucket int, logs binary, counts binary"), "lm-answers")
    discard(spark, before)  # the answers are written, so nothing reads the blocks any more
    return d.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(finish(buckets, n, v, ends), SCORES)


def op5_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))
