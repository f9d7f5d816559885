"""Operator 10, encoding and decoding with a SentencePiece model, by suffix-array matching.

A batch's texts are cut into segments that no piece of the vocabulary spans; the distinct segments
that the memo doesn't hold are concatenated (a zero between them) and their suffixes sorted by up to
the longest piece's length. Every piece is binary-searched in the suffix array, which gives the range
of its occurrences; the resulting edges (position, length, piece) are sorted by position. Then the
edges are relaxed: the vocabulary is a byte-pair one, so of all pairs of neighbouring symbols of a
segment that an edge joins, the one with the best score, the leftmost of equals, is joined, until
none is left; all segments advance at once. (A shortest path over the scores would be the rule for a
unigram model; for this one it gives other ids than the library.) Characters that are no piece
become their UTF-8 bytes' pieces.

Defined cases: null and empty texts have no ids; a literal U+2581 decodes to a space, as in the
library; repeated rows are rows of their own; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.llm.common import lean, table

MODEL, SPACE, MEMO, LONG, CHARS = "piece_bpe_32k.model", "▁", 800_000, 48, 400_000
NONE = np.int32(2**31 - 1)


class Pieces:
    """The vocabulary: pieces with their scores' ranks, byte pieces, and which neighbours of
    characters occur inside pieces."""

    def __init__(self, name: str = MODEL):
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
        ids = [i for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))]
        self.piece = {i: m.id_to_piece(i) for i in ids}
        self.bytes = {int(m.id_to_piece(i)[1:-1], 16): i for i in range(m.get_piece_size()) if m.is_byte(i)}
        self.most = max(map(len, self.piece.values()))
        by_score = sorted(ids, key=lambda i: (-m.get_score(i), i))
        self.rank = {i: r for r, i in enumerate(by_score)}
        order = sorted(ids, key=self.piece.get)
        self.sorted_ids = np.array(order, np.int32)
        self.sorted_pieces = np.array([self.piece[i] for i in order], f"U{self.most + 1}")
        self.sorted_ends = np.array([self.piece[i] + "\U0010ffff" for i in order], f"U{self.most + 1}")
        self.sorted_lengths = np.array([len(self.piece[i]) for i in order], np.int32)
        self.sorted_ranks = np.array([self.rank[i] for i in order], np.int32)
        self.inside = {p[k : k + 2] for p in self.piece.values() for k in range(len(p) - 1)}
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.piece.values()):
            raise ValueError("a piece holds a space after another character")
        self.text = [b""] * m.get_piece_size()
        for i in ids:
            self.text[i] = self.piece[i].replace(SPACE, " ").encode()
        for b, i in self.bytes.items():
            self.text[i] = bytes([b])
        self.memo: dict[str, bytes] = {}

    def decode(self, ids: np.ndarray) -> str:
        out = b"".join([self.text[i] for i in ids.tolist()])
        return (out[1:] if out[:1] == b" " else out).decode(errors="replace")

    def segments(self, text: str) -> list[str]:
        """Cuts that no piece spans: before each run of spaces; before a last full stop, comma or
        the like where the vocabulary allows it."""
        own = SPACE + text.replace(" ", SPACE)
        parts = own.split(SPACE)
        if "" in parts[1:]:
            found = re.findall(f"{SPACE}+[^{SPACE}]*", own)
        else:
            found = [SPACE + p for p in parts[1:]]
        out = []
        for p in found:
            if p[-1] in ".,":
                if p[-2:] not in self.inside:
                    out += (p[:-1], p[-1])
                    continue
            out.append(p)
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        cut = [self.segments(t) if t else [] for t in texts]
        if len(self.memo) > MEMO:
            self.memo.clear()
        memo = self.memo
        new = list({p for parts in cut for p in parts if p not in memo})
        at = 0
        while at < len(new):
            end, size = at, 0
            while end < len(new) and (size == 0 or size + len(new[end]) < CHARS):
                size += len(new[end]) + 1
                end += 1
            memo.update(zip(new[at:end], self.match(new[at:end]), strict=True))
            at = end
        return [b"".join([memo[p] for p in parts]) for parts in cut]

    def suffixes(self, codes: np.ndarray) -> np.ndarray:
        """Suffixes in the order of their first `most` code points (rounds that double the length)."""
        rank = np.unique(codes, return_inverse=True)[1].astype(np.int64)
        length = 1
        while length < self.most:
            nxt = np.zeros_like(rank)
            nxt[:-length] = rank[length:] + 1 if length < len(rank) else 0
            key = rank * (len(rank) + 2) + nxt
            order = np.argsort(key, kind="stable")
            new = np.empty_like(rank)
            new[order] = np.cumsum(np.concatenate(([0], np.diff(key[order]) != 0)))
            rank, length = new, 2 * length
            if rank.max() == len(rank) - 1:
                break
        return np.argsort(rank, kind="stable")

    def edges(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Position, length, id and rank of every occurrence of every piece, by position."""
        sa = self.suffixes(codes)
        padded = np.concatenate((codes, np.zeros(self.most + 1, np.uint32)))
        window = np.lib.stride_tricks.sliding_window_view(padded, self.most + 1)[sa].copy()
        window[np.cumsum(window == 0, 1) > 0] = 0  # a suffix ends with its segment
        words = window.view(f"U{self.most + 1}").ravel()
        # Cutting suffixes at their segments' ends keeps the order, as zero is the smallest code.
        low, high = np.searchsorted(words, self.sorted_pieces), np.searchsorted(words, self.sorted_ends)
        n = high - low
        which = np.repeat(np.arange(len(n)), n)
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
        pos = sa[at]
        order = np.argsort(pos, kind="stable")
        pos, which = pos[order], which[order]
        return pos, self.sorted_lengths[which], self.sorted_ids[which], self.sorted_ranks[which]

    def match(self, segments: list[str]) -> list[bytes]:
        text = "\0".join(s.replace("\0", "\ud800") for s in segments)
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").copy()
        pos, length, ids, ranks = self.edges(codes)
        width = self.most + 1
        rank = np.full(len(codes) * width, NONE, np.int32)
        rank[pos * width + length] = ranks
        which = np.zeros(len(codes) * width, np.int32)
        which[pos * width + length] = ids
        sizes = np.array([len(s) for s in segments])
        firsts = np.cumsum(sizes + 1) - sizes - 1
        out: list[bytes | None] = [None] * len(segments)
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for i in np.flatnonzero(sizes > LONG).tolist():
            s, n = self.alone(rank, width, int(firsts[i]), int(sizes[i]))
            done.append((np.full(len(s), i), s, n))
        short = np.flatnonzero(sizes <= LONG)
        seg = np.repeat(short, sizes[short])
        start = np.arange(len(seg)) - np.repeat(np.cumsum(sizes[short]) - sizes[short], sizes[short]) + firsts[seg]
        size = np.ones(len(seg), np.int64)
        while len(seg):
            both = np.zeros(len(seg), np.int64)
            both[:-1] = np.where(seg[1:] == seg[:-1], size[:-1] + size[1:], 0)
            cost = np.where((both > 1) & (both < width), rank[start * width + np.minimum(both, width - 1)], NONE)
            heads = np.flatnonzero(np.concatenate(([True], seg[1:] != seg[:-1])))
            least = np.minimum.reduceat(cost, heads)
            counts = np.diff(np.append(heads, len(seg)))
            live = np.repeat(least < NONE, counts)
            done.append((seg[~live], start[~live], size[~live]))
            seg, start, size, cost, both = (x[live] for x in (seg, start, size, cost, both))
            if not len(seg):
                break
            best = np.flatnonzero(cost == np.repeat(least, counts)[live])
            own = seg[best]
            best = best[np.concatenate(([True], own[1:] != own[:-1]))]
            size[best] = both[best]
            keep = np.ones(len(seg), bool)
            keep[best + 1] = False
            seg, start, size = seg[keep], start[keep], size[keep]
        seg, start, size = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(start, kind="stable")
        seg, start, size = seg[order], start[order], size[order]
        ids = which[start * width + size].astype("<u4")
        bounds = np.searchsorted(seg, np.arange(len(segments) + 1))
        odd = set(seg[ids == 0].tolist())
        for i in range(len(segments)):
            a, b = bounds[i], bounds[i + 1]
            if i in odd:
                found: list[int] = []
                for k in range(a, b):
                    found += [int(ids[k])] if ids[k] else [self.bytes[x] for x in segments[i][start[k] - firsts[i]].encode()]
                out[i] = np.array(found, "<u4").tobytes()
            else:
                out[i] = ids[a:b].tobytes()
        return out

    def alone(self, rank: np.ndarray, width: int, first: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        """A long segment: the same relaxation with a heap of the joins."""
        size, nxt, prev = [1] * n, list(range(1, n + 1)), list(range(-1, n - 1))
        cost = lambda i: int(rank[(first + i) * width + size[i] + size[nxt[i]]]) if nxt[i] < n and size[i] + size[nxt[i]] < width else int(NONE)
        heap = [(c, i, 1, 1) for i in range(n - 1) if (c := cost(i)) < NONE]
        heapq.heapify(heap)
        while heap:
            c, i, a, b = heapq.heappop(heap)
            j = nxt[i] if size[i] else n
            if size[i] != a or j >= n or size[j] != b:
                continue
            size[i], size[j], nxt[i] = a + b, 0, nxt[j]
            if nxt[i] < n:
                prev[nxt[i]] = i
            for k in (prev[i], i):
                if k >= 0 and nxt[k] < n and (c := cost(k)) < NONE:
                    heapq.heappush(heap, (c, k, size[k], size[nxt[k]]))
        live = [i for i in range(n) if size[i]]
        return np.array([first + i for i in live]), np.array([size[i] for i in live])


_made: dict[str, Pieces] = {}


def pieces(name: str = MODEL) -> Pieces:
    if name not in _made:
        _made[name] = Pieces(name)
    return _made[name]


def encode(docs: DataFrame, model: str = MODEL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids: the ids of each row's text as little-endian unsigned 32-bit integers."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                some = batch.slice(a, 1000)
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(pieces(model).encode(some.column(1).to_pylist()), pa.binary())], names=["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(lean(stream), "doc_id long, ids binary")


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id and text of rows that encode() made."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [pieces(model).decode(np.frombuffer(x, "<u4")) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(lean(stream), "doc_id long, text string")


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit
    integers), and round_trip: whether decoding gives the text back."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces(MODEL)
        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                some = batch.slice(a, 1000)
                texts = some.column(1).to_pylist()
                found = own.encode(texts)
                same = [own.decode(np.frombuffer(x, "<u4")) == (t or "") for x, t in zip(found, texts, strict=True)]
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array([len(x) // 4 for x in found]), pa.array([zlib.crc32(x) for x in found], pa.int64()), pa.array(same)], names=["doc_id", "n_tokens", "ids_crc32", "round_trip"])

    return d.mapInArrow(lean(stream), "doc_id long, n_tokens long, ids_crc32 long, round_trip boolean")
