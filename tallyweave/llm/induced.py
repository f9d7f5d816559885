"""Suffix and common-prefix arrays of a shard by induced sorting with disk-backed bucket queues.

The queue of a leading symbol holds suffix tuples (position, common prefix with the one before) in
the order in which they are induced, which is their sorted order; so the queues together are the
priority queue of induced sorting, and a whole bucket is taken and induced from at once. Queues past
``MEMORY`` bytes spill to an anonymous temporary file of the task, which vanishes with it, and which
no other task reads. Types, left-most S positions and names follow the usual scheme; the names of
left-most S substrings are ordered by doubling, as far as ``depth`` needs. Common prefixes are
carried along: that of two induced suffixes is one more than the least between their sources.
Everything is right up to ``depth`` symbols and not looked at beyond it.
"""

from __future__ import annotations

import tempfile

import numpy as np

MEMORY, CAP, FEED = 256 << 20, 120, 1 << 22


class Queue:
    """First in, first out, of (position, common prefix) arrays."""

    held = 0

    def __init__(self, disk: list):
        self.disk, self.chunks = disk, []

    def push(self, pos: np.ndarray, lcp: np.ndarray) -> None:
        if Queue.held + pos.nbytes > MEMORY:
            if not self.disk:
                self.disk.append(tempfile.TemporaryFile())
            f = self.disk[0]
            f.seek(0, 2)
            at = f.tell()
            f.write(np.ascontiguousarray(pos).tobytes() + np.ascontiguousarray(lcp).tobytes())
            self.chunks.append((at, len(pos), pos.dtype, lcp.dtype))
        else:
            Queue.held += pos.nbytes
            self.chunks.append((pos, lcp))

    def pop(self) -> list[tuple[np.ndarray, np.ndarray]]:
        out = []
        for c in self.chunks:
            if len(c) == 4:
                at, n, a, b = c
                self.disk[0].seek(at)
                out.append((np.frombuffer(self.disk[0].read(n * a.itemsize), a), np.frombuffer(self.disk[0].read(n * b.itemsize), b)))
            else:
                Queue.held -= c[0].nbytes
                out.append(c)
        self.chunks = []
        return out


def types(t: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next one (S type)."""
    n = len(t)
    up = np.zeros(n, np.int8)
    up[:-1] = np.sign(t[1:].astype(np.int32) - t[:-1].astype(np.int32))
    up[-1] = 1
    last = np.where(up != 0, np.arange(n), n)
    nxt = np.minimum.accumulate(last[::-1])[::-1]
    return up[nxt] > 0


def runs(t: np.ndarray) -> np.ndarray:
    """Length of the run of equal symbols that starts at each position, up to CAP."""
    n = len(t)
    end = np.where(np.append(t[1:] != t[:-1], True), np.arange(1, n + 1), n)
    return np.minimum(np.minimum.accumulate(end[::-1])[::-1] - np.arange(n), CAP).astype(np.uint8)


class Sparse:
    """Range minima over a small-integer array."""

    def __init__(self, v: np.ndarray):
        self.levels = [v]
        w = 1
        while 2 * w <= len(v):
            self.levels.append(np.minimum(self.levels[-1][:-w], self.levels[-1][w:]))
            w *= 2

    def least(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Minimum of v[a..b], both included."""
        k = np.frexp(b - a + 1)[1] - 1
        out = np.empty(len(a), self.levels[0].dtype)
        for level in np.unique(k).tolist():
            m = k == level
            out[m] = np.minimum(self.levels[level][a[m]], self.levels[level][b[m] - (1 << level) + 1])
        return out


class Sweep:
    """One pass of induction over the buckets, up (L types) or down (S types)."""

    def __init__(self, t: np.ndarray, is_s: np.ndarray, run: np.ndarray, symbols: int, want_s: bool, disk: list):
        self.t, self.is_s, self.run, self.want_s = t, is_s, run, want_s
        self.queues = [Queue(disk) for _ in range(symbols)]
        self.since = np.full(symbols, -1, np.int16)  # least common prefix since the bucket's last source; -1: none yet

    def feed(self, pos: np.ndarray, lcp: np.ndarray) -> None:
        """Induces from sorted suffixes; lcp[k] is that of pos[k] with the one fed before it."""
        if not len(pos):
            return
        prev = pos - 1
        ok = np.flatnonzero((prev >= 0) & (self.is_s[prev] == self.want_s))
        mins = Sparse(lcp)
        n, overall = len(pos), int(lcp.min())
        old = self.since.copy()
        self.since = np.where(old >= 0, np.minimum(old, overall), old).astype(np.int16)
        if not len(ok):
            return
        d = self.t[prev[ok]]
        order = np.argsort(d, kind="stable")
        ok, d = ok[order], d[order]
        new = np.ones(len(ok), bool)
        new[1:] = d[1:] != d[:-1]
        got = np.zeros(len(ok), np.uint8)
        inner = np.flatnonzero(~new)
        if len(inner):
            got[inner] = np.minimum(mins.least(ok[inner - 1] + 1, ok[inner]).astype(np.int16) + 1, CAP)
        heads = np.flatnonzero(new)
        before = old[d[heads]]
        to_head = mins.least(np.zeros(len(heads), np.int64), ok[heads]).astype(np.int16)
        got[heads] = np.where(before >= 0, np.minimum(np.minimum(before, to_head) + 1, CAP), 0)
        tails = np.append(heads[1:], len(ok)) - 1
        rest = np.full(len(heads), CAP, np.int16)
        open_ = ok[tails] + 1 < n
        if open_.any():
            rest[open_] = mins.least(ok[tails][open_] + 1, np.full(int(open_.sum()), n - 1))
        self.since[d[heads]] = rest
        for a, b in zip(heads.tolist(), np.append(heads[1:], len(ok)).tolist(), strict=True):
            self.queues[int(d[a])].push(prev[ok[a:b]], got[a:b])

    def bucket(self, c: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Takes what is queued for symbol c, induces from it until no more comes; all of it in order."""
        out, seam = [], True
        while chunks := self.queues[c].pop():
            at = 0
            while at < len(chunks):  # chunks follow each other, so many small ones are fed as one
                end, size = at, 0
                while end < len(chunks) and (end == at or size + len(chunks[end][0]) <= FEED):
                    size += len(chunks[end][0])
                    end += 1
                pos = np.concatenate([p for p, _ in chunks[at:end]])
                lcp = np.concatenate([x for _, x in chunks[at:end]])
                if seam:
                    lcp[0], seam = 0, False
                self.feed(pos, lcp)
                out.append((pos, lcp))
                at = end
        return out


def induce(t: np.ndarray, is_s: np.ndarray, run: np.ndarray, symbols: int, lms: np.ndarray, lms_lcp: np.ndarray, visit) -> None:
    """From left-most S suffixes in order, all suffixes in order: visit(pos, lcp) from the largest
    bucket down, each call's suffixes in descending order, lcp with the next larger one visited."""
    disk: list = []
    up = Sweep(t, is_s, run, symbols, False, disk)
    bounds = np.searchsorted(t[lms], np.arange(symbols + 1))
    kept: list[list] = []
    for c in range(symbols):
        found = up.bucket(c)
        own, lcp = lms[bounds[c] : bounds[c + 1]], lms_lcp[bounds[c] : bounds[c + 1]].copy()
        if len(own):
            lcp[0] = min(int(run[found[-1][0][-1]]), int(run[own[0]])) if found else 0
            up.feed(own, lcp)
        q = Queue(disk)
        for x in found:
            q.push(*x)
        kept.append(q)
    down = Sweep(t, is_s, run, symbols, True, disk)
    for c in range(symbols - 1, -1, -1):
        found = down.bucket(c)
        last = None
        for pos, lcp in found:
            visit(pos, lcp)
            last = pos[-1]
        for pos, lcp in kept[c].pop()[::-1]:
            back = pos[::-1]
            shifted = np.zeros(len(pos), np.uint8)
            shifted[1:] = lcp[::-1][:-1]
            # With the suffix visited before: the smallest S of the bucket, or the next run of L.
            shifted[0] = carry if last is not None and not is_s[last] else min(int(run[last]), int(run[back[0]])) if last is not None else 0
            down.feed(back, shifted)
            visit(back, shifted)
            carry, last = int(lcp[0]), back[-1]


def compare(t: np.ndarray, a: np.ndarray, b: np.ndarray, cap: int = CAP) -> np.ndarray:
    """Common prefixes of suffixes a and b, up to cap."""
    padded = np.concatenate((t, np.zeros(cap + 8, t.dtype)))
    out, live = np.zeros(len(a), np.uint8), np.arange(len(a))
    for k in range(0, cap, 4):
        x = np.stack([padded[a[live] + k + j] == padded[b[live] + k + j] for j in range(4)], 1)
        inside = (np.maximum(a[live], b[live])[:, None] + k + np.arange(4)) < len(t)
        same = np.logical_and.accumulate(x & inside, 1).sum(1)
        out[live] += same.astype(np.uint8)
        live = live[same == 4]
        if not len(live):
            break
    return out


def suffix_array(t: np.ndarray, symbols: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of t in the order of their first `depth` symbols, and their common prefixes with
    the ones before (right up to `depth`). t ends with its only 0."""
    n = len(t)
    is_s, run = types(t), runs(t)
    lms = np.flatnonzero(is_s & ~np.concatenate(([True], is_s[:-1])))
    if not len(lms):
        lms = np.array([n - 1])
    # Order of the substrings between left-most S positions, from any order within a bucket.
    seeds = lms[np.argsort(t[lms], kind="stable")]
    found: list[np.ndarray] = []
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    induce(t, is_s, run, symbols, seeds, np.zeros(len(seeds), np.uint8), lambda pos, _: found.append(pos[is_lms[pos]]))
    order = np.concatenate(found)[::-1]
    if len(order) < len(lms):  # the end itself is induced from nothing
        order = np.concatenate((np.setdiff1d(lms, order), order))
    rank_of = np.searchsorted(lms, order)
    ends = np.append(lms[1:], n - 1) + 1
    length = ends[rank_of] - order
    same = np.zeros(len(order), bool)
    maybe = np.flatnonzero(length[1:] == length[:-1]) + 1
    if len(maybe):
        common = _common(t, order[maybe - 1], order[maybe], length[maybe])
        same[maybe] = common
    rank = np.empty(len(lms), np.int64)
    rank[rank_of] = np.cumsum(~same) - 1
    width = 1
    while width < depth and rank.max() < len(rank) - 1:
        nxt = np.zeros(len(rank), np.int64)
        nxt[:-width] = rank[width:] + 1 if width < len(rank) else 0
        key = rank * (len(rank) + 2) + nxt
        o = np.argsort(key, kind="stable")
        rank[o] = np.cumsum(np.concatenate(([False], key[o][1:] != key[o][:-1])))
        width *= 2
    order = lms[np.argsort(rank, kind="stable")]
    lcp = np.zeros(len(order), np.uint8)
    if len(order) > 1:
        lcp[1:] = compare(t, order[:-1], order[1:])
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    induce(t, is_s, run, symbols, order, lcp, lambda pos, x: parts.append((pos, x)))
    pos = np.concatenate([p for p, _ in parts])[::-1]
    down = np.concatenate([x for _, x in parts])[::-1]  # each with the next larger one
    missing = n - len(pos)
    if missing:  # the end, the smallest suffix
        pos, down = np.concatenate(([n - 1], pos)), np.concatenate((np.zeros(missing, np.uint8), down))
    out = np.zeros(len(pos), np.uint8)
    out[1:] = down[:-1]
    return pos, out


def _common(t: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether the substrings of these lengths from a and b are equal."""
    out, live, k = np.ones(len(a), bool), np.arange(len(a)), 0
    while len(live):
        more = k < length[live]
        live = live[more]
        eq = t[a[live] + k] == t[b[live] + k]
        out[live[~eq]] = False
        live, k = live[eq], k + 1
    return out
