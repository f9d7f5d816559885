"""Token ids of whole texts from a public tokenizer file, with a memo of what repeats.

Pre-tokenizers of both vocabularies never join characters across a space or line feed that has a
character other than white space on at least one side, except that it belongs to what follows it,
and never join a letter and a full stop or comma after it. So texts are cut before these, and cuts
repeat a lot: a batch's cuts are brought together by hashes and compared byte by byte, the
tokenizers library encodes those alone that a bounded memo (sorted arrays, with their bytes) doesn't
hold, and the ids are gathered back into place. Equal ids are never taken from equal hashes. A text
with a longer run of white space, where the cut would matter, goes to the library whole.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np
import public_tokenizers

from tallyweave.llm.common import Polynomial

#: White space of any engine, and what any engine might take for it.
_WS = "[\\s\\x85\\xa0\\u1680\\u180e\\u2000-\\u200f\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff]"
ODD = re.compile(f"{_WS}[ \\n](?:{_WS}|$)")
MEMO = 1_500_000
_LETTER = np.zeros(256, bool)
_LETTER[list(range(65, 91)) + list(range(97, 123))] = True
#: Second bytes of the letters U+00C0 to U+00FF after their first byte C3 (not the two signs there).
_SECOND = np.zeros(256, bool)
_SECOND[128:192] = True
_SECOND[[0x97, 0xB7]] = False


def cuts(data: np.ndarray) -> np.ndarray:
    """Whether a cut may stand before each byte."""
    at = (data == 32) | (data == 10)
    stop = np.flatnonzero((data == 46) | (data == 44))
    stop = stop[stop > 0]
    before = data[stop - 1]
    lead = data[np.maximum(stop - 2, 0)]
    at[stop[_LETTER[before] | _SECOND[before] & (lead == 0xC3) & (stop > 1)]] = True
    return at


#: Bytes of the longest cut that is compared by words and held in the memo.
LONG = 256
_MASKS = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)


def _words(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on as one number, zeros after the end."""
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    return np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))


def same(x: np.ndarray, a: np.ndarray, y: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the `size` bytes of x (as _words) from a on equal those of y from b on."""
    out, todo, i = np.ones(len(a), bool), np.flatnonzero(size > 0), 0
    while len(todo):
        left = size[todo] - i
        out[todo] &= (x[a[todo] + i] ^ y[b[todo] + i]) & _MASKS[np.minimum(left, 8)] == 0
        todo, i = todo[left > 8], i + 8
    return out


class Encoder:
    def __init__(self, name: str, memo: int = MEMO):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(public_tokenizers.path(name))
        self.library.encode_special_tokens = True
        self.most, self.hash = memo, Polynomial(11)
        self._forget()

    def _forget(self) -> None:
        self.keys, self.place, self.length = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int32)
        self.bytes, self.held = np.zeros(1 << 20, np.uint8), 0
        self.begin, self.size = np.empty(0, np.int64), np.empty(0, np.int32)
        self.tokens, self.used = np.empty(1 << 20, np.uint32), 0

    def _keep(self, ids: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Puts ids at the end of the held tokens: where each begins, and its length."""
        size = np.array([len(x) for x in ids], np.int64) // 4
        begin = self.used + np.cumsum(size) - size
        self.used += int(size.sum())
        if self.used > len(self.tokens):
            self.tokens = np.resize(self.tokens, 2 * self.used)
        self.tokens[self.used - int(size.sum()) : self.used] = np.frombuffer(b"".join(ids), "<u4")
        return begin, size.astype(np.int32)

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def batch(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids (unsigned 32-bit) of UTF-8 texts that lie one after the other in data, and where
        each text's ids start and the last one's end."""
        n = len(offsets) - 1
        raw = data.tobytes()
        at = cuts(data)
        at[offsets[:-1][offsets[:-1] < len(data)]] = True
        own: dict[int, bytes] = {}
        for i in range(n):  # the few texts that go whole
            if ODD.search(raw[offsets[i] : offsets[i + 1]].decode()):
                at[offsets[i] + 1 : offsets[i + 1]] = False
                own[int(offsets[i])] = self._encode([raw[offsets[i] : offsets[i + 1]].decode()])[0]
        start = np.flatnonzero(at)
        end = np.append(start[1:], len(data))[: len(start)]
        key = self.hash.of(self.hash.prefix(data), start, end) + (end - start).astype(np.uint64)
        length = end - start
        u, first, which = np.unique(key, return_index=True, return_inverse=True)
        twin = np.flatnonzero(first[which] != np.arange(len(key)))
        one, two = start[twin], start[first[which[twin]]]
        words = _words(data)
        equal = length[twin] == length[first[which[twin]]]
        short = equal & (length[twin] <= LONG)
        equal[short] = same(words, one[short], words, two[short], length[twin][short])
        for i in np.flatnonzero(equal & ~short).tolist():
            n = int(length[twin[i]])
            equal[i] = raw[one[i] : one[i] + n] == raw[two[i] : two[i] + n]
        others: dict[bytes, int] = {}  # cuts with the hash of others
        for i in twin[~equal].tolist():
            which[i] = len(u) + others.setdefault(raw[start[i] : end[i]], len(others))
        a, b = start[first], end[first]
        if len(self.keys) > self.most:
            self._forget()
        pos = np.searchsorted(self.keys, u)
        hit = np.zeros(len(u), bool)
        if len(self.keys):
            near = np.minimum(pos, len(self.keys) - 1)
            found = np.flatnonzero((self.keys[near] == u) & (self.length[near] == b - a))
            memo = np.ndarray((len(self.bytes) - 7,), "<u8", self.bytes, 0, (1,))
            hit[found] = same(words, a[found], memo, self.place[near[found]], (b - a)[found])
            clash = (self.keys[near] == u) & ~hit
        else:
            clash = hit
        begin, size = np.zeros(len(u), np.int64), np.zeros(len(u), np.int32)
        begin[hit], size[hit] = self.begin[pos[hit]], self.size[pos[hit]]
        new = np.flatnonzero(~hit)
        whole = np.isin(a[new], np.fromiter(own, np.int64, len(own)))
        once, new = new[whole | clash[new] | (b - a > LONG)[new]], new[~(whole | clash[new] | (b - a > LONG)[new])]
        for x in range(0, len(new), 20_000):
            some = new[x : x + 20_000]
            begin[some], size[some] = self._keep(self._encode([raw[i:j].decode() for i, j in zip(a[some].tolist(), b[some].tolist(), strict=True)]))
        used = self.used
        if len(once):
            begin[once], size[once] = self._keep([own[i] if i in own else self._encode([raw[i:j].decode()])[0] for i, j in zip(a[once].tolist(), b[once].tolist(), strict=True)])
        if others:
            more = self._keep(self._encode([x.decode() for x in others]))
            begin, size = np.append(begin, more[0]), np.append(size, more[1])
        tokens, self.used = self.tokens, used  # long and whole texts don't come again
        length = (b - a)[new]
        place = self.held + np.cumsum(length) - length
        self.held += int(length.sum())
        if self.held + 8 > len(self.bytes):
            self.bytes = np.resize(self.bytes, 2 * self.held + 8)
        self.bytes[self.held - int(length.sum()) : self.held] = np.frombuffer(b"".join([raw[i:j] for i, j in zip(a[new].tolist(), b[new].tolist(), strict=True)]), np.uint8)
        self.keys, self.place, self.length = np.insert(self.keys, pos[new], u[new]), np.insert(self.place, pos[new], place), np.insert(self.length, pos[new], length.astype(np.int32))
        self.begin, self.size = np.insert(self.begin, pos[new], begin[new]), np.insert(self.size, pos[new], size[new])
        each = size[which]
        ends = np.cumsum(each)
        ids = tokens[np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin[which] - ends + each, each)]
        return ids, np.concatenate(([0], ends))[np.searchsorted(start, offsets)]

    def ids(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        parts = [(t or "").encode() for t in texts]
        offsets = np.cumsum([0, *map(len, parts)])
        ids, at = self.batch(np.frombuffer(b"".join(parts), np.uint8), offsets)
        return [ids[a:b].tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


_made: dict[str, Encoder] = {}


def encoder(name: str) -> Encoder:
    """One for each vocabulary and Python worker."""
    if name not in _made:
        _made[name] = Encoder(name)
    return _made[name]
