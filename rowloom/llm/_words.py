"""Words of whole texts and keyed hashes of runs of words, as array operations over a block of texts.

No hash here is linear: words are taken in eight bytes at a time with a mixing step after each (long words by BLAKE2b), and a run of
words is hashed as a tree of pairs. The keys are drawn anew for each run of an operator, so nobody can make texts up
whose hashes meet.
"""

from __future__ import annotations

import secrets
from hashlib import blake2b

import numpy as np

# The separators of words, an odd factor, and the factors of the mixer.
SEPARATORS = bytes([0x20, *range(0x09, 0x0E)])
ODD = 0x9E3779B97F4A7C17
MIX, MIX_2 = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
LONG = 64  # bytes; longer words go through BLAKE2b

_IS_SEPARATOR = np.zeros(256, bool)
_IS_SEPARATOR[list(SEPARATORS)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_FIRST_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def draw_key() -> int:
    return secrets.randbits(64)


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(MIX)
    x ^= x >> np.uint64(27)
    x *= np.uint64(MIX_2)
    x ^= x >> np.uint64(31)
    return x


class Words:
    """Words of a list of UTF-8 texts (None has none), one after the other.

    starts, ends: byte ranges in data; first[i] to first[i + 1]: the words of text i.
    """

    def __init__(self, texts: list[bytes | None], lower: bool = False):
        lengths = np.array([len(t) + 1 if t is not None else 1 for t in texts], np.int64)
        self.data = b"".join([(t or b"") + b" " for t in texts]) + bytes(8)  # so that eight bytes can be read anywhere
        raw = np.frombuffer(self.data, np.uint8)
        if lower:
            raw = _LOWER[raw]
            self.data = raw.tobytes()
        inside = ~_IS_SEPARATOR[raw[:-8]]
        edge = np.flatnonzero(np.diff(inside, prepend=False))
        self.starts, self.ends = edge[0::2], edge[1::2]
        self.first = np.searchsorted(self.starts, np.concatenate([[0], np.cumsum(lengths)]))

    def hashes(self, key: int) -> np.ndarray:
        """A 64-bit hash of each word. Different keys give independent hashes."""
        size = self.ends - self.starts
        out = mix(size.astype(np.uint64) * np.uint64(ODD) + np.uint64(key))
        eight = np.ndarray((len(self.data) - 7,), "<u8", self.data, strides=(1,))
        short = np.flatnonzero(size <= LONG)
        at, left, done = self.starts[short], size[short], 0
        while len(short):
            out[short] = mix(out[short] ^ (eight[at + done] & _FIRST_BYTES[np.minimum(left, 8)]))
            more = left > 8
            short, at, left, done = short[more], at[more], left[more] - 8, done + 8
        own = key.to_bytes(8, "little")
        for i in np.flatnonzero(size > LONG).tolist():
            out[i] = int.from_bytes(blake2b(self.data[self.starts[i] : self.ends[i]], digest_size=8, key=own).digest(), "little")
        return out

    def runs(self, n: int) -> np.ndarray:
        """The words at which a run of n words of one text starts."""
        ok = np.zeros(len(self.starts), bool)
        for a, b in zip(self.first, self.first[1:]):
            ok[a : max(a, b - n + 1)] = True
        return np.flatnonzero(ok)

    def owner(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def _join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * np.uint64(ODD) + b)


def run_hashes(words: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of the n words from each of `at` on: hashes of 1, 2, 4 .. words are made for all places, and those that n is the
    sum of are joined."""
    level, size, done, out = words, 1, 0, None
    while True:
        if n & size:
            part = level[at + done]
            out = mix(part + np.uint64(size)) if out is None else _join(out, part)
            done += size
        if 2 * size > n:
            return out
        level, size = _join(level[:-size], level[size:]), 2 * size
