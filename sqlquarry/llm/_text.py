"""Words of whole texts as NumPy arrays.

A word is a run of ASCII digits, ASCII letters (lower-cased) and characters beyond ASCII.  In UTF-8 every
byte of a character beyond ASCII is 0x80 or more, so words can be cut on bytes.
"""

from __future__ import annotations

import hashlib

import numpy as np

_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [2**64 - 1], dtype=np.uint64)
_LONG = 4096


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (the finaliser of MurmurHash3)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def fold(text: bytes) -> bytes:
    """ASCII letters in lower case, every byte that is not part of a word as a blank."""
    return text.translate(_FOLD)


def words(text: bytes | None) -> list[bytes]:
    """The words of one text, in order; none for a null text."""
    return text.translate(_FOLD).split() if text else []


def hashes(data: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each range of ``data``; at least seven bytes follow the last one."""
    eight = np.ndarray(shape=(len(data) - 7,), dtype="<u8", buffer=data, strides=(1,))
    length = end - start
    out = mix(length.astype(np.uint64) ^ (eight[start] & _MASK[np.minimum(length, 8)]) * np.uint64(0x9E3779B97F4A7C15))
    left = np.flatnonzero((length > 8) & (length <= _LONG))
    done = 8
    while len(left):
        at = start[left] + done
        out[left] = mix((out[left] ^ (eight[at] & _MASK[np.minimum(length[left] - done, 8)])) * np.uint64(0x9E3779B97F4A7C15))
        done += 8
        left = left[length[left] > done]
    for i in np.flatnonzero(length > _LONG):
        out[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]], digest_size=8).digest(), "little")
    return out


def heads(data: bytes, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The first eight bytes of each range as a number; seven bytes follow the last one."""
    eight = np.ndarray(shape=(len(data) - 7,), dtype="<u8", buffer=data, strides=(1,))
    return eight[start] & _MASK[np.minimum(length, 8)]


def differ(data: bytes, start: np.ndarray, other: bytes | np.ndarray, at: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Which ranges of ``data`` have other bytes than the range as long at ``at`` in ``other``; seven bytes follow the last ones."""
    out, done = heads(data, start, length) != heads(other, at, length), 8
    long = np.flatnonzero(length > _LONG)
    for i, a, b, n in zip(long.tolist(), start[long].tolist(), at[long].tolist(), length[long].tolist(), strict=True):
        out[i] = bytes(data[a : a + n]) != bytes(other[b : b + n])
    left = np.flatnonzero((length > 8) & (length <= _LONG))
    while len(left):
        out[left] |= heads(data, start[left] + done, length[left] - done) != heads(other, at[left] + done, length[left] - done)
        done += 8
        left = left[length[left] > done]
    return out


def same(data: bytes, start: np.ndarray, length: np.ndarray, new: np.ndarray) -> bool:
    """Whether each range that isn't ``new`` has the bytes of the one before; seven bytes follow the last one."""
    head = heads(data, start, length)
    if (((head[1:] != head[:-1]) | (length[1:] != length[:-1])) & ~new[1:]).any():
        return False
    long = np.flatnonzero(~new & (length > 8))
    return not differ(data, start[long], data, start[long - 1], length[long]).any()


class Words:
    """The words of several texts.

    ``start`` and ``end`` are byte positions in ``data`` (the folded texts with blanks between them), ``hash``
    a 64-bit hash of each word, and the words of text ``i`` are ``offset[i]`` to ``offset[i + 1]``.
    ``base[i]`` is where text ``i`` begins in ``data``.
    """

    def __init__(self, texts: list[bytes | None]):
        parts = [t or b"" for t in texts]
        self.data = b" ".join(parts).translate(_FOLD) + b" " * 9
        buf = np.frombuffer(self.data, dtype=np.uint8)
        edge = np.flatnonzero(np.diff((buf != 32).view(np.int8), prepend=np.int8(0)))
        self.start, self.end = edge[0::2], edge[1::2]
        size = np.fromiter((len(t) + 1 for t in parts), dtype=np.int64, count=len(parts))
        self.base = np.concatenate(([0], np.cumsum(size)))
        self.offset = np.searchsorted(self.start, self.base)
        self.hash = hashes(self.data, self.start, self.end)

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]]


def shingles(w: Words, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``n`` words in each text and where each text's own begin.

    A text of fewer words, but not none, has one shingle: all its words.
    """
    count = np.diff(w.offset)
    own = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    offset = np.concatenate(([0], np.cumsum(own)))
    total = len(w.hash)
    rolled = np.zeros(max(0, total - n + 1), dtype=np.uint64)
    for k in range(n):
        rolled = (rolled + w.hash[k : total - n + 1 + k]) * np.uint64(0x9FB21C651E98DF25)
        rolled ^= rolled >> np.uint64(29)
    text = np.repeat(np.arange(len(count)), own)
    at = np.arange(offset[-1]) - offset[:-1][text] + w.offset[:-1][text]
    full = count[text] >= n
    out = np.empty(offset[-1], dtype=np.uint64)
    out[full] = mix(rolled[at[full]])
    for j in np.flatnonzero(~full):
        i = text[j]
        own_words = w.hash[w.offset[i] : w.offset[i + 1]]
        h = np.uint64(len(own_words))
        for x in own_words:
            h = mix(np.atleast_1d(h ^ x))[0] + np.uint64(1)
        out[j] = h
    return out, offset
