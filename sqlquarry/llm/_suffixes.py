"""Deep-shallow sorting of byte strings.

The strings are slices of one buffer.  Multikey quicksort (three-way partitions around a pivot symbol, an equal part
going on with the next symbol) orders them to a shallow depth; a symbol is eight bytes, and all open parts of one
round are partitioned at once.  Parts that are still equal at that depth, duplicates included, are ordered by blind
tries.
"""

from __future__ import annotations

import numpy as np

_MASK = np.array([((1 << (8 * r)) - 1) << (64 - 8 * r) for r in range(9)], dtype=np.uint64)


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    different = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (different.bit_length() + 7) // 8


class Strings:
    """Slices of ``data``; ``lead`` is a symbol that stands before each of them."""

    def __init__(self, data: bytes, start: np.ndarray, length: np.ndarray, lead: np.ndarray | None = None):
        self.data, self.start, self.length, self.lead = data, start, length, lead
        padded = data + b"\0" * 8
        self.words = np.ndarray(shape=(len(data) + 1,), dtype=">u8", buffer=padded, strides=(1,))
        self.led = 0 if lead is None else 8
        self.size = length + self.led

    @classmethod
    def of(cls, strings: list[bytes]) -> "Strings":
        length = np.array([len(s) for s in strings], dtype=np.int64)
        return cls(b"".join(strings), np.cumsum(length) - length, length)

    def symbol(self, items: np.ndarray, level: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
        """The symbols of strings at a level, and how many bytes of them the strings have."""
        done = 8 * np.asarray(level, dtype=np.int64) - self.led
        left = np.clip(self.length[items] - done, 0, 8)
        at = np.clip(self.start[items] + done, 0, len(self.data))
        found = self.words[at].astype(np.uint64) & _MASK[left]
        if self.led:
            first = np.broadcast_to(done < 0, found.shape)
            found = np.where(first, self.lead[items], found)
            left = np.where(first, 8, left)
        return found, left

    def tail(self, i: int, depth: int) -> bytes:
        a = int(self.start[i])
        return self.data[a + depth - self.led : a + int(self.length[i])]


def multikey_quicksort(strings: Strings, symbols: int) -> np.ndarray:
    """The order of the strings by their first ``symbols`` symbols; what is equal so far stays in the given order."""
    n = len(strings.start)
    order = np.arange(n)
    low, high, level = np.array([0]), np.array([n]), np.array([0])
    while True:
        open_ = high - low > 1
        low, high, level = low[open_], high[open_], level[open_]
        if not len(low):
            return order
        size = high - low
        part = np.repeat(np.arange(len(low)), size)
        ends = np.cumsum(size)
        place = np.arange(ends[-1]) + np.repeat(low - ends + size, size)
        items = order[place]
        symbol, left = strings.symbol(items, level[part])
        begin = ends - size
        three = np.stack((begin, begin + size // 2, ends - 1))
        middle = np.argsort(symbol[three], axis=0, kind="stable")[1]
        pivot = three[middle, np.arange(len(low))]
        p, p_left = symbol[pivot][part], left[pivot][part]
        same = symbol == p
        less = (symbol < p) | (same & (left < p_left))
        kind = np.where(less, 0, np.where(same & (left == p_left), 1, 2))
        key = 3 * part + kind
        order[place] = items[np.argsort(key, kind="stable")]
        count = np.bincount(key, minlength=3 * len(low)).reshape(-1, 3)
        edge = low[:, None] + np.concatenate((np.zeros((len(low), 1), np.int64), np.cumsum(count, axis=1)), axis=1)
        deeper = (left[pivot] == 8) & (level + 1 < symbols)
        low = np.concatenate((edge[:, 0], edge[deeper, 1], edge[:, 2]))
        high = np.concatenate((edge[:, 1], edge[deeper, 2], edge[:, 3]))
        level = np.concatenate((level, level[deeper] + 1, level))


def blind_trie(strings: list[bytes]) -> tuple[list[int], list[int]]:
    """The order of strings and the common prefix length of each with the one before it.

    Inner nodes keep only a depth and the bytes that branch there.  A string is led down without comparing what
    lies between, compared once with the leaf it arrives at, and put in where they part, or beside the leaf if it
    equals it.
    """
    root: list | int = 0
    equal: dict[int, list[int]] = {}
    for i in range(1, len(strings)):
        s, node = strings[i], root
        while type(node) is list:
            depth, branches = node
            node = branches.get(s[depth] if depth < len(s) else -1)
            if node is None:
                node = next(iter(branches.values()))
        other = strings[node]
        if s == other:
            equal.setdefault(node, []).append(i)
            continue
        lcp = common_prefix(s, other)
        here, there = (x[lcp] if lcp < len(x) else -1 for x in (s, other))
        parent, node = None, root
        while type(node) is list and node[0] < lcp:
            parent, node = node, node[1][s[node[0]] if node[0] < len(s) else -1]
        if type(node) is list and node[0] == lcp:
            node[1][here] = i
        else:
            made = [lcp, {here: i, there: node}]
            if parent is None:
                root = made
            else:
                parent[1][s[parent[0]] if parent[0] < len(s) else -1] = made
    order, lcps, todo = [], [], [(root, 0)]
    while todo:
        node, lcp = todo.pop()
        if type(node) is list:
            depth, branches = node
            keys = sorted(branches, reverse=True)
            todo += [(branches[k], depth) for k in keys[:-1]]
            todo.append((branches[keys[-1]], lcp))
        else:
            order.append(node)
            lcps.append(lcp)
            for i in equal.get(node, ()):
                order.append(i)
                lcps.append(len(strings[node]))
    return order, lcps


def deep_shallow(strings: Strings, symbols: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of strings and the common prefix length of each with the one before it (0 for the first).

    Equal strings stay in the given order.
    """
    n, depth, size = len(strings.start), 8 * symbols, strings.size
    lcp = np.zeros(n, np.int64)
    order = multikey_quicksort(strings, symbols)
    at = np.arange(1, n)
    for k in range(symbols):
        a, a_left = strings.symbol(order[at - 1], k)
        b, b_left = strings.symbol(order[at], k)
        different = a ^ b
        lead = np.zeros(len(at), np.int64)
        for shift in (32, 16, 8):  # leading equal bytes of a symbol, by halves
            high = different >> np.uint64(64 - 8 * (shift // 8))
            clear = high == 0
            lead += np.where(clear, shift // 8, 0)
            different = np.where(clear, different << np.uint64(shift), different)
        lead += different == 0
        lcp[at] = 8 * k + np.minimum(lead, np.minimum(a_left, b_left))
        at = at[(a == b) & (a_left == 8) & (b_left == 8)]
    deep = np.zeros(n + 1, dtype=bool)
    deep[at] = True
    edge = np.flatnonzero(np.diff(deep.astype(np.int8)))
    for a, b in zip(edge[0::2].tolist(), edge[1::2].tolist(), strict=True):
        own = order[a : b + 1]
        ranked, between = blind_trie([strings.tail(i, depth) for i in own.tolist()])
        order[a : b + 1] = own[ranked]
        lcp[a + 1 : b + 1] = depth + np.array(between[1:])
    return order, np.minimum(lcp, size[order]) if n else lcp
