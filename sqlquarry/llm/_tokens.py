"""Token ids by a public tokenizer, faster than one call a text.

The vocabularies used here drop white space before their merges and never merge across it, so the ids of a
text are those of its blank-separated pieces, one after the other.

Texts of ASCII and common Latin letters are cut to the words that the vocabulary merges in as arrays of bytes, and the
different words of several texts are merged side by side, one merge of each word at a time.  Words are looked up among
those merged before by their hashes and compared byte by byte.  Of any other text, pieces repeat, so their ids are kept; a piece of such letters
goes straight to the tokenizer's BPE model, the rest through the whole tokenizer.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from ._common import chunks
from ._text import differ, hashes, heads, same

_KEEP = 600_000
#: Longer pieces hardly come again and are not kept, which bounds the kept ones in bytes.
_LONGEST = 64
#: Merged words that a worker keeps, some 65 bytes each with their places; with more it begins anew.
_WORDS = 1 << 20
#: Bytes up to which words are merged side by side.
_SIZES = (5, 8, 11, 15, 24, _LONGEST)
#: Letters of the texts that are cut and looked up together: arrays of these stay in a processor's cache.
_STEP = 1 << 19
#: Letters of the texts whose words are merged together.
_TOGETHER = 8 << 20
_LOADED: dict[str, "PieceTokenizer"] = {}
#: Pieces whose normal form and lower case are plain: printable ASCII and precomposed Latin letters.
_PLAIN = re.compile("[!-~À-ÖØ-öø-įı-ňŊ-ž]+").fullmatch
_PLAIN_TEXT = re.compile("[!-~À-ÖØ-öø-įı-ňŊ-ž \\n\\t\\r]*").fullmatch
_CUT = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-ž]+|[0-9]|[^\\sa-z0-9ß-ž]+").findall


def _byte_letters() -> dict[int, str]:
    """The printable character that byte-level vocabularies write for each byte."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = (b for b in range(256) if b not in own)
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


_LETTER = _byte_letters()


_BLANK, _LETTERS, _DIGIT, _SIGN = range(4)
#: What each byte of a lower-case plain text is part of.
_KIND = bytes(_BLANK if b <= 32 else _DIGIT if 48 <= b <= 57 else _LETTERS if 97 <= b <= 122 or b >= 128 else _SIGN for b in range(256))


def cut(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the words that ``_CUT`` finds in a lower-case plain text begin and end; it ends with three blanks."""
    buf, kind = np.frombuffer(data, np.uint8), np.frombuffer(data.translate(_KIND), np.uint8)
    edge = np.append(True, kind[1:] != kind[:-1]) | (kind == _DIGIT)
    quote = np.flatnonzero(buf[:-2] == ord("'"))
    quote = quote[edge[quote] & (kind[quote + 1] == _LETTERS)]
    one, two = buf[quote + 1], buf[quote + 2]
    size = np.where(np.isin(one, np.frombuffer(b"stmd", np.uint8)), 2, 0)
    size[((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))] = 3
    quote, size = quote[size > 0], size[size > 0]
    edge[quote + 1] = False
    edge[quote + size] = True
    at = np.flatnonzero(edge)
    word = np.flatnonzero(kind[at[:-1]] != _BLANK)
    return at[word], at[word + 1]


class Merges:
    """The merges of a byte-level BPE model, for many words at once.

    ``tables`` hash pairs to their merge's place among all, in the lower 16 bits, with the pair above to tell it from
    others; each has the pairs that found their place taken in the one before.
    """

    _NONE, _FREE = np.int32(2**31 - 1), np.uint64(2**64 - 1)

    def __init__(self, model: dict):
        vocab, end = model["vocab"], model.get("end_of_word_suffix") or ""
        self.first = np.array([vocab[_LETTER[b]] for b in range(256)], dtype=np.int32)
        self.last = np.array([vocab[_LETTER[b] + end] for b in range(256)], dtype=np.int32)
        named = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        merged = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(named)}
        left, right = (np.array(x, dtype=np.int64) for x in zip(*merged, strict=True))
        rank, made = (np.array(x, dtype=np.int32) for x in zip(*merged.values(), strict=True))
        self.made = np.zeros(int(rank.max()) + 1, dtype=np.int32)
        self.made[rank] = made
        self.size = np.uint64(max(vocab.values()) + 1)
        if len(self.made) > 1 << 16 or self.size >= 1 << 23:
            raise KeyError("more merges than places hold")
        key, self.tables = left.astype(np.uint64) * self.size + right.astype(np.uint64), []
        while len(key):
            factor = np.uint64((2 * len(self.tables) + 3) * 0x9E3779B97F4A7C15 & 2**64 - 1)
            table, slot = np.full(1 << 17, self._FREE), key * factor >> np.uint64(47)
            table[slot] = entry = key << np.uint64(16) | rank.astype(np.uint64)
            self.tables.append((table, factor))
            key, rank = (x[table[slot] != entry] for x in (key, rank))
        self.begin = self.rank(np.repeat(self.first, 512), np.tile(np.concatenate((self.first, self.last)), 256))

    @classmethod
    def of(cls, model: dict) -> "Merges | None":
        """None for a model of another kind."""
        if model.get("type") != "BPE" or any(model.get(x) for x in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges")):
            return None
        try:
            return cls(model)
        except KeyError:  # a byte or a merged token that the vocabulary lacks
            return None

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The place of each pair's merge among all."""
        key = left.astype(np.uint64) * self.size + right.astype(np.uint64)
        out, rest = np.full(len(key), self._NONE), np.arange(len(key))
        for table, factor in self.tables:
            found = table[key * factor >> np.uint64(47)]
            same = found >> np.uint64(16) == key
            out[rest[same]] = found[same] & np.uint64(0xFFFF)
            more = ~same & (found != self._FREE)
            key, rest = key[more], rest[more]
            if not len(key):
                break
        return out

    def run(self, letters: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Words as rows of ``size`` bytes each: (numbers of words, how many ids each has, all ids), every word once.

        Each step merges the first of the pairs of least rank in every word, as the model does.
        """
        at, width = np.arange(len(letters)), letters.shape[1]
        sym = self.first[letters]
        sym[at, size - 1] = self.last[letters[at, size - 1]]
        pair = letters[:, :-1].astype(np.int32) * 512 + letters[:, 1:]
        many = np.flatnonzero(size > 1)
        pair[many, size[many] - 2] += 256
        rank = self.begin[pair]
        rank[np.arange(1, width) >= size[:, None]] = self._NONE
        while width > 1 and len(at):
            j = rank.argmin(axis=1)
            low = rank[np.arange(len(at)), j]
            if (done := low == self._NONE).any():
                yield at[done], size[done], sym[done][np.arange(width) < size[done, None]]
                at, sym, rank, j, low, size = (x[~done] for x in (at, sym, rank, j, low, size))
            row, new = np.arange(len(at)), self.made[low]
            sym[row, j] = new
            kept = np.ones((len(at), width), dtype=bool)
            kept[row, j + 1] = False
            sym = sym[kept].reshape(len(at), width - 1)
            kept = np.ones((len(at), width - 1), dtype=bool)
            kept[row, j] = False
            width, size = width - 1, size - 1
            rank = rank[kept].reshape(len(at), width - 1)
            before, after = np.flatnonzero(j > 0), np.flatnonzero(j < size - 1)
            b, c = j[before] - 1, j[after]
            found = self.rank(np.concatenate((sym[before, b], new[after])), np.concatenate((new[before], sym[after, c + 1])))
            rank[before, b], rank[after, c] = found[: len(b)], found[len(b) :]
        if len(at):
            yield at, size, sym[np.arange(width) < size[:, None]]


def grown(x: np.ndarray, size: int) -> np.ndarray:
    """``x`` with room for ``size``."""
    return x if size <= len(x) else np.concatenate((x, np.zeros(max(len(x), size - len(x)), x.dtype)))


def spans(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers ``first[i], ..., first[i] + size[i] - 1`` for every ``i``."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - ends + size, size)


class Kept:
    """Merged words with their ids, numbered from 1, in a table by hash whose free places have 0.

    Word ``i`` has the bytes of ``text`` from ``start[i]``; ``ids[i]`` is where its ids begin in ``pool``, shifted by
    eight bits, and how many they are.  The last bit of a hash tells words of more than eight bytes from others.
    """

    def __init__(self, kind: np.dtype):
        self.words, self.bytes, self.held = 1, 0, 0
        self.hash, self.head = np.zeros(1, np.uint64), np.zeros(1, np.uint64)
        self.start, self.length, self.ids = (np.zeros(1, np.int64) for _ in range(3))
        self.text, self.pool = np.zeros(9, np.uint8), np.zeros(1, kind)
        self.table = np.zeros(1 << 12, np.int32)

    def find(self, data: bytes, start: np.ndarray, length: np.ndarray, known: np.ndarray) -> np.ndarray | None:
        """The number of each word, 0 for new ones; None if one has the hash of another."""
        head, bits = heads(data, start, length), len(self.table).bit_length() - 1
        place = (known >> np.uint64(64 - bits)).astype(np.int64)
        number = self.table.take(place)
        far = np.flatnonzero((self.hash.take(number) != known) & (number > 0))
        while len(far):
            place[far] = place[far] + 1 & len(self.table) - 1
            number[far] = self.table[place[far]]
            far = far[(self.hash[number[far]] != known[far]) & (number[far] > 0)]
        if ((self.head.take(number) != head) & (number > 0)).any():
            return None
        long = np.flatnonzero((number > 0) & (length > 8))
        mine = number[long]
        if (self.length[mine] != length[long]).any() or differ(data, start[long], self.text, self.start[mine], length[long]).any():
            return None
        return number

    def add(self, data: bytes, start: np.ndarray, length: np.ndarray, known: np.ndarray, ids: np.ndarray, first: np.ndarray, count: np.ndarray) -> None:
        """Keep words that aren't here yet; their ids are those of ``ids`` from ``first``."""
        a, b = self.words, self.words + len(start)
        text, more = np.frombuffer(data, np.uint8)[spans(start, length)], ids[spans(first, count)]
        columns = (("hash", known), ("head", heads(data, start, length)), ("start", self.bytes + np.cumsum(length) - length), ("length", length), ("ids", self.held + np.cumsum(count) - count << 8 | count))
        for name, x in columns:
            setattr(self, name, grown(getattr(self, name), b))
            getattr(self, name)[a:b] = x
        self.text, self.pool = grown(self.text, self.bytes + len(text) + 9), grown(self.pool, self.held + len(more))
        self.text[self.bytes : self.bytes + len(text)] = text
        self.pool[self.held : self.held + len(more)] = more
        self.words, self.bytes, self.held = b, self.bytes + len(text), self.held + len(more)
        rest = np.arange(a, b, dtype=np.int32)
        if 2 * b > len(self.table):
            self.table, rest = np.zeros(1 << (2 * b).bit_length(), np.int32), np.arange(1, b, dtype=np.int32)
        place = (self.hash[rest] >> np.uint64(65 - len(self.table).bit_length())).astype(np.int64)
        while len(rest):
            free = self.table[place] == 0
            self.table[place[free]] = rest[free]
            left = self.table[place] != rest
            place, rest = place[left] + 1 & len(self.table) - 1, rest[left]


def tokenizer(name: str) -> "PieceTokenizer":
    """The tokenizer of a vocabulary file, loaded once in each Python worker."""
    if name not in _LOADED:
        _LOADED[name] = PieceTokenizer(name)
    return _LOADED[name]


def forget() -> None:
    """Drop the kept pieces at a task's end: idle workers stay, and each would hold its own.

    Merged words stay, in arrays that take much less: the next task has most of them again.
    """
    for made in _LOADED.values():
        made.cache = _Ids(made)


class _Ids(dict):
    def __init__(self, owner: "PieceTokenizer"):
        super().__init__({"": b""})
        self.owner = owner

    def __missing__(self, piece: str) -> bytes:
        owner = self.owner
        if not owner.short:
            found = owner.encode(piece)
        elif piece.isalpha() and (piece.isascii() or _PLAIN(piece)):
            low = piece.lower()
            found = self[low] if low != piece else owner.word(piece)
        elif piece[-1] in ".,;:!?" and piece[:-1].isalpha() and (piece.isascii() or _PLAIN(piece)):
            found = self[piece[:-1]] + self[piece[-1:]] if len(piece) > 1 else owner.encode(piece)
        else:
            found = owner.encode(piece)
        if len(piece) <= _LONGEST:
            self[piece] = found
        return found


class PieceTokenizer:
    """Ids as ``tokenizers`` gives them with ``add_special_tokens=False``."""

    def __init__(self, name: str):
        self.plain = Tokenizer.from_file(public_tokenizers.path(name))
        self.model = self.plain.model
        self.kind = np.dtype("<u4" if self.plain.get_vocab_size() > 0xFFFF else "<u2")
        self.code = "I" if self.kind.itemsize == 4 else "H"
        self.specials = [t.content for t in self.plain.get_added_tokens_decoder().values()]
        self.cache = _Ids(self)
        probe = "Ça l'été n'a-t-il 2024 (don't) ÿ?!"
        direct = b"".join(map(self.direct, probe.split(" ")))
        self.short = np.frombuffer(direct, self.kind).tolist() == self.whole(probe)
        self.merges = Merges.of(json.loads(self.plain.to_str())["model"]) if self.short else None
        self.kept = Kept(self.kind)

    def whole(self, text: str) -> list[int]:
        return self.plain.encode(text, add_special_tokens=False).ids

    def word(self, part: str) -> bytes:
        """The ids of one run of lower-case letters, or of another part that the model takes whole."""
        if not part.isascii():
            part = "".join([_LETTER[b] for b in part.encode()])
        return array(self.code, [t.id for t in self.model.tokenize(part)]).tobytes()

    def direct(self, piece: str) -> bytes:
        return b"".join(map(self.word, _CUT(piece.lower())))

    def encode(self, piece: str) -> bytes:
        if self.short and _PLAIN(piece) and not ("<" in piece and any(s in piece for s in self.specials)):
            return self.direct(piece)
        return np.array(self.whole(piece), dtype=self.kind).tobytes()

    def _plain_ids(self, texts: list[str]) -> list[np.ndarray] | None:
        """The ids of plain texts; None if two different words have one hash."""
        kept, steps, missed = self.kept, [], []
        for lo, hi in chunks([len(t) for t in texts], _STEP):
            parts = [t.lower().encode() for t in texts[lo:hi]]
            data = b" ".join(parts) + b" " * 9
            start, end = cut(data)
            length = end - start
            known = hashes(data, start, end) & ~np.uint64(1) | (length > 8)
            number = kept.find(data, start, length, known)
            if number is None:
                return None
            new = np.flatnonzero(number == 0)
            steps.append((number, new, np.searchsorted(start, np.cumsum([0, *(len(p) + 1 for p in parts)]))))
            missed.append((np.frombuffer(data, np.uint8)[spans(start[new], length[new])], length[new], known[new]))
        if (merged := self._merge(*(np.concatenate(x) for x in zip(*missed, strict=True)))) is None:
            return None
        more, firsts, counts = merged
        pool, out, done = np.concatenate((kept.pool[: kept.held], more)), [], 0
        for number, new, place in steps:
            ids = kept.ids.take(number)
            first, count = ids >> 8, ids & 0xFF
            first[new], count[new] = (x[done : done + len(new)] for x in (firsts + kept.held, counts))
            ids, ends = pool.take(spans(first, count)), np.concatenate(([0], np.cumsum(count)))
            out += [ids[a:b] for a, b in zip(ends[place[:-1]], ends[place[1:]], strict=True)]
            done += len(new)
        if kept.words > _WORDS:
            self.kept = Kept(self.kind)
        return out

    def _merge(self, text: np.ndarray, length: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """Merge words that aren't kept, one after the other in ``text``, and keep them: ids, where each word's begin and
        how many they are; None if two different words have one hash."""
        data, start = text.tobytes() + b" " * 9, np.cumsum(length) - length
        bits = np.uint64(len(start).bit_length())
        found = np.sort(known >> bits << bits | np.arange(len(start), dtype=np.uint64))
        order = (found & (np.uint64(1) << bits) - np.uint64(1)).astype(np.int64)
        found >>= bits
        new = np.append(True, found[1:] != found[:-1])[: len(order)]
        if not same(data, start[order], length[order], new):
            return None
        named, one = np.empty(len(order), dtype=np.int64), order[new]
        named[order] = np.cumsum(new) - 1
        size = length[one]
        buf, pool, held = np.frombuffer(data, np.uint8), [np.empty(0, self.kind)], 0
        first, count = np.empty(len(one), np.int64), np.empty(len(one), np.int64)
        for low, high in zip((0, *_SIZES), (*_SIZES, max(int(size.max(initial=0)), _LONGEST)), strict=True):
            own = np.flatnonzero((size > low) & (size <= high))
            if low == _LONGEST:
                made = (np.frombuffer(self.word(data[start[one[i]] : start[one[i]] + size[i]].decode()), self.kind) for i in own.tolist())
                rows = ((np.array([k]), np.array([len(x)]), x) for k, x in enumerate(made))
            else:
                rows = self.merges.run(buf[np.minimum(start[one[own]][:, None] + np.arange(high), len(buf) - 1)], size[own])
            for at, many, ids in rows:
                pool.append(ids.astype(self.kind))
                first[own[at]], count[own[at]] = held + np.cumsum(many) - many, many
                held += len(ids)
        ids, brief = np.concatenate(pool), np.flatnonzero(size <= _LONGEST)
        self.kept.add(data, start[one[brief]], size[brief], known[one[brief]], ids, first[brief], count[brief])
        return ids, first[named], count[named]

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, as unsigned integers."""
        out: dict[int, np.ndarray] = {}
        plain = [i for i, t in enumerate(texts) if self.merges and _PLAIN_TEXT(t) and not ("<" in t and any(s in t for s in self.specials))]
        for lo, hi in chunks([len(texts[i]) for i in plain], _TOGETHER):
            found = self._plain_ids([texts[i] for i in plain[lo:hi]])
            out.update(zip(plain[lo:hi], found or [], strict=bool(found)))
        if len(self.cache) > _KEEP:
            self.cache = _Ids(self)
        get = self.cache.__getitem__
        for i, t in enumerate(texts):
            if i not in out:
                out[i] = np.frombuffer(b"".join(map(get, t.replace("\n", " ").split(" "))), dtype=self.kind)
        return [out[i] for i in range(len(texts))]
