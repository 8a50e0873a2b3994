"""Packing of token sequences by lexical retrieval.

A seed text asks with its strongest words: those that add most to its own BM25 score, up to ``query_words`` and no more
than make up ``query_share`` of that score.  Every unused text of the corpus that has one of them is scored.  The texts of an input partition are cut to index shards of at most
``shard_bytes``, each with its postings; document frequencies, the number of texts and their mean length are those of
the whole corpus.  All seeds of a round meet every shard, and their best lists are merged.

A seed opens a window of ``length`` tokens, and the unused texts that BM25 ranks next to it fill what room it
leaves, best first; where no unused text has one of its words, the next unused text does.  A text that crosses the
end of a window is cut there, and its rest seeds the next window of its chain.  Chains advance side by side, each by
one window a round, and take texts in turn.  A list is cut after ``_NEAR`` texts; a window that finds all of them
used asks again in the next round, for twice as many, so the cut leaves nobody out.  Equally near texts come in an
order of each seed's own, so that the seeds of one group of copies don't all ask for the same ones.  When no text is
left, the windows still open are joined one after the other, so every window is full but the last, and that one is
cut to sequences whose lengths are powers of two, which need no padding.

Words are 52 bits of their hashes.  Seeds whose words few texts of a shard have are scored posting by posting, others in a
cell for each text, of which only the seed's best leave the shard, so a group of copies whose words a third of all texts
have costs no list of pairs.  The driver holds a length and a flag for each
text and sends a round's queries, at most ``_CHAINS`` of ``query_words`` words; a task holds one shard and a few best
texts of each seed.

Defined results: a null or empty text is just the end id; repeated rows are packed as often as they come and
ids may repeat; a text without words has no neighbours; an empty table gives no row.  Only the key and the text are
read, whatever other columns there are.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import arrow_schema, map_batches, small_batches, stage
from ._meet import BITS, ORDINAL, pack as packed, ranges_for, unpack
from ._text import Words, mix
from ._tokens import forget, tokenizer

_ROUNDS, _CHAINS, _NEAR, _MOST, _FLUSH = 8, 1 << 16, 8, 2048, 500_000
#: Words that more than one in so many texts of a shard have are added as rows, with a cell for each text.
_DENSE = 16
_CELLS = 400_000
#: Words' weights and texts' scores are told apart so finely before the best are sorted.
_LEVELS, _STEPS = 256, 64
_TINY = np.nextafter(0.0, 1.0)
#: Scores that a task gathers before it keeps each seed's best.
_HELD = 500_000
#: Groups of seeds whose lists are merged by one task each.
_GROUPS = 64
#: Pieces up to so many bytes go to all executors, more are joined.
_BROADCAST = 32 << 20


def powers(window: list[tuple[int, int, int]], length: int) -> list[list[tuple[int, int, int]]]:
    """A window that is not full as sequences whose lengths are powers of two, longest first."""
    total = sum(n for _, _, n in window)
    if total == length:
        return [window]
    out, parts = [], list(reversed(window))
    for bit in range(total.bit_length() - 1, -1, -1):
        need = total & (1 << bit)
        own = []
        while need:
            text, start, size = parts.pop()
            take = min(size, need)
            own.append((text, start, take))
            if take < size:
                parts.append((text, start + take, size - take))
            need -= take
        if own:
            out.append(own)
    return out


def postings(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words as 52 bits of their hashes, ascending; the number of texts of each; the text and frequency of each
    posting; lengths.  There are at most 2 ** ORDINAL texts."""
    w = Words(texts)
    length = np.diff(w.offset)
    keys = (w.hash >> np.uint64(64 - BITS) << np.uint64(ORDINAL)) | np.repeat(np.arange(len(texts), dtype=np.uint64), length)
    keys.sort()
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, np.int64)
    tf = np.diff(np.append(first, len(keys)))
    keys = keys[first]
    terms = keys >> np.uint64(ORDINAL)
    first = np.flatnonzero(np.append(True, terms[1:] != terms[:-1])) if len(keys) else first
    return terms[first], np.diff(np.append(first, len(keys))), (keys & np.uint64((1 << ORDINAL) - 1)).astype(np.int64), tf, length


def narrow(x: np.ndarray) -> bytes:
    """Integers from 0 in as few bytes as the largest needs, after their width."""
    width = next(k for k in (1, 2, 4, 8) if not len(x) or int(x.max()) < 1 << (8 * k))
    return bytes([width]) + x.astype(f"<u{width}").tobytes()


def thin(blob: bytes) -> np.ndarray:
    """Integers as ``narrow`` wrote them."""
    return np.frombuffer(blob, f"<u{blob[0]}", offset=1)


def widen(blob: bytes) -> np.ndarray:
    return thin(blob).astype(np.int64)


def slim(x: np.ndarray) -> bytes:
    """Integers from 0, most of them below 256, in a byte each; larger ones follow with their places."""
    large = np.flatnonzero(x > 255)
    rest = np.concatenate((large, x[large])).astype("<i8").tobytes()
    return len(x).to_bytes(8, "little") + np.minimum(x, 255).astype(np.uint8).tobytes() + rest


def slimmed(blob: bytes) -> np.ndarray:
    """Integers as ``slim`` wrote them."""
    n = int.from_bytes(blob[:8], "little")
    out = np.frombuffer(blob, np.uint8, n, 8)
    if len(blob) > 8 + n:
        large, value = np.frombuffer(blob, "<i8", offset=8 + n).reshape(2, -1)
        out = out.astype(np.int64)
        out[large] = value
    return out


def idf(texts: int, df: np.ndarray) -> np.ndarray:
    """Positive for every word."""
    return np.log1p((texts - df + 0.5) / (df + 0.5))


def damping(size: np.ndarray, mean: float, k1: float = 1.2, b: float = 0.75) -> np.ndarray:
    """What a text's length adds below the line."""
    return k1 * (1 - b + b * size / mean)


def damped(tf: np.ndarray, damp: np.ndarray, k1: float = 1.2) -> np.ndarray:
    return tf * (k1 + 1) / (tf + damp)


def saturation(tf: np.ndarray, size: np.ndarray, mean: float, k1: float = 1.2, b: float = 0.75) -> np.ndarray:
    return damped(tf, damping(size, mean, k1, b), k1)


def common(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each of the equal ones of two ascending lists of different hashes is in both: sorting them together takes a
    fraction of the time of a search for each."""
    both = np.concatenate((left << np.uint64(1), right << np.uint64(1) | np.uint64(1)))
    both.sort(kind="stable")
    met = np.flatnonzero(both[1:] ^ both[:-1] == 1)
    here = np.cumsum(both & np.uint64(1), dtype=np.int64)[met]
    return met - here, here


def strongest(df: np.ndarray, count: np.ndarray, text: np.ndarray, tf: np.ndarray, size: np.ndarray, texts: int, mean: float, most: int, share: float) -> tuple[np.ndarray, np.ndarray]:
    """The words, by text, that each text asks with, and where each text's begin.

    They are the words that add most to its own score, up to ``most``, and no more than make up ``share`` of it.
    Words of one text only find nothing and are left out; equal ones go by their hash.
    """
    term = np.repeat(np.arange(len(df)), count)
    found = np.flatnonzero(df[term] > 1)
    whose = text[found]
    weight = idf(texts, df)[term[found]] * damped(tf[found], damping(size, mean)[whose])
    total = np.bincount(whose, weights=weight, minlength=len(size))
    level = (weight * (_LEVELS - 1) / weight.max(initial=1e-9)).astype(np.int64)
    least = _level_of(whose, level, _LEVELS, np.full(len(size), most))
    found, weight = (x[level >= least[whose]] for x in (found, weight))
    order = np.lexsort((-weight, text[found]))
    whose, weight = text[found][order], weight[order]
    begin = np.searchsorted(whose, whose)
    before = np.concatenate(([0.0], np.cumsum(weight)))
    before = before[:-1] - before[begin]
    kept = (np.arange(len(order)) - begin < most) & (before < share * total[whose] - 1e-6)
    return term[found[order[kept]]], np.searchsorted(whose[kept], np.arange(len(size) + 1))


def _level_of(own: np.ndarray, level: np.ndarray, levels: int, most: np.ndarray) -> np.ndarray:
    """The highest level from which up each ``i`` owns ``most[i]``, 0 if it has fewer."""
    above = np.bincount(own * levels + level, minlength=len(most) * levels).reshape(len(most), levels)[:, ::-1].cumsum(axis=1)
    return np.maximum(0, levels - 1 - (above < most[:, None]).sum(axis=1))


class Shard:
    """The postings of an index shard, of its unused texts only."""

    def __init__(self, terms: np.ndarray, count: np.ndarray, text: np.ndarray, tf: np.ndarray, size: np.ndarray, used: np.ndarray, mean: float):
        self.left = np.flatnonzero(~used)
        self.n, self.terms, self.ends, self.count = len(self.left), terms, np.cumsum(count), count
        self.text, self.tf, self.damp, self.used = text, tf, damping(size, mean), used
        self.number = np.cumsum(~used) - 1

    def scores(self, words: np.ndarray, weight: np.ndarray, who: np.ndarray, bound: np.ndarray, most: np.ndarray, least: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(seed, number among the unused, score) of every pair above 0 that may be among its seed's best.

        ``words`` are the ascending hashes of all queries and ``weight`` their IDF; the seeds that ask with word ``i``
        are ``who[bound[i]:bound[i + 1]]``, ascending.  A seed wants ``most`` texts of at least the score ``least``.
        """
        yield from self.meet(words, weight, *by_seed(who, bound), most, least)

    def meet(self, words: np.ndarray, weight: np.ndarray, who: np.ndarray, what: np.ndarray, most: np.ndarray, least: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """``scores`` with the seed and the place of the word of each question, ordered by both."""
        at, here = common(self.terms, words)
        count = self.count[at]
        each = _ranges(self.ends[at] - count, count)
        own = np.repeat(np.arange(len(here)), count)
        free = ~self.used[self.text[each]]
        each, own = each[free], own[free]
        text = self.text[each]
        value = weight[here[own]] * damped(self.tf[each].astype(np.int64), self.damp[text])
        doc = self.number[text]
        size = np.bincount(own, minlength=len(here))
        first = np.cumsum(size) - size
        column = np.full(len(here), -1)
        dense = np.flatnonzero(size * _DENSE > self.n)
        column[dense] = np.arange(len(dense))
        table = np.zeros((len(dense), self.n))
        many = column[own] >= 0
        table[column[own[many]], doc[many]] = value[many]

        place = np.full(len(words), -1)
        place[here[size > 0]] = np.flatnonzero(size > 0)
        term = place[what]
        asked = term >= 0
        seed, term = who[asked], term[asked]
        new = np.append(True, seed[1:] != seed[:-1])[: len(seed)]
        seeds, seed = seed[new], np.cumsum(new) - 1
        hits = np.bincount(seed, weights=size[term], minlength=len(seeds))
        full = hits * 8 > self.n
        full[seed[column[term] >= 0]] = True
        yield from self._few(seeds, seed[~full[seed]], term[~full[seed]], first, size, doc, value)
        yield from self._many(seeds, seed[full[seed]], term[full[seed]], first, size, doc, value, column, table, most, least)

    def _few(self, seeds, seed, term, first, size, doc, value) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Scores of seeds with few postings, by sorting these."""
        done = np.cumsum(size[term])
        lo = 0
        while lo < len(seed):
            hi = int(np.searchsorted(done, (done[lo - 1] if lo else 0) + _CELLS, "right"))
            hi = int(np.searchsorted(seed, seed[max(lo, hi - 1)], "right"))
            t = term[lo:hi]
            each = _ranges(first[t], size[t])
            cell = np.repeat(seed[lo:hi], size[t]) * self.n + doc[each]
            bits = len(cell).bit_length()
            cell = np.sort(cell << bits | np.arange(len(cell)))
            order = cell & (1 << bits) - 1
            cell >>= bits
            new = np.append(True, cell[1:] != cell[:-1])
            score = np.bincount(np.cumsum(new) - 1, weights=value[each][order])
            cell = cell[new]
            row = cell // self.n
            yield seeds[row], cell - row * self.n, score
            lo = hi

    def _many(self, seeds, seed, term, first, size, doc, value, column, table, most, least) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Scores of the others, in a cell for each text; those below ``least``, or below as many texts as a seed without
        one wants, are left out."""
        name, seed = np.unique(seed, return_inverse=True)
        seeds = seeds[name]
        bound = np.searchsorted(seed, np.arange(len(seeds) + 1))
        step = max(1, _CELLS // max(1, self.n))
        for lo in range(0, len(seeds), step):
            hi = min(len(seeds), lo + step)
            t, s = term[bound[lo] : bound[hi]], seed[bound[lo] : bound[hi]] - lo
            in_table = column[t] >= 0
            few, whose = t[~in_table], s[~in_table]
            cell = np.repeat(whose, size[few]) * self.n + doc[each := _ranges(first[few], size[few])]
            score = np.bincount(cell, weights=value[each], minlength=(hi - lo) * self.n).astype(np.float64, copy=False).reshape(hi - lo, self.n)
            rows, columns = s[in_table], column[t[in_table]]
            place = np.arange(len(rows)) - np.searchsorted(rows, rows)
            for k in range(int(place.max(initial=-1)) + 1):
                score[rows[place == k]] += table[columns[place == k]]
            wanted = int(most[seeds[lo:hi]].max())
            floor = least[seeds[lo:hi]]
            bare = np.flatnonzero(floor == 0)
            if wanted < self.n and len(bare):
                floor[bare] = np.partition(score[bare], self.n - wanted, axis=1)[:, self.n - wanted]
            row, cell = np.nonzero(score >= np.maximum(floor - 1e-5, _TINY)[:, None])
            yield seeds[lo + row], cell, score[row, cell]


def by_seed(who: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The seed and the word of each question, ordered by both, from the seeds of each word."""
    order = np.argsort(who, kind="stable")
    return who[order], np.repeat(np.arange(len(bound) - 1), np.diff(bound))[order]


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers ``first[i], ..., first[i] + size[i] - 1`` for every ``i``."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - ends + size, size)


def best(seed: np.ndarray, doc: np.ndarray, score: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``most[i]`` best texts of each seed ``i``, best first."""
    if len(seed):
        here = np.zeros(len(most), dtype=bool)
        here[seed] = True
        own, top = (np.cumsum(here) - 1)[seed], np.zeros(int(here.sum()))
        np.maximum.at(top, own, score)
        level = (score * (_STEPS - 1) / top[own]).astype(np.int64)
        near = level >= _level_of(own, level, _STEPS, most[here])[own]
        seed, doc, score = seed[near], doc[near], score[near]
    tie = mix(doc.astype(np.uint64) ^ mix(seed.astype(np.uint64) + np.uint64(1)))
    order = np.lexsort((tie, -score, seed))
    seed, doc, score = seed[order], doc[order], score[order]
    rank = np.arange(len(seed)) - np.searchsorted(seed, seed)
    keep = rank < most[seed]
    return seed[keep], doc[keep], score[keep]


class Chains:
    """Windows that grow side by side; ``seeds`` are those that want neighbours, ``take`` gives them theirs."""

    def __init__(self, tokens: np.ndarray, length: int):
        self.tokens, self.length = tokens, length
        self.used = np.zeros(len(tokens), dtype=bool)
        self.following = self.at = 0
        windows = -(-int(tokens.sum()) // length)
        self.open: list[dict] = []
        self.out = [array("q") for _ in range(5)]
        for _ in range(min(_CHAINS, max(1, windows // _ROUNDS), len(tokens))):
            own = {"window": [], "room": length, "seed": None, "most": _NEAR}
            self.open.append(own)
            self._place(own, self._next(), 0)

    def _next(self) -> int | None:
        while self.following < len(self.used) and self.used[self.following]:
            self.following += 1
        return self.following if self.following < len(self.used) else None

    def _close(self, own: dict) -> None:
        for sequence in powers(own["window"], self.length):
            place = 0
            for text, start, size in sequence:
                for column, x in zip(self.out, (text, start, size, self.at, place), strict=True):
                    column.append(x)
                place += size
            self.at += 1
        own["window"], own["room"], own["seed"], own["most"] = [], self.length, None, _NEAR

    def _place(self, own: dict, text: int, start: int) -> bool:
        """Put a text into a window; whether that closed a window."""
        self.used[text] = True
        total, closed = int(self.tokens[text]), False
        while start < total:
            if own["seed"] is None:
                own["seed"] = text
            size = min(own["room"], total - start)
            own["window"].append((text, start, size))
            own["room"] -= size
            start += size
            if not own["room"]:
                self._close(own)
                closed = True
        return closed

    def seeds(self) -> tuple[np.ndarray, np.ndarray]:
        """The seed of each chain that has one and how long its list shall be; none when all texts are used.

        A chain whose window closed at the end of a text opens the next one with an unused text.
        """
        for own in self.open:
            while own["seed"] is None and (text := self._next()) is not None:
                self._place(own, text, 0)
        asked = [own for own in self.open if own["seed"] is not None and self._next() is not None]
        return tuple(np.array([own[x] for own in asked], dtype=np.int64) for x in ("seed", "most"))

    def take(self, near: list[np.ndarray]) -> None:
        """``near``: the best unused texts of each seed as of the round's begin, best first."""
        asked = [own for own in self.open if own["seed"] is not None]
        for own, texts in zip(asked, near, strict=True):
            closed, cut = False, len(texts) >= own["most"]
            for text in texts.tolist():
                if closed:
                    break
                if not self.used[text]:
                    closed = self._place(own, text, 0)
            while not closed and not cut and (text := self._next()) is not None:
                closed = self._place(own, text, 0)
            if not closed:
                own["most"] = min(_MOST, 2 * own["most"])

    def end(self) -> None:
        last = {"window": [], "room": self.length}
        for text, start, size in (piece for own in self.open for piece in own["window"]):
            while size:
                take = min(size, last["room"])
                last["window"].append((text, start, take))
                last["room"] -= take
                start, size = start + take, size - take
                if not last["room"]:
                    self._close(last)
        if last["window"]:
            self._close(last)


def id_kind(tok, end_id: int) -> np.dtype:
    """The type that staged ids have."""
    return np.dtype("<u4") if end_id > np.iinfo(tok.kind).max else tok.kind


def pack(
    docs: DataFrame,
    *,
    key: str = "doc_id",
    text: str = "text",
    vocabulary: str = "word_bpe_49k.json",
    end_id: int = 2,
    length: int = 4096,
    query_words: int = 16,
    query_share: float = 0.5,
    shard_bytes: int = 6 << 20,
    with_ids: bool = False,
) -> DataFrame:
    """One row for each piece of a text: where it stands, and with ``with_ids`` its ids (unsigned 32 bits)."""
    spark = docs.sparkSession
    small_batches(spark)
    kind = docs.schema[key].dataType
    fields = [T.StructField(key, kind), T.StructField("start", T.LongType()), T.StructField("length", T.LongType())]
    fields += [T.StructField(n, T.LongType()) for n in ("ids_crc32", "doc_tokens", "sequence_id", "offset")]
    schema = T.StructType(fields + [T.StructField("ids", T.BinaryType())] * with_ids)

    blobs = ("tokens", "lengths", "terms", "count", "text", "tf")
    rows = T.StructType([T.StructField("d", T.LongType()), T.StructField("k", kind), T.StructField("ids", T.BinaryType()), T.StructField("shard", T.LongType()), T.StructField("n", T.IntegerType())])
    rows = T.StructType([*rows.fields, *(T.StructField(n, T.BinaryType()) for n in blobs), T.StructField("kind", T.StringType())])

    def cut(keys: list, texts: list[str], first: int) -> Iterator[pa.RecordBatch]:
        """A row for each text, and one for the shard."""
        tok, out = tokenizer(vocabulary), arrow_schema(rows)
        end = np.array([end_id], dtype="<u4")
        ids = [np.concatenate((x, end)).astype(id_kind(tok, end_id)) for x in tok.ids(texts)]
        n = len(keys)
        for lo in range(0, n, 500):
            own = range(lo, min(n, lo + 500))
            columns = [[first + i for i in own], [keys[i] for i in own], [ids[i].tobytes() for i in own]]
            columns += [[None] * len(own)] * (2 + len(blobs)) + [["text"] * len(own)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, out, strict=True)], schema=out)
        terms, count, at, tf, size = postings([t.encode("utf-8", "surrogatepass") for t in texts])
        made = [narrow(np.array([len(x) for x in ids])), narrow(size), packed(terms), narrow(count), narrow(at), slim(tf)]
        columns = [[None], [None], [None], [first], [len(terms)], *([x] for x in made), ["shard"]]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, out, strict=True)], schema=out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 40
        keys: list = []
        texts: list[str] = []
        held = 0
        for batch in batches:
            for k, t in zip(batch.column("k").to_pylist(), batch.column("t").to_pylist(), strict=True):
                if texts and (held + len(t or "") > shard_bytes or len(texts) == 1 << ORDINAL):
                    yield from cut(keys, texts, first)
                    first += len(keys)
                    keys, texts, held = [], [], 0
                keys.append(k)
                texts.append(t or "")
                held += len(t or "")
        if texts:
            yield from cut(keys, texts, first)
        forget()

    cuts = stage(map_batches(docs.select(F.col(key).alias("k"), F.col(text).alias("t")), run, rows), "packing-texts", by="kind")
    whole = cuts.where("kind = 'text'").select("d", "k", "ids")
    index = cuts.where("kind = 'shard'").select("shard", "n", *blobs)

    found = sorted((r["shard"], bytes(r["tokens"]), r["words"]) for r in _sized(index).collect())
    starts = np.array([r[0] for r in found], dtype=np.int64)
    parts = [widen(r[1]).astype(np.int32) for r in found]
    offset = np.concatenate(([0], np.cumsum([len(x) for x in parts], dtype=np.int64)))
    tokens = np.concatenate(parts) if parts else np.empty(0, np.int32)
    words = sum(r[2] for r in found)
    n, mean = len(tokens), max(1.0, words / max(1, len(tokens)))
    queries = stage(_queries(index, 8 * words, n, mean, query_words, query_share).coalesce(max(2, len(starts) // 16)), "packing-queries")

    chains, flushed = Chains(tokens, length), []

    def named(numbers) -> np.ndarray:
        numbers = np.asarray(numbers, dtype=np.int64)
        at = np.searchsorted(offset, numbers, "right") - 1
        return starts[at] + numbers - offset[at]

    def numbered(names: np.ndarray) -> np.ndarray:
        at = np.searchsorted(starts, names, "right") - 1
        return offset[at] + names - starts[at]

    def flush() -> None:
        columns = [np.frombuffer(x, dtype=np.int64) for x in chains.out]
        names = ("d", "start", "length", "sequence_id", "offset")
        columns[0] = named(columns[0]) if len(columns[0]) else columns[0]
        made = spark.createDataFrame(pa.table({k: pa.array(c, pa.int64()) for k, c in zip(names, columns, strict=True)}))
        flushed.append((len(columns[0]), stage(made, "packing-pieces")))
        chains.out = [array("q") for _ in chains.out]

    while len((asked := chains.seeds())[0]):
        chains.take([numbered(x) for x in _search(index, queries, named(asked[0]), asked[1], chains.used, starts, offset, mean)])
        if len(chains.out[0]) >= _FLUSH:
            flush()
    chains.end()
    flush()

    staged = id_kind(tokenizer(vocabulary), end_id).str

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = arrow_schema(schema)
        for batch in batches:
            own, ids = batch.column("own"), [np.frombuffer(x, staged).astype("<u4") for x in batch.column("ids").to_pylist()]
            count = own.value_lengths().to_numpy()
            start, size, sequence, offset = (c.to_numpy(zero_copy_only=False) for c in own.flatten().flatten())
            whose = np.repeat(np.arange(len(ids)), count)
            cut = [ids[i][a : a + n] for i, a, n in zip(whose.tolist(), start.tolist(), size.tolist(), strict=True)]
            total = np.array([len(x) for x in ids], dtype=np.int64)[whose]
            columns = [batch.column("k").take(pa.array(whose)), start, size, [zlib.crc32(x) for x in cut], total, sequence, offset]
            if with_ids:
                columns.append([x.tobytes() for x in cut])
            arrays = [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, out, strict=True)]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(arrays, out, strict=True)], schema=out)

    grouped = reduce(DataFrame.union, [f for _, f in flushed]).groupBy("d").agg(F.collect_list(F.struct("start", "length", "sequence_id", "offset")).alias("own"))
    if sum(m for m, _ in flushed) * 64 <= _BROADCAST:
        grouped = F.broadcast(grouped)
    return map_batches(whole.join(grouped, "d").select("k", "ids", "own"), pieces, schema)


def _sized(shards: DataFrame) -> DataFrame:
    """Each shard's token counts and number of words."""
    schema = T.StructType([T.StructField("shard", T.LongType()), T.StructField("tokens", T.BinaryType()), T.StructField("words", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [int(widen(x).sum()) for x in batch.column("lengths").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("shard"), batch.column("tokens").cast(pa.binary()), pa.array(words, pa.int64())], schema=arrow_schema(schema))

    return map_batches(shards.select("shard", "tokens", "lengths"), run, schema)


def _queries(index: DataFrame, size: int, texts: int, mean: float, most: int, share: float) -> DataFrame:
    """(shard, offset, words, df): the strongest words of each text with their document frequencies.

    Words are counted by ranges of their hashes: a shard sends a range its words and how many texts have each, and
    gets their sums over all shards.
    """
    ranges = ranges_for(size)
    part = T.StructType([T.StructField("range", T.IntegerType()), T.StructField("shard", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("terms", T.BinaryType()), T.StructField("count", T.BinaryType())])
    sums = T.StructType([T.StructField("shard", T.LongType()), T.StructField("range", T.IntegerType()), T.StructField("df", T.BinaryType())])
    made = T.StructType([T.StructField("shard", T.LongType()), *(T.StructField(x, T.BinaryType()) for x in ("offset", "words", "df"))])
    edge = np.array([-(-(r << BITS) // ranges) for r in range(1, ranges)], dtype=np.uint64)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, n, terms, count in zip(*(batch.column(c).to_pylist() for c in ("shard", "n", "terms", "count")), strict=True):
                terms, count = unpack(terms, n), widen(count)
                bound = np.concatenate(([0], np.searchsorted(terms, edge), [n]))
                rows = [(r, shard, int(b - a), packed(terms[a:b]), narrow(count[a:b])) for r, (a, b) in enumerate(zip(bound[:-1], bound[1:], strict=True)) if b > a]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow_schema(part), strict=True)], schema=arrow_schema(part))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(held: list[tuple]) -> pa.RecordBatch:
            terms = np.concatenate([unpack(x[3], x[2]) for x in held])
            _, name = np.unique(terms, return_inverse=True)
            df = np.bincount(name, weights=np.concatenate([widen(x[4]) for x in held])).astype(np.int64)[name]
            ends = np.cumsum([x[2] for x in held])
            rows = [(x[1], x[0], narrow(df[b - x[2] : b])) for x, b in zip(held, ends.tolist(), strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow_schema(sums), strict=True)], schema=arrow_schema(sums))

        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and held[-1][0] != row[0]:
                    yield close(held)
                    held = []
                held.append(row)
        if held:
            yield close(held)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                df = np.concatenate([widen(x["df"]) for x in sorted(row["sums"], key=lambda x: x["range"])])
                term, offset = strongest(df, widen(row["count"]), widen(row["text"]), slimmed(row["tf"]).astype(np.int64), widen(row["lengths"]), texts, mean, most, share)
                terms = unpack(row["terms"], row["n"])
                arrays = [[row["shard"]], [narrow(offset)], [terms[term].tobytes()], [narrow(df[term])]]
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(arrays, arrow_schema(made), strict=True)], schema=arrow_schema(made))

    dealt = map_batches(index.select("shard", "n", "terms", "count"), send, part).repartition("range").sortWithinPartitions("range")
    own = map_batches(dealt, add, sums).groupBy("shard").agg(F.collect_list(F.struct("range", "df")).alias("sums"))
    return map_batches(index.select("shard", "n", "lengths", "terms", "count", "text", "tf").join(own, "shard"), choose, made)


def _search(index: DataFrame, queries: DataFrame, seeds: np.ndarray, most: np.ndarray, used: np.ndarray, starts: np.ndarray, offset: np.ndarray, mean: float) -> list[np.ndarray]:
    """The ``most`` unused texts of the whole corpus that are nearest to each seed, best first."""
    context, n = index.sparkSession.sparkContext, len(used)
    wanted = context.broadcast(np.unique(seeds))
    told = T.StructType([T.StructField("d", T.LongType()), T.StructField("words", T.BinaryType()), T.StructField("df", T.BinaryType())])
    size_of = dict(zip(starts.tolist(), np.diff(offset).tolist(), strict=True))
    first_of = dict(zip(starts.tolist(), offset[:-1].tolist(), strict=True))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, at, words, df in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                a, b = np.searchsorted(wanted.value, [shard, shard + size_of[shard]])
                if a == b:
                    continue
                own, at, words, df = wanted.value[a:b], widen(at), np.frombuffer(words, "<u8"), widen(df)
                rows = [(d, words[at[d - shard] : at[d - shard + 1]].tobytes(), df[at[d - shard] : at[d - shard + 1]].tobytes()) for d in own.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow_schema(told), strict=True)], schema=arrow_schema(told))

    got = {r["d"]: (bytes(r["words"]), bytes(r["df"])) for r in map_batches(queries.select("shard", "offset", "words", "df"), ask, told).collect()}
    query = [np.frombuffer(got.get(int(s), (b"", b""))[0], "<u8") for s in seeds]
    df = [np.frombuffer(got.get(int(s), (b"", b""))[1], "<i8") for s in seeds]
    ends = np.concatenate(([0], np.cumsum([len(q) for q in query])))
    names, at, word = np.unique(np.concatenate(query), return_index=True, return_inverse=True)
    weight = idf(n, np.concatenate(df)[at])
    order = np.argsort(word, kind="stable")
    who = (np.searchsorted(ends, order, "right") - 1).astype(np.int32)
    bound = np.searchsorted(word[order], np.arange(len(names) + 1))
    asked = context.broadcast((names, weight, who, bound, np.packbits(used)))
    listed = T.StructType([T.StructField("group", T.IntegerType()), *(T.StructField(x, T.BinaryType()) for x in ("seed", "d", "score"))])
    kinds = ("<i4", "<i8", "<f8")
    kept_as = {"count": widen, "text": thin, "tf": slimmed, "lengths": widen}

    def row(group: int, own: tuple) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([group], pa.int32()), *(pa.array([x.astype(k).tobytes()], pa.binary()) for x, k in zip(own, kinds, strict=True))], schema=arrow_schema(listed))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, weight, who, bound, flags = asked.value
        flags = np.unpackbits(flags)
        who, what = by_seed(who, bound)
        least, own = np.zeros(len(most)), (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        parts = [own]

        def keep() -> tuple:
            own = best(*(np.concatenate(c) for c in zip(*parts, strict=True)), most)
            full = np.bincount(own[0], minlength=len(least)) == most
            last = np.searchsorted(own[0], np.arange(len(least)), "right") - 1
            least[:] = np.where(full, own[2][last] if len(own[2]) else 0.0, 0.0)
            return own

        for batch in batches:
            for row_ in batch.to_pylist():
                at = first_of[row_["shard"]]
                taken = flags[at : at + size_of[row_["shard"]]].astype(bool)
                if taken.all() or not row_["n"] or not len(names):
                    continue
                shard = Shard(unpack(row_["terms"], row_["n"]), *(read(row_[c]) for c, read in kept_as.items()), taken, mean)
                for s, d, score in shard.meet(names, weight, who, what, most, least):
                    score = np.round(score, 6)
                    kept = (score >= least[s]) & (score > 0)
                    parts.append((s[kept], shard.left[d[kept]] + row_["shard"], score[kept]))
                if not least.any() or sum(len(x[0]) for x in parts) > _HELD:
                    parts = [keep()]
        own = keep()
        for group in range(_GROUPS):
            some = own[0] % _GROUPS == group
            if some.any():
                yield row(group, tuple(x[some] for x in own))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, list[tuple]] = {}
        held, limit = 0, _HELD

        def keep(parts: list[tuple]) -> tuple:
            return best(*(np.concatenate(c) for c in zip(*parts, strict=True)), most) if len(parts) > 1 else parts[0]

        for batch in batches:
            for group, *blobs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own.setdefault(group, []).append(tuple(np.frombuffer(x, k) for x, k in zip(blobs, kinds, strict=True)))
                held += len(own[group][-1][0])
                if held > limit:
                    own = {g: [keep(parts)] for g, parts in own.items()}
                    held = sum(len(x[0]) for (x,) in own.values())
                    limit = max(_HELD, 2 * held)
        for group, parts in own.items():
            yield row(group, keep(parts))

    lists = map_batches(map_batches(index.select("shard", "n", "terms", "count", "text", "tf", "lengths"), search, listed).repartition("group"), merge, listed).collect()
    seed, doc, score = (np.concatenate([np.empty(0, k), *(np.frombuffer(r[c], k) for r in lists)]) for c, k in zip(("seed", "d", "score"), kinds, strict=True))
    seed, doc, _ = best(seed, doc, score, most)
    wanted.destroy()
    asked.destroy()
    cuts = np.searchsorted(seed, np.arange(len(seeds) + 1))
    return [doc[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
