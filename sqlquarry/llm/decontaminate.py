"""Benchmark decontamination with an FM-index for each training shard.

Training texts are taken as sequences of words.  A shard is a run of whole texts of a bounded size; its index holds all
its words: the Burrows-Wheeler transform of their numbers in a wavelet matrix, with sampled suffix positions.  Texts
are parted by a number that no phrase has.  Test phrases (windows of ``window`` consecutive words of a benchmark item,
or the whole item if it is shorter) are found by backward search with wavelet ranks, all phrases at once; their places
come from sampled suffix positions by walking the last-to-first mapping.  Places found in a text are merged to removal
spans.

Texts are never moved: each task indexes the shards of its own partition, one after the other, and searches an index
for all phrases before it builds the next one.  Phrases come in blocks of about ``block_bytes`` of benchmark text (an
item is never cut); a task holds one block at a time, and so does the driver.  Words are compared by 64-bit hashes.

Defined results: null and empty texts and items have no words, so no spans; repeated item ids count once;
repeated rows are kept; the hits of an item whose id is null count, and so does the item, but it has no name among
the ids.  Columns with clashing names are kept, ours get a leading underscore.
"""

from __future__ import annotations

import contextlib
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import append, arrow_schema, chunks, fresh, map_batches, small_batches, utf8, with_fields
from ._text import Words, words

_SAMPLE = 8
#: A function over Arrow batches and the schema of what it gives.
Pass = tuple[Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], T.StructType]


def suffix_array(text: np.ndarray) -> np.ndarray:
    """The order of all suffixes of a sequence of integers from 0, whose last one is found nowhere else.

    Suffixes are sorted by as many symbols as fit 63 bits; those that are still equal by their ranks further on, in
    doubling steps.
    """
    n = len(text)
    bits = max(1, int(text.max()).bit_length())
    step = max(1, 63 // bits)
    key = np.zeros(n, np.int64)
    for k in range(min(step, n)):
        key[: n - k] |= text[k:] << (bits * (step - 1 - k))
    order = np.argsort(key, kind="stable")
    rank = np.empty(n, np.int64)
    first = np.append(True, np.diff(key[order]) != 0)
    begin = np.flatnonzero(first)
    rank[order] = np.repeat(begin, np.diff(np.append(begin, n)))
    while len(begin) < n:
        first = np.append(first, True)
        slots = np.flatnonzero(~(first[:-1] & first[1:]))  # places in the order that are not settled
        own = order[slots]
        key = rank[own] * (n + 1)
        further = own + step < n
        key[further] += rank[own[further] + step] + 1
        by = np.argsort(key, kind="stable")
        own, key = own[by], key[by]
        order[slots] = own
        new = np.append(True, np.diff(key) != 0)
        rank[own] = slots[np.maximum.accumulate(np.where(new, np.arange(len(own)), 0))]
        first = first[:-1]
        first[slots] = new
        begin = np.flatnonzero(first)
        step *= 2
    return order


class WaveletMatrix:
    """Ranks of symbols in a sequence of small integers."""

    def __init__(self, text: np.ndarray, bits: int):
        self.levels, self.zeros = [], []
        for level in range(bits - 1, -1, -1):
            one = (text >> level) & 1
            self.levels.append(np.concatenate(([0], np.cumsum(one, dtype=np.int32))).astype(np.int32))
            self.zeros.append(len(text) - int(self.levels[-1][-1]))
            text = np.concatenate((text[one == 0], text[one == 1]))
        self.bits = bits

    def rank(self, symbol: np.ndarray, end: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        start = np.zeros_like(end)
        for level, zeros, ones in zip(range(self.bits - 1, -1, -1), self.zeros, self.levels, strict=True):
            one = ((symbol >> level) & 1).astype(bool)
            start = np.where(one, zeros + ones[start], start - ones[start])
            end = np.where(one, zeros + ones[end], end - ones[end])
        return end - start

    def access(self, at: np.ndarray) -> np.ndarray:
        """The symbol at each place."""
        out = np.zeros_like(at)
        for zeros, ones in zip(self.zeros, self.levels, strict=True):
            one = ones[at + 1] - ones[at]
            out = (out << 1) | one
            at = np.where(one == 1, zeros + ones[at], at - ones[at])
        return out


class FMIndex:
    """An FM-index of a sequence of integers from 1 to ``most``."""

    def __init__(self, text: np.ndarray, most: int, sample: int = _SAMPLE):
        text = np.append(text, 0)
        order = suffix_array(text)
        bwt = text[order - 1]
        self.n = len(text)
        self.wavelet = WaveletMatrix(bwt, max(1, int(most).bit_length()))
        self.before = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=most + 1))))
        kept = order % sample == 0
        self.kept = kept
        self.kept_rank = np.concatenate(([0], np.cumsum(kept)))
        self.kept_place = order[kept]

    def search(self, phrases: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ranges of suffixes that begin with each phrase (rows of ``phrases``, padded at the left)."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        width = phrases.shape[1]
        live = np.arange(len(phrases))
        for k in range(width - 1, -1, -1):
            live = live[(hi[live] > lo[live]) & (length[live] > width - 1 - k)]
            if not len(live):
                break
            c = phrases[live, k]
            lo[live] = self.before[c] + self.wavelet.rank(c, lo[live])
            hi[live] = self.before[c] + self.wavelet.rank(c, hi[live])
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Where the suffixes of these rows begin."""
        place, steps = np.full(len(rows), -1, np.int64), np.zeros(len(rows), np.int64)
        todo, rows = np.arange(len(rows)), rows.copy()
        while len(todo):
            done = self.kept[rows[todo]]
            at = todo[done]
            place[at] = self.kept_place[self.kept_rank[rows[at]]] + steps[at]
            todo = todo[~done]
            c = self.wavelet.access(rows[todo])
            rows[todo] = self.before[c] + self.wavelet.rank(c, rows[todo])
            steps[todo] += 1
        return place


class Shard:
    """An FM-index of all words of some texts."""

    def __init__(self, texts: list[bytes | None]):
        w = Words(texts)
        self.n, self.count = len(texts), np.diff(w.offset)
        self.words, number = np.unique(w.hash, return_inverse=True)
        self.base = w.offset[:-1] + np.arange(self.n)  # one parting number, 1, behind each text
        sequence = np.ones(len(number) + self.n, dtype=np.int64)
        sequence[np.arange(len(number)) + np.repeat(np.arange(self.n), self.count)] = number + 2
        self.index = FMIndex(sequence, len(self.words) + 1)

    def places(self, phrases: "Phrases") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All occurrences: number of the phrase, of the text, and of the word that it begins with."""
        none = np.empty(0, np.int64)
        if not len(self.words) or not len(phrases.length):
            return none, none, none
        at = np.minimum(np.searchsorted(self.words, phrases.words), len(self.words) - 1)
        number = np.append(np.where(self.words[at] == phrases.words, at + 2, 0), 0)
        own = number[phrases.ids]
        known = np.flatnonzero(((own > 0) | (phrases.ids == len(phrases.words))).all(axis=1))
        lo, hi = self.index.search(own[known], phrases.length[known])
        which = np.repeat(np.arange(len(lo)), hi - lo)
        rows = np.arange(len(which)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + lo[which]
        place = self.index.locate(rows)
        text = np.searchsorted(self.base, place, "right") - 1
        return known[which], text, place - self.base[text]


class Phrases:
    """The windows of a block of benchmark items, as rows of numbers of ``words``, padded at the left by their count."""

    def __init__(self, items: list[tuple[str | None, bytes | None]], window: int):
        w = Words([text for _, text in items])
        self.words, number = np.unique(w.hash, return_inverse=True)
        owners: dict[tuple[int, ...], set[str | None]] = {}
        for (name, _), a, b in zip(items, w.offset[:-1].tolist(), w.offset[1:].tolist(), strict=True):
            own = number[a:b].tolist()
            for i in range(max(1, len(own) - window + 1) if own else 0):
                owners.setdefault(tuple(own[i : i + window]), set()).add(name)
        self.length = np.array([len(k) for k in owners], dtype=np.int64)
        self.ids = np.array([[len(self.words)] * (window - len(k)) + list(k) for k in owners], dtype=np.int64).reshape(len(owners), window)
        self.owners = [tuple(names) for names in owners.values()]

    def find(self, shard: Shard) -> list[tuple[list[tuple[int, int]], set[str | None]]]:
        """For each text of a shard the merged word ranges of all occurrences and the items that they are of."""
        out: list[tuple[list[tuple[int, int]], set[str | None]]] = [([], set()) for _ in range(shard.n)]
        phrase, text, word = shard.places(self)
        if not len(phrase):
            return out
        for pair in np.unique(text * len(self.length) + phrase).tolist():
            out[pair // len(self.length)][1].update(self.owners[pair % len(self.length)])
        order = np.lexsort((word, text))
        text, start, end = text[order], word[order], (word + self.length[phrase])[order]
        for a, b in zip(begin := np.flatnonzero(np.append(True, text[1:] != text[:-1])), np.append(begin[1:], len(text)), strict=True):
            reach = np.maximum.accumulate(end[a:b])
            first = np.flatnonzero(np.append(True, start[a + 1 : b] > reach[:-1]))
            out[text[a]][0].extend(zip(start[a:b][first].tolist(), reach[np.append(first[1:], b - a) - 1].tolist(), strict=True))
        return out


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping and touching ranges as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def blocks(benchmark: DataFrame, *, item: str = "item_id", text: str = "text", window: int = 10, block_bytes: int = 8 << 20) -> Iterator[Phrases]:
    """The benchmark's phrases in blocks of about ``block_bytes`` of text, one after the other."""
    rows = benchmark.select(F.col(item).cast("string").alias("item"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    for b in range(n):
        own = rows if n == 1 else rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == b)
        yield Phrases([(r["item"], r["text"].encode()) for r in own.collect()], window)


def find(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    window: int = 10,
    block_bytes: int = 8 << 20,
    shard_bytes: int = 4 << 20,
    names: tuple[str, str] = ("word_spans", "items"),
    finish: Callable[[T.StructType, str, str], Pass] | None = None,
) -> DataFrame:
    """``docs`` with the merged word ranges of test phrases and the sorted ids of their items, a null one last.

    ``finish`` gives a last pass over the batches, which runs in the same worker.
    """
    small_batches(docs.sparkSession)
    spans_name, items_name = fresh(docs, *names)
    span = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
    schema = with_fields(docs.schema, T.StructField(spans_name, T.ArrayType(span)), T.StructField(items_name, T.ArrayType(T.StringType())))
    send = docs.sparkSession.sparkContext.broadcast
    sent = [send(block) for block in blocks(benchmark, item=item, text=item_text, window=window, block_bytes=block_bytes)]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = arrow_schema(schema)
        for batch in batches:
            texts = utf8(batch.column(text))
            spans, found = [], []
            for lo, hi in chunks([len(t or b"") for t in texts], shard_bytes):
                shard = Shard(texts[lo:hi])
                got = sent[0].value.find(shard)
                for block in sent[1:]:
                    for (was, names), (more, others) in zip(got, block.value.find(shard), strict=True):
                        was.extend(more)
                        names.update(others)
                    with contextlib.suppress(AttributeError):
                        del block._value  # the next block takes its place in memory
                spans += [[{"start": a, "end": b} for a, b in merged(s)] for s, _ in got]
                found += [sorted(i, key=lambda x: (x is None, x)) for _, i in got]
            yield append(batch, made, spans, found)

    if finish:
        last, result = finish(schema, spans_name, items_name)
        return map_batches(docs, lambda batches: last(search(batches)), result)
    return map_batches(docs, search, schema)


def digest(schema: T.StructType, spans: str, items: str, *, key: str = "doc_id", text: str = "text") -> Pass:
    """Words, hit words, items and their digest for each text; an item without an id counts, but isn't in the digest."""
    fields = [T.StructField(key, schema[key].dataType), *(T.StructField(n, T.LongType()) for n in ("n_words", "n_hit", "n_items"))]
    made = T.StructType([*fields, T.StructField("items_sha256", T.StringType()), T.StructField("contaminated", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = arrow_schema(made)
        for batch in batches:
            texts = utf8(batch.column(text))
            count = []
            for lo, hi in chunks([len(t or b"") for t in texts], 1 << 20):
                count += np.diff(Words(texts[lo:hi]).offset).tolist()
            hit = [sum(x["end"] - x["start"] for x in s) for s in batch.column(spans).to_pylist()]
            names = batch.column(items).to_pylist()
            arrays = [batch.column(key), pa.array(count, pa.int64()), pa.array(hit, pa.int64()), pa.array([len(x) for x in names], pa.int64())]
            arrays += [pa.array([hashlib.sha256(",".join(i for i in x if i is not None).encode()).hexdigest() for x in names], pa.string()), pa.array([h > 0 for h in hit])]
            yield pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(arrays, out, strict=True)], schema=out)

    return run, made


def cut(schema: T.StructType, spans: str, items: str, *, text: str = "text") -> Pass:
    """The input's columns with the spans cut from the texts; texts that keep no word go.

    A span is cut from its first word's first character to its last word's last one.  A text without spans is
    left as it is, and stays even if it has no word.
    """
    rest = [f.name for f in schema.fields if f.name not in (spans, items)]
    made = T.StructType([f for f in schema.fields if f.name in rest])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = arrow_schema(made)
        place = rest.index(text)
        for batch in batches:
            texts, own = utf8(batch.column(text)), batch.column(spans).to_pylist()
            keep = np.ones(len(texts), dtype=bool)
            for i, found_spans in enumerate(own):
                if found_spans:
                    w = Words([texts[i]])
                    kept, at = [], 0
                    for s in found_spans:
                        kept.append(texts[i][at : w.start[s["start"]]])
                        at = int(w.end[s["end"] - 1])
                    texts[i] = b"".join([*kept, texts[i][at:]])
                    keep[i] = bool(words(texts[i]))
            arrays = [c.cast(out.field(k).type) for k, c in enumerate(batch.select(rest).columns)]
            arrays[place] = pa.array(texts, pa.large_binary()).cast(out.field(place).type)
            whole = pa.RecordBatch.from_arrays(arrays, schema=out)
            yield whole if keep.all() else whole.filter(pa.array(keep))

    return run, made


def report(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The digest of every text, in one pass."""
    return find(docs, benchmark, finish=digest, **options)


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without test passages, in one pass; see ``cut``."""
    return find(docs, benchmark, finish=cut, **options)


#: The digest of ``documents`` against ``benchmark`` in windows of ten words.
ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents
), i AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), starts AS (
  SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS s FROM i WHERE len(w) > 0
), phrases AS (
  SELECT DISTINCT item_id, n, array_to_string(w[s : s + n - 1], ' ') AS p FROM starts
), sizes AS (
  SELECT DISTINCT n FROM phrases
), places AS (
  SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d CROSS JOIN sizes
), hits AS (
  SELECT doc_id, s, places.n, item_id FROM places
  JOIN phrases ON places.n = phrases.n AND array_to_string(w[s : s + places.n - 1], ' ') = p
), covered AS (
  SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS place FROM hits) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered ON d.doc_id = covered.doc_id LEFT JOIN named ON d.doc_id = named.doc_id
"""
