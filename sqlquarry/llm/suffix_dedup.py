"""Removal of repeated passages by suffix sorting.

A byte goes if it is covered by a string of ``length`` bytes that also starts earlier (in a text of a smaller
id, or earlier in the same text).  Strings are judged on the input.

1. Anchors.  In every window of ``length - GRAM + 1`` places the place with the least hash of its ``GRAM`` bytes
   (the first of several) is an anchor: two equal strings of ``length`` bytes have the same anchor at the same
   offset.  Anchors that occur twice come back to their texts (see ``_meet``).
2. Fragments.  A text with such anchors gives for each the bytes of all strings that it anchors.
3. Suffix sorting.  The suffixes that begin at the anchors of a block of fragments, and the reversed prefixes that
   end there, are sorted deep-shallow: by multikey quicksort to a shallow depth, then what is still equal by blind
   tries (see ``_suffixes``).  From the common prefix lengths of both orders follow, for each offset, which strings
   are equal; all but the first of them are repeats.  This happens twice: for the fragments of a task, and, of the
   strings that are the first of their task, for the fragments of all tasks that have one anchor.
4. The repeats of a text are merged to spans and cut.

How it stays bounded: the first sorting leaves one of a task's equal fragments, so a group of copies costs one for
each task.  An anchor that occurs more than ``HOT`` times (a line in many different contexts) goes string by string,
dealt by the whole string, so its strings need no common task.  Sorting takes blocks of ``BLOCK`` fragments, and at
most one anchor more.

Defined results: null and empty texts have no bytes; texts of fewer than ``length`` bytes lose none; of rows with
one id and one text the first counts as earlier; of those with one id and different texts the one with the lesser
digest; null ids count as larger than all others.  Ids must be integers.  Extra columns stay, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import arrow_schema, chunks, discard, map_batches, small_batches, stage, utf8
from ._meet import Shared, meet
from ._suffixes import Strings, deep_shallow
from ._text import mix

GRAM = 32
#: Fragments that are sorted at once, and the bytes of text they are cut from.
BLOCK, BLOCK_BYTES = 40_000, 16 << 20
#: An anchor that occurs more often is dealt by its whole strings.
HOT = 100_000
#: Symbols of eight bytes to which suffixes and reversed prefixes are sorted by multikey quicksort.
SHALLOW, SHALLOW_BACK = 8, 3
_LAST = np.iinfo(np.int64).max
_EMPTY = hashlib.sha256(b"").hexdigest()


# anchors


def anchors(texts: list[bytes], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each text its anchors: hash, place, and the first and last start of the strings that each anchors."""
    data = b"".join(texts) + b"\0" * 40
    n, width = len(data) - 40, length - GRAM + 1
    bound = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    word = np.ndarray(shape=(len(data) - 7,), dtype="<u8", buffer=data, strides=(1,))
    h = np.zeros(max(n, 0), np.uint64)
    for k in range(0, GRAM, 8):
        h = (h ^ word[k : k + n]) * np.uint64(0x9FB21C651E98DF25)
        h ^= h >> np.uint64(32)
    h = mix(h)
    starts = max(0, n - length + 1)
    if starts:
        key = ((h >> np.uint64(32)) << np.uint64(32)) | np.arange(n, dtype=np.uint64)
        rows = -(-n // width)
        padded = np.full(rows * width, np.iinfo(np.uint64).max, np.uint64)
        padded[:n] = key
        grid = padded.reshape(rows, width)
        ahead = np.minimum.accumulate(grid, axis=1).ravel()
        behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        anchor = (np.minimum(behind[:starts], ahead[width - 1 : width - 1 + starts]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    for a, b in zip(bound[:-1], bound[1:], strict=True):
        if b - a < length:
            yield (np.empty(0, np.uint64), *[np.empty(0, np.int64)] * 3)
            continue
        own = anchor[a : b - length + 1]
        first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        last = np.append(first[1:], len(own)) - 1
        place = own[first]
        yield mix(h[place]), place - a, first, last  # the least hashes are small numbers: spread again


def _batches(texts: list[bytes | None], length: int) -> Iterator[tuple[int, tuple]]:
    for lo, hi in chunks([len(t or b"") for t in texts], 1 << 20):
        for i, found in zip(range(lo, hi), anchors([t or b"" for t in texts[lo:hi]], length), strict=True):
            yield i, found


# suffix sorting


def repeated_offsets(data: bytes, anchor: np.ndarray, low: np.ndarray, high: np.ndarray, length: int) -> np.ndarray:
    """Which strings of fragments, given in order of their places, also start earlier.

    A fragment has its anchor at ``anchor`` of ``data`` and strings that begin ``low`` to ``high`` bytes before it.
    The result has a row for each fragment, a column for each offset.
    """
    n, width = len(anchor), length - GRAM + 1
    order, lcp = deep_shallow(Strings(data, anchor, length - low), SHALLOW)
    cut = np.cumsum(lcp < GRAM)
    group = np.empty(n, np.uint64)
    group[order] = cut
    b_order, b_lcp = deep_shallow(Strings(data[::-1], len(data) - anchor, high, group), SHALLOW_BACK)
    out = np.zeros((n, width), dtype=bool)
    f_class, b_class = np.empty(n, np.int64), np.empty(n, np.int64)
    several = (np.bincount(cut, minlength=1) > 1)[group.astype(np.int64)] if n else np.zeros(0, dtype=bool)
    for o in range(width):
        own = np.flatnonzero((low <= o) & (o <= high) & several)
        if len(own) < 2:
            continue
        f_class[order] = np.cumsum(lcp < length - o)
        b_class[b_order] = np.cumsum(b_lcp < 8 + o)
        both = f_class[own] * (n + 1) + b_class[own]
        ranked = np.argsort(both, kind="stable")
        sorted_both = both[ranked]
        out[own[ranked[1:][sorted_both[1:] == sorted_both[:-1]]], o] = True
    return out


def _ranges(found: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The runs of true values in the rows: row, first column, column after the last."""
    edge = np.diff(np.pad(found, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, begin = np.nonzero(edge == 1)
    return row, begin, np.nonzero(edge == -1)[1]


# tables


def _spans(pairs: np.ndarray) -> np.ndarray:
    """Overlapping and touching ranges (rows of start, end) as one."""
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    reach = np.maximum.accumulate(pairs[:, 1])
    first = np.flatnonzero(np.append(True, pairs[1:, 0] > reach[:-1]))
    return np.stack((pairs[first, 0], reach[np.append(first[1:], len(pairs)) - 1]), axis=1)


def _shared_anchors(rows: DataFrame, size: int, length: int) -> DataFrame:
    """(i, digest, hashes): for each text of ``rows`` (id, sha, text) that has any, its anchors that occur twice.

    They are 52 bits of the hash and one bit for those that occur often.
    """
    schema = T.StructType([T.StructField("i", T.LongType()), T.StructField("digest", T.StringType()), T.StructField("hashes", T.BinaryType())])

    def items(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, object]]:
        ids, digests = (batch.column(c).to_pylist() for c in ("id", "sha"))
        for i, (h, _, _, _) in _batches(utf8(batch.column("text")), length):
            yield h, (ids[i], digests[i])

    def finish(info: list, shared: list[Shared]) -> Iterator[pa.RecordBatch]:
        made = [(i, d, ((own << np.uint64(1)) | (count > HOT).astype(np.uint64)).tobytes()) for (i, d), (own, _, count) in zip(info, shared, strict=True) if len(own)]
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made, strict=True), arrow_schema(schema), strict=True)], schema=arrow_schema(schema))

    return meet(rows.select("id", "sha", "text"), items, finish, schema, size=size, occurrences=True)


_FRAGMENT = T.StructType(
    [T.StructField("h", T.LongType()), T.StructField("id", T.LongType()), T.StructField("s8", T.LongType())]
    + [T.StructField(n, T.IntegerType()) for n in ("place", "low", "high")]
    + [T.StructField("bytes", T.BinaryType())]
)
_REPEAT = T.StructType([T.StructField("id", T.LongType()), T.StructField("s8", T.LongType()), T.StructField("blob", T.BinaryType())])


def _blobs(text: np.ndarray, start: np.ndarray, end: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """The merged ranges of each text, as pairs of 32-bit integers."""
    order = np.argsort(text, kind="stable")
    text, pairs = text[order], np.stack((start[order], end[order]), axis=1)
    first = np.flatnonzero(np.append(True, text[1:] != text[:-1])) if len(text) else []
    for a, b in zip(first, np.append(first[1:], len(text)) if len(text) else [], strict=True):
        yield int(text[a]), _spans(pairs[a:b]).astype("<i4").tobytes()


def _fragments(candidates: DataFrame, length: int) -> DataFrame:
    """Fragments of texts at their shared anchors, without the strings that a task has earlier.

    Those go as one row for each text with the ranges to cut as ``bytes`` and -1 as ``low``.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = arrow_schema(_FRAGMENT)
        held: list[tuple] = []
        n = size = 0

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), out, strict=True)], schema=out)

        def sort() -> Iterator[pa.RecordBatch]:
            held.sort(key=lambda x: x[:2])
            data = b"".join([x[2] for x in held])
            base = np.cumsum([0] + [len(x[2]) for x in held])
            text = np.repeat(np.arange(len(held)), [len(x[3]) for x in held])
            h, place, first, last, hot = (np.concatenate([x[k] for x in held]) for k in range(3, 8))
            low, high = place - last, place - first
            anchor = base[text] + place
            _, name, times = np.unique(h, return_inverse=True, return_counts=True)
            met = np.flatnonzero(times[name] > 1)
            gone = np.zeros((len(h), length - GRAM + 1), dtype=bool)
            if len(met):
                gone[met] = repeated_offsets(data, anchor[met], low[met], high[met], length)
            row, a, b = _ranges(gone)
            rows: list[tuple] = []
            for t, blob in _blobs(text[row], place[row] - b + 1, place[row] - a + length):
                key, s8 = held[t][:2]
                rows.append((key ^ s8, key, s8, 0, -1, -1, blob))
            offset = np.arange(length - GRAM + 1)[None, :]
            left = ~gone & (low[:, None] <= offset) & (offset <= high[:, None])
            some = np.flatnonzero(left.any(axis=1))
            low, high = left.argmax(axis=1), left.shape[1] - 1 - left[:, ::-1].argmax(axis=1)
            signed = h.view(np.int64)
            for i in some.tolist():
                key, s8 = held[text[i]][:2]
                at, p = int(anchor[i]), int(place[i])
                if hot[i]:
                    for o in np.flatnonzero(left[i]).tolist():
                        own = data[at - o : at - o + length]
                        rows.append((int.from_bytes(hashlib.blake2b(own, digest_size=8).digest(), "little", signed=True), key, s8, p, o, o, own))
                else:
                    a, b = int(low[i]), int(high[i])
                    rows.append((int(signed[i]), key, s8, p, a, b, data[at - b : at - a + length]))
                if len(rows) >= 5000:
                    yield batch_of(rows)
                    rows = []
            if rows:
                yield batch_of(rows)

        for batch in batches:
            texts = utf8(batch.column("text"))
            ids, s8, wanted = (batch.column(c).to_pylist() for c in ("id", "s8", "hashes"))
            for i, (h, place, first, last) in _batches(texts, length):
                want = np.frombuffer(wanted[i], dtype="<u8")
                name = h >> np.uint64(12)
                keep = np.isin(name, want >> np.uint64(1))
                hot = np.isin(name[keep], (want >> np.uint64(1))[(want & np.uint64(1)) == 1])
                held.append((_LAST if ids[i] is None else ids[i], s8[i], texts[i], h[keep], place[keep], first[keep], last[keep], hot))
                n, size = n + int(keep.sum()), size + len(texts[i])
                if n >= BLOCK or size >= BLOCK_BYTES:
                    yield from sort()
                    held.clear()
                    n = size = 0
        if held:
            yield from sort()

    return map_batches(candidates, cut, _FRAGMENT)


def _repeats(fragments: DataFrame, length: int) -> DataFrame:
    """(id, s8, blob): ranges to cut, as pairs of 32-bit integers."""

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = arrow_schema(_REPEAT)
        held: list[list] = []
        n = 0

        def emit(parts: list[list]) -> Iterator[pa.RecordBatch]:
            h, key, s8, place, low, high = (np.concatenate([p[k] for p in parts]) for k in range(6))
            pieces = [x for p in parts for x in p[6]]
            order = np.lexsort((place, s8, key))
            key, s8, place, low, high = (x[order] for x in (key, s8, place, low, high))
            data = b"".join([pieces[i] for i in order.tolist()])
            base = np.cumsum([0] + [len(pieces[i]) for i in order.tolist()])[:-1]
            row, a, b = _ranges(repeated_offsets(data, base + high, low, high, length))
            text = np.cumsum(np.append(True, (key[1:] != key[:-1]) | (s8[1:] != s8[:-1]))) - 1
            first = np.flatnonzero(np.append(True, text[1:] != text[:-1]))
            made = [(int(key[first[t]]), int(s8[first[t]]), blob) for t, blob in _blobs(text[row], place[row] - b + 1, place[row] - a + length)]
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made, strict=True), out, strict=True)], schema=out)

        for batch in batches:
            cut = batch.column("low").to_numpy() < 0
            if cut.any():
                own = batch.filter(pa.array(cut))
                yield pa.RecordBatch.from_arrays([own.column(c).cast(f.type) for c, f in zip(("id", "s8", "bytes"), out, strict=True)], schema=out)
                batch = batch.filter(pa.array(~cut))
            if not batch.num_rows:
                continue
            new = [batch.column(c).to_numpy().astype(np.int64) for c in ("h", "id", "s8", "place", "low", "high")] + [batch.column("bytes").to_pylist()]
            if n >= BLOCK:
                edge = int(np.argmax(new[0] != held[-1][0][-1])) if new[0][-1] != held[-1][0][-1] else None
                if edge is not None:
                    yield from emit([*held, [x[:edge] for x in new]])
                    held, n, new = [], 0, [x[edge:] for x in new]
            held.append(new)
            n += len(new[0])
        if held:
            yield from emit(held)

    return map_batches(fragments.repartition("h").sortWithinPartitions("h"), sort, _REPEAT)


def _keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(id, text, sha, s8) of every row; nulls as empty texts."""
    rows = docs.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return with_digest(rows)


def with_digest(rows: DataFrame) -> DataFrame:
    rows = rows.withColumn("sha", F.sha2(F.col("text").cast("binary"), 256))
    return rows.withColumn("s8", F.conv(F.substring("sha", 1, 15), 16, 10).cast("long"))


def repeats(docs: DataFrame, *, key: str = "doc_id", text: str = "text", length: int = 100, digests: bool = True) -> DataFrame:
    """What to remove, one row for each different (id, text).

    (id, sha, s8, copies, n_bytes, spans, n_removed, kept_sha256): the first of ``copies`` loses ``spans``, the others
    all bytes if there are ``length``.  Without ``digests`` there is no ``kept_sha256``, and texts are moved once less.
    The result is staged, and what it was made from is gone.
    """
    small_batches(docs.sparkSession)
    rows = _keyed(docs, key, text)
    base = rows.select("id", "sha", "s8", F.octet_length("text").cast("long").alias("n_bytes")).groupBy("id", "sha", "s8")
    base = stage(base.agg(F.count("*").alias("copies"), F.max("n_bytes").alias("n_bytes")), "texts")
    # the parts of the null-safe join as columns: Spark then sees that its result is dealt for the next step, too
    known = lambda c: (F.coalesce(c, F.lit(_LAST)).alias("known"), F.isnull(c).alias("void"))
    total = base.agg(F.sum(F.col("n_bytes") * F.col("copies"))).first()[0] or 0
    wanted = _shared_anchors(rows.where(F.octet_length("text") >= length), total, length).dropDuplicates(["i", "digest"])
    wanted = wanted.select(*known("i"), F.col("digest").alias("sha"), "hashes")
    found = rows.select(*known("id"), "sha", "id", "s8", "text").join(wanted, ["known", "void", "sha"])
    candidates = stage(found.dropDuplicates(["known", "void", "sha"]).select("id", "s8", "text", "hashes"), "candidates")
    cuts = _repeats(_fragments(candidates, length), length).groupBy("id", "s8").agg(F.collect_list("blob").alias("blobs"))
    cuts = cuts.select(F.col("id").alias("i"), F.col("s8").alias("s"), "blobs")
    at = (F.coalesce("id", F.lit(_LAST)) == F.col("i")) & (F.col("s8") == F.col("s"))
    own = candidates.drop("hashes").join(cuts, at).select("i", "s", "blobs", "text") if digests else cuts
    span = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
    schema = T.StructType([T.StructField("i", T.LongType()), T.StructField("s", T.LongType()), T.StructField("spans", T.ArrayType(span)), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = arrow_schema(schema)
        for batch in batches:
            spans, removed, kept = [], [], []
            texts = utf8(batch.column("text")) if digests else [None] * batch.num_rows
            for raw, blobs in zip(texts, batch.column("blobs").to_pylist(), strict=True):
                own = _spans(np.frombuffer(b"".join(blobs), dtype="<i4").reshape(-1, 2)).tolist()
                spans.append([{"start": a, "end": b} for a, b in own])
                removed.append(sum(b - a for a, b in own))
                kept.append(hashlib.sha256(cut_bytes(raw, own)).hexdigest() if digests else None)
            yield pa.RecordBatch.from_arrays([batch.column("i"), batch.column("s"), pa.array(spans, out.field(2).type), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], schema=out)

    out = base.join(map_batches(own, merge, schema), at, "left")
    found = out.select("id", "sha", "s8", "copies", "n_bytes", "spans", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"))
    found = stage(found if digests else found.drop("kept_sha256"), "spans")
    discard(base, candidates)
    return found


def cut_bytes(raw: bytes, spans: list) -> bytes:
    kept, at = [], 0
    for a, b in spans:
        kept.append(raw[at:a])
        at = b
    return b"".join([*kept, raw[at:]])


def report(found: DataFrame, *, key: str = "doc_id", length: int = 100) -> DataFrame:
    """The digest of ``repeats`` for every row of its input."""
    row = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("k")
    rows = found.select("*", row).withColumn("gone", (F.col("n_bytes") >= length) & (F.col("k") > 1))
    return rows.select(
        F.col("id").alias(key),
        "n_bytes",
        F.when(F.col("gone"), F.col("n_bytes")).otherwise(F.col("n_removed")).alias("n_removed"),
        F.when(F.col("gone"), F.lit(1)).otherwise(F.coalesce(F.size("spans"), F.lit(0))).cast("long").alias("n_spans"),
        F.when(F.col("gone"), F.lit(_EMPTY)).otherwise(F.col("kept_sha256")).alias("kept_sha256"),
    )


def remove(docs: DataFrame, *, key: str = "doc_id", text: str = "text", length: int = 100) -> DataFrame:
    """``docs`` without repeated passages; texts of which nothing is left go.

    A character goes if all its bytes do.  Of equal rows one stays.
    """
    small_batches(docs.sparkSession)
    found = repeats(docs, key=key, text=text, length=length, digests=False)
    plan = found.select(F.col("id").alias("i"), F.col("sha").alias("digest"), "spans", "copies", "n_bytes")
    rows = with_digest(docs.select(F.struct(*docs.columns).alias("row"), F.col(key).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")))
    rows = rows.select("row", "id", "sha").join(plan, F.col("id").eqNullSafe(F.col("i")) & (F.col("sha") == F.col("digest")))
    twice = (F.col("copies") > 1) & (F.col("n_bytes") >= length)
    one = rows.where(twice).groupBy("id", "sha").agg(F.any_value("row").alias("row"), F.any_value("spans").alias("spans")).select("row", "spans")
    rows = rows.where(~twice).select("row", "spans").unionByName(one)
    schema = T.StructType([T.StructField("row", docs.schema)])
    place = docs.columns.index(text)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = arrow_schema(schema)
        kind = out.field(0).type
        for batch in batches:
            row, spans = batch.column("row"), batch.column("spans").to_pylist()
            columns = row.flatten()
            texts, keep = utf8(columns[place]), np.ones(len(spans), dtype=bool)
            for i, own in enumerate(spans):
                if own:
                    raw = texts[i]
                    whole = [(next(k for k in range(s["start"], s["end"] + 4) if k >= len(raw) or raw[k] & 0xC0 != 0x80), _floor(raw, s["end"])) for s in own]
                    texts[i] = cut_bytes(raw, [(a, b) for a, b in whole if a < b])
                    keep[i] = bool(texts[i])
            columns[place] = pa.array(texts, pa.large_binary()).cast(kind.field(place).type)
            columns = [c.cast(kind.field(k).type) for k, c in enumerate(columns)]
            made = pa.RecordBatch.from_arrays([pa.StructArray.from_arrays(columns, fields=list(kind))], schema=out)
            yield made if keep.all() else made.filter(pa.array(keep))

    return map_batches(rows, cut, schema).select("row.*")


def _floor(raw: bytes, at: int) -> int:
    """The last place not after ``at`` where a character begins or the text ends."""
    while at < len(raw) and raw[at] & 0xC0 == 0x80:
        at -= 1
    return at
