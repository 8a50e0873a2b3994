"""Hashed items that texts share, with their exact counts, brought back to the texts.

1. Blocks.  A task cuts its texts to blocks of about ``BLOCK_ITEMS`` items and fewer than ``MARK`` texts.  An entry is
   one number: 52 bits of an item's hash and the text's place in the block.  A block's entries are sorted, cut to hash
   ranges, and go as differences in byte planes.  An item that at least ``OFTEN`` texts of the block have goes as one
   entry with its count, and its texts stay with the block: so what a range gets of one item grows with the blocks,
   not with the texts that have it.
2. Ranges.  A range counts its items over all blocks and answers each block with those that occur at least twice.
   Their number grows with the corpus, that of their tasks has a bound; a task takes one range after the other.
3. Blocks again.  Answers meet by block, and ``finish`` gets each text's shared items.

Two items whose 52 bits agree count as one; a word's chance of that is the number of different items over 2 ** 52.
"""

from __future__ import annotations

import pickle
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import arrow_schema, map_batches

BITS, ORDINAL = 52, 12
MARK = (1 << ORDINAL) - 1
OFTEN = 8
BLOCK_ITEMS = 1 << 20
#: Text bytes for each range, and the most tasks that ranges are dealt to.
RANGE_BYTES, TASKS = 24 << 20, 20_000

_ROW = T.StructType(
    [T.StructField("range", T.IntegerType()), T.StructField("block", T.LongType()), T.StructField("n", T.IntegerType())]
    + [T.StructField(c, T.BinaryType()) for c in ("keys", "counts", "info")]
)
#: A text's shared items as parallel arrays: 52-bit hash, occurrences in the text, count over the corpus.
Shared = tuple[np.ndarray, np.ndarray, np.ndarray]


def ranges_for(size: int) -> int:
    """Hash ranges for so many bytes of text; beyond 4096 each holds up to eight times as much."""
    n = max(16, -(-size // RANGE_BYTES))
    return n if n <= 4096 else max(4096, -(-n // 8))


def pack(keys: np.ndarray) -> bytes:
    """Ascending unsigned 64-bit numbers as differences: all but the top byte plane as they are."""
    if not len(keys):
        return b""
    step = np.diff(keys)
    width = max(1, (int(step.max()).bit_length() + 7) // 8) if len(step) else 1
    planes = np.ascontiguousarray(step.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T)
    top = zlib.compress(planes[-1].tobytes(), 1)
    return struct.pack("<QBI", int(keys[0]), width, len(top)) + top + planes[:-1].tobytes()


def unpack(blob: bytes, n: int) -> np.ndarray:
    if not n:
        return np.empty(0, np.uint64)
    first, width, size = struct.unpack_from("<QBI", blob)
    step = np.zeros((n - 1, 8), np.uint8)
    step[:, width - 1] = np.frombuffer(zlib.decompress(blob[13 : 13 + size]), np.uint8)
    if width > 1:
        step[:, : width - 1] = np.frombuffer(blob, np.uint8, (n - 1) * (width - 1), 13 + size).reshape(width - 1, n - 1).T
    out = np.empty(n, np.uint64)
    out[0] = first
    np.cumsum(step.reshape(-1).view("<u8"), out=out[1:])
    out[1:] += np.uint64(first)
    return out


def _sparse(counts: np.ndarray) -> bytes:
    """Counts of which most are 1."""
    at = np.flatnonzero(counts != 1)
    return zlib.compress(at.astype("<u4").tobytes() + counts[at].astype("<u4").tobytes(), 1) if len(at) else b""


def _dense(blob: bytes, n: int) -> np.ndarray:
    out = np.ones(n, np.int64)
    if blob:
        at, counts = np.frombuffer(zlib.decompress(blob), "<u4").reshape(2, -1)
        out[at] = counts
    return out


def _runs(sorted_values: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.append(True, sorted_values[1:] != sorted_values[:-1])) if len(sorted_values) else np.empty(0, np.int64)


def _block(number: int, ranges: int, items: list[np.ndarray], info: list) -> pa.RecordBatch:
    """The rows of one block: its entries by range, and what stays with it."""
    size = [len(x) for x in items]
    keys = (np.concatenate(items) >> np.uint64(64 - BITS) << np.uint64(ORDINAL)) | np.repeat(np.arange(len(items), dtype=np.uint64), size)
    keys.sort()
    first = _runs(keys)
    tf = np.diff(np.append(first, len(keys)))
    keys = keys[first]
    gram = keys >> np.uint64(ORDINAL)
    first = _runs(gram)
    texts = np.diff(np.append(first, len(gram)))
    many = np.repeat(texts >= OFTEN, texts)
    own_keys, own_tf = keys[many], tf[many]
    marked = first[texts >= OFTEN]
    sums = np.stack((texts, np.add.reduceat(tf, first) if len(first) else texts))[:, texts >= OFTEN]
    sent = np.concatenate((keys[~many], (gram[marked] << np.uint64(ORDINAL)) | np.uint64(MARK)))
    counts = np.concatenate((tf[~many], np.arange(len(marked))))
    order = np.argsort(sent, kind="stable")
    sent, counts = sent[order], counts[order]
    aggregated = (sent & np.uint64(MARK)) == MARK
    edge = np.array([-(-(r << BITS) // ranges) << ORDINAL for r in range(1, ranges)], dtype=np.uint64)
    bound = np.concatenate(([0], np.searchsorted(sent, edge), [len(sent)]))
    rows: list[tuple] = []
    for r in np.flatnonzero(np.diff(bound)).tolist():
        a, b = int(bound[r]), int(bound[r + 1])
        own = aggregated[a:b]
        both = sums[:, counts[a:b][own]].astype("<u4").tobytes()
        rows.append((r, number, b - a, pack(sent[a:b]), _sparse(np.where(own, 1, counts[a:b])), both))
    stays = pickle.dumps((info, own_tf.astype(np.uint32)))
    rows.append(((number + (number >> 36) * 31) % ranges, number, -len(own_keys) - 1, pack(own_keys), b"", stays))
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow_schema(_ROW), strict=True)], schema=arrow_schema(_ROW))


def _answers(rows: list[tuple], occurrences: bool) -> Iterator[tuple]:
    """From one range's rows (block, n, keys, counts, sums): answers (block, n, keys, occurrences, counts)."""
    keys = [unpack(r[2], r[1]) for r in rows]
    size = [len(k) for k in keys]
    every = np.concatenate(keys)
    tf = np.concatenate([_dense(r[3], r[1]) for r in rows])
    weight = tf.copy() if occurrences else np.ones(len(every), np.int64)
    sums = np.concatenate([np.frombuffer(r[4], "<u4").reshape(2, -1) for r in rows], axis=1)
    marked = np.flatnonzero((every & np.uint64(MARK)) == MARK)
    weight[marked] = sums[1 if occurrences else 0]
    gram = every >> np.uint64(ORDINAL)
    order = np.argsort(gram, kind="stable")
    first = _runs(gram[order])
    total = np.add.reduceat(weight[order], first)
    count = np.empty(len(every), np.int64)
    count[order] = np.repeat(total, np.diff(np.append(first, len(every))))
    at = 0
    for r, n in zip(rows, size, strict=True):
        own = np.flatnonzero(count[at : at + n] > 1) + at
        if len(own):
            yield r[0], len(own), pack(every[own]), _sparse(tf[own]), _sparse(count[own])
        at += n


def _texts(local: tuple, answers: list[tuple]) -> tuple[list, list[Shared]]:
    """The texts of a block and the shared items of each."""
    n, blob, stays = local
    info, own_tf = pickle.loads(stays)
    own = unpack(blob, n)
    keys = np.concatenate([unpack(a[1], a[0]) for a in answers]) if answers else np.empty(0, np.uint64)
    tf = np.concatenate([_dense(a[2], a[0]) for a in answers]) if answers else np.empty(0, np.int64)
    count = np.concatenate([_dense(a[3], a[0]) for a in answers]) if answers else np.empty(0, np.int64)
    marked = (keys & np.uint64(MARK)) == MARK
    named = keys[marked] >> np.uint64(ORDINAL)
    order = np.argsort(named)
    at = order[np.searchsorted(named[order], own >> np.uint64(ORDINAL))] if len(own) else np.empty(0, np.int64)
    keys = np.concatenate((keys[~marked], own))
    tf = np.concatenate((tf[~marked], own_tf.astype(np.int64)))
    count = np.concatenate((count[~marked], count[marked][at]))
    ordinal = (keys & np.uint64(MARK)).astype(np.int64)
    order = np.lexsort((keys, ordinal))
    keys, tf, count = keys[order] >> np.uint64(ORDINAL), tf[order], count[order]
    bound = np.searchsorted(ordinal[order], np.arange(len(info) + 1))
    return info, [(keys[a:b], tf[a:b], count[a:b]) for a, b in zip(bound[:-1], bound[1:], strict=True)]


def meet(
    rows: DataFrame,
    items: Callable[[pa.RecordBatch], Iterator[tuple[np.ndarray, object]]],
    finish: Callable[[list, list[Shared]], Iterator[pa.RecordBatch]],
    schema: T.StructType,
    *,
    size: int,
    occurrences: bool = False,
) -> DataFrame:
    """What ``finish`` makes of each block of texts and their shared items.

    ``items`` gives for each row of a batch its items, as 64-bit hashes with repeats, and what ``finish`` needs to
    know of it.  An item is shared if two texts have it; with ``occurrences``, also if one has it twice, and counts
    are of occurrences instead of texts.  ``size`` is the bytes of text.
    """
    ranges = ranges_for(size)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 36
        held: list[np.ndarray] = []
        info: list = []
        n = 0
        for batch in batches:
            for own, told in items(batch):
                if held and (n + len(own) > BLOCK_ITEMS or len(held) == MARK):
                    yield _block(number, ranges, held, info)
                    number, held, info, n = number + 1, [], [], 0
                held.append(own)
                info.append(told)
                n += len(own)
        if held:
            yield _block(number, ranges, held, info)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = arrow_schema(_ROW)
        now, held = None, []

        def close() -> Iterator[pa.RecordBatch]:
            made = [(0, b, n, k, t, c) for b, n, k, t, c in _answers(held, occurrences)]
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made, strict=True), out, strict=True)], schema=out)

        for batch in batches:
            local = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[2] < 0:
                    local.append(row)
                    continue
                if row[0] != now and held:
                    yield from close()
                    held = []
                now = row[0]
                held.append(row[1:])
            if local:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*local, strict=True), out, strict=True)], schema=out)
        if held:
            yield from close()

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, local, answers = None, None, []
        for batch in batches:
            for _, block, n, keys, tf, last in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if block != now and local is not None:
                    yield from finish(*_texts(local, answers))
                    local, answers = None, []
                now = block
                if n < 0:
                    local = (-n - 1, keys, last)
                else:
                    answers.append((n, keys, tf, last))
        if local is not None:
            yield from finish(*_texts(local, answers))

    tasks = min(ranges, TASKS)
    dealt = map_batches(rows, cut, _ROW).repartitionById(tasks, F.floor(F.col("range").cast("long") * tasks / ranges).cast("int"))
    answered = map_batches(dealt.sortWithinPartitions("range"), count, _ROW)
    return map_batches(answered.repartition("block").sortWithinPartitions("block"), gather, schema)
