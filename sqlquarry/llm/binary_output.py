"""Token ids packed to fixed-length sequences by best-fit decreasing.

Texts are tokenized, each followed by an end id, and cut without loss into pieces of at most ``length``
tokens.  Whole pieces of ``length`` fill a sequence alone; the others, longest first, each go to the open
sequence with the least room that still holds them, which a segment tree over the possible rooms finds in
logarithmic time.  A row is one packed sequence: its id matrix row, cumulative segment lengths, the places
where positions start again, and which part of which text every segment is.

Packing works on bounded blocks of texts within a partition, so nothing is shuffled and memory does not grow;
a block of ``block_tokens`` fills all but a small part of its last sequences.

Defined results: null and empty texts are just the end id; repeated rows are packed as often as they come;
an empty table gives no sequence.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ._common import arrow_schema, chunks, map_batches, small_batches
from ._tokens import tokenizer


class RoomTree:
    """Open sequences by the room that they have left; finds the least room of at least a given size."""

    def __init__(self, most: int):
        self.leaves = 1 << most.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(most + 1)]

    def add(self, room: int, sequence: int) -> None:
        self.open[room].append(sequence)
        node = room + self.leaves
        while node:
            self.count[node] += 1
            node >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """The room and the number of the best sequence, taken out; None if none has room."""
        count, node = self.count, need + self.leaves
        if not count[node]:
            while node > 1 and (node & 1 or not count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node *= 2
                if not count[node]:
                    node += 1
        room = node - self.leaves
        while node:
            count[node] -= 1
            node >>= 1
        return room, self.open[room].pop()


def best_fit_decreasing(lengths: np.ndarray, room: int) -> list[list[int]]:
    """Which pieces go together; every piece must fit in ``room``."""
    tree, packed = RoomTree(room), []
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        found = tree.take(need)
        if found is None:
            left, at = room, len(packed)
            packed.append([])
        else:
            left, at = found
        packed[at].append(i)
        if left > need:
            tree.add(left - need, at)
    return packed


def pack(
    docs: DataFrame,
    *,
    key: str = "doc_id",
    text: str = "text",
    vocabulary: str = "word_bpe_49k.json",
    end_id: int = 2,
    pad_id: int = 0,
    length: int = 4096,
    block_tokens: int = 4 << 20,
) -> DataFrame:
    """One row for each packed sequence.

    ``input_ids`` has ``length`` little-endian unsigned 32-bit ids, ``n_tokens`` of them real; ``cu_seqlens``
    goes from 0 to ``n_tokens``; ``resets`` are the places at which positions start again at 0 (padding, if
    any, is a segment of its own); ``doc_ids`` and ``doc_starts`` say of which text and from which of its ids
    each segment is; ``sequence_id`` is unique.
    """
    small_batches(docs.sparkSession)
    id_type = docs.schema[key].dataType
    whole = T.ArrayType(T.IntegerType(), False)
    schema = T.StructType(
        [
            T.StructField("sequence_id", T.LongType()),
            T.StructField("n_tokens", T.IntegerType()),
            T.StructField("input_ids", T.BinaryType()),
            T.StructField("cu_seqlens", whole),
            T.StructField("resets", whole),
            T.StructField("doc_ids", T.ArrayType(id_type)),
            T.StructField("doc_starts", T.ArrayType(T.LongType())),
        ]
    )

    def packed(ids: list[np.ndarray], keys: list, first: int) -> pa.RecordBatch:
        cut = [(d, s, min(length, len(x) - s)) for d, x in enumerate(ids) for s in range(0, len(x), length)]
        rows: list[list] = [[] for _ in schema.fields]
        for k, own in enumerate(best_fit_decreasing(np.array([n for _, _, n in cut]), length)):
            parts = [cut[i] for i in own]
            row = np.full(length, pad_id, dtype="<u4")
            ends = np.cumsum([n for _, _, n in parts]).tolist()
            for (d, s, n), e in zip(parts, ends, strict=True):
                row[e - n : e] = ids[d][s : s + n]
            used = ends[-1]
            resets = [0, *ends] if used < length else [0, *ends[:-1]]
            for column, x in zip(rows, (first + k, used, row.tobytes(), [0, *ends], resets, [keys[d] for d, _, _ in parts], [s for _, s, _ in parts]), strict=True):
                column.append(x)
        out = arrow_schema(schema)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, out, strict=True)], schema=out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, at = tokenizer(vocabulary), TaskContext.get().partitionId() << 40
        end = np.array([end_id], dtype=tok.kind)
        ids: list[np.ndarray] = []
        keys: list = []
        held = 0
        for batch in batches:
            texts, names = [t or "" for t in batch.column(text).to_pylist()], batch.column(key).to_pylist()
            for lo, hi in chunks([len(t) for t in texts], 1 << 20):
                new = [np.concatenate((x, end)) for x in tok.ids(texts[lo:hi])]
                ids += new
                keys += names[lo:hi]
                held += sum(map(len, new))
                if held >= block_tokens:
                    made = packed(ids, keys, at)
                    for i in range(0, made.num_rows, 256):
                        yield made.slice(i, 256)
                    at += made.num_rows
                    ids, keys, held = [], [], 0
        if ids:
            made = packed(ids, keys, at)
            for i in range(0, made.num_rows, 256):
                yield made.slice(i, 256)

    return map_batches(docs.select(key, text), run, schema)


def matrix(rows: list, length: int = 4096) -> np.ndarray:
    """The id matrix of collected rows of ``pack``."""
    return np.frombuffer(b"".join(r["input_ids"] for r in rows), dtype="<u4").reshape(-1, length)


def write_packed(docs: DataFrame, path: str, **options) -> None:
    """Write the sequences of ``pack`` as Parquet with binary id rows."""
    pack(docs, **options).write.option("compression", "zstd").mode("overwrite").parquet(path)
