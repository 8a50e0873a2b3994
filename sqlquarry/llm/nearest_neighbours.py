"""Approximate nearest neighbours by multiprobe p-stable hashing.

Vectors are dealt to shards of a bounded size by a hash of their id; every shard is an index of ``tables`` hash
tables.  A table's hash is ``functions`` Gaussian (2-stable) projections of the unit vector, each cut to
buckets of ``width``.  For a query the occupied buckets of a table are visited in order of their estimated
success: the probability that a neighbour at cosine ``near`` of the query lies in the bucket, from how far each
projection of the query is from the bucket's sides.  Visiting stops when the visited buckets' probabilities
add up to ``success``.  The candidates of all tables are merged and ranked by their exact cosine in double
precision; the best of all shards are merged.

``near`` is the cosine at which a bounded sample of queries finds its ``k``-th neighbour in a bounded sample of
vectors.  Every vector is indexed, queries stream past the shards in blocks, and no list of candidates is cut.

Defined results: vectors that are null, empty, zero, or hold a null or a non-finite component take no part;
vectors of another dimension than the query's are no candidates; equal scores go to the smaller id; a query
finds all candidates if there are fewer than ``k``.  Rows with one id are separate candidates, and none of
them is one of a query with that id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import arrow_schema, map_batches, small_batches

_QUERIES = 256


def normal_share(z: np.ndarray) -> np.ndarray:
    """The standard normal distribution function, to seven places (Abramowitz and Stegun 26.2.17)."""
    t = 1 / (1 + 0.2316419 * np.abs(z))
    tail = 0.3989422804 * np.exp(-z * z / 2) * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return np.where(z > 0, 1 - tail, tail)


def scaled(x: np.ndarray) -> np.ndarray:
    """The vectors times powers of two that bring their largest component to 0.5 to 1: no square overflows or
    vanishes, and the cosine stays the same."""
    power = -np.frexp(np.abs(x).max(axis=1))[1]
    half = power // 2
    return np.ldexp(np.ldexp(x, half[:, None]), (power - half)[:, None])


class HashTable:
    """One p-stable hash table of unit vectors."""

    def __init__(self, unit: np.ndarray, functions: int, width: float, seed: int):
        rng = np.random.default_rng(seed)
        self.width = width
        self.project = rng.standard_normal((unit.shape[1], functions))
        self.shift = rng.uniform(0, width, functions)
        code = np.floor((unit @ self.project + self.shift) / width).astype(np.int64)
        self.low = code.min(axis=0)
        self.high = code.max(axis=0)
        self.buckets, self.bucket_of = np.unique(code - self.low, axis=0, return_inverse=True)
        self.bucket_of = self.bucket_of.ravel()

    def probe(self, queries: np.ndarray, near: float, success: float) -> np.ndarray:
        """Which vectors lie in the buckets that each query visits."""
        at, spread = queries @ self.project, np.sqrt(max(1e-9, 1 - near * near))
        chance = np.ones((len(queries), len(self.buckets)))
        for i in range(self.project.shape[1]):
            sides = np.arange(self.low[i], self.high[i] + 2) * self.width - self.shift[i]
            share = np.diff(normal_share((sides[None, :] - near * at[:, i, None]) / spread), axis=1)
            chance *= share[:, self.buckets[:, i]]
        order = np.argsort(-chance, axis=1, kind="stable")
        reached = np.cumsum(np.take_along_axis(chance, order, axis=1), axis=1)
        visits = (reached < success).sum(axis=1) + 1
        visited = np.zeros(chance.shape, dtype=bool)
        np.put_along_axis(visited, order, np.arange(chance.shape[1])[None, :] < visits[:, None], axis=1)
        return visited[:, self.bucket_of]


class ShardIndex:
    """The index of a shard's vectors of one dimension."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, *, tables: int, functions: int, width: float):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], scaled(vectors[order])
        self.norm = np.sqrt((self.vectors * self.vectors).sum(axis=1))
        unit = self.vectors / self.norm[:, None]
        self.unit = unit.astype(np.float32)
        self.tables = [HashTable(unit, functions, width, 1000 + t) for t in range(tables)]

    def search(self, ids: np.ndarray, queries: np.ndarray, k: int, near: float, success: float) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query the ids and exact cosines of its best candidates."""
        queries = scaled(queries)
        norm = np.sqrt((queries * queries).sum(axis=1))
        unit = queries / norm[:, None]
        candidate = np.zeros((len(queries), len(self.ids)), dtype=bool)
        for table in self.tables:
            candidate |= table.probe(unit, near, success)
        candidate &= self.ids[None, :] != ids[:, None]
        out, unit = [], unit.astype(np.float32)
        together = self.unit @ unit.T if candidate.mean() > 0.25 else None
        for q, own in enumerate(candidate):
            at = np.flatnonzero(own)
            rough = together[at, q] if together is not None else self.unit[at] @ unit[q]
            if len(at) > k:
                least = np.partition(rough, len(at) - k)[len(at) - k]
                at = at[rough >= least - 1e-4]
            score = (self.vectors[at] * queries[q]).sum(axis=1) / (self.norm[at] * norm[q])
            best = np.argsort(-score, kind="stable")[:k]
            out.append((self.ids[at[best]], score[best]))
        return out


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v) of the vectors that take part, in double precision."""
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & finite & F.exists("v", lambda x: x != 0))


def nearness(rows: DataFrame, count: int, k: int, sample: int) -> float:
    """The cosine that four of five sampled vectors reach with their ``k``-th neighbour in the sample."""
    share = min(1.0, sample / max(1, count))
    picked = rows if share == 1 else rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 31)) < int(share * (1 << 31)))
    got = [r["v"] for r in picked.select("v").limit(2 * sample).collect()]
    size = max(set(map(len, got)), key=[len(v) for v in got].count, default=0)
    x = np.array([v for v in got if len(v) == size])
    if len(x) <= k:
        return 0.0
    x = scaled(x)
    x /= np.sqrt((x * x).sum(axis=1))[:, None]
    cosine = x[:400] @ x.T
    cosine[np.arange(len(cosine)), np.arange(len(cosine))] = -2
    kth = np.partition(cosine, cosine.shape[1] - k, axis=1)[:, cosine.shape[1] - k]
    return float(np.clip(np.quantile(kth, 0.2), 0.0, 0.999))


def search(
    vectors: DataFrame,
    queries: Column,
    *,
    key: str = "vec_id",
    vector: str = "embedding",
    k: int = 5,
    tables: int = 4,
    functions: int = 8,
    width: float = 2.0,
    success: float = 0.56,
    shard_rows: int = 8192,
    sample: int = 2000,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the nearest found of the rows that ``queries`` admits among all rows."""
    small_batches(vectors.sparkSession, 4000)
    rows = usable(vectors, key, vector)
    count = rows.count()
    shards = max(1, -(-count // shard_rows))
    near = nearness(rows, count, k, sample)
    none = F.lit(0).cast("int")
    index = rows.select(F.pmod(F.xxhash64("id", "v"), F.lit(shards)).cast("int").alias("shard"), none.alias("kind"), "id", "v")
    asked = usable(vectors.where(queries), key, vector)
    asked = asked.select(F.explode(F.sequence(none, F.lit(shards - 1))).alias("shard"), F.lit(1).cast("int").alias("kind"), "id", "v")
    schema = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.DoubleType())])

    def answer(held: dict[int, ShardIndex], block: list[tuple]) -> Iterator[pa.RecordBatch]:
        for size in sorted({len(v) for _, v in block} & set(held)):
            own = [(i, v) for i, v in block if len(v) == size]
            ids, x = np.array([i for i, _ in own]), np.array([v for _, v in own], dtype=np.float64)
            found = held[size].search(ids, x, k, near, success)
            query = np.repeat(ids, [len(a) for a, _ in found])
            yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(np.concatenate([a for a, _ in found])), pa.array(np.concatenate([s for _, s in found]))], schema=arrow_schema(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, building, held, block = None, [], {}, []
        for batch in batches:
            for shard, kind, i, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if shard != now:
                    yield from answer(held, block)
                    now, building, held, block = shard, [], {}, []
                if kind == 0:
                    building.append((i, np.array(v, dtype=np.float64)))
                    continue
                if building:
                    for size in {len(x) for _, x in building}:
                        own = [(a, x) for a, x in building if len(x) == size]
                        held[size] = ShardIndex(np.array([a for a, _ in own]), np.array([x for _, x in own]), tables=tables, functions=functions, width=width)
                    building = []
                block.append((i, v))
                if len(block) == _QUERIES:
                    yield from answer(held, block)
                    block = []
        yield from answer(held, block)

    dealt = index.union(asked).repartition("shard").sortWithinPartitions("shard", "kind", "id")
    found = map_batches(dealt, run, schema)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
