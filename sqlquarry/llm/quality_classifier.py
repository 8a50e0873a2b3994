"""Text quality by naive Bayes support vectors.

Features are indicators of n-grams, hashed to ``2**BITS`` places: byte trigrams, and runs of one to three token
shapes (which kinds of characters a token has, begins and ends with, and whether it repeats the one before).
Each indicator is scaled by the log ratio of its smoothed shares in the two classes; a linear model with hinge
loss is fitted to the scaled, length-normalised rows by dual coordinate descent and mixed with the plain ratios.
A sigmoid fitted to the margins of rows left out of a first fit turns margins to scores.

The model is fitted, in one task, on a sample of labelled rows whose expected number is ``max_train``, taken by
a hash of the id; all of each text is used.  Equal rows of an id count once; an id with more different texts than
its share of ``4 * max_train`` rows trains on a hash sample of about that many, so no id crowds out another and a
rerun gives the same model.  Every text is scored in one pass without a shuffle.

Defined results: null and empty texts have no feature and score as the model's intercept does; null labels are
ignored; a text with both labels trains as both; without both classes every score is the share of label 1 (0.5
without labels).  Repeated rows and clashing column names are kept, ours get a leading underscore.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import append, arrow_schema, chunks, fresh, map_batches, small_batches, utf8, with_fields

BITS = 18
_LOWER, _UPPER, _DIGIT, _MARK, _WIDE = 1, 2, 4, 8, 16
_KIND = np.array([0 if c <= 32 else _LOWER if 97 <= c <= 122 else _UPPER if 65 <= c <= 90 else _DIGIT if 48 <= c <= 57 else _WIDE if c >= 128 else _MARK for c in range(256)], dtype=np.uint8)


class Features:
    """Distinct feature numbers of texts."""

    def __init__(self):
        self.stamp = np.zeros(1 << BITS, dtype=np.int64)

    def _distinct(self, places: np.ndarray) -> np.ndarray:
        turn = np.arange(len(places))
        self.stamp[places] = turn
        return places[self.stamp[places] == turn]

    def __call__(self, texts: list[bytes | None]) -> Iterator[np.ndarray]:
        for lo, hi in chunks([len(t or b"") for t in texts], 1 << 20):
            parts = [t or b"" for t in texts[lo:hi]]
            data = np.frombuffer(b"\n".join(parts) + b"\n\n\n", dtype=np.uint8)
            size = np.fromiter((len(t) for t in parts), np.int64, len(parts))
            begin = np.cumsum(size + 1) - size - 1
            wide = data.astype(np.uint32)
            three = (wide[:-2] << np.uint32(16)) | (wide[1:-1] << np.uint32(8)) | wide[2:]
            three = ((three * np.uint32(2654435761)) >> np.uint32(32 - BITS)).astype(np.int64)
            kind = _KIND[data]
            edge = np.flatnonzero(np.diff((kind > 0).view(np.int8), prepend=np.int8(0)))
            first, last = edge[0::2], edge[1::2]
            token = np.searchsorted(first, np.append(begin, len(data)))
            runs: list[np.ndarray] = []
            if len(first):
                has = np.bitwise_or.reduceat(kind, first).astype(np.uint64)
                own = np.add.reduceat((wide.astype(np.uint64) + np.uint64(1)) * (wide.astype(np.uint64) + np.uint64(7)) * (kind > 0), first)
                same = np.append(False, (own[1:] == own[:-1]) & (np.diff(last - first) == 0))
                same[token[:-1][token[:-1] < len(same)]] = False  # a text's first token repeats none
                shape = has | (kind[first].astype(np.uint64) << np.uint64(5)) | (kind[last - 1].astype(np.uint64) << np.uint64(10)) | (same.astype(np.uint64) << np.uint64(15))
                code = np.zeros_like(shape)
                for n in range(3):
                    code = (code << np.uint64(17)) ^ np.concatenate((np.zeros(n, np.uint64), shape[: len(shape) - n])) ^ np.uint64(1 << 16)
                    hashed = (code * np.uint64(0x9E3779B97F4A7C15) + np.uint64(n)) * np.uint64(0xD6E8FEB86659FD93)
                    runs.append((hashed >> np.uint64(64 - BITS)).astype(np.int64))
            for i in range(len(parts)):
                found = [three[begin[i] : begin[i] + max(0, size[i] - 2)]]
                a, b = token[i], token[i + 1]
                found += [x[a + n : b] for n, x in enumerate(runs) if b > a + n]
                yield self._distinct(np.concatenate(found))


def dual_descent(rows: list[np.ndarray], scale: np.ndarray, y: np.ndarray, c: float, epochs: int, seed: int = 3) -> np.ndarray:
    """Weights (the last is the intercept's) of the L1-loss linear support vector machine of scaled unit rows."""
    w, alpha = np.zeros(len(scale) + 1), np.zeros(len(rows))
    values = []
    for r in rows:
        v = scale[r]
        values.append(v / max(1e-12, np.sqrt((v * v).sum())))
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        worst = 0.0
        for i in rng.permutation(len(rows)):
            r, v = rows[i], values[i]
            gradient = y[i] * (w[r] @ v + w[-1]) - 1
            old = alpha[i]
            projected = min(gradient, 0) if old == 0 else max(gradient, 0) if old == c else gradient
            worst = max(worst, abs(projected))
            if projected:
                norm = 2.0 if len(r) else 1.0
                alpha[i] = min(max(old - gradient / norm, 0), c)
                step = (alpha[i] - old) * y[i]
                w[r] += step * v
                w[-1] += step
        if worst < 0.05:
            break
    return w


class Model:
    """Scale, weights and the sigmoid of a fitted classifier."""

    def __init__(self, scale: np.ndarray, weights: np.ndarray, slope: float, shift: float):
        self.scale, self.weights, self.slope, self.shift = scale, weights, slope, shift

    def margin(self, row: np.ndarray) -> float:
        v = self.scale[row]
        return float(self.weights[row] @ v / max(1e-12, np.sqrt((v * v).sum())) + self.weights[-1])

    def score(self, row: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(row) + self.shift, -35, 35))))

    def dump(self) -> bytes:
        return np.concatenate((self.scale, self.weights, [self.slope, self.shift])).astype("<f4").tobytes()

    @classmethod
    def load(cls, blob: bytes) -> "Model":
        x, n = np.frombuffer(blob, dtype="<f4").astype(np.float64), 1 << BITS
        return cls(x[:n], x[n : 2 * n + 1], float(x[-2]), float(x[-1]))


def train(rows: list[np.ndarray], labels: np.ndarray, *, c: float = 1.0, smooth: float = 1.0, mix: float = 0.25, epochs: int = 20) -> Model:
    """A model of feature rows and 0/1 labels."""
    n, share = 1 << BITS, float(labels.mean()) if len(labels) else 0.5
    if not 0 < share < 1:
        prior = min(max(share, 1e-6), 1 - 1e-6)
        return Model(np.zeros(n), np.zeros(n + 1), 0.0, float(np.log(prior / (1 - prior))))

    def one(picked: np.ndarray) -> Model:
        y = labels[picked]
        seen = [np.full(n, smooth), np.full(n, smooth)]
        for i, label in zip(picked, y, strict=True):
            seen[label][rows[i]] += 1
        scale = np.log((seen[1] / seen[1].sum()) / (seen[0] / seen[0].sum()))
        w = dual_descent([rows[i] for i in picked], scale, np.where(y == 1, 1.0, -1.0), c, epochs)
        w[:-1] = (1 - mix) * w[:-1] + mix * np.abs(w[:-1]).mean()
        return Model(scale, w, 1.0, 0.0)

    order = np.random.default_rng(11).permutation(len(rows))
    margin = np.empty(len(rows))
    for k in range(2):
        part, rest = order[k::2], order[1 - k :: 2]
        if len(set(labels[rest])) == 2:
            model = one(rest)
            margin[part] = [model.margin(rows[i]) for i in part]
        else:
            margin[part] = 0.0
    slope, shift = sigmoid(margin, labels)
    model = one(np.arange(len(rows)))
    model.slope, model.shift = slope, shift
    return model


def sigmoid(margin: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and shift by Newton's method on smoothed targets (Platt 1999)."""
    up, down = labels.sum(), len(labels) - labels.sum()
    target = np.where(labels == 1, (up + 1) / (up + 2), 1 / (down + 2))
    theta, x = np.array([1.0, 0.0]), np.stack((margin, np.ones_like(margin)), axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -35, 35)))
        g = x.T @ (p - target) + 1e-6 * theta
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, g)
        theta = theta - step * min(1.0, 10 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return float(max(theta[0], 0.0)), float(theta[1])


def fit(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "quality", max_train: int = 20_000) -> Model:
    """A model of the texts that ``labels`` (id, 0/1) marks, on a sample of about ``max_train`` of them."""
    small_batches(docs.sparkSession)
    marked = labels.select(F.col(key).alias("k"), F.col(label).cast("int").alias("y")).where("k is not null and y in (0, 1)").distinct()
    share = min(1.0, max_train / max(1, marked.count()))
    if share < 1:
        marked = marked.where(F.pmod(F.xxhash64("k"), F.lit(1 << 31)) < int(share * (1 << 31)))
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("text")).join(F.broadcast(marked), "k").select("k", "y", "text")
    rows = rows.withColumn("h", F.xxhash64("k", "text"))
    sizes = rows.select("k", "y", "h").distinct().groupBy("k", "y").agg(F.count("*").alias("n"))
    quota = max(1, 4 * max_train // max(1, marked.count()))
    large = sizes.where(F.col("n") > quota)
    kept = F.col("n").isNull() | (F.pmod("h", F.lit(1 << 31)) < F.lit(float(quota << 31)) / F.col("n"))
    rows = rows.join(F.broadcast(large), ["k", "y"], "left").where(kept).select("k", "y", "text").distinct()
    row = T.StructType([T.StructField("k", docs.schema[key].dataType), T.StructField("y", T.IntegerType()), T.StructField("row", T.BinaryType())])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, out = Features(), arrow_schema(row)
        for batch in batches:
            blobs = [x.astype("<i4").tobytes() for x in features(utf8(batch.column("text")))]
            yield pa.RecordBatch.from_arrays([batch.column("k").cast(out.field(0).type), batch.column("y").cast(pa.int32()), pa.array(blobs, pa.binary())], schema=out)

    made = T.StructType([T.StructField("model", T.BinaryType())])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [x for batch in batches for x in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
        found.sort(key=lambda x: (x[0], x[1], x[2]))
        rows = [np.frombuffer(x[2], dtype="<i4") for x in found]
        model = train(rows, np.array([x[1] for x in found], dtype=np.int64))
        yield pa.RecordBatch.from_arrays([pa.array([model.dump()], pa.binary())], schema=arrow_schema(made))

    got = map_batches(map_batches(rows, make, row).repartition(1), learn, made).collect()
    return Model.load(bytes(got[0]["model"])) if got else train([], np.empty(0, np.int64))


def score(docs: DataFrame, model: Model, *, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with a score from 0 to 1, higher for likelier label 1."""
    small_batches(docs.sparkSession)
    (name,) = fresh(docs, name)
    schema = with_fields(docs.schema, T.StructField(name, T.DoubleType()))
    held = docs.sparkSession.sparkContext.broadcast(model.dump())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, features, out = Model.load(held.value), Features(), arrow_schema(schema)
        for batch in batches:
            yield append(batch, out, [own.score(r) for r in features(utf8(batch.column(text)))])

    return map_batches(docs, run, schema)
