"""Language identification by rank-order n-gram profiles.

A profile is the list of a language's most frequent letter n-grams (one to three characters, words set in
blanks), most frequent first.  A text's own profile is compared with each by the out-of-place distance: the sum,
over the text's n-grams, of how far each stands from its rank in the language; an n-gram that the language's
profile lacks costs the profile's whole length.  The nearest language wins.

Profiles are learnt from a sample of labelled rows whose expected size is the parameter ``max_train``: a row
is in it by a hash of its id and text, at a rate of ``max_train`` over the number of labelled rows.  Every
text, whole, is predicted in one pass without a shuffle.

Defined results: a null text, an empty one and one without a letter get ``und`` and score 0; so does every text
if no row is labelled.  Equal distances go to the language that sorts first.  Repeated rows and ids are kept
as they are; columns with clashing names are kept and ours get a leading underscore.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import append, arrow_schema, chunks, fresh, map_batches, small_batches, with_fields

_BLANK = 32
_HELD: dict[str, np.ndarray] = {}


def _letters() -> np.ndarray:
    if "letters" not in _HELD:
        _HELD["letters"] = np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)
    return _HELD["letters"]


def text_ngrams(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each text its distinct n-grams, ascending, and their counts.

    An n-gram of code points a, b, c is the number a * 2**42 + b * 2**21 + c, shorter ones with leading
    zeros.  What is not a letter is a blank; blanks do not repeat.
    """
    lowered = [(t or "").lower() for t in texts]
    size = np.fromiter((len(t) for t in lowered), dtype=np.int64, count=len(lowered))
    ends = np.cumsum(size + 1)
    code = np.frombuffer((" ".join(lowered) + " ").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = _letters()[code]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    alphabet, small = np.unique(np.where(letter, code, _BLANK)[keep], return_inverse=True)
    bound = np.concatenate(([0], np.cumsum(keep)))[np.concatenate(([0], ends))]
    bits = max(2, int(len(alphabet)).bit_length())
    kind = np.uint32 if 3 * bits <= 32 else np.uint64
    wide = alphabet.astype(np.uint64)
    blank = int(np.searchsorted(alphabet, _BLANK))
    mask = np.uint64((1 << bits) - 1)
    small = small.astype(kind) + kind(1)
    blank = kind(blank + 1)
    for lo, hi in zip(bound[:-1], bound[1:], strict=True):
        if hi - lo < 2:
            yield np.empty(0, np.uint64), np.empty(0, np.int64)
            continue
        own = np.concatenate(([blank], small[lo:hi])).astype(kind)
        two = (own[:-1] << kind(bits)) | own[1:]
        three = (two[:-1] << kind(bits)) | own[2:]
        grams = np.concatenate((own[own != blank], two, three))
        grams.sort()
        first = np.flatnonzero(np.concatenate(([True], grams[1:] != grams[:-1])))
        count = np.diff(first, append=len(grams))
        found = grams[first].astype(np.uint64)
        out = np.zeros(len(found), np.uint64)
        for shift in (2, 1, 0):
            digit = (found >> np.uint64(shift * bits)) & mask
            there = digit > 0
            out[there] |= wide[digit[there].astype(np.int64) - 1] << np.uint64(21 * shift)
        yield out, count


def _top(grams: np.ndarray, count: np.ndarray, most: int) -> np.ndarray:
    """The most frequent n-grams, ties in ascending order."""
    order = (count.astype(np.int64) << 32) | np.arange(len(count) - 1, -1, -1, dtype=np.int64)
    if len(order) > most:
        order = np.partition(order, len(order) - most)[-most:]
    order = np.sort(order)[::-1]
    return grams[len(count) - 1 - (order & 0xFFFFFFFF)]


class Profiles:
    """Ranks of n-grams in each language."""

    def __init__(self, ranked: dict[str, list[int]], size: int):
        self.size = size
        self.langs = sorted(ranked)
        self.grams = np.unique(np.array([g for v in ranked.values() for g in v], dtype=np.uint64))
        self.ranks = np.full((len(self.langs), len(self.grams) + 1), -1, dtype=np.int64)
        for i, lang in enumerate(self.langs):
            own = np.array(ranked[lang], dtype=np.uint64)
            self.ranks[i, np.searchsorted(self.grams, own)] = np.arange(len(own))

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        langs, scores = [], []
        for grams, count in text_ngrams(texts):
            if not len(grams) or not self.langs:
                langs.append("und")
                scores.append(0.0)
                continue
            top = _top(grams, count, self.size)
            at = np.searchsorted(self.grams, top)
            at[(at == len(self.grams)) | (self.grams[np.minimum(at, len(self.grams) - 1)] != top)] = len(self.grams)
            rank = self.ranks[:, at]
            away = np.where(rank < 0, self.size, np.abs(rank - np.arange(len(top)))).sum(axis=1)
            best = int(away.argmin())
            langs.append(self.langs[best])
            scores.append(float(1 - away[best] / (len(top) * self.size)))
        return langs, scores


def fit(
    docs: DataFrame,
    *,
    text: str = "text",
    lang: str = "lang",
    key: str = "doc_id",
    where: Column | None = None,
    size: int = 400,
    max_train: int = 40_000,
) -> Profiles:
    """Profiles from the rows of ``docs`` that ``where`` admits and whose ``lang`` is not null.

    Counts are added up by language and n-gram over the cluster; the driver gets ``size`` n-grams a language.
    """
    small_batches(docs.sparkSession)
    rows = docs.where(F.col(lang).isNotNull() & (F.lit(True) if where is None else where))
    n = rows.count()
    share = min(1.0, max_train / max(n, 1))
    picked = rows.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"), F.xxhash64(key, text).alias("h"))
    if share < 1:
        picked = picked.where(F.pmod("h", F.lit(1 << 31)) < int(share * (1 << 31)))
    made = T.StructType([T.StructField("lang", T.StringType()), T.StructField("gram", T.LongType()), T.StructField("n", T.LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = arrow_schema(made)
        for batch in batches:
            texts, names = batch.column("text").to_pylist(), np.array(batch.column("lang").to_pylist(), dtype=object)
            found = list(text_ngrams(texts))
            for name in sorted(set(names)):
                own = [found[i] for i in np.flatnonzero(names == name)]
                grams = np.concatenate([g for g, _ in own])
                if len(grams):
                    grams, at = np.unique(grams, return_inverse=True)
                    total = np.bincount(at, weights=np.concatenate([c for _, c in own])).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(grams), pa.string()), pa.array(grams.astype(np.int64)), pa.array(total)], schema=out)

    total = map_batches(picked.select("lang", "text"), count, made).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    first = Window.partitionBy("lang").orderBy(F.desc("n"), F.asc("gram"))
    best = total.withColumn("r", F.row_number().over(first)).where(F.col("r") <= size)
    ranked: dict[str, list[int]] = {}
    for row in sorted(best.collect(), key=lambda r: (r["lang"], r["r"])):
        ranked.setdefault(row["lang"], []).append(row["gram"])
    return Profiles(ranked, size)


def identify(docs: DataFrame, profiles: Profiles, *, text: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` with the predicted language and a score from 0 to 1 (1: every n-gram in its place)."""
    small_batches(docs.sparkSession)
    label, score = fresh(docs, *names)
    schema = with_fields(docs.schema, T.StructField(label, T.StringType()), T.StructField(score, T.DoubleType()))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = arrow_schema(schema)
        for batch in batches:
            texts = batch.column(text).to_pylist()
            langs, scores = [], []
            for lo, hi in chunks([len(t or "") for t in texts], 1 << 20):
                a, b = profiles.predict(texts[lo:hi])
                langs += a
                scores += b
            yield append(batch, out, langs, scores)

    return map_batches(docs, predict, schema)
