"""Near-duplicate classes by consistent weighted sampling of TF-IDF shingles.

A text is a weighted set of its shingles (five consecutive words): a shingle weighs its count in the text times
``1 + log10(N / df)``, with ``df`` counted exactly over all ``N`` texts that have words.  Improved consistent weighted
sampling draws ``bands * rows`` samples of the set, two texts sharing each with a probability equal to their weighted
Jaccard similarity.  Texts that share a whole band are candidates, and a candidate pair is linked if its weighted
Jaccard similarity, computed from the whole sets, is at least ``threshold``.  Classes are the connected components of
the links.

With ``counts``, a pair whose plain counts are as similar is linked, too, and draws samples of them.  Near copies of one
text lower the IDF of what they share, not that of the words edited in one copy only: the larger their group and the
corpus, the more copies the weights alone leave out.

How it stays bounded:

* Document frequencies are counted by hash ranges and come back to the texts (see ``_meet``).  Only shared shingles
  come back: one that no other text has can't be in a common part, whatever it is, so a text's unshared shingles are
  known by their number and drawn under names of the text's own.  A text whose shared shingles weigh less than
  ``threshold`` of the whole has no partner and draws no samples.
* Copies.  Texts with the same words become one node before any grouping, so a group of exact copies costs one.
* Stars.  A band's texts are compared with its least one first, in groups of ``STAR`` texts, which settles almost
  all of a large group in linear work.
* Rests.  Where a component of bands still has several classes, every pair of texts of different classes is decided
  by an inverted index of their sets, with nothing emitted but the links of a spanning forest.  The members of the
  largest class are not compared with each other; what remains is dealt to pairs of blocks of a bounded size.

Defined results: a null, empty or word-less text is in no class but its own; repeated rows are exact copies
of each other; ``class_id`` is the least id of the class, null only if its texts have no other id.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import arrow_schema, chunks, discard, map_batches, small_batches, stage, utf8
from ._meet import Shared, meet
from ._text import Words, mix, shingles

#: Texts that are compared with one least text in one group.
STAR = 256
#: Shingles of a block, each text counting as ``SET_COST`` more.
BLOCK_GRAMS, SET_COST = 2_000_000, 200
#: A word has a byte of this kind.
_WORD = "[0-9A-Za-z\\x{80}-\\x{10FFFF}]"


def _sets(texts: list[bytes | None], n: int) -> Iterator[tuple[Words, np.ndarray, np.ndarray]]:
    """Texts in pieces of about a megabyte: their words, shingles, and where each text's shingles begin."""
    for lo, hi in chunks([len(t or b"") for t in texts], 1 << 20):
        w = Words(texts[lo:hi])
        yield w, *shingles(w, n)


def idf(texts: int, df: np.ndarray | int) -> np.ndarray:
    return 1 + np.log10(np.maximum(1.0, texts / np.maximum(df, 1)))


class Sampler:
    """Improved consistent weighted sampling (Ioffe 2010) with random numbers drawn from a shingle's hash.

    For sample k and shingle s: r and c are Gamma(2, 1), b is uniform; t = floor(ln w / r + b), and the shingle
    with the least ln c - r (t - b + 1) is drawn, together with its t.
    """

    def __init__(self, bands: int, rows: int, seed: int = 20_240_601):
        rng = np.random.default_rng(seed)
        self.bands, self.rows = bands, rows
        self.factor = rng.integers(0, 2**63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.shift = rng.integers(0, 2**63, bands * rows, dtype=np.uint64)
        p = (np.arange(1 << 16) + 0.5) / (1 << 16)
        x = np.linspace(0, 30, 600_001)
        gamma = np.interp(p, 1 - (1 + x) * np.exp(-x), x)
        self.r, self.log_c = gamma, np.log(gamma)

    def bands_of(self, grams: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """One 64-bit number a band."""
        drawn = np.empty(len(self.factor), np.uint64)
        step = max(1, 40_000 // len(grams))
        log_w = np.log(weight)[None, :]
        for k in range(0, len(drawn), step):
            u = grams[None, :] * self.factor[k : k + step, None] + self.shift[k : k + step, None]
            u ^= u >> np.uint64(32)
            u *= np.uint64(0xD6E8FEB86659FD93)
            r = self.r[(u >> np.uint64(48)).astype(np.int64)]
            b = ((u >> np.uint64(16)) & np.uint64(0xFFFF)) * (1 / 65536)
            t = np.floor(log_w / r + b)
            a = self.log_c[((u >> np.uint64(32)) & np.uint64(0xFFFF)).astype(np.int64)] - r * (t - b + 1)
            best = a.argmin(axis=1)
            chosen = t[np.arange(len(best)), best].astype(np.int64).view(np.uint64)
            drawn[k : k + step] = grams[best] ^ (chosen * np.uint64(0x9E3779B97F4A7C15))
        drawn = drawn.reshape(self.bands, self.rows)
        out = np.arange(1, self.bands + 1, dtype=np.uint64)
        for j in range(self.rows):
            out = (out ^ drawn[:, j]) * np.uint64(0xFF51AFD7ED558CCD)
            out ^= out >> np.uint64(32)
        return out


def similarity(a: tuple[np.ndarray, np.ndarray, float], b: tuple[np.ndarray, np.ndarray, float]) -> float:
    """Weighted Jaccard similarity of two sets: shared shingles ascending, their weights, the weight of all."""
    at = np.searchsorted(a[0], b[0])
    at[at == len(a[0])] = 0
    same = a[0][at] == b[0]
    common = np.minimum(a[1][at[same]], b[1][same]).sum()
    return float(common / (a[2] + b[2] - common))


Sets = list[tuple[np.ndarray, np.ndarray, float]]


def _pack(own: np.ndarray, weight: np.ndarray, tf: np.ndarray, count: int) -> bytes:
    counts = np.append(tf, count).astype("<u4")
    return zlib.compress(weight.astype("<f4").tobytes() + counts.tobytes(), 1) + own.astype("<u8").tobytes()


def _unpack(blob: bytes, n: int, total: float, counts: bool) -> Sets:
    """A text's weighted set, and with ``counts`` that of its plain counts."""
    raw, own = zlib.decompress(blob[: len(blob) - 8 * n]), np.frombuffer(blob[len(blob) - 8 * n :], dtype="<u8")
    tf = np.frombuffer(raw, "<u4", offset=4 * n)
    return [(own, np.frombuffer(raw, "<f4", n).astype(np.float64), total), (own, tf[:-1], float(tf[-1]))][: 1 + counts]


def _alike(a: Sets, b: Sets, threshold: float) -> bool:
    near = lambda x, y, t: min(x[2], y[2]) >= t * max(x[2], y[2]) * (1 - 1e-9) and similarity(x, y) >= t
    return any(near(x, y, t) for x, y, t in zip(a, b, _thresholds(threshold), strict=False))


def _thresholds(threshold: float) -> tuple[float, float]:
    """Of the weights and of counts, whose similarity can be the threshold itself."""
    return threshold, threshold * (1 - 1e-12)


def _digest(words: np.ndarray) -> bytes:
    return hashlib.blake2b(words.tobytes(), digest_size=16).digest()


def components(links: DataFrame) -> DataFrame:
    """The least node that each node of ``links`` (a, b) is connected with, as (node, root).

    Every round links all larger neighbours of a node to the least one, then all smaller ones, until nothing
    changes; stars stay stars, so a large component needs no wide rows.  The least neighbours are staged before they are
    joined back, so that both sides are dealt for the join alone and Spark can split the rows of a large star's centre.
    """
    edges = stage(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    before = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stage(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
        large = stage(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large")
        low = stage(large.groupBy("a").agg(F.min("b").alias("m")), "low")
        small = large.join(low, "a")
        small = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(small.select("a", F.col("m").alias("b"))).distinct()
        read, edges = edges, stage(small, "edges")
        discard(read, least, large, low)
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        before = now


def signatures(docs: DataFrame, sampler: Sampler, *, key: str = "doc_id", text: str = "text", shingle: int = 5, threshold: float = 0.8, counts: bool = False) -> DataFrame:
    """(id, node, bands, n, total, grams) of every row.

    ``node`` is a digest of the text's words, null for a text without words.  The others are null where no text can
    be similar enough, and for further copies in one block: band numbers, and the weighted set as the number of
    shared shingles, the weight of all, and the shared ones packed with their weights and counts.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    texts, size = rows.agg(F.count(F.when(F.col("text").rlike(_WORD), 1)), F.sum(F.octet_length("text"))).first()
    schema = T.StructType(
        [T.StructField("id", rows.schema["id"].dataType), T.StructField("node", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType(), False))]
        + [T.StructField("n", T.IntegerType()), T.StructField("total", T.DoubleType()), T.StructField("grams", T.BinaryType())]
    )
    single = float(idf(texts, 1))

    def items(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, object]]:
        ids, at = batch.column("id"), 0
        for w, grams, offset in _sets(utf8(batch.column("text")), shingle):
            for i, (a, b) in enumerate(zip(offset[:-1], offset[1:], strict=True)):
                yield grams[a:b], (ids[at].as_py(), _digest(w.hash[w.offset[i] : w.offset[i + 1]]) if b > a else None, int(b - a))
                at += 1

    def finish(info: list, shared: list[Shared]) -> Iterator[pa.RecordBatch]:
        out = arrow_schema(schema)
        rows: list[tuple] = []
        seen: set[bytes] = set()
        for (i, node, n), (own, tf, df) in zip(info, shared, strict=True):
            row = (i, node, None, None, None, None)
            if node is not None and node not in seen:
                weight = tf * idf(texts, df)
                alone = n - int(tf.sum())
                total = float(weight.sum()) + alone * single
                kinds = [(weight, single)] if weight.sum() >= threshold * total * (1 - 1e-9) else []
                kinds += [(tf, 1.0)] if counts and n - alone >= threshold * n * (1 - 1e-9) else []
                if kinds:
                    named = int.from_bytes(node[:8], "little")
                    names = np.concatenate((mix(own), mix(np.arange(alone, dtype=np.uint64) + np.uint64(named))))
                    bands = [sampler.bands_of(mix(names) if w is tf else names, np.concatenate((w, np.full(alone, each)))) for w, each in kinds]
                    row = (i, node, np.concatenate(bands).view(np.int64), len(own), total, _pack(own, weight, tf, n))
                seen.add(node)
            rows.append(row)
            if len(rows) == 500:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), out, strict=True)], schema=out)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), out, strict=True)], schema=out)

    return meet(rows, items, finish, schema, size=size or 0)


def forest(sets: list[tuple[np.ndarray, np.ndarray, float]], side: np.ndarray, threshold: float, label: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that connect what all links between sets of both sides connect (one side: between all sets).

    Sets of one ``label`` are connected already.
    """
    n, both = len(sets), bool(side.any()) and not side.all()
    total = np.array([s[2] for s in sets])
    label = np.arange(n) if label is None else np.unique(label, return_inverse=True)[1].copy()
    links: list[tuple[int, int]] = []
    gram = np.concatenate([s[0] for s in sets])
    owner = np.repeat(np.arange(n), [len(s[0]) for s in sets])
    weight = np.concatenate([s[1] for s in sets])
    _, gram = np.unique(gram, return_inverse=True)
    many = (np.bincount(gram) > 1)[gram] if len(gram) else np.zeros(0, dtype=bool)
    shared = np.bincount(owner[many], weights=weight[many], minlength=n)
    able = shared >= threshold * total * (1 - 1e-6)
    keep = many & able[owner]
    gram, owner, weight = gram[keep], owner[keep], weight[keep]
    order = np.argsort(gram, kind="stable")
    post_owner, post_weight = owner[order], weight[order]
    size = np.bincount(gram) if len(gram) else np.zeros(0, np.int64)
    first = np.cumsum(size) - size
    begin = np.searchsorted(owner, np.arange(n + 1))
    # every pair of different labels has one set that isn't of the most frequent label, and one on the lesser side
    asked = able & (side == (side.sum() * 2 <= n)) if both else able & (label != np.bincount(label).argmax())
    for i in np.flatnonzero(asked).tolist():
        own, w = gram[begin[i] : begin[i + 1]], weight[begin[i] : begin[i + 1]]
        count = size[own]
        ends = np.cumsum(count)
        if not len(ends):
            continue
        at = np.arange(ends[-1]) + np.repeat(first[own] - ends + count, count)
        common = np.bincount(post_owner[at], weights=np.minimum(post_weight[at], np.repeat(w, count)), minlength=n)
        near = (common >= threshold * (total + total[i] - common)) & (label != label[i])
        if both:
            near &= side != side[i]
        for j in np.flatnonzero(near).tolist():
            if label[j] != label[i]:
                label[label == label[j]] = label[i]
                links.append((i, j))
    return links


_LINK = T.StructType([T.StructField("a", T.BinaryType()), T.StructField("b", T.BinaryType())])


def _link_batch(found: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*found, strict=True)], schema=arrow_schema(_LINK))


def _stars(pairs: DataFrame, sets: DataFrame, threshold: float, counts: bool) -> DataFrame:
    """(a, b): those ``pairs`` (node, hub) that are similar enough; a hub's nodes go in groups of ``STAR``."""
    count = pairs.groupBy("hub").agg(F.ceil(F.count("*") / STAR).cast("int").alias("groups"))
    salted = pairs.join(count, "hub").select("node", "hub", F.pmod(F.xxhash64("node"), F.col("groups")).cast("int").alias("salt"))
    members = salted.join(sets, "node").select("hub", "salt", F.lit(1).alias("kind"), "node", "n", "total", "grams")
    hubs = count.withColumnRenamed("hub", "node").join(sets, "node").select(F.col("node").alias("hub"), F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("salt"), F.lit(0).alias("kind"), "node", "n", "total", "grams")

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, centre = None, None
        for batch in batches:
            found: list[tuple[bytes, bytes]] = []
            for hub, salt, kind, node, n, total, grams in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not kind:
                    now, centre = (hub, salt), _unpack(grams, n, total, counts)
                elif now == (hub, salt) and _alike(centre, _unpack(grams, n, total, counts), threshold):
                    found.append((node, hub))
            if found:
                yield _link_batch(found)

    return map_batches(hubs.union(members).repartition("hub", "salt").sortWithinPartitions("hub", "salt", "kind"), decide, _LINK)


def _rests(rows: DataFrame, sets: DataFrame, threshold: float, counts: bool) -> DataFrame:
    """(a, b): links between the classes of each component; ``rows`` has (node, class, root)."""
    sized = rows.join(sets.select("node", (F.col("n") + SET_COST).cast("long").alias("size")), "node")
    sums = sized.groupBy("root", "class").agg(F.sum("size").alias("size"))
    main = sums.groupBy("root").agg(F.max(F.struct("size", "class")).alias("main"), F.sum("size").alias("all")).select("root", F.col("main.class").alias("main"), F.col("main.size").alias("large"), "all")
    ways = lambda size: F.ceil(size / F.lit(BLOCK_GRAMS)).cast("int")
    small = F.col("all") <= BLOCK_GRAMS
    main = main.select("root", "main", F.when(small, F.lit(1)).otherwise(ways(F.col("all") - F.col("large"))).alias("few"), F.when(small, F.lit(0)).otherwise(ways(F.col("large"))).alias("many"))
    dealt = sized.join(main, "root").withColumn("inner", (F.col("many") > 0) & (F.col("class") == F.col("main")))
    at = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    dealt = dealt.withColumn("own", F.when(F.col("inner"), F.col("few") + at(F.greatest("many", F.lit(1)))).otherwise(at(F.col("few"))))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(F.col("inner"), F.col("few")).otherwise(F.col("few") + F.col("many")) - 1)))
    dealt = dealt.select("node", "class", "root", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).alias("side"))
    made = dealt.join(sets, "node").select("root", "i", "j", "side", "node", "class", "n", "total", "grams")

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple | None = None
        held: list[tuple] = []

        def close() -> Iterator[pa.RecordBatch]:
            name = {c: k for k, c in enumerate(dict.fromkeys(x[2] for x in held))}
            side, label = np.array([x[0] for x in held]), np.array([name[x[2]] for x in held])
            for kind, least in enumerate(_thresholds(threshold)[: 1 + counts]):
                if len(np.unique(label)) > 1:
                    links = forest([x[3][kind] for x in held], side, least, label)
                    for a, b in links:
                        label[label == label[b]] = label[a]
                    if links:
                        yield _link_batch([(held[a][1], held[b][1]) for a, b in links])

        for batch in batches:
            for root, i, j, side, node, own, n, total, grams in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (root, i, j) != now:
                    yield from close()
                    now, held = (root, i, j), []
                held.append((side, node, own, _unpack(grams, n, total, counts)))
        yield from close()

    return map_batches(made.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j", "node"), decide, _LINK)


def classes(
    docs: DataFrame,
    *,
    key: str = "doc_id",
    text: str = "text",
    shingle: int = 5,
    threshold: float = 0.8,
    bands: int = 13,
    rows: int = 4,
    counts: bool = False,
) -> DataFrame:
    """(id, node, root, class_id) for every row of ``docs``; ``node`` is the digest of the text's words.

    Pairs of similar weights are linked, with ``counts`` those of similar counts, too.

    With 13 bands of 4 a pair at a similarity of 0.8 is a candidate with a probability of 0.999.
    """
    signed = stage(signatures(docs, Sampler(bands, rows), key=key, text=text, shingle=shingle, threshold=threshold, counts=counts), "signed")
    sets = stage(signed.where("bands is not null").select("node", "bands", "n", "total", "grams").dropDuplicates(["node"]), "sets")
    ids = stage(signed.select("id", "node"), "ids")
    discard(signed)
    nodes = ids.where("node is not null").groupBy("node").agg(F.min("id").alias("id"))
    members = sets.select("node", F.explode("bands").alias("band"))
    hubs = members.groupBy("band").agg(F.count("*").alias("c"), F.min("node").alias("hub")).where("c > 1").select("band", "hub")
    pairs = stage(members.join(hubs, "band").where("node <> hub").select("node", "hub").distinct(), "pairs")
    stars = components(_stars(pairs, sets, threshold, counts))
    # classes that a band still joins, contracted to one node each
    named = lambda c: stars.select(F.col("node").alias(c), F.col("root").alias(f"{c}_class"))
    open_ = pairs.join(named("node"), "node", "left").join(named("hub"), "hub", "left")
    open_ = open_.select(F.coalesce("node_class", "node").alias("a"), F.coalesce("hub_class", "hub").alias("b")).where("a <> b")
    groups = components(open_).select(F.col("node").alias("class"), "root")
    rests = sets.select("node").join(stars.withColumnRenamed("root", "class"), "node", "left").select("node", F.coalesce("class", "node").alias("class")).join(groups, "class")
    links = _rests(rests, sets, threshold, counts).union(stars.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))
    roots = components(links)
    discard(sets, pairs)
    of_node = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = of_node.groupBy("root").agg(F.min("id").alias("class_id"))
    found = of_node.select("node", "root").join(least, "root").select("node", "root", "class_id")
    out = ids.join(found, "node", "left")
    return out.select("id", "node", F.coalesce("root", "node").alias("root"), F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"))


def keep_one(docs: DataFrame, *, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each class: that with the least id, of several such the least text.

    Rows without words all stay.
    """
    found = classes(docs, key=key, text=text, **options)
    kept = found.where("node is not null and id <=> class_id").groupBy("root").agg(F.min("node").alias("node"), F.min("id").alias("kept_id"))
    named = docs.select(F.struct(*docs.columns).alias("row"), F.col(key).alias("k"), F.col(text).alias("t"))
    rows = _nodes(named, docs)
    chosen = rows.join(kept.select("node", "kept_id"), "node").where(F.col("k").eqNullSafe(F.col("kept_id")))
    one = chosen.groupBy("node").agg(F.min_by("row", F.col("row")[text]).alias("row"))
    return one.select("row.*").unionByName(rows.where("node is null").select("row.*"))


def _nodes(named: DataFrame, docs: DataFrame) -> DataFrame:
    """(row, k, node): every row with the digest of its words."""
    small_batches(docs.sparkSession)
    schema = T.StructType([T.StructField("row", docs.schema), T.StructField("k", named.schema["k"].dataType), T.StructField("node", T.BinaryType())])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = arrow_schema(schema)
        for batch in batches:
            nodes: list[bytes | None] = []
            texts = utf8(batch.column("t"))
            for lo, hi in chunks([len(t or b"") for t in texts], 1 << 20):
                w = Words(texts[lo:hi])
                nodes += [_digest(w.hash[a:b]) if b > a else None for a, b in zip(w.offset[:-1], w.offset[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("row").cast(out.field(0).type), batch.column("k").cast(out.field(1).type), pa.array(nodes, pa.binary())], schema=out)

    return map_batches(named, add, schema)
