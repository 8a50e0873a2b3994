"""Sharding by extendible hashing, in DataFrame operations only.

A row's key is hashed to 60 bits.  A directory is indexed by the leading bits; a bucket whose rows are more than
``limit`` bytes splits on one more bit, and only such a bucket does, until every bucket fits or holds one row.  So a row's bucket
is the shortest prefix of its hash whose bytes fit, which one pass over sums by prefix gives for all rows: cells of
a fine prefix are summed, their sums rolled up to all shorter prefixes, and the first that fits is taken.  Only
rows of cells that are still too large go on to finer cells.

Rows whose whole hash is equal (one key repeated) can't be told apart by bits.  They go on overflow pages of the
bucket, numbered from 0; a page holds more than ``limit`` bytes only if one row alone does.

Cells grow with the number of shards, not of rows; they are joined to rows by the cell, so no side needs to be
broadcast (Spark may, by its size).

Defined results: a null key hashes like the empty text; a null text has no bytes; repeated rows share a bucket
or its pages; an empty table gives no shard.  Columns with clashing names are kept, ours get a leading underscore.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import fresh, stage

BITS = 60
#: Cells that a shard's bytes are dealt to, as a power of two.
_FINE = 6
#: Pages of a part of the rows of one hash; rows of which at least ``_MANY`` fit a page are paged by their sum.
_PART, _MANY = 256, 64


def key_hash(*keys: str) -> Column:
    """60 bits of a digest of the keys, as a number that any SQL engine can compute."""
    text = F.concat_ws("\x1f", *(F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, BITS // 4), 16, 10).cast("long")


def prefix(h: Column | str, depth: Column | int) -> Column:
    """The leading ``depth`` bits of a hash."""
    h = F.col(h) if isinstance(h, str) else h
    if isinstance(depth, int):
        return F.shiftright(h, BITS - depth)
    return F.call_function("shiftright", h, (F.lit(BITS) - depth).cast("int"))


def buckets(rows: DataFrame, limit: int) -> DataFrame:
    """(cell, at, depth, prefix): the bucket of each cell of hashes, ``at`` being the cell's own depth.

    ``rows`` has (h, bytes).  Cells whose whole hash is equal may be too large; they have depth 60.
    """
    total = rows.agg(F.sum("bytes")).first()[0] or 0
    at, start, out = min(BITS, max(1, math.ceil(math.log2(max(1, total / limit))) + _FINE)), 0, None
    while True:
        cells = stage(rows.groupBy(prefix("h", at).alias("cell")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n")), "cells")
        depths = F.sequence(F.lit(start), F.lit(at))
        wide = cells.withColumn("depth", F.explode(depths)).withColumn("prefix", F.call_function("shiftright", F.col("cell"), (F.lit(at) - F.col("depth")).cast("int")))
        sums = wide.groupBy("depth", "prefix").agg(F.sum("bytes").alias("sum"), F.sum("n").alias("rows"))
        fits = (F.col("sum") <= limit) | (F.col("rows") == 1) | (F.col("depth") == BITS)
        own = wide.join(sums.where(fits), ["depth", "prefix"]).groupBy("cell").agg(F.min("depth").alias("depth"))
        own = own.select("cell", F.lit(at).alias("at"), "depth", F.call_function("shiftright", F.col("cell"), (F.lit(at) - F.col("depth")).cast("int")).alias("prefix"))
        out = own if out is None else out.union(own)
        if at == BITS:
            return out
        large = cells.where((F.col("bytes") > limit) & (F.col("n") > 1)).select("cell")
        if large.isEmpty():
            return out
        rows = rows.withColumn("cell", prefix("h", at)).join(large, "cell", "left_semi").drop("cell")
        start, at = at + 1, min(BITS, at + 12)


def shard(docs: DataFrame, *, keys: tuple[str, ...] = ("doc_id",), text: str = "text", limit: int = 1 << 20, names: tuple[str, str, str, str] = ("n_bytes", "depth", "prefix", "page")) -> DataFrame:
    """``docs`` with each row's bytes and its shard: the bucket's depth and prefix, and the page within it."""
    n_bytes, depth, bits, page = fresh(docs, *names)
    wide = docs.select(F.struct(*docs.columns).alias("row"), key_hash(*keys).alias("h"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("bytes"))
    found = stage(buckets(wide.select("h", "bytes"), limit), "buckets")
    levels = sorted(r["at"] for r in found.select("at").distinct().collect())
    placed = wide
    for i, at in enumerate(levels):
        own = found.where(F.col("at") == at).select(F.col("cell").alias("c"), F.col("depth").alias(f"d{i}"), F.col("prefix").alias(f"p{i}"))
        placed = placed.join(own, prefix("h", at) == F.col("c"), "left").drop("c")
    last = range(len(levels))
    placed = placed.withColumn("d", F.coalesce(*(f"d{i}" for i in last)) if levels else F.lit(0)).withColumn("p", F.coalesce(*(f"p{i}" for i in last)) if levels else F.lit(0).cast("long"))
    full = found.where(F.col("depth") == BITS)
    out = placed.withColumn("g", F.lit(0).cast("long"))
    if not full.isEmpty():
        out = placed.where(F.col("d") != BITS).withColumn("g", F.lit(0).cast("long")).unionByName(_pages(placed.where(F.col("d") == BITS), limit, text))
    return out.select("row.*", F.col("bytes").alias(n_bytes), F.col("d").cast("int").alias(depth), F.col("p").alias(bits), F.col("g").alias(page))


def _pages(rows: DataFrame, limit: int, text: str) -> DataFrame:
    """Overflow pages: the rows of one hash, dealt to parts of about ``_PART`` pages, by how many fit a page.

    Rows of which k fit a page, but not k + 1, go k to a page, up to ``_MANY``; smaller ones by their running sum, cut
    every ``limit`` less the largest of them.  So no page of several rows is larger than ``limit``, each part and kind
    has one page at most that is less than half full, and pages of one hash are numbered without gaps.
    """
    sums = rows.groupBy("h").agg(F.ceil(F.sum("bytes") / F.lit(_PART * limit)).cast("int").alias("ways"))
    dealt = rows.withColumn("x", F.xxhash64(F.col("row")[text])).join(sums, "h")
    dealt = dealt.withColumn("part", F.pmod(F.hash("x", F.monotonically_increasing_id()), F.greatest("ways", F.lit(1))))
    dealt = dealt.withColumn("k", F.least(F.floor(F.lit(limit) / F.greatest("bytes", F.lit(1))), F.lit(_MANY)).cast("int")).withColumn("k", F.greatest("k", F.lit(1)))
    parts = stage(dealt.drop("ways"), "overflow")
    order = Window.partitionBy("h", "part", "k").orderBy("x")
    run = F.sum("bytes").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("bytes")
    step = F.lit(limit) - F.lit(limit // _MANY) + 1
    own = parts.withColumn("g", F.when(F.col("k") < _MANY, F.floor((F.row_number().over(order) - 1) / F.col("k"))).otherwise(F.floor(run / step)).cast("long"))
    count = own.groupBy("h", "part", "k").agg((F.max("g") + 1).alias("n"))
    before = Window.partitionBy("h").orderBy("part", "k").rowsBetween(Window.unboundedPreceding, -1)
    first = count.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    own = own.join(first, ["h", "part", "k"])
    return own.withColumn("g", (F.col("g") + F.col("first")).cast("long")).drop("part", "k", "x", "first")


def directory(found: DataFrame) -> DataFrame:
    """(slot, depth, prefix): the directory of the distinct buckets of ``shard``, a slot for each value of the
    leading bits of the deepest bucket."""
    own = found.select("depth", "prefix").distinct()
    deepest = own.agg(F.max("depth")).first()[0] or 0
    wide = own.withColumn("more", (F.lit(deepest) - F.col("depth")).cast("int"))
    first = F.call_function("shiftleft", F.col("prefix"), F.col("more"))
    size = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("more"))
    return wide.select(F.explode(F.sequence(first, first + size - 1)).alias("slot"), "depth", "prefix")


ORACLE_SQL = """
WITH docs AS (
  SELECT doc_id, coalesce(octet_length(encode(text)), 0) AS n_bytes,
         ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15))::BIGINT AS h
  FROM documents
), wide AS (
  SELECT doc_id, n_bytes, h, d.depth::INTEGER AS depth, (h >> (60 - d.depth::INTEGER)) AS prefix
  FROM docs, (SELECT unnest(range(0, 61)) AS depth) d
), sums AS (
  SELECT depth, prefix, sum(n_bytes) AS total, count(*) AS n FROM wide GROUP BY depth, prefix
), own AS (
  SELECT w.doc_id, w.n_bytes, w.depth, w.prefix,
         row_number() OVER (PARTITION BY w.doc_id ORDER BY w.depth) AS r
  FROM wide w JOIN sums s ON w.depth = s.depth AND w.prefix = s.prefix
  WHERE s.total <= 1048576 OR s.n = 1
)
SELECT doc_id, n_bytes::BIGINT AS n_bytes, depth, prefix::BIGINT AS prefix, 0::BIGINT AS page
FROM own WHERE r = 1
"""
