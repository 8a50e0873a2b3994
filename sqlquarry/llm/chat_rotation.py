"""Multi-party perspective rotation of dialogues, in DataFrame operations only.

Every participant of a conversation (each speaker but ``system``) gets a rendering of the whole dialogue in which
they are the assistant, the others are users with their names, and system turns stay; only what the assistant says,
with its end mark, is to be learnt.  Masks are half-open ranges of characters.

A long dialogue comes in segments of ``SEGMENT`` turns, the last one with the rest, so no row grows without bound:
segments are numbered from 0, ``first_char`` is where a segment begins in the whole rendering, and masks count from
there.  Turns are in order of number, then speaker, then text.  A turn's place is its place among the turns of a range
of numbers plus the count of those before, so a long dialogue is sorted by many tasks; what is added up over a whole
dialogue are counts and lengths, never texts, and segments meet the participants in groups of ``GROUP``.

Defined results: a null text is empty; a null speaker is a user named ``unknown`` and no participant; a null turn
comes first; null conversation ids are one conversation; repeated rows are repeated turns; a conversation without a
participant has no rendering.  Marks within texts and names are broken up, line ends in names are blanks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEGMENT, GROUP = 256, 64
_OPEN, _CLOSE = "<|im_start|>", "<|im_end|>"


def _plain(text: Column) -> Column:
    return F.replace(text, F.lit("<|im_"), F.lit("< |im_"))


def rotate(turns: DataFrame, *, conversation: str = "conv_id", turn: str = "turn", speaker: str = "role", text: str = "text", system: str = "system") -> DataFrame:
    """(conversation, perspective, segment, n_turns, first_char, text, mask) for every participant and segment."""
    rows = turns.select(
        F.col(conversation).alias("c"),
        F.col(turn).cast("long").alias("t"),
        F.col(speaker).alias("s"),
        _plain(F.coalesce(F.col(text), F.lit(""))).alias("x"),
    ).withColumn("block", F.coalesce(F.floor(F.col("t") / SEGMENT), F.lit(-(1 << 60))))
    before = Window.partitionBy("k").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy(F.col("c").alias("k"), F.col("block").alias("b")).agg(F.count("*").alias("n"))
    blocks = blocks.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("all", F.sum("n").over(Window.partitionBy("k")))
    place = F.row_number().over(Window.partitionBy("c", "block").orderBy("t", "s", "x"))
    rows = rows.withColumn("place", place).join(blocks, F.col("c").eqNullSafe(F.col("k")) & (F.col("block") == F.col("b")))
    rows = rows.withColumn("segment", F.floor((F.col("first") + F.col("place") - 1) / SEGMENT)).withColumn("last", F.floor((F.col("all") - 1) / SEGMENT)).drop("k")
    segments = rows.groupBy("c", "segment", "last").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("t", F.lit(-(1 << 62))).alias("t"), F.coalesce("s", F.lit("")).alias("o"), "x", "s"))).alias("turns"))
    people = rows.where(F.col("s").isNotNull() & (F.col("s") != system)).groupBy(F.col("c").alias("k"), F.col("s").alias("me")).agg(F.max("last").alias("l"))
    people = people.select("k", "me", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("l") / GROUP))).alias("g"))
    both = segments.join(people, F.col("c").eqNullSafe(F.col("k")) & (F.floor(F.col("segment") / GROUP) == F.col("g")))

    def head(t: Column) -> Column:
        name = F.replace(_plain(F.coalesce(t["s"], F.lit("unknown"))), F.lit("\n"), F.lit(" "))
        who = F.when(t["s"] == F.col("me"), "assistant").when(t["s"] == system, "system").otherwise(F.concat(F.lit("user name="), name))
        return F.concat(F.lit(_OPEN), who, F.lit("\n"))

    made = both.withColumn("pieces", F.transform("turns", lambda t: F.struct(head(t).alias("head"), F.concat(t["x"], F.lit(_CLOSE)).alias("body"), F.coalesce(t["s"] == F.col("me"), F.lit(False)).alias("mine"))))
    made = made.withColumn("size", F.transform("pieces", lambda p: F.length(p["head"]) + F.length(p["body"]) + 1))
    begin = lambda i: F.aggregate(F.slice("size", F.lit(1), i), F.lit(0), lambda a, n: a + n)
    spans = F.transform("pieces", lambda p, i: F.struct(p["mine"].alias("mine"), (begin(i) + F.length(p["head"])).alias("start"), (begin(i) + F.length(p["head"]) + F.length(p["body"])).alias("end")))
    mask = F.transform(F.filter(spans, lambda m: m["mine"]), lambda m: F.struct(m["start"], m["end"]))
    made = made.select(
        F.col("c").alias(conversation),
        F.col("me").alias("perspective"),
        "segment",
        "last",
        F.size("turns").cast("long").alias("n_turns"),
        F.aggregate("size", F.lit(0).cast("long"), lambda a, n: a + n).alias("chars"),
        F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"], F.lit("\n"))), "").alias("text"),
        mask.alias("mask"),
    )
    order = Window.partitionBy("k", "p").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    several = made.where(F.col("last") > 0).select(F.col(conversation).alias("k"), F.col("perspective").alias("p"), F.col("segment").alias("g"), "chars")
    several = several.select("k", "p", "g", F.sum("chars").over(order).alias("before"))
    at = F.col(conversation).eqNullSafe(F.col("k")) & (F.col("perspective") == F.col("p")) & (F.col("segment") == F.col("g"))
    made = made.join(several, at, "left")
    return made.select(conversation, "perspective", F.col("segment").cast("long").alias("segment"), "n_turns", F.coalesce("before", F.lit(0)).cast("long").alias("first_char"), "text", "mask")


def digest(found: DataFrame) -> DataFrame:
    """``rotate``'s result with the mask as text: start-end, comma-joined."""
    text = F.array_join(F.transform("mask", lambda m: F.concat(m["start"].cast("string"), F.lit("-"), m["end"].cast("string"))), ",")
    return found.withColumn("mask", text)


#: For conversations of one segment, as all test tables have.
ORACLE_SQL = """
WITH turns AS (
  SELECT conv_id, turn, role, replace(coalesce(text, ''), '<|im_', '< |im_') AS x FROM conversations
), people AS (
  SELECT DISTINCT conv_id, role AS me FROM turns WHERE role IS NOT NULL AND role <> 'system'
), pieces AS (
  SELECT p.conv_id, p.me, t.turn, t.role, t.x, coalesce(t.role = p.me, FALSE) AS mine,
         '<|im_start|>' || CASE WHEN t.role = p.me THEN 'assistant' WHEN t.role = 'system' THEN 'system'
           ELSE 'user name=' || replace(replace(coalesce(t.role, 'unknown'), '<|im_', '< |im_'), chr(10), ' ') END
           || chr(10) AS head,
         t.x || '<|im_end|>' AS body
  FROM people p JOIN turns t ON t.conv_id IS NOT DISTINCT FROM p.conv_id
), placed AS (
  SELECT *, coalesce(sum(length(head) + length(body) + 1) OVER (
    PARTITION BY conv_id, me ORDER BY turn NULLS FIRST, coalesce(role, ''), x
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM pieces
)
SELECT conv_id, me AS perspective, 0::BIGINT AS segment, count(*)::BIGINT AS n_turns, 0::BIGINT AS first_char,
       string_agg(head || body || chr(10), '' ORDER BY before) AS text,
       coalesce(string_agg(CASE WHEN mine THEN (before + length(head))::VARCHAR || '-'
         || (before + length(head) + length(body))::VARCHAR END, ',' ORDER BY before), '') AS mask
FROM placed GROUP BY conv_id, me
"""
