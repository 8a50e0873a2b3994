import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F
from sqlquarry.llm import chat_rotation, sharding

from tests.oracle import assert_same


@pytest.mark.parametrize("name", ["op1_sharding", "op2_chat_rotation", "op4_decontaminate"])
@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_against_sql(spark, name, size):
    assert_same(spark, name, f"/root/testdata/{size}")


def brute_shards(rows, limit):
    """Split too large buckets bit by bit."""
    import hashlib

    h = [int(hashlib.md5(str(k).encode() if k is not None else b"").hexdigest()[:15], 16) for k, _ in rows]
    out = {}

    def split(own, depth):
        if depth == 60 or len(own) == 1 or sum(len((rows[i][1] or "").encode()) for i in own) <= limit:
            for i in own:
                out[i] = (depth, h[i] >> (60 - depth))
            return
        for bit in (0, 1):
            part = [i for i in own if (h[i] >> (59 - depth)) & 1 == bit]
            if part:
                split(part, depth + 1)

    split(list(range(len(rows))), 0)
    return sorted(((*rows[i], *out[i]) for i in out), key=str)


def test_small_limit_and_repeated_keys(spark):
    rng = random.Random(2)
    rows = [(i, "x" * rng.randrange(40)) for i in range(300)] + [(7, "repeated")] * 50 + [(None, "null key"), (400, None), (401, "y" * 900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("page", F.lit("mine"))
    out = sharding.shard(docs, limit=100)
    assert out.columns == ["doc_id", "text", "page", "n_bytes", "depth", "prefix", "_page"]
    got = out.collect()
    assert sorted(((r["doc_id"], r["text"], r["depth"], r["prefix"]) for r in got), key=str) == brute_shards(rows, 100)
    size, number = defaultdict(int), defaultdict(int)
    for r in got:
        size[r["depth"], r["prefix"], r["_page"]] += r["n_bytes"]
        number[r["depth"], r["prefix"], r["_page"]] += 1
    assert all(n <= 100 or number[k] == 1 for k, n in size.items())
    slots = sharding.directory(out.where("depth < 60")).collect()
    assert len({r["slot"] for r in slots}) == len(slots)


@pytest.mark.parametrize(("sizes", "least"), [([10] * 50 + [150], 6), ([10] * 2000 + [99], 201), ([1] * 3000 + [60] * 40 + [30] * 90, 100)])
def test_overflow_pages_are_few_and_numbered(spark, sizes, least):
    rows = [(5, "x" * n) for n in sizes]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), limit=100).collect()
    pages = defaultdict(list)
    for r in got:
        pages[r["page"]].append(r["n_bytes"])
    assert sorted(n for p in pages.values() for n in p) == sorted(sizes)
    assert all(sum(p) <= 100 or len(p) == 1 for p in pages.values())
    assert sorted(pages) == list(range(len(pages)))
    assert least <= len(pages) <= 1.1 * least + 2


def test_empty_tables(spark):
    assert sharding.shard(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert chat_rotation.rotate(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def brute_chat(turns):
    mark = lambda t: (t or "").replace("<|im_", "< |im_")
    out = {}
    for c in {r[0] for r in turns}:
        own = sorted((r for r in turns if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", mark(r[3])))
        for me in {r[2] for r in own} - {None, "system"}:
            text, mask = "", []
            for _, _, who, said in own:
                name = "assistant" if who == me else "system" if who == "system" else "user name=" + (mark(who) if who is not None else "unknown").replace("\n", " ")
                text += f"<|im_start|>{name}\n"
                if who == me:
                    mask.append((len(text), len(text) + len(mark(said)) + 10))
                text += f"{mark(said)}<|im_end|>\n"
            out[c, me] = (text, mask)
    return out


def test_segments_count_turns_not_numbers(spark):
    turns = [(1, 300 * i, ("ann", "bob")[i % 2], f"t{i}") for i in range(20)] + [(2, i * 7, "ann", f"u{i}") for i in range(600)]
    got = chat_rotation.rotate(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).collect()
    assert sorted((r["conv_id"], r["perspective"], r["segment"], r["n_turns"]) for r in got) == [(1, "ann", 0, 20), (1, "bob", 0, 20), (2, "ann", 0, 256), (2, "ann", 1, 256), (2, "ann", 2, 88)]


def test_rotation_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(chat_rotation, "GROUP", 2)
    turns = [(1, 0, "system", "Be <|im_start|> nice"), (1, 1, "ann", "hé"), (1, 2, "bob", None), (1, 2, "bob", None), (1, 3, None, "who?"), (1, None, "ann", "first"), (1, 4, "c\nd", "")]
    turns += [(None, 1, "x", "y"), (2, 1, "system", "alone"), (3, 10**12, "late", "z")] + [(4, i % 700, ("ann", "bob", "cy")[i % 3], f"t{i}") for i in range(2000)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    found = defaultdict(list)
    for r in chat_rotation.rotate(df).collect():
        found[r["conv_id"], r["perspective"]].append(r)
        assert r["n_turns"] <= chat_rotation.SEGMENT
    want = brute_chat(turns)
    assert set(found) == set(want)
    for key, rows in found.items():
        rows.sort(key=lambda r: r["segment"])
        assert [r["segment"] for r in rows] == list(range(len(rows)))
        text, mask = "", []
        for r in rows:
            assert r["first_char"] == len(text)
            mask += [(len(text) + m["start"], len(text) + m["end"]) for m in r["mask"]]
            text += r["text"]
        assert (text, mask) == want[key]
