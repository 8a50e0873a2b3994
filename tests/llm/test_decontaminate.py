import hashlib
import random
import re

import numpy as np
from sqlquarry.llm import decontaminate, queries

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, n=10):
    windows = {}
    for name, text in items:
        w = brute_words(text)
        for i in range(max(1, len(w) - n + 1) if w else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(name)
    sizes = {len(k) for k in windows}
    out = []
    for key, text in docs:
        w = brute_words(text)
        hit, names = set(), set()
        for size in sizes:
            for i in range(len(w) - size + 1):
                own = windows.get(tuple(w[i : i + size]))
                if own:
                    hit.update(range(i, i + size))
                    names |= own
        digest = hashlib.sha256(",".join(sorted(str(x) for x in names if x is not None)).encode()).hexdigest()
        out.append((key, len(w), len(hit), len(names), digest, bool(hit)))
    return sorted(out, key=str)


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    got = sorted((tuple(r) for r in queries.op4_decontaminate(spark, sf).collect()), key=str)
    assert got == brute(docs, items)
    assert sum(r[5] for r in got) > 0


def test_small_vocabulary_and_blocks(spark):
    rng = random.Random(3)
    text = lambda n: " ".join(rng.choice("ab") + rng.choice(["", "É"]) for _ in range(n))
    docs = [(i, text(rng.randrange(120))) for i in range(40)] + [(50, None), (51, ""), (52, "a a"), (52, "a a"), (None, text(200))]
    items = [(i, text(rng.randrange(1, 14))) for i in range(12)] + [(20, None), (21, "..."), (3, text(8)), (22, "solo"), (None, text(3)), (None, text(12))]
    docs_df = spark.createDataFrame(docs, "doc_id long, text string")
    items_df = spark.createDataFrame(items, "item_id long, text string")
    for size in (8 << 20, 60):
        got = decontaminate.report(docs_df, items_df, block_bytes=size, shard_bytes=500).collect()
        assert sorted((tuple(r) for r in got), key=str) == brute(docs, items)
    none = decontaminate.report(docs_df, items_df.where("false")).collect()
    assert not any(r["contaminated"] for r in none) and len(none) == len(docs)
    assert decontaminate.find(docs_df.where("false"), items_df).count() == 0


def test_item_without_id_and_sql(spark):
    """Null and repeated ids: hits count, the null id has no name, and the SQL says the same."""
    import duckdb

    item = "one two three four five six seven eight nine ten eleven"
    docs = [(1, f"x {item} y"), (2, "solo"), (3, None), (4, f"{item} solo {item}"), (4, f"{item} solo {item}")]
    items = [(None, item), (5, "solo"), (5, "solo"), (6, None)]
    docs_df, items_df = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = sorted((tuple(r) for r in decontaminate.report(docs_df, items_df).collect()), key=str)
    assert got == brute(docs, items)
    assert got[0][2:4] == (11, 1) and got[0][4] == hashlib.sha256(b"").hexdigest() and got[0][5]
    c = duckdb.connect()
    own = docs_df.where("doc_id < 4").toArrow(), items_df.toArrow()  # the SQL takes ids as unique
    c.register("documents", own[0])
    c.register("benchmark", own[1])
    want = c.execute(decontaminate.ORACLE_SQL).fetchall()
    assert sorted(want, key=str) == got[:3]


def test_suffix_array_of_copies():
    rng = random.Random(6)
    for _ in range(30):
        part = [rng.randrange(1, 4) for _ in range(rng.randrange(1, 40))]
        whole = part * rng.randrange(1, 6) + [rng.randrange(1, 70_000) for _ in range(rng.randrange(4))] + [0]
        assert decontaminate.suffix_array(np.array(whole)).tolist() == sorted(range(len(whole)), key=lambda i: whole[i:])


def test_remove(spark):
    item = "one two three four five six seven eight nine ten eleven"
    docs = spark.createDataFrame([(1, f"Before, {item.upper()}! After."), (2, item), (3, "..."), (4, None)], "items long, text string")
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert decontaminate.find(docs, items).columns == ["items", "text", "word_spans", "_items"]
    out = decontaminate.clean(docs, items)
    assert out.columns == docs.columns
    assert {r["items"]: r["text"] for r in out.collect()} == {1: "Before, ! After.", 3: "...", 4: None}


def test_index_parts():
    rng = np.random.default_rng(0)
    text = rng.integers(1, 5, 300)
    order = decontaminate.suffix_array(np.append(text, 0))
    whole = np.append(text, 0).tolist()
    assert order.tolist() == sorted(range(301), key=lambda i: whole[i:])
    index = decontaminate.FMIndex(text, 4)
    for n in (1, 2, 3, 4):
        phrase = text[10 : 10 + n]
        padded = np.concatenate((np.zeros(4 - n, np.int64), phrase))[None]
        lo, hi = index.search(padded, np.array([n]))
        got = sorted(index.locate(np.arange(lo[0], hi[0])).tolist())
        assert got == [i for i in range(300 - n + 1) if text[i : i + n].tolist() == phrase.tolist()]
