import hashlib
import random

import numpy as np
import pytest
from sqlquarry.llm import _meet, suffix_dedup
from sqlquarry.llm._suffixes import Strings, common_prefix, deep_shallow


def brute(rows, n=100):
    """Every byte covered by an n-byte string that starts earlier, with a set of all strings seen."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, hashlib.sha256((rows[i][1] or "").encode()).hexdigest()[:15]))
    seen, out = set(), []
    for i in order:
        raw = (rows[i][1] or "").encode()
        gone = bytearray(len(raw))
        for s in range(len(raw) - n + 1):
            own = raw[s : s + n]
            if own in seen:
                gone[s : s + n] = b"\1" * n
            else:
                seen.add(own)
        spans = sum(1 for k in range(len(raw)) if gone[k] and (k == 0 or not gone[k - 1]))
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        out.append((rows[i][0], len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted((tuple(r) for r in suffix_dedup.report(suffix_dedup.repeats(docs)).collect()), key=str)


def test_synthetic_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    want = brute(rows)
    assert run(spark, rows) == want
    assert sum(r[2] for r in want) > 0


def test_hard_texts(spark):
    rng = random.Random(4)
    text = lambda n, a="ab cdé\0": "".join(rng.choice(a) for _ in range(n))
    passage, line = text(300), text(40)
    rows = [(i, text(rng.randrange(400))) for i in range(10)]
    rows += [(20 + i, text(rng.randrange(90)) + passage[rng.randrange(60) : rng.randrange(150, 300)] + text(rng.randrange(90))) for i in range(40)]
    rows += [(70, "a" * 700), (71, "b" + "a" * 99), (72, "a" * 99), (73, "ab" * 300), (74, "x" + "ab" * 120), (75, (line + "\n") * 30), (76, line * 5)]
    rows += [(80, passage * 3), (81, passage), (81, passage), (82, passage), (None, passage), (None, None), (83, ""), (84, "short"), (84, "short"), (85, passage + "1"), (85, passage + "2")]
    rows += [(90 + i, text(120, "a") + text(i % 7, "ab") + text(100, "a")) for i in range(12)]
    assert run(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert run(spark, []) == []
    docs = spark.createDataFrame([], "doc_id long, text string, row int")
    assert suffix_dedup.remove(docs).columns == docs.columns


def test_remove(spark):
    rng = random.Random(1)
    text = lambda n: "".join(rng.choice("abcdefghijklmnop éà") for _ in range(n))
    p = "é" * 3 + text(200)
    rows = [(1, p, 5), (2, "own start " + p, 6), (3, p, 7), (1, p, 5), (4, None, 8), (5, "tiny", 9), (5, "tiny", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sha int")
    out = suffix_dedup.remove(docs)
    assert out.columns == docs.columns
    assert sorted((tuple(r) for r in out.collect()), key=str) == sorted([(1, p, 5), (2, "own start ", 6), (4, None, 8), (5, "tiny", 9), (5, "tiny", 9)], key=str)


@pytest.mark.parametrize("symbols", [1, 2, 4])
def test_deep_shallow(symbols):
    rng = random.Random(7)
    for alphabet in (b"\0a", b"abc"):
        for _ in range(40):
            strings = [bytes(rng.choice(alphabet) for _ in range(rng.randrange(30))) for _ in range(rng.randrange(1, 60))]
            strings += [b"\0\0\0prefix" * 2 + s for s in strings[:20]]
            order, lcp = deep_shallow(Strings.of(strings), symbols)
            got = [strings[i] for i in order]
            assert got == sorted(strings) and sorted(order.tolist()) == list(range(len(strings)))
            for k in range(1, len(got)):
                assert lcp[k] == common_prefix(got[k - 1], got[k])
                assert got[k] != got[k - 1] or order[k] > order[k - 1]


def test_hot_line_and_small_blocks(spark, monkeypatch):
    """A line in many contexts and many copies, with every bound so low that it acts."""
    rng = random.Random(3)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    line, whole = text(140), text(400)
    rows = [(i, text(rng.randrange(20)) + line + text(rng.randrange(60))) for i in range(300)] + [(400 + i, whole) for i in range(60)]
    want = brute(rows)
    for name, value in (("HOT", 50), ("BLOCK", 64), ("BLOCK_BYTES", 4000)):
        monkeypatch.setattr(suffix_dedup, name, value)
    monkeypatch.setattr(_meet, "BLOCK_ITEMS", 100)
    assert run(spark, rows) == want


def test_sorting_decides(spark, monkeypatch):
    """Without the order nothing but further copies of a row goes."""
    rng = random.Random(3)
    p = "".join(rng.choice("abcdefgh ") for _ in range(300))
    rows = [(1, p), (2, p), (3, p + "!"), (4, "x" + p)]
    assert sum(r[2] for r in run(spark, rows)) > 800
    data, anchor = p.encode() * 2, np.array([100, 400])
    found = suffix_dedup.repeated_offsets(data, anchor, np.array([5, 5]), np.array([60, 60]), 100)
    assert not found[0].any() and found[1].sum() == 56
    monkeypatch.setattr(suffix_dedup, "deep_shallow", lambda strings, symbols: (np.arange(len(strings.start)), np.zeros(len(strings.start), np.int64)))
    assert not suffix_dedup.repeated_offsets(data, anchor, np.array([5, 5]), np.array([60, 60]), 100).any()
    monkeypatch.setattr(suffix_dedup, "repeated_offsets", lambda data, anchor, low, high, length: np.zeros((len(anchor), length - 31), dtype=bool))
    assert sum(r[2] for r in run(spark, rows)) == 0


def test_anchors_are_shared():
    rng = np.random.default_rng(0)
    a = bytes(rng.integers(97, 100, 500, dtype=np.uint8))
    b = bytes(rng.integers(97, 100, 57, dtype=np.uint8)) + a[130:330]
    found = list(suffix_dedup.anchors([a, b], 100))
    of = [{s: (h, m - s) for h, m, lo, hi in zip(*(x.tolist() for x in f), strict=True) for s in range(lo, hi + 1)} for f in found]
    assert set(of[0]) == set(range(401)) and set(of[1]) == set(range(len(b) - 99))
    for s in range(130, 231):
        assert of[0][s] == of[1][s - 130 + 57]
