"""Whole queries against direct versions, over tables with nulls, empty and long texts, ties and repeated rows."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from sqlquarry.llm import binary_output, quality_classifier, queries, retrieval_packing

from tests.llm.test_language_id import brute_ngrams, code
from tests.llm.test_tokens_and_packing import plain

ODD = [
    (None, "a text without an id, in English words that stand here", "en"),
    (9001, None, "en"),
    (9002, "", None),
    (9003, "... 12 !!", "fr"),
    (9004, "tie tie eit", "en"),
    (9004, "tie tie eit", "en"),
    (9005, "long words stand here " * 4000, None),
    (9006, "日本語 テキスト", None),
]


def fold(key, n):
    return zlib.crc32(str(key).encode()) % n if key is not None else None


@pytest.fixture(scope="module")
def folder(spark, sf, tmp_path_factory):
    """A folder with ``documents`` (and a clashing column), whose rows are all kinds."""
    path = str(tmp_path_factory.mktemp("odd"))
    own = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    docs = own.union(spark.createDataFrame(ODD, "doc_id long, text string, lang string"))
    docs.selectExpr("*", "'x' AS score", "1 AS held_out_", "2 AS n_tokens").coalesce(1).write.parquet(f"{path}/documents.parquet")
    spark.read.parquet(f"{sf}/labels.parquet").write.parquet(f"{path}/labels.parquet")
    return path


@pytest.fixture(scope="module")
def rows(spark, folder):
    return [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "lang").collect()]


def test_language_query(spark, folder, rows):
    counts = defaultdict(Counter)
    for key, text, lang in rows:
        if lang is not None and fold(key, 3) != 1:
            counts[lang].update(brute_ngrams(text))
    ranked = {}
    for lang, c in counts.items():
        if c:
            ranked[lang] = {g: r for r, g in enumerate(sorted(c, key=lambda g: (-c[g], code(g)))[:400])}
    want = []
    for key, text, _ in rows:
        c = brute_ngrams(text)
        top = sorted(c, key=lambda g: (-c[g], code(g)))[:400]
        away = {lang: sum(abs(i - r[g]) if g in r else 400 for i, g in enumerate(top)) for lang, r in ranked.items()}
        best = min(sorted(away), key=away.get) if top else "und"
        want.append((key, fold(key, 3) == 1, best, round(1 - away[best] / (len(top) * 400), 9) if top else 0.0))
    got = [(r["doc_id"], r["held_out"], r["lang_pred"], round(r["score"], 9)) for r in queries.op8_language_id(spark, folder).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert {w[2] for w in want} >= {"en", "und"}


def test_quality_query_scores_every_row(spark, folder, rows):
    got = queries.op5_quality(spark, folder).collect()
    assert sorted((r["doc_id"] for r in got), key=str) == sorted((r[0] for r in rows), key=str)
    assert all(r["held_out"] == (fold(r["doc_id"], 5) == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    blank = {round(r["score"], 12) for r in got if r["doc_id"] in (9001, 9002)}
    assert len(blank) == 1


def test_log_count_ratios():
    """The scale of each feature from counts made here, and the margin from the weights."""
    rng = np.random.default_rng(1)
    rows = [np.sort(rng.choice(12, 4, replace=False)) for _ in range(60)]
    labels = np.array([int(3 in r) for r in rows])
    model = quality_classifier.train(rows, labels)
    n = 1 << quality_classifier.BITS
    up = [1 + sum(f in r for r, y in zip(rows, labels, strict=True) if y) for f in range(12)]
    down = [1 + sum(f in r for r, y in zip(rows, labels, strict=True) if not y) for f in range(12)]
    for f in range(12):
        ratio = math.log(up[f] / (sum(up) + n - 12)) - math.log(down[f] / (sum(down) + n - 12))
        assert abs(model.scale[f] - ratio) < 1e-9
    v = model.scale[rows[0]]
    assert abs(model.margin(rows[0]) - ((model.weights[rows[0]] * v).sum() / math.sqrt((v * v).sum()) + model.weights[-1])) < 1e-12


def test_dual_descent_reaches_the_least_objective():
    """The primal objective of the weights against plain subgradient descent from many steps."""
    rng = np.random.default_rng(5)
    rows = [np.sort(rng.choice(8, 3, replace=False)) for _ in range(40)]
    scale = rng.uniform(0.5, 2, 8)
    y = np.where(rng.random(40) < 0.5, 1.0, -1.0)
    x = np.zeros((40, 9))
    for i, r in enumerate(rows):
        x[i, r] = scale[r] / np.sqrt((scale[r] ** 2).sum())
    x[:, 8] = 1
    value = lambda w: 0.5 * w @ w + np.maximum(0, 1 - y * (x @ w)).sum()
    found = quality_classifier.dual_descent(rows, scale, y, 1.0, 500)
    w, best = np.zeros(9), math.inf
    for t in range(1, 20_001):
        w = w - (w - x.T @ (y * (y * (x @ w) < 1))) / t
        best = min(best, value(w))
    assert value(found) <= best * 1.01


def brute_fit(lengths, room):
    """Best fit decreasing by looking at every open sequence."""
    left: list[int] = []
    for n in sorted(lengths, reverse=True):
        fits = [k for k, r in enumerate(left) if r >= n]
        if fits:
            left[min(fits, key=lambda k: left[k])] -= n
        else:
            left.append(room - n)
    return sorted(room - r for r in left)


def test_binary_query(spark, folder, rows):
    got = queries.op10_binary_output(spark, folder).collect()
    lengths = [n for _, text, _ in rows for size in [len(plain(text))] for s in range(0, size, 4096) for n in [min(4096, size - s)]]
    assert sorted(r["n_tokens"] for r in got) == brute_fit(lengths, 4096)
    ids = binary_output.matrix(got)
    pieces = Counter()
    for row, r in zip(ids, got, strict=True):
        assert not row[r["n_tokens"] :].any() and len(row) == 4096
        for d, s, a, b in zip(r["doc_ids"], r["doc_starts"], r["cu_seqlens"], r["cu_seqlens"][1:], strict=False):
            pieces[d, s, tuple(row[a:b].tolist())] += 1
    want = Counter((d, s, tuple(plain(text)[s : s + 4096])) for d, text, _ in rows for s in range(0, len(plain(text)), 4096))
    assert pieces == want


def test_packing_query(spark, folder, rows):
    """Every id of every row once, repeated rows as often as they come, full windows but for the last."""
    got = queries.op6_retrieval_packing(spark, folder).collect()
    want = Counter()
    for key, text, _ in rows:
        want[key, len(plain(text))] += len(plain(text))
    have = Counter()
    room = Counter()
    for r in got:
        have[r["doc_id"], r["doc_tokens"]] += r["length"]
        room[r["sequence_id"]] += r["length"]
    assert have == want
    total = sum(room.values())
    assert sorted(room.values(), reverse=True) == [4096] * (total // 4096) + [1 << b for b in range(11, -1, -1) if total % 4096 >> b & 1]
    assert retrieval_packing.pack(spark.createDataFrame([(1, "a b", 2)], "length long, text string, start int"), key="length").columns[0] == "length"


def test_near_dedup_with_long_and_tied_texts(spark):
    from sqlquarry.llm import near_dedup

    long = " ".join(f"w{i % 5000}" for i in range(60_000))
    rows = [(5, long, 1), (6, long + " end", 1), (7, "x " * 30_000, 1), (8, "x " * 30_000, 1), (7, "x " * 30_000, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, class_id int")
    got = sorted((r["id"], r["class_id"]) for r in near_dedup.classes(docs).collect())
    assert got == [(5, 5), (6, 5), (7, 7), (7, 7), (8, 7)]
    assert sorted(r["doc_id"] for r in near_dedup.keep_one(docs).collect()) == [5, 7]
