import math
import random

import numpy as np
from pyspark.sql import functions as F
from sqlquarry.llm import nearest_neighbours, quality_classifier, queries

SF = "/root/testdata/sf0.1"


def test_held_out_quality(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = queries.op5_quality(spark, SF).join(labels, "doc_id").where("held_out").collect()
    assert len(rows) > 500
    assert sum(r["predicted"] == r["quality"] for r in rows) / len(rows) > 0.98
    bad, good = ([r["score"] for r in rows if r["quality"] == q] for q in (0, 1))
    assert np.mean([[a < b for b in good] for a in bad]) > 0.99


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, None, 0.5), (2, "", 0.5), (3, "a", 0.5), (3, "a", 0.5), (None, "word", 0.5), (4, "x" * 50_000, 0.5)], "doc_id long, text string, score double")
    none = spark.createDataFrame([], "doc_id long, quality int")
    out = quality_classifier.score(docs, quality_classifier.fit(docs, none))
    assert out.columns == ["doc_id", "text", "score", "_score"]
    assert [r["_score"] for r in out.collect()] == [0.5] * 6
    one = spark.createDataFrame([(1, 1), (2, None), (3, 1), (None, 0)], "doc_id long, quality int")
    assert all(r["_score"] > 0.99 for r in quality_classifier.score(docs, quality_classifier.fit(docs, one)).collect())
    both = spark.createDataFrame([(1, 1), (3, 1), (3, 0), (2, 0)], "doc_id long, quality int")
    assert all(0 <= r["_score"] <= 1 for r in quality_classifier.score(docs, quality_classifier.fit(docs, both)).collect())
    assert quality_classifier.score(docs.where("false"), quality_classifier.fit(docs, both)).count() == 0


def test_one_id_does_not_crowd_out_others(spark):
    rng = random.Random(4)
    hot = [(1, " ".join(rng.choices(["fine", "clear", "prose"], k=8)) + f" {i}") for i in range(600)] + [(1, "fine prose")] * 600
    rest = [(i, "CLICK!!! $$$ " * (i % 5 + 1)) for i in range(2, 40)]
    labels = spark.createDataFrame([(1, 1)] + [(i, 0) for i, _ in rest], "doc_id long, quality int")
    models = []
    for rows in (hot + rest, rest + hot[::-1]):
        docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
        models.append(quality_classifier.fit(docs, labels, max_train=50))
    assert models[0].dump() == models[1].dump()
    seen = spark.createDataFrame([(1, "fine clear prose"), (2, "CLICK!!! $$$ ")], "doc_id long, text string")
    score = {r["doc_id"]: r["score"] for r in quality_classifier.score(seen, models[0]).collect()}
    assert score[1] > 0.5 > score[2]


def test_dual_descent_separates():
    rng = np.random.default_rng(0)
    rows = [np.sort(rng.choice(20, 5, replace=False)) for _ in range(200)]
    y = np.array([1.0 if 3 in r else -1.0 for r in rows])
    w = quality_classifier.dual_descent(rows, np.ones(20), y, 10.0, 200)
    margin = np.array([w[r].sum() / math.sqrt(5) + w[-1] for r in rows])
    assert ((margin > 0) == (y > 0)).all()


def test_features_are_distinct_and_local():
    texts = [b"one two two", None, b"", b"A", "é é".encode(), b"  lead", b"one two two", b"two one", b"one", b"x", b"x", b""]
    together = [sorted(x.tolist()) for x in quality_classifier.Features()(texts)]
    alone = [sorted(next(quality_classifier.Features()([t])).tolist()) for t in texts]
    assert together == alone
    assert all(len(set(x)) == len(x) for x in together) and together[1] == together[2] == []


def brute(rows, k=5):
    ok = [(i, v) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = []
    for q, a in ok:
        if q % 50:
            continue
        x = np.array(a, dtype=np.float64)
        near = []
        for i, b in ok:
            if i != q and len(b) == len(a):
                y = np.array(b, dtype=np.float64)
                near.append((-((y * x).sum() / (np.sqrt((y * y).sum()) * np.sqrt((x * x).sum()))), i))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(sorted(near)[:k])]
    return out


def test_recall_and_scores(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()]
    want = brute(rows)
    got = queries.op9_nearest_neighbours(spark, SF).collect()
    found = {(r["query_id"], r["vec_id"]): r["score"] for r in got}
    hit = sum((q, i) in found for q, _, i, _ in want)
    assert hit / len(want) >= 0.92
    for q, _, i, s in want:
        assert (q, i) not in found or abs(found[q, i] - s) < 1e-12
    by = {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        by.setdefault(r["query_id"], []).append((-r["score"], r["vec_id"]))
    assert all(v == sorted(v) and len(v) == 5 for v in by.values())


def test_neighbour_edges(spark):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(1, 30)] + [(50, [1.0, 0.0, 0.0, 0.0]), (100, [1.0, 0.0, 0.0, 0.0])]
    rows += [(200 + i, [2.0, 0.0, 0.0, 0.0]) for i in range(10)] + [(300, None), (350, []), (400, [0.0] * 4), (450, [float("nan"), 1.0, 0.0, 0.0]), (500, [None, 1.0, 1.0, 1.0]), (550, [float("inf"), 0.0, 0.0, 1.0]), (600, [1.0, 2.0]), (601, [2.0, 1.0]), (None, [1.0, 0.0, 0.0, 0.0]), (50, [0.0, 1.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit("x"))
    for shard_rows in (8192, 7):
        got = nearest_neighbours.search(df, F.col("vec_id") % 50 == 0, success=1.0, shard_rows=shard_rows).collect()
        first = [(r["rank"], r["vec_id"]) for r in got if r["query_id"] == 100]
        assert sorted(first) == [(1, 50), (2, 200), (3, 201), (4, 202), (5, 203)]
        assert [(r["vec_id"], r["rank"]) for r in got if r["query_id"] == 600] == [(601, 1)]
        assert {r["query_id"] for r in got} == {50, 100, 200, 600}
    assert nearest_neighbours.search(df.where("false"), F.col("vec_id") % 50 == 0).count() == 0
    assert nearest_neighbours.search(df.where("vec_id = 50 and embedding[0] = 1"), F.col("vec_id") % 50 == 0).count() == 0


def test_huge_and_tiny_components(spark):
    """Squares that overflow or vanish: the cosine is that of the vectors brought to a common size."""
    base = [(50, [3.0, 4.0, 0.0]), (1, [3.0, 4.0, 1.0]), (2, [-3.0, 4.0, 0.0]), (3, [0.0, 0.0, 2.0])]
    docs = lambda size: spark.createDataFrame([(i, [x * size for x in v]) for i, v in base], "vec_id long, embedding array<double>")
    found = [[tuple(r) for r in nearest_neighbours.search(docs(size), F.col("vec_id") % 50 == 0, success=1.0).orderBy("rank").collect()] for size in (1.0, 2.0**660, 2.0**-600)]
    assert found[0] == found[1] == found[2] and [r[2] for r in found[0]] == [1, 2, 3]
    assert abs(found[0][0][3] - 25 / (5 * 26**0.5)) < 1e-12
