import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T
from sqlquarry.llm import _meet, near_dedup
from sqlquarry.llm._text import mix, words


def brute_classes(rows, threshold=0.8):
    """Single-link classes by the true weighted similarity of all pairs."""
    sets, df, n = [], Counter(), 0
    for _, text in rows:
        w = words(None if text is None else text.encode())
        own = Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()
        sets.append(own)
        df.update(own.keys())
        n += bool(own)
    weigh = lambda s: 1 + math.log10(n / df[s])
    sets = [{s: c * weigh(s) for s, c in own.items()} for own in sets]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    borderline = set()
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            common = sum(min(a[s], b[s]) for s in a.keys() & b.keys())
            if not common:
                continue
            sim = common / (sum(a.values()) + sum(b.values()) - common)
            if sim >= threshold:
                root[find(i)] = find(j)
            if abs(sim - threshold) < 1e-4:
                borderline.add((i, j))
    ids = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            ids[find(i)] = min(ids.get(find(i), key), key)
    return [ids.get(find(i)) for i in range(len(rows))], borderline


def test_classes_against_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]
    want, borderline = brute_classes(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["id"]: r["class_id"] for r in near_dedup.classes(docs).collect()}
    assert not borderline
    assert [got[k] for k, _ in rows] == want
    assert len(set(want)) < len(want)


def test_bucket_of_mutually_different_texts(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    common = [word() for _ in range(60)]
    rows = [(i, " ".join(common + [word() for _ in range(40)])) for i in range(40)]
    rows += [(100 + i, rows[i][1].rsplit(" ", 1)[0] + " " + word()) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["id"]: r["class_id"] for r in near_dedup.classes(docs).collect()}
    assert got == dict(zip((k for k, _ in rows), brute_classes(rows)[0], strict=True))
    assert got[105] == 5 and got[5] == 5 and got[6] == 6


def near_group(rng, n, most):
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    base = [word() for _ in range(120)]
    out = []
    for _ in range(n):
        own = list(base)
        for _ in range(rng.randrange(most)):
            own[rng.randrange(len(own))] = word()
        out.append(" ".join(own))
    return out


def test_large_group_in_blocks(spark, monkeypatch):
    rng = random.Random(8)
    rows = list(enumerate(near_group(rng, 80, 5) + near_group(rng, 5, 4) + near_group(rng, 12, 20)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_classes(rows)[0]
    monkeypatch.setattr(near_dedup, "STAR", 7)
    for size in (2_000_000, 6000):
        monkeypatch.setattr(near_dedup, "BLOCK_GRAMS", size)
        got = {r["id"]: r["class_id"] for r in near_dedup.classes(docs).collect()}
        assert [got[k] for k, _ in rows] == want
    assert 5 < len(set(want)) < 80


def test_forest_against_all_pairs():
    rng = random.Random(2)
    for n in (3, 8, 40):
        sets = []
        for text in near_group(rng, n, 12):
            grams = np.unique(np.array([hash(w) & 0xFFFFFFFF for w in text.split()], dtype=np.uint64))
            weight = np.array([1 + (g % 3) for g in grams.tolist()], dtype=float)
            sets.append((grams, weight, weight.sum()))
        for side in (np.zeros(n, bool), np.arange(n) % 2 == 1):
            both = side.any()
            want = [(i, j) for i in range(n) for j in range(i) if (not both or side[i] != side[j]) and near_dedup.similarity(sets[i], sets[j]) >= 0.8]
            got = near_dedup.forest(sets, side, 0.8)
            label = lambda links: [min(c) for c in groups(n, links)]
            assert label(got) == label(want)


def groups(n, links):
    own = [{i} for i in range(n)]
    for a, b in links:
        merged = own[a] | own[b]
        for i in merged:
            own[i] = merged
    return own


def test_edges(spark):
    long = "alpha beta gamma delta epsilon zeta"
    rows = [(1, long), (1, long), (2, long.upper() + "!"), (None, long), (3, None), (4, ""), (5, ""), (6, "..."), (7, "one"), (8, "one"), (None, "solo text")]
    docs = spark.createDataFrame([(*r, 9) for r in rows], "doc_id long, text string, node int")
    got = sorted(((r["id"], r["class_id"]) for r in near_dedup.classes(docs).collect()), key=str)
    assert got == sorted([(1, 1), (1, 1), (2, 1), (None, 1), (3, 3), (4, 4), (5, 5), (6, 6), (7, 7), (8, 7), (None, None)], key=str)
    kept = near_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted([1, 3, 4, 5, 6, 7, None], key=str)
    assert near_dedup.classes(docs.where("false")).count() == 0
    assert near_dedup.keep_one(docs.where("false")).count() == 0


def test_sampler_estimates_weighted_jaccard():
    rng = np.random.default_rng(2)
    grams = np.sort(rng.integers(0, 2**63, 400, dtype=np.uint64))
    a, b = (grams[:300], rng.uniform(1, 3, 300)), (grams[100:], np.ones(300))
    b[1][:200] = a[1][100:] * rng.uniform(0.5, 1.5, 200)
    s = near_dedup.Sampler(4000, 1)
    share = (s.bands_of(*a) == s.bands_of(*b)).mean()
    assert abs(share - near_dedup.similarity((*a, a[1].sum()), (*b, b[1].sum()))) < 0.03


def test_idf_decides(spark):
    """A pair that counts alone keep apart (0.74) and the exact IDF links, as its boilerplate is frequent."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    licence = " ".join(word() for _ in range(30))
    rare = " ".join(word() for _ in range(100))
    rows = [(0, rare), (1, f"{rare} {licence}")]
    rows += [(2 + i, " ".join(word() for _ in range(60)) + " " + (licence if i % 2 else "")) for i in range(200)]
    got = {r["id"]: r["class_id"] for r in near_dedup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[k] for k, _ in rows] == brute_classes(rows)[0]
    assert got[1] == 0 and got[5] == 5
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in (rare, f"{rare} {licence}")]
    assert len(sets[0] & sets[1]) / len(sets[0] | sets[1]) < 0.8


def test_items_meet(spark, monkeypatch):
    """Counts and texts of shared items against a plain count, over many blocks, with items that most texts have."""
    rng = random.Random(7)
    rows = [(i, [rng.randrange(400) for _ in range(rng.randrange(40))] + [9999] * (i % 3) + [5000 + i]) for i in range(900)]
    docs = spark.createDataFrame(rows, "id long, own array<long>").repartition(5)
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("got", T.ArrayType(T.LongType()))])

    def items(batch):
        for i, own in zip(*(batch.column(c).to_pylist() for c in ("id", "own")), strict=True):
            yield mix(np.array(own, dtype=np.uint64)), i

    def finish(info, shared):
        flat = [np.stack([x.astype(np.int64) for x in s], axis=1).ravel().tolist() for s in shared]
        yield pa.RecordBatch.from_arrays([pa.array(info, pa.int64()), pa.array(flat, pa.list_(pa.int64()))], names=["id", "got"])

    name = {x: int(mix(np.array([x], dtype=np.uint64))[0] >> np.uint64(12)) for x in {x for _, own in rows for x in own}}
    for occurrences in (False, True):
        total = Counter(x for _, own in rows for x in (own if occurrences else set(own)))
        want = {i: sorted((name[x], c, total[x]) for x, c in Counter(own).items() if total[x] > 1) for i, own in rows}
        for most in (1 << 20, 700):
            monkeypatch.setattr(_meet, "BLOCK_ITEMS", most)
            found = _meet.meet(docs, items, finish, schema, size=10**9, occurrences=occurrences).collect()
            got = {r["id"]: sorted(zip(r["got"][::3], r["got"][1::3], r["got"][2::3], strict=True)) for r in found}
            assert got == want


def test_numbers_packed():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 1000):
        x = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        assert _meet.unpack(_meet.pack(x), len(x)).tolist() == x.tolist()
    x = np.array([0, 0, 5, 2**64 - 1], dtype=np.uint64)
    assert _meet.unpack(_meet.pack(x), 4).tolist() == x.tolist()


def test_components(spark):
    rng = random.Random(9)
    edges = [(i, i + 1) for i in range(30)] + [(100, 100 + i) for i in range(1, 50)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(50)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r["node"]: r["root"] for r in near_dedup.components(df).collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: find(x) for x in linked}
    assert near_dedup.components(df.where(F.lit(False))).count() == 0
