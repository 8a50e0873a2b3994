import math
import random
from collections import Counter

from sqlquarry.llm import near_dedup, queries
from sqlquarry.llm._text import words

from tests.llm.test_near_dedup import near_group


def brute(rows, threshold=0.8):
    """Single-link classes of texts whose weights or counts are similar, over all pairs that share a shingle."""
    sets, df = [], Counter()
    for _, text in rows:
        w = words(None if text is None else text.encode())
        sets.append(Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter())
        df.update(sets[-1].keys())
    n = sum(map(bool, sets))
    weighed = [{s: c * (1 + math.log10(n / df[s])) for s, c in own.items()} for own in sets]
    root, having = list(range(len(rows))), {}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    def near(a, b):
        common = sum(min(a[s], b[s]) for s in a.keys() & b.keys())
        return common >= threshold * (1 - 1e-12) * (sum(a.values()) + sum(b.values()) - common)

    for i, own in enumerate(sets):
        met = {j for s in own for j in having.get(s, ())}
        for s in own:
            having.setdefault(s, []).append(i)
        for j in met:
            if find(i) != find(j) and (near(sets[i], sets[j]) or near(weighed[i], weighed[j])):
                root[find(i)] = find(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), key), key)
    return {key: least[find(i)] for i, (key, _) in enumerate(rows)}


def write(spark, folder, rows):
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def found(spark, folder):
    return {r["doc_id"]: r["class_id"] for r in queries.op3_near_dedup(spark, folder).collect()}


def test_near_copies_in_a_large_group(spark, tmp_path):
    """Two edits in each copy: what all 300 share weighs half as much as what one of them has alone."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    base = [word() for _ in range(100)]
    rows = [(0, " ".join(base))]
    for i in range(1, 300):
        own = list(base)
        own[10 + i % 25], own[60 + i % 27] = word(), word()
        rows.append((i, " ".join(own)))
    rows += [(1000 + i, " ".join(word() for _ in range(40))) for i in range(500)]
    got = found(spark, write(spark, tmp_path, rows))
    assert {got[i] for i in range(300)} == {0}
    assert all(got[1000 + i] == 1000 + i for i in range(500))
    assert got == brute(rows)


def test_groups_in_blocks(spark, tmp_path, monkeypatch):
    rng = random.Random(8)
    rows = list(enumerate(near_group(rng, 80, 5) + near_group(rng, 5, 4) + near_group(rng, 12, 20)))
    folder, want = write(spark, tmp_path, rows), brute(rows)
    monkeypatch.setattr(near_dedup, "STAR", 7)
    for size in (2_000_000, 6000):
        monkeypatch.setattr(near_dedup, "BLOCK_GRAMS", size)
        assert found(spark, folder) == want


def test_query_on_given_tables(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    assert found(spark, "/root/testdata/sf0.01") == brute(rows)


def test_rare_words_link_as_before(spark, tmp_path):
    """A pair that only the weights link: its boilerplate is frequent."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    licence = " ".join(word() for _ in range(30))
    rare = " ".join(word() for _ in range(100))
    rows = [(0, rare), (1, f"{rare} {licence}")]
    rows += [(2 + i, " ".join(word() for _ in range(60)) + " " + (licence if i % 2 else "")) for i in range(200)]
    got = found(spark, write(spark, tmp_path, rows))
    assert got == brute(rows) and got[1] == 0 and got[5] == 5
