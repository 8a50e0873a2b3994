import zlib
from collections import defaultdict

import numpy as np
import pytest
from sqlquarry.llm import _tokens, binary_output, retrieval_packing
from sqlquarry.llm._text import Words, shingles, words
from sqlquarry.llm._tokens import tokenizer

VOCAB = "word_bpe_49k.json"
ODD = ["", None, "a", "a<|endoftext|>b don'T İ ŉ ſ x×y ÷ ΟΔΟΣ é", "tab\tand space\r\n\n", "z" * 9000, "same", "same", "word " * 9000]


def plain(text):
    return tokenizer(VOCAB).plain.encode(text or "", add_special_tokens=False).ids + [2]


@pytest.fixture(scope="module")
def docs(spark, sf):
    own = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(100_000 + i, t) for i, t in enumerate(ODD)] + [(None, "no id")], "doc_id long, text string")
    return own.union(odd).cache()


def test_ids_match_the_tokenizer(docs):
    texts = [r["text"] or "" for r in docs.collect()]
    for text, ids in zip(texts, tokenizer(VOCAB).ids(texts), strict=True):
        assert [*ids.tolist(), 2] == plain(text)


def latin_texts():
    rng = np.random.default_rng(5)
    parts = ["th", "ing", "É", "ß", "on", "An", "ü", "don't", "'s", "'", "'ve", "'rest", "''ll", "'llé", "42", "***", ".'", "x" * 70, " ", "\n", "\t\r ", ", "]
    texts = ["".join(rng.choice(parts, int(rng.integers(0, 60)))) for _ in range(400)]
    return [*texts, "", " \n", "'", "'s", "a'", "z" * 5000 + " " + "z" * 5000 + "y " + "z" * 5000]


def test_plain_words_do_not_go_to_the_tokenizer_one_by_one(monkeypatch):
    texts = latin_texts()
    want = [plain(t)[:-1] for t in texts]
    seen = []
    word = _tokens.PieceTokenizer.word
    monkeypatch.setattr(_tokens.PieceTokenizer, "word", lambda self, part: seen.append(part) or word(self, part))
    monkeypatch.setattr(_tokens.PieceTokenizer, "encode", None)
    _tokens.forget()
    assert [x.tolist() for x in tokenizer(VOCAB).ids(texts)] == want
    assert all(len(p) > 60 for p in seen)
    for few in ([], [""], [" \n"], ["'"]):
        assert [x.tolist() for x in tokenizer(VOCAB).ids(few)] == [plain(t)[:-1] for t in few]


def test_words_of_one_hash_keep_their_ids(monkeypatch):
    monkeypatch.setattr(_tokens, "hashes", lambda data, start, end: (end - start).astype(np.uint64) << np.uint64(40))
    texts = latin_texts()
    assert [x.tolist() for x in tokenizer(VOCAB).ids(texts)] == [plain(t)[:-1] for t in texts]


def test_words_and_hashes(docs):
    texts = [None if r["text"] is None else r["text"].encode() for r in docs.collect()]
    w = Words(texts)
    assert [w.word(i) for i in range(len(w.hash))] == [x for t in texts for x in words(t)]
    seen = {}
    for i, h in enumerate(w.hash.tolist()):
        assert seen.setdefault(h, w.word(i)) == w.word(i)
    found, offset = shingles(w)
    by = {}
    for k, t in enumerate(texts):
        own = words(t)
        sets = [tuple(own[i : i + 5]) for i in range(max(1, len(own) - 4))] if own else []
        assert offset[k + 1] - offset[k] == len(sets)
        for s, h in zip(sets, found[offset[k] : offset[k + 1]].tolist(), strict=True):
            assert by.setdefault(s, h) == h
    assert len(set(by.values())) == len(by)


def check_pieces(rows, docs):
    want = defaultdict(list)
    for r in docs.collect():
        want[r["doc_id"]].append(plain(r["text"]))
    got = defaultdict(list)
    for r in rows:
        got[r["doc_id"]].append(r)
    assert set(got) == set(want)
    for key, texts in want.items():
        if len(texts) > 1:
            continue
        ids, at = texts[0], 0
        for r in sorted(got[key], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            raw = np.array(ids[at : at + r["length"]], dtype="<u4").tobytes()
            assert zlib.crc32(raw) == r["ids_crc32"]
            at += r["length"]
        assert at == len(ids)
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in by.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at == 4096 or at & (at - 1) == 0 and at < 4096


def test_retrieval_packing_is_lossless(docs):
    check_pieces(retrieval_packing.pack(docs).collect(), docs)
    check_pieces(retrieval_packing.pack(docs, shard_bytes=20_000).collect(), docs)


def test_retrieval_packing_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert retrieval_packing.pack(empty).count() == 0
    same = spark.createDataFrame([(1, "one two three")] * 40, "doc_id long, text string")
    rows = retrieval_packing.pack(same).collect()
    assert sum(r["length"] for r in rows) == 40 * len(plain("one two three"))


def corpus_scores(texts, seed, query_words, k1=1.2, b=0.75):
    """Every text's score for the strongest words of one; the least score that is lost by equally strong words."""
    docs = [t.split() for t in texts]
    n, avg = len(docs), sum(map(len, docs)) / len(docs)
    df = {t: sum(t in x for x in docs) for t in set(docs[seed])}

    def weight(t, own):
        tf = own.count(t)
        return np.log1p((n - df[t] + 0.5) / (df[t] + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(own) / avg))

    strong = sorted((t for t in df if df[t] > 1), key=lambda t: -weight(t, docs[seed]))
    total, before, asked = sum(weight(t, docs[seed]) for t in strong), 0.0, []
    for t in strong[:query_words]:
        if before < 0.5 * total - 1e-6:
            asked.append(t)
        before += weight(t, docs[seed])
    tied = len(strong) > len(asked) and weight(asked[-1], docs[seed]) - weight(strong[len(asked)], docs[seed]) < 1e-9
    return None if tied else np.array([sum(weight(t, own) for t in asked) for own in docs])


@pytest.mark.parametrize(("shard_bytes", "query_words", "dense"), [(300, 32, 64), (6 << 20, 32, 64), (900, 5, 1), (900, 5, 10**6)])
def test_neighbours_are_the_best_of_the_whole_corpus(spark, monkeypatch, shard_bytes, query_words, dense):
    monkeypatch.setattr(retrieval_packing, "_DENSE", dense)
    rng = np.random.default_rng(3)
    words_ = [f"w{i}" for i in range(60)]
    texts = [" ".join(["the", *rng.choice(words_, int(rng.integers(3, 25)))]) for _ in range(80)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = defaultdict(list)
    for r in retrieval_packing.pack(rows, length=128, shard_bytes=shard_bytes, query_words=query_words).collect():
        got[r["sequence_id"]].append((r["offset"], r["doc_id"], r["start"]))
    used: set = set()
    checked = 0
    full = sorted(got)[: sum(len(plain(t)) for t in texts) // 128]
    for s in full:
        (_, seed, _), *rest = sorted(got[s])
        used.add(seed)
        scores = corpus_scores(texts, seed, query_words)
        for _, d, _ in rest:
            assert d not in used
            if scores is not None:
                assert scores[d] >= max(scores[i] for i in range(80) if i not in used) - 1e-3
                checked += 1
            used.add(d)
    assert checked > 20


def test_a_seed_whose_list_is_used_up_asks_for_more(spark, monkeypatch):
    monkeypatch.setattr(retrieval_packing, "_NEAR", 1)
    texts = [f"same words here {i % 7}" for i in range(60)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = retrieval_packing.pack(rows, length=64, shard_bytes=200).collect()
    assert sum(r["length"] for r in got) == sum(len(plain(t)) for t in texts)
    assert len({r["doc_id"] for r in got}) == 60


def test_shared_words_count_in_tiny_tables(spark):
    texts = ["red fox runs far", "blue sky over hills", "red fox sleeps now", "blue sky at dawn"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted((r["sequence_id"], r["offset"], r["doc_id"]) for r in retrieval_packing.pack(rows, length=4096).collect())
    order = list(dict.fromkeys(d for _, _, d in got))
    assert order[1] == (order[0] + 2) % 4


def test_best_fit_decreasing_against_search():
    rng = np.random.default_rng(1)
    for _ in range(30):
        lengths, room = rng.integers(1, 65, 200), 64
        packed = binary_output.best_fit_decreasing(lengths, room)
        assert sorted(i for p in packed for i in p) == list(range(200))
        left: list[int] = []
        for i in np.argsort(-lengths, kind="stable"):
            fits = [k for k, r in enumerate(left) if r >= lengths[i]]
            if fits:
                left[min(fits, key=lambda k: left[k])] -= lengths[i]
            else:
                left.append(room - lengths[i])
        assert sorted(left) == sorted(room - int(lengths[p].sum()) for p in packed)


def test_binary_output_round_trip(docs, spark):
    rows = binary_output.pack(docs).collect()
    ids, parts = binary_output.matrix(rows), defaultdict(list)
    assert len({r["sequence_id"] for r in rows}) == len(rows)
    for row, r in zip(ids, rows, strict=True):
        cu = r["cu_seqlens"]
        assert cu[0] == 0 and cu[-1] == r["n_tokens"] and len(cu) == len(r["doc_ids"]) + 1
        assert r["resets"] == (cu if cu[-1] < 4096 else cu[:-1])
        for d, s, a, b in zip(r["doc_ids"], r["doc_starts"], cu, cu[1:], strict=False):
            parts[d].append((s, row[a:b].tolist()))
        assert not row[cu[-1] :].any()
    for r in docs.collect():
        assert sum((p for _, p in sorted(parts[r["doc_id"]])), []) == plain(r["text"])
    assert binary_output.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("dense", [1, 16, 10_000])
def test_pruned_lists_against_all_scores(monkeypatch, dense):
    monkeypatch.setattr(retrieval_packing, "_DENSE", dense)
    monkeypatch.setattr(retrieval_packing, "_CELLS", 50)
    rng = np.random.default_rng(dense)
    texts = [" ".join(f"w{w}" for w in rng.zipf(1.4, 12) if w < 60).encode() for _ in range(90)] + [b"", b"w1 w1 w2"] * 9
    terms, count, text, tf, size = retrieval_packing.postings(texts)
    used = rng.random(len(texts)) < 0.3
    shard = retrieval_packing.Shard(terms, count, text, tf, size, used, 8.0)
    asks = [rng.choice(len(terms), k, replace=False) for k in rng.integers(0, 9, 40)]
    word = np.concatenate(asks)
    seed = np.repeat(np.arange(40), [len(a) for a in asks])
    order = np.argsort(word, kind="stable")
    weight, most = rng.random(len(terms)) + 0.1, rng.integers(1, 9, 40)
    bound = np.searchsorted(word[order], np.arange(len(terms) + 1))
    found = [np.concatenate(c) for c in zip(*shard.scores(terms, weight, seed[order], bound, most, np.zeros(40)), strict=True)]
    seeds, docs, scores = retrieval_packing.best(found[0], found[1], np.round(found[2], 6), most)

    value = np.zeros((len(terms), len(texts)))
    value[np.repeat(np.arange(len(terms)), count), text] = retrieval_packing.saturation(tf, size[text], 8.0)
    for s in range(40):
        every = np.round((value[asks[s]] * weight[asks[s]][:, None]).sum(axis=0)[~used], 6)
        want = np.sort(every[every > 0])[::-1][: most[s]]
        assert np.allclose(scores[seeds == s], want, atol=2e-6)
        assert np.allclose(every[docs[seeds == s]], want, atol=2e-6)


def test_words_are_merged_once_over_many_calls(monkeypatch):
    texts = [*latin_texts(), *(f"{a}{b}ung {b}tion{a} x" for a in "abcdefghijklm" for b in ("re", "ß", "xyzzyxyzzyx"))]
    want = [plain(t)[:-1] for t in texts]
    rows, run = [], _tokens.Merges.run
    monkeypatch.setattr(_tokens.Merges, "run", lambda self, letters, *more: rows.append(len(letters)) or run(self, letters, *more))
    monkeypatch.setattr(_tokens, "_LOADED", {})
    for step in (1 << 19, 200):  # the second time in many small steps
        monkeypatch.setattr(_tokens, "_STEP", step, raising=False)
        assert [x.tolist() for x in tokenizer(VOCAB).ids(texts)] == want
        _tokens.forget()
        if step == 1 << 19:
            rows.clear()
    assert sum(rows) == 0
    monkeypatch.setattr(_tokens, "_WORDS", 10)  # begins anew
    assert [x.tolist() for x in tokenizer(VOCAB).ids([*texts, "neverseenbefore"])][:-1] == want
    assert tokenizer(VOCAB).kept.words == 1
    assert [x.tolist() for x in tokenizer(VOCAB).ids(texts)] == want


def test_best_counts_levels_of_its_own_seeds_only(monkeypatch):
    """A merge holds one group of seeds, so its work must not grow with those of all groups."""
    asked, level_of = [], retrieval_packing._level_of
    monkeypatch.setattr(retrieval_packing, "_level_of", lambda own, level, levels, most: asked.append(len(most)) or level_of(own, level, levels, most))
    rng = np.random.default_rng(1)
    seed, doc, score = np.repeat(np.arange(3, 3 + 64 * 5, 64), 20), rng.permutation(100), rng.integers(1, 9, 100) / 8
    most = np.full(100_000, 4)
    got = retrieval_packing.best(seed, doc, score, most)
    assert asked == [5]
    for s in np.unique(seed):
        assert sorted(got[2][got[0] == s].tolist(), reverse=True) == np.sort(score[seed == s])[::-1][:4].tolist()


def test_slim_integers_and_common_hashes():
    rng = np.random.default_rng(2)
    for x in (np.empty(0, np.int64), np.array([0, 255, 256, 1 << 40]), rng.integers(0, 300, 500)):
        assert retrieval_packing.slimmed(retrieval_packing.slim(x)).tolist() == x.tolist()
    a, b = (np.unique(rng.integers(0, 400, 200)).astype(np.uint64) << np.uint64(43) for _ in range(2))
    for x, y in ((a, b), (b[:0], a), (a, a[-1:])):
        at, here = retrieval_packing.common(x, y)
        assert x[at].tolist() == y[here].tolist() == np.intersect1d(x, y).tolist()
