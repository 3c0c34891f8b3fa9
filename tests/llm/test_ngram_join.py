import random
import re

import numpy as np
import pyarrow as pa
import pytest

from vectide.llm import ngram_join as nj
from vectide.llm import shingles

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_set(text, k):
    w = WORD.findall((text or "").translate(LOWER))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) or frozenset([tuple(w)])


def brute(rows, k, percent):
    sets = [plain_set(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    low = {}
    for x in range(len(rows)):
        low[find(x)] = min(low.get(find(x), rows[x][0]), rows[x][0])
    return sorted((rows[x][0], len(sets[x]), low[find(x)]) for x in range(len(rows)))


def corpus(seed, n=260):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)] + ["É", "the", "The", "of"]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    base = [[rng.choice(vocabulary) for _ in range(rng.choice([3, 9, 10, 11, 30, 80, 150]))] for _ in range(25)]
    rows = []
    for i in range(n):
        kind = rng.random()
        w = list(rng.choice(base))
        if kind < 0.6:
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
        elif kind < 0.7:
            w = [rng.choice(vocabulary) for _ in range(rng.randint(0, 40))]
        elif kind < 0.85:
            w = [rng.choice(vocabulary) for _ in range(rng.randint(1, 20))] + passage
        rows.append((i, rng.choice([" ", "\n", " \t "]).join(w)))
    return rows + [(n, ""), (n + 1, None), (n + 2, " \n "), (n + 3, "one"), (n + 4, "ONE"), (n + 5, "one two")]


def test_sets_equal_plain_sets(monkeypatch):
    monkeypatch.setattr(shingles, "PIECE_BYTES", 400)
    texts = [t or "" for _, t in corpus(1)] + ["x" * 3000, "a\x1fb c d", " é  É "]
    got = list(shingles.shingle_sets(pa.array(texts), 3))
    assert [len(s) for s in got] == [len(plain_set(t, 3)) for t in texts]
    ids = {}
    for t, s in zip(texts, got, strict=True):
        assert ids.setdefault(plain_set(t, 3), s.tobytes()) == s.tobytes()
    assert len(set(ids.values())) == len(ids)


def test_planes():
    v = np.sort(np.random.default_rng(0).integers(0, 1 << 48, 1000).astype(np.uint64))
    assert (nj._values(nj._planes(v)) == v).all() and len(nj._values(b"")) == 0


@pytest.mark.parametrize("seed,k,percent,blocks", [(1, 3, 90, 2_000_000), (2, 3, 90, 300), (3, 5, 80, 2_000_000), (4, 1, 60, 200)])
def test_against_all_pairs(spark, monkeypatch, seed, k, percent, blocks):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(tuple(r) for r in nj.ngram_components(df, words=k, percent=percent, cluster_tokens=blocks).collect())
    assert got == brute(rows, k, percent)


def test_odd_tables(spark):
    df = spark.createDataFrame([(7, "a b c d", 1), (7, "a b c d", 2), (5, "a B c d", 3), (None, "a b c d", 4), (None, None, 5), (7, "z", 6)], "doc_id long, text string, component_id int")
    got = sorted((tuple(r) for r in nj.ngram_components(df, words=3, percent=90).collect()), key=str)
    assert got == sorted([(7, 2, 5), (7, 2, 5), (5, 2, 5), (None, 2, 5), (None, 0, None), (7, 1, 7)], key=str)
    assert nj.ngram_components(df.limit(0)).count() == 0
    kept = nj.deduplicated(df)
    assert kept.columns == df.columns and sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(5, "a B c d"), (None, None), (7, "z")], key=str)


def test_texts_under_one_id_are_told_apart(spark):
    long = " ".join(f"w{i}" for i in range(40))
    rows = [(1, long), (1, "quite another text of some words"), (1, long), (2, long + " x"), (None, long), (None, "nameless one of five words"), (3, " "), (3, ""), (3, "")]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, key_one int").repartition(3)
    kept = nj.deduplicated(df)
    assert kept.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(1, long), (1, "quite another text of some words"), (None, "nameless one of five words"), (3, " "), (3, "")], key=str)


def test_deduplicated_keeps_one_of_each_component(spark):
    rows = corpus(5)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = sorted({c for i, n, c in brute(rows, 5, 80) if n} | {i for i, n, c in brute(rows, 5, 80) if not n})
    assert sorted(r.doc_id for r in nj.deduplicated(df).collect()) == want


def test_cluster_above_a_share_of_the_work(spark, monkeypatch):
    monkeypatch.setattr(nj, "SHARE_TOKENS", 200)
    rng = random.Random(9)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(200):
        w = list(base)
        for _ in range(rng.randint(0, 2)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(40)}"
        rows.append((i, " ".join(w)))
    rows += [(200 + i, " ".join(f"y{i // 2}-{k}" for k in range(30 + i % 2))) for i in range(40)]
    got = nj.ngram_components(spark.createDataFrame(rows, "doc_id long, text string"), words=3, percent=90)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == brute(rows, 3, 90)


@pytest.mark.parametrize("seed,k,percent", [(1, 3, 90), (6, 5, 80), (4, 1, 60)])
def test_frequent_tokens_stay_in_their_batch(spark, monkeypatch, seed, k, percent):
    monkeypatch.setattr(nj, "OFTEN", 4)
    monkeypatch.setattr(nj, "HOT_POSTINGS", 12)
    monkeypatch.setattr(nj, "HOT_TOKENS", 10**9)
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    sizes = nj.set_sizes(df, k).cache()
    total = sizes.agg({"n": "sum"}).first()[0]
    hot, rank = nj.frequent(sizes, total, 6)
    count = {}
    for s in {plain_set(t, k) for _, t in rows}:
        for t in s:
            count[t] = count.get(t, 0) + 1
    assert len(hot) == len(rank) and sum(c >= 60 for c in count.values()) <= len(hot) <= sum(c >= 4 for c in count.values())
    assert len(hot) > 0
    packed = nj._pack(df, k, 6, hot).collect()
    assert not any(np.isin((np.uint64(r.key) << np.uint64(48)) | nj._values(r.tokens), hot).any() for r in packed if r.key >= 0)
    assert sum(len(r.owner) for r in packed if r.key < 0 and r["rank"] is not None) > 0
    assert sorted(tuple(r) for r in nj.ngram_components(df, words=k, percent=percent).collect()) == brute(rows, k, percent)


def test_only_frequent_tokens(spark, monkeypatch):
    monkeypatch.setattr(nj, "OFTEN", 2)
    monkeypatch.setattr(nj, "HOT_POSTINGS", 2)
    monkeypatch.setattr(nj, "HOT_TOKENS", 10**9)
    base = [f"w{i}" for i in range(30)]
    rows = [(i, " ".join(base + [f"w{j}" for j in range(i % 4)])) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert sorted(tuple(r) for r in nj.ngram_components(df, words=3, percent=90).collect()) == brute(rows, 3, 90)


def test_tally():
    tally = nj._Tally(3)
    a = np.array([1, 2, 3, 2**63 + 5], np.uint64)
    for k in range(3):
        tally.add(bytes([k]), np.append(a, np.uint64(2**63 + 10 + k)))
    tally.add(bytes([2]), a)
    assert tally.held == 15
    assert sorted(tally.report()) == sorted((int(x), 3) for x in a.view(np.int64)) and tally.held == 0
    tally.add(b"x", a)
    assert tally.report() is None and tally.report() is None
