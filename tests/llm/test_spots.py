import hashlib
import random
from collections import Counter
from itertools import islice

import pytest
import regex
from pyspark.sql import functions as F

from vectide.llm import spots

ANCHORS = set(spots.ANCHORS)


def plain(text):
    words = ["\u0002"]
    for part in regex.split(r"([.!?\n\u0002]+)", text.lower()):
        words += ["\u0002"] if regex.match(r"[.!?\n\u0002]", part) else regex.sub(r"[^\p{L}\p{N}]+", " ", part).split()
    common = ANCHORS | {"\u0002"}
    counts = Counter()
    for at, w in enumerate(words):
        if w in common and at + 1 < len(words) and words[at + 1] not in common:
            chain = [x for x in islice((x for x in words[at + 1 :] if x not in common), spots.CHAIN)]
            counts[(w, *chain)] += 1
    out = {(s, k) for s, n in counts.items() for k in range(n.bit_length())}
    return out or ({text} if text else set())


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def texts(n, seed=1):
    rng = random.Random(seed)
    vocabulary = ["the", "of", "la", "une", "Der", *[f"word{i}" for i in range(60)], "É!", "日本", "🙂", "end.", "a\nb"]
    out = []
    for _ in range(n):
        if out and rng.random() < 0.3:
            out.append(rng.choice(out) + rng.choice(["", " the end", "x"]))
        else:
            out.append(" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 80))))
    return [*out, "", None, "the of", "!!!", "the " * 20_000, "x" * 100_000, "the cat sat. " * 300, "a" + "\n" * 5000 + "b"]


def test_against_plain_version(spark):
    rows = [(3 * k, t) for k, t in enumerate(texts(150))]
    random.Random(0).shuffle(rows)
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, fingerprint string").repartition(4)
    old, spots.BUCKET_ROWS = spots.BUCKET_ROWS, 16
    try:
        got = {r.doc_id: r for r in spots.edited_fingerprints(df).collect()}
    finally:
        spots.BUCKET_ROWS = old
    order = [(i, t or "") for i, t in sorted(rows, reverse=True)]
    assert len(got) == len(rows)
    prints = {}
    for k, (i, t) in enumerate(order):
        nxt = order[(k + 1) % len(order)][1]
        m = len(t) // 3
        edited = t[: len(t) - m] + nxt[:m]
        r = got[i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.near_edited == pytest.approx(jaccard(plain(t), plain(edited))) and r.near_next == pytest.approx(jaccard(plain(t), plain(nxt)))
        assert len(r.fingerprint) == 8 * len(plain(t)) and len(r.edited_fingerprint) == 8 * len(plain(edited))
        assert prints.setdefault(t, r.fingerprint) == r.fingerprint
        if edited == t:
            assert r.edited_fingerprint == r.fingerprint


def test_odd_tables(spark):
    df = spark.createDataFrame([(5, "a b"), (5, "a b"), (None, "c d"), (5, "a c")], "doc_id long, text string")
    assert spots.edited_fingerprints(df).count() == 4
    assert spots.edited_fingerprints(df.filter("text = 'c d'")).first().near_next == 1.0
    assert spots.edited_fingerprints(df.limit(0)).count() == 0


def test_near_duplicates_against_all_pairs(spark):
    rows = list(enumerate(texts(120, 7)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {}
    for i, t in rows:
        if s := frozenset(plain(t or "")):
            sets.setdefault(s, i)
    want = {(min(a, b), max(a, b)): jaccard(s, t) for s, a in sets.items() for t, b in sets.items() if a < b and jaccard(s, t) >= 0.6}
    got = {(r.a, r.b): r.likeness for r in spots.near_duplicates(df, threshold=0.6).collect()}
    assert got == pytest.approx(want)
    old, spots.GROUP_CLASSES = spots.GROUP_CLASSES, 2
    try:
        assert {(r.a, r.b): r.likeness for r in spots.near_duplicates(df, threshold=0.6).collect()} == got
    finally:
        spots.GROUP_CLASSES = old


def test_far_apart_and_repeated_ids(spark, monkeypatch):
    monkeypatch.setattr(spots, "BUCKET_ROWS", 8)
    monkeypatch.setattr(spots, "MOST_ROWS", 1)
    monkeypatch.setattr(spots, "GROUP_CLASSES", 3)
    ids = [*range(100), 10**18, -(10**18), (1 << 63) - 1, -(1 << 63), *(2**k + 1000 for k in range(60))]
    rows = [(i, f"the text number {i} says it") for i in ids]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    placed = spots._bucketed(df.select(F.col("doc_id").alias("key"), F.xxhash64("text").alias("tie")))
    sizes = [r["count"] for r in placed.groupBy("bucket").count().collect()]
    assert sum(sizes) == len(ids) and max(sizes) <= 8
    got = {r.doc_id: r.next_text for r in spots.with_next(df, ["text"]).collect()}
    order = sorted(rows, reverse=True)
    assert got == {i: order[(k + 1) % len(order)][1] for k, (i, _) in enumerate(order)}
    hot = spark.createDataFrame([(7, f"text {k}") for k in range(200)] + [(None, f"lost {k}") for k in range(100)] + [(8, "x")], "doc_id long, text string")
    placed = spots._bucketed(hot.select(F.coalesce("doc_id", F.lit(0).cast("long")).alias("key"), F.xxhash64("text").alias("tie")))
    assert max(r["count"] for r in placed.groupBy("bucket").count().collect()) <= 8
    got = [(r.text, r.next_text) for r in spots.with_next(hot, ["text"]).collect()]
    assert len(got) == 301 and sorted(a for a, _ in got) == sorted(b for _, b in got)
