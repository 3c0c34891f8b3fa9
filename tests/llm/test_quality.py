import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from vectide.llm import quality

DATA = "/root/testdata/sf0.1"


def auc(score, label):
    order = np.argsort(score, kind="stable")
    s, y = np.asarray(score)[order], np.asarray(label)[order]
    ranks = np.empty(len(s))
    lo = np.searchsorted(s, s, "left")
    hi = np.searchsorted(s, s, "right")
    ranks = (lo + hi + 1) / 2
    p = y.sum()
    return (ranks[y == 1].sum() - p * (p + 1) / 2) / (p * (len(y) - p))


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    got = quality.quality_scores(docs, labels)
    assert got.count() == docs.count()
    rows = got.filter("held_out").join(labels, "doc_id").select("score", "predicted", "quality").collect()
    assert auc([r.score for r in rows], [r.quality for r in rows]) > 0.97
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.95


def test_isotonic_against_definition():
    rng = np.random.default_rng(0)
    for _ in range(50):
        n = rng.integers(1, 9, 12)
        ones = rng.binomial(n, rng.uniform(0, 1, 12))
        x, v = quality.isotonic(list(zip(np.arange(12.0), n, ones, strict=True)))
        assert (np.diff(v) > 0).all() and (np.diff(x) > 0).all()
        # minimax form of the isotonic fit
        fit = [max(min(ones[a : b + 1].sum() / n[a : b + 1].sum() for b in range(k, 12)) for a in range(k + 1)) for k in range(12)]
        assert sorted(set(np.round(fit, 9))) == pytest.approx(list(np.round(v, 9)))


def test_odd_tables(spark):
    docs = spark.createDataFrame([(1, "Good text here.", 1), (1, "Good text here.", 1), (2, None, 2), (None, "", 3), (3, "x" * 300_000, 4)], "doc_id long, text string, score int")
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = quality.quality_scores(docs, none).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    some = spark.createDataFrame([(k, k % 2) for k in range(5)] + [(2, None), (None, 1)], "doc_id long, quality int")
    assert quality.quality_scores(docs, some).count() == 5
    assert quality.quality_scores(docs.limit(0), some).count() == 0
    assert quality.of_good_quality(docs, none).columns == docs.columns


def test_weights_against_plain_ridge(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").repartition(5)
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model, _ = quality.learn(docs, labels)
    texts = {r.doc_id: np.array(quality.statistics(r.text or ""), np.float32).astype(float) for r in docs.collect()}
    every = np.array(list(texts.values()))
    mean, scale = every.mean(0), every.std(0)
    scale[scale < 1e-9] = 1
    assert model.mean == pytest.approx(mean) and model.scale == pytest.approx(scale)
    kept = [r for r in labels.collect() if r.quality is not None and zlib.crc32(str(r.doc_id).encode()) % 5 and r.doc_id in texts]
    x, y = np.array([texts[r.doc_id] for r in kept]), np.array([r.quality for r in kept], float)
    rng = np.random.default_rng(quality.SEED)
    w, b = rng.normal(size=(x.shape[1], quality.FEATURES)) / np.sqrt(x.shape[1]), rng.uniform(0, 2 * np.pi, quality.FEATURES)
    z = np.hstack([np.sqrt(2 / quality.FEATURES) * np.cos(np.clip((x - mean) / scale, -8, 8) @ w + b), np.ones((len(x), 1))])
    penalty = np.diag([quality.RIDGE * len(x)] * quality.FEATURES + [1e-9 * len(x)])
    # the same least squares, solved as one stacked system
    want = np.linalg.lstsq(np.vstack([z, np.sqrt(penalty)]), np.concatenate([y, np.zeros(len(penalty))]), rcond=None)[0]
    assert model.weights == pytest.approx(want, rel=1e-5, abs=1e-6)
    assert model.raw(x) == pytest.approx(z @ want, abs=1e-6)


def test_stage_keeps_rows_and_agrees_with_the_query(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("quality_stats", F.lit(1))
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    kept = quality.of_good_quality(docs, labels)
    assert kept.columns == docs.columns
    good = quality.quality_scores(docs, labels).filter("predicted = 1").select("doc_id")
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in good.collect())
