import re

import pytest
from pyspark.sql import functions as F

from vectide.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_targets(sizes, weights=(1, 2, 3), most=3):
    """Share by weight; what is above the most goes back to the others, until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, out, free = sum(sizes.values()), {}, list(names)
    while free:
        rest = total - sum(out.values())
        share = {s: rest * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if share[s] > most * sizes[s]]
        if not over:
            return out | share
        for s in over:
            out[s] = most * sizes[s]
            free.remove(s)
    return out


def test_targets_and_taken(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text", F.when(F.col("source") != "src7", F.col("source")).alias("source"))
    docs = docs.filter("source is null or source <> 'src3' or pmod(hash(doc_id), 20) = 0").unionByName(docs.sparkSession.createDataFrame([(-1, None, "none"), (-2, "", "none")], "doc_id long, text string, source string"))
    rows = mixing.mix_plan(docs, keep=False).select("row.doc_id", "size", "source_size", "target", F.size("draws").alias("n")).collect()
    again = mixing.mix_plan(docs.repartition(7), keep=False).select("row.doc_id", "size", "source_size", "target", F.size("draws").alias("n")).collect()
    assert sorted(rows) == sorted(again)
    text = {r.doc_id: r for r in docs.collect()}
    sizes = {}
    for r in text.values():
        n = len(WORD.findall(r.text or ""))
        sizes[r.source] = sizes.get(r.source, 0) + n
    want, taken = plain_targets(sizes), dict.fromkeys(sizes, 0)
    assert len(rows) == len(text)
    for r in rows:
        s = text[r.doc_id].source
        assert r.size == len(WORD.findall(text[r.doc_id].text or "")) and r.source_size == sizes[s] and r.n <= 3
        assert r.target == pytest.approx(want[s])
        taken[s] += r.size * r.n
    assert want["src3"] == 3 * sizes["src3"] == taken["src3"]
    for s in sizes:
        assert -1 <= want[s] - taken[s] <= max(50, want[s] / 100)


def test_quotas_are_exact(spark):
    quotas = spark.createDataFrame([(1, 40), (2, 7), (3, 0), (4, 103)], "sid int, q long")
    for shards in (1, 2, 5, 16):
        rows = mixing.split_quotas(quotas, shards, 3).collect()
        per_source, per_shard = {}, {}
        for r in rows:
            assert r.q >= 0
            per_source[r.sid] = per_source.get(r.sid, 0) + r.q
            per_shard[r.shard] = per_shard.get(r.shard, 0) + r.q
        assert per_source == {1: 40, 2: 7, 3: 0, 4: 103} and sorted(per_shard) == list(range(shards))
        assert max(per_shard.values()) - min(per_shard.values()) <= 5


def test_draws_follow_the_distribution(spark):
    n = spark.range(4000).select(mixing._drawn(F.lit(30).cast("long"), F.lit(12).cast("long"), F.lit(10).cast("long"), [F.col("id")]).alias("x")).agg(F.avg("x"), F.var_samp("x")).first()
    assert n[0] == pytest.approx(4.0, abs=0.08) and n[1] == pytest.approx(10 * 0.4 * 0.6 * 20 / 29, rel=0.1)


def test_mixed_rows(spark):
    rows = [(k % 50, f"w{k} " * (k % 9), f"s{k % 3}", k) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    plan = mixing.mix_plan(df, words_per_shard=40, docs_per_block=4)
    mixed = mixing.mix(df, words_per_shard=40, docs_per_block=4)
    assert mixed.columns == [*df.columns, "mix_epoch", "mix_shard"]
    assert mixed.count() == plan.agg(F.sum(F.size("draws"))).first()[0]
    assert mixed.select("mix_shard").distinct().count() > 3
    assert mixing.mix(df.limit(0)).count() == 0


def test_large_quotas_are_drawn_by_deviation(spark):
    import time

    quotas = spark.createDataFrame([(1, 10**8), (2, 3 * 10**8), (3, 17)], "sid int, q long")
    began = time.perf_counter()
    rows = mixing.split_quotas(quotas, 4, 5).collect()
    assert time.perf_counter() - began < 30
    for sid, q in ((1, 10**8), (2, 3 * 10**8), (3, 17)):
        per = [r.q for r in rows if r.sid == sid]
        assert sum(per) == q and all(abs(x - q / 4) < 8 * (q**0.5) for x in per)


def test_deep_trees_are_dealt_anew(spark):
    rows = mixing.split_quotas(spark.createDataFrame([(1, 5000), (2, 300)], "sid int, q long"), 200, 3).collect()
    assert {s: sum(r.q for r in rows if r.sid == s) for s in (1, 2)} == {1: 5000, 2: 300} and len({r.shard for r in rows}) == 200


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, "a b", "s", 9, 8), (2, "c", "t", 7, 6)], "doc_id long, text string, source string, mix_epoch int, mix_shard int")
    assert mixing.mix(df).columns == [*df.columns, "_mix_epoch", "_mix_shard"]


def test_a_long_document_left_out_goes_in_for_a_shorter_one(spark):
    sizes = [900, 10, 20, 30, 40, 450, 480, 500, 70]
    rows = [(k, "w " * n, "a") for k, n in enumerate(sizes)] + [(k, "w " * n, "a") for k, n in enumerate(sizes)] + [(99, "w " * 3200, "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix_plan(df, keep=False, weights=(3, 5)).select("row.doc_id", "size", "source_size", "target", F.size("draws").alias("n")).collect()
    mine = [r for r in got if r.source_size == 2 * sum(sizes)]
    assert len(mine) == len(rows) - 1 and all(r.n <= 1 for r in mine)
    gap = mine[0].target - sum(r.size * r.n for r in mine)
    assert -1e-6 <= gap <= 30


def test_exchange_narrows_the_gap(spark):
    rows = [(1, 0, k, n, 1000.0) for k, n in enumerate([300, 290, 200, 310])] + [(2, 0, k, n, None) for k, n in enumerate([5, 6])]
    got = mixing._fitted(spark.createDataFrame(rows, "sid int, block long, key long, size long, left double")).collect()
    assert sorted(r.size for r in got if r.sid == 1 and r.fits) == [290, 300, 310] and not any(r.fits for r in got if r.sid == 2)
