import numpy as np
import pytest
from pyspark.sql import functions as F

from vectide.llm import hamming


@pytest.mark.parametrize("bits,n", [(64, 3000), (40, 500), (128, 800), (64, 3)])
def test_index_is_exact(bits, n):
    rng = np.random.default_rng(bits + n)
    raw = rng.integers(0, 2, (n, bits))
    raw[n // 2 :] = raw[rng.integers(0, max(1, n // 20), n - n // 2)] ^ (rng.random((n - n // 2, bits)) < 0.05)
    codes = hamming.pack(["".join(map(str, r)) for r in raw])
    ids = rng.permutation(n).astype(np.int64)
    index = hamming.Index(ids, codes)
    for q in range(0, n, max(1, n // 40)):
        d = (raw != raw[q]).sum(1)
        best = np.lexsort((ids, d))[:10]
        got_d, at = index.search(codes[q], 10)
        assert got_d.tolist() == d[best].tolist() and ids[at].tolist() == ids[best].tolist()


def test_blocks_nulls_ties(spark):
    rows = [(i, "01" * 8) for i in range(30)] + [(30, None), (None, "0" * 16), (31, "1" * 16), (3, "01" * 8)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "id long, code string, rank int")
    got = hamming.top_k(df, df.filter("id in (0, 31)"), 4, rows_per_block=5).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.rank, r.neighbour_id, r.distance) for r in got] == [(0, 1, 0, 0), (0, 2, 1, 0), (0, 3, 2, 0), (0, 4, 3, 0), (31, 1, 31, 0), (31, 2, 0, 8), (31, 3, 1, 8), (31, 4, 2, 8)]
    assert hamming.top_k(df.limit(0), df, 4).count() == 0


@pytest.mark.parametrize("bits", [4, 9, 11, 16])
def test_segments(bits):
    raw = np.random.default_rng(0).integers(0, 2, (20, 40))
    cut = hamming.segments(hamming.pack(["".join(map(str, r)) for r in raw]), bits)
    wide = np.zeros((20, -(-48 // bits) * bits), int)
    wide[:, :40] = raw
    assert cut.tolist() == [[int("".join(map(str, r[k : k + bits])), 2) for k in range(0, len(r), bits)] for r in wide]


def test_proofs_end_the_search_before_all_is_compared(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", hamming.sign_code(F.col("embedding")).alias("code")).collect()
    index = hamming.Index(np.array([r.vec_id for r in rows]), hamming.pack([r.code for r in rows]))
    asked = range(0, len(rows), 100)
    for q in asked:
        index.search(index.codes[q], 10)
    assert index.verified < 0.8 * len(asked) * len(rows)


def test_a_code_that_most_rows_have(spark):
    rows = [(i, "1100" * 4) for i in range(3000, 0, -1)] + [(i, format(i % 65536, "016b")) for i in range(5000, 5200)] + [(7, "0" * 16), (7, "0" * 16)]
    df = spark.createDataFrame(rows, "id long, code string").repartition(5)
    got = hamming.top_k(df, df.filter("id in (7, 5000, 3000)").distinct(), 5, rows_per_block=50).collect()
    for q, code in {(i, c) for i, c in rows if i in (5000, 3000)}:
        want = sorted((sum(a != b for a, b in zip(code, c, strict=True)), i) for i, c in rows)[:5]
        assert [(r.distance, r.neighbour_id) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] == want
