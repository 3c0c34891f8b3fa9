"""The registered queries: contract columns and types, one row per row of the table, SQL counterparts."""

import glob
import os
import re
import zlib

import duckdb
import pytest

from vectide.llm import queries

DATA = "/root/testdata/sf0.001"
# The contracts' columns.
COLUMNS = {
    "op1_quality": ("documents", {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}),
    "op2_mix": ("documents", {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"}),
    "op4_pieces": ("documents", {"doc_id": "bigint", "n_pieces": "bigint", "round_trip": "boolean"}),
    "op5_spots": ("documents", {"doc_id": "bigint", "n_chars": "bigint", "edited_sha256": "string", "fingerprint": "string", "edited_fingerprint": "string", "near_edited": "double", "near_next": "double"}),
    "op6_ngram_join": ("documents", {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint"}),
    "op8_token_counts": ("documents", {"doc_id": "bigint", "n_bytes": "bigint", "n_tokens": "bigint", "over_limit": "boolean"}),
    "op9_secrets": ("documents", {"doc_id": "bigint", "n_assign": "bigint", "n_access": "bigint", "n_hex": "bigint", "base_sha256": "string", "spans": "string"}),
    "op10_main_text": ("pages", {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"}),
}


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_contract(spark, name):
    table, columns = COLUMNS[name]
    df = queries.QUERIES[name](spark, DATA)
    kinds = dict(df.dtypes)
    assert {c: kinds.get(c) for c in columns} == columns
    key = next(iter(columns))
    rows = df.collect()
    assert sorted(r[key] for r in rows) == sorted(r[key] for r in spark.read.parquet(f"{DATA}/{table}.parquet").select(key).collect())
    if name == "op1_quality":
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    if name == "op8_token_counts":
        assert all(r.over_limit == (r.n_tokens > 1024) for r in rows)
    if name == "op4_pieces":
        assert all(r.round_trip for r in rows)
    if name == "op9_secrets":
        assert all(re.fullmatch(r"([a-z]+:\d+:\d+(,|$))*", r.spans) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql_counterpart(spark, sql, name):
    df = queries.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    shown = lambda rows: sorted(tuple(map(repr, r)) for r in rows)
    assert shown(tuple(r) for r in df.select(*columns).collect()) == shown(sql.sql(f"SELECT {', '.join(columns)} FROM ({queries.ORACLES[name]})").fetchall())


def test_each_operator_has_one_query():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES) == list(range(1, 11))
