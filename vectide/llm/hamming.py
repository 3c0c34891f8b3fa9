"""Exact top-k search over binary codes by incremental multi-index hashing.

Equal codes form a class that keeps its k least ids, so a code that many rows have is searched once. Classes are
packed into blocks of codes, queries likewise; each pair of blocks is searched on its own
and the blocks' best are merged by (distance, id). In a block of n codes every code is cut into segments of
about log2 n bits (16 at most) with a bucket index each. For a query the radius grows: at radius r the buckets whose key
differs from the query's segment in exactly r bits are probed and their codes verified in full. A code
not met after segment j at radius r differs in at least (j+1)(r+1) + (m-j-1)r bits; once the kth
verified distance is below that, the k best are proven, ties included. No size or radius switches to a scan.

Rows with a null code are left out; ties go to the smaller id; repeated rows appear each; fewer than
k rows give fewer results; an empty side gives none.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vectide.llm.common import ident, saved

#: Codes are packed in words of so many bits; a segment has no more.
WORD_BITS = 16
LEAST_SEGMENT = 4
ROWS_PER_BLOCK = 65_536
QUERIES_PER_BLOCK = 1_024

#: Block indexes that a worker keeps.
HELD_INDEXES = 8

_masks: dict[tuple[int, int], np.ndarray] = {}
_held: dict[bytes, Index] = {}


def sign_code(embedding: Column) -> Column:
    """One bit per dimension, set where the value is positive, as a string of 0 and 1; null for a null vector."""
    return F.when(embedding.isNotNull(), F.concat_ws("", F.transform(embedding, lambda x: F.when(x > 0, F.lit("1")).otherwise(F.lit("0")))))


def masks(bits: int, r: int) -> np.ndarray:
    if (bits, r) not in _masks:
        _masks[bits, r] = np.array([sum(1 << b for b in c) for c in itertools.combinations(range(bits), r)], np.uint16)
    return _masks[bits, r]


def pack(codes: list[str]) -> np.ndarray:
    """Codes as rows of 16-bit words; bits past the end are 0."""
    bits = max(1, max(map(len, codes)))
    wide = -(-bits // WORD_BITS) * WORD_BITS
    raw = np.frombuffer("".join(c.ljust(wide, "0") for c in codes).encode(), np.uint8).reshape(len(codes), wide) - 48
    return np.packbits(raw, axis=1).view(">u2").astype(np.uint16)


def segments(codes: np.ndarray, bits: int) -> np.ndarray:
    """The codes cut anew, into segments of so many bits; the last one is filled up with 0."""
    raw = np.unpackbits(codes.astype(">u2").view(np.uint8).reshape(len(codes), -1), axis=1)
    m = -(-raw.shape[1] // bits)
    wide = np.zeros((len(codes), m, bits), np.uint16)
    wide.reshape(len(codes), -1)[:, : raw.shape[1]] = raw
    return (wide << np.arange(bits - 1, -1, -1, dtype=np.uint16)).sum(axis=2, dtype=np.uint16)


class Index:
    """Buckets of each segment over one block. verified counts the codes that searches have compared in full."""

    def __init__(self, ids: np.ndarray, codes: np.ndarray):
        self.ids, self.codes, self.verified = ids, codes, 0
        self.bits = min(WORD_BITS, max(LEAST_SEGMENT, round(math.log2(max(1, len(ids))))))
        keys = segments(codes, self.bits)
        self.m = keys.shape[1]
        self.order = [np.argsort(keys[:, j], kind="stable").astype(np.int32) for j in range(self.m)]
        self.start = [np.concatenate([[0], np.cumsum(np.bincount(keys[:, j], minlength=1 << self.bits))]) for j in range(self.m)]

    def near(self, segment: int, keys: np.ndarray) -> np.ndarray:
        lo, hi = self.start[segment][keys], self.start[segment][keys.astype(np.int64) + 1]
        n = hi - lo
        if not (total := int(n.sum())):
            return np.empty(0, np.int32)
        at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(total)
        return self.order[segment][at]

    def search(self, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(distances, places) of the k best, by distance, then id."""
        rows = len(self.ids)
        seen, found, dist = np.zeros(rows, bool), [], []
        key = segments(query[None, :], self.bits)[0]

        def proven() -> bool:
            for r in range(self.bits + 1):
                for j in range(self.m):
                    at = self.near(j, key[j] ^ masks(self.bits, r))
                    at = np.unique(at[~seen[at]])
                    seen[at] = True
                    found.append(at)
                    dist.append(np.bitwise_count(self.codes[at] ^ query).sum(axis=1, dtype=np.int32))
                    have = np.concatenate(dist)
                    bound = (j + 1) * (r + 1) + (self.m - j - 1) * r
                    if len(have) >= rows or len(have) >= k and np.partition(have, k - 1)[k - 1] < bound:
                        return True
            return False

        if rows and not proven():
            raise AssertionError("a code in no bucket")
        if not rows:
            return np.empty(0, np.int32), np.empty(0, np.int32)
        d, at = np.concatenate(dist), np.concatenate(found)
        self.verified += len(d)
        best = np.lexsort((self.ids[at], d))[:k]
        return d[best], at[best]


def index_of(ids: bytes, codes: bytes, m: int) -> Index:
    """The index of a packed block; a worker keeps some, as blocks and queries may come in any order."""
    key = hashlib.blake2b(ids + codes, digest_size=16).digest()
    if key not in _held:
        while len(_held) >= HELD_INDEXES:
            del _held[next(iter(_held))]
        _held[key] = Index(np.frombuffer(ids, np.int64), np.frombuffer(codes, np.uint16).reshape(-1, m))
    return _held[key]


def _packed(rows: DataFrame, size: int) -> DataFrame:
    """rows: cls, id, code. Blocks of so many rows: ids, cls, codes, m (words of a code)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def block(rows: pa.Table) -> pa.RecordBatch:
            c = pack(rows.column("code").to_pylist())
            cls, ids = (np.asarray(rows.column(x), np.int64).tobytes() for x in ("cls", "id"))
            return pa.RecordBatch.from_arrays([pa.array([ids]), pa.array([cls]), pa.array([c.tobytes()]), pa.array([c.shape[1]], pa.int32())], ["ids", "cls", "codes", "m"])

        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) >= size:
                rows = pa.Table.from_batches(held)
                for at in range(0, len(rows) - size + 1, size):
                    yield block(rows.slice(at, size))
                held = rows.slice(len(rows) - len(rows) % size).to_batches()
        if rest := [b for b in held if b.num_rows]:
            yield block(pa.Table.from_batches(rest))

    return rows.mapInArrow(run, "ids binary, cls binary, codes binary, m int")


def top_k(data: DataFrame, queries: DataFrame, k: int, *, id_col: str = "id", code_col: str = "code", rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """data, queries: id (long), code (string of 0 and 1 of one length). Returns query_id, rank, neighbour_id, distance."""
    clean = lambda df: df.select(F.col(ident(id_col)).cast("long").alias("id"), F.col(ident(code_col)).alias("code")).filter("id is not null and code is not null")
    first = F.row_number().over(Window.partitionBy("code").orderBy("id"))  # at most k rows of a code leave a task
    classes = clean(data).withColumn("rank", first).filter(F.col("rank") <= k).groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    classes = saved(classes.select(F.monotonically_increasing_id().alias("cls"), F.col("ids")[0].alias("id"), "code", "ids"))
    blocks, asked = saved(_packed(classes.select("cls", "id", "code"), rows_per_block)), saved(_packed(clean(queries).select(F.lit(0).cast("long").alias("cls"), "id", "code"), QUERIES_PER_BLOCK))
    pairs = blocks.crossJoin(asked.select(F.col("ids").alias("q_ids"), F.col("codes").alias("q_codes")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from vectide.llm.hamming import index_of as own

        for b in batches:
            for row in b.to_pylist():
                index, cls = own(row["ids"], row["codes"], row["m"]), np.frombuffer(row["cls"], np.int64)
                asked_ids = np.frombuffer(row["q_ids"], np.int64)
                out = [(np.full(len(d), q), at, d) for q, (d, at) in zip(asked_ids, (index.search(c, k) for c in np.frombuffer(row["q_codes"], np.uint16).reshape(len(asked_ids), -1)), strict=True)]
                q, at, d = (np.concatenate(x) for x in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(index.ids[at], pa.int64()), pa.array(cls[at], pa.int64()), pa.array(d, pa.int32())], ["query_id", "id", "found", "distance"])

    found = pairs.mapInArrow(run, "query_id long, id long, found long, distance int")
    # the k best rows lie in the k best classes, as a class stands at its least id
    best = lambda df, *order: df.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).filter(F.col("rank") <= k)
    found = best(found, "distance", "id", "found").drop("rank", "id")
    rows = found.join(classes.select("cls", "ids"), F.col("found") == F.col("cls")).select("query_id", F.explode("ids").alias("neighbour_id"), "distance")
    return best(rows, "distance", "neighbour_id").select("query_id", "rank", "neighbour_id", "distance")
