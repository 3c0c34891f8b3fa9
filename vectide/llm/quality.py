"""Quality classifier: ridge regression on random Fourier features of document statistics, then isotonic calibration.

1. Every text becomes a fixed row of statistics (lengths, character classes, repetition,
   compressibility). The text alone decides; id, source, language and labels never enter.
2. Statistics are standardised with the mean and deviation over all documents. Random Fourier
   features, cos(Wx + b) with Gaussian W, approximate a Gaussian kernel on them.
3. Each partition of labelled rows sums its normal equations; the sums are added in a second step and
   solved once on the driver, whose memory depends on the number of features alone.
4. Raw scores of the training rows are counted in a fixed number of bins; pooling adjacent violators
   makes the rate of label 1 monotone in the score, and straight lines join the pools. A thousandth
   of the raw score is mixed in, so that ranks within a pool survive.

All labelled rows train; nothing is sampled. Null texts count as empty and are scored too; labels that
are null are left out; a document labelled twice counts twice; without labels every score is 0.5.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from vectide.llm.common import free_name, ident, only, saved, tidy

FEATURES = 256
RIDGE = 1e-3
BINS = 512
LOW, HIGH = -0.5, 1.5
THRESHOLD = 0.3
SEED = 20
# Byte classes counted by the statistics.
_CLASSES = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" ", b"\n", b".,;:?", b"!", b"#$%&*@^~+=<>{}[]\\/_", b"|", b"\"'()-", bytes(range(0xC0, 0x100))]
_ENDS = (".", "!", "?")


def statistics(text: str) -> list[float]:
    raw = text.encode()
    n = max(1, len(raw))
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    out = [float(counts[list(c)].sum()) / n for c in _CLASSES]
    words = text.split()
    m = max(1, len(words))
    lines = [x for x in text.split("\n") if x]
    lengths = [len(w) for w in words]
    top = Counter(words).most_common(3)
    return [
        *out,
        float(np.log1p(n)),
        float(np.log1p(len(words))),
        sum(lengths) / m,
        float(np.log1p(max(lengths, default=0))),
        len(set(words)) / m,
        len(set(zip(words, words[1:]))) / max(1, m - 1),
        len(set(zip(words, words[1:], words[2:]))) / max(1, m - 2),
        sum(map(str.__eq__, words, words[1:])) / max(1, m - 1),
        len(set(lines)) / max(1, len(lines)),
        float(np.log1p(m / max(1, len(lines)))),
        sum(c for _, c in top) / m,
        sum(w.endswith(_ENDS) for w in words) / m,
        sum(w.isupper() for w in words) / m,
        sum(not w[-1].isalnum() for w in words) / m,
        len(zlib.compress(raw, 1)) / n if raw else 0.0,
    ]


STATISTICS = len(statistics("a"))


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def raw(self, x: np.ndarray) -> np.ndarray:
        return fourier((x - self.mean) / self.scale) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = self.raw(x)
        level = np.clip((raw - LOW) / (HIGH - LOW), 0, 1)
        return np.clip(0.999 * np.interp(raw, self.knots, self.values) + 0.001 * level, 0, 1)


def fourier(x: np.ndarray) -> np.ndarray:
    """Random features of standardised statistics, and a constant."""
    rng = np.random.default_rng(SEED)
    w = rng.normal(size=(STATISTICS, FEATURES)) / np.sqrt(STATISTICS)
    b = rng.uniform(0, 2 * np.pi, FEATURES)
    # far outliers carry no more news than 8 deviations do
    return np.hstack([np.sqrt(2 / FEATURES) * np.cos(np.clip(x, -8, 8) @ w + b), np.ones((len(x), 1))])


@arrow_udf(T.ArrayType(T.FloatType()))
def text_statistics(texts: pa.Array) -> pa.Array:
    """The statistics of each text; a null text counts as empty."""
    from vectide.llm.quality import statistics as own

    only()
    offsets, values = np.arange(len(texts) + 1, dtype=np.int32) * STATISTICS, np.empty((len(texts), STATISTICS), np.float32)
    for k in range(0, len(texts), 512):
        part = texts.slice(k, 512)
        values[k : k + len(part)] = [own(t or "") for t in part.to_pylist()]
    tidy()
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.ravel()))


def _matrix(column) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(len(column), STATISTICS)


def fit(stats: DataFrame, labelled: DataFrame, ridge: float = RIDGE) -> Model:
    """stats: column stats, a row for every document. labelled: stats, label (0 or 1), the rows to learn from."""
    each = [F.col("stats")[k] for k in range(STATISTICS)]
    row = stats.agg(*[F.avg(x) for x in each], *[F.stddev_pop(x) for x in each]).first()
    mean, scale = (np.array([v or 0.0 for v in row[k : k + STATISTICS]]) for k in (0, STATISTICS))
    scale[scale < 1e-9] = 1.0
    size = FEATURES + 1

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, y, n = np.zeros((size, size)), np.zeros(size), 0
        for b in batches:
            if b.num_rows:
                x, label = _matrix(b.column("stats")), np.asarray(b.column("label"), np.float64)
                for k in range(0, len(x), 2048):
                    z = fourier((x[k : k + 2048] - mean) / scale)
                    a += z.T @ z
                    y += z.T @ label[k : k + 2048]
                n += b.num_rows
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % 16], pa.int32()), pa.array([np.vstack([a, y]).tobytes()]), pa.array([n], pa.int64())], ["part", "sums", "n"])

    def added(group: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, np.float64) for x in group.column("sums").to_pylist())
        return pa.table({"sums": pa.array([total.tobytes()]), "n": pa.array([sum(group.column("n").to_pylist())], pa.int64())})

    parts = labelled.select("stats", "label").mapInArrow(sums, "part int, sums binary, n long").groupBy("part").applyInArrow(added, "sums binary, n long").collect()
    if not parts:
        return Model(mean, scale, np.zeros(size), np.array([LOW, HIGH]), np.array([0.5, 0.5]))
    total = sum(np.frombuffer(p["sums"], np.float64) for p in parts).reshape(size + 1, size)
    n = sum(p["n"] for p in parts)
    penalty = np.full(size, ridge * n)
    penalty[-1] = 1e-9 * n
    weights = np.linalg.solve(total[:size] + np.diag(penalty), total[size])
    model = Model(mean, scale, weights, np.array([LOW, HIGH]), np.array([0.0, 1.0]))
    width = (HIGH - LOW) / BINS

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, ones = np.zeros(BINS, np.int64), np.zeros(BINS, np.int64)
        for b in batches:
            if b.num_rows:
                raw = np.concatenate([model.raw(_matrix(b.column("stats").slice(k, 2048))) for k in range(0, b.num_rows, 2048)])
                at = np.clip((raw - LOW) / width, 0, BINS - 1).astype(int)
                n += np.bincount(at, minlength=BINS)
                ones += np.bincount(at, weights=np.asarray(b.column("label"), np.float64), minlength=BINS).astype(np.int64)
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(n[used]), pa.array(ones[used])], ["bin", "n", "ones"])

    counted = labelled.select("stats", "label").mapInArrow(bins, "bin int, n long, ones long").groupBy("bin").agg(F.sum("n").alias("n"), F.sum("ones").alias("ones")).orderBy("bin").collect()
    model.knots, model.values = isotonic([(LOW + (r["bin"] + 0.5) * width, r["n"], r["ones"]) for r in counted])
    return model


def isotonic(bins: list[tuple[float, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """bins: place, rows, rows of label 1, by place. Pools adjacent violators; a pool stands at its rows' mean place."""
    pools: list[list[float]] = []
    for x, n, ones in bins:
        pools.append([x * n, n, ones])
        while len(pools) > 1 and pools[-2][2] * pools[-1][1] >= pools[-1][2] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    return np.array([p[0] / p[1] for p in pools]), np.array([p[2] / p[1] for p in pools])


def score_of(model: Model):  # noqa: ANN201
    """A function of a statistics column."""

    @arrow_udf(T.DoubleType())
    def score(stats: pa.Array) -> pa.Array:
        parts = [model.score(_matrix(stats.slice(k, 2048))) for k in range(0, len(stats), 2048)]
        return pa.array(np.concatenate(parts) if parts else np.empty(0), pa.float64())

    return score


def held_out(doc_id: Column) -> Column:
    """Every fifth document by checksum of its id; rows without id are held out."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def learn(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", stats_col: str = "stats", keep: bool = False) -> tuple[Model, DataFrame]:
    """The model, and saved rows of docs with their statistics: doc_id and stats_col, or all columns and stats_col if keep."""
    stats = text_statistics(F.col(ident(text_col))).alias(stats_col)
    rows = saved(docs.select("*", stats) if keep else docs.select(F.col(ident(id_col)).alias("doc_id"), stats))
    each = rows.select(F.col(ident(id_col) if keep else "doc_id").alias("doc_id"), F.col(ident(stats_col)).alias("stats"))
    told = labels.select(F.col(ident(id_col)).alias("of"), F.col(ident(label_col)).cast("int").alias("label")).filter("label in (0, 1)")
    labelled = each.filter(~held_out(F.col("doc_id"))).join(told, F.col("doc_id") == F.col("of"))
    return fit(each, saved(labelled.select("stats", "label"))), rows


def quality_scores(docs: DataFrame, labels: DataFrame, **columns) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted."""
    model, rows = learn(docs, labels, **columns)
    scored = rows.select("doc_id", score_of(model)(F.col("stats")).alias("score"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def of_good_quality(docs: DataFrame, labels: DataFrame, *, threshold: float = THRESHOLD, **columns) -> DataFrame:
    """The rows of docs that score at least threshold, with docs' columns. Texts are read once and not shuffled; only statistics go to the scoring worker."""
    at = free_name(docs, "quality_stats")
    model, rows = learn(docs, labels, stats_col=at, keep=True, **columns)
    return rows.filter(score_of(model)(F.col(at)) >= threshold).drop(at)
