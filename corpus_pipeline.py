"""Corpus pipeline: quality, near duplicates, secrets, source mix, pieces.

Each stage takes (spark, docs, sf_dir), works on every row that the stage before kept, and returns a
DataFrame that ``run`` writes to the shared folder and reads again for the next. What a stage saves for itself is
removed when the next one begins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vectide.llm import mixing, ngram_join, pieces, quality, secrets
from vectide.llm.common import release, saved, step, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(rows: DataFrame) -> DataFrame:
    """The columns of documents, n_chars in step with text."""
    return rows.selectExpr("doc_id", "text", "lang", "source", "CAST(length(text) AS long) AS n_chars")


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones among them, doesn't reject."""
    with step(docs):
        return _documents(quality.of_good_quality(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity 0.8 or more."""
    with step(docs):
        return _documents(ngram_join.deduplicated(docs, words=5, percent=80))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced."""
    with step(docs):
        return _documents(secrets.redact(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    with step(docs):
        return _documents(mixing.mix(docs))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The piece ids of every document of the mix."""
    with step(docs):
        return pieces.encoded(docs.select("doc_id", "lang", "source", "n_chars", "text"), keep_text=False).selectExpr("doc_id", "lang", "source", "n_chars", "CAST(size(piece_ids) AS long) AS n_pieces", "piece_ids")


STAGES = [
    ("quality", classify_quality),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("mix", mix_sources),
    ("pieces", encode_pieces),
]

#: The classifier, the similarity join and the codec have no SQL; the tests hold each against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other; of the tables between them only the last stays."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        before, docs = docs, saved(stage(spark, docs, sf_dir))
        release(before)
    return docs
