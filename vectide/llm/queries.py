"""Registry of the training-data queries: each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectide.llm import chats, hamming, mixing, ngram_join, pieces, quality, secrets, spots, token_counts, wrappers
from vectide.llm.common import table


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.mix_plan(table(spark, sf_dir, "documents"), keep=False)
    return rows.select("row.doc_id", "size", "source_size", "target", (F.col("size") * F.size("draws")).cast("long").alias("taken"))


def op3_hamming_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest sign codes of every hundredth vector, itself included."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), hamming.sign_code(F.col("embedding")).alias("code"))
    return hamming.top_k(rows, rows.filter("id % 100 = 0"), 10)


def op4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trips(table(spark, sf_dir, "documents"))


def op5_spots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spots.edited_fingerprints(table(spark, sf_dir, "documents"))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(table(spark, sf_dir, "documents"), words=3, percent=90)


def op7_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chats.maximal_chats(table(spark, sf_dir, "conversations"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = token_counts.token_counts(table(spark, sf_dir, "documents"))
    return rows.withColumn("over_limit", F.col("n_tokens") > 1024)


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = secrets.find_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["rank"] < len(secrets.BASE_KINDS))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return rows.select("doc_id", *map(count, secrets.BASE_KINDS), F.sha2(secrets.joined(base), 256).alias("base_sha256"), secrets.joined(F.col("spans")).alias("spans"))


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.main_texts(table(spark, sf_dir, "pages"))


QUERIES: dict = {
    "op1_quality": op1_quality,
    "op2_mix": op2_mix,
    "op3_hamming_top_k": op3_hamming_top_k,
    "op4_pieces": op4_pieces,
    "op5_spots": op5_spots,
    "op6_ngram_join": op6_ngram_join,
    "op7_chats": op7_chats,
    "op8_token_counts": op8_token_counts,
    "op9_secrets": op9_secrets,
    "op10_main_text": op10_main_text,
}

ORACLES: dict = {
    "op3_hamming_top_k": """
        WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x > 0) AS bits FROM embeddings),
        d AS (
            SELECT q.vec_id AS query_id, e.vec_id AS neighbour_id,
                   CAST(list_sum(list_transform(list_zip(q.bits, e.bits), lambda p: CASE WHEN p[1] <> p[2] THEN 1 ELSE 0 END)) AS INTEGER) AS distance
            FROM e q, e WHERE q.vec_id % 100 = 0
        )
        SELECT query_id, CAST(rank AS INTEGER) AS rank, neighbour_id, distance
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbour_id) AS rank FROM d)
        WHERE rank <= 10
    """,
    "op6_ngram_join": r"""
        WITH RECURSIVE d AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
        ),
        s AS (
            SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                   ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS shingles
            FROM d
        ),
        x AS (SELECT doc_id, len(shingles) AS n, unnest(shingles) AS shingle FROM s),
        links AS (
            SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
            GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
        ),
        reach AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT links.b, reach.root FROM reach JOIN links ON links.a = reach.doc_id)
        SELECT s.doc_id, CAST(len(s.shingles) AS BIGINT) AS n_shingles, c.component_id
        FROM s JOIN (SELECT doc_id, min(root) AS component_id FROM reach GROUP BY doc_id) c ON c.doc_id = s.doc_id
    """,
    "op7_chats": """
        WITH t AS (
            SELECT log, conv_id, row_number() OVER (PARTITION BY log ORDER BY turn NULLS FIRST, coalesce(role, 'unknown'), coalesce(text, '')) AS pos,
                   '<|im_start|>' || coalesce(role, 'unknown') || chr(10) || replace(coalesce(text, ''), '<|', '< |') || '<|im_end|>' || chr(10) AS shown,
                   {'role': coalesce(role, 'unknown'), 'text': coalesce(text, '')} AS said
            FROM (SELECT coalesce(CAST(conv_id AS VARCHAR), '-' || row_number() OVER ()) AS log, * FROM conversations)
        ),
        c AS (SELECT min(conv_id) AS conv_id, count(*) AS n, list(said ORDER BY pos) AS turns, string_agg(shown, '' ORDER BY pos) AS chat FROM t GROUP BY log),
        u AS (SELECT turns, min(conv_id) AS conv_id, min(n) AS n_turns, count(*) AS n_copies, min(chat) AS chat FROM c GROUP BY turns),
        p AS (SELECT DISTINCT turns[1:k] AS turns FROM (SELECT turns, unnest(range(1, n_turns)) AS k FROM u))
        SELECT conv_id, n_turns, n_copies, chat FROM u WHERE turns NOT IN (SELECT turns FROM p)
    """,
}
