from collections import Counter

import corpus_pipeline
from test_mixing import WORD, plain_targets
from test_ngram_join import brute
from test_secrets import base, entropy
from vectide.llm import pieces, secrets
from pyspark.sql import functions as F


def plain_redacted(text):
    """Each group of overlapping spans replaced once."""
    spans = base(text)
    out, reach = "", 0
    for start, _, end, _ in sorted(spans + entropy(text, spans)):
        if start >= reach:
            out += text[reach:start] + secrets.REPLACEMENT
        reach = max(reach, end)
    return out + text[reach:]


def test_stages_and_run(spark):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    labels = spark.read.parquet(f"{d}/labels.parquet")
    after = {}
    from vectide.llm.common import saved

    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, saved(stage(spark, docs, d))
        after[name] = docs
        if name != "pieces":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            assert docs.select("doc_id").subtract(before.select("doc_id")).isEmpty()
    kept = {r.doc_id for r in after["quality"].collect()}
    good = [r.doc_id for r in labels.filter("quality = 1").collect()]
    bad = [r.doc_id for r in labels.filter("quality = 0").collect()]
    assert sum(i in kept for i in good) >= 0.99 * len(good) and sum(i in kept for i in bad) <= 0.1 * len(bad)
    assert after["near_duplicates"].count() == after["near_duplicates"].select("doc_id").distinct().count() < after["quality"].count()
    assert secrets.find_spans(after["secrets"]).filter(F.exists("spans", lambda s: s["rank"] < 3)).isEmpty()
    assert after["secrets"].count() == after["near_duplicates"].count()
    texts = {r.doc_id: r.text for r in after["mix"].collect()}
    codec = pieces.load(None)
    rows = after["pieces"].collect()
    assert len(rows) == after["mix"].count()
    assert all(codec.decode(r.piece_ids) == texts[r.doc_id] and r.n_pieces == len(r.piece_ids) for r in rows)
    assert corpus_pipeline.run(spark, d).count() == len(rows)
    # each stage's rows against a plain version of it on the same input
    into = {name: [(r.doc_id, r.text) for r in after[name].collect()] for name in ("quality", "near_duplicates", "secrets")}
    parts = brute(into["quality"], 5, 80)
    assert sorted(i for i, _ in into["near_duplicates"]) == sorted({c for _, n, c in parts if n} | {i for i, n, _ in parts if not n})
    assert set(into["near_duplicates"]) <= set(into["quality"])
    assert sorted(into["secrets"]) == sorted((i, plain_redacted(t)) for i, t in into["near_duplicates"])
    source = {r.doc_id: r.source for r in after["secrets"].collect()}
    size = {i: len(WORD.findall(t)) for i, t in into["secrets"]}
    texts_in = dict(into["secrets"])
    words, taken, times = Counter(), Counter(), Counter()
    for i, n in size.items():
        words[source[i]] += n
    for r in after["mix"].collect():
        assert r.text == texts_in[r.doc_id] and r.source == source[r.doc_id]
        taken[r.source] += size[r.doc_id]
        times[r.doc_id] += 1
    assert max(times.values()) <= 3
    for s, want in plain_targets(dict(words)).items():
        assert -1 <= want - taken[s] <= max(100, want / 50)


def test_odd_and_empty_tables(spark, tmp_path):
    long = "Once more the end. " * 40_000
    rows = [
        (1, "A plain text. It has some words.", "en", "s1", 32, 1),
        (1, "A plain text. It has some words.", "en", "s1", 32, 1),
        (2, None, None, None, None, 2),
        (None, "no id here", "en", "s1", 10, 3),
        (3, "", "en", "s2", 0, 4),
        (4, long, "en", "s2", len(long), 5),
        (5, long + "x", "en", None, len(long) + 1, 6),
        (6, 'token = "1eb9c654e721b4f812088970e66a6345cee33dd6"', "en", "s3", 50, 7),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, stats int")
    labels = spark.createDataFrame([(1, 1, 0), (4, 1, 0), (3, None, 0), (None, 1, 1), (6, 1, 0)], "doc_id long, quality int, toxic int")
    for name, docs in (("odd", df), ("none", df.limit(0))):
        d = f"{tmp_path}/{name}"
        docs.write.parquet(f"{d}/documents.parquet")
        (labels if name == "odd" else labels.limit(0)).write.parquet(f"{d}/labels.parquet")
        got = corpus_pipeline.run(spark, d).collect()
        assert (len(got) > 0) == (name == "odd")
        kept = {r.doc_id for r in got}
        assert not {4, 5} <= kept
        for r in got:
            if r.doc_id == 6:
                assert "1eb9c654" not in pieces.load(None).decode(r.piece_ids)
