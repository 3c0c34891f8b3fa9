import random

import pytest
import public_tokenizers
from tokenizers import Tokenizer

from vectide.llm import token_counts as tc


@pytest.fixture(scope="module")
def tok():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def whole(tok, text):
    return len(tok.encode(text, add_special_tokens=False).ids)


def test_chunks_agree_with_one_pass(tok):
    rng = random.Random(5)
    parts = ["word", " the", "  ", "\n\n", "<|endoftext|>", "<|endo", "é", "日本", "12345", "!!", "'s", " ", "\t", "a" * 40, "🙂", " x"]
    for n in (50, 300, 900):
        for _ in range(25):
            text = "".join(rng.choice(parts) for _ in range(n))
            assert tc.count_huge(tok, text, 256, 80) == whole(tok, text)


@pytest.mark.parametrize("text", ["", " " * 5000, "a" * 5000, "ab " * 4000, "!" * 3000 + " " * 3000 + "x", "\n" * 700 + "word " * 900, "<|endoftext|>" * 300])
def test_degenerate_texts(tok, text):
    assert tc.count_batch(tok, [text, "", text[:7]], 256, 80) == [whole(tok, text), 0, whole(tok, text[:7])]


def test_pre_tokens_agree_with_whole_texts(tok):
    rng = random.Random(9)
    letters = [chr(c) for c in range(0x250)]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    parts = ["don't", " I'll", "'S", "  ", " ", "\n\n", "\t", "\x1c", "\x85", "\xa0", "x", "12", "!?", "é", "ß", " ²", "ª", "<|endoftext|>", "<|endo", "日", "\u2003", "\u0301", "word", " the"]
    texts += ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    assert tc.count_batch(tok, texts) == [whole(tok, t) for t in texts]


def test_whole_table(tok):
    import pyarrow.parquet as pq

    texts = [t or "" for t in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).column(0).to_pylist()]
    assert tc.count_batch(tok, texts) == [whole(tok, t) for t in texts]


def test_rows_nulls_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "hello world", 5), (1, "hello world", 5), (2, None, 6), (None, "", 7)], "doc_id long, text string, n_tokens long")
    got = sorted((tuple(r) for r in tc.token_counts(df).collect()), key=str)
    assert got == sorted([(1, 11, 2), (1, 11, 2), (2, 0, 0), (None, 0, 0)], key=str)
    assert tc.token_counts(df.limit(0)).count() == 0
