import random

import public_tokenizers
import pytest
import sentencepiece

from vectide.llm import pieces


def varint(raw, at):
    value = shift = 0
    while True:
        value |= (raw[at] & 127) << shift
        at, shift = at + 1, shift + 7
        if raw[at - 1] < 128:
            return value, at


def as_unigram(raw):
    """The model file with its type set to unigram, so that the library segments by best score."""
    at = 0
    while at < len(raw):
        tag, at = varint(raw, at)
        size, body = varint(raw, at)
        if tag >> 3 == 2:
            k = body
            while k < body + size:
                t, k = varint(raw, k)
                if t == 3 << 3:
                    return raw[:k] + b"\x01" + raw[k + 1 :]
                if t & 7 == 2:
                    n, k = varint(raw, k)
                    k += n
                elif t & 7 == 5:
                    k += 4
                else:
                    _, k = varint(raw, k)
        at = body + size
    raise ValueError


@pytest.fixture(scope="module")
def codec():
    return pieces.load(None)


TEXTS = ["Hello world", "a", " lead", "The theory\nof\teverything.", "é日本 🙂 ok", "x" * 300, "naïve café", "#include <stdio.h>", "123 4567", "…\x00", "ends "]


def test_against_library_by_best_score(codec):
    sp = sentencepiece.SentencePieceProcessor(model_proto=as_unigram(open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read()))
    rng = random.Random(2)
    texts = TEXTS + ["".join(rng.choice("abcdeth ,.ñé") for _ in range(rng.randint(1, 60))).replace("  ", " ") for _ in range(200)]
    same = 0
    for t in texts:
        want, got = sp.encode(t), codec.encode(t)
        score = lambda ids: sum(sp.get_score(i) if not sp.is_byte(i) else 0 for i in ids)
        assert sum(sp.is_byte(i) for i in want) == sum(sp.is_byte(i) for i in got), t
        assert score(got) >= score(want) - 1e-3, t
        same += want == got
    assert same >= 0.97 * len(texts)


def brute(codec, table, text):
    """Best score over all segmentations, by plain dynamic programming over start and end."""
    best = [0.0] + [-float("inf")] * len(text)
    for e in range(1, len(text) + 1):
        for s in range(max(0, e - 20), e):
            if text[s:e] in table:
                best[e] = max(best[e], best[s] + table[text[s:e]])
        if text[e - 1] not in table:
            best[e] = max(best[e], best[e - 1] + codec.bad)
    return best[-1]


def test_best_score_and_round_trip(codec):
    small = pieces.Codec([("<unk>", 0.0), ("▁", -2.0), ("a", -1.0), ("b", -1.5), ("ab", -1.2), ("▁ab", -2.0), ("bab", -2.1), ("▁▁", -2.5), ("bb", -2.9)], {}, 0, set())
    table = {"▁": -2.0, "a": -1.0, "b": -1.5, "ab": -1.2, "▁ab": -2.0, "bab": -2.1, "▁▁": -2.5, "bb": -2.9}
    score = dict(enumerate([0, -2.0, -1.0, -1.5, -1.2, -2.0, -2.1, -2.5, -2.9]))
    rng = random.Random(4)
    for _ in range(400):
        t = "".join(rng.choice("ab cab") for _ in range(rng.randint(1, 14)))
        ids = small.encode(t)
        assert sum(small.bad if i == 0 else score[i] for i in ids) == pytest.approx(brute(small, table, "▁" + t.replace(" ", "▁")))
    for t in [*TEXTS, "", "  two  blanks  ", "\n\n", "日" * 500, "a " * 5000]:
        assert codec.decode(codec.encode(t)) == t


def test_rows(spark):
    df = spark.createDataFrame([(1, "ab cd", 3), (1, "ab cd", 3), (2, None, 4), (None, "", 5)], "doc_id long, text string, n_pieces int")
    got = sorted(((r.doc_id, r.n_pieces, r.round_trip) for r in pieces.round_trips(df).collect()), key=str)
    n = len(pieces.load(None).encode("ab cd"))
    assert got == sorted([(1, n, True), (1, n, True), (2, 0, True), (None, 0, True)], key=str)
    out = pieces.encoded(df)
    assert out.columns == [*df.columns, "piece_ids"] and out.count() == 4 and pieces.encoded(df.limit(0)).count() == 0
