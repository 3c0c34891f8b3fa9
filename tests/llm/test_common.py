import tracemalloc

import numpy as np
import pyarrow as pa

from vectide.llm import common, pieces, quality, shingles


def test_a_worker_keeps_what_one_operator_left():
    codec = pieces.load(None)
    ids = codec.encode("One text of a few words.")
    assert pieces.load(None) is codec
    first = [s.tolist() for s in shingles.shingle_sets(pa.array(["One text of a few words."]), 3)]
    assert not pieces._loaded and shingles._tables
    assert pieces.load(None).encode("One text of a few words.") == ids and not shingles._tables
    assert [s.tolist() for s in shingles.shingle_sets(pa.array(["One text of a few words."]), 3)] == first
    pieces.load(None)
    quality.text_statistics.func(pa.array(["a b", None]))
    assert not pieces._loaded and not shingles._tables


def test_only_lets_go_of_the_others():
    one, two = common.kept_between_tasks(), common.kept_between_tasks()
    one["x"], two["x"] = 1, 2
    common.only(two)
    assert not one and two == {"x": 2}
    common.only()
    assert not two


def test_memory_of_shingle_sets():
    words = np.random.default_rng(0).integers(0, 50_000, 400_000)
    texts = pa.array([" ".join(f"word{x}" for x in words[k : k + 400]) for k in range(0, len(words), 400)])
    list(shingles.shingle_sets(texts.slice(0, 1), 3))
    tracemalloc.start()
    for _ in shingles.shingle_sets(texts, 3):
        pass
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20e6
