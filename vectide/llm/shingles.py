"""Distinct word-shingle sets of Arrow string batches, vectorised in numpy.

Words are runs without white space, A-Z lower-cased. A word's hash is a polynomial over random
64-bit values of its bytes, read off running sums; a shingle's hash mixes its words' hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from vectide.llm.common import kept_between_tasks, only

#: Bytes hashed at a time: about 50 bytes of a worker's memory for each.
PIECE_BYTES = 1 << 18
#: Rows whose texts are laid out for numpy at a time; bounds a worker's memory whatever the batch size.
SLICE_ROWS = 512
_MULT = np.uint64(0x9E3779B97F4A7C15)
_tables = kept_between_tasks()


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _tables.get("powers")
    if have is None or len(have[0]) < n + 1:
        size = max(n + 1, PIECE_BYTES + 1)
        inverse = np.uint64(pow(int(_MULT), -1, 1 << 64))
        up = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size, _MULT)]))
        down = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size, inverse)]))
        have = _tables["powers"] = (up, down)
    return have


def _bytes() -> tuple[np.ndarray, np.ndarray]:
    if "bytes" not in _tables:
        lower = np.arange(256)
        lower[65:91] += 32
        space = np.zeros(256, bool)
        space[[9, 10, 11, 12, 13, 32]] = True
        _tables["bytes"] = (mix64(lower.astype(np.uint64) + np.uint64(1000)), space)
    return _tables["bytes"]


def _word_hashes(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of texts laid end to end (text k is raw[bounds[k]:bounds[k+1]]), and how many words start before each bound."""
    values, space = _bytes()
    n = len(raw)
    if not n:
        return np.empty(0, np.uint64), np.zeros(len(bounds), np.int64)
    blank = space[raw]
    edge = np.zeros(n + 1, bool)
    edge[bounds] = True
    start, end = ~blank, ~blank
    start[1:] &= blank[:-1] | edge[1:n]
    end[:-1] &= blank[1:] | edge[1:n]
    lo, hi = np.flatnonzero(start), np.flatnonzero(end) + 1
    up, down = _powers(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(values[raw] * up[:n], out=sums[1:])
    h = (sums[hi] - sums[lo]) * down[lo] + (hi - lo).astype(np.uint64)
    return mix64(h), np.searchsorted(lo, bounds)


def _set_of(w: np.ndarray, k: int) -> np.ndarray:
    if not len(w):
        return w
    factors = [np.uint64(0xC2B2AE3D27D4EB4F + 2 * j) for j in range(k)]
    if len(w) < k:
        h = np.full(1, len(w), np.uint64)
        for j in range(len(w)):
            h = h + w[j : j + 1] * factors[j]
        return mix64(h)
    n = len(w) - k + 1
    h = np.full(n, k, np.uint64)
    for j in range(k):
        h += mix64(w[j : j + n] + np.uint64(j)) * factors[j]
    return np.unique(mix64(h))


def _long_words(raw: np.ndarray) -> np.ndarray:
    """Word hashes of one long text, piece by piece; pieces end at white space."""
    _, space = _bytes()
    out, at = [], 0
    while at < len(raw):
        end = min(len(raw), at + PIECE_BYTES)
        while end < len(raw) and not space[raw[end]]:
            gap = np.flatnonzero(space[raw[end : end + PIECE_BYTES]])
            end = end + int(gap[0]) if len(gap) else min(len(raw), end + PIECE_BYTES)
        out.append(_word_hashes(raw[at:end], np.array([0, end - at]))[0])
        at = end
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def shingle_sets(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a text with fewer than k words has its whole sequence as one, one without words none."""
    only(_tables)
    for at in range(0, len(texts), SLICE_ROWS):
        yield from _sets_of_slice(texts.slice(at, SLICE_ROWS), k)


def _sets_of_slice(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    with np.errstate(over="ignore"):
        texts = texts.cast(pa.large_binary())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = texts.buffers()[2]
        raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
        at = 0
        while at < len(texts):
            if offsets[at + 1] - offsets[at] > PIECE_BYTES:
                yield _set_of(_long_words(raw[offsets[at] : offsets[at + 1]]), k)
                at += 1
                continue
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + PIECE_BYTES, "right")) - 1)
            bounds = offsets[at : end + 1] - offsets[at]
            words, first = _word_hashes(raw[offsets[at] : offsets[end]], bounds)
            for j in range(end - at):
                yield _set_of(words[first[j] : first[j + 1]], k)
            at = end


def set_digest(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()
