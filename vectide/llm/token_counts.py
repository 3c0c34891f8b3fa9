"""Token counts of whole texts, with overlap resynchronisation for huge ones.

A text of more than ``chunk_chars`` characters is encoded in overlapping chunks. Two neighbouring
chunks are spliced where both start a pre-token at the same character: the scan that forms
pre-tokens keeps no memory of what lies before such a start and looks a bounded number of
characters ahead (``MARGIN`` exceeds it), so from there on the right chunk sees what one pass over
the whole text would see. Where the overlap has no common start, it is doubled, and in the end the
left chunk is grown, so a text without any boundary is encoded whole.

Shorter texts are cut into pre-tokens, which the library merges one by one; each different pre-token
is encoded once by the library and its count remembered, up to ``MEMO`` of them. That is done only where
the cut is known to be the library's: for its byte-level pre-tokenizer, characters below U+0250 (whose
classes no Unicode version changes) and texts without special strings. Other texts are encoded whole.

Null texts count as empty, empty texts have no tokens, repeated rows are counted each, extra
columns are ignored.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectide.llm.common import ident, tidy

#: Characters at a chunk's end whose boundaries aren't trusted; more than any look-ahead and any special string.
MARGIN = 64
CHUNK_CHARS = 65_536
OVERLAP_CHARS = 512
BATCH_CHARS = 400_000
MEMO = 200_000
# The pre-token pattern of the byte-level vocabularies, with white space spelt out.
_BLANK = r"\t-\r \x85\xa0"
PRE_TOKEN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_BLANK}\p{{L}}\p{{N}}]+|[{_BLANK}]+(?![^{_BLANK}])|[{_BLANK}]+"

_loaded: dict = {}
_counters: dict = {}


def load(path: str | None):
    """The tokenizer of this worker; None stands for the public byte-level vocabulary."""
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        if path is None:
            import public_tokenizers

            _loaded[path] = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
        else:
            _loaded[path] = Tokenizer.from_file(path)
    return _loaded[path]


def _starts(tokenizer, text: str, base: int) -> tuple[list[int], list[int]]:
    """Where each token starts in the whole text, and where each pre-token does."""
    e = tokenizer.encode(text, add_special_tokens=False)
    at = [base + s for s, _ in e.offsets]
    words = e.word_ids
    return at, [x for k, x in enumerate(at) if k == 0 or words[k] is None or words[k] != words[k - 1]]


def count_huge(tokenizer, text: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> int:
    """As many tokens as one call over the whole text gives."""
    total, done, lo, hi = 0, 0, 0, min(len(text), chunk)
    left, left_starts = _starts(tokenizer, text[lo:hi], lo)
    while hi < len(text):
        wide, met = overlap, None
        while met is None:
            at = hi - wide
            if at <= max(lo, done):  # no common start in all of the left chunk: grow it
                hi = min(len(text), hi + (hi - lo))
                left, left_starts = _starts(tokenizer, text[lo:hi], lo)
                if hi == len(text):
                    break
                wide = overlap
                continue
            end = min(len(text), at + max(chunk, 2 * wide))
            right, right_starts = _starts(tokenizer, text[at:end], at)
            common = set(left_starts).intersection(x for x in right_starts if x > at and x > done and x <= hi - MARGIN)
            if common:
                met = max(common)
            else:
                wide *= 2
        if met is None:
            break
        total += sum(done <= x < met for x in left)
        done, lo, hi, left, left_starts = met, at, end, right, right_starts
    return total + sum(x >= done for x in left)


class Counter:
    """Token counts of short texts by their pre-tokens."""

    def __init__(self, tokenizer) -> None:  # noqa: ANN001
        import json
        import re

        import regex

        given = json.loads(tokenizer.to_str())
        pre = given.get("pre_tokenizer") or {}
        plain = pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not given.get("normalizer") and given["model"].get("type") == "BPE"
        special = [a["content"] for a in given.get("added_tokens", ())]
        self.usable = bool(plain)
        self.unsafe = re.compile("[^\x00-\u024f]" + "".join("|" + re.escape(x) for x in special))
        self.cut = regex.compile(PRE_TOKEN).findall
        self.encode = getattr(tokenizer, "encode_batch_fast", tokenizer.encode_batch)
        self.memo: dict[str, int] = {}

    def count(self, texts: list[str]) -> list[int]:
        memo = self.memo
        if len(memo) > MEMO:
            memo.clear()
        parts = [self.cut(t) for t in texts]
        new = list({p for some in parts for p in some if p not in memo})
        for k in range(0, len(new), 10_000):
            some = new[k : k + 10_000]
            memo.update(zip(some, (len(e.ids) for e in self.encode(some, add_special_tokens=False)), strict=True))
        return [sum(map(memo.__getitem__, some)) for some in parts]


def count_batch(tokenizer, texts: list[str], chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> list[int]:
    found, some, held = [0] * len(texts), [], 0
    counter = _counters.get(id(tokenizer))
    if counter is None:
        counter = _counters[id(tokenizer)] = (Counter(tokenizer), tokenizer)
    counter = counter[0]
    if counter.usable:
        short = [k for k, t in enumerate(texts) if len(t) <= chunk and not counter.unsafe.search(t)]
        for k, n in zip(short, counter.count([texts[k] for k in short]), strict=True):
            found[k] = n
        done = set(short)
    else:
        done = set()
    encode = getattr(tokenizer, "encode_batch_fast", tokenizer.encode_batch)

    def flush() -> None:
        for k, e in zip(some, encode([texts[k] for k in some], add_special_tokens=False), strict=True):
            found[k] = len(e.ids)
        some.clear()

    for k, text in enumerate(texts):
        if k in done:
            continue
        if len(text) > chunk:
            found[k] = count_huge(tokenizer, text, chunk, overlap)
            continue
        some.append(k)
        held += len(text)
        if held >= BATCH_CHARS:
            flush()
            held = 0
    flush()
    return found


def token_counts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS) -> DataFrame:
    """One row per row of docs: id_col, n_bytes, n_tokens. Runs in one pass, without a shuffle."""
    rows = docs.select(F.col(ident(id_col)).alias("id"), F.coalesce(F.col(ident(text_col)), F.lit("")).alias("text"))
    kind = dict(rows.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from vectide.llm import token_counts as own

        t = own.load(tokenizer)
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                texts = part.column("text")
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(pc.binary_length(texts), pa.int64()), pa.array(own.count_batch(t, texts.to_pylist(), chunk_chars, overlap_chars), pa.int64())], ["id", "n_bytes", "n_tokens"])
        tidy()

    return rows.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long").withColumnRenamed("id", id_col)
