"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives a one-pass Viterbi.

The automaton reads a text once; at each position its output links give every piece that ends
there, and each relaxes the best score of a segmentation up to that position (ties: the longer
piece). A character that isn't a piece itself costs the unknown penalty and is written as its bytes.
Pieces hold the space sign only at their front, so no piece spans the border between another
character and a space sign: the best segmentation of a text is that of its units (space signs and
what follows them) one after the other. Units are encoded once and remembered, up to ``MEMO`` of
them; a unit may be the whole text.

Scores are the model file's; for a merge-rank model they are ranks, so the result is the path of the
best score sum, not that of the merge procedure. Decoding gives the text back exactly, unless it
holds the space sign itself, which decodes as a blank. Null texts count as empty and have no ids.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectide.llm.common import ident, kept_between_tasks, only, tidy

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
MEMO = 120_000
LONG_UNIT = 64

_UNIT = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
_loaded = kept_between_tasks()


class Codec:
    def __init__(self, pieces: list[tuple[str, float]], bytes_from: dict[int, int], unknown: int, skip: set[int], dummy_prefix: bool = True):
        """pieces: (piece, score) by id; bytes_from: byte value to id (empty: no byte fallback); skip: ids that no text yields."""
        import ahocorasick

        self.automaton, self.single, self.dummy = ahocorasick.Automaton(), set(), dummy_prefix
        self.bytes_from, self.unknown = bytes_from, unknown
        usable = [(k, p, s) for k, (p, s) in enumerate(pieces) if p and k not in skip and k != unknown and k not in set(bytes_from.values())]
        for k, p, s in usable:
            if SPACE in p.lstrip(SPACE):
                raise ValueError(f"a piece has the space sign inside: {p!r}")
            self.automaton.add_word(p, (len(p), s, k))
            if len(p) == 1:
                self.single.add(p)
        self.automaton.make_automaton()
        self.bad = min((s for _, _, s in usable), default=0.0) - UNKNOWN_PENALTY
        back = {k: bytes([b]) for b, k in bytes_from.items()}
        self.raw = [back.get(k, b" \xe2\x81\x87 " if k == unknown else b"" if k in skip else p.replace(SPACE, " ").encode()) for k, (p, _) in enumerate(pieces)]
        self.memo: dict[str, list[int]] = {}

    def _unit(self, unit: str) -> list[int]:
        n = len(unit)
        if self.single.issuperset(unit):  # every position ends a piece; of one end the longest piece comes first
            best, by = [0.0] + [-1e300] * n, [None] * (n + 1)
            for end, piece in self.automaton.iter(unit):
                s = best[end + 1 - piece[0]] + piece[1]
                if s > best[end + 1]:
                    best[end + 1], by[end + 1] = s, piece
            out = []
            while n:
                size, _, k = by[n]
                out.append(k)
                n -= size
            out.reverse()
            return out
        best, from_, by = [0.0] + [None] * n, [0] * (n + 1), [-1] * (n + 1)
        closed = 0
        single, bad = self.single, self.bad
        for end, (size, score, k) in self.automaton.iter(unit):
            end += 1
            while closed < end - 1:  # positions that no piece ends at
                if unit[closed] not in single and (best[closed + 1] is None or best[closed] + bad > best[closed + 1]):
                    best[closed + 1], from_[closed + 1], by[closed + 1] = best[closed] + bad, closed, -1
                closed += 1
            if closed == end - 1 and unit[closed] not in single and by[end] == -1 and best[end] is None:
                best[end], from_[end] = best[closed] + bad, closed
            start = end - size
            s = best[start] + score
            b = best[end]
            if b is None or s > b or s == b and start < from_[end]:
                best[end], from_[end], by[end] = s, start, k
        while closed < n:
            if unit[closed] not in single and (best[closed + 1] is None or best[closed] + bad > best[closed + 1]):
                best[closed + 1], from_[closed + 1], by[closed + 1] = best[closed] + bad, closed, -1
            closed += 1
        out, at = [], n
        while at:
            k = by[at]
            if k >= 0:
                out.append(k)
            elif self.bytes_from:
                out.extend(self.bytes_from[b] for b in reversed(unit[from_[at] : at].encode()))
            else:
                out.append(self.unknown)
            at = from_[at]
        out.reverse()
        return out

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        memo, out = self.memo, []
        for unit in _UNIT.findall((SPACE if self.dummy else "") + text.replace(" ", SPACE)):
            ids = memo.get(unit)
            if ids is None:
                ids = self._unit(unit)
                if len(unit) <= LONG_UNIT:
                    if len(memo) >= MEMO:
                        memo.clear()
                    memo[unit] = ids
            out += ids
        return out

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.dummy and text.startswith(" ") else text


def load(path: str | None) -> Codec:
    """The codec of this worker; None stands for the public 32k vocabulary."""
    only(_loaded)
    if path not in _loaded:
        import sentencepiece

        if path is None:
            import public_tokenizers

            at = public_tokenizers.path("piece_bpe_32k.model")
        else:
            at = path
        sp = sentencepiece.SentencePieceProcessor(model_file=at)
        size = sp.get_piece_size()
        as_byte = {int(sp.id_to_piece(k)[3:5], 16): k for k in range(size) if sp.is_byte(k)}
        skip = {k for k in range(size) if sp.is_control(k) or sp.is_unused(k)}
        dummy = sp.encode("a", out_type=str)[:1] == [SPACE + "a"] or sp.encode("a", out_type=str)[:1] == [SPACE]
        _loaded[path] = Codec([(sp.id_to_piece(k), sp.get_score(k)) for k in range(size)], as_byte, sp.unk_id(), skip, dummy)
    return _loaded[path]


def encoded(docs: DataFrame, *, text_col: str = "text", ids_col: str = "piece_ids", model: str | None = None, keep_text: bool = True) -> DataFrame:
    """docs with ids_col, the ids of each text, and without the text unless keep_text. One pass, no shuffle."""
    bare = docs if keep_text else docs.drop(text_col)
    schema = bare.withColumn(ids_col, F.array().cast("array<int>")).schema
    columns = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from vectide.llm import pieces as own

        codec = own.load(model)
        for b in batches:
            for k in range(0, b.num_rows, 128):
                part = b.slice(k, 128)
                offsets, values = np.zeros(part.num_rows + 1, np.int32), []
                for row, text in enumerate(part.column(text_col).to_pylist()):
                    values.append(np.array(codec.encode(text or ""), np.int32))
                    offsets[row + 1] = offsets[row] + len(values[-1])
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(values)))
                yield pa.RecordBatch.from_arrays([ids if c == ids_col else part.column(c) for c in columns], columns)
        tidy()

    return docs.mapInArrow(run, schema)


def round_trips(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", model: str | None = None) -> DataFrame:
    """One row per row of docs: id, n_pieces, ids_sha256 (of the ids as little-endian 32-bit numbers), round_trip (decoding gives the text)."""
    rows = docs.select(F.col(ident(id_col)).alias("id"), F.coalesce(F.col(ident(text_col)), F.lit("")).alias("text"))
    kind = dict(rows.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from vectide.llm import pieces as own

        codec = own.load(model)
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                n, sha, back = [], [], []
                for text in part.column("text").to_pylist():
                    ids = codec.encode(text)
                    n.append(len(ids))
                    sha.append(hashlib.sha256(np.array(ids, "<i4").tobytes()).hexdigest())
                    back.append(codec.decode(ids) == text)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(back, pa.bool_())], ["id", "n_pieces", "ids_sha256", "round_trip"])
        tidy()

    return rows.mapInArrow(run, f"id {kind}, n_pieces long, ids_sha256 string, round_trip boolean").withColumnRenamed("id", id_col)
