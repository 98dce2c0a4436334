"""Byte-level BPE encoding and decoding as a tree reduction.

A text is encoded in halves, down to leaves of bounded length, and neighbours are joined. Two joins
are needed, as a text is first cut into pieces by a pattern and each piece is then merged:

* between pieces: a space after a character that isn't white space always begins a new piece, and
  what follows depends on nothing before it. The window around a seam grows to the next such place on
  either side; tokens outside it can't change.
* inside a piece that is itself longer than a leaf: a token sequence is the encoding of its bytes
  exactly if each two neighbours are the encoding of their joint bytes. The window of re-encoded
  tokens grows until both of its edges fulfil that.
"""

from __future__ import annotations

import base64
import hashlib
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewake.llm.shared import column

#: Small enough that most documents pass through joins.
LEAF_CHARS = 512
LEAF_BYTES = 128
_SEAM = re.compile(r"(?<=\S)(?= )")


class Codec:
    """Ranks and pattern of one vocabulary; ``encode`` and ``decode`` work on the tree."""

    def __init__(self, path: str, pattern: str, leaf_chars: int = LEAF_CHARS, leaf_bytes: int = LEAF_BYTES):
        import regex
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pieces = regex.compile(pattern)
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.text_of = [str(i) for i in range(len(self.bytes_of))]
        self.leaf_chars, self.leaf_bytes = max(2, leaf_chars), max(2, leaf_bytes)
        self.adjoin = lru_cache(65_536)(lambda a, b: self.own._encode_single_piece(self.bytes_of[a] + self.bytes_of[b]) == [a, b])

    def encode(self, text: str) -> list[int]:
        if len(text) <= self.leaf_chars:
            return self._leaf(text)
        mid = len(text) // 2
        return self._join(text, mid, self.encode(text[:mid]), self.encode(text[mid:]))

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= self.leaf_chars:
            return b"".join([self.bytes_of[i] for i in ids])
        mid = len(ids) // 2
        return self.decode(ids[:mid]) + self.decode(ids[mid:])

    def _leaf(self, text: str) -> list[int]:
        if len(text) <= self.leaf_bytes or _SEAM.search(text, 0, self.leaf_bytes):
            longest = max(map(len, text.split(" ")), default=0)
            if longest <= self.leaf_bytes:
                return self.own.encode_ordinary(text)
        return self._span(text)

    def _span(self, text: str) -> list[int]:
        """Piece by piece, so that a piece longer than a leaf goes through the tree of bytes."""
        out: list[int] = []
        for m in self.pieces.finditer(text):
            out += self._piece(m[0].encode("utf-8", "surrogatepass"))
        return out

    def _join(self, text: str, mid: int, left: list[int], right: list[int]) -> list[int]:
        reach, a, b = 64, None, None
        while True:
            if a is None:
                lo = max(0, mid - reach)
                a = next((p for p in range(mid - 1, max(lo, 1) - 1, -1) if text[p] == " " and not text[p - 1].isspace()), 0 if lo == 0 else None)
            if b is None:
                hi = min(len(text), mid + reach)
                b = next((p for p in range(mid + 1, hi) if text[p] == " " and not text[p - 1].isspace()), len(text) if hi == len(text) else None)
            if a is not None and b is not None:
                break
            reach *= 2
        keep_l = self._keep(left, len(text[a:mid].encode()), -1)
        keep_r = self._keep(right, len(text[mid:b].encode()), 1)
        return left[:keep_l] + self._leaf(text[a:b]) + right[keep_r:]

    def _keep(self, ids: list[int], n_bytes: int, step: int) -> int:
        """How far into ``ids`` (from its end, if step is -1) lie ``n_bytes``."""
        at = 0 if step > 0 else len(ids)
        while n_bytes > 0:
            n_bytes -= len(self.bytes_of[ids[at if step > 0 else at - 1]])
            at += step
        assert n_bytes == 0, "a seam that isn't a token's edge"
        return at

    def _piece(self, piece: bytes) -> list[int]:
        if len(piece) <= self.leaf_bytes:
            return self.own._encode_single_piece(piece)
        mid = len(piece) // 2
        left, right = self._piece(piece[:mid]), self._piece(piece[mid:])
        k = 1
        while True:
            i, j = max(0, len(left) - k), min(len(right), k)
            window = b"".join(map(self.bytes_of.__getitem__, left[i:] + right[:j]))
            new = self.own._encode_single_piece(window)
            if (i == 0 or self.adjoin(left[i - 1], new[0])) and (j == len(right) or self.adjoin(new[-1], right[j])):
                return left[:i] + new + right[j:]
            k *= 2


@lru_cache(4)
def codec(path: str, pattern: str, leaf_chars: int = LEAF_CHARS, leaf_bytes: int = LEAF_BYTES) -> Codec:
    """One per Python worker."""
    return Codec(path, pattern, leaf_chars, leaf_bytes)


def encode_digest(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token ids of every text, decoded again, as digests: id, n_tokens, ids_sha256, decoded_sha256.

    A null text counts as empty (no tokens); repeated rows and null ids stay as they are; other
    columns of ``docs`` are not looked at. Narrow: no shuffle, one text in memory at a time.
    """

    def run(batches):
        c = codec(vocabulary, pattern)
        for batch in batches:
            n, ids_sha, back_sha = [], [], []
            for text in batch.column(1):
                ids = c.encode(text.as_py() or "")
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(" ".join([c.text_of[i] for i in ids]).encode()).hexdigest())
                back_sha.append(hashlib.sha256(c.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(back_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    picked = docs.select(column(id_col).cast("long").alias("doc_id"), column(text_col).alias("text"))
    return picked.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_ids(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The ids themselves: id, ids array<int>. A null text has an empty array."""

    def run(batches):
        c = codec(vocabulary, pattern)
        for batch in batches:
            ids = [c.encode(t.as_py() or "") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select(column(id_col).cast("long").alias("doc_id"), column(text_col).alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode_ids(encoded: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """Bytes of each row of ``encode_ids``: id, payload binary. Null ids give null."""

    def run(batches):
        c = codec(vocabulary, pattern)
        for batch in batches:
            out = [None if x.as_py() is None else c.decode(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["doc_id", "payload"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, payload binary")
