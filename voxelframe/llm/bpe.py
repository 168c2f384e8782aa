"""Byte-level BPE encoding and decoding.

A segment tree over the byte positions of a piece keeps the leftmost minimum of the ranks of live neighbouring pairs; a
merge updates the leaves of at most three positions, each in logarithmic time.
"""

from __future__ import annotations

import base64
import hashlib
from array import array

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from voxelframe.llm.common import arrow_map, id_text

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
NONE = 1 << 40  # rank of a pair that is no token


def load(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(t): int(r) for t, r in map(bytes.split, f)}


def splitter(pattern: str) -> regex.Pattern:
    """The split pattern with white space as Unicode defines it (Python's \\s also has U+001C to U+001F)."""
    return regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\S", r"\P{White_Space}")
                         .replace(r"\s", r"\p{White_Space}"))


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece: the leftmost pair of lowest rank merges until no neighbouring pair is a token."""
    if piece in ranks:
        return [ranks[piece]]
    n, rank = len(piece), ranks.get
    size = 1 << (n - 1).bit_length()
    # leaf i is the rank of the live symbols that start at byte i and at the next live byte
    tree = [NONE] * size + [rank(piece[i:i + 2], NONE) for i in range(n - 1)] + [NONE] * (size - n + 1)
    for k in range(size - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a <= b else b
    after, before = list(range(1, n + 1)), list(range(-1, n))
    while (low := tree[1]) < NONE:
        k = 1
        while k < size:
            k *= 2
            if tree[k] != low:
                k += 1
        i = k - size
        gone, left = after[i], before[i]
        end = after[i] = after[gone]
        before[end] = i
        changed = [(gone, NONE), (i, rank(piece[i:after[end]], NONE) if end < n else NONE)]
        if left >= 0:
            changed.append((left, rank(piece[left:end], NONE)))
        for leaf, value in changed:
            k = size + leaf
            tree[k] = value
            while k > 1:
                other = tree[k ^ 1]
                if other < value:
                    value = other
                k >>= 1
                if tree[k] == value:
                    break
                tree[k] = value
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i:after[i]]])
        i = after[i]
    return out


class Codec(dict):
    """Maps a piece to its ids as little-endian 32-bit integers; short pieces are remembered, up to a bound."""

    REMEMBERED, SHORT = 1_000_000, 48

    def __init__(self, path: str, pattern: str) -> None:
        super().__init__()
        self.ranks = load(path)
        self.tokens = {i: t for t, i in self.ranks.items()}
        self.pieces = splitter(pattern)

    def __missing__(self, piece: str) -> bytes:
        ids = array("I", merge(piece.encode(), self.ranks)).tobytes()
        if len(piece) <= self.SHORT:
            if len(self) >= self.REMEMBERED:
                self.clear()
            self[piece] = ids
        return ids

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, self.pieces.findall(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, array("I", ids)))


CODECS: dict[tuple[str, str], Codec] = {}  # per worker


def codec(path: str, pattern: str) -> Codec:
    if (path, pattern) not in CODECS:
        CODECS[path, pattern] = Codec(path, pattern)
    return CODECS[path, pattern]


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None,
           pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """(doc_id, ids binary, decoded binary): ids of the whole text and the bytes they decode to, a row for each input row.

    Null texts count as empty (no ids). The vocabulary file is opened on the executors, so `path` is a place that every
    machine has. Repeated rows and null ids give a row each; other columns are ignored.
    """
    path = path or public_tokenizers.path(VOCABULARY)

    def of(batch: pa.RecordBatch) -> dict:
        c = codec(path, pattern)
        ids = [c.encode(t or "") for t in batch.column(1).to_pylist()]
        return {"doc_id": batch.column(0), "ids": ids, "decoded": list(map(c.decode, ids))}

    return arrow_map(id_text(docs, id_col, text_col), of, "doc_id long, ids binary, decoded binary")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None,
            pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """As encode(), with the number of ids and SHA-256 digests instead of the bytes, which then stay in the task."""
    path = path or public_tokenizers.path(VOCABULARY)

    def of(batch: pa.RecordBatch) -> dict:
        c = codec(path, pattern)
        ids = [c.encode(t or "") for t in batch.column(1).to_pylist()]
        return {"doc_id": batch.column(0), "n_tokens": [len(x) // 4 for x in ids],
                "ids_sha256": [hashlib.sha256(x).hexdigest() for x in ids],
                "decoded_sha256": [hashlib.sha256(c.decode(x)).hexdigest() for x in ids]}

    return arrow_map(id_text(docs, id_col, text_col), of, SCHEMA)
