"""Best-fit packing of tokenized documents into sequences.

Pieces above a third of the capacity are matched, at most two to a sequence: the longest with the longest that fits it.
Smaller ones, longest first, go into the smallest gap that takes them. Pieces of one length are interchangeable, so the
packing is decided on the counts per length (at most `capacity` numbers) and dealt out to the pieces by their rank.
"""

from __future__ import annotations

import os
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator
from math import isqrt
from typing import NamedTuple
from unicodedata import normalize

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxelframe.llm.common import LOWER, id_text, slices, staged

VOCABULARY = "word_bpe_49k.json"
CAPACITY = 2048
END_ID = 0
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class Words(dict):
    """Maps a stretch of text without blanks or line ends, A-Z in lower case, to its ids (32-bit, little-endian).

    The tokenizer ignores case, splits at white space and normalises within words, so the ids of a text are those of its
    stretches in a row. Short ones are remembered: those met lately, and those met in the generation before.
    """

    GENERATION, SHORT = 250_000, 48

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tool = Tokenizer.from_file(path)
        self.tool.encode_special_tokens = True
        self.before: dict[str, bytes] = {"": b""}

    def __missing__(self, word: str) -> bytes:
        ids = self.before.get(word)
        if ids is None:
            bare = word.rstrip(".,;:!?")
            if bare != word and normalize("NFC", bare[-1:]).lower()[-1:].isalpha():  # the tokenizer splits marks from letters before
                ids = self[bare] + self[word[len(bare):]]
            else:
                ids = array("I", self.tool.encode(word, add_special_tokens=False).ids).tobytes()
        if len(word) <= self.SHORT:
            if len(self) >= self.GENERATION:
                self.before = dict(self)
                self.clear()
            self[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        low = text.encode().translate(LOWER).decode()
        return b"".join(map(self.__getitem__, low.replace("\n", " ").split(" ")))


WORDS: dict[str, Words] = {}  # per worker


def words_of(path: str) -> Words:
    """The worker's own memory, whatever task asks: a name that a closure uses itself would be copied into each task."""
    if path not in WORDS:
        WORDS[path] = Words(path)
    return WORDS[path]


def pieces(docs: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text",
           path: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): the ids of each whole text and a final 0, cut only beyond the capacity.

    Null and empty texts are the final 0 alone. Rows that repeat a document give its pieces again.
    """
    path = path or public_tokenizers.path(VOCABULARY)
    end = array("I", [END_ID]).tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = words_of(path)
        for batch in slices(batches):
            rows = []
            for doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids = words.encode(text or "") + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at:at + 4 * capacity]
                    rows.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)))
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)],
                                             names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return id_text(docs, id_col, text_col).mapInArrow(cut, PIECES)


class Slot(NamedTuple):
    """Pieces `low` to `high` (exclusive) of a length go `per_bin` at a time to sequences from `first` on, from `base` there."""

    length: int
    low: int
    high: int
    first: int
    per_bin: int
    base: int


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[Slot]:
    """Where the pieces of each length go. A few slots for each length, whatever the counts."""
    left, slots, made = dict(counts), [], 0
    gaps: dict[int, list[tuple[int, int]]] = {}  # free space -> (first sequence, how many)
    sizes: list[int] = []                        # the keys of gaps, ascending

    def put(length: int, first: int, bins: int, per_bin: int, space: int) -> None:
        low = counts[length] - left[length]
        left[length] -= bins * per_bin
        slots.append(Slot(length, low, low + bins * per_bin, first, per_bin, capacity - space))

    def leave(space: int, first: int, bins: int) -> None:
        if space and bins:
            if space not in gaps:
                gaps[space] = []
                insort(sizes, space)
            gaps[space].append((first, bins))

    large = sorted(n for n in counts if 3 * n > capacity)
    for a in reversed(large):
        for b in reversed(large[:bisect_left(large, capacity - a + 1)]):
            bins = min(left[a], left[b]) if b != a else left[a] // 2
            if b <= a and bins:
                if b == a:
                    put(a, made, bins, 2, capacity)
                else:
                    put(a, made, bins, 1, capacity)
                    put(b, made, bins, 1, capacity - a)
                leave(capacity - a - b, made, bins)
                made += bins
            if not left[a]:
                break
        if bins := left[a]:
            put(a, made, bins, 1, capacity)
            leave(capacity - a, made, bins)
            made += bins
    for s in sorted((n for n in counts if 3 * n <= capacity), reverse=True):
        while left[s]:
            at = bisect_left(sizes, s)
            if at == len(sizes):
                bins = -(-left[s] // (capacity // s))
                leave(capacity, made, bins)
                made += bins
                continue
            space = sizes[at]
            first, bins = gaps[space].pop()
            if not gaps[space]:
                del gaps[space], sizes[at]
            each = min(space // s, left[s])  # a sequence stays the best fit for this length until it takes no more
            used = min(bins, left[s] // each)
            put(s, first, used, each, space)
            leave(space - each * s, first, used)
            leave(space, first + used, bins - used)
    return slots


def pack(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to rows with doc_id, piece and length (1 to capacity).

    Ranks within a length are counted in buckets of about the square root of all rows, so no task gets a whole length.
    """
    spark = found.sparkSession
    counts = {r["length"]: r["n"] for r in found.groupBy("length").agg(F.count("*").alias("n")).collect()}  # <= capacity rows
    group = max(200, isqrt(sum(counts.values())))
    split = spark.createDataFrame([(n, -(-c // group)) for n, c in counts.items()], "length long, buckets long")
    dealt = found.join(F.broadcast(split), "length") \
        .withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.col("buckets"))).drop("buckets")
    sums = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = sums.withColumn("before", F.coalesce(F.sum("n").over(
        Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    inside = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece")) - 1
    ranked = dealt.withColumn("inside", inside).join(before, ["length", "bucket"]) \
        .withColumn("rank", F.col("before") + F.col("inside")).drop("before", "inside", "bucket")
    slots = spark.createDataFrame(plan(counts, capacity), "of long, low long, high long, first long, per_bin long, base long")
    return ranked.join(F.broadcast(slots), (F.col("length") == F.col("of")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))) \
        .withColumn("sequence_id", F.expr("first + (rank - low) div per_bin")) \
        .withColumn("offset", F.expr("base + (rank - low) % per_bin * length")) \
        .drop("of", "low", "high", "first", "per_bin", "base", "rank")


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text",
                   path: str | None = None) -> DataFrame:
    """One row for each piece, with its place. The pieces (not the texts) are staged, so each text is tokenized once."""
    found = staged(pieces(docs, capacity, id_col, text_col, path), "pieces")
    return pack(found, capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
