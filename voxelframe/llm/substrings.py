"""Substring dedup by recompression.

Every document is rewritten in rounds that name runs of a symbol and pairs of symbols; which neighbours pair is decided by
bits of their names, so equal stretches of words get equal symbols but near their ends, in whatever document they stand.
Names are hashes of what they stand for: all tasks give the same name without meeting.

Two levels of symbols are used. High ones (about a dozen words) that another document has before show long repeats at once:
all windows that begin in such a symbol, and end in those after it, are repeats. For the windows left, the smallest low
symbol whose naming depends on the window's words alone serves as its anchor; only windows whose anchor occurs again are
compared themselves, by a 128-bit hash of their words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelframe.llm.common import HASHES, id_text, intermediate, mixed, numbered, slices, staged

WIDTH = 20        # words in a window
LOW, HIGH = 2, 9  # rounds until the symbols of anchors, and of long repeats
SLICE = 4 << 20
BASES = tuple(np.uint64(xxhash.xxh3_64_intdigest(b"base", k) | 1) for k in (1, 2))


class Words:
    """The words of a slice of documents in a row, with hashes of any stretch of them."""

    def __init__(self, texts: list[str | None]) -> None:
        self.words = [(t or "").encode().split() for t in texts]
        self.sizes = np.array([len(w) for w in self.words], np.int64)
        self.ends = np.cumsum(self.sizes)
        self.starts = self.ends - self.sizes
        self.hashes = HASHES.of([w for words in self.words for w in words])
        self.doc = np.repeat(np.arange(len(texts)), self.sizes)
        n = len(self.hashes)
        self.sums, self.back = [], []
        for k, base in enumerate(BASES):
            powers = np.full(n + 1, base, np.uint64)
            powers[0] = 1
            inverse = np.full(n + 1, np.uint64(pow(int(base), -1, 1 << 64)), np.uint64)
            inverse[0] = 1
            h = self.hashes if k == 0 else mixed(self.hashes)
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(h * np.multiply.accumulate(powers)[:-1], out=sums[1:])
            self.sums.append(sums)
            self.back.append(np.multiply.accumulate(inverse))

    def stretch(self, a: np.ndarray, b: np.ndarray, k: int = 0) -> np.ndarray:
        """Hash number k of the words from a up to b: a polynomial modulo 2^64 in an odd base, finalized."""
        return mixed((self.sums[k][b] - self.sums[k][a]) * self.back[k][a] + (b - a).astype(np.uint64))


@dataclass
class Symbols:
    """Symbols in a row: name, words from start to end, document; their naming depends on the words from low to high alone."""

    name: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    low: np.ndarray
    high: np.ndarray

    @classmethod
    def of(cls, words: Words) -> Symbols:
        at = np.arange(len(words.hashes))
        return cls(words.hashes.copy(), at, at + 1, words.doc, at, at + 1)

    def neighbours(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """What a symbol's naming depends on once it looks at the one before, and after; beyond the document at its ends."""
        before, after = words.starts[self.doc] - 1, words.ends[self.doc] + 1
        same = self.doc[1:] == self.doc[:-1]
        before[1:][same] = self.low[:-1][same]
        after[:-1][same] = self.high[1:][same]
        return before, after

    def runs(self, words: Words) -> Symbols:
        """Runs of one symbol become one, named by it and their length."""
        new = np.ones(len(self.name), bool)
        new[1:] = (self.name[1:] != self.name[:-1]) | (self.doc[1:] != self.doc[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(new)) - 1
        count = (last - first + 1).astype(np.uint64)
        name = np.where(count > 1, mixed(self.name[first] + count * np.uint64(0x9E3779B97F4A7C15)), self.name[first])
        before, after = self.neighbours(words)
        return Symbols(name, self.start[first], self.end[last], self.doc[first], before[first], after[last])

    def pairs(self, words: Words, salt: int) -> Symbols:
        """A symbol whose bit is 0 joins a following one whose bit is 1."""
        bit = (mixed(self.name ^ np.uint64(salt * 0x51_7C_C1_B7_27_22_0A_95 % (1 << 64))) >> np.uint64(63)).astype(bool)
        pair = np.zeros(len(bit), bool)
        pair[:-1] = ~bit[:-1] & bit[1:] & (self.doc[1:] == self.doc[:-1])
        left = np.flatnonzero(pair)
        keep = np.ones(len(bit), bool)
        keep[left + 1] = False
        before, after = self.neighbours(words)
        low = np.where(bit, before, self.low)          # a lone 1 looks at the one before
        high = np.where(~bit & ~pair, after, self.high)  # a lone 0 at the one after
        name, end = self.name.copy(), self.end.copy()
        name[left] = mixed(self.name[left] * np.uint64(0xD6E8FEB86659FD93) + self.name[left + 1])
        end[left], high[left], low[left] = self.end[left + 1], self.high[left + 1], self.low[left]
        return Symbols(name[keep], self.start[keep], end[keep], self.doc[keep], low[keep], high[keep])

    def round(self, words: Words, number: int) -> Symbols:
        return self.runs(words).pairs(words, number)


def anchors(symbols: Symbols, words: Words) -> tuple[np.ndarray, ...]:
    """(key, doc, first window, windows, anchors): runs of windows of a document whose anchors are alike, and how many those are.

    A window sees the symbols whose naming depends on its words alone, and takes the one of smallest key, the first of equal
    ones; equal windows take equal anchors at equal places. One that sees none is its own anchor.
    """
    at = np.flatnonzero(np.arange(len(words.hashes)) + WIDTH <= words.ends[words.doc])
    if not len(at):
        return (np.empty(0, np.uint64), *(np.empty(0, np.int64),) * 4)
    keys = words.stretch(np.maximum(symbols.low, 0), np.minimum(symbols.high, len(words.hashes)))
    first = np.searchsorted(symbols.low, at, "left")        # low and high never fall from a symbol to the next
    stop = np.searchsorted(symbols.high, at + WIDTH, "right")
    best, count = first.copy(), stop - first
    for k in range(1, max(1, count.max())):
        open_ = np.flatnonzero(count > k)
        other = first[open_] + k
        better = keys[other] < keys[best[open_]]
        best[open_[better]] = other[better]
    own = count <= 0
    key = keys[np.minimum(best, len(keys) - 1)]
    key[own] = words.stretch(at[own], at[own] + WIDTH)
    best[own] = -1 - at[own]
    near = at[1:] == at[:-1] + 1
    new, other = np.ones(len(at), bool), np.ones(len(at), bool)
    new[1:] = (key[1:] != key[:-1]) | ~near  # in periodic text neighbouring windows have different anchors that are alike
    other[1:] = (best[1:] != best[:-1]) | ~near
    lead = np.flatnonzero(new)
    times = np.diff(np.append(np.cumsum(other)[lead], other.sum() + 1))
    return key[lead], words.doc[at[lead]], at[lead], np.diff(np.append(lead, len(at))), times


def spans(symbols: Symbols, words: Words) -> tuple[np.ndarray, ...]:
    """(key, second key, doc, first window, windows): per high symbol, the windows that begin in it.

    The keys are those of the words up to the end of the first symbol that contains the end of all these windows.
    """
    last = np.searchsorted(symbols.doc, np.arange(len(words.sizes)), "right") - 1
    until = np.minimum(np.searchsorted(symbols.end, symbols.end + WIDTH - 1), last[symbols.doc])
    end = symbols.end[until]
    count = np.minimum(symbols.end, end - WIDTH + 1) - symbols.start
    some = count > 0
    a, b = symbols.start[some], end[some]
    return words.stretch(a, b), words.stretch(a, b, 1) | np.uint64(1), symbols.doc[some], a, count[some]


ROWS = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("row", pa.int64()), ("doc_id", pa.int64()), ("at", pa.int32()), ("n", pa.int32()),
                  ("times", pa.int32())])
LAST = (1 << 63) - 1  # place of a null id in the order of documents


def named(docs: DataFrame) -> DataFrame:
    """(k1, k2, row, doc_id, at, n, times): the anchors (k2 = 0) and high symbols of all documents, with their n windows from at on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, SLICE):
            row, doc_id = (batch.column(k).to_numpy() for k in range(2))
            words = Words(batch.column(2).to_pylist())
            if not len(words.hashes):
                continue
            symbols = Symbols.of(words)
            for k in range(LOW):
                symbols = symbols.round(words, k)
            key, doc, at, n, times = anchors(symbols, words)
            for k in range(LOW, HIGH):
                symbols = symbols.round(words, k)
            k1, k2, doc2, at2, n2 = spans(symbols, words)
            doc, at = np.concatenate([doc, doc2]), np.concatenate([at, at2])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([key, k1]).view(np.int64)), pa.array(np.concatenate([np.zeros(len(key), np.int64), k2.view(np.int64)])),
                 pa.array(row[doc]), pa.array(doc_id[doc]), pa.array((at - words.starts[doc]).astype(np.int32)),
                 pa.array(np.concatenate([n, n2]).astype(np.int32)),
                 pa.array(np.concatenate([times, np.ones(len(n2), np.int64)]).astype(np.int32))], schema=ROWS)

    return docs.mapInArrow(run, "k1 long, k2 long, row long, doc_id long, at int, n int, times int")


def repeats(rows: DataFrame) -> DataFrame:
    """(row, known, maybe): windows that an earlier document has, and those whose anchor occurs again, as [at, n] ranges.

    What occurs again is staged first: a join of two tables can split the rows of a very common symbol over many tasks.
    """
    again = staged(rows.groupBy("k1", "k2").agg(F.min("doc_id").alias("first"), F.sum("times").alias("c")).where("c > 1").drop("c"), "again")
    hits = rows.drop("times").join(again, ["k1", "k2"]).where("k2 = 0 OR doc_id > first")
    pair = F.struct("at", "n")
    return hits.groupBy("row").agg(F.collect_list(F.when(F.col("k2") != 0, pair)).alias("known"),
                                   F.collect_list(F.when(F.col("k2") == 0, pair)).alias("maybe"))


def marked(words: Words, ranges: list[pa.Array]) -> np.ndarray:
    """True at the words where a window of the given [at, n] ranges (a list for each document) begins."""
    change = np.zeros(len(words.hashes) + 1, np.int64)
    doc = np.repeat(np.arange(len(words.sizes)), np.diff(ranges.offsets.to_numpy()))
    at = ranges.flatten().field("at").to_numpy() + words.starts[doc]
    np.add.at(change, at, 1)
    np.add.at(change, at + ranges.flatten().field("n").to_numpy(), -1)
    return np.cumsum(change[:-1]) > 0


CHECKS = "row long, doc_id long, known array<int>, at array<int>, w1 array<long>, w2 array<long>"


def checks(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Per document with repeats: windows known to be repeats, and (at, w1, w2) of those to compare.

    Of equal windows in one document the first is compared, the others are repeats of it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, SLICE):
            words = Words(batch.column(2).to_pylist())
            known, maybe = marked(words, batch.column(3)), marked(words, batch.column(4))
            at = np.flatnonzero(maybe & ~known)
            w1, w2 = (words.stretch(at, at + WIDTH, k).view(np.int64) for k in range(2))
            order = np.lexsort((at, w2, w1, words.doc[at]))
            later = np.zeros(len(at), bool)
            a, b = order[:-1], order[1:]
            later[b] = (words.doc[at[a]] == words.doc[at[b]]) & (w1[a] == w1[b]) & (w2[a] == w2[b])
            known[at[later]] = True
            at, w1, w2 = at[~later], w1[~later], w2[~later]
            sure = np.flatnonzero(known)
            cut = lambda where, values: pa.ListArray.from_arrays(np.append(
                np.searchsorted(where, words.starts), len(where)).astype(np.int32), pa.array(values))
            local = lambda where: (where - words.starts[words.doc[where]]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), cut(sure, local(sure)), cut(at, local(at)), cut(at, w1), cut(at, w2)],
                                             names=["row", "doc_id", "known", "at", "w1", "w2"])

    return docs.join(found, "row").select("row", "doc_id", "text", "known", "maybe").mapInArrow(run, CHECKS)


def repeated(docs: DataFrame) -> DataFrame:
    """(row, gone) for (row, doc_id, text): where the windows that also start earlier begin, in documents that have some."""
    placed = docs.withColumn("doc_id", F.coalesce("doc_id", F.lit(LAST)))
    spark = docs.sparkSession
    with intermediate(spark) as keep:
        with intermediate(spark) as keep_found:  # the names, most rows of all, go as soon as what repeats is known
            found = keep_found(repeats(staged(named(placed), "named")), "repeats")
        return keep(_gone(checks(placed, found)), "gone")


def _gone(checked: DataFrame) -> DataFrame:
    checked = staged(checked, "windows")
    one = checked.select("row", "doc_id", F.explode(F.arrays_zip("at", "w1", "w2")).alias("w")).select("row", "doc_id", "w.*")
    first = staged(one.groupBy("w1", "w2").agg(F.min("doc_id").alias("first"), F.count("*").alias("c")).where("c > 1").drop("c"), "first")
    later = one.join(first, ["w1", "w2"]).where("doc_id > first").groupBy("row").agg(F.collect_list("at").alias("later"))
    known = checked.where(F.size("known") > 0).select("row", "known")
    none = F.array().cast("array<int>")
    return known.join(later, "row", "full").select("row", F.concat(F.coalesce("known", none), F.coalesce("later", none)).alias("gone"))


def without(words: list[bytes], starts: np.ndarray) -> list[bytes]:
    """The words that no window beginning at one of the starts covers."""
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + WIDTH, -1)
    return [words[k] for k in np.flatnonzero(np.cumsum(change[:-1]) == 0)]


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, doc_id, n_words, n_removed, kept), a row for each input row; kept are the words left, joined by one space.

    A word goes if a window of 20 words that covers it also starts earlier: in a document of smaller id, or before in its
    own. Null and empty texts have no words. A null id comes after all others; rows that share an id (repeated ones, or
    null) leave each other's words alone. Other columns are ignored. Rows are numbered once and staged with their texts.
    """
    docs = numbered(id_text(docs, id_col, text_col))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, SLICE):
            n_words, n_removed, kept = [], [], []
            for text, starts in zip(batch.column(2).to_pylist(), batch.column(3), strict=True):
                words = (text or "").encode().split()
                left = without(words, starts.values.to_numpy()) if starts.is_valid else words
                n_words.append(len(words))
                n_removed.append(len(words) - len(left))
                kept.append(b" ".join(left).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
                                              pa.array(kept, pa.string())], names=["row", "doc_id", "n_words", "n_removed", "kept"])

    return docs.join(repeated(docs), "row", "left").select("row", "doc_id", "text", "gone") \
        .mapInArrow(cut, "row long, doc_id long, n_words long, n_removed long, kept string")


def shortened(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs with the repeated words taken out of their texts; texts without any stay as they are, to the letter.

    See dedup(). All other columns are kept as they are.
    """
    schema, rows = docs.schema, numbered(docs, "__row")
    gone = repeated(rows.select(F.col("__row").alias("row"), F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")))
    at = docs.columns.index(text_col)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, SLICE):
            columns = batch.columns[:-1]
            columns[at] = pa.array([t if not s.is_valid else b" ".join(without(t.encode().split(), s.values.to_numpy())).decode()
                                    for t, s in zip(columns[at].to_pylist(), batch.column(len(columns)), strict=True)], columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])

    both = rows.join(gone.withColumnRenamed("row", "__row"), "__row", "left")
    return both.select(*[rows[f"`{c}`"] for c in docs.columns], F.col("gone").alias("__gone")).mapInArrow(cut, schema)
