"""Language-model scoring by prediction by partial matching.

A trie over byte contexts (orders 0 to 4) is counted on all training documents. The code length of a byte starts at its
longest known context and escapes to shorter ones (method C: as many escapes as distinct symbols), leaving out the symbols
that the longer context had. Beside it, a unigram base score over words.

Nothing counted is dropped. Grams (a byte with the four before it) of a share of 2^-20 of the training bytes, 2^20 at most,
are looked up in the task; all others are staged as counts per document and join their values. So are words.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from voxelframe.llm.common import slices, staged

ORDER = 4
END = 0xFF                     # ends a text and stands before its first byte; no byte of UTF-8
SHORT = 2                      # orders up to this one are held whole: three bytes of UTF-8 at most
CHUNK = 1 << 18                # grams valued at a time, more than the 2^16 with the same bytes 1 to 3
GRAM_SHARE = 2.0 ** -20
HEAD_SHARE = 2.0 ** -20
HEAD_WORD_BYTES = 64
SLICE = 2 << 20
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
END_TOKEN = b"\n"              # cannot be a word
PARTS = "row long, doc_id long, n_tokens long, n_known long, base double, score double, word binary, gram long, tf long"


def grams(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(grams, text indices) in runs of about SLICE bytes: each byte and the end with the ORDER bytes before it, packed."""
    pad = bytes([END]) * ORDER
    data = np.frombuffer(b"".join(pad + t + bytes([END]) for t in texts), np.uint8)
    sizes = np.array([len(t) + ORDER + 1 for t in texts], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    for at in range(ORDER, len(data), SLICE):
        stop = min(len(data), at + SLICE)
        packed = np.zeros(stop - at, np.uint64)
        for k in range(ORDER + 1):
            packed = (packed << np.uint64(8)) | data[at - ORDER + k:stop - ORDER + k]
        where = np.arange(at, stop)
        owner = np.searchsorted(starts, where, "right") - 1
        real = where - starts[owner] >= ORDER
        yield packed[real], owner[real]


class Model:
    """The trie as sorted arrays: per order, nodes (context and symbol packed), and totals per context."""

    def __init__(self, nodes: list[tuple[np.ndarray, np.ndarray]]) -> None:
        self.keys, self.n, self.contexts, self.total, self.kinds, self.inherited = [], [], [], [], [], []
        for keys, n in nodes:
            self.add(keys, n)

    def add(self, keys: np.ndarray, n: np.ndarray) -> None:
        """The nodes of the next order."""
        at, order = np.argsort(keys, kind="stable"), len(self.keys)
        keys, n = keys[at].astype(np.uint64), n[at].astype(np.float64)
        contexts, first = np.unique(keys >> np.uint64(8), return_index=True)
        add = lambda v: np.add.reduceat(v, first) if len(first) else v
        shorter = np.zeros(len(keys))
        if order and len(keys):  # what this context's symbols count in the context one byte shorter
            shorter = self.n[-1][np.searchsorted(self.keys[-1], keys & self.mask(order - 1))]
        self.keys.append(keys)
        self.n.append(n)
        self.contexts.append(contexts)
        self.total.append(add(n))
        self.kinds.append(add(np.ones(len(keys))))
        self.inherited.append(add(shorter))

    def longer(self, nodes: list[tuple[np.ndarray, np.ndarray]]) -> Model:
        """With further orders; the arrays of those that are there are shared."""
        out = Model([])
        for name, arrays in vars(self).items():
            setattr(out, name, list(arrays))
        for keys, n in nodes:
            out.add(keys, n)
        return out

    @staticmethod
    def mask(order: int) -> np.uint64:
        return np.uint64((1 << 8 * (order + 1)) - 1)

    @staticmethod
    def find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(keys):
            return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return at, keys[at] == wanted

    def log10(self, wanted: np.ndarray) -> np.ndarray:
        """log10 probability of each gram's last byte after the bytes before it."""
        out, open_ = np.zeros(len(wanted)), np.ones(len(wanted), bool)
        seen, seen_kinds = np.zeros(len(wanted)), np.zeros(len(wanted))  # excluded: counts here, and distinct symbols
        for order in reversed(range(len(self.keys))):
            key = wanted & self.mask(order)
            at, known = self.find(self.contexts[order], key >> np.uint64(8))
            if not known.any():
                continue
            total = np.where(known, self.total[order][at] - seen, 0)
            kinds = np.where(known, self.kinds[order][at] - seen_kinds, 0)
            node, hit = self.find(self.keys[order], key)
            coded = open_ & known & hit
            out[coded] += np.log10(self.n[order][node[coded]] / (total[coded] + kinds[coded]))
            open_ &= ~coded
            escape = open_ & known & (kinds > 0)
            out[escape] += np.log10(kinds[escape] / (total[escape] + kinds[escape]))
            seen = np.where(known, self.inherited[order][at], 0)
            seen_kinds = np.where(known, self.kinds[order][at], 0)
        out[open_] -= np.log10(np.maximum(1, 256 - seen_kinds[open_]))
        return out


class Head:
    """Values of the commonest grams: sorted arrays behind a direct-mapped table."""

    BITS = 21

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        at = np.argsort(keys)
        self.keys, self.values = keys[at].astype(np.uint64), values[at]
        self.slots = np.full(1 << self.BITS, -1, np.int32)
        self.slots[self.slot(self.keys)] = np.arange(len(keys), dtype=np.int32)

    def slot(self, wanted: np.ndarray) -> np.ndarray:
        return ((wanted * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def find(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values, found)."""
        if not len(self.keys):
            return np.zeros(len(wanted)), np.zeros(len(wanted), bool)
        at = self.slots[self.slot(wanted)]
        found = (at >= 0) & (self.keys[at] == wanted)
        miss = np.flatnonzero(~found & (at >= 0))  # of grams that share a slot one has it
        at[miss], found[miss] = Model.find(self.keys, wanted[miss])
        return np.where(found, self.values[at], 0.0), found


def count(docs: DataFrame, train: Column) -> DataFrame:
    """(gram, word, n) over all training documents: a row for each distinct gram (word null) and each word (gram null)."""
    texts = docs.where(train).select(F.coalesce("text", F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4 * SLICE):
            data = [t.encode().translate(LOWER) for t in batch.column(0).to_pylist()]
            words: Counter = Counter()
            for t in data:
                words.update(t.split())
            words[END_TOKEN] += len(data)
            yield pa.RecordBatch.from_arrays([pa.nulls(len(words), pa.int64()), pa.array(words.keys(), pa.binary()),
                                              pa.array(words.values(), pa.int64())], names=["gram", "word", "n"])
            keys, n = np.empty(0, np.uint64), np.empty(0, np.int64)
            for packed, _ in grams(data):
                k, c = np.unique(packed, return_counts=True)
                keys, back = np.unique(np.concatenate([keys, k]), return_inverse=True)
                n = np.bincount(back, np.concatenate([n, c])).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.nulls(len(keys), pa.binary()), pa.array(n)],
                                             names=["gram", "word", "n"])

    return texts.mapInArrow(run, "gram long, word binary, n long").groupBy("gram", "word").agg(F.sum("n").alias("n"))


def short_orders(counts: DataFrame) -> Model:
    """All nodes of the orders up to SHORT."""
    mask = int(Model.mask(SHORT))
    rows = counts.where("gram IS NOT NULL").groupBy(F.col("gram").bitwiseAND(mask).alias("key")).agg(F.sum("n").alias("n")).toArrow()
    key, n = rows.column("key").to_numpy().astype(np.uint64), rows.column("n").to_numpy()
    return Model([folded(key, n, k) for k in range(SHORT + 1)])


def folded(grams_: np.ndarray, n: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    keys, back = np.unique(grams_ & Model.mask(order), return_inverse=True)
    return keys, np.bincount(back, n, len(keys))


def head_of(counts: DataFrame) -> Head:
    """Grams of a share of GRAM_SHARE of the training bytes; they code at their longest context."""
    rows = counts.where("gram IS NOT NULL").select("gram", "n")
    total = rows.agg(F.sum("n")).first()[0] or 0
    context = Window.partitionBy(F.shiftright("gram", 8))
    top = rows.withColumn("whole", F.sum("n").over(context) + F.count("*").over(context)).where(F.col("n") >= total * GRAM_SHARE) \
        .select("gram", F.log10(F.col("n") / F.col("whole")).alias("value")).toArrow()
    return Head(top.column("gram").to_numpy(), top.column("value").to_numpy())


def valued(counts: DataFrame, wanted: DataFrame, short: Broadcast) -> DataFrame:
    """(gram, value): log10 probability of each distinct wanted gram.

    Counted and wanted grams with the same bytes 1 to 3 lie together: the nodes of their longest orders are whole there.
    """
    both = counts.where("gram IS NOT NULL").select("gram", "n", F.lit(False).alias("wanted")) \
        .unionByName(wanted.select("gram", F.lit(0).cast("long").alias("n"), F.lit(True).alias("wanted")))
    place = F.shiftright("gram", 8).bitwiseAND((1 << 24) - 1).alias("place")
    dealt = both.groupBy("gram").agg(F.sum("n").alias("n"), F.max("wanted").alias("wanted")).select(place, "gram", "n", "wanted") \
        .repartition("place").sortWithinPartitions("place")

    def of(rows: pa.Table) -> pa.RecordBatch:
        gram, n = rows.column("gram").to_numpy().astype(np.uint64), rows.column("n").to_numpy()
        ask = gram[rows.column("wanted").to_numpy()]
        there = n > 0
        model = short.value.longer([folded(gram[there], n[there], k) for k in range(SHORT + 1, ORDER + 1)])
        return pa.RecordBatch.from_arrays([pa.array(ask.astype(np.int64)), pa.array(model.log10(ask))], names=["gram", "value"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= CHUNK:
                rows = pa.Table.from_batches(held)
                places = rows.column("place").to_numpy()
                cut = int(np.searchsorted(places, places[-1]))
                yield of(rows.slice(0, cut))
                held, size = rows.slice(cut).to_batches(), size - cut
        if size:
            yield of(pa.Table.from_batches(held))

    return dealt.mapInArrow(run, "gram long, value double")


def score(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score), a row for each input row.

    `train` is a condition on doc_id and text, the names that the id and text columns get. Null texts count as empty (the
    end token alone); null conditions as false; repeated rows and null ids give a row each. Without training documents all
    bytes are equally likely. Rows are numbered once, in what is staged.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    counts = staged(count(docs, F.coalesce(train, F.lit(False))), "ppm-counts")
    words = counts.where("word IS NOT NULL").select("word", F.col("n").alias("c"))
    got = words.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    tokens, kinds = got["n"] or 0, got["v"]
    top = words.where((F.col("c") >= tokens * HEAD_SHARE) & (F.octet_length("word") <= HEAD_WORD_BYTES)).toArrow()  # <= 2^20 rows
    head = spark.sparkContext.broadcast(dict(zip(top.column(0).to_pylist(), top.column(1).to_pylist(), strict=True)))
    head_grams = spark.sparkContext.broadcast(head_of(counts))
    per_token = tokens + 0.1 * (kinds + 1)

    def parts(**columns: pa.Array) -> pa.RecordBatch:
        size = len(columns["row"])
        return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(size, f.type)).cast(f.type) for f in types], schema=types)

    types = to_arrow_schema(_parse_datatype_string(PARTS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, grams_ = head.value, head_grams.value
        logs = {c: float(np.log10((c + 0.1) / per_token)) for c in set(common.values())}
        for batch in slices(batches, 4 * SLICE):
            rows, n, known, base = batch.column(0).to_numpy(), [], [], []
            data = [(t or "").encode().translate(LOWER) for t in batch.column(2).to_pylist()]
            rare: tuple[list, list, list] = ([], [], [])
            for row, text in zip(rows.tolist(), data, strict=True):
                found = Counter(text.split())
                found[END_TOKEN] += 1
                got = [(common[w], k) for w, k in found.items() if w in common]
                n.append(found.total())
                known.append(sum(k for _, k in got))
                base.append(sum(k * logs[c] for c, k in got))
                for w, k in found.items():
                    if w not in common:
                        rare[0].append(row)
                        rare[1].append(w)
                        rare[2].append(k)
            score = np.zeros(len(data))
            for packed, owner in grams(data):
                values, there = grams_.find(packed)
                score += np.bincount(owner, values, len(data))
                pairs, tf = np.unique((owner[~there].astype(np.uint64) << np.uint64(40)) | packed[~there], return_counts=True)
                yield parts(row=pa.array(rows[(pairs >> np.uint64(40)).astype(np.int64)]),
                            gram=pa.array((pairs & Model.mask(ORDER)).astype(np.int64)), tf=pa.array(tf))
            yield parts(row=pa.array(rare[0], pa.int64()), word=pa.array(rare[1], pa.binary()), tf=pa.array(rare[2], pa.int64()))
            yield parts(row=batch.column(0), doc_id=batch.column(1), n_tokens=pa.array(n), n_known=pa.array(known),
                        base=pa.array(base, pa.float64()), score=pa.array(score))

    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    found = staged(rows.mapInArrow(run, PARTS), "ppm-found")
    rare_grams = found.where("gram IS NOT NULL").select("row", "gram", "tf")
    short = spark.sparkContext.broadcast(short_orders(counts))
    values = staged(valued(counts, rare_grams, short), "ppm-values")
    none = {c: F.lit(None).cast("long" if c in ("doc_id", "n_tokens", "n_known") else "double").alias(c)
            for c in ("doc_id", "n_tokens", "n_known", "base", "score")}
    c = F.coalesce("c", F.lit(0))
    by_word = found.where("word IS NOT NULL").select("row", "word", "tf").join(words, "word", "left").select(
        "row", none["doc_id"], none["n_tokens"], F.when(c > 0, F.col("tf")).alias("n_known"),
        (F.col("tf") * F.log10((c + 0.1) / F.lit(per_token))).alias("base"), none["score"])
    by_gram = rare_grams.join(values, "gram").select(
        "row", none["doc_id"], none["n_tokens"], none["n_known"], none["base"], (F.col("tf") * F.col("value")).alias("score"))
    return found.where("n_tokens IS NOT NULL").select("row", *none).unionByName(by_word).unionByName(by_gram).groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.sum("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"), F.sum("base").alias("base_score"), F.sum("score").alias("score")).drop("row")
