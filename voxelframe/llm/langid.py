"""Language identification by compression.

One zstandard raw-content dictionary per language; a text belongs to the language whose dictionary encodes it in the
fewest bytes, and is rejected when the runner-up is nearly as good.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelframe.llm.common import arrow_map, id_text, slices

UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")
REST = regex.compile(r"[^\p{L}]+")
SCHEMA = "doc_id long, lang_pred string, score double, rejected boolean"


@dataclass(frozen=True)
class Settings:
    """Bounds of the training sample, and when a prediction is rejected."""

    docs_per_language: int = 300      # labelled documents read per language, at most
    doc_bytes: int = 1 << 16          # longer documents are not used for training
    dictionary_bytes: int = 1 << 16   # per language
    languages: int = 500              # more distinct labels than this raise an error
    block: int = 4096                 # a text is encoded in blocks, all of them: margins do not shrink with its length
    margin: float = 0.01              # smaller relative savings against the runner-up are rejected


def fit(docs: DataFrame, train: Column, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text",
        settings: Settings = Settings()) -> dict[str, bytes]:
    """Dictionary content per language, from the labelled documents of smallest id hash (a bounded sample)."""
    rows = docs.where(train).select(
        F.xxhash64(F.col(f"`{id_col}`")).alias("h"), F.col(f"`{lang_col}`").cast("string").alias("lang"),
        F.col(f"`{text_col}`").alias("text")
    ).where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.octet_length("text") <= settings.doc_bytes))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(settings.languages + 1).collect()}
    if len(counts) > settings.languages:
        raise ValueError(f"more than {settings.languages} languages in {lang_col}")
    if not counts:
        return {}
    # the share of hashes that holds about twice the wanted number of documents of a language
    share = F.lit(1.0)
    for lang, n in counts.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, 2 * settings.docs_per_language / n))).otherwise(share)
    chosen = rows.where((F.col("h") / F.lit(2.0 ** 64) + 0.5) <= share).orderBy("h", "text") \
        .limit(3 * settings.docs_per_language * len(counts))
    taken: dict[str, bytearray] = {lang: bytearray() for lang in sorted(counts)}
    used = dict.fromkeys(taken, 0)
    for r in chosen.toLocalIterator():
        if used[r["lang"]] < settings.docs_per_language and len(taken[r["lang"]]) < settings.dictionary_bytes:
            used[r["lang"]] += 1
            taken[r["lang"]] += letters(r["text"])
    return {lang: bytes(b[:settings.dictionary_bytes]) for lang, b in taken.items() if b}


def letters(text: str) -> bytes:
    """Lower-case words of letters with one space around each."""
    return f" {REST.sub(' ', text.lower()).strip()} ".encode()


class Encoder:
    """Encoded size of a text under one language's dictionary."""

    LEAD = 256  # bytes of the dictionary put before a short text: zstandard would store it unencoded otherwise

    def __init__(self, content: bytes, settings: Settings) -> None:
        params = {"strategy": zstandard.STRATEGY_GREEDY, "min_match": 4, "search_log": 3, "window_log": 19, "chain_log": 16,
                  "hash_log": 17, "write_content_size": False, "write_dict_id": False}
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(compression_params=zstandard.ZstdCompressionParameters(**params))
        self.tool = zstandard.ZstdCompressor(dict_data=d, compression_params=zstandard.ZstdCompressionParameters(**params))
        self.lead, self.block = content[-self.LEAD:], settings.block

    def size(self, data: bytes) -> int:
        if len(data) < 4 * self.LEAD:
            return len(self.tool.compress(self.lead + data))
        return sum(len(self.tool.compress(data[i:i + self.block])) for i in range(0, len(data), self.block))


def decide(size: list[int], names: list[str], margin: float) -> tuple[str, float, bool]:
    """Language of the smallest size (ties: first by name), its relative saving, and whether that is too narrow."""
    best = min(range(len(size)), key=lambda i: (size[i], names[i]))
    rest = [s for i, s in enumerate(size) if i != best]
    saving = 1.0 if not rest else (min(rest) - size[best]) / min(rest)
    return names[best], saving, saving < margin


def judge(text: str | None, encoders: list[Encoder], names: list[str], margin: float) -> tuple[str, float, bool]:
    if not names or text is None or not LETTER.search(text):
        return UNKNOWN, 0.0, True
    data = letters(text)
    return decide([e.size(data) for e in encoders], names, margin)


def judging(docs: DataFrame, model: dict[str, bytes], settings: Settings) -> Callable[[pa.Array], list[tuple[str, float, bool]]]:
    """A function for the executors that judges a column of texts."""
    names = sorted(model)
    shared = docs.sparkSession.sparkContext.broadcast({n: model[n] for n in names})  # languages x dictionary_bytes at most
    made: list[list[Encoder]] = []

    def of(texts: pa.Array) -> list[tuple[str, float, bool]]:
        if not made:
            made.append([Encoder(shared.value[n], settings) for n in names])
        return [judge(t, made[0], names, settings.margin) for t in texts.to_pylist()]

    return of


def predict(docs: DataFrame, model: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text",
            settings: Settings = Settings()) -> DataFrame:
    """(doc_id, lang_pred, score, rejected), one row per input row.

    A null text, a text without a letter, or an empty model gives ``und``, score 0, rejected. The whole text counts.
    Repeated rows and null ids give a row each; other columns are ignored.
    """
    judged = judging(docs, model, settings)

    def of(batch: pa.RecordBatch) -> dict:
        lang, score, rejected = zip(*judged(batch.column(1)), strict=True)
        return {"doc_id": batch.column(0), "lang_pred": lang, "score": score, "rejected": rejected}

    return arrow_map(id_text(docs, id_col, text_col), of, SCHEMA)


def accepted(docs: DataFrame, model: dict[str, bytes], text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """The rows of docs, unchanged, whose text is not rejected."""
    judged, at = judging(docs, model, settings), docs.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield batch.filter(pa.array([not rejected for _, _, rejected in judged(batch.column(at))], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
