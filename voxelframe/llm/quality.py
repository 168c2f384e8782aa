"""Quality rules as a short-circuit cascade.

The measures of the base rule are taken of every document. The further rules run in the order of rejections per second,
both estimated on a sample, and stop at the first that rejects; the verdict does not depend on the order.
"""

from __future__ import annotations

import re
import time
from collections import Counter
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelframe.llm import common
from voxelframe.llm.common import arrow_map, id_text, slices

SYMBOL = re.compile(r"[#*$%&|<>]")
SCHEMA = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
          "base_failed boolean, kept boolean")
WINDOW = 5
LONG = 100_000  # words from which a text's windows are compared by hash, to bound memory


@dataclass(frozen=True)
class Measures:
    text: str
    words: list[bytes]
    word_chars: int
    n_symbols: int
    n_lines: int        # lines with a word
    n_dup_lines: int
    n_repeat_words: int

    @property
    def base_failed(self) -> bool:
        return len(self.words) < 10 or 100 * self.n_repeat_words > 20 * len(self.words)


def repeat_words(words: Sequence[bytes], width: int = WINDOW) -> int:
    """Words inside windows of `width` words that occur twice or more, the first occurrence included."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    if n > LONG:  # 64-bit hashes instead of tuples
        h = common.windows(common.HASHES.of(words), width, 4)
        _, back, times = np.unique(h, return_inverse=True, return_counts=True)
        change = np.zeros(len(words) + 1, np.int64)
        at = np.flatnonzero(times[back] > 1)
        np.add.at(change, at, 1)
        np.add.at(change, at + width, -1)
        return int((np.cumsum(change) > 0).sum())
    windows = list(zip(*(words[i:] for i in range(width)), strict=False))
    counts = Counter(windows)
    if len(counts) == n:
        return 0
    covered, end = 0, 0
    for i, w in enumerate(windows):
        if counts[w] > 1:
            covered += i + width - max(i, end)
            end = i + width
    return covered


def measure(text: str | None) -> Measures:
    """Null counts as empty. Words are maximal runs of anything but space and \\t \\n \\v \\f \\r."""
    text = text or ""
    data = text.encode()
    words = data.split()
    lines = [x for x in data.split(b"\n") if x.strip()]
    spaces = sum(map(text.count, " \t\n\v\f\r"))
    return Measures(text, words, len(text) - spaces, len(SYMBOL.findall(text)), len(lines), len(lines) - len(set(lines)),
                    repeat_words(words))


# name -> true if the document is rejected; integer comparisons only, so that SQL gives the same
RULES: dict[str, Callable[[Measures], bool]] = {
    "word_length": lambda m: not 2 * len(m.words) <= m.word_chars <= 25 * len(m.words),
    "symbols": lambda m: 10 * m.n_symbols > 3 * len(m.words),
    "duplicate_lines": lambda m: 10 * m.n_dup_lines > 3 * m.n_lines,
    "letters": lambda m: 2 * sum(map(str.isalpha, m.text)) < m.word_chars,
    "capitals": lambda m: 2 * sum("A" <= c <= "Z" for c in m.text) > m.word_chars,
    "common_word": lambda m: 10 * Counter(m.words).most_common(1)[0][1] > 4 * len(m.words),
    "ellipsis": lambda m: 10 * sum(x.rstrip(" \t\v\f\r").endswith(("...", "…")) for x in m.text.split("\n")) > 3 * m.n_lines,
}


def estimate(docs: DataFrame, sample: int = 2000, rules: dict[str, Callable[[Measures], bool]] = RULES) -> list[str]:
    """Rule names by rejections per second on about `sample` documents chosen by id hash; ties by name.

    Only the order comes from the sample, so its size cannot change a verdict.
    """
    total = docs.count()
    every = max(1, total // sample)
    chosen = id_text(docs).where(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0)

    def trial(batches):
        cost, hits = dict.fromkeys(rules, 0.0), dict.fromkeys(rules, 0)
        for batch in slices(batches):
            for text in batch.column(1).to_pylist():
                m = measure(text)
                if m.base_failed:
                    continue
                for name, rule in rules.items():
                    start = time.perf_counter()
                    hits[name] += rule(m)
                    cost[name] += time.perf_counter() - start
        yield pa.RecordBatch.from_pydict({"rule": list(rules), "cost": list(cost.values()), "hits": list(hits.values())})

    got = chosen.mapInArrow(trial, "rule string, cost double, hits long").groupBy("rule") \
        .agg(F.sum("hits").alias("hits"), F.sum("cost").alias("cost")).collect()  # a row for each rule
    worth = {r["rule"]: (r["hits"] + 1) / (r["cost"] + 1e-9) for r in got}
    return sorted(rules, key=lambda n: (-worth.get(n, 0.0), n))


def apply(docs: DataFrame, order: Sequence[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Measures and verdict, a row for each input row.

    Null and empty texts have no words and fail the base rule. Repeated rows and null ids give a row each; other columns
    are ignored. `kept` is false if the base rule or any rule of the cascade rejects.
    """
    order = list(order)

    def of(batch: pa.RecordBatch) -> dict:
        ms = [measure(t) for t in batch.column(1).to_pylist()]
        failed = [m.base_failed for m in ms]
        return {"doc_id": batch.column(0), "n_words": [len(m.words) for m in ms], "word_chars": [m.word_chars for m in ms],
                "n_symbols": [m.n_symbols for m in ms], "n_dup_lines": [m.n_dup_lines for m in ms],
                "n_repeat_words": [m.n_repeat_words for m in ms], "base_failed": failed,
                "kept": [not f and not any(RULES[n](m) for n in order) for m, f in zip(ms, failed, strict=True)]}

    return arrow_map(id_text(docs, id_col, text_col), of, SCHEMA)
