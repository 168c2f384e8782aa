"""N-gram Jaccard join, size-aware: light sets by fixed-size subsets, heavy sets by inverted lists.

Two sets of sizes s and t have a Jaccard similarity of a threshold or more exactly if they share a subset of the overlap
o(s, t) that the threshold asks for. Light sets enumerate these subsets: all sets under one subset are linked, so a star to
the smallest of them says the same as all their pairs. Heavy sets meet in the inverted lists of their first elements, in an
order that puts unshared elements first. The boundary is the size at which enumerating costs more than scanning.

Equal sets are one class and meet once. In a list all sets are first compared with its most typical one; what is linked is
one component then, and only pairs of different components go on.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelframe.llm.common import HASHES, LOWER, id_text, intermediate, numbered, slices, staged, windows
from voxelframe.operators.components import contract

LIGHT_MOST = 16  # sizes above are never light: their subsets are too many


@dataclass(frozen=True)
class Settings:
    width: int = 5         # words in a shingle
    percent: int = 80      # Jaccard similarity, in hundredths

    def overlap(self, s: int, t: int) -> int:
        """Smallest intersection of sets of sizes s and t that are linked: 100 i >= percent (s + t - i)."""
        return -(-self.percent * (s + t) // (100 + self.percent))

    def least(self, s: int) -> int:
        """Smallest size of a partner, and smallest overlap with any partner, of a set of size s."""
        return -(-self.percent * s // 100)

    def partners(self, s: int) -> range:
        return range(self.least(s), 100 * s // self.percent + 1)


def shingles(texts: list[str | None], width: int) -> Iterator[np.ndarray]:
    """Per text the sorted distinct hashes of its shingles; a text of fewer words is one shingle, one without words none."""
    split = [(t or "").encode().translate(LOWER).split() for t in texts]
    h = HASHES.of([w for words in split for w in words])
    grams, at = windows(h, width, 5), 0
    for words in split:
        n = len(words)
        if n >= width:
            yield np.unique(grams[at:at + n - width + 1])
        else:
            yield windows(h[at:at + n], n, 100 + n) if n else np.empty(0, np.uint64)
        at += n


def identity(hashes: np.ndarray) -> tuple[int, int]:
    """128-bit identity of a set, as two signed longs."""
    d = xxhash.xxh3_128_digest(hashes.tobytes())
    return int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True)


SETS = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64()),
                  ("first", pa.list_(pa.int64())), ("light", pa.list_(pa.int64()))])


def spare(n: int) -> int:
    """Elements looked at beyond a prefix, so that a heavy set needs that many shared ones to go on: a 20th of it."""
    return max(1, n // 20)


def signatures(docs: DataFrame, by: Settings) -> DataFrame:
    """(row, doc_id, n, lo, hi, first, light): size, identity, the first elements by hash, and small sets whole.

    With overlap o, the first s - o + e elements of both sets share e (any order that both use).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4 << 20):
            rows = []
            for u in shingles(batch.column(2).to_pylist(), by.width):
                n = len(u)
                signed = u.view(np.int64)
                rows.append((n, *identity(u), signed[:n - by.least(n) + spare(n)], signed if n <= LIGHT_MOST else None))
            n, lo, hi, first, light = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, f.type) for c, f in zip(
                (n, lo, hi, first, light), list(SETS)[2:], strict=True))], schema=SETS)

    return staged(docs.select("row", "doc_id", "text").mapInArrow(run, "row long, doc_id long, n long, lo long, hi long, first array<long>, light array<long>"), "sets")


def boundary(counts: dict[int, int], by: Settings) -> int:
    """Size up to which sets are light: least rows in all, counted from how many sets have each size.

    A light set makes a row for each subset; a heavy one about three for each element (prefix, screening, comparison). Sets
    near the boundary do both, as their partners may be heavy.
    """
    def light(s: int, x: int) -> int:
        return sum(comb(s, by.overlap(s, t)) for t in by.partners(s) if t <= x and not s == t == by.overlap(s, t))

    def cost(x: int) -> int:
        return sum(c * ((light(s, x) if s <= x else 0) + (3 * s if s > x or s >= by.least(x + 1) else 0)) for s, c in counts.items())

    return min(range(LIGHT_MOST + 1), key=lambda x: (cost(x), x))


def light_links(classes: DataFrame, x: int, by: Settings) -> DataFrame:
    """(u, w) among sets of at most x elements, from equal subsets of the size that their two sizes ask for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int, int, bool]] = []
            for row, elements in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                s = len(elements)
                for t in by.partners(s):
                    o = by.overlap(s, t)
                    if t > x or s == t == o:  # equal sets are one class already
                        continue
                    pair = bytes([min(s, t), max(s, t)])
                    for part in combinations(elements, o):
                        key = xxhash.xxh3_64_intdigest(pair + np.array(part, np.int64).tobytes())
                        out.append((key - (1 << 64) if key >> 63 else key, row, s <= t))
            columns = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.bool_()), strict=True)],
                                             names=["key", "row", "shorter"])

    keys = classes.where((F.col("n") > 1) & (F.col("n") <= x)).select("row", "light").mapInArrow(run, "key long, row long, shorter boolean")
    # a set links with those of the other size; where sizes are equal all rows are of the shorter kind
    ends = keys.groupBy("key").agg(F.min(F.when(F.col("shorter"), F.col("row"))).alias("low"),
                                   F.min(F.when(~F.col("shorter"), F.col("row"))).alias("high"), F.count("*").alias("c"),
                                   F.count_if("shorter").alias("c_low")).where("c > 1")
    other = F.when(F.col("c") == F.col("c_low"), F.col("low")).when(F.col("shorter"), F.col("high")).otherwise(F.col("low"))
    return keys.join(ends, "key").select(F.col("row").alias("u"), other.alias("w")).where("w IS NOT NULL AND u <> w").distinct()


def survivors(sets: DataFrame, x: int, by: Settings) -> DataFrame:
    """Rows of sets that may have a heavy partner: enough of their first elements are also first elements of other sets.

    What is shared is staged first, so that the join can split the rows of a very common element over many tasks.
    """
    rows = sets.where((F.col("n") > 0) & (F.col("n") >= by.least(x + 1)))
    one = rows.select("row", "n", "lo", F.explode("first").alias("h"))
    shared = staged(one.groupBy("h").agg(F.min("lo").alias("a"), F.max("lo").alias("b")).where("a <> b").select("h"), "shared")
    least = F.greatest(F.lit(1), F.expr(f"(({by.percent} * n + 99) div 100) div 20"))
    return staged(one.select("row", "n", "h").join(shared, "h").groupBy("row", "n").agg(F.count("*").alias("c"))
                  .where(F.col("c") >= least).select("row"), "survivors")


def whole_sets(docs: DataFrame, wanted: DataFrame, by: Settings) -> DataFrame:
    """(row, n, elements) of the wanted sets (row, lo, hi), from their texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4 << 20):
            rows = []
            for row, lo, hi, u in zip(*(batch.column(k).to_pylist() for k in range(3)), shingles(batch.column(3).to_pylist(), by.width),
                                      strict=True):
                if identity(u) != (lo, hi):
                    raise ValueError("the documents do not read alike each time")
                rows.append((row, len(u), u.view(np.int64)))
            columns = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.list_(pa.int64())), strict=True)],
                                             names=["row", "n", "elements"])

    texts = docs.select("row", "text").join(wanted, "row").select("row", "lo", "hi", "text")
    return staged(texts.mapInArrow(run, "row long, n long, elements array<long>"), "whole-sets")


def shared_parts(whole: DataFrame, by: Settings) -> DataFrame:
    """(row, n, m, shared): the m elements that another of these sets has too, rare ones first, where they are enough."""
    one = whole.select("row", "n", F.explode("elements").alias("h"))
    df = staged(one.groupBy("h").agg(F.count("*").alias("df")).where("df > 1"), "frequencies")
    parts = one.join(df, "h").groupBy("row", "n").agg(F.sort_array(F.collect_list(F.struct("df", "h"))).alias("shared"))
    return staged(parts.select("row", "n", F.size("shared").cast("long").alias("m"), F.col("shared.h").alias("shared"))
                  .where(F.col("m") * 100 >= F.col("n") * by.percent), "shared-parts")


def possible(by: Settings, n: Column, m: Column, n2: Column, m2: Column) -> Column:
    """Sizes and shared elements leave room for the overlap that the pair needs."""
    return (F.least(n, n2) * 100 >= F.greatest(n, n2) * by.percent) & (F.least(m, m2) * (100 + by.percent) >= (n + n2) * by.percent)


def verified(pairs: DataFrame, parts: DataFrame, by: Settings) -> DataFrame:
    """The pairs (u, w) whose exact overlap reaches the threshold."""
    one = lambda c: parts.select(F.col("row").alias(c), F.col("n").alias(f"n_{c}"), F.col("shared").alias(f"s_{c}"))
    both = F.size(F.array_intersect("s_u", "s_w"))
    return pairs.join(one("u"), "u").join(one("w"), "w").where(both * (100 + by.percent) >= (F.col("n_u") + F.col("n_w")) * by.percent) \
        .select("u", "w")


def heavy_links(parts: DataFrame, known: DataFrame, by: Settings) -> DataFrame:
    """(u, w) that join all linked sets of `parts` into components, given the links (u, w) known already."""
    take = F.expr(f"n - (({by.percent} * n + 99) div 100) + 1 - (n - m)")  # unshared elements are first in the order
    lists = parts.select("row", "n", "m", F.posexplode(F.slice("shared", F.lit(1), take.cast("int"))).alias("at", "h"))
    lists = staged(lists.select("row", "n", "m", "h", F.col("at").cast("long").alias("at")), "lists")
    typical = F.min(F.struct((F.col("n") - F.col("m")).alias("k"), "row", "n", "m")).alias("p")
    pivots = staged(lists.groupBy("h").agg(typical, F.count("*").alias("c")).where("c > 1").select("h", "p"), "pivots")
    star = lists.join(pivots, "h").where((F.col("row") != F.col("p.row")) & possible(by, F.col("n"), F.col("m"), F.col("p.n"), F.col("p.m"))) \
        .select(F.col("row").alias("u"), F.col("p.row").alias("w")).distinct()
    links = staged(known.unionByName(verified(star, parts, by)), "links")
    of = contract(links.select(F.lit(0).alias("k"), "u", "w")).select(F.col("u").alias("row"), F.col("w").alias("c"))
    left = staged(lists.join(of, "row", "left").withColumn("c", F.coalesce("c", "row")), "lists-left")
    mixed = left.groupBy("h").agg(F.min("c").alias("a"), F.max("c").alias("b"), F.min("n").alias("low")).where("a <> b").select("h", "low")
    mixed = staged(mixed, "mixed")
    # a set goes on if the smallest size it can meet in the list leaves room for an overlap
    least = F.greatest("low", F.expr(f"({by.percent} * n + 99) div 100"))
    left = left.join(mixed, "h").where(F.col("m") * (100 + by.percent) >= (F.col("n") + least) * by.percent).drop("low")
    left = staged(left.join(parts.select("row", F.slice("shared", F.lit(1), take.cast("int")).alias("prefix")), "row"), "lists-mixed")
    a, b = left.alias("a"), left.alias("b")
    bound = F.least("a.at", "b.at") + F.least(F.col("a.m") - F.col("a.at"), F.col("b.m") - F.col("b.at"))
    rest = a.join(b, (F.col("a.h") == F.col("b.h")) & (F.col("a.row") < F.col("b.row")) & (F.col("a.c") != F.col("b.c"))
                  & possible(by, F.col("a.n"), F.col("a.m"), F.col("b.n"), F.col("b.m"))
                  & (bound * (100 + by.percent) >= (F.col("a.n") + F.col("b.n")) * by.percent)
                  # a pair meets once, in the list of the first element that both prefixes have
                  & (F.element_at(F.array_intersect("a.prefix", "b.prefix"), 1) == F.col("a.h"))) \
        .select(F.col("a.row").alias("u"), F.col("b.row").alias("w")).distinct()
    return links.unionByName(verified(rest, parts, by))


def grouped(docs: DataFrame, by: Settings) -> DataFrame:
    """(row, doc_id, n, root): rows of one component have one root; sets without elements are components of their own."""
    sets = signatures(docs, by)
    # row: any one of the class
    classes = staged(sets.where("n > 0").groupBy("lo", "hi", "n").agg(F.min(F.struct("row", "light")).alias("r"))
                     .select("lo", "hi", "n", "r.*"), "classes")
    counts = {r["s"]: r["c"] for r in classes.groupBy(F.least("n", F.lit(LIGHT_MOST + 1)).alias("s")).agg(F.count("*").alias("c")).collect()}
    x = boundary(counts, by)
    wanted = classes.join(survivors(sets, x, by), "row", "left_semi").select("row", "lo", "hi")
    parts = shared_parts(whole_sets(docs, wanted, by), by)
    links = staged(heavy_links(parts, light_links(classes, x, by), by), "all-links")
    of = contract(links.select(F.lit(0).alias("k"), "u", "w")).select(F.col("u").alias("row"), F.col("w").alias("root"))
    roots = classes.join(of, "row", "left").select("lo", "hi", F.coalesce("root", "row").alias("root"))
    one = sets.select("row", "doc_id", "n", "lo", "hi")
    return one.where("n > 0").join(roots, ["lo", "hi"]).select("row", "doc_id", "n", "root") \
        .unionByName(one.where("n = 0").select("row", "doc_id", "n", F.col("row").alias("root")))


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", by: Settings = Settings()) -> DataFrame:
    """(doc_id, n_shingles, component_id), a row for each input row.

    Null texts and texts without words have an empty set, linked with nothing (their component is their own id). Repeated
    rows are equal sets. Rows with a null id take part; a component whose ids are all null has a null component_id. Other
    columns are ignored. Rows are numbered once and staged with their texts.
    """
    with intermediate(docs.sparkSession) as keep:
        rows = keep(grouped(numbered(id_text(docs, id_col, text_col)), by), "grouped")
    smallest = staged(rows.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("c")).where("c > 1").drop("c"), "smallest")
    return rows.join(smallest, "root", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", by: Settings = Settings()) -> DataFrame:
    """The rows of docs, unchanged, that come first in their component: by id, null ids last, then as read."""
    docs = numbered(docs, "__row")
    with intermediate(docs.sparkSession) as keep:
        rows = grouped(docs.select(F.col("__row").alias("row"), F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")), by)
        first = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "row")).alias("r"))
        chosen = keep(first.select(F.col("r.row").alias("__row")), "representatives")
    return docs.join(chosen, "__row", "left_semi").drop("__row")
