"""Document fingerprints as invertible Bloom lookup tables, in DataFrame operations alone.

A text's paragraphs are the stretches of its lines, 256 characters at most. Each distinct paragraph, with how often it
occurs, is a key in three cells, one in each third of the table; a cell has a count, the XOR of its keys and the XOR of
their check sums. Such tables are linear: subtracting one version's cells from another's leaves the keys of only one of
them. A cell left with a single key gives it away; taking it out of its other cells frees more (peeling). Where cells
remain, the pair is tried again with a table four times as large.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelframe.llm.common import numbered, staged

CELLS = 60        # of a fingerprint; a multiple of three
GROWTH = 4
SWEEPS = 3        # over the three thirds, before a pair counts as failed
PARAGRAPH = r"[^\n]{1,256}"


def paragraphs(text: Column) -> Column:
    """64-bit digests of the paragraphs of a text, in order."""
    return F.transform(F.regexp_extract_all(text, F.lit(PARAGRAPH), F.lit(0)), lambda p: F.xxhash64(p))


def keyed(digests: DataFrame, by: str, columns: Sequence[str]) -> DataFrame:
    """(by, columns): the arrays of digests as sets of keys; a key is a digest with how often it occurs. Empty ones are kept.

    Rows are dealt before they are exploded, so the aggregates that follow need no further exchange.
    """
    one = digests.repartition(by).select(by, F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(c).alias("d")) for k, c in enumerate(columns)])).alias("v")) \
        .select(by, "v.k", F.explode_outer("v.d").alias("d"))
    keys = one.groupBy(by, "k", "d").agg(F.count("*").alias("n")) \
        .withColumn("key", F.when(F.col("d").isNotNull(), F.xxhash64("d", "n")))
    return keys.groupBy(by).agg(*[F.sort_array(F.collect_list(F.when(F.col("k") == k, F.col("key")))).alias(c) for k, c in enumerate(columns)])


def check(key: Column) -> Column:
    return F.xxhash64(key, F.lit("check"))


def cell(key: Column, third: Column, cells: int) -> Column:
    return third * F.lit(cells // 3) + F.pmod(F.xxhash64(key, third), F.lit(cells // 3)).cast("int")


def tables(signed: DataFrame, by: Sequence[str], cells: int) -> DataFrame:
    """(by, cell, n, keys, checks) from rows (by, key, sign): the cells that are not empty."""
    placed = signed.withColumn("third", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    return placed.groupBy(*by, cell(F.col("key"), F.col("third"), cells).alias("cell")).agg(
        F.sum("sign").alias("n"), F.bit_xor("key").alias("keys"), F.bit_xor(check(F.col("key"))).alias("checks")) \
        .where("n <> 0 OR keys <> 0 OR checks <> 0")


def fingerprints(sets: DataFrame, by: str, columns: Sequence[str], cells: int = CELLS) -> DataFrame:
    """(by, columns): each set of keys as the base64 text of its table (size, then cell, count, keys, 32 check bits each)."""
    sets = sets.repartition(by)  # once, before the cells are made
    one = sets.select(by, F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(c).alias("s")) for k, c in enumerate(columns)])).alias("v")) \
        .select(by, "v.k", F.explode("v.s").alias("key"), F.lit(1).alias("sign"))
    wide = lambda c, digits: F.right(F.lpad(F.hex(c), 16, "0"), F.lit(digits))
    each = tables(one, [by, "k"], cells).select(by, "k", "cell", F.concat(wide(F.col("cell"), 4), wide(F.col("n"), 8), wide(F.col("keys"), 16),
                                                                          wide(F.col("checks"), 8)).alias("x"))
    texts = each.groupBy(by).agg(*[F.sort_array(F.collect_list(F.when(F.col("k") == k, F.struct("cell", "x")))).alias(c)
                                   for k, c in enumerate(columns)])
    sizes = sets.select(by, *[F.size(c).alias(f"n_{c}") for c in columns])
    return sizes.join(texts, by, "left").select(by, *[F.base64(F.unhex(F.concat(
        wide(F.col(f"n_{c}"), 8), F.coalesce(F.array_join(F.col(f"{c}.x"), ""), F.lit(""))))).alias(c) for c in columns])


def peel(state: DataFrame, by: Sequence[str], cells: int, third: int) -> DataFrame:
    """One pass over a third of the tables: single keys become rows of their own (cell -1, found) and leave their other cells.

    A key has one cell in each third, so no key is found twice in a pass.
    """
    key, t = F.col("keys"), F.lit(third)
    single = (F.abs("n") == 1) & (F.col("checks") == check(key)) & (F.col("cell") == cell(key, t, cells))
    row = lambda c, found, n, keys, checks: F.struct(c.cast("int").alias("cell"), found.cast("long").alias("found"), n.cast("long").alias("n"),
                                                     keys.cast("long").alias("keys"), checks.cast("long").alias("checks"))
    zero = F.lit(0)
    out = [row(F.lit(-1), key, F.col("n"), zero, zero),
           *[row(cell(key, F.lit(o), cells), zero, -F.col("n"), key, F.col("checks")) for o in range(3) if o != third]]
    stay = F.array(row(F.col("cell"), F.col("found"), F.col("n"), key, F.col("checks")))
    return state.select(*by, F.explode(F.when(single, F.array(*out)).otherwise(stay)).alias("r")).select(*by, "r.*") \
        .groupBy(*by, "cell", "found").agg(F.sum("n").alias("n"), F.bit_xor("keys").alias("keys"), F.bit_xor("checks").alias("checks")) \
        .where("cell < 0 OR n <> 0 OR keys <> 0 OR checks <> 0")


def decoded(pairs: DataFrame, by: Sequence[str], cells: int) -> DataFrame:
    """State after peeling the subtracted tables of `pairs` (by, plus, minus: sets of keys)."""
    sign = lambda c, s: F.transform(c, lambda k: F.struct(k.alias("key"), F.lit(s).alias("sign")))
    signed = pairs.repartition(*by).select(*by, F.explode(F.concat(sign("plus", 1), sign("minus", -1))).alias("s")).select(*by, "s.*")
    state = tables(signed, by, cells).withColumn("found", F.lit(0).cast("long"))
    for _ in range(SWEEPS):
        for third in range(3):
            state = peel(state, by, cells, third)
    return state


def differences(pairs: DataFrame, by: Sequence[str], cells: int = CELLS) -> DataFrame:
    """(by, only_plus, only_minus): the keys recovered for each pair of sets that differ; equal ones give no row.

    Pairs whose tables do not peel to nothing are tried again with larger ones until none is left.
    """
    results = None
    while True:
        state = decoded(pairs, by, cells)
        key = lambda n: F.collect_list(F.when((F.col("cell") < 0) & (F.col("n") == n), F.col("found")))
        got = staged(state.groupBy(*by).agg(F.count_if(F.col("cell") >= 0).alias("left"), key(1).alias("only_plus"), key(-1).alias("only_minus")), "peeled")
        done = got.where("left = 0").drop("left")
        results = done if results is None else results.unionByName(done)
        if got.where("left > 0").isEmpty():
            return results
        pairs = staged(pairs.join(got.where("left > 0").select(*by), list(by), "left_semi"), "pairs-again")
        cells *= GROWTH


def following(docs: DataFrame) -> DataFrame:
    """(row, doc_id, need, next_row): the row after each in ascending (doc_id, row), the first after the last.

    Rows are dealt by ranges of ids; in each range the next row is at hand, and only the first row of each range is needed
    by another.
    """
    dealt = staged(docs.select("row", "doc_id", F.expr("length(text) div 4").alias("need")).repartitionByRange("doc_id", "row")
                   .withColumn("range", F.spark_partition_id()), "order")
    firsts = dealt.groupBy("range").agg(F.min(F.struct("doc_id", "row")).alias("f")).select("range", F.col("f.row").alias("r"))
    by_range = Window.orderBy("range")  # one row for each range
    after = firsts.select("range", F.coalesce(F.lead("r").over(by_range), F.first("r").over(by_range)).alias("other"))
    inside = F.lead("row").over(Window.partitionBy("range").orderBy("doc_id", "row"))
    return dealt.withColumn("inside", inside).join(F.broadcast(after), "range") \
        .select("row", "doc_id", "need", F.coalesce("inside", "other").alias("next_row"))


def edited_versions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next), a row for each input row.

    The edited text has its last quarter replaced by as many first characters of the next document. Likeness is the Jaccard
    similarity of the paragraph sets, from what peeling the subtracted fingerprints recovers; two sets without a paragraph
    are alike (1). Null texts count as empty; null ids come first; rows that share an id follow in the order they are read.
    Other columns are ignored. Rows are numbered once and staged with their texts.
    """
    docs = numbered(docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")))
    links = staged(following(docs), "next")
    texts = docs.select("row", "text").repartition("row")  # both joins read this one exchange
    t, k = texts.alias("t"), links.alias("k")
    heads = t.join(k, F.col("t.row") == F.col("k.next_row")).select(
        "k.row", "k.doc_id", "k.next_row", "k.need", F.expr("substring(t.text, 1, k.need)").alias("head"))
    both = texts.join(heads, "row").withColumn("edited", F.concat(F.expr("substring(text, 1, length(text) - need)"), F.col("head")))
    found = staged(both.select("row", "doc_id", "next_row", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
                               paragraphs(F.col("text")).alias("a"), paragraphs(F.col("edited")).alias("b")), "versions")
    sets = staged(keyed(found.select("row", "a", "b"), "row", ["a", "b"]), "keys")
    beside = found.select("row", F.col("next_row").alias("n")).join(sets.select(F.col("row").alias("n"), F.col("a").alias("c")), "n")
    three = sets.join(beside.select("row", "c"), "row")
    pairs = staged(three.select("row", F.explode(F.array(F.struct(F.lit("edited").alias("kind"), F.col("a").alias("plus"), F.col("b").alias("minus")),
                                                         F.struct(F.lit("next").alias("kind"), F.col("a").alias("plus"), F.col("c").alias("minus"))))
                                .alias("p")).select("row", "p.*"), "pairs")
    apart = differences(pairs, ["row", "kind"]).select("row", "kind", F.size("only_plus").alias("x"), F.size("only_minus").alias("y"))
    sizes = pairs.select("row", "kind", F.size("plus").alias("p"), F.size("minus").alias("m"))
    x, y = F.coalesce("x", F.lit(0)), F.coalesce("y", F.lit(0))
    either = F.col("p") + y
    like = sizes.join(apart, ["row", "kind"], "left").select("row", "kind", F.when(either == 0, 1.0).otherwise((F.col("p") - x) / either).alias("near"))
    likes = like.groupBy("row").agg(F.max(F.when(F.col("kind") == "edited", F.col("near"))).alias("near_edited"),
                                    F.max(F.when(F.col("kind") == "next", F.col("near"))).alias("near_next"))
    prints = fingerprints(sets, "row", ["a", "b"]).withColumnsRenamed({"a": "fingerprint", "b": "edited_fingerprint"})
    return found.select("row", "doc_id", "n_chars", "edited_sha256").join(prints, "row").join(likes, "row") \
        .select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
