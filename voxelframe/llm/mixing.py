"""Mixing sources to target weights with a low-discrepancy schedule, in DataFrame operations alone.

The mix is a row of slots, each for one block of words. Slot k has a golden-ratio point, frac(k * 0.618...), and the cumulative
shares of the sources cut [0, 1): the slot belongs to the source whose stretch the point falls into, so any stretch of the
mix holds the sources near their shares. A source's slots are ranked, its documents are shuffled by a hash and laid end to
end, pass after pass, and cut into blocks of equal size; block r goes to the slot of rank r.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil, isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelframe.llm.common import numbered, staged

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SHARE = (3, 2)      # of all words, numerator and denominator
PASSES = 2          # a source gives each of its words so often at most
BLOCK = 256         # words of a slot
POINTS = 1 << 31
STEP = 1327217885   # fixed value: the odd number nearest to POINTS / golden ratio
CELLS = 1 << 12     # of the points, to look up a slot's source by an equality


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(row, doc_id, source, size, key), staged: a number for each row, its words and a hash for the shuffle."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    doc = F.col(f"`{id_col}`").cast("long")
    return numbered(docs.select(doc.alias("doc_id"), F.col(f"`{source_col}`").cast("string").alias("source"),
                                F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
                                F.md5(F.concat(F.coalesce(doc.cast("string"), F.lit("")), F.lit(":"), text)).alias("key")))


def running(table: DataFrame, order: Sequence[Column], sums: Sequence[str]) -> DataFrame:
    """table with `before_<sum>`: the sums over all rows before each one. Rows are dealt by ranges, only totals of ranges meet."""
    dealt = staged(table.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "ranges")
    ends = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    starts = dealt.groupBy("range").agg(*[F.sum(c).alias(c) for c in sums]).select(
        "range", *[F.coalesce(F.sum(c).over(ends), F.lit(0)).alias(f"start_{c}") for c in sums])
    inside = Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return dealt.select("*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"in_{c}") for c in sums]).join(starts, "range") \
        .select(*table.columns, *[(F.col(f"in_{c}") + F.col(f"start_{c}")).alias(f"before_{c}") for c in sums])


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: tuple[int, int] = SHARE, passes: int = PASSES,
            block: int = BLOCK) -> DataFrame:
    """(source, no, source_size, target, need, blocks), staged: what the mix takes of each source.

    A source takes its weight's share of all, up to `passes` times its size; what is over goes to the others by weight. That
    is one level for all: a source takes the lesser of level * weight and its limit. The level rises as sources reach their
    limits, until no more do; only two sums a round come to the driver.
    """
    by_name = [F.col("source").isNull(), F.col("source")]
    one = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("one", F.lit(1).cast("long"))
    one = running(one, by_name, ["one"]).withColumnRenamed("before_one", "no")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("no") % len(weights) + 1).cast("int")).cast("long")
    limit = F.col("source_size") * passes
    one = staged(one.select("source", "no", "source_size", weight.alias("weight"), limit.alias("limit"), (limit / weight).alias("full_at")), "weights")
    total = one.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    full, top, bottom = -1, 0, 1
    while True:
        at_limit = F.col("full_at") < F.lit(top / bottom)
        got = one.agg(F.count_if(at_limit), F.coalesce(F.sum(F.when(at_limit, F.col("limit"))), F.lit(0)),
                      F.coalesce(F.sum(F.when(~at_limit, F.col("weight"))), F.lit(0))).first()
        if got[0] <= full:
            break
        full = got[0]
        if got[2]:
            top, bottom = share[0] * total - share[1] * got[1], share[1] * got[2]
    target = F.when(F.col("full_at") < F.lit(top / bottom), F.col("limit").cast("double")).otherwise(
        (F.col("weight") * F.lit(top)).cast("double") / F.lit(float(bottom)))
    need = F.floor(target + 0.5)
    out = one.select("source", "no", "source_size", target.alias("target"), need.alias("need"),
                     F.ceil(need / F.lit(block)).alias("blocks"))
    return staged(running(out, [F.col("no")], ["blocks"]), "targets")


def schedule(sources: DataFrame) -> DataFrame:
    """(no, rank, slot): the slots of each source, ranked from 0, as many as it has blocks.

    The points give a source as many slots as its share asks for, but for a few (their discrepancy). Slots past its last block
    are dropped; those it is short of follow after all others.
    """
    spark = sources.sparkSession
    count = sources.agg(F.coalesce(F.sum("blocks"), F.lit(0))).first()[0]
    edge = lambda c: F.floor(F.lit(float(POINTS)) * (c / F.lit(max(1, count))))
    cut = sources.select("no", "blocks", edge(F.col("before_blocks")).alias("low"), edge(F.col("before_blocks") + F.col("blocks")).alias("high"))
    width = POINTS // CELLS
    cut = staged(cut.where("low < high").withColumn("cell", F.explode(F.sequence(
        F.floor(F.col("low") / width), F.floor((F.col("high") - 1) / width)))), "stretches")
    tasks = max(spark.sparkContext.defaultParallelism, ceil(count / 4_000_000))
    k = spark.range(0, count, 1, tasks).select(F.col("id").alias("slot"), ((F.col("id") + 1) % POINTS * STEP % POINTS).alias("point"))
    placed = k.withColumn("cell", F.floor(F.col("point") / width)).join(cut, "cell").where("low <= point AND point < high")
    chunk = max(1, isqrt(count))
    dealt = placed.select("no", "blocks", "slot", F.expr(f"slot div {chunk}").alias("chunk")).repartition("no", "chunk")
    per = dealt.groupBy("no", "chunk").agg(F.count(F.lit(1)).alias("n"))
    by_chunk = Window.partitionBy("no").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)  # the root of the slots
    starts = per.select("no", "chunk", F.coalesce(F.sum("n").over(by_chunk), F.lit(0)).alias("start"))
    inside = F.row_number().over(Window.partitionBy("no", "chunk").orderBy("slot")) - 1
    ranked = dealt.withColumn("inside", inside).join(starts, ["no", "chunk"]).withColumn("rank", F.col("start") + F.col("inside")) \
        .where("rank < blocks").select("no", "rank", "slot")
    got = per.groupBy("no").agg(F.sum("n").alias("got"))
    short = sources.join(got, "no", "left").withColumn("got", F.coalesce("got", F.lit(0))).where("got < blocks")
    after = short.select("no", "got", F.explode(F.expr("sequence(got, blocks - 1)")).alias("rank"))
    many = sources.count()
    return ranked.unionByName(after.select("no", "rank", (F.lit(count) + (F.col("rank") - F.col("got")) * many + F.col("no")).alias("slot")))


def laid_out(sized: DataFrame, sources: DataFrame, passes: int = PASSES) -> DataFrame:
    """(row, doc_id, no, pass, at, end): where each document lies among its source's words, pass after pass, up to its need.

    A pass has an order of its own: that of the hash's next digits, or of a hash of the pass and the hash from the third on.
    Running totals are taken in buckets of hashes, about the root of all rows.
    """
    digits = F.when(F.col("pass") < 2, F.substring("key", F.col("pass") * 16 + 1, F.lit(16))).otherwise(
        F.substring(F.md5(F.concat(F.col("pass").cast("string"), F.lit(":"), F.col("key"))), 1, 16))
    of = sources.select(F.col("source").alias("of"), "no", "source_size", "need")
    one = sized.where("size > 0").join(of, F.col("source").eqNullSafe(F.col("of"))) \
        .withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(passes - 1)))).where("need > pass * source_size")
    buckets = max(1, isqrt(sized.count()))
    one = one.withColumn("order", digits).withColumn(
        "bucket", F.floor(F.conv(F.substring("order", 1, 7), 16, 10).cast("long") * buckets / F.lit(1 << 28)))
    one = one.select("row", "doc_id", "no", "pass", "order", "bucket", "size", "source_size", "need").repartition("no", "pass", "bucket")
    per = one.groupBy("no", "pass", "bucket").agg(F.sum("size").alias("s"))
    by_bucket = Window.partitionBy("no", "pass").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = per.select("no", "pass", "bucket", F.coalesce(F.sum("s").over(by_bucket), F.lit(0)).alias("start"))
    inside = Window.partitionBy("no", "pass", "bucket").orderBy("order", "doc_id", "row").rowsBetween(Window.unboundedPreceding, -1)
    placed = one.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(starts, ["no", "pass", "bucket"]) \
        .withColumn("at", F.col("pass") * F.col("source_size") + F.col("start") + F.col("inside")).where("at < need")
    return placed.select("row", "doc_id", "no", "pass", "at", F.least(F.col("at") + F.col("size"), F.col("need")).alias("end"))


def pieces(sized: DataFrame, sources: DataFrame, passes: int = PASSES, block: int = BLOCK) -> DataFrame:
    """(slot, at, row, doc_id, pass, start, length): the mix, by slot and by place in it; `start` counts the document's words."""
    cut = laid_out(sized, sources, passes).withColumn("rank", F.explode(F.expr(f"sequence(at div {block}, (end - 1) div {block})")))
    cut = cut.select("row", "doc_id", "no", "pass", "rank", "at", F.greatest("at", F.col("rank") * block).alias("low"),
                     F.least("end", (F.col("rank") + 1) * block).alias("high"))
    return cut.join(schedule(sources), ["no", "rank"]).select(
        "slot", (F.col("low") - F.col("rank") * block).alias("at"), "row", "doc_id", "pass", (F.col("low") - F.col("at")).alias("start"),
        (F.col("high") - F.col("low")).alias("length"))


def texts(docs: DataFrame, mix: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(slot, at, doc_id, text): the words of each piece; ids have to be unique."""
    words = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.regexp_extract_all(f"`{text_col}`", F.lit(WORD), F.lit(0)).alias("words"))
    return mix.join(words, "doc_id").select("slot", "at", "doc_id", F.array_join(F.slice(
        "words", (F.col("start") + 1).cast("int"), F.col("length").cast("int")), " ").alias("text"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, DataFrame, DataFrame]:
    """The mix's pieces, the measured rows and the sources."""
    sized = measured(docs, id_col, text_col, source_col)
    sources = targets(sized)
    return pieces(sized, sources), sized, sources


def taken(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, size, source_size, target, taken), a row for each input row.

    Null and empty texts have size 0 and are never taken; null sources are one source, the last. Each source's taken words are
    its target to the nearest word. The order depends on ids and texts alone, so reruns and other partitions agree; rows with
    the same id and text may stand for each other. No rows, or no words: nothing is taken. Other columns are ignored.
    """
    parts, sized, sources = mix(docs, id_col, text_col, source_col)
    got = parts.groupBy("row").agg(F.sum("length").alias("taken"))
    of = sources.select(F.col("source").alias("of"), "source_size", "target")
    return sized.join(got, "row", "left").join(of, F.col("source").eqNullSafe(F.col("of"))) \
        .select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))


ORACLE = rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS size,
                  md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')) AS key FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [3, 1, 2][(row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1] AS w
      FROM d GROUP BY source),
f AS (SELECT *, 2 * source_size AS lim, CAST(2 * source_size AS DOUBLE) / CAST(w AS DOUBLE) AS full_at FROM s),
v AS (SELECT a.full_at, CAST(3 * (SELECT sum(source_size) FROM f) - 2 * coalesce(sum(b.lim) FILTER (b.full_at < a.full_at), 0) AS BIGINT) AS top,
             CAST(2 * sum(b.w) FILTER (b.full_at >= a.full_at) AS BIGINT) AS bottom FROM f a, f b GROUP BY a.source, a.full_at),
l AS (SELECT top, bottom FROM v WHERE CAST(top AS DOUBLE) / CAST(bottom AS DOUBLE) <= full_at ORDER BY full_at LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN full_at < CAST(top AS DOUBLE) / CAST(bottom AS DOUBLE) THEN CAST(lim AS DOUBLE)
                                  ELSE CAST(w * top AS DOUBLE) / CAST(bottom AS DOUBLE) END AS target FROM f, l),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target, CAST(floor(t.target + 0.5) AS BIGINT) AS need,
             sum(d.size) OVER (PARTITION BY d.source ORDER BY key[1:16], doc_id) - d.size AS a0,
             sum(d.size) OVER (PARTITION BY d.source ORDER BY key[17:32], doc_id) - d.size AS a1
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(greatest(0, least(size, need - a0)) + greatest(0, least(size, need - source_size - a1)) AS BIGINT) AS taken FROM p"""
