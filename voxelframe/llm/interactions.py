"""How filters interact: every order of five filters over a corpus, by a recursive query over mask cells.

A text fails filters independently of their order, so all a part (source) has to tell is how many of its documents fail
which set of filters: at most 32 cells of counts. A recursive common table expression extends every prefix of an order by
each letter not used yet, joins the part's cells, and carries the bits applied so far; each level of the recursion is one
step, with that step's counts.
"""

from __future__ import annotations

from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelframe.llm.common import settings, staged

WORD = r"[^\x20\x09-\x0D]+"
LETTERS = "ABCDE"   # bit 0 to 4 of a mask; E is set by `cells`, as it depends on other rows
MIN_WORDS = 200
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def own_failures(text: Column, words: Column) -> Column:
    """Bits of the filters A to D that a text fails by itself."""
    bit = lambda k, failed: F.when(failed, 1 << k).otherwise(0)
    n = F.size(words)
    capitals = F.length(text) - F.length(F.translate(text, CAPITALS, ""))
    return (bit(0, n < MIN_WORDS) + bit(1, 100 * F.size(F.array_distinct(words)) < 50 * n)
            + bit(2, 100 * capitals > 2 * F.length(text)) + bit(3, text.rlike(r"[#$%&*|]"))).cast("int")


def _with_labels(facts: DataFrame, labels: DataFrame) -> DataFrame:
    """good, toxic per row, false where a document has no label or no id. Ids that are null skip the join."""
    known = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    some = facts.where("doc_id IS NOT NULL").join(known, "doc_id", "left").withColumns(
        {c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})
    none = facts.where("doc_id IS NULL").withColumns({"good": F.lit(False), "toxic": F.lit(False)})
    return some.unionByName(none)


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, cells): one row for each part with its array of (mask, n, good, toxic), 32 entries at most; staged.

    All copies of a text fail the same of A to D. So copies are counted per (text, part, labels) before anything is compared:
    of a text's rows, those with its smallest id pass E. Neither a text nor an id is ever gathered in one task.
    """
    text = F.col("text")
    read = docs.select("doc_id", "part", "text", F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("words"))
    facts = read.select("doc_id", "part", F.unhex(F.sha2(text, 256)).alias("digest"), own_failures(text, F.col("words")).alias("mask"))
    facts = staged(facts.groupBy("doc_id", "part", "digest", "mask").agg(F.count(F.lit(1)).alias("n")), "facts")
    groups = _with_labels(facts, labels).groupBy("digest", "part", "mask", "good", "toxic").agg(
        F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))), F.lit(0)).alias("no_id"),
        F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("low"))
    # a text has at most four of these rows for each part
    groups = groups.withColumn("first", F.expr("min(low.doc_id) OVER (PARTITION BY digest)"))
    passing = F.col("no_id") + F.when(F.col("low.doc_id") == F.col("first"), F.col("low.n")).otherwise(0)
    both = F.array(F.struct(F.col("mask"), passing.alias("n")),
                   F.struct(F.col("mask").bitwiseOR(16).alias("mask"), (F.col("n") - passing).alias("n")))
    one = groups.select("part", "good", "toxic", F.explode(both).alias("c")).where("c.n > 0")
    per = one.groupBy("part", "c.mask").agg(F.sum("c.n").alias("n"), F.coalesce(F.sum(F.when(F.col("good"), F.col("c.n"))), F.lit(0)).alias("good"),
                                            F.coalesce(F.sum(F.when(F.col("toxic"), F.col("c.n"))), F.lit(0)).alias("toxic"))
    return staged(per.groupBy("part").agg(F.sort_array(F.collect_list(F.struct("mask", "n", "good", "toxic"))).alias("cells")), "cells")


def _counts(applied: str, bit: str) -> str:
    """The step's counts from the array of cells: `applied` the bits of earlier filters, `bit` that of the step's own."""
    total = lambda when, field="n": f"aggregate(c.cells, 0L, (sum, cell) -> sum + if({when}, cell.{field}, 0L))"
    fails, before = f"(cell.mask & {bit}) <> 0", f"(cell.mask & {applied}) <> 0"
    return f"""{total(f"(cell.mask & ({applied} | {bit})) = 0")} AS kept, {total(f"{fails} AND NOT {before}")} AS removed,
      {total(f"{fails} AND {before}")} AS redundant, {total(f"cell.mask = {bit}")} AS unique_fails,
      {total(f"{fails} AND NOT {before}", "good")} AS good_lost, {total(f"{fails} AND NOT {before}", "toxic")} AS toxic_lost"""


def prefixes(parts: DataFrame) -> DataFrame:
    """(part, prefix, step, letter, applied, counts) for each of the 325 prefixes of orders, in each part; staged.

    A level of the recursion has at most 120 rows for each part; no order's rows depend on how many documents there are.
    """
    letters = ", ".join(f"('{c}', {1 << k})" for k, c in enumerate(LETTERS))
    query = f"""WITH RECURSIVE letters AS (SELECT * FROM VALUES {letters} AS t(letter, bit)),
      steps AS (
      SELECT c.part, l.letter AS prefix, 1 AS step, l.letter, l.bit AS applied, {_counts('0', 'l.bit')}
      FROM letters l JOIN {{cells}} c
      UNION ALL
      SELECT s.part, concat(s.prefix, l.letter), s.step + 1, l.letter, s.applied | l.bit, {_counts('s.applied', 'l.bit')}
      FROM steps s JOIN letters l ON (s.applied & l.bit) = 0 JOIN {{cells}} c ON c.part = s.part)
      SELECT * FROM steps"""
    spark = parts.sparkSession
    with settings(spark, spark__sql__cteRecursionRowLimit="-1"):  # the rows grow with the parts; the levels are five
        return staged(spark.sql(query, cells=parts), "prefixes")


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley): each order of the
    filters in each part, step by step.

    Null texts count as empty (they fail A alone, and E after the first); null parts are the part ''. A row without an id has
    no smaller one and is smaller than none: it passes E, and has no labels. Rows that share an id and a text pass or fail E
    alike. Several labels of an id: good or toxic if one of them says so. Other columns are ignored; no rows give no parts.
    """
    docs = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"),
                       F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality", "toxic")
    steps = prefixes(cells(docs, labels))
    share = F.element_at(F.array(*[F.lit(factorial(len(LETTERS) - k)) for k in range(1, 6)]), F.col("step"))  # orders with this prefix
    shapley = steps.groupBy("part", "letter").agg(F.sum(F.col("removed") * share).alias("shapley"))
    orders = steps.where(F.col("step") == len(LETTERS)).select("part", F.col("prefix").alias("filter_order"),
                                                                F.explode(F.sequence(F.lit(1), F.lit(len(LETTERS)))).alias("step"))
    orders = orders.withColumn("prefix", F.expr("substring(filter_order, 1, step)"))
    return orders.join(steps.drop("step", "applied"), ["part", "prefix"]).join(shapley, ["part", "letter"]).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


ORACLE = rf"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws FROM documents),
l AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY 1),
m AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
        (CASE WHEN len(ws) < {MIN_WORDS} THEN 1 ELSE 0 END) + (CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 2 ELSE 0 END)
        + (CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) THEN 4 ELSE 0 END)
        + (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END)
        + (CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END) AS mask
      FROM d LEFT JOIN l USING (doc_id)),
c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m GROUP BY ALL),
f AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS v(x, b)),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM f a, f b, f c, f d, f e WHERE a.b + b.b + c.b + d.b + e.b = 31
      AND len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, k AS step, (SELECT b FROM f WHERE x = filter_order[k]) AS bit,
             (SELECT coalesce(sum(b), 0)::INT FROM f WHERE contains(filter_order[:k - 1], x)) AS applied
      FROM o, range(1, 6) AS r(k)),
r AS (SELECT part, filter_order, step, bit, coalesce(sum(n) FILTER (mask & (applied | bit) = 0), 0) AS kept,
             coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & applied = 0), 0) AS removed,
             coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & applied <> 0), 0) AS redundant,
             coalesce(sum(n) FILTER (mask = bit), 0) AS unique_fails,
             coalesce(sum(good) FILTER (mask & bit <> 0 AND mask & applied = 0), 0) AS good_lost,
             coalesce(sum(toxic) FILTER (mask & bit <> 0 AND mask & applied = 0), 0) AS toxic_lost
      FROM s, c GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
       CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM r"""
