"""How five document filters interact, audited over every order of applying them.

A document fails filter A with fewer than 100 words, B if fewer than 80 % of its words are distinct,
C if more than 10 % of its characters are A-Z, D if it holds one of ``#$%&*|``, and E if its text is
that of a document with a smaller id. What a document fails does not depend on the order, so a part
of the table is no more than its counts per set of failed filters (32 cells). A recursive query
extends prefixes of filters by one unused letter a level; it carries the bits of the applied filters
and meets every cell, so that each level gives that step's figures. Prefixes that orders share are
worked out once.

Texts: null counts as empty. Parts: the values of ``lang``, null as the empty string. A null id is
never a copy and makes none. Rows that share the smallest id of a text are no copies of each other.
Labels: an id counts as good or toxic if any of its label rows says so. An empty table has no parts
and gives no rows. Very long texts are read once and leave their row as a hash and a few bits.
Columns beyond those named are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.text import bind
from tidewatch.llm.common import UPPER, core, join_by_size
from tidewatch.sources.tables import staged

FILTERS = "ABCDE"
WORD = r"[^\x20\x09-\x0D]+"
MIN_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT = 100, 80, 10


def text_failures(text: Column) -> Column:
    """The bits of the filters that a text fails by itself, A lowest."""
    capitals = F.length(text) - F.length(F.translate(text, UPPER, ""))
    words = bind(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda w: F.struct(
        F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("distinct")))
    return bind(words, lambda w: (
        F.when(w["n"] < MIN_WORDS, 1).otherwise(0)
        + F.when(w["distinct"].cast("long") * 100 < w["n"].cast("long") * DISTINCT_PERCENT, 2).otherwise(0)
        + F.when(capitals.cast("long") * 100 > F.length(text).cast("long") * CAPITAL_PERCENT, 4).otherwise(0)
        + F.when(text.rlike(r"[#$%&*|]"), 8).otherwise(0)))


def failures(docs: DataFrame) -> DataFrame:
    """doc_id, part and the bits of all failed filters of every row."""
    text = F.coalesce("text", F.lit(""))
    rows = staged(core(docs, "doc_id", "text", "lang").select(
        "doc_id", F.coalesce("lang", F.lit("")).alias("part"), text_failures(text).alias("fails"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest")), "failures")
    copies = (rows.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n"))
              .where(F.col("n") > 1))
    copy = F.coalesce(F.col("doc_id") > F.col("first_id"), F.lit(False))
    return join_by_size(rows, copies, "digest", "n").select(
        "doc_id", "part", (F.col("fails") + F.when(copy, 16).otherwise(0)).alias("fails"))


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents, good and toxic ones per part and set of failed filters: part, mask, n, good, toxic."""
    rows = staged(failures(docs), "failed")
    told = (core(labels, "doc_id", "quality", "toxic").groupBy("doc_id")
            .agg(F.max(F.when(F.col("quality") == 1, 1)).alias("good"),
                 F.max(F.when(F.col("toxic") == 1, 1)).alias("bad"))
            .where(F.col("good").isNotNull() | F.col("bad").isNotNull())
            .join(rows.groupBy("doc_id").agg(F.count("*").alias("n")), "doc_id"))
    return (join_by_size(rows, told, "doc_id", "n")
            .groupBy("part", F.col("fails").alias("mask"))
            .agg(F.count("*").alias("n"), F.count("good").alias("good"), F.count("bad").alias("toxic")))


# a level holds at most 120 prefixes for each of at most 32 masks, whatever the table
LEVELS = """
WITH RECURSIVE levels(prefix, step, letter, bit, applied, mask) AS (
  SELECT '', 0, '', 0, 0, mask FROM {masks}
  UNION ALL
  SELECT concat(l.prefix, f.letter), l.step + 1, f.letter, f.bit, l.applied | f.bit, l.mask
  FROM levels l JOIN {filters} f ON (l.applied & f.bit) = 0)
SELECT prefix, step, letter, bit, applied, applied - bit AS earlier, mask FROM levels WHERE step > 0
"""


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the five filters and step: kept, removed, redundant, unique_fails,
    good_lost, toxic_lost and shapley (removals of the step's filter, summed over all orders)."""
    spark = docs.sparkSession
    counted = staged(cells(docs, labels), "cells")
    masks = counted.select("mask").distinct()
    filters = spark.createDataFrame([(c, 1 << k) for k, c in enumerate(FILTERS)], "letter string, bit int")
    levels = spark.sql(LEVELS, masks=masks, filters=filters)
    own = F.col("mask").bitwiseAND(F.col("bit")) != 0
    before = F.col("mask").bitwiseAND(F.col("earlier")) != 0

    def total(value: str, condition: Column, name: str) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col(value))), F.lit(0)).cast("long").alias(name)

    steps = staged(counted.join(levels, "mask").groupBy("part", "prefix", "step", "letter").agg(
        total("n", F.col("mask").bitwiseAND(F.col("applied")) == 0, "kept"),
        total("n", own & ~before, "removed"), total("n", own & before, "redundant"),
        total("n", F.col("mask") == F.col("bit"), "unique_fails"),
        total("good", own & ~before, "good_lost"), total("toxic", own & ~before, "toxic_lost")), "steps")
    orders = steps.where(F.col("step") == len(FILTERS)).select("part", F.col("prefix").alias("filter_order"))
    all_orders = Window.partitionBy("part", "letter")
    return (steps.join(orders, "part")
            .where(F.col("filter_order").startswith(F.col("prefix")))
            .withColumn("shapley", F.sum("removed").over(all_orders))
            .select("part", "filter_order", F.col("step").cast("int").alias("step"), "kept", "removed",
                    "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"))


SQL = r"""
WITH RECURSIVE told AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good,
         max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY doc_id),
texts AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
counted AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
         min(doc_id) OVER (PARTITION BY text) AS first_id FROM texts),
failed AS (
  SELECT doc_id, part,
         CASE WHEN len(words) < 100 THEN 1 ELSE 0 END
         + CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 2 ELSE 0 END
         + CASE WHEN 100 * len(regexp_extract_all(text, '[A-Z]')) > 10 * length(text) THEN 4 ELSE 0 END
         + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END
         + CASE WHEN doc_id > first_id THEN 16 ELSE 0 END AS mask
  FROM counted),
cells AS (
  SELECT part, mask, count(*) AS n, count(*) FILTER (good = 1) AS good, count(*) FILTER (bad = 1) AS toxic
  FROM failed LEFT JOIN told USING (doc_id) GROUP BY part, mask),
filters AS (SELECT 'ABCDE'[k] AS letter, 1 << (k - 1) AS bit FROM range(1, 6) AS r(k)),
orders AS (
  SELECT letter AS filter_order, bit AS applied, [bit] AS bits FROM filters
  UNION ALL
  SELECT filter_order || letter, applied | bit, list_append(bits, bit) FROM orders, filters
  WHERE applied & bit = 0),
steps AS (
  SELECT filter_order, k AS step, bits[k] AS bit, list_sum(bits[1:k - 1])::BIGINT AS earlier
  FROM orders, range(1, 6) AS r(k) WHERE length(filter_order) = 5),
figures AS (
  SELECT part, filter_order, step, bit,
         sum(CASE WHEN mask & (coalesce(earlier, 0) | bit) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
         sum(CASE WHEN mask & bit <> 0 AND mask & coalesce(earlier, 0) = 0 THEN n ELSE 0 END)::BIGINT AS removed,
         sum(CASE WHEN mask & bit <> 0 AND mask & coalesce(earlier, 0) <> 0 THEN n ELSE 0 END)::BIGINT AS redundant,
         sum(CASE WHEN mask = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
         sum(CASE WHEN mask & bit <> 0 AND mask & coalesce(earlier, 0) = 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
         sum(CASE WHEN mask & bit <> 0 AND mask & coalesce(earlier, 0) = 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM cells, steps GROUP BY ALL)
SELECT part, filter_order, step::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost,
       toxic_lost, sum(removed) OVER (PARTITION BY part, bit)::BIGINT AS shapley
FROM figures
"""
