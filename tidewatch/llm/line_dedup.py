"""Removal of boilerplate lines by the number of distinct sites they are found on.

A HyperLogLog sketch of the sites of every line is built per line hash; partial sketches merge in
the aggregation, so a line that a third of all documents share is one small sketch per task. Lines
whose estimate is too near the threshold to decide are counted exactly. Lines on enough sites are
boilerplate: their first occurrence, by doc_id and place, stays, every other one is removed.

Lines are compared without surrounding spaces; blank lines are never removed. A null source is no
site. Null texts stay null with no lines. Rows that repeat wholly keep and lose the same lines. An
empty table gives an empty result. DataFrame functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.text import bind
from tidewatch.llm.common import core, join_by_size, unused
from tidewatch.sources.tables import staged

MIN_SITES = 3
SKETCH_BITS = 10
LINE = ["h1", "h2"]  # two 64-bit hashes name a line


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_table(docs: DataFrame) -> DataFrame:
    """Hashes of all lines that are not blank, without their texts.

    The text is hashed in a step before its lines are spread, or it would be hashed once for each.
    """
    line = F.trim(F.col("line"))
    return (core(docs, "doc_id", "text", "source").where(F.col("text").isNotNull())
            .withColumn("text_hash", F.xxhash64("text"))
            .select("doc_id", "source", "text_hash", F.posexplode(lines_of(F.col("text"))).alias("pos", "line"))
            .where(line != "")
            .select("doc_id", "text_hash", "pos", "source", F.xxhash64(line).alias("h1"),
                    F.xxhash64(F.lit(7), line).alias("h2")))


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES, bits: int = SKETCH_BITS) -> DataFrame:
    """Hashes, number of places (n) and first occurrence of the lines found on ``min_sites`` sites or
    more.

    The standard error of a sketch is 1.04 / sqrt(2 ** bits); within five of them, and one site, of
    the threshold the distinct sites are counted exactly.
    """
    margin = 5 * 1.04 / math.sqrt(2 ** bits) * min_sites + 1
    spread = (lines.groupBy(*LINE)
              .agg(F.hll_sketch_agg(F.coalesce("source", F.lit("")), F.lit(bits)).alias("sketch"),
                   F.min(F.struct("doc_id", "text_hash", "pos")).alias("first"), F.count("*").alias("n"))
              .select(*LINE, "n", "first", F.hll_sketch_estimate("sketch").alias("sites"))
              .where(F.col("sites") >= min_sites - margin))
    spread = staged(spread, "line-sites")
    near = F.col("sites") <= min_sites + margin
    exact = (join_by_size(lines, spread.where(near).select(*LINE, "n"), LINE, "n", "inner")
             .where(F.col("source").isNotNull())
             .select(*LINE, "source").distinct()
             .groupBy(*LINE).count().where(F.col("count") >= min_sites))
    return (spread.where(~near).select(*LINE, "n", "first")
            .unionByName(spread.where(near).join(exact, LINE, "left_semi").select(*LINE, "n", "first")))


def remove_boilerplate(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """``docs`` with boilerplate lines taken out of ``text``, all other columns as they are, and the
    counts ``n_lines`` and ``n_removed``.

    Only hashes and places are shuffled by line; the texts are shuffled once, by document.
    """
    lines = staged(line_table(docs), "lines")
    found = staged(boilerplate(lines, min_sites), "boilerplate")
    again = (join_by_size(lines, found, LINE, "n", "inner")
             .where(~F.struct("doc_id", "text_hash", "pos").eqNullSafe(F.col("first")))
             .groupBy("doc_id", "text_hash").agg(F.collect_set("pos").alias("gone")))
    d, h, g = (unused(docs, c) for c in ("_doc", "_hash", "_gone"))
    again = again.toDF(d, h, g)
    row = docs.withColumn(unused(docs, "_own"), F.xxhash64(docs["text"]))
    own = row[row.columns[-1]]
    joined = row.join(again, (own == again[h]) & row["doc_id"].eqNullSafe(again[d]), "left")
    n = F.coalesce(F.size(lines_of(row["text"])), F.lit(0))

    def without(parts: Column) -> Column:
        kept = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), again[g])
        return F.array_join(F.transform(kept, lambda p: F.element_at(parts, p + 1)), "\n")

    # the text is split once, not once for every line that stays
    text = F.when(again[g].isNull(), row["text"]).otherwise(bind(lines_of(row["text"]), without))
    others = [text.alias(c) if c == "text" else row[c] for c in docs.columns]
    return joined.select(*others,
                         F.when(row["text"].isNull(), 0).otherwise(n).cast("long")
                         .alias(unused(docs, "n_lines")),
                         F.coalesce(F.size(again[g]), F.lit(0)).cast("long")
                         .alias(unused(docs, "n_removed")))


def cleaned(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """``docs`` with the same columns, boilerplate lines taken out and n_chars, if there, counted anew."""
    out = remove_boilerplate(docs, min_sites)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def line_dedup(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """doc_id, n_lines, n_removed and the cleaned text of every row."""
    return remove_boilerplate(core(docs, "doc_id", "text", "source"), min_sites).select(
        "doc_id", "n_lines", "n_removed", "text")


SQL = f"""
WITH split AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line,
         unnest(range(len(string_split(text, chr(10))))) AS pos
  FROM documents WHERE text IS NOT NULL),
keyed AS (SELECT *, trim(line, ' ') AS k FROM split),
boiler AS (
  SELECT k FROM keyed WHERE k <> '' GROUP BY k HAVING count(DISTINCT source) >= {MIN_SITES}),
marked AS (
  SELECT keyed.*, boiler.k IS NOT NULL
         AND row_number() OVER (PARTITION BY keyed.k ORDER BY doc_id NULLS FIRST, pos) > 1 AS gone
  FROM keyed LEFT JOIN boiler ON keyed.k = boiler.k),
joined AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed,
         coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text
  FROM marked GROUP BY doc_id)
SELECT d.doc_id, coalesce(j.n_lines, 0) AS n_lines, coalesce(j.n_removed, 0) AS n_removed, j.text
FROM documents d LEFT JOIN joined j ON d.doc_id = j.doc_id
"""
