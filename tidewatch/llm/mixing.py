"""Mixing sources to target weights, with repeated epochs.

Documents get a hash-random key. They are range-sorted by source and key; prefix sums of their
sizes, first over whole ranges and then inside each, say how many words of the source stand before a
document. A source whose target is T words repeats all its documents floor(T / size) times and takes
the rest from the front, cut at exactly that word.

Targets share a budget by weight; none exceeds ``max_epochs`` times its source, and what it cannot
take is shared among the others. That is a common level: target = min(level * weight, cap).

The size of a text is its number of words between ASCII white space; nulls count 0. Null sources are
one source, the last. Rows that repeat wholly share a key and are taken one after the other. Sources
without words and empty tables get targets of 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import core, unused
from tidewatch.sources.tables import staged

WEIGHTS = (3, 1, 2)
SOURCE = ["no_source", "src"]


def prefix_sums(df: DataFrame, group: list[str], order: list[str], sums: dict[str, str]
                ) -> DataFrame:
    """Adds, for each ``value: name`` of ``sums``, the sum of the value over all earlier rows of
    the group.

    Rows are range-partitioned by group and order and written, so that a range is the same each time
    it is read. Only one row per range and group is needed to know what stands before a range; inside
    a range a window runs over that range's rows alone. A group of any size spans many ranges.
    """
    ranged = staged(df.repartitionByRange(*group, *order)
                    .withColumn("_range", F.spark_partition_id()), "ranges")
    totals = ranged.groupBy("_range", *group).agg(*[F.sum(v).alias(f"_{n}") for v, n in sums.items()])
    earlier = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_range", *group, *[
        F.coalesce(F.sum(f"_{n}").over(earlier), F.lit(0)).alias(f"_{n}") for n in sums.values()])
    inside = (Window.partitionBy("_range", *group).orderBy(*order)
              .rowsBetween(Window.unboundedPreceding, -1))
    summed = ranged.withColumns({n: F.coalesce(F.sum(v).over(inside), F.lit(0))
                                 for v, n in sums.items()})
    joined = summed.join(offsets, ["_range", *group])
    return joined.withColumns({n: F.col(n) + F.col(f"_{n}") for n in sums.values()}).drop(
        "_range", *[f"_{n}" for n in sums.values()])


def key_of(doc_id: Column, text: Column, seed: int) -> Column:
    """The hash-random key of a row."""
    empty = F.lit("")
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), empty),
                             F.coalesce(text, empty)))


def sized(docs: DataFrame, seed: int) -> DataFrame:
    """Key, source and size of every row, without its text."""
    text = F.coalesce("text", F.lit(""))
    return core(docs, "doc_id", "text", "source").select(
        "doc_id", F.col("source").isNull().alias("no_source"),
        F.coalesce("source", F.lit("")).alias("src"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("size"),
        key_of(F.col("doc_id"), F.col("text"), seed).alias("key"))


def targets(sizes: DataFrame, share: float, weights: tuple[int, ...], max_epochs: int) -> DataFrame:
    """Target of every source: no_source, src, source_size, target.

    Sorted by cap / weight, a source is capped if the level that its predecessors' caps leave exceeds
    its own cap / weight; the first one that is not fixes the level. Three numbers reach the driver.
    """
    sources = prefix_sums(sizes.withColumn("one", F.lit(1)), [], SOURCE, {"one": "rank"})
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]),
                          (F.col("rank") % len(weights) + 1).cast("int"))
    sources = (sources.drop("one").withColumns({"weight": weight.cast("long"),
                                                "cap": F.col("source_size") * max_epochs})
               .withColumn("ratio", F.col("cap").cast("double") / F.col("weight")))
    sources = prefix_sums(sources, [], ["ratio", *SOURCE], {"cap": "caps", "weight": "weights"})
    sources = staged(sources, "sources")
    total, weight_sum = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    level = ((F.lit(share * (total or 0)) - F.col("caps").cast("double"))
             / (F.lit(weight_sum) - F.col("weights")))
    sources = sources.withColumn("level", level)
    common = sources.where(F.col("level") <= F.col("ratio")).agg(
        F.min_by("level", F.struct("ratio", *SOURCE))).first()[0]
    capped = F.lit(True) if common is None else F.col("level") > F.col("ratio")
    return sources.select(*SOURCE, "source_size", F.when(capped, F.col("cap").cast("double"))
                          .otherwise(F.lit(common or 0.0) * F.col("weight")).alias("target"))


def portions(docs: DataFrame, share: float, weights: tuple[int, ...], max_epochs: int, seed: int
             ) -> DataFrame:
    """key, doc_id, size, source_size, target and taken of every row."""
    rows = staged(sized(docs, seed), "sizes")
    sizes = rows.groupBy(*SOURCE).agg(F.sum("size").alias("source_size"))
    goal = targets(sizes, share, weights, max_epochs)
    placed = prefix_sums(rows, SOURCE, ["key", "doc_id", "size"], {"size": "before"})
    budget = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0,
                    F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    rest = budget - epochs * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("before")))
    return placed.join(goal, SOURCE).select(
        "key", "doc_id", "size", "source_size", "target",
        (epochs * F.col("size") + part).cast("long").alias("taken"))


def mixed(docs: DataFrame, share: float = 1.5, weights: tuple[int, ...] = WEIGHTS,
          max_epochs: int = 2, seed: int = 7) -> DataFrame:
    """doc_id, size, source_size, target and taken (words, repeats counted) of every row."""
    return portions(docs, share, weights, max_epochs, seed).drop("key")


def with_portions(docs: DataFrame, share: float = 1.5, weights: tuple[int, ...] = WEIGHTS,
                  max_epochs: int = 2, seed: int = 7) -> DataFrame:
    """The rows of ``docs`` that the mix takes words of, all columns, with size, source_size, target
    and taken; where ``docs`` has such a name already, the new one gets an underscore.

    Rows that repeat an id and its text carry the largest portion of them.
    """
    names, key = ["size", "source_size", "target", "taken"], unused(docs, "_key")
    took = (portions(docs, share, weights, max_epochs, seed).where(F.col("taken") > 0)
            .groupBy("key").agg(F.max(F.struct("taken", *names[:3])).alias("m"))
            .select(F.col("key").alias(key), *[F.col(f"m.{n}").alias(unused(docs, n))
                                                  for n in names]))
    return docs.join(took, key_of(docs["doc_id"], docs["text"], seed) == took[key]).drop(key)


SQL = r"""
WITH sized AS (
  SELECT doc_id, source IS NULL AS no_source, coalesce(source, '') AS src,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('7:' || coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')) AS key
  FROM documents),
sources AS (
  SELECT no_source, src, sum(size)::BIGINT AS source_size FROM sized GROUP BY ALL),
weighed AS (
  SELECT *, source_size * 2 AS cap, [3, 1, 2][
      (row_number() OVER (ORDER BY no_source, src COLLATE "binary") - 1) % 3 + 1]::BIGINT AS weight
  FROM sources),
ratios AS (SELECT *, cap::DOUBLE / weight AS ratio FROM weighed),
levels AS (
  SELECT *, ((1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE)
             - coalesce(sum(cap) OVER before, 0)::DOUBLE)
            / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0))::DOUBLE AS level
  FROM ratios WINDOW before AS (ORDER BY ratio, no_source, src COLLATE "binary"
                                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
goals AS (
  SELECT no_source, src, source_size, CASE WHEN level > ratio THEN cap::DOUBLE ELSE
    (SELECT arg_min(level, ratio) FROM levels WHERE level <= ratio) * weight END AS target
  FROM levels),
placed AS (
  SELECT s.*, g.source_size, g.target, floor(g.target)::BIGINT AS budget,
         coalesce(sum(size) OVER (PARTITION BY s.no_source, s.src ORDER BY key, doc_id, size
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS earlier
  FROM sized s JOIN goals g ON s.no_source = g.no_source AND s.src = g.src),
cut AS (
  SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM placed)
SELECT doc_id, size, source_size, target,
       (epochs * size + greatest(0, least(size, budget - epochs * source_size - earlier)))::BIGINT
         AS taken
FROM cut
"""
