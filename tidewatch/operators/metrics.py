"""Operational counts and latency figures."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch import dims
from tidewatch.operators.ordered import ordered_scan, split_sorted
from tidewatch.sources.tables import staged


def mentions_by_ticker(mentions: DataFrame) -> DataFrame:
    return mentions.groupBy("ticker").agg(F.count("*").alias("mentions"))


def distinct_tickers(mentions: DataFrame) -> DataFrame:
    return mentions.select("ticker").filter(F.col("ticker").isNotNull()).distinct()


def outcomes(checked: DataFrame, ok: Column) -> DataFrame:
    outcome = F.when(ok, "success").otherwise("error")
    return checked.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("requests"))


def cumulative_histogram(df: DataFrame, value: str, buckets=None) -> DataFrame:
    """(le, observations, total, count): cumulative counts per bucket bound and for ``+Inf``."""
    bounds = dims.ENRICH_BUCKETS if buckets is None else buckets
    v = F.col(value)
    sums = df.agg(*[F.count_if(v <= b).alias(f"b{i}") for i, b in enumerate(bounds)],
                  F.coalesce(F.sum(v), F.lit(0.0)).alias("total"), F.count(v).alias("count"))
    labels = [f"{b}" for b in bounds] + ["+Inf"]
    rows = F.array(*[F.struct(F.lit(label).alias("le"), F.col(f"b{i}" if i < len(bounds) else
                                                              "count").alias("observations"))
                     for i, label in enumerate(labels)])
    return (sums.select(F.explode(rows).alias("r"), "total", "count")
            .select("r.le", "r.observations", "total", "count"))


def batch_summary(articles: DataFrame, batch: str = "batch_id") -> DataFrame:
    """Articles, mentions and time span per batch (articles carry ``companies``)."""
    return articles.groupBy(batch).agg(
        F.count("*").alias("articles"), F.sum(F.size("companies")).alias("mentions"))


def enrichment_stats(enriched: DataFrame, slow: Column, batch: str = "batch_id") -> DataFrame:
    """Counters over mention rows: one row per (article, company), company null if none."""
    mention = F.col("ticker").isNotNull()
    stats = enriched.agg(
        F.countDistinct("news_id").alias("total_requests"),
        F.countDistinct(batch).alias("batch_requests"),
        F.count_if(mention & ~slow).alias("fast_path_count"),
        F.count_if(mention & slow).alias("slow_path_count"),
        F.count("ticker").alias("total_companies_detected"),
        F.countDistinct("ticker").alias("distinct_companies"))
    scored = F.col("fast_path_count") + F.col("slow_path_count")
    return stats.withColumns({
        "fast_path_percentage": F.concat(F.format_string("%.1f", F.when(
            scored > 0, F.col("fast_path_count") / scored * 100.0).otherwise(F.lit(0.0))),
            F.lit("%")),
        "total_companies": F.lit(len(dims.COMPANIES)),
        "total_keywords": F.lit(len(dims.keyword_rows())),
        "supply_chain_categories": F.lit(len(dims.CATEGORIES))})


def ranked(df: DataFrame, key: str, value: str) -> DataFrame:
    """Adds ``rank``: the 0-based position of the value among its key's values, in order.

    A global sort cut into pieces, so neither a hot key nor a single global group meets one task.
    """
    def count(parts: list[pd.DataFrame]) -> dict:
        return {"n": sum(len(p) for p in parts)}

    def advance(state: dict | None, s: dict) -> dict:
        return {"seen": int((state["seen"] if state else 0) + s["n"])}

    def emit(rows: pd.DataFrame, state: dict | None) -> tuple[pd.DataFrame, dict]:
        start = int(state["seen"]) if state else 0
        out = pd.DataFrame({key: rows[key].to_numpy(), value: rows[value].to_numpy(),
                            "rank": np.arange(start, start + len(rows))})
        return out, {"seen": start + len(rows)}

    rows = df.select(F.col(key).cast("string").alias(key), F.col(value).cast("double").alias(value))
    # equal values may be the bulk of the rows; the salt lets the cuts fall among them
    rows = rows.filter(F.col(value).isNotNull()).withColumn("_salt", F.rand(7))
    return ordered_scan(
        split_sorted(rows, [key], [value, "_salt"]), key,
        summary_columns=[value], summary_schema="n long", state_schema="seen long",
        summarize=count, advance=advance, emit=emit,
        output_schema=f"{key} string, {value} double, rank long")


MOST_KEYS = 1_000  # keys with more than this part of all rows are fewer than this many
LEAST = 10_000  # rows that may be ordered in one task anyhow
SKETCH = 2_000  # items of a sketch; a rank is then off by about half a per cent at most
MARGIN = 0.005
GRID = 200


def _narrowed(rows: DataFrame, brackets: DataFrame) -> DataFrame:
    """Counts the rows below and inside each bracket and takes the narrower bracket that a sketch of
    the inside suggests; where that one misses the rank, the side of the old one that holds it.

    Brackets (key, which, rank, lo, hi, tried_lo, tried_hi) are few, so they are broadcast; only
    counts and sketches are shuffled.
    """
    v = F.col("value")
    tried = (v >= F.col("tried_lo")) & (v <= F.col("tried_hi"))
    counted = (rows.join(F.broadcast(brackets), "key")
               .groupBy("key", "which", "rank", "lo", "hi", "tried_lo", "tried_hi")
               .agg(F.count_if(v < F.col("tried_lo")).alias("below"), F.count_if(tried).alias("inside"),
                    F.kll_sketch_agg_double(F.when(tried, v), F.lit(SKETCH)).alias("sketch")))
    place = (F.col("rank") - F.col("below") + 0.5) / F.col("inside")
    missed_low, missed_high = F.col("rank") < F.col("below"), F.col("rank") >= F.col("below") + F.col("inside")
    lo = F.when(missed_low, F.col("lo")).when(missed_high, F.col("tried_hi")).otherwise(F.col("tried_lo"))
    hi = F.when(missed_low, F.col("tried_lo")).when(missed_high, F.col("hi")).otherwise(F.col("tried_hi"))

    # a sketch is asked for fixed quantiles; the bracket ends at those around the rank
    quantiles = F.kll_sketch_get_quantile_double("sketch", F.array(*[F.lit(k / GRID) for k in range(GRID + 1)]))
    counted = counted.withColumn("quantiles", quantiles)

    def guess(at: Column, otherwise: Column) -> Column:
        sure = F.when(missed_low | missed_high | (F.col("inside") == 0), otherwise)
        place = F.greatest(F.lit(0), F.least(F.lit(GRID), at.cast("int")))
        return sure.otherwise(F.element_at("quantiles", place + 1))

    return counted.select(
        "key", "which", "rank", lo.alias("lo"), hi.alias("hi"), guess(F.floor((place - MARGIN) * GRID), lo).alias("tried_lo"),
        guess(F.ceil((place + MARGIN) * GRID), hi).alias("tried_hi"),
        F.when(missed_low | missed_high, None).otherwise(F.col("inside")).alias("inside"))


def _picked(rows: DataFrame, brackets: DataFrame) -> DataFrame:
    """key, which, value at the rank: exact counts of the values inside each bracket."""
    v = F.col("value")
    held = rows.join(brackets, "key").filter(v <= F.col("hi"))
    values = held.groupBy("key", "which", "rank", F.when(v >= F.col("lo"), v).alias("value")).agg(
        F.count("*").alias("n"))
    so_far = Window.partitionBy("key", "which").orderBy(F.col("value").asc_nulls_first()).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    return (values.withColumn("upto", F.sum("n").over(so_far))
            .filter((F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("n")))
            .select("key", "which", "value"))


def latency_summary(df: DataFrame, key: str, value: str) -> DataFrame:
    """Exact count, min, mean, median, p95, p99 and max per key; pXX = sorted[int(n * XX/100)].

    Nothing is sorted as a whole. A sketch brackets each rank and the rows inside the bracket are
    counted by value. For a key with more than a thousandth of all rows (there are fewer than a
    thousand such keys) brackets are narrowed by passes over the rows until they hold no more than
    that part; each pass leaves about a fiftieth. Rows without a value are left out; a null key is a
    key. NaN counts as the largest value.
    """
    rows = df.select(F.struct(F.col(key).cast("string").alias("k")).alias("key"),
                     F.col(value).cast("double").alias("value")).filter(F.col("value").isNotNull())
    totals = staged(rows.groupBy("key").agg(
        F.count("*").alias("n"), F.min("value").alias("min_value"), F.avg("value").alias("avg_value"),
        F.max("value").alias("max_value")), "totals")
    most = max(LEAST, (totals.agg(F.sum("n")).first()[0] or 0) // MOST_KEYS)
    n = F.col("n")
    ranks = [F.floor((n - 1) / 2), F.floor(n / 2), F.floor(n * 0.95), F.floor(n * 0.99)]
    wanted = totals.select("key", "n", F.posexplode(F.array(*[r.cast("long") for r in ranks])).alias("which", "rank"),
                           *[F.col(c).alias(a) for a, c in (("lo", "min_value"), ("hi", "max_value"),
                                                            ("tried_lo", "min_value"), ("tried_hi", "max_value"))])
    hot = wanted.filter(n > most).drop("n")
    if totals.filter(n > most).limit(1).count():
        last = None
        while True:
            hot = staged(_narrowed(rows, hot), "brackets")
            wide = hot.filter((F.col("lo") < F.col("hi")) & (F.coalesce(F.col("inside"), F.lit(most + 1)) > most))
            left = wide.agg(F.count("*"), F.sum("inside")).first()
            if not left[0] or tuple(left) == last:  # ties hold what cannot be narrowed
                break
            last = tuple(left)
            hot = hot.drop("inside")
    bracket = ["key", "which", "rank", "lo", "hi"]
    light = rows.join(F.broadcast(hot.select("key").distinct()), "key", "left_anti")
    picked = _picked(light, wanted.filter(n <= most).select(*bracket)).unionByName(
        _picked(rows, F.broadcast(hot.select(*bracket))))

    def at(k: int) -> Column:
        return F.max(F.when(F.col("which") == k, F.col("value")))

    return (totals.join(picked.groupBy("key").agg(
        ((at(0) + at(1)) / 2.0).alias("median_value"), at(2).alias("p95_value"), at(3).alias("p99_value")), "key")
        .select(F.col("key.k").alias(key), "n", "min_value", "avg_value", "max_value", "median_value",
                "p95_value", "p99_value"))
