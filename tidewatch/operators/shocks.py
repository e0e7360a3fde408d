"""Shock detection: prefilter, shock events, shock windows, shock alerts."""

from __future__ import annotations

from math import gcd

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch import dims
from tidewatch.functions.scoring import shock_risk
from tidewatch.functions.text import contains_any, prefilter_text
from tidewatch.operators.features import clean_mentions, seconds


def has_shock_phrase(phrases=None) -> Column:
    return contains_any(prefilter_text(F.col("headline"), F.col("full_text")),
                        dims.SHOCK_PHRASES if phrases is None else phrases)


def shock_prefilter(news: DataFrame, phrases=None) -> DataFrame:
    """Articles holding a shock phrase."""
    return news.filter(has_shock_phrase(phrases))


def not_shock(news: DataFrame, phrases=None) -> DataFrame:
    """The complement of the prefilter."""
    return news.filter(~F.coalesce(has_shock_phrase(phrases), F.lit(False)))


def prefilter_stats(news: DataFrame, phrases=None) -> DataFrame:
    kept = F.count_if(has_shock_phrase(phrases))
    return (news.agg(F.count("*").alias("total_articles"), kept.alias("shock_articles"))
            .withColumn("filtered_articles", F.col("total_articles") - F.col("shock_articles"))
            .withColumn("filtered_pct", F.when(
                F.col("total_articles") > 0,
                (1.0 - F.col("shock_articles") / F.col("total_articles")) * 100.0)))


def shock_threshold(mentions: DataFrame, threshold: float = -0.5) -> DataFrame:
    return mentions.filter(F.col("sentiment") < threshold)


def _heads(events: DataFrame, bucket: str, keep: int) -> DataFrame:
    """The first ``keep`` headlines per ticker and bucket.

    Spark cuts each group to ``keep`` rows per task before the shuffle, so a hot group stays small.
    """
    order = Window.partitionBy("ticker", bucket).orderBy("event_ts", F.col("news_id").cast("string"))
    return (events.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= keep)
            .select("ticker", bucket,
                    F.struct("event_ts", F.col("news_id").cast("string").alias("news_id"),
                             "headline").alias("head")))


def shock_features(shocks: DataFrame, window: str = "5 minutes", slide: str = "1 minute",
                   headlines: int = 3) -> DataFrame:
    """Count, worst sentiment, risk and first headlines per ticker and sliding window.

    Counts and minima are pre-aggregated per pane with map-side partials, headlines are cut to the
    first few per pane, and only pane rows are spread over the windows.
    """
    pane = f"{gcd(seconds(window), seconds(slide))} seconds"
    events = (clean_mentions(shocks).filter(F.col("headline").isNotNull())
              .withColumn("pane", F.window("event_ts", pane)["start"]))
    counts = events.groupBy("ticker", "pane").agg(F.count("*").alias("n"),
                                                  F.min("sentiment").alias("worst"))
    panes = counts.unionByName(_heads(events, "pane", headlines), allowMissingColumns=True)
    spread = panes.withColumn("window_end", F.window("pane", window, slide)["end"])
    first = F.slice(F.array_sort(F.collect_list("head")), 1, headlines)
    return (spread.groupBy("ticker", "window_end")
            .agg(F.sum("n").cast("int").alias("shock_count_5m"),
                 F.least(F.lit(0.0), F.min("worst")).alias("worst_sentiment_5m"),
                 F.transform(first, lambda h: h["headline"]).alias("shock_headlines"))
            .select("ticker", "window_end", "shock_count_5m", "worst_sentiment_5m",
                    shock_risk(F.col("shock_count_5m")).alias("risk_score_5m"),
                    "shock_headlines"))


def first_headlines(shocks: DataFrame, window: str = "5 minutes", keep: int = 3) -> DataFrame:
    """First headlines per ticker and tumbling window, one row each with its position."""
    events = shocks.withColumn("window_end", F.window("event_ts", window)["end"])
    order = Window.partitionBy("ticker", "window_end").orderBy(
        "event_ts", F.col("news_id").cast("string"))
    return (events.withColumn("position", F.row_number().over(order))
            .filter(F.col("position") <= keep)
            .select("ticker", "window_end", "position", "news_id", "headline"))


def shock_alert_filter(features: DataFrame, min_count: int = 3) -> DataFrame:
    return (features.filter(F.col("shock_count_5m") >= min_count)
            .select("ticker", "shock_count_5m", "risk_score_5m", "worst_sentiment_5m",
                    "shock_headlines", "window_end"))
