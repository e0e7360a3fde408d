"""Company features: windowed and running."""

from __future__ import annotations

from itertools import accumulate
from math import gcd

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.scoring import risk_score, round_half_up
from tidewatch.operators.ordered import (ewm_fold, ewm_partials, fold_partials, ordered_scan,
                                         split_sorted)

_UNITS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}


def seconds(duration: str) -> int:
    """``"5 minutes"`` -> 300."""
    count, unit = duration.split()
    return int(count) * _UNITS[unit.rstrip("s")]


def clean_mentions(mentions: DataFrame) -> DataFrame:
    """Mentions without ticker or sentiment are skipped."""
    return mentions.filter(F.col("ticker").isNotNull() & F.col("sentiment").isNotNull())


def sentiment_counts(mentions: DataFrame, *keys: str | Column) -> DataFrame:
    """Negative and positive mentions per group; zero (either sign) is neutral."""
    return clean_mentions(mentions).groupBy(*keys).agg(
        F.count_if(F.col("sentiment") < 0).cast("int").alias("neg_news_count_5m"),
        F.count_if(F.col("sentiment") > 0).cast("int").alias("pos_news_count_5m"))


def finish_features(df: DataFrame) -> DataFrame:
    """ticker, window_end, neg, pos, ewm -> feature row with rounded score and risk."""
    return (df.select(
        "ticker", "window_end", F.col("neg").cast("int").alias("neg_news_count_5m"),
        F.col("pos").cast("int").alias("pos_news_count_5m"),
        round_half_up(F.col("ewm"), 3).alias("sentiment_score_5m"))
        .withColumn("risk_score_5m", risk_score(F.col("neg_news_count_5m"),
                                                F.col("pos_news_count_5m"),
                                                F.col("sentiment_score_5m"))))


def combine_partials(partials: DataFrame, alpha: float = 0.1, dealt: tuple[str, ...] = ()
                     ) -> DataFrame:
    """Partials keyed by (ticker, window_end) -> feature rows.

    The list per window holds one entry per bucket and piece, not one per mention. ``dealt`` names
    columns that depend on a window alone and by which the rows are shuffled already: grouped by
    these, too, they are not shuffled again.
    """
    parts = F.array_sort(F.collect_list(F.struct("first_ts", "first_id", "n", "first_x", "tail")))
    grouped = partials.groupBy("ticker", "window_end", *dealt).agg(
        parts.alias("parts"), F.sum("neg").alias("neg"), F.sum("pos").alias("pos"))
    return finish_features(grouped.withColumn("ewm", fold_partials(F.col("parts"), alpha)))


def company_features(mentions: DataFrame, window: str = "5 minutes", slide: str = "1 minute",
                     alpha: float = 0.1) -> DataFrame:
    """Counts, exponentially weighted sentiment and risk per ticker and sliding window.

    Mentions are aggregated once per pane (the stretch between two window edges), and the few pane
    rows are spread over the windows holding them, instead of every mention over five windows.
    """
    pane = gcd(seconds(window), seconds(slide))
    partials = ewm_partials(clean_mentions(mentions), pane, alpha)
    spread = partials.withColumn("window_end", F.window("bucket", window, slide)["end"])
    return combine_partials(spread, alpha)


def company_features_tumbling(mentions: DataFrame, window: str = "5 minutes",
                              alpha: float = 0.1) -> DataFrame:
    return company_features(mentions, window, window, alpha)


def company_features_plain(mentions: DataFrame, window: str = "5 minutes",
                           slide: str = "1 minute", alpha: float = 0.1) -> DataFrame:
    """The definition spelled out: every mention in every window, folded in order.

    Kept as the yardstick for tests and benchmarks; it holds a window's mentions in one list.
    """
    xs = F.array_sort(F.collect_list(F.struct("event_ts", F.col("news_id").cast("string"),
                                              "sentiment")))
    spread = clean_mentions(mentions).withColumn("window_end",
                                                 F.window("event_ts", window, slide)["end"])
    grouped = spread.groupBy("ticker", "window_end").agg(
        F.transform(xs, lambda r: r["sentiment"]).alias("xs"),
        F.count_if(F.col("sentiment") < 0).alias("neg"),
        F.count_if(F.col("sentiment") > 0).alias("pos"))
    return finish_features(grouped.withColumn("ewm", ewm_fold(F.col("xs"), alpha)))


def ewm_by_ticker(mentions: DataFrame, alpha: float = 0.1, seed: str = "first") -> DataFrame:
    """Exponentially weighted mean of all mentions of a ticker, in (event_ts, news_id) order."""
    partials = ewm_partials(clean_mentions(mentions), 86400, alpha)
    parts = F.array_sort(F.collect_list(F.struct("first_ts", "first_id", "n", "first_x", "tail")))
    start = F.element_at("parts", 1)["first_x"] if seed == "first" else F.lit(0.0)
    fold = F.aggregate("parts", start,
                       lambda e, p: e * F.pow(F.lit(1.0 - alpha), p["n"]) + p["tail"])
    return (partials.groupBy("ticker").agg(parts.alias("parts"), F.sum("n").alias("n"))
            .select("ticker", "n", fold.alias("ewm")))


def legacy_aliases(features: DataFrame) -> DataFrame:
    """The window fields under their older names, next to the current ones."""
    return features.withColumns({"neg_news_count_24h": F.col("neg_news_count_5m"),
                                 "pos_news_count_24h": F.col("pos_news_count_5m"),
                                 "sentiment_ewm_7d": F.col("sentiment_score_5m")})


def latest_features(features: DataFrame) -> DataFrame:
    """Newest row per ticker."""
    row = F.struct(*features.columns)
    return (features.groupBy("ticker").agg(F.max_by(row, "window_end").alias("r"))
            .select("r.*"))


def simple_features(mentions: DataFrame) -> DataFrame:
    """One feature row per mention, counts 0 or 1."""
    s = F.col("sentiment")
    return mentions.select(
        "news_id", "ticker", F.col("event_ts").alias("window_end"),
        (s < 0).cast("int").alias("neg_news_count_24h"),
        (s > 0).cast("int").alias("pos_news_count_24h"), s.alias("sentiment_ewm_7d"))


def running_features(mentions: DataFrame, alpha: float = 0.1, seed: str = "zero",
                     before: DataFrame | None = None) -> DataFrame:
    """After every mention: the ticker's lifetime counts and exponentially weighted sentiment.

    ``seed``: "zero" starts the mean from 0, "first" from the first value. ``before`` (ticker, neg,
    pos, ewm; one row per ticker) holds what earlier mentions came to; it enters the scan as a row in
    front of its ticker's mentions.
    """
    keep = 1.0 - alpha

    def opening(first) -> dict | None:
        """The state that the front row of a ticker brings, if this is one."""
        return {"ewm": float(first["b_ewm"]), "neg": int(first["b_neg"]), "pos": int(first["b_pos"])} \
            if not np.isnan(first["b_ewm"]) else None

    def stretch(parts: list[pd.DataFrame]) -> dict:
        start = opening(parts[0].iloc[0])
        x = np.concatenate([p["sentiment"].to_numpy() for p in parts])[1 if start else 0:]
        weights = alpha * np.power(keep, np.arange(len(x) - 1, -1, -1))
        base = start or {"ewm": float(x[0]) if seed == "first" else 0.0, "neg": 0, "pos": 0}
        return {"n": len(x), "tail": float(np.dot(x, weights)), "neg": int((x < 0).sum()),
                "pos": int((x > 0).sum()), **{f"b_{k}": v for k, v in base.items()}}

    def advance(state: dict | None, s: dict) -> dict:
        before = state or {k: s[f"b_{k}"] for k in ("ewm", "neg", "pos")}
        return {"ewm": keep ** s["n"] * before["ewm"] + s["tail"],
                "neg": int(before["neg"] + s["neg"]), "pos": int(before["pos"] + s["pos"])}

    def emit(rows: pd.DataFrame, state: dict | None) -> tuple[pd.DataFrame, dict]:
        start = opening(rows.iloc[0])
        rows = rows.iloc[1:] if start else rows
        x = rows["sentiment"].to_numpy()
        before = state or start or {"ewm": float(x[0]) if seed == "first" else 0.0, "neg": 0, "pos": 0}
        ewm = list(accumulate(x.tolist(), lambda e, v: alpha * v + keep * e,
                              initial=before["ewm"]))[1:]
        neg = before["neg"] + np.cumsum(x < 0)
        pos = before["pos"] + np.cumsum(x > 0)
        out = pd.DataFrame({
            "news_id": rows["news_id"].to_numpy(), "ticker": rows["ticker"].to_numpy(),
            "window_end": rows["event_ts"].to_numpy(), "neg_news_count_24h": neg.astype("int32"),
            "pos_news_count_24h": pos.astype("int32"), "sentiment_ewm_7d": ewm})
        return out, {"ewm": ewm[-1], "neg": int(neg[-1]), "pos": int(pos[-1])} if len(x) else before

    rows = clean_mentions(mentions).select(
        "ticker", "event_ts", F.col("news_id").cast("string").alias("news_id"),
        F.col("sentiment").cast("double").alias("sentiment"),
        *[F.lit(None).cast("double").alias(f"b_{k}") for k in ("ewm", "neg", "pos")])
    if before is not None:  # null times sort first
        rows = rows.unionByName(before.where(F.col("ewm").isNotNull()).select(
            "ticker", F.lit(None).cast("timestamp").alias("event_ts"),
            F.lit(None).cast("string").alias("news_id"), F.lit(0.0).alias("sentiment"),
            *[F.col(k).cast("double").alias(f"b_{k}") for k in ("ewm", "neg", "pos")]))
    return ordered_scan(
        split_sorted(rows, ["ticker"], ["event_ts", "news_id"]), "ticker",
        summary_columns=["sentiment", "b_ewm", "b_neg", "b_pos"],
        summary_schema="n long, tail double, neg long, pos long, b_ewm double, b_neg long, b_pos long",
        state_schema="ewm double, neg long, pos long",
        summarize=stretch, advance=advance, emit=emit,
        output_schema="news_id string, ticker string, window_end timestamp, "
                      "neg_news_count_24h int, pos_news_count_24h int, sentiment_ewm_7d double")
