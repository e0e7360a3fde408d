"""Thresholds, cooldown, alert history and statistics."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.dims import local_table
from tidewatch.functions.scoring import alert_message, notification_payload, severity
from tidewatch.operators.ordered import ordered_scan, split_sorted
from tidewatch.operators.shocks import shock_alert_filter

DEFAULT_THRESHOLD = 0.7
COOLDOWN_MINUTES = 30
DELIVERY_ERROR = "Slack notification failed"  # fixed value
NEVER = int(np.iinfo(np.int64).min)  # blocked until then: not at all


def lookup_threshold(df: DataFrame, thresholds: DataFrame | dict[str, float] | None = None,
                     default: float = DEFAULT_THRESHOLD) -> DataFrame:
    """Adds ``threshold``: the ticker's own, or the default.

    ``thresholds`` is a (ticker, threshold) table or a dict; a join strategy is left to Spark.
    """
    if not isinstance(thresholds, DataFrame):
        if not thresholds:
            return df.withColumn("threshold", F.lit(float(default)))
        thresholds = local_table(df.sparkSession, [(t, float(v)) for t, v in thresholds.items()],
                                 "ticker string, threshold double")
    own = thresholds.select("ticker", F.col("threshold").alias("_own"))
    return (df.join(own, "ticker", "left")
            .withColumn("threshold", F.coalesce("_own", F.lit(float(default)))).drop("_own"))


def alert_threshold(features: DataFrame) -> DataFrame:
    """Rows above their threshold (strictly)."""
    return features.filter(F.col("risk_score_5m") > F.col("threshold"))


def in_cooldown(at: Column, last_sent: Column, cooldown_minutes: int = COOLDOWN_MINUTES) -> Column:
    """Is an alert sent at ``last_sent`` still cooling down at ``at``? Expired at exactly the end."""
    age = F.unix_micros(at) - F.unix_micros(last_sent)
    return F.coalesce((age >= 0) & (age < cooldown_minutes * 60_000_000), F.lit(False))


def cooldown_check(features: DataFrame, last_sent: DataFrame, at: str = "window_end",
                   cooldown_minutes: int = COOLDOWN_MINUTES) -> DataFrame:
    """Flags rows whose ticker has an unexpired entry in the last-sent store (ticker, sent_at)."""
    newest = last_sent.groupBy("ticker").agg(F.max("sent_at").alias("last_sent"))
    return (features.join(newest, "ticker", "left")
            .withColumn("in_cooldown", in_cooldown(F.col(at), F.col("last_sent"),
                                                   cooldown_minutes)))


def suppression_reason(cooling: Column) -> Column:
    return F.when(cooling, "cooldown").otherwise("threshold_not_met")


def greedy_cooldown(at: np.ndarray, over: np.ndarray, good: np.ndarray, blocked: int, span: int
                    ) -> tuple[np.ndarray, np.ndarray, int]:
    """Status and reason of one ticker's rows, sorted by time, and the microsecond until which it is
    blocked after them. It costs a step per alert, not per row."""
    cooling = np.zeros(len(at), dtype=bool)
    start = int(np.searchsorted(at, blocked, side="left"))
    cooling[:start] = True
    fires = np.flatnonzero(over & good)
    pos = int(np.searchsorted(fires, start, side="left"))
    while pos < len(fires):
        i = int(fires[pos])
        blocked = int(at[i]) + span
        end = int(np.searchsorted(at, blocked, side="left"))
        cooling[i + 1:end] = True
        pos = int(np.searchsorted(fires, max(end, i + 1), side="left"))
    status = np.where(cooling | ~over, "suppressed", np.where(good, "sent", "failed"))
    reason = np.where(cooling, "cooldown", np.where(over, None, "threshold_not_met"))
    return status, reason, blocked


def alert_decisions(rows: DataFrame, at: str = "window_end", delivered: Column | None = None,
                    cooldown_minutes: int = COOLDOWN_MINUTES, tiebreak: str | None = None
                    ) -> DataFrame:
    """Greedy cooldown per ticker over (ticker, ``at``, risk_score_5m, threshold).

    Adds ``status`` (sent, failed, suppressed) and ``reason`` (cooldown, threshold_not_met). Only a
    delivered alert starts a cooldown. An alert depends on the one before it, so this is an ordered
    scan; a stretch of rows is summed up as a step function from "blocked until" on entry to
    "blocked until" on exit.
    """
    span = cooldown_minutes * 60_000_000
    ok = F.lit(True) if delivered is None else F.coalesce(delivered, F.lit(False))
    columns = [c for c in rows.columns if c not in ("status", "reason")]
    # an alert may be decided on a row only once its time is known
    work = (rows.filter(F.col(at).isNotNull() & F.col("ticker").isNotNull())
            .withColumn("_at", F.unix_micros(F.col(at)))
            .withColumn("_over", F.coalesce(F.col("risk_score_5m") > F.col("threshold"),
                                            F.lit(False)))
            .withColumn("_ok", ok))

    def summarize(parts: list[pd.DataFrame]) -> dict:
        begin = int(parts[0]["_at"].iloc[0])
        fires = np.concatenate([p["_at"].to_numpy()[(p["_over"] & p["_ok"]).to_numpy(dtype=bool)]
                                for p in parts])
        following = np.searchsorted(fires, fires + span, side="left")
        exits = fires + span
        for i in range(len(fires) - 1, -1, -1):
            if following[i] < len(fires):
                exits[i] = exits[following[i]]
        # whoever enters is blocked until begin + span at most, so later entries cannot occur
        reach = int(np.searchsorted(fires, begin + span, side="left")) + 1
        fires, exits = fires[:reach], exits[:reach]
        last_of_step = np.append(exits[1:] != exits[:-1], True) if len(exits) else []
        return {"until": fires[last_of_step].tolist() if len(exits) else [],
                "leaves": exits[last_of_step].tolist() if len(exits) else []}

    def advance(state: dict | None, s: dict) -> dict:
        blocked = state["blocked"] if state else NEVER
        step = int(np.searchsorted(np.asarray(s["until"], dtype=np.int64), blocked, side="left"))
        return {"blocked": int(s["leaves"][step]) if step < len(s["until"]) else int(blocked)}

    def emit(pdf: pd.DataFrame, state: dict | None) -> tuple[pd.DataFrame, dict]:
        blocked = int(state["blocked"]) if state else NEVER
        status, reason, blocked = greedy_cooldown(
            pdf["_at"].to_numpy(), pdf["_over"].to_numpy(dtype=bool), pdf["_ok"].to_numpy(dtype=bool), blocked, span)
        return pdf[columns].assign(status=status, reason=reason), {"blocked": blocked}

    order = [at] if tiebreak is None else [at, tiebreak]
    kinds = {f.name: f.dataType.simpleString() for f in work.schema.fields}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in columns)
    return ordered_scan(
        split_sorted(work, ["ticker"], order), "ticker",
        summary_columns=["_at", "_over", "_ok"],
        summary_schema="until array<long>, leaves array<long>", state_schema="blocked long",
        summarize=summarize, advance=advance, emit=emit,
        output_schema=f"{schema}, status string, reason string")


def evaluate_alerts(features: DataFrame, thresholds: DataFrame | dict[str, float] | None = None,
                    default_threshold: float = DEFAULT_THRESHOLD,
                    cooldown_minutes: int = COOLDOWN_MINUTES, delivered: Column | None = None
                    ) -> DataFrame:
    """Feature rows -> one decision per row; the clock is ``window_end``."""
    rows = lookup_threshold(features, thresholds, default_threshold)
    keep = ["ticker", "window_end", "risk_score_5m", "threshold"]
    if delivered is not None:
        rows = rows.withColumn("_delivered", delivered)
        out = alert_decisions(rows.select(*keep, "_delivered"), delivered=F.col("_delivered"),
                              cooldown_minutes=cooldown_minutes)
        return out.drop("_delivered")
    return alert_decisions(rows.select(*keep), cooldown_minutes=cooldown_minutes)


def shock_alerts(shock_windows: DataFrame, min_count: int = 3,
                 cooldown_minutes: int = COOLDOWN_MINUTES) -> DataFrame:
    """Alerts for windows with enough shocks, under the same cooldown."""
    rows = shock_alert_filter(shock_windows, min_count)
    decided = alert_decisions(rows.withColumn("threshold", F.lit(-1.0)),
                              cooldown_minutes=cooldown_minutes)
    return decided.filter(F.col("status") == "sent").drop("status", "reason", "threshold")


def alert_history(decisions: DataFrame, triggered_at: Column | None = None) -> DataFrame:
    """Decisions as rows of the alert history table."""
    at = F.col("window_end") if triggered_at is None else triggered_at
    sent = F.col("status") == "sent"
    risk = F.col("risk_score_5m")
    return decisions.select(
        "ticker", risk.cast("decimal(6,3)").alias("risk_score"),
        F.col("threshold").cast("decimal(6,3)").alias("threshold"),
        severity(risk).alias("severity"), "window_end", at.alias("triggered_at"),
        sent.alias("notification_sent"), F.when(sent, at).alias("notification_sent_at"),
        F.when(F.col("status") == "failed", F.lit(DELIVERY_ERROR)).alias("notification_error"),
        (F.col("status") == "suppressed").alias("suppressed"),
        F.col("reason").alias("suppression_reason"),
        alert_message(F.col("ticker"), risk).alias("alert_message"))


# fixed values: channel and user name
def outbox(decisions: DataFrame, channel: str = "#supply-chain-alerts", username: str = "RiskBot"
           ) -> DataFrame:
    """Notifications to deliver, one row per fired alert."""
    fired = decisions.filter(F.col("status").isin("sent", "failed"))
    return fired.select(
        "ticker", "window_end", F.lit(channel).alias("channel"), F.lit(username).alias("username"),
        notification_payload(F.col("ticker"), F.col("risk_score_5m"), F.col("threshold"),
                             F.col("window_end"), F.col("window_end")).alias("payload"))


def alert_log_union(sent: DataFrame, suppressed: DataFrame, failed: DataFrame) -> DataFrame:
    """One history from the three outcomes."""
    return sent.unionByName(suppressed).unionByName(failed)


def alert_stats(decisions: DataFrame) -> DataFrame:
    return decisions.groupBy("status", "reason").agg(F.count("*").alias("alerts"))


def recent_alerts(history: DataFrame, limit: int, where: Column | None = None) -> DataFrame:
    """Newest alerts first; a report, so limited. Sort and limit run as one top-k per task."""
    rows = history if where is None else history.filter(where)
    return rows.orderBy(F.col("triggered_at").desc(), "ticker").limit(limit)
