"""Queries: thresholds, cooldown, alert history, outbox and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.codecs import last_sent_key
from tidewatch.operators import alerts
from tidewatch.plans import sqlparts as S
from tidewatch.plans import views as V
from tidewatch.plans.catalog import query
from tidewatch.plans.ingest_queries import SHOCK_WINDOWS, shock_windows
from tidewatch.plans.views import Tables
from tidewatch.sources.tables import staged

FEATURES = V.FEATURES_CTE.replace("WITH ", "WITH RECURSIVE ", 1)
OWN = S.values(list(V.THRESHOLDS.items()), "ticker, own", "own")
RATED = f"""{FEATURES}, {OWN},
rated AS (SELECT ticker, window_end, risk_score_5m, coalesce(own, 0.7::DOUBLE) AS threshold FROM features LEFT JOIN own USING (ticker))"""
# delivery of some alerts fails, by rule
DELIVERED_SQL = "(CAST(epoch(s.window_end) AS BIGINT) // 60 % 4 <> 1)"
DECIDED = f"{RATED},\n{S.cooldown('rated', ok=DELIVERED_SQL)}"


def rated(t: Tables) -> DataFrame:
    return alerts.lookup_threshold(V.company_windows(t), V.THRESHOLDS)


def decided(t: Tables) -> DataFrame:
    delivered = F.floor(F.unix_seconds("window_end") / 60) % 4 != 1
    return alerts.evaluate_alerts(V.company_windows(t), V.THRESHOLDS, delivered=delivered)


@query("lookup_threshold", f"{RATED} SELECT ticker, window_end, threshold FROM rated")
def lookup_threshold(t: Tables) -> DataFrame:
    return rated(t).select("ticker", "window_end", "threshold")


@query("alert_threshold", f"{RATED} SELECT ticker, window_end, risk_score_5m FROM rated WHERE risk_score_5m > threshold")
def alert_threshold(t: Tables) -> DataFrame:
    return alerts.alert_threshold(rated(t)).select("ticker", "window_end", "risk_score_5m")


@query("alert_cooldown", f"{DECIDED} SELECT ticker, window_end, risk_score_5m, threshold, status, reason FROM decided")
def alert_cooldown(t: Tables) -> DataFrame:
    return decided(t)


@query("alert_cooldown_default", f"""{FEATURES},
rated AS (SELECT ticker, window_end, risk_score_5m, 0.7::DOUBLE AS threshold FROM features),
{S.cooldown('rated')} SELECT ticker, window_end, risk_score_5m, threshold, status, reason FROM decided""")
def alert_cooldown_default(t: Tables) -> DataFrame:
    return alerts.evaluate_alerts(V.company_windows(t))


@query("cooldown_check", f"""{RATED},
sent AS (SELECT ticker, max(window_end) AS sent_at FROM rated WHERE risk_score_5m > 0.85 AND window_end < TIMESTAMP '2024-01-01 01:00:00' GROUP BY ticker)
SELECT r.ticker, r.window_end, coalesce(r.window_end >= sent_at AND r.window_end < sent_at + INTERVAL 30 MINUTE, FALSE) AS in_cooldown
FROM rated r LEFT JOIN sent USING (ticker)""")
def cooldown_check(t: Tables) -> DataFrame:
    rows = rated(t)
    sent = (rows.filter((F.col("risk_score_5m") > 0.85)
                        & (F.col("window_end") < F.lit("2024-01-01 01:00:00").cast("timestamp")))
            .select("ticker", F.col("window_end").alias("sent_at")))
    return alerts.cooldown_check(rows, sent).select("ticker", "window_end", "in_cooldown")


@query("shock_alerts", f"""{SHOCK_WINDOWS.replace("WITH ", "WITH RECURSIVE ", 1)},
enough AS (SELECT *, -1.0::DOUBLE AS threshold FROM shock_windows WHERE shock_count_5m >= 3),
{S.cooldown("enough")}
SELECT ticker, shock_count_5m, risk_score_5m, worst_sentiment_5m, shock_headlines, window_end FROM decided WHERE status = 'sent'""")
def shock_alerts(t: Tables) -> DataFrame:
    return alerts.shock_alerts(shock_windows(t))


HISTORY = f"""{DECIDED},
history AS (SELECT ticker, CAST(risk_score_5m AS DECIMAL(6,3)) AS risk_score, CAST(threshold AS DECIMAL(6,3)) AS threshold,
  {S.severity("risk_score_5m")} AS severity, window_end, window_end AS triggered_at, status = 'sent' AS notification_sent,
  CASE WHEN status = 'sent' THEN window_end END AS notification_sent_at,
  CASE WHEN status = 'failed' THEN 'Slack notification failed' END AS notification_error,
  status = 'suppressed' AS suppressed, reason AS suppression_reason, {S.message("ticker", "risk_score_5m")} AS alert_message
  FROM decided)"""
HISTORY_COLUMNS = ("ticker, risk_score, threshold, severity, window_end, triggered_at, notification_sent, "
                   "notification_sent_at, notification_error, suppressed, suppression_reason, alert_message")


def history(t: Tables) -> DataFrame:
    return alerts.alert_history(decided(t))


@query("sink_alert_history", f"{HISTORY} SELECT {HISTORY_COLUMNS} FROM history")
def sink_alert_history(t: Tables) -> DataFrame:
    return history(t)


@query("sink_outbox", f"""{DECIDED} SELECT ticker, window_end, '#supply-chain-alerts' AS channel, 'RiskBot' AS username,
  {S.payload("ticker", "risk_score_5m", "threshold", "window_end")} AS payload FROM decided WHERE status IN ('sent', 'failed')""")
def sink_outbox(t: Tables) -> DataFrame:
    return alerts.outbox(decided(t))


@query("alert_stats", f"{DECIDED} SELECT status, reason, count(*) AS alerts FROM decided GROUP BY status, reason")
def alert_stats(t: Tables) -> DataFrame:
    return alerts.alert_stats(decided(t))


@query("alert_log_union", f"""{HISTORY} SELECT ticker, window_end, notification_sent, suppressed, notification_error FROM history""")
def alert_log_union(t: Tables) -> DataFrame:
    rows = staged(history(t), "history")  # three filters, one ordered scan
    sent = rows.filter("notification_sent")
    suppressed = rows.filter("suppressed")
    failed = rows.filter("notification_error IS NOT NULL")
    return alerts.alert_log_union(sent, suppressed, failed).select(
        "ticker", "window_end", "notification_sent", "suppressed", "notification_error")


REPORT = "ticker, triggered_at, risk_score, alert_message"


def _report(rows: DataFrame) -> DataFrame:
    return rows.select("ticker", "triggered_at", "risk_score", "alert_message")


@query("recent_alerts", f"{HISTORY} SELECT {REPORT} FROM history ORDER BY triggered_at DESC, ticker LIMIT 100")
def recent_alerts(t: Tables) -> DataFrame:
    return _report(alerts.recent_alerts(history(t), 100))


@query("recent_alerts_by_ticker", f"{HISTORY} SELECT {REPORT} FROM history WHERE ticker = 'T3' ORDER BY triggered_at DESC, ticker LIMIT 20")
def recent_alerts_by_ticker(t: Tables) -> DataFrame:
    return _report(alerts.recent_alerts(history(t), 20, F.col("ticker") == "T3"))


@query("alerts_by_sent", f"{HISTORY} SELECT {REPORT} FROM history WHERE notification_sent ORDER BY triggered_at DESC, ticker LIMIT 50")
def alerts_by_sent(t: Tables) -> DataFrame:
    return _report(alerts.recent_alerts(history(t), 50, F.col("notification_sent")))


@query("alerts_by_suppressed", f"{HISTORY} SELECT {REPORT} FROM history WHERE suppressed ORDER BY triggered_at DESC, ticker LIMIT 50")
def alerts_by_suppressed(t: Tables) -> DataFrame:
    return _report(alerts.recent_alerts(history(t), 50, F.col("suppressed")))


@query("last_sent_store", f"""{DECIDED} SELECT 'alert:last_sent:' || ticker AS key, max(window_end) AS sent_at, max(window_end) + INTERVAL 30 MINUTE AS expires_at
FROM decided WHERE status = 'sent' GROUP BY ticker""")
def last_sent_store(t: Tables) -> DataFrame:
    sent = decided(t).filter(F.col("status") == "sent")
    return (sent.groupBy(last_sent_key(F.col("ticker")).alias("key"))
            .agg(F.max("window_end").alias("sent_at"))
            .withColumn("expires_at", F.col("sent_at") + F.make_dt_interval(mins=F.lit(30))))
