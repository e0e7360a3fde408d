import random

import pytest
from helpers import at, greedy
from pyspark.sql import functions as F

from tidewatch.functions import scoring
from tidewatch.operators import alerts


def features(spark, rows):
    """rows: (ticker, minute, risk)"""
    return spark.createDataFrame([(k, at(m), r) for k, m, r in rows],
                                 "ticker string, window_end timestamp, risk_score_5m double")


def decide(spark, rows, **kw):
    out = alerts.evaluate_alerts(features(spark, rows), **kw)
    return [(r.status, r.reason) for r in out.orderBy("ticker", "window_end").collect()]


def test_sequence(spark):
    got = decide(spark, [("A", m, 0.9) for m in (0, 10, 29, 30, 45, 61)])
    assert [s for s, _ in got] == ["sent", "suppressed", "suppressed", "sent", "suppressed", "sent"]


def test_threshold_is_strict_and_cooldown_is_the_reason_while_it_lasts(spark):
    assert decide(spark, [("A", 0, 0.7)]) == [("suppressed", "threshold_not_met")]
    assert decide(spark, [("A", 0, 0.9), ("A", 5, 0.1), ("A", 31, 0.1)]) == [
        ("sent", None), ("suppressed", "cooldown"), ("suppressed", "threshold_not_met")]


def test_tickers_are_independent_and_have_their_own_thresholds(spark):
    rows = [("MSFT", 0, 0.65), ("TSLA", 0, 0.65)]
    assert decide(spark, rows, thresholds={"TSLA": 0.6, "MSFT": 0.75}) == [
        ("suppressed", "threshold_not_met"), ("sent", None)]


def test_failed_delivery_starts_no_cooldown(spark):
    got = decide(spark, [("A", 0, 0.9), ("A", 1, 0.9), ("A", 2, 0.9)],
                 delivered=F.col("window_end") != F.lit(str(at(0))).cast("timestamp"))
    assert got == [("failed", None), ("sent", None), ("suppressed", "cooldown")]


@pytest.mark.parametrize("seed", range(3))
def test_hot_ticker_across_pieces_equals_greedy(spark, pieces, seed):
    rnd = random.Random(seed)
    rows = []
    for ticker, n in (("HOT", 1500), ("B", 40), ("C", 3)):
        minutes = sorted(rnd.sample(range(4000), n))
        rows += [(ticker, m, round(rnd.random(), 2)) for m in minutes]
    ok = {m for m in range(4000) if m % 3}
    got = alerts.evaluate_alerts(
        features(spark, rows), default_threshold=0.6, cooldown_minutes=17,
        delivered=F.floor(F.unix_seconds("window_end") / 60)
        % 3 != F.lit(int(at().timestamp() // 60) % 3)).collect()
    got = {(r.ticker, r.window_end): (r.status, r.reason) for r in got}
    base = int(at().timestamp() // 60)
    for ticker in ("HOT", "B", "C"):
        mine = [(at(m), r) for k, m, r in rows if k == ticker]
        want = greedy(mine, 0.6, 17, lambda t: (int(t.timestamp() // 60)) % 3 != base % 3)
        assert [got[(ticker, t)] for t, _ in mine] == want
    assert ok


def test_history_and_statistics(spark):
    out = alerts.evaluate_alerts(features(spark, [("A", 0, 0.912), ("A", 1, 0.9), ("B", 0, 0.2)]))
    rows = {(r.ticker, r.window_end): r for r in alerts.alert_history(out).collect()}
    first = rows[("A", at(0))]
    assert str(first.risk_score) == "0.912" and first.severity == "high"
    assert first.notification_sent and first.notification_sent_at == at(0)
    assert first.alert_message == "CRITICAL: High supply chain risk detected for A (risk: 0.912)"
    assert rows[("A", at(1))].suppression_reason == "cooldown"
    stats = {(r.status, r.reason): r.alerts for r in alerts.alert_stats(out).collect()}
    assert stats == {("sent", None): 1, ("suppressed", "cooldown"): 1,
                     ("suppressed", "threshold_not_met"): 1}
    assert alerts.outbox(out).count() == 1


def test_cooldown_check(spark):
    sent = spark.createDataFrame([("A", at(0)), ("A", at(-60))], "ticker string, sent_at timestamp")
    f = features(spark, [("A", 10, 0.8), ("A", 30, 0.8), ("B", 10, 0.8)])
    got = alerts.cooldown_check(f, sent).orderBy("ticker", "window_end").collect()
    assert [r.in_cooldown for r in got] == [True, False, False]


def test_severity(spark):
    df = spark.createDataFrame([(0.9,), (0.8,), (0.75,), (0.6,), (0.55,)], "r double")
    assert [r.s for r in df.select(scoring.severity(F.col("r")).alias("s")).collect()] == [
        "high", "high", "medium", "medium", "low"]
