"""Small data builders and plain-Python yardsticks."""

import datetime as dt

START = dt.datetime(2024, 1, 1)


def at(minutes: float = 0, seconds: float = 0) -> dt.datetime:
    return START + dt.timedelta(minutes=minutes, seconds=seconds)


def mentions(spark, rows):
    """rows: (ticker, time, sentiment)"""
    data = [(f"{i:06d}", t, k, s) for i, (k, t, s) in enumerate(rows)]
    return spark.createDataFrame(
        data, "news_id string, event_ts timestamp, ticker string, sentiment double")


def news(spark, rows):
    """rows: (headline, body)"""
    data = [(str(i), h, "http://x/1", "2024-01-01T10:00:00Z", b) for i, (h, b) in enumerate(rows)]
    return spark.createDataFrame(
        data, "news_id string, headline string, url string, published string, full_text string")


def fold_ewm(xs, alpha=0.1, seed="first"):
    e = xs[0] if seed == "first" else 0.0
    out = []
    for x in xs:
        e = alpha * x + (1 - alpha) * e
        out.append(e)
    return out


def greedy(rows, threshold, minutes=30, delivered=lambda t: True):
    """rows: sorted (time, risk) of one ticker -> [(status, reason)]"""
    blocked, out = None, []
    for t, risk in rows:
        if blocked is not None and t < blocked:
            out.append(("suppressed", "cooldown"))
        elif risk <= threshold:
            out.append(("suppressed", "threshold_not_met"))
        elif delivered(t):
            out.append(("sent", None))
            blocked = t + dt.timedelta(minutes=minutes)
        else:
            out.append(("failed", None))
    return out
