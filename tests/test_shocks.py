from helpers import at, mentions, news
from pyspark.sql import functions as F

from tidewatch import dims
from tidewatch.operators import alerts, shocks


def events(spark, sentiments, step=10):
    m = mentions(spark, [("A", at(seconds=step * i), s) for i, s in enumerate(sentiments)])
    return m.withColumn("headline", F.concat(F.lit("h"), (F.col("news_id").cast("int") + 1)))


def test_counts_and_first_headlines(spark):
    out = shocks.shock_features(events(spark, [-0.6, -0.9, -0.7, -1.0]), "5 minutes", "5 minutes").first()
    assert (out.shock_count_5m, out.worst_sentiment_5m, out.risk_score_5m) == (4, -1.0, 0.8)
    assert out.shock_headlines == ["h1", "h2", "h3"]


def test_risk_is_capped(spark):
    out = shocks.shock_features(events(spark, [-0.6] * 6), "5 minutes", "5 minutes").first()
    assert out.risk_score_5m == 1.0


def test_sliding_windows_take_headlines_across_panes(spark):
    out = shocks.shock_features(events(spark, [-0.6, -0.7, -0.8, -0.9], step=50))
    last = out.filter(F.col("window_end") == F.lit(str(at(5))).cast("timestamp")).first()
    assert last.shock_headlines == ["h1", "h2", "h3"] and last.shock_count_5m == 4


def test_prefilter_is_substring_over_headline_and_body(spark):
    rows = [("Factory Closure announced", None), ("Quiet day", "a power\noutage"),
            ("Quiet day", "POWER OUTAGES reported"), ("plant", "closure"), ("Nothing", "")]
    kept = [r.news_id for r in shocks.shock_prefilter(news(spark, rows)).collect()]
    # headline and body are joined by a space, so a phrase may span them
    assert sorted(kept) == ["0", "2", "3"]
    rest = [r.news_id for r in shocks.not_shock(news(spark, rows)).collect()]
    assert sorted(rest) == ["1", "4"]
    stats = shocks.prefilter_stats(news(spark, rows)).first()
    assert (stats.total_articles, stats.shock_articles, stats.filtered_articles) == (5, 3, 2)
    assert abs(stats.filtered_pct - 40.0) < 1e-9


def test_every_phrase_is_found(spark):
    rows = [(f"x {p} y", None) for p in dims.SHOCK_PHRASES] + [
        (f"x {p[:-1]}", None) for p in dims.SHOCK_PHRASES]
    assert shocks.shock_prefilter(news(spark, rows)).count() == len(dims.SHOCK_PHRASES)


def test_threshold_is_strict(spark):
    m = mentions(spark, [("A", at(), -0.5), ("A", at(), -0.51)])
    assert shocks.shock_threshold(m).count() == 1
    assert shocks.shock_threshold(m, -0.3).count() == 2


def test_shock_alerts_follow_the_cooldown(spark):
    rows = [("A", at(minutes=m, seconds=s), -0.9) for m in (0, 10, 40) for s in (1, 2, 3)]
    e = mentions(spark, rows).withColumn("headline", F.lit("h"))
    out = alerts.shock_alerts(shocks.shock_features(e)).orderBy("window_end").collect()
    assert [r.window_end for r in out] == [at(1), at(41)]
    assert out[0].shock_count_5m == 3


def test_hot_ticker_windows_against_plain_python(spark, pieces):
    rows = [("HOT" if i % 3 else f"T{i % 7}", at(seconds=(i * 7) % 400), -0.51 - (i % 40) / 100)
            for i in range(900)]
    e = mentions(spark, rows).withColumn("headline", F.concat(F.lit("h"), "news_id"))
    got = {(r.ticker, r.window_end): r for r in shocks.shock_features(e).collect()}
    want = {}
    for i, (ticker, t, s) in enumerate(rows):
        minute = int((t - at()).total_seconds() // 60)
        for k in range(1, 6):
            want.setdefault((ticker, at(minute + k)), []).append((t, f"{i:06d}", s))
    assert set(got) == set(want)
    for key, items in want.items():
        items.sort()
        r = got[key]
        assert r.shock_count_5m == len(items)
        assert r.worst_sentiment_5m == min(s for _, _, s in items)
        assert r.shock_headlines == [f"h{i}" for _, i, _ in items[:3]]
