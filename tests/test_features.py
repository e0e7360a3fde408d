import random

import pytest
from helpers import at, fold_ewm, mentions
from pyspark.sql import functions as F

from tidewatch.operators import features

# sentiments in order, negative, positive, score, risk
RISK_TABLE = [
    ([-0.8, -0.2, 0.6, -0.5, -0.3], 4, 1, -0.566, 1.0),
    ([-0.9, -0.8, -0.7], 3, 0, -0.871, 1.0),
    ([-0.1, 0.1, 0.0], 1, 1, -0.072, 0.59),
    ([0.8, 0.9, 0.7], 0, 3, 0.799, 0.09),
    ([-0.6, -0.4, -0.5, -0.3, -0.7, -0.2], 6, 0, -0.524, 1.0),
    ([-0.95], 1, 0, -0.95, 1.0),
    ([-0.2, 0.3, 0.1], 1, 2, -0.125, 0.619),
    ([0.5, 0.7, 0.8], 0, 3, 0.548, 0.203),
    ([-0.7, 0.2], 1, 1, -0.61, 0.885),
    ([0.0, 0.0], 0, 0, 0.0, 0.45),
    ([0.0, -0.0, 1e-6, -1e-6], 1, 1, 0.0, None),
    ([-999.9, 999.9, -1.0, 1.0, 0.0], 2, 2, None, None),
]


@pytest.mark.parametrize("build", [features.company_features_tumbling,
                                   lambda m: features.company_features_plain(m, "5 minutes", "5 minutes")])
def test_risk_table(spark, build):
    rows = [(f"C{i:02d}", at(seconds=10 * j), s)
            for i, (xs, *_) in enumerate(RISK_TABLE) for j, s in enumerate(xs)]
    got = {r.ticker: r for r in build(mentions(spark, rows)).collect()}
    assert len(got) == len(RISK_TABLE)
    for i, (_, neg, pos, score, risk) in enumerate(RISK_TABLE):
        row = got[f"C{i:02d}"]
        assert (row.neg_news_count_5m, row.pos_news_count_5m) == (neg, pos)
        assert row.window_end == at(5)
        if score is not None:
            assert row.sentiment_score_5m == score
        if risk is not None:
            assert row.risk_score_5m == risk


def hot_mentions(spark, n=3000, seed=1):
    """One ticker has most rows, half of them within one second."""
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        ticker = "HOT" if rnd.random() < 0.8 else f"T{rnd.randrange(5)}"
        second = 100 if rnd.random() < 0.5 else rnd.randrange(1200)
        rows.append((ticker, at(seconds=second), round(rnd.uniform(-1, 1), 2)))
    return rows


def test_hot_key_windows_equal_plain_form(spark, pieces):
    m = mentions(spark, hot_mentions(spark))
    fast = features.company_features(m)
    plain = features.company_features_plain(m)
    assert fast.exceptAll(plain).count() == 0
    assert plain.exceptAll(fast).count() == 0


def test_uneven_slide(spark, pieces):
    m = mentions(spark, hot_mentions(spark, 500))
    fast = features.company_features(m, "5 minutes", "2 minutes", 0.3)
    plain = features.company_features_plain(m, "5 minutes", "2 minutes", 0.3)
    assert sorted(fast.collect()) == sorted(plain.collect())


@pytest.mark.parametrize("seed", ["first", "zero"])
def test_hot_key_running_features(spark, pieces, seed):
    rows = hot_mentions(spark)
    got = {r.news_id: r for r in
           features.running_features(mentions(spark, rows), seed=seed).collect()}
    assert len(got) == len(rows)
    by_ticker = {}
    for i, (ticker, t, s) in enumerate(rows):
        by_ticker.setdefault(ticker, []).append((t, f"{i:06d}", s))
    for ordered in by_ticker.values():
        ordered.sort()
        xs = [s for _, _, s in ordered]
        neg = pos = 0
        for (_, news_id, s), ewm in zip(ordered, fold_ewm(xs, seed=seed)):
            neg, pos = neg + (s < 0), pos + (s > 0)
            r = got[news_id]
            assert (r.neg_news_count_24h, r.pos_news_count_24h) == (neg, pos)
            assert r.sentiment_ewm_7d == pytest.approx(ewm, abs=1e-12)


def test_ewm_by_ticker(spark, pieces):
    rows = [("A", at(seconds=i), ((i * 37) % 201 - 100) / 100) for i in range(800)]
    for seed in ("first", "zero"):
        got = features.ewm_by_ticker(mentions(spark, rows), seed=seed).first()
        assert got.ewm == pytest.approx(fold_ewm([r[2] for r in rows], seed=seed)[-1], abs=1e-12)


def test_many_mentions_one_row_per_ticker(spark):
    rows = [(f"T{i % 100}", at(seconds=i % 60), 0.1) for i in range(10_000)]
    out = features.company_features_tumbling(mentions(spark, rows)).collect()
    assert len(out) == 100 and len({r.ticker for r in out}) == 100


def test_incomplete_mentions_are_skipped(spark):
    m = mentions(spark, [("A", at(), 0.5), (None, at(), 0.5), ("A", at(), None)])
    assert features.company_features_tumbling(m).first().pos_news_count_5m == 1
    assert features.company_features(m.filter("false")).count() == 0


def test_aliases_and_latest(spark):
    f = features.company_features(mentions(spark, [("A", at(), 0.5), ("A", at(9), -0.5)]))
    row = features.legacy_aliases(f).first()
    assert row.sentiment_ewm_7d == row.sentiment_score_5m
    assert row.neg_news_count_24h == row.neg_news_count_5m
    assert features.latest_features(f).first().window_end == at(14)


def test_simple_features(spark):
    out = features.simple_features(mentions(spark, [("A", at(), -0.7), ("B", at(), 0.0)]))
    assert [(r.neg_news_count_24h, r.pos_news_count_24h) for r in out.orderBy("ticker").collect()] \
        == [(1, 0), (0, 0)]


def test_plan_spreads_panes_not_mentions(spark):
    plan = features.company_features(mentions(spark, [("A", at(), 0.1)]).filter(F.lit(True)))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.index("Expand") < text.index("MapInArrow") < text.index("rangepartitioning")
