"""Queries: windowed and running features, shock windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.scoring import round_half_up
from tidewatch.operators import features, shocks
from tidewatch.plans import views as V
from tidewatch.plans.catalog import query
from tidewatch.plans.detect_queries import ARTICLE_SHOCKS, ENRICHED, SCORE, SIMPLE
from tidewatch.plans.ingest_queries import SHOCK_WINDOWS, shock_windows
from tidewatch.plans.views import Tables
from tidewatch.sources.tables import staged

MENTIONS = f"WITH {V.MENTIONS_SQL}"
FEATURE_COLUMNS = ("ticker, window_end, neg_news_count_5m, pos_news_count_5m, sentiment_score_5m, "
                   "risk_score_5m")
FEATURES_SQL = f"{V.FEATURES_CTE} SELECT {FEATURE_COLUMNS} FROM features"
TUMBLING = f"""{MENTIONS},
spread AS (SELECT *, time_bucket(INTERVAL 5 MINUTE, event_ts) + INTERVAL 5 MINUTE AS window_end FROM mentions),
{V.features_sql("spread")}"""


@query("company_features", FEATURES_SQL)
def company_features(t: Tables) -> DataFrame:
    return V.company_windows(t)


@query("company_features_plain", FEATURES_SQL)
def company_features_plain(t: Tables) -> DataFrame:
    return features.company_features_plain(V.mentions(t))


@query("company_features_tumbling", f"{TUMBLING} SELECT {FEATURE_COLUMNS} FROM features")
def company_features_tumbling(t: Tables) -> DataFrame:
    return features.company_features_tumbling(V.mentions(t))


@query("company_features_articles", f"""{ENRICHED},
mentions AS (SELECT d.news_id, n.event_ts, d.ticker, {SCORE} AS sentiment
  FROM detected d JOIN context USING (news_id) JOIN news n USING (news_id)),
{V.windows_sql("mentions")},
{V.features_sql("spread")} SELECT {FEATURE_COLUMNS} FROM features""")
def company_features_articles(t: Tables) -> DataFrame:
    """The whole standard job in batch: articles to features."""
    rows = V.article_mentions(t).withColumn("sentiment", F.round("sentiment", 6))
    return features.company_features(staged(rows, "mentions"))


@query("sentiment_counts", f"""{MENTIONS}
SELECT ticker, CAST(count(*) FILTER (WHERE sentiment < 0) AS INTEGER) AS neg_news_count_5m,
  CAST(count(*) FILTER (WHERE sentiment > 0) AS INTEGER) AS pos_news_count_5m FROM mentions GROUP BY ticker""")
def sentiment_counts(t: Tables) -> DataFrame:
    return features.sentiment_counts(V.mentions(t), "ticker")


RANKED = f"""{MENTIONS},
ranked AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY event_ts, news_id) AS i,
  count(*) OVER (PARTITION BY ticker) AS n FROM mentions)"""


@query("ewm_first", f"""{RANKED}
SELECT ticker, n, round({V.EWM_SUM}, 6) AS ewm FROM ranked GROUP BY ticker, n""")
def ewm_first(t: Tables) -> DataFrame:
    return features.ewm_by_ticker(V.mentions(t)).withColumn("ewm", F.round("ewm", 6))


@query("ewm_zero", f"""{RANKED}
SELECT ticker, n, round(sum(sentiment * 0.1::DOUBLE * pow(0.9::DOUBLE, n - i)), 6) AS ewm FROM ranked GROUP BY ticker, n""")
def ewm_zero(t: Tables) -> DataFrame:
    return features.ewm_by_ticker(V.mentions(t), seed="zero").withColumn("ewm", F.round("ewm", 6))


@query("risk_score", f"{V.FEATURES_CTE} SELECT ticker, window_end, risk_score_5m FROM features")
def risk_score(t: Tables) -> DataFrame:
    return V.company_windows(t).select("ticker", "window_end", "risk_score_5m")


@query("legacy_aliases", f"""{V.FEATURES_CTE} SELECT ticker, window_end, neg_news_count_5m AS neg_news_count_24h,
  pos_news_count_5m AS pos_news_count_24h, sentiment_score_5m AS sentiment_ewm_7d FROM features""")
def legacy_aliases(t: Tables) -> DataFrame:
    return features.legacy_aliases(V.company_windows(t)).select(
        "ticker", "window_end", "neg_news_count_24h", "pos_news_count_24h", "sentiment_ewm_7d")


@query("latest_features", f"""{V.FEATURES_CTE} SELECT {FEATURE_COLUMNS}
FROM features QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY window_end DESC) = 1""")
def latest_features(t: Tables) -> DataFrame:
    return features.latest_features(V.company_windows(t))


@query("clean_mentions", f"""{MENTIONS}
SELECT news_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE ticker END AS ticker, sentiment
FROM mentions WHERE event_id % 7 <> 0 AND event_id % 5 <> 0""")
def clean_mentions(t: Tables) -> DataFrame:
    e = F.col("news_id").cast("long")
    holes = V.mentions(t).withColumns({
        "ticker": F.when(e % 7 != 0, F.col("ticker")), "sentiment": F.when(e % 5 != 0, F.col("sentiment"))})
    return features.clean_mentions(holes).select("news_id", "ticker", "sentiment")


@query("simple_features", f"""WITH {V.NEWS_SQL}, {SIMPLE}
SELECT news_id, ticker, event_ts AS window_end, CAST(sentiment < 0 AS INTEGER) AS neg_news_count_24h,
  CAST(sentiment > 0 AS INTEGER) AS pos_news_count_24h, sentiment AS sentiment_ewm_7d FROM simple WHERE ticker IS NOT NULL""")
def simple_features(t: Tables) -> DataFrame:
    from tidewatch.functions.codecs import parse_iso
    from tidewatch.operators.detect import detect_simple
    rows = detect_simple(V.news(t)).withColumn("event_ts", parse_iso(F.col("published")))
    return features.simple_features(rows)


# the closed form of the running mean for every prefix; the decay makes it a self-join, so the
# oracle folds recursively instead
def running_sql(first: bool) -> str:
    seed = "sentiment" if first else "0.1::DOUBLE * sentiment"
    return f"""WITH RECURSIVE {V.MENTIONS_SQL},
ranked AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY event_ts, news_id) AS i,
  count(*) FILTER (WHERE sentiment < 0) OVER w AS neg, count(*) FILTER (WHERE sentiment > 0) OVER w AS pos
  FROM mentions WINDOW w AS (PARTITION BY ticker ORDER BY event_ts, news_id ROWS UNBOUNDED PRECEDING)),
walk AS (SELECT ticker, i, {seed} AS ewm FROM ranked WHERE i = 1
  UNION ALL SELECT r.ticker, r.i, 0.1::DOUBLE * r.sentiment + 0.9::DOUBLE * w.ewm
  FROM walk w JOIN ranked r ON r.ticker = w.ticker AND r.i = w.i + 1)"""


RUNNING_COLUMNS = ("r.news_id, r.ticker, r.event_ts AS window_end, CAST(neg AS INTEGER) AS neg_news_count_24h, "
                   "CAST(pos AS INTEGER) AS pos_news_count_24h")


@query("running_features", f"""{running_sql(False)}
SELECT {RUNNING_COLUMNS}, round(ewm, 6) AS sentiment_ewm_7d FROM ranked r JOIN walk USING (ticker, i)""")
def running_features(t: Tables) -> DataFrame:
    return (features.running_features(V.mentions(t))
            .withColumn("sentiment_ewm_7d", F.round("sentiment_ewm_7d", 6)))


@query("running_features_first", f"""{running_sql(True)}
SELECT {RUNNING_COLUMNS}, CAST(round(CAST(ewm AS DECIMAL(18,9)), 3) AS DOUBLE) AS sentiment_ewm_7d
FROM ranked r JOIN walk USING (ticker, i)""")
def running_features_first(t: Tables) -> DataFrame:
    return (features.running_features(V.mentions(t), seed="first")
            .withColumn("sentiment_ewm_7d", round_half_up(F.col("sentiment_ewm_7d"), 3)))


@query("running_counts", f"""{MENTIONS}
SELECT news_id, ticker, CAST(count(*) FILTER (WHERE sentiment < 0) OVER w AS INTEGER) AS neg_news_count_24h,
  CAST(count(*) FILTER (WHERE sentiment > 0) OVER w AS INTEGER) AS pos_news_count_24h
FROM mentions WINDOW w AS (PARTITION BY ticker ORDER BY event_ts, news_id ROWS UNBOUNDED PRECEDING)""")
def running_counts(t: Tables) -> DataFrame:
    return features.running_features(V.mentions(t)).select(
        "news_id", "ticker", "neg_news_count_24h", "pos_news_count_24h")


@query("ewm_running", f"""{running_sql(True)}
SELECT r.news_id, r.ticker, round(ewm, 6) AS ewm FROM ranked r JOIN walk USING (ticker, i)""")
def ewm_running(t: Tables) -> DataFrame:
    return features.running_features(V.mentions(t), seed="first").select(
        "news_id", "ticker", F.round("sentiment_ewm_7d", 6).alias("ewm"))


# ---- shocks ----

SHOCK_COLUMNS = "ticker, window_end, shock_count_5m, worst_sentiment_5m, risk_score_5m, shock_headlines"


@query("shock_features", f"{SHOCK_WINDOWS} SELECT {SHOCK_COLUMNS} FROM shock_windows")
def shock_features(t: Tables) -> DataFrame:
    return shock_windows(t)


def _windows_of(source: str) -> str:
    return SHOCK_WINDOWS.split(V.EVENT_SHOCKS_SQL + ",\n")[1].replace("FROM shocks m", f"FROM {source} m")


@query("shock_features_articles", f"{ARTICLE_SHOCKS},\n{_windows_of('article_shocks')} SELECT {SHOCK_COLUMNS} FROM shock_windows")
def shock_features_articles(t: Tables) -> DataFrame:
    """The whole shock job in batch: prefilter, enrich, threshold, windows."""
    rows = V.article_shocks(t).withColumn("sentiment", F.round("sentiment", 6))
    return (shocks.shock_features(staged(rows, "shocks"))
            .withColumn("shock_headlines", F.array_join("shock_headlines", "|")))


@query("shock_threshold", f"{MENTIONS} SELECT news_id, ticker, sentiment FROM mentions WHERE sentiment < -0.5")
def shock_threshold(t: Tables) -> DataFrame:
    return shocks.shock_threshold(V.mentions(t)).select("news_id", "ticker", "sentiment")


@query("shock_alert_filter", f"{SHOCK_WINDOWS} SELECT {SHOCK_COLUMNS} FROM shock_windows WHERE shock_count_5m >= 3")
def shock_alert_filter(t: Tables) -> DataFrame:
    return shocks.shock_alert_filter(shock_windows(t))


@query("first_k_headlines", f"""{MENTIONS}, {V.EVENT_SHOCKS_SQL},
heads AS (SELECT *, time_bucket(INTERVAL 5 MINUTE, event_ts) + INTERVAL 5 MINUTE AS window_end FROM shocks)
SELECT ticker, window_end, CAST(row_number() OVER (PARTITION BY ticker, window_end ORDER BY event_ts, news_id) AS INTEGER) AS position,
  news_id, headline FROM heads QUALIFY position <= 3""")
def first_k_headlines(t: Tables) -> DataFrame:
    return shocks.first_headlines(V.event_shocks(t))
