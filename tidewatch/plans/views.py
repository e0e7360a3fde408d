"""News and mention views over the given tables.

The tables hold no news about companies, so the article view puts one of fifteen headlines and
openings in front of every document's own text, and the mention view reads events as mentions. The
SQL twins (``*_SQL``) say the same for the oracle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators import enrich, features, shocks

HEADLINES = [
    "Tesla warns of factory closure after fire",
    "iPhone assembly slows in a supply chain crisis at Apple",
    "Power outage stops Microsoft services",
    "Amazon depots hit by port congestion and severe shortage",
    "Chip shortage forces Google to cut phone plans",
    "Netflix adds films to its library",
    "Profit beat lifts Meta shares",
    "Teslamotors club meets in spring",
    "McDonald's and AT&T agree on growth plan",
    "Food for pets sells well",
    "Carmakers expand on a quiet market",
    "Apple signs partnership with chip designer",
    "Tesla output update",
    "NVIDIA and TSMC talk about delay",
    "Ford F-150 and Tesla Model 3 lead sales",
]
OPENINGS = [
    "Tesla closed the plant while the semiconductor shortage goes on.",
    "Several suppliers report a raw material shortage and a manufacturing halt.",
    "Azure and Xbox users were cut off; an infrastructure failure is the cause.",
    "The logistics crisis adds to a shipping delay for Kindle devices.",
    "A supply shortage and a logistics crisis slow the Android hardware.",
    "Subscribers may rise in new markets.",
    "Instagram revenue rose; economic headwinds and price volatility remain.",
    "Members restore old cars.",
    "Both hope for cost reduction and a new supplier.",
    "Catnip and heavy-duty bowls sell best.",
    "Analysts at JP Morgan and Wells Fargo name Toyota and Tesla.",
    "Microsoft and Google take part, and Coca-Cola watches.",
    "The Cybertruck line has a production delay and a recall.",
    "Quality control costs time; capacity expansion may help.",
    "General Motors follows; demand uncertainty stays.",
]
CORPUS_WORDS = [("that", "WTHAT"), ("with", "WWITH"), ("orre", "WORRE"), ("ering", "WRING"),
                ("the is", "WTHAT")]
THRESHOLDS = {"T0": 0.6, "T1": 0.75, "T2": 0.9, "T3": 0.5}
LEXICON = [("with", 0.4), ("that", -0.7), ("this", 1.1), ("closed", -1.9), ("crisis", -3.1),
           ("delay", -1.3), ("growth", 1.6), ("rise", 0.9), ("orre", 0.25), ("le", -0.15),
           ("der", 0.35), ("que", -0.55)]


def sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def sql_list(values: list[str]) -> str:
    return "[" + ", ".join(sql_text(v) for v in values) + "]"


@dataclass
class Tables:
    """The parquet tables of one directory."""
    spark: SparkSession
    path: str

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path.rstrip('/')}/{name}.parquet")


def _choice(values: list[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


START = "2024-01-01 00:00:00"


def after_start(secs: Column) -> Column:
    return F.lit(START).cast("timestamp") + F.make_dt_interval(secs=secs)


# ---- mentions: every event is a mention, one per second ----

def mentions(t: Tables) -> DataFrame:
    e = F.col("event_id")
    return t.events.select(
        e.cast("string").alias("news_id"), after_start(e).alias("event_ts"),
        F.concat(F.lit("T"), (F.col("user_id") % 42).cast("string")).alias("ticker"),
        F.when(F.col("event_type") == "view", "mentioned").otherwise("primary").alias("role"),
        (((e * 37) % 201 - 100) / 100.0).alias("sentiment"))


MENTIONS_SQL = """mentions AS (
  SELECT CAST(event_id AS VARCHAR) AS news_id, TIMESTAMP '2024-01-01' + to_seconds(event_id) AS event_ts,
         'T' || CAST(user_id % 42 AS VARCHAR) AS ticker,
         CASE WHEN event_type = 'view' THEN 'mentioned' ELSE 'primary' END AS role,
         CAST((event_id * 37) % 201 - 100 AS DOUBLE) / 100.0::DOUBLE AS sentiment, event_id
  FROM events)"""


def company_windows(t: Tables) -> DataFrame:
    return features.company_features(mentions(t))


def windows_sql(source: str, ends: int = 5) -> str:
    return f"""spread AS (
  SELECT m.*, date_trunc('minute', event_ts) + to_minutes(k) AS window_end
  FROM {source} m, range(1, {ends + 1}) AS r(k))"""


EWM_SUM = ("sum(sentiment * pow(0.9::DOUBLE, n - i) * "
           "CASE WHEN i = 1 THEN 1.0::DOUBLE ELSE 0.1::DOUBLE END)")

RISK_TAIL = """
  SELECT *, CAST(printf('%.3f', least(1.0::DOUBLE,
      greatest(0.0::DOUBLE, least(1.0::DOUBLE, (1.0::DOUBLE - sentiment_score_5m) / 2.0::DOUBLE))
      * least(1.5::DOUBLE, 1.0::DOUBLE + (neg_news_count_5m + pos_news_count_5m - 1) * 0.1::DOUBLE)
      * CASE WHEN neg_news_count_5m + pos_news_count_5m > 0
             THEN 1.0::DOUBLE + (neg_news_count_5m::DOUBLE / (neg_news_count_5m + pos_news_count_5m)
                                 - 0.5::DOUBLE) * 0.5::DOUBLE
             ELSE 1.0::DOUBLE END)) AS DOUBLE) AS risk_score_5m
  FROM scored"""


def features_sql(source: str = "mentions") -> str:
    """CTEs ending in ``features`` from a mentions relation with ``spread`` defined before."""
    return f"""numbered AS (
  SELECT ticker, window_end, sentiment,
         row_number() OVER (PARTITION BY ticker, window_end ORDER BY event_ts, news_id) AS i,
         count(*) OVER (PARTITION BY ticker, window_end) AS n
  FROM {source}),
scored AS (
  SELECT ticker, window_end,
         CAST(count(*) FILTER (WHERE sentiment < 0) AS INTEGER) AS neg_news_count_5m,
         CAST(count(*) FILTER (WHERE sentiment > 0) AS INTEGER) AS pos_news_count_5m,
         CAST(round(CAST({EWM_SUM} AS DECIMAL(18,9)), 3) AS DOUBLE) AS sentiment_score_5m
  FROM numbered GROUP BY ticker, window_end),
features AS ({RISK_TAIL})"""


FEATURES_CTE = f"WITH {MENTIONS_SQL},\n{windows_sql('mentions')},\n{features_sql('spread')}"


# ---- news: every document is an article ----

def news(t: Tables) -> DataFrame:
    d, text = F.col("doc_id"), F.col("text")
    return t.documents.select(
        d.cast("string").alias("news_id"),
        F.concat(_choice(HEADLINES, d % 15), F.lit(" "), F.substring_index(text, "\n", 1))
        .alias("headline"),
        F.concat(F.lit("http://"), F.col("source"), F.lit("/"), d.cast("string")).alias("url"),
        F.date_format(after_start(d * 7), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("published"),
        F.concat(_choice(OPENINGS, d % 15), F.lit(" "), text).alias("full_text"))


NEWS_SQL = f"""news AS (
  SELECT CAST(doc_id AS VARCHAR) AS news_id,
         {sql_list(HEADLINES)}[doc_id % 15 + 1] || ' ' || split_part(text, chr(10), 1) AS headline,
         'http://' || source || '/' || CAST(doc_id AS VARCHAR) AS url,
         strftime(TIMESTAMP '2024-01-01' + to_seconds(doc_id * 7), '%Y-%m-%dT%H:%M:%SZ') AS published,
         {sql_list(OPENINGS)}[doc_id % 15 + 1] || ' ' || text AS full_text,
         TIMESTAMP '2024-01-01' + to_seconds(doc_id * 7) AS event_ts, doc_id
  FROM documents),
texts AS (SELECT *, headline || ' ' || full_text AS full_body,
                 lower(headline || ' ' || full_text) AS low FROM news)"""


# ---- requests: articles with faults put in by rule ----

def requests(t: Tables) -> DataFrame:
    d = F.col("news_id").cast("long")
    published = (F.when(d % 9 == 3, "").when(d % 9 == 4, "invalid-date")
                 .when(d % 9 == 5, F.substring("published", 1, 19))
                 .when(d % 9 == 6, F.concat(F.substring("published", 1, 19), F.lit("+02:00")))
                 .when(d % 9 == 7, F.concat(F.substring("published", 1, 19), F.lit(".250Z")))
                 .when(d % 9 == 8, "2024-02-30T10:00:00Z").otherwise(F.col("published")))
    return news(t).select(
        "news_id", F.when(d % 9 == 1, "").otherwise(F.col("headline")).alias("headline"),
        F.when(d % 9 == 2, F.lit(None)).otherwise(F.col("url")).alias("url"),
        published.alias("published"),
        F.when(d % 4 == 1, "").otherwise(F.col("full_text")).alias("full_text"))


REQUESTS_SQL = """requests AS (
  SELECT news_id, CASE WHEN doc_id % 9 = 1 THEN '' ELSE headline END AS headline,
         CASE WHEN doc_id % 9 = 2 THEN NULL ELSE url END AS url,
         CASE doc_id % 9 WHEN 3 THEN '' WHEN 4 THEN 'invalid-date'
           WHEN 5 THEN published[1:19] WHEN 6 THEN published[1:19] || '+02:00'
           WHEN 7 THEN published[1:19] || '.250Z' WHEN 8 THEN '2024-02-30T10:00:00Z'
           ELSE published END AS published,
         CASE WHEN doc_id % 4 = 1 THEN '' ELSE full_text END AS full_text, doc_id
  FROM news)"""


def raw_records(t: Tables) -> DataFrame:
    """Articles as JSON, some broken: cut off, missing a key, null, a list, empty."""
    d = F.col("news_id").cast("long")
    whole = F.to_json(F.struct("news_id", "headline", "url", "published", "full_text"))
    no_url = F.to_json(F.struct("news_id", "headline", "published", "full_text"))
    no_body = F.to_json(F.struct("news_id", "headline", "url", "published"))
    return news(t).select(
        F.col("news_id").alias("record_id"),
        F.when(d % 11 == 1, F.expr("left({0}, length({0}) - 1)".format(
            "to_json(struct(news_id, headline, url, published, full_text))")))
        .when(d % 11 == 2, no_url).when(d % 11 == 3, "null").when(d % 11 == 4, "[]")
        .when(d % 11 == 5, "").when(d % 11 == 6, no_body)
        .when(d % 11 == 7, '{"invalid": json}').otherwise(whole).alias("value"))


# ---- enriched articles and shocks ----

def enriched(t: Tables) -> DataFrame:
    return enrich.enrich_news(news(t))


def article_mentions(t: Tables) -> DataFrame:
    return enrich.to_mention_events(enriched(t))


def article_shocks(t: Tables, threshold: float = -0.5) -> DataFrame:
    return enrich.to_shock_events(enrich.enrich_news(shocks.shock_prefilter(news(t))), threshold)


def event_shocks(t: Tables) -> DataFrame:
    """Shock events from the mention view."""
    return (shocks.shock_threshold(mentions(t), -0.5)
            .select("news_id", "event_ts", "ticker", "sentiment",
                    F.concat(F.lit("headline "), "news_id").alias("headline")))


EVENT_SHOCKS_SQL = """shocks AS (
  SELECT news_id, event_ts, ticker, sentiment, 'headline ' || news_id AS headline
  FROM mentions WHERE sentiment < -0.5)"""


def batched(t: Tables) -> DataFrame:
    """Articles in batches of uneven size: up to 120, some beyond the limit."""
    d = F.col("news_id").cast("long")
    size = F.when(F.floor(d / 500) % 2 == 0, 50).otherwise(125)
    return news(t).withColumn("batch_id", F.concat(
        F.floor(d / 500).cast("string"), F.lit("-"), F.floor((d % 500) / size).cast("string")))


BATCHED_SQL = """batched AS (
  SELECT *, CAST(doc_id // 500 AS VARCHAR) || '-' ||
    CAST((doc_id % 500) // CASE WHEN (doc_id // 500) % 2 = 0 THEN 50 ELSE 125 END AS VARCHAR) AS batch_id
  FROM news)"""
