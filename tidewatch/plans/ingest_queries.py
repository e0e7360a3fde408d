"""Queries: parsing, validation, publishing, the keyed store."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.text import strip
from tidewatch.operators import enrich, features, ingest, metrics, shocks, store
from tidewatch.plans import sqlparts as S
from tidewatch.plans import views as V
from tidewatch.plans.catalog import query
from tidewatch.plans.views import Tables
from tidewatch.session import fresh_path
from tidewatch.sources.tables import RecordTable, staged

NEWS = f"WITH {V.NEWS_SQL}"
REQUESTS = f"{NEWS},\n{V.REQUESTS_SQL}"
# fixed values: rejection messages
REJECTION = """CASE WHEN coalesce(headline, '') = '' THEN 'headline is required'
  WHEN coalesce(url, '') = '' THEN 'url is required'
  WHEN coalesce(published, '') = '' THEN 'published is required'
  WHEN NOT (regexp_full_match(published,
              '\\d{4}-\\d{2}-\\d{2}T\\d{2}:\\d{2}:\\d{2}(\\.\\d+)?(Z|[+-]\\d{2}:\\d{2})')
            AND try_cast(replace(published[1:19], 'T', ' ') AS TIMESTAMP) IS NOT NULL)
  THEN 'published must be valid ISO-8601 format' END"""


@query("parse_news", f"""{NEWS}
SELECT news_id, headline, url, published,
       CASE WHEN doc_id % 11 = 6 THEN NULL ELSE full_text END AS full_text
FROM news WHERE doc_id % 11 NOT IN (1, 2, 3, 4, 5, 7)""")
def parse_news(t: Tables) -> DataFrame:
    return ingest.parse_news(V.raw_records(t))


@query("rejected_news", f"""{NEWS}
SELECT news_id AS record_id, doc_id % 11 AS fault FROM news WHERE doc_id % 11 IN (1, 2, 3, 4, 5, 7)""")
def rejected_news(t: Tables) -> DataFrame:
    return ingest.rejected_news(V.raw_records(t)).select(
        "record_id", (F.col("record_id").cast("long") % 11).alias("fault"))


@query("sink_news_topic", f"""{REQUESTS}
SELECT news_id AS key, news_id, headline, url, published, nullif(full_text, '') AS full_text,
       full_text <> '' AS has_body
FROM requests WHERE {REJECTION} IS NULL""")
def sink_news_topic(t: Tables) -> DataFrame:
    valid = ingest.validate_news(V.requests(t)).filter("rejection IS NULL").drop("rejection")
    records = ingest.topic_records(valid)
    back = F.from_json("value", "news_id string, headline string, url string, published string, "
                                "full_text string")
    return records.select("key", back.alias("r"), F.contains(
        F.col("value"), F.lit('"full_text":')).alias("has_body")).select("key", "r.*", "has_body")


@query("validate_news", f"{REQUESTS} SELECT news_id, {REJECTION} AS rejection FROM requests")
def validate_news(t: Tables) -> DataFrame:
    return ingest.validate_news(V.requests(t)).select("news_id", "rejection")


@query("validate_enrich_request", f"""{NEWS},
req AS (SELECT doc_id, CASE doc_id % 5 WHEN 1 THEN '' WHEN 2 THEN '  ' ELSE news_id END AS news_id,
          CASE doc_id % 7 WHEN 1 THEN '' WHEN 2 THEN ' ' || chr(9) || chr(10) ELSE headline END AS headline FROM news)
SELECT doc_id, CASE WHEN trim(news_id) = '' THEN 422 WHEN NOT regexp_matches(headline, '\\S') THEN 400 ELSE 200 END AS status_code,
  CASE WHEN trim(news_id) = '' THEN 'News ID cannot be empty' WHEN NOT regexp_matches(headline, '\\S') THEN 'Headline cannot be empty' END AS detail
FROM req""")
def validate_enrich_request(t: Tables) -> DataFrame:
    d = F.col("doc_id")
    req = (V.news(t).withColumn("doc_id", F.col("news_id").cast("long")).select(
        "doc_id", F.when(d % 5 == 1, "").when(d % 5 == 2, "  ").otherwise(F.col("news_id")).alias("news_id"),
        F.when(d % 7 == 1, "").when(d % 7 == 2, " \t\n").otherwise(F.col("headline")).alias("headline")))
    return ingest.validate_enrich_request(req).select("doc_id", "status_code", "detail")


@query("validate_batch", f"""{NEWS}, {V.BATCHED_SQL}
SELECT batch_id, count(*) AS batch_size, CASE WHEN count(*) > 100 THEN 400 ELSE 200 END AS status_code,
  CASE WHEN count(*) > 100 THEN 'Batch size cannot exceed 100 articles' END AS detail
FROM batched GROUP BY batch_id""")
def validate_batch(t: Tables) -> DataFrame:
    return ingest.validate_batch(V.batched(t))


@query("sanitize_text", """SELECT doc_id, regexp_replace(regexp_replace(chr(9) || ' ' || text || chr(10) || ' ', '^\\s+', ''), '\\s+$', '') AS clean,
  length(text) AS n_raw FROM documents""")
def sanitize_text(t: Tables) -> DataFrame:
    padded = F.concat(F.lit("\t "), F.col("text"), F.lit("\n "))
    return t.documents.select("doc_id", strip(padded).alias("clean"),
                              F.length("text").cast("long").alias("n_raw"))


@query("assign_news_id", f"""{NEWS}
SELECT news_id AS doc, sha256(url || chr(31) || published || chr(31) || headline) AS news_id FROM news""")
def assign_news_id(t: Tables) -> DataFrame:
    return (ingest.assign_news_id(V.news(t).withColumnRenamed("news_id", "doc"))
            .select("doc", "news_id"))


@query("to_enrichment_request", f"""{NEWS}
SELECT news_id, headline, full_text AS body, url, published FROM news""")
def to_enrichment_request(t: Tables) -> DataFrame:
    return enrich.to_enrichment_request(V.news(t))


# ---- outcome counts ----

@query("outcomes", f"""{REQUESTS}
SELECT CASE WHEN {REJECTION} IS NULL THEN 'success' ELSE 'error' END AS outcome, count(*) AS requests
FROM requests GROUP BY 1""")
def outcomes(t: Tables) -> DataFrame:
    return metrics.outcomes(ingest.validate_news(V.requests(t)), F.col("rejection").isNull())


@query("cumulative_histogram", """WITH v AS (SELECT value / 100.0::DOUBLE AS seconds FROM events),
b AS (SELECT * FROM (VALUES ('0.01', 0.01::DOUBLE), ('0.05', 0.05::DOUBLE), ('0.1', 0.1::DOUBLE), ('0.2', 0.2::DOUBLE),
  ('0.5', 0.5::DOUBLE), ('1.0', 1.0::DOUBLE), ('2.0', 2.0::DOUBLE), ('5.0', 5.0::DOUBLE), ('+Inf', 'inf'::DOUBLE)) x(le, bound))
SELECT le, count(*) FILTER (WHERE seconds <= bound) AS observations, round(sum(seconds), 4) AS total, count(*) AS count
FROM b, v GROUP BY le""")
def cumulative_histogram(t: Tables) -> DataFrame:
    return (metrics.cumulative_histogram(t.events.withColumn("seconds", F.col("value") / 100.0), "seconds")
            .withColumn("total", F.round("total", 4)))


@query("latency_summary", """WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS rank,
  count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, n, round(min(value), 6) AS min_value, round(avg(value), 6) AS avg_value, round(max(value), 6) AS max_value,
  round((max(value) FILTER (WHERE rank = (n - 1) // 2) + max(value) FILTER (WHERE rank = n // 2)) / 2, 6) AS median_value,
  max(value) FILTER (WHERE rank = CAST(floor(n * 0.95::DOUBLE) AS BIGINT)) AS p95_value,
  max(value) FILTER (WHERE rank = CAST(floor(n * 0.99::DOUBLE) AS BIGINT)) AS p99_value
FROM r GROUP BY event_type, n""")
def latency_summary(t: Tables) -> DataFrame:
    out = metrics.latency_summary(t.events.select("event_type", "value"), "event_type", "value")
    return out.withColumns({c: F.round(c, 6) for c in
                            ("min_value", "avg_value", "max_value", "median_value")})


# ---- keyed store ----

FEATURE_FIELDS = [("ticker", "text"), ("window_end", "time"), ("neg_news_count_5m", "number"),
                  ("pos_news_count_5m", "number"), ("sentiment_score_5m", "number"),
                  ("risk_score_5m", "number")]
LEGACY_FIELDS = [*FEATURE_FIELDS, ("neg_news_count_24h", "number"),
                 ("pos_news_count_24h", "number"), ("sentiment_ewm_7d", "number")]
TIMED = "':' || CAST(CAST(epoch(window_end) AS BIGINT) AS VARCHAR)"


def keyed_sql(rows: str, prefix: str, fields, version: str, ingest_ts: str, latest_only=False) -> str:
    value = S.record_value(fields, version, ingest_ts)
    both = f"""SELECT '{prefix}:' || ticker || ':latest' AS key, {value} AS value, window_end, {ingest_ts} AS ingest_ts FROM {rows}"""
    if not latest_only:
        both += f"""\n  UNION ALL SELECT '{prefix}:' || ticker || {TIMED} AS key, {value} AS value, window_end, {ingest_ts} AS ingest_ts FROM {rows}"""
    return both


def last_wins_sql(source: str) -> str:
    return f"""SELECT key, value, window_end, ingest_ts, ingest_ts + INTERVAL 7 DAY AS expires_at
FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY window_end DESC, ingest_ts DESC) AS r FROM ({source})) WHERE r = 1"""


# a first write from half of the mentions, then the complete one: the later write must stay
TWO_WRITES = f"""WITH {V.MENTIONS_SQL},
spread AS (SELECT m.*, date_trunc('minute', event_ts) + to_minutes(k) AS window_end FROM mentions m, range(1, 6) AS r(k)),
{V.features_sql("(SELECT * FROM spread WHERE event_id % 2 = 0)").replace("numbered", "numbered0").replace("scored", "scored0").replace("features", "features0")},
{V.features_sql("spread")}"""
EARLY, LATE = "window_end + INTERVAL 10 SECOND", "window_end + INTERVAL 70 SECOND"


def _after(secs: int):
    return F.col("window_end") + F.make_dt_interval(secs=F.lit(secs))


def _two_writes(t: Tables) -> tuple[DataFrame, DataFrame]:
    half = features.company_features(V.mentions(t).filter(F.col("news_id").cast("long") % 2 == 0))
    return half, V.company_windows(t)


@query("kv_upsert_features", f"""{TWO_WRITES}
{last_wins_sql(keyed_sql("features0", "feat", FEATURE_FIELDS, "v1", EARLY) + " UNION ALL "
               + keyed_sql("features", "feat", FEATURE_FIELDS, "v1", LATE))}""")
def kv_upsert_features(t: Tables) -> DataFrame:
    half, full = _two_writes(t)
    return store.upsert(store.keyed_records(half, ingest_ts=_after(10)),
                        store.keyed_records(full, ingest_ts=_after(70)))


SHOCK_WINDOWS = f"""WITH {V.MENTIONS_SQL},\n{V.EVENT_SHOCKS_SQL},\n{V.windows_sql("shocks")},
heads AS (SELECT *, row_number() OVER (PARTITION BY ticker, window_end ORDER BY event_ts, news_id) AS i FROM spread),
shock_windows AS (
  SELECT ticker, window_end, CAST(count(*) AS INTEGER) AS shock_count_5m, least(0.0::DOUBLE, min(sentiment)) AS worst_sentiment_5m,
    least(1.0::DOUBLE, count(*) / 5.0::DOUBLE) AS risk_score_5m,
    string_agg(headline, '|' ORDER BY i) FILTER (WHERE i <= 3) AS shock_headlines
  FROM heads GROUP BY ticker, window_end)"""
SHOCK_FIELDS = [("ticker", "text"), ("window_end", "time"), ("shock_count_5m", "number"),
                ("worst_sentiment_5m", "number"), ("risk_score_5m", "number"), ("shock_headlines", "text")]


def shock_windows(t: Tables) -> DataFrame:
    return (shocks.shock_features(V.event_shocks(t))
            .withColumn("shock_headlines", F.array_join("shock_headlines", "|")))


@query("kv_upsert_shocks", f"""{SHOCK_WINDOWS}
{last_wins_sql(keyed_sql("shock_windows", "shock", SHOCK_FIELDS, "v1_shock", EARLY))}""")
def kv_upsert_shocks(t: Tables) -> DataFrame:
    return store.last_write_wins(store.keyed_records(
        shock_windows(t), prefix="shock", version="v1_shock", ingest_ts=_after(10)))


RUNNING = f"""WITH {V.MENTIONS_SQL},
ranked AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY ticker) AS n FROM mentions WINDOW w AS (PARTITION BY ticker ORDER BY event_ts, news_id)),
running AS (
  SELECT a.ticker, max(a.event_ts) AS window_end, CAST(count(*) FILTER (WHERE sentiment < 0) AS INTEGER) AS neg_news_count_24h,
    CAST(count(*) FILTER (WHERE sentiment > 0) AS INTEGER) AS pos_news_count_24h,
    round(sum(sentiment * 0.1::DOUBLE * pow(0.9::DOUBLE, n - i)), 6) AS sentiment_ewm_7d
  FROM ranked a GROUP BY a.ticker)"""


@query("kv_upsert_latest_running", f"""{RUNNING}
SELECT 'feat:' || ticker || ':latest' AS key, ticker, strftime(window_end, '%Y-%m-%dT%H:%M:%SZ') AS window_end,
  neg_news_count_24h, pos_news_count_24h, round(sentiment_ewm_7d, 6) AS sentiment_ewm_7d, 'v1' AS _ver
FROM running""")
def kv_upsert_latest_running(t: Tables) -> DataFrame:
    rows = (features.running_features(V.mentions(t)).drop("news_id")
            .withColumn("sentiment_ewm_7d", F.round("sentiment_ewm_7d", 6)))
    records = store.last_write_wins(store.keyed_records(rows, latest_only=True, ingest_ts=_after(1)))
    value = F.from_json("value", "ticker string, window_end string, neg_news_count_24h int, "
                                 "pos_news_count_24h int, sentiment_ewm_7d double, _ver string")
    return records.select("key", value.alias("v")).select("key", "v.*")


@query("kv_record_v2", f"""{V.FEATURES_CTE},
aliased AS (SELECT *, neg_news_count_5m AS neg_news_count_24h, pos_news_count_5m AS pos_news_count_24h, sentiment_score_5m AS sentiment_ewm_7d FROM features)
{keyed_sql("aliased", "feat", LEGACY_FIELDS, "v2", EARLY).split("UNION ALL ")[1]}""")
def kv_record_v2(t: Tables) -> DataFrame:
    rows = features.legacy_aliases(V.company_windows(t))
    records = store.keyed_records(rows, version="v2", ingest_ts=_after(10))
    return records.filter(~F.col("key").endswith(":latest")).drop("expires_at")


STORED = f"""{V.FEATURES_CTE},
stored AS ({last_wins_sql(keyed_sql("features", "feat", FEATURE_FIELDS, "v1", EARLY))})"""


def stored(t: Tables) -> DataFrame:
    return store.last_write_wins(store.keyed_records(V.company_windows(t), ingest_ts=_after(10)))


@query("kv_expire", f"""{STORED}
SELECT key, value, window_end, ingest_ts, expires_at FROM stored WHERE expires_at > TIMESTAMP '2024-01-08 01:00:00'""")
def kv_expire(t: Tables) -> DataFrame:
    return store.live(stored(t), F.lit("2024-01-08 01:00:00").cast("timestamp"))


@query("kv_compaction", f"""{STORED}
SELECT key, value, window_end, ingest_ts, expires_at FROM stored WHERE expires_at > TIMESTAMP '2024-01-08 01:00:00'""")
def kv_compaction(t: Tables) -> DataFrame:
    """Records written hour after hour, folded twice: the hours that are closed leave one record per
    key, and none that has expired."""
    spark, now = t.spark, F.lit("2024-01-08 01:00:00").cast("timestamp")
    table = RecordTable(fresh_path(spark, "records"), ("key",))
    records = store.keyed_records(V.company_windows(t), ingest_ts=_after(10))
    hours = staged(records.withColumn("_h", F.hour("window_end") % 3), "hourly")
    for batch in range(3):
        rows = hours.filter(F.col("_h") == batch).drop("_h")
        table.write(store.last_write_wins(rows), batch)
    for closed in (dt.datetime(2024, 1, 1, 2), dt.datetime(2024, 1, 20)):
        table.compact(spark, closed, now)
    return store.live(table.current(table.versions(spark)), now).drop("_hour", "_batch")


@query("kv_lookup", f"""{STORED} SELECT key, value, window_end, ingest_ts, expires_at FROM stored WHERE key = 'feat:T7:latest'""")
def kv_lookup(t: Tables) -> DataFrame:
    path = fresh_path(t.spark, "store")
    store.write_store(stored(t), path)
    return store.lookup_stored(t.spark, path, "feat:T7:latest")


@query("kv_scan", f"""{STORED} SELECT key, value, window_end, ingest_ts, expires_at FROM stored WHERE key LIKE 'feat:T1%:latest'""")
def kv_scan(t: Tables) -> DataFrame:
    path = fresh_path(t.spark, "store")
    store.write_store(stored(t), path)
    return store.scan_stored(t.spark, path, "feat:T1*:latest")


@query("batch_enrich_io", f"""WITH {V.NEWS_SQL}, {S.hits()},
{S.DETECTED}, {S.CONTEXT}
SELECT d.news_id, n.event_ts, d.ticker, d.role, round({S.KEYWORD_SCORE}, 6) AS sentiment
FROM detected d JOIN context c USING (news_id) JOIN news n USING (news_id)""")
def batch_enrich_io(t: Tables) -> DataFrame:
    batches = (enrich.enrich_news(V.batched(t)).groupBy("batch_id").agg(
        F.collect_list(F.struct("news_id", "companies")).alias("results")))
    responses = batches.select(F.to_json(F.struct(
        "results", F.size("results").alias("total_articles"),
        F.lit(0.0).alias("processing_time_ms"))).alias("value"))
    return (enrich.batch_enrich_io(V.news(t), responses)
            .withColumn("sentiment", F.round("sentiment", 6)))
