"""Queries: streaming jobs run over the whole tables until the input is used up.

The results must equal the batch results, so the SQL is the batch SQL.
"""

from __future__ import annotations

import asyncio

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from tidewatch.functions.codecs import event_time
from tidewatch.operators import alerts, enrich, ingest
from tidewatch.operators.concurrent import unordered_enrich
from tidewatch.plans import sqlparts as S
from tidewatch.plans import views as V
from tidewatch.plans.alert_queries import FEATURES
from tidewatch.plans.catalog import SQL, query
from tidewatch.plans.detect_queries import ENRICHED, SCORE
from tidewatch.plans.feature_queries import FEATURES_SQL
from tidewatch.plans.views import Tables
from tidewatch.session import fresh_path
from tidewatch.sources.news import read_news_stream
from tidewatch.sources.tables import BatchTable, staged
from tidewatch.streaming import jobs
from tidewatch.streaming.batching import micro_batches

UNTIL_DONE = {"availableNow": True}


class StreamedTables(Tables):
    """The same tables, read as streams. The one-name glob reads a file as well as a folder of part
    files."""

    def __getattr__(self, name: str) -> DataFrame:
        folder = self.path.rstrip("/")
        schema = self.spark.read.parquet(f"{folder}/{name}.parquet").schema
        return self.spark.readStream.schema(schema).parquet(f"{folder}/{{{name}.parquet}}")


def streamed(t: Tables) -> StreamedTables:
    return StreamedTables(t.spark, t.path)


def finish(writer: DataStreamWriter) -> None:
    started = writer.start()
    try:
        started.awaitTermination()
    finally:
        started.stop()


def to_parquet(df: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream into a parquet folder and reads that."""
    spark = df.sparkSession
    out = fresh_path(spark, "out")
    finish(df.writeStream.format("parquet").outputMode(mode).option("path", out)
           .option("checkpointLocation", fresh_path(spark, "checkpoint")).trigger(**UNTIL_DONE))
    return spark.read.schema(df.schema).parquet(out)


def _root(t: Tables) -> tuple[str, str]:
    return fresh_path(t.spark, "tables"), fresh_path(t.spark, "checkpoint")


@query("src_news_stream", SQL["parse_news"])
def src_news_stream(t: Tables) -> DataFrame:
    folder = fresh_path(t.spark, "records")
    V.raw_records(t).select("value").write.text(folder)
    articles = ingest.parse_news(read_news_stream(t.spark, "text", folder))
    return to_parquet(articles.drop("record_ts"))  # the time the file was read at


@query("st_event_time", f"""WITH {V.NEWS_SQL}
SELECT news_id, CASE WHEN doc_id % 3 = 1 THEN TIMESTAMP '2024-06-01' ELSE event_ts END AS event_ts FROM news""")
def st_event_time(t: Tables) -> DataFrame:
    d = F.col("news_id").cast("long")
    text = F.when(d % 3 == 1, "yesterday").otherwise(F.col("published"))
    record = F.lit("2024-06-01").cast("timestamp")
    rows = V.news(streamed(t)).select("news_id", event_time(text, record).alias("event_ts"))
    return to_parquet(rows)


@query("st_features", FEATURES_SQL)
def st_features(t: Tables) -> DataFrame:
    writer, tables = jobs.feature_job(V.mentions(streamed(t)), *_root(t), UNTIL_DONE)
    finish(writer)
    return tables.windows.read(t.spark)


@query("st_upsert", f"""{V.FEATURES_CTE}
SELECT 'feat:' || ticker || ':' || CAST(CAST(epoch(window_end) AS BIGINT) AS VARCHAR) AS key, window_end, risk_score_5m FROM features
UNION ALL SELECT 'feat:' || ticker || ':latest' AS key, window_end, risk_score_5m FROM features
QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY window_end DESC) = 1""")
def st_upsert(t: Tables) -> DataFrame:
    writer, tables = jobs.feature_job(V.mentions(streamed(t)), *_root(t), UNTIL_DONE)
    finish(writer)
    value = F.from_json("value", "risk_score_5m double")
    return tables.live_records(t.spark).select("key", "window_end", value["risk_score_5m"]
                                               .alias("risk_score_5m"))


@query("st_exactly_once", FEATURES_SQL)
def st_exactly_once(t: Tables) -> DataFrame:
    """Stopped after all input, started again from its checkpoint, last batch replayed."""
    root, checkpoint = _root(t)
    for _ in range(2):
        writer, tables = jobs.feature_job(V.mentions(streamed(t)), root, checkpoint, UNTIL_DONE)
        finish(writer)
    last = tables.partials.versions(t.spark)
    newest = last.agg(F.max("_batch")).first()[0]
    tables(last.filter(F.col("_batch") == newest).drop("_hour", "_batch"), newest)
    return tables.windows.read(t.spark)


@query("st_shocks", SQL["shock_features_articles"])
def st_shocks(t: Tables) -> DataFrame:
    s = streamed(t)
    rows = V.article_shocks(s).withColumn("sentiment", F.round("sentiment", 6))
    writer, tables = jobs.shock_job(rows, *_root(t), UNTIL_DONE)
    finish(writer)
    return tables.windows.read(t.spark).withColumn(
        "shock_headlines", F.array_join("shock_headlines", "|"))


@query("st_unordered_enrich", f"""{ENRICHED}
SELECT d.news_id, n.event_ts, d.ticker, d.role, {SCORE} AS sentiment
FROM detected d JOIN context USING (news_id) JOIN news n USING (news_id)
WHERE doc_id % 97 <> 5 AND doc_id % 89 <> 3""")
def st_unordered_enrich(t: Tables) -> DataFrame:
    """A service that answers after up to a few milliseconds, in any order; it never answers some
    articles and fails on others, which then mention nothing."""
    async def answer(row: dict) -> list[dict]:
        number = int(row["news_id"])
        if number % 97 == 5:
            await asyncio.sleep(3600)
        if number % 89 == 3:
            raise ConnectionError("no answer")
        await asyncio.sleep(number % 7 / 1000)
        return row["known"]

    known = enrich.enrich_news(V.news(streamed(t))).withColumnRenamed("companies", "known")
    rows = enrich.to_mention_events(unordered_enrich(known, lambda: answer, timeout=2.0))
    return to_parquet(rows.withColumn("sentiment", F.round("sentiment", 6)))


@query("st_running_features", SQL["running_features"])
def st_running_features(t: Tables) -> DataFrame:
    writer, tables = jobs.running_job(V.mentions(streamed(t)), *_root(t), UNTIL_DONE)
    finish(writer)
    return tables.features.read(t.spark).withColumn(
        "sentiment_ewm_7d", F.round("sentiment_ewm_7d", 6))


@query("st_cooldown", SQL["alert_cooldown_default"])
def st_cooldown(t: Tables) -> DataFrame:
    """Three batches: every other window of the last minutes of the first one comes late, in the
    second; the third holds a row far ahead, behind which all others are decided."""
    folder = fresh_path(t.spark, "features")
    rated = staged(alerts.lookup_threshold(V.company_windows(t)), "rated")
    end = F.unix_seconds("window_end")
    low, high = rated.agg(F.min(end), F.max(end)).first()
    middle = ((low or 0) + (high or 0)) // 2
    second = (end > middle) | ((end > middle - 300) & (F.minute("window_end") % 2 == 0))
    ahead = rated.limit(1).withColumns({"ticker": F.lit("ahead"), "risk_score_5m": F.lit(0.0),
                                        "window_end": F.timestamp_seconds(F.lit((high or 0) + 86_400))})
    root, checkpoint = _root(t)
    for part in (rated.filter(~second), rated.filter(second), ahead):
        part.write.mode("append").parquet(folder)
        stream = t.spark.readStream.schema(rated.schema).parquet(folder)
        writer, tables = jobs.cooldown_job(stream, root, checkpoint, UNTIL_DONE)
        finish(writer)
    return tables.history.read(t.spark).select(
        "ticker", "window_end", F.col("risk_score").cast("double").alias("risk_score_5m"),
        F.col("threshold").cast("double").alias("threshold"),
        F.when(F.col("notification_sent"), "sent").otherwise("suppressed").alias("status"),
        F.col("suppression_reason").alias("reason"))


# a window is closed once the newest event is 7 minutes past its end
CLOSED = "window_end <= (SELECT max(event_ts) FROM mentions) - INTERVAL 7 MINUTE"
COUNTED = f"""WITH {V.MENTIONS_SQL}, {V.windows_sql("mentions")},
counted AS (SELECT ticker, window_end, count(*) AS mentions FROM spread GROUP BY ticker, window_end)"""


def _counts(t: Tables) -> DataFrame:
    rows = jobs.watermarked(V.mentions(streamed(t)))
    return (rows.groupBy(F.window("event_ts", "5 minutes", "1 minute").alias("w"), "ticker")
            .agg(F.count("*").alias("mentions"))
            .select("ticker", F.col("w.end").alias("window_end"), "mentions"))


@query("st_watermark", f"{COUNTED} SELECT * FROM counted WHERE {CLOSED}")
def st_watermark(t: Tables) -> DataFrame:
    return to_parquet(_counts(t))


@query("st_state_read", f"{COUNTED} SELECT * FROM counted WHERE NOT ({CLOSED})")
def st_state_read(t: Tables) -> DataFrame:
    """The windows still open, read from the state of the finished query."""
    checkpoint = fresh_path(t.spark, "checkpoint")
    finish(_counts(t).writeStream.format("parquet").option("path", fresh_path(t.spark, "out"))
           .option("checkpointLocation", checkpoint).trigger(**UNTIL_DONE))
    state = t.spark.read.format("statestore").load(checkpoint)
    return state.select(F.col("key.ticker").alias("ticker"),
                        F.col("key").getField(state.schema["key"].dataType.names[0])["end"].alias("window_end"),
                        F.col("value.count").alias("mentions"))


def dated_records(t: Tables) -> DataFrame:
    """The articles as JSON records with a time of their own; some publication times do not parse."""
    d = F.col("news_id").cast("long")
    rows = V.news(t).withColumn("published", F.when(d % 5 == 1, "yesterday").when(d % 5 == 2, "12:30")
                                .when(d % 5 == 3, "").otherwise(F.col("published")))
    return rows.select(
        F.to_json(F.struct("news_id", "headline", "url", "published", "full_text")).alias("value"),
        V.after_start(d * 7 + F.when((d % 5).between(1, 3), 3600).otherwise(0)).alias("timestamp"))


ARRIVED = """CASE WHEN doc_id % 5 BETWEEN 1 AND 3 THEN event_ts + INTERVAL 1 HOUR ELSE event_ts END"""


@query("st_news_job", f"""{ENRICHED},
arrived AS (SELECT d.news_id, {ARRIVED} AS event_ts, d.ticker, {SCORE} AS sentiment
  FROM detected d JOIN context USING (news_id) JOIN news n USING (news_id)),
{V.windows_sql("arrived")}
SELECT ticker, window_end, CAST(count(*) FILTER (sentiment < 0) AS INTEGER) AS negative,
       CAST(count(*) FILTER (sentiment > 0) AS INTEGER) AS positive
FROM spread GROUP BY ticker, window_end""")
def st_news_job(t: Tables) -> DataFrame:
    """The standard job from raw records: an article whose publication time does not parse is taken
    at its record's time and reaches its windows."""
    stream = jobs.mention_stream(dated_records(streamed(t)))
    writer, tables = jobs.feature_job(stream, *_root(t), UNTIL_DONE)
    finish(writer)
    return tables.windows.read(t.spark).select(
        "ticker", "window_end", F.col("neg_news_count_5m").alias("negative"),
        F.col("pos_news_count_5m").alias("positive"))


@query("st_dead_letter", f"""WITH {V.NEWS_SQL}
SELECT news_id AS record_id, doc_id % 11 AS fault FROM news WHERE doc_id % 11 IN (1, 2, 3, 4, 5, 7)""")
def st_dead_letter(t: Tables) -> DataFrame:
    """Broken records go to the quarantine folder."""
    records = V.raw_records(streamed(t))
    path, checkpoint = _root(t)
    finish(jobs.quarantine_job(records, path, checkpoint, UNTIL_DONE))
    return t.spark.read.schema(records.schema).parquet(path).select(
        "record_id", (F.col("record_id").cast("long") % 11).alias("fault"))


@query("sink_fanout", f"""{FEATURES},
rated AS (SELECT ticker, window_end, risk_score_5m, 0.7::DOUBLE AS threshold FROM features WHERE {CLOSED}),
{S.cooldown("rated")}
SELECT 'history' AS sink, ticker, window_end, CAST(risk_score_5m AS DECIMAL(6,3)) AS risk_score, status = 'sent' AS notification_sent, reason AS suppression_reason FROM decided
UNION ALL
SELECT 'outbox' AS sink, ticker, window_end, CAST(risk_score_5m AS DECIMAL(6,3)) AS risk_score, true AS notification_sent, NULL AS suppression_reason FROM decided WHERE status = 'sent'""")
def sink_fanout(t: Tables) -> DataFrame:
    """Closed windows into the alert history and the outbox by one query, both under one manifest."""
    writer, tables = jobs.alert_job(V.mentions(streamed(t)), *_root(t), UNTIL_DONE)
    finish(writer)
    history = tables.history.read(t.spark).select(
        F.lit("history").alias("sink"), "ticker", "window_end", "risk_score", "notification_sent",
        "suppression_reason")
    risk = F.get_json_object("payload", "$.attachments[0].fields[0].value")
    outbox = tables.outbox.read(t.spark).select(
        F.lit("outbox").alias("sink"), "ticker", "window_end", risk.cast("decimal(6,3)").alias("risk_score"),
        F.lit(True).alias("notification_sent"), F.lit(None).cast("string").alias("suppression_reason"))
    return history.unionByName(outbox)


@query("st_sliding", f"{COUNTED} SELECT * FROM counted")
def st_sliding(t: Tables) -> DataFrame:
    """Sliding counts from slices: every refined window is upserted."""
    writer, tables = jobs.count_job(V.mentions(streamed(t)), *_root(t), UNTIL_DONE)
    finish(writer)
    return tables.windows.read(t.spark)


LATE = f"""WITH {V.MENTIONS_SQL},
late AS (SELECT news_id || '-late' AS news_id, event_ts, ticker, role, -sentiment AS sentiment, event_id FROM mentions),
spread AS (
  SELECT m.*, date_trunc('minute', event_ts) + to_minutes(k) AS window_end FROM mentions m, range(1, 6) AS r(k)
  UNION ALL
  SELECT l.*, date_trunc('minute', event_ts) + to_minutes(k) AS window_end FROM late l, range(1, 6) AS r(k)
  WHERE NOT (date_trunc('minute', event_ts) + to_minutes(k) <= (SELECT max(event_ts) FROM mentions) - INTERVAL 7 MINUTE)),
{V.features_sql("spread")}"""


@query("st_lateness", f"""{LATE} SELECT ticker, window_end, neg_news_count_5m, pos_news_count_5m,
  sentiment_score_5m, risk_score_5m FROM features""")
def st_lateness(t: Tables) -> DataFrame:
    """All mentions, and then all of them again as late rows: only open windows may change."""
    folder = fresh_path(t.spark, "mentions")
    root, checkpoint = _root(t)
    rows = V.mentions(t)
    late = rows.withColumns({"news_id": F.concat("news_id", F.lit("-late")),
                             "sentiment": -F.col("sentiment")})
    for part in (rows, late):
        part.write.mode("append").parquet(folder)
        stream = t.spark.readStream.schema(rows.schema).parquet(folder)
        writer, tables = jobs.feature_job(stream, root, checkpoint, UNTIL_DONE)
        finish(writer)
    return tables.windows.read(t.spark)


def arrivals(t: Tables) -> DataFrame:
    """Events as articles that arrive in bursts on four lanes: sixty within 1.2 seconds, then a
    pause."""
    e = F.col("event_id")
    ms = F.floor(e / 60) * 2300 + (e % 60) * 20
    return t.events.select(
        e.cast("string").alias("news_id"), (F.col("user_id") % 4).cast("int").alias("lane"),
        F.timestamp_millis(F.lit(1_704_067_200_000) + ms).alias("arrived"))


@query("st_batching", """WITH RECURSIVE arrived AS (
  SELECT CAST(event_id AS VARCHAR) AS news_id, CAST(user_id % 4 AS INTEGER) AS lane,
         (event_id // 60) * 2300 + (event_id % 60) * 20 AS ms FROM events),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY lane ORDER BY ms, news_id) AS i,
         count(*) OVER (PARTITION BY lane ORDER BY ms RANGE BETWEEN CURRENT ROW AND 999 FOLLOWING) AS within,
         rank() OVER (PARTITION BY lane ORDER BY ms) AS first_i FROM arrived),
jumps AS (
  SELECT *, least(10, within - (i - first_i)) AS n FROM numbered),
groups AS (
  SELECT lane, i, n, news_id FROM jumps WHERE i = 1
  UNION ALL
  SELECT j.lane, j.i, j.n, j.news_id FROM groups g JOIN jumps j ON j.lane = g.lane AND j.i = g.i + g.n)
SELECT lane, news_id AS first_id, CAST(n AS INTEGER) AS size FROM groups""")
def st_batching(t: Tables) -> DataFrame:
    """Ten articles or 1,000 ms, whichever comes first, over several micro-batches; a last row far
    ahead drains what is left."""
    folder = fresh_path(t.spark, "arrivals")
    rows = arrivals(t)
    root, checkpoint = _root(t)
    third = F.floor(F.unix_millis("arrived") / 2300) % 3
    ahead = t.spark.range(4).select(F.lit("ahead").alias("news_id"), F.col("id").cast("int").alias("lane"),
                                    F.lit("2124-01-01").cast("timestamp").alias("arrived"))
    newest = F.max("arrived")
    halves = rows.agg(F.min("arrived").alias("a"), newest.alias("b"))
    middle = halves.select(F.timestamp_millis(((F.unix_millis("a") + F.unix_millis("b")) / 2).cast("long"))
                           .alias("middle"))
    marked = staged(rows.crossJoin(F.broadcast(middle)).select(
        "*", (F.col("arrived") > F.col("middle")).alias("second")), "arrivals")
    for part in (marked.filter("NOT second"), marked.filter("second"), ahead):
        part.select(*rows.columns).write.mode("append").parquet(folder)
        stream = t.spark.readStream.schema(rows.schema).parquet(folder)
        groups = micro_batches(stream, ["lane"], "arrived")
        table = BatchTable(root, ("lane", "first_at", "number"), "first_at")
        finish(groups.writeStream.foreachBatch(table.write).option("checkpointLocation", checkpoint)
               .trigger(**UNTIL_DONE))
    return table.read(t.spark).select(
        "lane", F.col("rows")[0]["news_id"].alias("first_id"), F.size("rows").alias("size"))
