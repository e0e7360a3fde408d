"""Streams, fed file by file, against the batch operators on the same rows."""

import json

import pytest
from helpers import at, mentions
from pyspark.sql import functions as F

from tidewatch.functions.codecs import event_time
from tidewatch.operators import alerts, features, ingest, shocks
from tidewatch.plans.stream_queries import finish, to_parquet
from tidewatch.sources import tables as T
from tidewatch.sources.news import read_news_stream
from tidewatch.streaming import jobs
from tidewatch.streaming.state import cooldown_stream, running_features_stream

MENTION = "news_id string, event_ts timestamp, ticker string, sentiment double"
NOW = {"availableNow": True}


class Feed:
    """A folder of parquet files, one added per step."""

    def __init__(self, spark, path, schema=MENTION):
        self.spark, self.path, self.schema, self.rows = spark, str(path), schema, []
        spark.createDataFrame([], schema).write.parquet(self.path)

    def add(self, rows):
        self.rows += rows
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(self.path)

    def stream(self):
        return self.spark.readStream.schema(self.schema).parquet(self.path)

    def batch(self):
        return self.spark.createDataFrame(self.rows, self.schema)


def row(i, t, s, ticker="A"):
    return (f"{i:05d}", t, ticker, s)


def spread(n, ticker_of=lambda i: f"T{i % 3}", step=13):
    return [row(i, at(seconds=i * step), ((i * 37) % 201 - 100) / 100, ticker_of(i)) for i in range(n)]


def test_late_rows_refine_open_windows_only(spark, tmp_path):
    feed = Feed(spark, tmp_path / "in")
    writer, tables = jobs.feature_job(feed.stream(), str(tmp_path / "out"), str(tmp_path / "cp"),
                                      {"processingTime": "0 seconds"})
    started = writer.start()
    try:
        steps = [[row(1, at(10, 30), -0.8)], [row(2, at(20), -0.1)],
                 [row(3, at(10, 45), 0.5), row(4, at(7), 0.9)]]
        for step in steps:
            feed.add(step)
            started.processAllAvailable()
        dropped = sum(s["numRowsDroppedByWatermark"] for p in started.recentProgress
                      for s in p["stateOperators"])
    finally:
        started.stop()
    got = {r.window_end: (r.neg_news_count_5m + r.pos_news_count_5m, r.sentiment_score_5m)
           for r in tables.windows.read(spark).collect()}
    assert {t: v for t, v in got.items() if t < at(20)} == {
        at(11): (1, -0.8), at(12): (1, -0.8), at(13): (1, -0.8),
        at(14): (2, -0.67), at(15): (2, -0.67)}
    assert dropped == 1  # the slice at minute 7, all of whose windows are closed


@pytest.mark.parametrize("restart", [False, True])
def test_feature_job_equals_batch(spark, tmp_path, restart):
    feed = Feed(spark, tmp_path / "in")
    rows = spread(90)
    for start in range(0, 90, 30):
        feed.add(rows[start:start + 30])
        if restart or start == 60:
            writer, tables = jobs.feature_job(feed.stream(), str(tmp_path / "out"), str(tmp_path / "cp"), NOW)
            finish(writer)
    want = features.company_features(feed.batch()).collect()
    assert sorted(tables.windows.read(spark).select(*want[0].__fields__).collect()) == sorted(want)
    live = {r.key for r in tables.live_records(spark).collect()}
    assert "feat:T0:latest" in live and len(live) == len(want) + 3


def test_replayed_batch_changes_nothing(spark, tmp_path):
    feed = Feed(spark, tmp_path / "in")
    feed.add(spread(40))
    writer, tables = jobs.feature_job(feed.stream(), str(tmp_path / "out"), str(tmp_path / "cp"), NOW)
    finish(writer)
    before = sorted(tables.windows.read(spark).collect())
    count = tables.windows.versions(spark).count()
    versions = tables.partials.versions(spark)
    number = versions.agg(F.max("_batch")).first()[0]
    tables(versions.filter(F.col("_batch") == number).drop("_hour", "_batch"), number)
    assert sorted(tables.windows.read(spark).collect()) == before
    assert tables.windows.versions(spark).count() == count


def test_shock_job_equals_batch(spark, tmp_path):
    schema = MENTION + ", headline string"
    feed = Feed(spark, tmp_path / "in", schema)
    rows = [r + (f"h{r[0]}",) for r in spread(80)]
    for part in (rows[:50], rows[50:]):
        feed.add(part)
        writer, tables = jobs.shock_job(feed.stream(), str(tmp_path / "out"), str(tmp_path / "cp"), NOW)
        finish(writer)
    want = shocks.shock_features(feed.batch())
    assert sorted(tables.windows.read(spark).select(*want.columns).collect()) == sorted(want.collect())


def test_alert_job_equals_batch_on_closed_windows(spark, tmp_path):
    feed = Feed(spark, tmp_path / "in")
    rows = spread(500, lambda i: f"T{i % 2}", 20)
    for start in range(0, 500, 125):
        feed.add(rows[start:start + 125])
        writer, tables = jobs.alert_job(feed.stream(), str(tmp_path / "out"), str(tmp_path / "cp"), NOW,
                                        default_threshold=0.5, cooldown_minutes=11)
        finish(writer)
    closed = rows[-1][1] - (at(7) - at(0))
    f = features.company_features(feed.batch()).filter(F.col("window_end") <= F.lit(str(closed)).cast("timestamp"))
    want = alerts.alert_history(alerts.evaluate_alerts(f, default_threshold=0.5, cooldown_minutes=11))
    got = tables.history.read(spark).select(*want.columns)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    assert got.filter("notification_sent").count() > 4
    assert tables.outbox.read(spark).count() == got.filter("notification_sent").count()


@pytest.mark.parametrize("seed", ["zero", "first"])
def test_running_state_across_batches(spark, tmp_path, seed):
    feed = Feed(spark, tmp_path / "in")
    rows = spread(60)
    for part in (rows[:20], rows[20:]):
        feed.add(part)
        finish(running_features_stream(feed.stream(), seed=seed).writeStream.format("parquet")
               .option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp"))
               .trigger(**NOW))
    got = spark.read.parquet(str(tmp_path / "out")).withColumn("sentiment_ewm_7d", F.round("sentiment_ewm_7d", 9))
    want = features.running_features(feed.batch(), seed=seed).withColumn(
        "sentiment_ewm_7d", F.round("sentiment_ewm_7d", 9))
    assert sorted(got.select(*want.columns).collect()) == sorted(want.collect())


def test_text_source_to_mentions_and_dead_letters(spark, tmp_path):
    records = [json.dumps({"news_id": str(i), "headline": "Tesla recall", "url": "u",
                           "published": "2024-01-01T10:00:00Z"}) for i in range(3)] + ["{broken", "null"]
    spark.createDataFrame([(r,) for r in records], "value string").write.text(str(tmp_path / "in"))
    stream = read_news_stream(spark, "text", str(tmp_path / "in"))
    assert stream.columns == ["value", "timestamp"]
    found = to_parquet(jobs.mention_stream(stream))
    assert {r.ticker for r in found.collect()} == {"TSLA"} and found.count() == 3
    bad = to_parquet(ingest.rejected_news(read_news_stream(spark, "text", str(tmp_path / "in"))))
    assert sorted(r.value for r in bad.collect()) == ["null", "{broken"]
    assert to_parquet(jobs.shock_stream(read_news_stream(spark, "text", str(tmp_path / "in")))).count() == 0


def test_event_time_falls_back(spark):
    df = spark.createDataFrame([("2024-01-01T00:00:00Z", at(5)), ("x", at(5)), (None, None)],
                               "t string, r timestamp")
    got = [r.e for r in df.select(event_time(F.col("t"), F.col("r")).alias("e")).collect()]
    assert got[:2] == [at(0), at(5)] and got[2] > at(5)


def test_fan_out_and_console(spark, tmp_path):
    feed = Feed(spark, tmp_path / "in")
    feed.add(spread(10))
    seen = []
    finish(feed.stream().writeStream.foreachBatch(jobs.fan_out(
        lambda b, i: seen.append(b.count()), lambda b, i: seen.append(b.count())))
        .option("checkpointLocation", str(tmp_path / "cp")).trigger(**NOW))
    assert seen == [10, 10]
    finish(T.show_stream(feed.stream()).trigger(**NOW))


def test_micro_batches_are_bounded_by_source_options(spark, tmp_path):
    feed = Feed(spark, tmp_path / "in")
    for part in range(3):
        feed.add(spread(5))
    sizes = []
    stream = spark.readStream.schema(MENTION).option("maxFilesPerTrigger", 1).parquet(feed.path)
    finish(stream.writeStream.foreachBatch(lambda b, i: sizes.append(b.count()))
           .option("checkpointLocation", str(tmp_path / "cp")).trigger(**NOW))
    assert sorted(s for s in sizes if s) == [5, 5, 5]


def test_reading_by_hour_sees_only_those_hours(spark, tmp_path):
    table = T.BatchTable(str(tmp_path / "t"), ("ticker", "window_end"))
    f = features.company_features_tumbling(mentions(spark, [("A", at(m), 0.5) for m in (0, 70, 130)]))
    assert table.versions(spark) is None
    table.write(f, 0)
    assert table.versions(spark, between=(at(65), at(100))).count() == 1
    assert table.versions(spark, between=(at(300), at(400))) is None
    table.write(f.filter(F.col("window_end") < F.lit(str(at(60))).cast("timestamp"))
                .withColumn("risk_score_5m", F.lit(0.123)), 1)
    assert sorted(r.risk_score_5m == 0.123 for r in table.read(spark).collect()) == [False, False, True]
    assert table.versions(spark, upto=0).count() == 3


@pytest.mark.parametrize("seed", ["zero", "first"])
def test_running_job_equals_batch_and_splits_a_hot_ticker(spark, tmp_path, pieces, seed):
    feed = Feed(spark, tmp_path / "in")
    rows = spread(300, lambda i: "HOT" if i % 3 else f"T{i % 5}", 20)
    for part in (rows[:100], rows[100:150], rows[150:]):
        feed.add(part)
        writer, tables = jobs.running_job(feed.stream(), str(tmp_path / "out"), str(tmp_path / "cp"),
                                          NOW, seed=seed)
        finish(writer)
    got = tables.features.read(spark).withColumn("sentiment_ewm_7d", F.round("sentiment_ewm_7d", 9))
    want = features.running_features(feed.batch(), seed=seed).withColumn(
        "sentiment_ewm_7d", F.round("sentiment_ewm_7d", 9))
    assert sorted(got.select(*want.columns).collect()) == sorted(want.collect())


def test_shock_alerts_equal_batch(spark, tmp_path):
    feed = Feed(spark, tmp_path / "in", MENTION + ", headline string")
    rows = [r + (f"h{r[0]}",) for r in spread(400, lambda i: f"T{i % 2}", 15)]
    for part in (rows[:200], rows[200:]):
        feed.add(part)
        writer, tables = jobs.shock_alert_job(feed.stream(), str(tmp_path / "out"), str(tmp_path / "cp"),
                                              NOW, cooldown_minutes=9)
        finish(writer)
    closed = rows[-1][1] - (at(7) - at(0))
    windows = shocks.shock_features(feed.batch()).filter(
        F.col("window_end") <= F.lit(str(closed)).cast("timestamp"))
    want = alerts.shock_alerts(windows, cooldown_minutes=9)
    got = tables.alerts.read(spark).select(*want.columns)
    assert want.count() > 2
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
