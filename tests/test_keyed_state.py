"""Keyed state: lifetime features, cooldown and micro-batches, against the batch definitions."""

import datetime as dt
import random

import pytest
from helpers import at
from pyspark.sql import functions as F
from test_streaming import MENTION, NOW, Feed, spread

from tidewatch.operators import alerts, features
from tidewatch.plans.stream_queries import finish
from tidewatch.streaming import batching, jobs, state

RATED = "ticker string, window_end timestamp, risk_score_5m double, threshold double"
AHEAD = at(60 * 24 * 365)


def micro(n):
    return dt.timedelta(microseconds=n)


def decided(spark, tmp_path, parts, **params):
    feed = Feed(spark, tmp_path / "in", RATED)
    for rows in (*parts, [("ahead", AHEAD, 0.0, 1.0)]):
        feed.add(rows)
        writer, tables = jobs.cooldown_job(feed.stream(), str(tmp_path / "out"), str(tmp_path / "cp"), NOW, **params)
        finish(writer)
    return feed, tables


def test_cooldown_equals_batch_with_late_and_failed_rows(spark, tmp_path):
    rnd = random.Random(4)
    rows = [(t, at(m), rnd.choice([0.2, 0.5, 0.7, 0.9, None]), rnd.choice([0.5, 0.5, None]))
            for m in range(150) for t in ("A", "B")]
    late = [r for r in rows if at(55) < r[1] < at(60) and r[0] == "A"]
    parts = [[r for r in rows if r[1] < at(60) and r not in late], [r for r in rows if r[1] >= at(60)][:6] + late,
             [r for r in rows if r[1] >= at(60)][6:]]
    arrived = F.minute("window_end") % 4 != 1
    feed, tables = decided(spark, tmp_path, parts, delivered=arrived, cooldown_minutes=11)
    batch = spark.createDataFrame(rows, RATED)
    want = alerts.alert_history(alerts.alert_decisions(
        batch.withColumn("ok", arrived), delivered=F.col("ok"), cooldown_minutes=11).drop("ok"))
    got = tables.history.read(spark).select(*want.columns)
    assert got.count() == len(rows)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    assert got.filter("notification_error IS NOT NULL").count() > 2
    assert tables.outbox.read(spark).count() == got.filter("NOT suppressed").count()


def test_cooldown_counts_microseconds_and_equal_times(spark, tmp_path):
    end = at(30) + micro(7)
    rows = [("A", at(0) + micro(7), 0.9, 0.5), ("A", at(0) + micro(7), 0.8, 0.5), ("A", end - micro(1), 0.9, 0.5),
            ("A", end, 0.9, 0.5), ("A", end, 0.4, 0.5)]
    _, tables = decided(spark, tmp_path, [rows[:1], rows[1:]], delay="60 minutes")
    got = sorted((r.window_end, float(r.risk_score), r.notification_sent, r.suppression_reason)
                 for r in tables.history.versions(spark).collect())
    assert got == [(at(0) + micro(7), 0.8, True, None), (at(0) + micro(7), 0.9, False, "cooldown"),
                   (end - micro(1), 0.9, False, "cooldown"), (end, 0.4, False, "threshold_not_met"),
                   (end, 0.9, True, None)]


def test_a_row_later_than_the_delay_is_dropped_and_blocks_expire(spark, tmp_path):
    _, tables = decided(spark, tmp_path, [[("A", at(0), 0.9, 0.5)], [("B", at(100), 0.9, 0.5)],
                                          [("A", at(1), 0.9, 0.5)], [("B", at(200), 0.9, 0.5)]])
    assert {(r.ticker, r.window_end) for r in tables.history.read(spark).collect()} == {
        ("A", at(0)), ("B", at(100)), ("B", at(200))}
    kept = spark.read.format("statestore").option("path", str(tmp_path / "cp")).option(
        "stateVarName", "blocked").load()
    assert kept.filter("key.ticker = 'A'").count() == 0  # gone by its timer


def test_lifetime_state_is_all_a_batch_touches(spark, tmp_path):
    """Rows updated per batch follow the batch, not the age of the stream; a replay changes nothing."""
    feed, updated = Feed(spark, tmp_path / "in"), []
    for part in range(4):
        feed.add([(f"{part}-{i}", at(part, i), f"T{part}-{i}", 0.5) for i in range(10)])
        writer, tables = jobs.running_job(feed.stream(), str(tmp_path / "out"), str(tmp_path / "cp"), NOW)
        query = writer.start()
        query.awaitTermination()
        updated.append(sum(s["numRowsUpdated"] for p in query.recentProgress for s in p["stateOperators"]))
    assert updated == [10] * 4
    before = sorted(tables.features.read(spark).collect())
    tables(tables.features.versions(spark).filter("_batch = 3").drop("_hour", "_batch"), 3)
    assert sorted(tables.features.read(spark).collect()) == before and len(before) == 40


def test_state_takes_new_fields(spark, tmp_path):
    class WiderState(state.RunningState):
        """A later version that counts all mentions as well."""

        def init(self, handle):
            self.so_far = handle.getValueState("so_far", "neg long, pos long, ewm double, seen long")

        def handleInputRows(self, key, rows, timerValues):
            import pandas as pd
            batch = pd.concat(list(rows))
            neg, pos, ewm, seen = self.so_far.get() if self.so_far.exists() else (0, 0, 0.0, 0)
            seen = (seen or 0) + len(batch)
            self.so_far.update((neg, pos, ewm, seen))
            yield pd.DataFrame({"ticker": [key[0]], "pos": [pos], "seen": [seen]})

    feed, cp = Feed(spark, tmp_path / "in"), str(tmp_path / "cp")
    feed.add([("1", at(0), "A", 0.5), ("2", at(1), "A", 0.5)])
    finish(state.running_features_stream(feed.stream()).writeStream.format("noop")
           .option("checkpointLocation", cp).trigger(**NOW))
    feed.add([("3", at(2), "A", 0.5)])
    seen = []
    rows = state.with_state(feed.stream()).select("ticker", "event_ts", "news_id", "sentiment")
    finish(rows.groupBy("ticker").transformWithStateInPandas(
        WiderState(0.1, "zero"), "ticker string, pos long, seen long", "Append", "None")
        .writeStream.foreachBatch(lambda df, _: seen.extend(map(tuple, df.collect())))
        .option("checkpointLocation", cp).trigger(**NOW))
    assert seen == [("A", 2, 1)]


# ---- slices ----

def test_state_holds_a_mention_once(spark, tmp_path):
    feed = Feed(spark, tmp_path / "in")
    feed.add(spread(60))
    writer, _ = jobs.feature_job(feed.stream(), str(tmp_path / "out"), str(tmp_path / "cp"), NOW)
    query = writer.start()
    query.awaitTermination()
    rows = max(s["numRowsTotal"] for p in query.recentProgress for s in p["stateOperators"])
    assert rows <= 60  # the windows' own slices would be five times as many


def test_clock_is_kept_over_empty_batches_and_replays(spark, tmp_path):
    tables = jobs.feature_tables(str(tmp_path / "t"))
    schema = "ticker string, slice timestamp, neg long, pos long, first_ts timestamp, first_id string, first_x double, " \
             "last_ts timestamp, n long, tail double"

    def slice_of(minute, x):
        return spark.createDataFrame([("A", at(minute), int(x < 0), int(x > 0), at(minute), "1", x, at(minute), 1,
                                       0.1 * x)], schema)
    tables(slice_of(30, 0.5), 0)
    tables(spark.createDataFrame([], schema), 1)
    for _ in range(2):
        tables(slice_of(20, -0.5), 2)  # windows that end at 21, 22 and 23 are closed
    got = {r.window_end: r.neg_news_count_5m for r in tables.windows.read(spark).collect()}
    assert got == {at(24): 1, at(25): 1, **{at(31 + k): 0 for k in range(5)}}
    assert tables.clock.last(spark) == (2, int((at(30) - dt.datetime(1970, 1, 1)).total_seconds()) * 1_000_000)


# ---- micro-batches ----

def plain_groups(rows, most, span):
    out, lanes = [], {}
    for lane, t, name in sorted(rows):
        lanes.setdefault(lane, []).append((t, name))
    for lane, own in lanes.items():
        k = 0
        while k < len(own):
            end = k
            while end < len(own) and end - k < most and own[end][0] - own[k][0] < span:
                end += 1
            out.append((lane, own[k][0], [n for _, n in own[k:end]]))
            k = end
    return sorted(out)


def test_groups_of_rows_or_milliseconds(spark, tmp_path):
    rnd, schema = random.Random(6), "lane int, arrived timestamp, name string"
    rows, t = [], at(0)
    for k in range(400):
        t += rnd.choice([micro(0), micro(1), dt.timedelta(milliseconds=rnd.choice([5, 90, 999, 1000]))])
        rows.append((rnd.randint(0, 1), t, f"n{k:03d}"))
    feed, got = Feed(spark, tmp_path / "in", schema), []
    middle = rows[200][1]
    late = [r for r in rows if middle - dt.timedelta(milliseconds=400) < r[1] < middle]
    first = [r for r in rows if r[1] < middle and r not in late]
    for part in (first, [r for r in rows if r not in first], [(k, AHEAD, "ahead") for k in (0, 1)]):
        feed.add(part)
        finish(batching.micro_batches(feed.stream(), ["lane"], "arrived", 7).writeStream.foreachBatch(
            lambda df, _: got.extend(df.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(**NOW))
    assert sorted((r.lane, r.first_at, [x.name for x in r.rows]) for r in got) == plain_groups(
        rows, 7, dt.timedelta(seconds=1))
    assert {len(r.rows) for r in got} > {1, 7}


@pytest.mark.parametrize("until, sizes", [(999, []), (1000, [3]), (6000, [3, 1])])
def test_an_open_group_waits(until, sizes):
    assert batching.cut([0, 1, 2, 5000], 10, 1000, until) == sizes
    assert batching.cut([0, 1, 2, 5000], 2, 1000, until)[:1] == [2]


def test_lifetime_features_of_a_null_ticker_are_left_out(spark, tmp_path):
    feed = Feed(spark, tmp_path / "in", MENTION)
    feed.add([("1", at(0), None, 0.5), ("2", at(0), "A", None), ("3", at(1), "A", 0.5)])
    writer, tables = jobs.running_job(feed.stream(), str(tmp_path / "out"), str(tmp_path / "cp"), NOW)
    finish(writer)
    assert tables.features.read(spark).count() == features.running_features(feed.batch()).count() == 1


# ---- many rows, many partitions ----

def test_rows_of_the_cooldown_wait_in_chunks(spark, tmp_path):
    rows = [("A", at(m), 0.9, 0.5) for m in range(2000)]
    feed = Feed(spark, tmp_path / "in", RATED)
    feed.add(rows)
    decided_rows = state.cooldown_stream(feed.stream(), delay="3000 minutes")
    query = (decided_rows.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "cp"))
             .trigger(**NOW).start())
    query.awaitTermination()
    assert max(s["numRowsTotal"] for p in query.recentProgress for s in p["stateOperators"]) < 50


def test_a_keyed_job_begins_with_state_partitions_by_cores(spark, tmp_path):
    before = spark.conf.get(state.PARTITIONS)
    spark.conf.set(state.PARTITIONS, "40")
    try:
        _, tables = decided(spark, tmp_path, [[("A", at(0), 0.9, 0.5), ("B", at(1), 0.2, 0.5)]])
        assert spark.conf.get(state.PARTITIONS) == "40"
        feed = Feed(spark, tmp_path / "mentions")
        feed.add(spread(20))
        finish(jobs.running_job(feed.stream(), str(tmp_path / "run"), str(tmp_path / "cp2"), NOW)[0])
    finally:
        spark.conf.set(state.PARTITIONS, before)
    most = state.PER_CORE * spark.sparkContext.defaultParallelism
    for checkpoint in ("cp", "cp2"):
        folders = [f for f in (tmp_path / checkpoint / "state" / "0").iterdir() if f.name.isdigit()]
        assert 0 < len(folders) <= most
    assert tables.history.read(spark).count() == 2


@pytest.mark.parametrize("times", [1, 40, 10_000])
def test_ids_decide_only_among_equal_times(times):
    import pandas as pd
    rnd = random.Random(times)
    rows = pd.DataFrame({"event_ts": pd.to_datetime([rnd.randrange(times) for _ in range(500)], unit="s"),
                         "news_id": [rnd.choice([None, f"{rnd.randrange(400)}"]) for _ in range(500)],
                         "sentiment": [float(k) for k in range(500)]})
    want = rows.sort_values(["event_ts", "news_id"], kind="stable")
    assert state.in_order(rows).equals(want)


def test_state_of_the_alert_job_holds_a_mention_once(spark, tmp_path):
    feed = Feed(spark, tmp_path / "in")
    feed.add(spread(60))
    writer, tables = jobs.alert_job(feed.stream(), str(tmp_path / "out"), str(tmp_path / "cp"), NOW)
    query = writer.start()
    query.awaitTermination()
    rows = max(s["numRowsTotal"] for p in query.recentProgress for s in p["stateOperators"])
    assert 0 < rows <= 60  # the closed windows' own slices would be five times as many
    assert tables.history.read(spark).count() > 0


def test_a_late_mention_counts_for_open_windows_only_and_a_replay_changes_nothing(spark, tmp_path):
    feed = Feed(spark, tmp_path / "in")
    parts = [[("1", at(0, 30), "A", -0.5), ("2", at(10), "A", 0.5)],  # closed up to minute 3 after it
             [("3", at(0, 45), "A", -0.9)], [("4", at(60), "A", 0.5)]]
    for part in parts:
        feed.add(part)
        writer, tables = jobs.alert_job(feed.stream(), str(tmp_path / "out"), str(tmp_path / "cp"), NOW)
        finish(writer)
    got = {r.window_end: float(r.risk_score) for r in tables.history.read(spark).collect()}
    want = {k: alone for s, ends in (([-0.5], (1, 2, 3)), ([-0.5, -0.9], (4, 5)), ([0.5], range(11, 16)))
            for alone in [float(features.company_features(spark.createDataFrame(
                [(str(i), at(0, 30 + i), "A", x) for i, x in enumerate(s)], MENTION)).first().risk_score_5m)]
            for k in map(at, ends)}
    assert got == want
    last = tables.clock.last(spark)[0]
    tables(tables.slices.versions(spark).filter(F.col("_batch") == last).drop("_hour", "_batch"), last)
    assert {r.window_end: float(r.risk_score) for r in tables.history.read(spark).collect()} == want
