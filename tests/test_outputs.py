"""Concurrent enrichment, joint outputs and the compacted record table."""

import asyncio
import datetime as dt
import os
import threading
import time

import pytest
from helpers import at, news
from pyspark.sql import functions as F

from tidewatch.operators import enrich
from tidewatch.operators.concurrent import InFlight, unordered_enrich
from tidewatch.sources import tables as T
from tidewatch.streaming import jobs

MENTION = [{"ticker": "A", "role": "primary", "sentiment": -0.5}]


# ---- concurrent enrichment ----

def test_slow_hanging_and_failing_calls(spark):
    async def service(row):
        n = int(row["news_id"])
        if n % 10 == 3:
            await asyncio.sleep(3600)
        if n % 10 == 4:
            raise ValueError("bad article")
        await asyncio.sleep(0.05 if n % 10 == 5 else 0)
        return [{"ticker": f"T{n}", "role": "primary", "sentiment": n / 100}] if n % 10 else []

    articles = news(spark, [(f"h{k}", "b") for k in range(100)]).repartition(2)
    start = time.time()
    got = {int(r.news_id): r for r in unordered_enrich(articles, lambda: service, timeout=1.0).collect()}
    assert time.time() - start < 40 and len(got) == 100
    for n, r in got.items():
        want = {3: "timeout", 4: "failed"}.get(n % 10, "answered")
        assert r.outcome == want
        assert [c.ticker for c in r.companies] == ([f"T{n}"] if want == "answered" and n % 10 else [])
    assert set(enrich.to_mention_events(articles.transform(
        lambda a: unordered_enrich(a, lambda: service, timeout=1.0))).columns) >= {"ticker", "sentiment"}


def test_answers_overtake_each_other_and_places_are_bounded():
    now, most = 0, 0

    async def service(row):
        nonlocal now, most
        now += 1
        most = max(most, now)
        await asyncio.sleep(row["wait"])
        now -= 1
        return MENTION

    calls = InFlight(service, 5, 10.0)
    for k in range(20):
        calls.send({"id": k, "wait": 0.3 if k == 0 else 0.01})
    order = [row["id"] for row, _, _ in calls.ready(wait=True)]
    calls.close()
    assert sorted(order) == list(range(20)) and order[-1] == 0 and most == 5


def test_a_hanging_service_holds_no_place_beyond_the_deadline():
    async def hang(row):
        await asyncio.sleep(3600)

    calls, start = InFlight(hang, 10, 0.2), time.time()
    for k in range(40):
        calls.send({"id": k})
    outcomes = [o for _, _, o in calls.ready(wait=True)]
    calls.close()
    assert outcomes == ["timeout"] * 40 and 0.7 < time.time() - start < 10


def test_enrichment_of_no_articles(spark):
    async def service(row):
        return MENTION
    before = threading.active_count()
    assert unordered_enrich(news(spark, [("h", "b")]).where("false"), lambda: service).count() == 0
    assert threading.active_count() <= before + 2


# ---- joint outputs ----

ROWS = "ticker string, window_end timestamp, n int"


def test_a_stop_between_two_outputs_shows_neither(spark, tmp_path):
    joint = T.JointTables(str(tmp_path), history=("ticker", "window_end"), outbox=("ticker", "window_end"))

    def rows(n):
        return spark.createDataFrame([("A", at(n), n)], ROWS)

    def seen():
        return tuple(sorted(r.n for r in rows.collect()) if (rows := joint.tables[t].versions(spark)) is not None
                     else None for t in ("history", "outbox"))
    joint.tables["history"].write(rows(0), 0)
    assert seen() == (None, None)
    joint.write(0, history=rows(0), outbox=rows(0))
    joint.write(1, history=rows(1), outbox=rows(1))
    assert seen() == ([0, 1], [0, 1])
    joint.tables["history"].write(rows(2), 2)  # stopped here
    assert seen() == ([0, 1], [0, 1])
    joint.write(2, history=rows(2), outbox=rows(2))
    assert seen() == ([0, 1, 2], [0, 1, 2])


def test_marks_keep_the_last_two(spark, tmp_path):
    marks = T.Marks(str(tmp_path / "m"))
    assert marks.last(spark) is None
    for n in range(5):
        marks.put(spark, n, n * 10)
    assert marks.last(spark) == (4, 40) and marks.last(spark, 4) == (3, 30)
    assert sorted(os.listdir(tmp_path / "m")) == ["slot0", "slot1"]


# ---- compacted records ----

RECORD = "key string, value string, window_end timestamp, expires_at timestamp"


def record(key, hour, value, days=7):
    end = at(60 * hour)
    return (key, value, end, end + dt.timedelta(days=days))


@pytest.fixture
def store(spark, tmp_path):
    table = T.RecordTable(str(tmp_path / "records"), ("key",))
    for batch, rows in enumerate([
            [record("a:latest", 1, "a1"), record("a:1", 1, "a1"), record("gone", 1, "x", days=0)],
            [record("a:latest", 2, "a2"), record("b:latest", 2, "b2"), record("a:1", 1, "a1 again")],
            [record("a:latest", 5, "a5"), record("c", 5, "c5")]]):
        table.write(spark.createDataFrame(rows, RECORD), batch)
    return table


def values(spark, store):
    return {r.key: r.value for r in store.current(store.versions(spark)).collect()}


def test_compaction_keeps_the_newest_and_drops_the_expired(spark, store):
    now = F.lit("2024-01-01 12:00:00").cast("timestamp")
    before = values(spark, store)
    store.compact(spark, at(60 * 4), now)
    after = values(spark, store)
    assert before["gone"] == "x" and after == {k: v for k, v in before.items() if k != "gone"}
    assert after == {"a:latest": "a5", "a:1": "a1 again", "b:latest": "b2", "c": "c5"}
    base = store.versions(spark).filter(F.col("_hour") < "2024010104")
    assert base.count() == base.select("key").distinct().count() == 3  # one record per key
    store.compact(spark, at(60 * 4), now)  # nothing new is closed
    assert store.base.last(spark)[0] == 0


def test_readers_replays_and_later_batches_beside_a_compaction(spark, store):
    now = F.lit("2024-01-01 12:00:00").cast("timestamp")
    reader = store.versions(spark)  # planned before, read after
    store.compact(spark, at(60 * 4), now)
    assert reader.count() == 8
    store.write(spark.createDataFrame([record("a:latest", 5, "a5"), record("c", 5, "c5")], RECORD), 2)  # replay
    assert values(spark, store)["a:latest"] == "a5"
    store.write(spark.createDataFrame([record("a:latest", 9, "a9")], RECORD), 3)
    store.compact(spark, at(60 * 8), now)
    assert values(spark, store) == {"a:latest": "a9", "a:1": "a1 again", "b:latest": "b2", "c": "c5"}
    hours = sorted(d for d in os.listdir(store.path) if d.startswith("_hour"))
    assert hours == ["_hour=2024010105", "_hour=2024010109"]  # those folded before are gone
    store.compact(spark, at(60 * 24 * 30), F.lit("2024-03-01").cast("timestamp"))
    assert values(spark, store) == {}


def test_feature_job_records_are_the_same_after_compaction(spark, tmp_path):
    tables = jobs.feature_tables(str(tmp_path / "t"))
    schema = "ticker string, slice timestamp, neg long, pos long, first_ts timestamp, first_id string, first_x double, " \
             "last_ts timestamp, n long, tail double"
    for batch, minute in enumerate((5, 65, 66, 200)):
        tables(spark.createDataFrame([("A", at(minute), 1, 0, at(minute), "1", -0.5, at(minute), 1, -0.05)], schema), batch)
    early = F.lit("2024-01-02").cast("timestamp")
    before = {(r.key, r.value) for r in tables.live_records(spark, early).collect()}
    tables.compact(spark, early)
    assert {(r.key, r.value) for r in tables.live_records(spark, early).collect()} == before
    assert tables.records.base.last(spark) == (0, 2024010103)
