import datetime as dt
import json
import random

import pytest
from helpers import START, at, mentions
from pyspark.sql import functions as F

from tidewatch.operators import enrich, features, ingest, metrics, store

GOOD = {"headline": "h", "url": "u", "published": "2024-01-01T10:00:00Z"}


@pytest.mark.parametrize("change, want", [
    ({}, None), ({"headline": ""}, "headline is required"), ({"headline": None}, "headline is required"),
    ({"url": ""}, "url is required"), ({"published": None}, "published is required"),
    ({"published": "invalid-date"}, "published must be valid ISO-8601 format"),
    ({"published": "2024-01-01T10:00:00"}, "published must be valid ISO-8601 format"),
    ({"published": "2024-13-01T10:00:00Z"}, "published must be valid ISO-8601 format"),
    ({"published": "2024-01-01T10:00:00.123+05:30"}, None),
    ({"headline": "", "url": ""}, "headline is required"),
])
def test_validation(spark, change, want):
    row = {**GOOD, **change}
    df = spark.createDataFrame([(row["headline"], row["url"], row["published"])],
                               "headline string, url string, published string")
    assert ingest.validate_news(df).first().rejection == want


def test_parse_and_quarantine(spark):
    whole = json.dumps({**GOOD, "news_id": "1", "full_text": "ünïcode \"q\""})
    raw = [whole, whole[:-1], '{"invalid": json}', '{"ticker": "AAPL"}', "", "null", "[]", "[1]",
           json.dumps({**GOOD, "news_id": "2"}), json.dumps(GOOD)]
    df = spark.createDataFrame([(r,) for r in raw], "value string")
    good = ingest.parse_news(df).orderBy("news_id").collect()
    assert [(r.news_id, r.full_text) for r in good] == [("1", 'ünïcode "q"'), ("2", None)]
    assert ingest.rejected_news(df).count() == len(raw) - 2


def test_request_and_batch_checks(spark):
    df = spark.createDataFrame([("1", "h"), (" ", "h"), ("1", "\n "), (None, None)],
                               "news_id string, headline string")
    assert [r.status_code for r in ingest.validate_enrich_request(df).collect()] == [200, 422, 400, 422]
    rows = [("a", str(i)) for i in range(100)] + [("b", str(i)) for i in range(101)] + [("c", None)]
    got = {r.batch_id: (r.batch_size, r.status_code) for r in ingest.validate_batch(
        spark.createDataFrame(rows, "batch_id string, news_id string")).collect()}
    assert got == {"a": (100, 200), "b": (101, 400), "c": (0, 400)}


def test_ids_and_topic_records(spark):
    df = spark.createDataFrame([("h", "u", "p", "")], "headline string, url string, published string, full_text string")
    first, again = (ingest.assign_news_id(df).first().news_id for _ in range(2))
    assert first == again
    assert ingest.assign_news_id(df, random=True).first().news_id != first
    record = ingest.topic_records(ingest.assign_news_id(df)).first()
    assert record.key == first and "full_text" not in json.loads(record.value)
    assert ingest.sanitize(spark.createDataFrame([("\t a b \n",)], "x string"), "x").first().x == "a b"


def test_store_keys_ttl_and_overwrite(spark):
    f = features.company_features_tumbling(mentions(spark, [("TSLA", dt.datetime(2024, 1, 1, 11, 56), 0.5)]))
    ts = F.lit("2024-01-01 12:00:05").cast("timestamp")
    records = store.keyed_records(f, ingest_ts=ts)
    keys = {r.key: r for r in records.collect()}
    assert set(keys) == {"feat:TSLA:1704110400", "feat:TSLA:latest"}
    value = json.loads(keys["feat:TSLA:latest"].value)
    assert value["window_end"] == "2024-01-01T12:00:00Z" and value["_ver"] == "v1"
    assert value["_ingest_ts"] == "2024-01-01T12:00:05Z"
    later = store.keyed_records(f.withColumn("risk_score_5m", F.lit(0.9)),
                                ingest_ts=ts + F.expr("INTERVAL 1 MINUTE"))
    merged = store.upsert(records, later)
    assert merged.count() == 2
    assert json.loads(store.lookup(merged, "feat:TSLA:latest").first().value)["risk_score_5m"] == 0.9
    end = F.lit("2024-01-08 12:01:05").cast("timestamp")
    assert store.live(merged, end).count() == 0
    assert store.live(merged, end - F.expr("INTERVAL 1 SECOND")).count() == 2
    assert store.scan(merged, "feat:*:latest").count() == 1
    assert store.scan(merged, "shock:*").count() == 0


def test_latest_keeps_the_newest_window_whatever_the_write_order(spark):
    rows = [("A", at(i), i / 10.0) for i in range(6)]
    f = spark.createDataFrame([(k, t, r) for k, t, r in rows], "ticker string, window_end timestamp, risk_score_5m double")
    late_first = F.lit(START).cast("timestamp") - (F.col("window_end") - F.lit(START).cast("timestamp"))
    out = store.last_write_wins(store.keyed_records(f, ingest_ts=late_first))
    assert out.count() == 7
    assert json.loads(store.lookup(out, "feat:A:latest").first().value)["risk_score_5m"] == 0.5


def test_batch_responses(spark):
    news = spark.createDataFrame([("1", "h", "u", "2024-01-01T00:00:00Z", None)],
                                 "news_id string, headline string, url string, published string, full_text string")
    body = json.dumps({"results": [{"news_id": "1", "companies": [
        {"ticker": "A", "role": "primary", "sentiment": -0.5}]}, {"news_id": "9", "companies": []}],
        "total_articles": 2, "processing_time_ms": 1.5})
    df = spark.createDataFrame([(body,), ("broken",)], "value string")
    got = enrich.batch_enrich_io(news, df).collect()
    assert [(r.ticker, r.sentiment, r.event_ts) for r in got] == [("A", -0.5, START)]


def test_latency_and_histogram(spark, pieces):
    values = [float(i % 50) for i in range(997)] + [7.0] * 1000
    df = spark.createDataFrame([("all", v) for v in values], "k string, v double")
    got = metrics.latency_summary(df, "k", "v").first()
    ordered = sorted(values)
    n = len(values)
    assert (got.n, got.min_value, got.max_value) == (n, 0.0, 49.0)
    assert got.median_value == (ordered[(n - 1) // 2] + ordered[n // 2]) / 2
    assert got.p95_value == ordered[int(n * 0.95)] and got.p99_value == ordered[int(n * 0.99)]
    hist = {r.le: r.observations for r in metrics.cumulative_histogram(df, "v", [1.0, 10.0]).collect()}
    assert hist == {"1.0": sum(v <= 1 for v in values), "10.0": sum(v <= 10 for v in values), "+Inf": n}


def test_null_key_is_a_group_of_its_own(spark, pieces):
    df = spark.createDataFrame([(None, float(i)) for i in range(500)] + [("a", 1.0)],
                               "k string, v double")
    got = {r.k: (r.n, r.median_value, r.max_value) for r in metrics.latency_summary(df, "k", "v").collect()}
    assert got == {None: (500, 249.5, 499.0), "a": (1, 1.0, 1.0)}
    ranks = sorted(r["rank"] for r in metrics.ranked(df, "k", "v").filter("k IS NULL").collect())
    assert ranks == list(range(500))


def test_incomplete_times_are_null(spark):
    from tidewatch.functions.codecs import parse_iso
    texts = ["12:30", "T10:00", "2024", "2024-01-01", "yesterday", "", "2024-02-30T10:00:00Z", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert df.where(parse_iso(F.col("t")).isNotNull()).count() == 0
    good = spark.createDataFrame([("2024-01-01T00:02:00Z",), ("2024-01-01 00:02:00,5+01:00",)], "t string")
    assert good.where(parse_iso(F.col("t")).isNotNull()).count() == 2


def test_article_time_falls_back_to_the_record(spark):
    from tidewatch.operators import enrich
    value = json.dumps({"news_id": "1", "headline": "h", "url": "u", "published": "12:30"})
    raw = spark.createDataFrame([(value, "2024-05-01 00:00:00")], "value string, timestamp string")
    news = ingest.parse_news(raw)
    got = news.select(enrich.article_time(news).alias("t")).first()
    assert str(got.t) == "2024-05-01 00:00:00"
    plan = news._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1


def test_only_a_missing_path_counts_as_nothing_written(spark, tmp_path):
    from pyspark.errors import AnalysisException
    from tidewatch.sources.tables import BatchTable
    assert BatchTable(str(tmp_path / "none"), ("k",)).versions(spark) is None
    (tmp_path / "bad").mkdir()  # there, but without any readable file
    with pytest.raises(AnalysisException):
        BatchTable(str(tmp_path / "bad"), ("k",)).versions(spark)


def test_point_reads_open_the_keys_own_folder(spark, tmp_path):
    rows = [(f"feat:T{k}:{e}", "v") for k in range(300) for e in ("latest", "170")]
    path = str(tmp_path / "store")
    store.write_store(spark.createDataFrame(rows, "key string, value string"), path)
    found = store.lookup_stored(spark, path, "feat:T7:latest")
    assert [tuple(r) for r in found.collect()] == [("feat:T7:latest", "v")]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "_kind" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "_bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert store.scan_stored(spark, path, "feat:T1*:latest").count() == 111


def plain_summary(values):
    s, n = sorted(values), len(values)
    return n, (s[(n - 1) // 2] + s[n // 2]) / 2, s[int(n * 0.95)], s[int(n * 0.99)]


def test_latency_of_hot_keys_is_bracketed_by_sketches(spark, monkeypatch):
    """Three keys above the limit, one of them nearly all ties, and small ones below it."""
    monkeypatch.setattr(metrics, "MARGIN", 0.02)
    monkeypatch.setattr(metrics, "LEAST", 50)
    rnd = random.Random(1)
    rows = [("hot", rnd.gauss(0, 5)) for _ in range(6000)] + [(None, round(rnd.random(), 2)) for _ in range(3000)]
    rows += [("ties", 1.0)] * 2900 + [("ties", 2.0)] * 100 + [("small", float(k)) for k in range(7)] + [("one", 3.5)]
    df = spark.createDataFrame(rows + [("hot", None)], "k string, v double")
    got = {r.k: (r.n, r.median_value, r.p95_value, r.p99_value)
           for r in metrics.latency_summary(df, "k", "v").collect()}
    assert got == {k: plain_summary([v for x, v in rows if x == k]) for k in ("hot", None, "ties", "small", "one")}


def test_a_bracket_that_misses_goes_back_to_the_side_that_holds_the_rank(spark):
    rows = spark.range(1000).selectExpr("struct('a' AS k) AS key", "CAST(id AS double) AS value")
    brackets = spark.createDataFrame(
        [(0, 10, 0.0, 999.0, 500.0, 600.0), (1, 900, 0.0, 999.0, 500.0, 600.0), (2, 550, 0.0, 999.0, 500.0, 600.0)],
        "which int, rank long, lo double, hi double, tried_lo double, tried_hi double").selectExpr(
            "struct('a' AS k) AS key", "*")
    got = {r.which: r for r in metrics._narrowed(rows, brackets).collect()}
    assert (got[0].lo, got[0].hi) == (0.0, 500.0) and (got[1].lo, got[1].hi) == (600.0, 999.0)
    assert (got[2].lo, got[2].hi, got[2].inside) == (500.0, 600.0, 101)
    assert 500 <= got[2].tried_lo <= 550 <= got[2].tried_hi <= 600
