"""Slices meet by ticker and stretch of time: one shuffle, the same windows."""

import pytest
from helpers import at
from pyspark.sql import functions as F

from tidewatch.operators import features, store
from tidewatch.streaming import jobs


def slices(spark, n=400):
    rows = spark.range(n).select(
        F.col("id").cast("string").alias("news_id"),
        (F.lit(str(at(-40))).cast("timestamp") + F.make_dt_interval(secs=F.col("id") * 37)).alias("event_ts"),
        F.concat(F.lit("T"), (F.col("id") % 3).cast("string")).alias("ticker"),
        ((F.col("id") * 37) % 201 / 100.0 - 1).alias("sentiment"))
    return rows, jobs.feature_slices(rows)


@pytest.mark.parametrize("window, slide", [
    ("5 minutes", "1 minute"), ("5 minutes", "5 minutes"), ("5 minutes", "2 minutes"),
    ("70 seconds", "30 seconds"), ("2 hours", "50 minutes")])
def test_slices_reach_the_windows_that_hold_them(spark, window, slide):
    rows = spark.range(-300, 1200).select(F.lit("A").alias("ticker"),
                                          F.timestamp_seconds(F.col("id") * 10).alias("slice"))
    tables = jobs.feature_tables("unused", window=window, slide=slide)
    spread = tables.spread(tables.dealt(rows)).select("slice", "window_end")
    plain = rows.select("slice", F.window("slice", window, slide)["end"].alias("window_end"))
    assert sorted(spread.collect()) == sorted(plain.collect())


def test_a_first_batch_shuffles_its_slices_once(spark, tmp_path, monkeypatch):
    rows, batch = slices(spark)
    tables, plans = jobs.feature_tables(str(tmp_path / "t")), []
    write = tables.windows.write

    def spy(windows, batch_id):
        plans.append(windows._jdf.queryExecution().executedPlan().toString())
        write(windows, batch_id)

    monkeypatch.setattr(tables.windows, "write", spy)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        tables(batch.localCheckpoint(), 0)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert plans[0].count("Exchange hashpartitioning") == 1
    expected = features.company_features(rows)
    assert sorted(tables.windows.read(spark).collect()) == sorted(expected.collect())


def test_window_records_are_those_of_all_writes(spark):
    rows, _ = slices(spark, 100)
    windows = features.company_features(rows)
    kept = ["key", "window_end"]
    whole = store.last_write_wins(store.keyed_records(windows))
    assert sorted(store.window_records(windows).select(*kept).collect()) == sorted(
        whole.select(*kept).collect())
