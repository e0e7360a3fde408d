"""Files and rows of batches that come in many tasks, without adaptive execution, as streams run."""

from pathlib import Path

import pytest
from helpers import at
from pyspark.sql import functions as F

from tidewatch.sources import tables as T

ROWS = "key string, window_end timestamp, n int"


@pytest.fixture
def as_streams(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield spark
    spark.conf.unset("spark.sql.adaptive.enabled")


def ten_hours(spark):
    """A row a minute, dealt over 20 tasks."""
    end = F.lit(str(at(0))).cast("timestamp") + F.make_dt_interval(secs=F.col("id") * 60)
    return spark.range(600).select(F.col("id").cast("string").alias("key"), end.alias("window_end"),
                                   F.col("id").cast("int").alias("n")).repartition(20)


def test_a_batch_writes_a_file_per_hour_not_per_hour_and_task(as_streams, tmp_path):
    table = T.BatchTable(str(tmp_path / "t"), ("key",))
    rows = ten_hours(as_streams)
    table.write(rows, 0)
    assert len(list(Path(table.path).rglob("*.parquet"))) == 10
    assert sorted(table.read(as_streams).collect()) == sorted(rows.collect())
    assert not rows.is_cached


def test_a_crowded_hour_is_shared_out(as_streams, tmp_path, monkeypatch):
    monkeypatch.setattr(T, "PIECE", 1000)
    table = T.BatchTable(str(tmp_path / "t"), ("window_end", "key"))
    rows = ten_hours(as_streams).union(as_streams.range(5000).select(
        F.col("id").cast("string"), F.lit(str(at(30))).cast("timestamp"), F.lit(1))).persist()
    table.write(rows, 0)
    assert rows.is_cached  # the caller's
    files = list(Path(table.path).rglob("*.parquet"))
    assert 4 <= sum("_hour=2024010100" in str(f) for f in files) and len(files) <= 10 + 6
    assert table.versions(as_streams).count() == 5600
    rows.unpersist()


def test_few_rows_of_many_hours_are_written_by_several_tasks(as_streams, tmp_path):
    table = T.BatchTable(str(tmp_path / "t"), ("key",))
    rows = ten_hours(as_streams).withColumn("window_end", F.lit(str(at(0))).cast("timestamp")
                                            + F.make_dt_interval(hours=F.col("n") % 200))
    table.write(rows, 0)
    files = [f.name for f in Path(table.path).rglob("*.parquet")]
    assert 200 <= len(files) <= 207 and len({f.split("-")[1] for f in files}) > 4
    assert sorted(table.read(as_streams).collect()) == sorted(rows.collect())
