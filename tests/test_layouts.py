"""Streams must read a table the same way whether it is one file or a folder of part files."""

import pytest

from tidewatch.plans import catalog

SMALL = "/root/testdata/sf0.001"
STREAMS = ["st_unordered_enrich", "st_watermark", "st_running_features", "st_features", "st_sliding",
           "st_event_time", "st_shocks", "st_news_job", "st_dead_letter", "sink_fanout"]


@pytest.fixture(scope="module")
def parted(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("parted")
    for table in ("events", "documents"):
        spark.read.parquet(f"{SMALL}/{table}.parquet").repartition(3).write.parquet(
            str(folder / f"{table}.parquet"))
    catalog.load()
    return str(folder)


@pytest.mark.parametrize("name", STREAMS)
def test_same_rows_from_part_files(spark, parted, name):
    run = catalog.runner(name)
    one, many = ([sorted(map(repr, run(spark, d).collect())) for d in (SMALL, parted)])
    assert one and one == many
