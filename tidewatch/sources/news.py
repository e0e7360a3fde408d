"""Reading and writing the news topic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from tidewatch.operators.ingest import topic_records

TOPIC = "raw_news_fulltext"  # fixed value


def read_news_stream(spark: SparkSession, source: str = "kafka", path: str | None = None,
                     **options: str) -> DataFrame:
    """Raw records as (value, timestamp).

    ``kafka`` (starting at the latest offset unless told otherwise) needs the connector on the
    class path; ``text`` reads files of JSON lines, for which the record time is unknown.
    """
    reader = spark.readStream.format(source)
    if source == "kafka":
        options = {"subscribe": TOPIC, "startingOffsets": "latest", **options}
    stream = reader.options(**options).load(path)
    stamp = F.col("timestamp") if "timestamp" in stream.columns else F.lit(None)
    return stream.select(F.col("value").cast("string").alias("value"),
                         stamp.cast("timestamp").alias("timestamp"))


def write_news(news: DataFrame, **options: str) -> None:
    """Publishes a batch of articles to the topic; the key is the news_id."""
    (topic_records(news).write.format("kafka").option("topic", TOPIC)
     .option("kafka.acks", "all").option("kafka.enable.idempotence", "true")
     .options(**options).save())


def news_stream_writer(news: DataFrame, **options: str) -> DataStreamWriter:
    """The same for a stream; the caller adds the checkpoint and starts it."""
    return (topic_records(news).writeStream.format("kafka").option("topic", TOPIC)
            .option("kafka.acks", "all").option("kafka.enable.idempotence", "true")
            .options(**options))
