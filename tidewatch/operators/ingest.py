"""Parsing and validating articles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch import schemas
from tidewatch.functions.codecs import is_rfc3339
from tidewatch.functions.text import is_blank, strip
from tidewatch.operators.common import once

# fixed values: rejection messages
HEADLINE_REQUIRED = "headline is required"
URL_REQUIRED = "url is required"
PUBLISHED_REQUIRED = "published is required"
PUBLISHED_MALFORMED = "published must be valid ISO-8601 format"
NEWS_ID_EMPTY = "News ID cannot be empty"
HEADLINE_EMPTY = "Headline cannot be empty"
BATCH_EMPTY = "Batch cannot be empty"
BATCH_TOO_LARGE = "Batch size cannot exceed 100 articles"
MAX_BATCH = 100


def _decoded(raw: DataFrame, value: str) -> DataFrame:
    news = F.from_json(F.col(value).cast("string"), f"{schemas.NEWS}, _corrupt_record string",
                       {"mode": "PERMISSIVE"})
    complete = F.lit(True)
    for name in schemas.NEWS_REQUIRED:
        complete = complete & F.col(f"_news.{name}").isNotNull()
    return (once(raw, "_news", news)
            .withColumn("_good", F.coalesce(F.col("_news._corrupt_record").isNull() & complete,
                                            F.lit(False))))


def parse_news(raw: DataFrame, value: str = "value", time: str = "timestamp") -> DataFrame:
    """JSON records -> articles; broken or incomplete records are left out.

    If the records have a time of their own (``time``), it is kept as ``record_ts``.
    """
    kept = [F.col(time).cast("timestamp").alias("record_ts")] if time in raw.columns else []
    return _decoded(raw, value).filter("_good").select(
        *[F.col(f"_news.{c.split(' ')[0]}") for c in schemas.NEWS.split(", ")], *kept)


def rejected_news(raw: DataFrame, value: str = "value") -> DataFrame:
    """The records ``parse_news`` leaves out."""
    return _decoded(raw, value).filter("NOT _good").drop("_news", "_good")


def news_rejection(headline: Column, url: Column, published: Column) -> Column:
    """First failing rule, or null."""
    def missing(c: Column) -> Column:
        return F.coalesce(c, F.lit("")) == ""
    return (F.when(missing(headline), HEADLINE_REQUIRED).when(missing(url), URL_REQUIRED)
            .when(missing(published), PUBLISHED_REQUIRED)
            .when(~F.coalesce(is_rfc3339(published), F.lit(False)), PUBLISHED_MALFORMED))


def validate_news(requests: DataFrame) -> DataFrame:
    """Adds ``rejection``; null means valid."""
    return requests.withColumn("rejection", news_rejection(
        F.col("headline"), F.col("url"), F.col("published")))


def validate_enrich_request(requests: DataFrame) -> DataFrame:
    """Adds ``status_code`` and ``detail`` (200 and null when fine)."""
    no_id, no_headline = is_blank(F.col("news_id")), is_blank(F.col("headline"))
    return requests.withColumns({
        "status_code": F.when(no_id, 422).when(no_headline, 400).otherwise(200),
        "detail": F.when(no_id, NEWS_ID_EMPTY).when(no_headline, HEADLINE_EMPTY)})


def validate_batch(articles: DataFrame, batch: str = "batch_id") -> DataFrame:
    """Size and verdict per batch. An article with a null news_id marks an empty batch."""
    size = F.count("news_id")
    return articles.groupBy(batch).agg(size.alias("batch_size")).withColumns({
        "status_code": F.when((F.col("batch_size") == 0) | (F.col("batch_size") > MAX_BATCH), 400)
        .otherwise(200),
        "detail": F.when(F.col("batch_size") == 0, BATCH_EMPTY)
        .when(F.col("batch_size") > MAX_BATCH, BATCH_TOO_LARGE)})


def sanitize(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: strip(F.col(c)) for c in columns})


def assign_news_id(requests: DataFrame, random: bool = False) -> DataFrame:
    """Adds ``news_id``: a digest of the article, so that replays keep it, or a random UUID."""
    key = F.concat_ws("\x1f", "url", "published", "headline")
    return requests.withColumn("news_id", F.uuid() if random else F.sha2(key, 256))


def topic_records(news: DataFrame) -> DataFrame:
    """(key, value) for the news topic; an empty full_text is left out of the JSON."""
    body = F.nullif(F.col("full_text"), F.lit("")).alias("full_text")
    return news.select(F.col("news_id").alias("key"),
                       F.to_json(F.struct("news_id", "headline", "url", "published", body))
                       .alias("value"))
