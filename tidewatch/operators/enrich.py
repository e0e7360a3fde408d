"""Articles -> company mentions with sentiment."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch import schemas
from tidewatch.functions.codecs import event_time, from_record
from tidewatch.functions.scoring import sentiment_result
from tidewatch.functions.text import full_text
from tidewatch.operators.common import once
from tidewatch.operators.detect import detect_first_match, detect_simple, with_company_hits


def enrich_news(news: DataFrame, keywords=None) -> DataFrame:
    """Adds ``companies``: array<struct<ticker, role, sentiment>>, with the default scorer.

    The text score does not depend on the company, so it is computed once per article, and only
    for articles that mention one.
    """
    text = full_text(F.col("headline"), F.col("full_text"))
    scored = once(with_company_hits(news, keywords), "_score",
                  F.when(F.size("_hits") > 0, sentiment_result(text)["sentiment"]))
    mentions = F.transform("_hits", lambda h: F.struct(
        h["ticker"].alias("ticker"), h["role"].alias("role"), F.col("_score").alias("sentiment")))
    return scored.select(*news.columns, mentions.alias("companies"))


def enrich_first_match(news: DataFrame) -> DataFrame:
    return _as_companies(news, detect_first_match(news))


def enrich_simple(news: DataFrame) -> DataFrame:
    return _as_companies(news, detect_simple(news).withColumn("role", F.lit("primary")))


def _as_companies(news: DataFrame, mentions: DataFrame) -> DataFrame:
    one = F.array(F.struct("ticker", "role", "sentiment"))
    return mentions.withColumn("companies", one).select(*news.columns, "companies")


ENRICHERS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "full": enrich_news, "first_match": enrich_first_match, "simple": enrich_simple,
}


def drop_unmentioned(enriched: DataFrame) -> DataFrame:
    """Articles with no company produce nothing."""
    return enriched.filter(F.size("companies") > 0)


def article_time(articles: DataFrame) -> Column:
    """Publication time; where that is malformed the record's time (``record_ts``, if the articles
    have it), else now. No article loses its place in the windows."""
    record = F.col("record_ts") if "record_ts" in articles.columns else F.lit(None).cast("timestamp")
    return event_time(F.col("published"), record)


def to_mention_events(enriched: DataFrame) -> DataFrame:
    """One event per mention, at the article's time."""
    return (enriched.select("news_id", article_time(enriched).alias("event_ts"),
                            F.explode_outer("companies").alias("c"))
            .filter(F.col("c").isNotNull())
            .select("news_id", "event_ts", "c.ticker", "c.role", "c.sentiment"))


def to_shock_events(enriched: DataFrame, threshold: float = -0.5) -> DataFrame:
    """Mentions below the shock threshold, with the headline."""
    return (enriched.select("news_id", article_time(enriched).alias("event_ts"),
                            F.explode_outer("companies").alias("c"), "headline")
            .filter(F.col("c.sentiment") < threshold)
            .select("news_id", "event_ts", "c.ticker", "c.sentiment", "headline"))


def to_enrichment_request(news: DataFrame) -> DataFrame:
    return news.select("news_id", "headline", F.col("full_text").alias("body"), "url", "published")


def join_results(news: DataFrame, results: DataFrame) -> DataFrame:
    """Articles with their enrichment results, by news_id."""
    return news.join(results.select("news_id", "companies"), "news_id")


def batch_results(responses: DataFrame, value: str = "value") -> DataFrame:
    """Stored batch responses (JSON) -> one row per article result."""
    schema = (f"results array<struct<{_struct(schemas.ENRICHMENT)}>>, total_articles int, "
              "processing_time_ms double")
    return (responses.select(F.explode(from_record(F.col(value), schema)["results"]).alias("r"))
            .select("r.news_id", "r.companies"))


def _struct(ddl: str) -> str:
    return ddl.replace("news_id string", "news_id: string").replace("companies array",
                                                                    "companies: array")


def batch_enrich_io(news: DataFrame, responses: DataFrame) -> DataFrame:
    """Mention events from articles and stored batch responses."""
    return to_mention_events(join_results(news, batch_results(responses)))
