"""Queries: company detection, prefilter, enrichment and dimension look-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch import dims
from tidewatch.functions.scoring import needs_slow_scorer
from tidewatch.functions.text import full_text
from tidewatch.operators import detect, enrich, metrics, shocks
from tidewatch.plans import sqlparts as S
from tidewatch.plans import views as V
from tidewatch.plans.catalog import query
from tidewatch.plans.views import Tables

NEWS = f"WITH {V.NEWS_SQL}"
DETECTED = f"{NEWS}, {S.hits()},\n{S.DETECTED}"
ENRICHED = f"{DETECTED},\n{S.CONTEXT}"
SCORE = f"round({S.KEYWORD_SCORE}, 6)"
CORPUS = [(w, k, i) for i, (w, k) in enumerate(V.CORPUS_WORDS)]
SHOCK_TEXT = "lower(headline || ' ' || coalesce(full_text, ''))"
IS_SHOCK = S.any_phrase(SHOCK_TEXT, dims.SHOCK_PHRASES)


def _mentions(t: Tables) -> DataFrame:
    return detect.detect_companies(V.news(t))


@query("detect_companies", f"{DETECTED} SELECT news_id, ticker, role, keyword FROM detected")
def detect_companies(t: Tables) -> DataFrame:
    return _mentions(t).select("news_id", "ticker", "role", "keyword")


@query("detect_companies_by_dim", f"""{NEWS}, {S.hits(CORPUS)},
{S.DETECTED} SELECT news_id, ticker, role, keyword FROM detected""")
def detect_companies_by_dim(t: Tables) -> DataFrame:
    dim = dims.local_table(t.spark, CORPUS, "keyword string, ticker string, ord int")
    return (detect.detect_companies_by_dim(V.news(t), dim)
            .select("news_id", "ticker", "role", "keyword"))


@query("detect_companies_corpus_words", f"""{NEWS}, {S.hits(CORPUS)},
{S.DETECTED} SELECT news_id, ticker, role, keyword FROM detected""")
def detect_companies_corpus_words(t: Tables) -> DataFrame:
    return (detect.detect_companies(V.news(t), CORPUS)
            .select("news_id", "ticker", "role", "keyword"))


@query("longest_keyword_per_ticker", f"{DETECTED} SELECT news_id, ticker, keyword, CAST(ord AS INTEGER) AS ord FROM detected")
def longest_keyword_per_ticker(t: Tables) -> DataFrame:
    hits = detect.keyword_hits(V.news(t))
    return (detect.longest_keyword_per_ticker(hits)
            .select("news_id", "ticker", "keyword", F.col("ord").cast("int").alias("ord")))


@query("mention_order", f"{DETECTED} SELECT news_id, ticker, CAST(position AS INTEGER) AS position FROM detected")
def mention_order(t: Tables) -> DataFrame:
    best = detect.longest_keyword_per_ticker(detect.keyword_hits(V.news(t)))
    return detect.mention_order(best).select("news_id", "ticker",
                                             F.col("position").cast("int").alias("position"))


@query("detect_first_match", f"""{NEWS}, {S.FIRST_MATCH_KEYWORDS}
SELECT news_id, ticker, 'primary' AS role, keyword,
  {S.headline_sentiment("lower(headline)", dims.FIRST_MATCH_NEGATIVE, dims.FIRST_MATCH_POSITIVE)} AS sentiment
FROM (SELECT n.news_id, n.headline, k.*, row_number() OVER (PARTITION BY news_id ORDER BY length(keyword) DESC, ord) AS r
      FROM news n JOIN kw k ON contains(lower(n.headline), k.keyword)) WHERE r = 1""")
def detect_first_match(t: Tables) -> DataFrame:
    return (detect.detect_first_match(V.news(t))
            .select("news_id", "ticker", "role", "keyword", "sentiment"))


SIMPLE = f"""simple AS (
SELECT news_id, event_ts, CASE {" ".join(f"WHEN contains(lower(headline), '{k}') THEN '{v}'" for k, v in dims.SIMPLE_KEYWORDS)} END AS ticker,
  {S.headline_sentiment("lower(headline)", dims.SIMPLE_NEGATIVE, dims.SIMPLE_POSITIVE)} AS sentiment FROM news)"""


@query("detect_simple", f"{NEWS}, {SIMPLE} SELECT news_id, ticker, sentiment FROM simple WHERE ticker IS NOT NULL")
def detect_simple(t: Tables) -> DataFrame:
    return detect.detect_simple(V.news(t)).select("news_id", "ticker", "sentiment")


@query("match_categories", f"""{NEWS}, {S.CONTEXT}
SELECT news_id, category FROM matched""")
def match_categories(t: Tables) -> DataFrame:
    from tidewatch.functions.scoring import matched_categories
    text = full_text(F.col("headline"), F.col("full_text"))
    return (V.news(t).select("news_id", F.explode(matched_categories(text)).alias("c"))
            .select("news_id", "c.category"))


@query("shock_prefilter", f"{NEWS} SELECT news_id, headline FROM news WHERE {IS_SHOCK}")
def shock_prefilter(t: Tables) -> DataFrame:
    return shocks.shock_prefilter(V.news(t)).select("news_id", "headline")


@query("not_shock", f"{NEWS} SELECT news_id, headline FROM news WHERE NOT {IS_SHOCK}")
def not_shock(t: Tables) -> DataFrame:
    return shocks.not_shock(V.news(t)).select("news_id", "headline")


@query("prefilter_stats", f"""{NEWS} SELECT count(*) AS total_articles, count(*) FILTER (WHERE {IS_SHOCK}) AS shock_articles,
  count(*) FILTER (WHERE NOT {IS_SHOCK}) AS filtered_articles,
  round((1.0::DOUBLE - count(*) FILTER (WHERE {IS_SHOCK})::DOUBLE / count(*)) * 100.0::DOUBLE, 6) AS filtered_pct FROM news""")
def prefilter_stats(t: Tables) -> DataFrame:
    return shocks.prefilter_stats(V.news(t)).withColumn("filtered_pct", F.round("filtered_pct", 6))


@query("enrich_news", f"""{ENRICHED}
SELECT news_id, string_agg(ticker || '/' || role, '|' ORDER BY position) AS companies, {SCORE} AS sentiment
FROM detected JOIN context USING (news_id) GROUP BY news_id, sentiment_bias""")
def enrich_news(t: Tables) -> DataFrame:
    rows = enrich.drop_unmentioned(V.enriched(t))
    listed = F.transform("companies", lambda c: F.concat(c["ticker"], F.lit("/"), c["role"]))
    return rows.select("news_id", F.array_join(listed, "|").alias("companies"),
                       F.round(F.element_at("companies", 1)["sentiment"], 6).alias("sentiment"))


@query("drop_unmentioned", f"{DETECTED} SELECT news_id, count(*) AS companies FROM detected GROUP BY news_id")
def drop_unmentioned(t: Tables) -> DataFrame:
    return enrich.drop_unmentioned(V.enriched(t)).select(
        "news_id", F.size("companies").cast("long").alias("companies"))


@query("to_mention_events", f"""{ENRICHED}
SELECT d.news_id, n.event_ts, d.ticker, d.role, {SCORE} AS sentiment
FROM detected d JOIN context USING (news_id) JOIN news n USING (news_id)""")
def to_mention_events(t: Tables) -> DataFrame:
    return V.article_mentions(t).withColumn("sentiment", F.round("sentiment", 6))


ARTICLE_SHOCKS = f"""{ENRICHED},
article_shocks AS (
  SELECT d.news_id, n.event_ts, d.ticker, {SCORE} AS sentiment, n.headline
  FROM detected d JOIN context USING (news_id) JOIN news n USING (news_id)
  WHERE {IS_SHOCK.replace("headline ||", "n.headline ||").replace("full_text", "n.full_text")} AND {S.KEYWORD_SCORE} < -0.5)"""


@query("to_shock_events", f"{ARTICLE_SHOCKS} SELECT * FROM article_shocks")
def to_shock_events(t: Tables) -> DataFrame:
    return V.article_shocks(t).withColumn("sentiment", F.round("sentiment", 6))


@query("join_results", f"""{DETECTED}
SELECT n.news_id, n.url, count(d.ticker) AS companies FROM news n LEFT JOIN detected d USING (news_id) GROUP BY n.news_id, n.url""")
def join_results(t: Tables) -> DataFrame:
    joined = enrich.join_results(V.news(t), V.enriched(t).select("news_id", "companies"))
    return joined.select("news_id", "url", F.size("companies").cast("long").alias("companies"))


@query("lookup_company", f"""{DETECTED}, {S.COMPANIES}
SELECT d.news_id, d.ticker, c.official_name, c.sector, c.is_supplier FROM detected d LEFT JOIN companies c USING (ticker)""")
def lookup_company(t: Tables) -> DataFrame:
    rows = detect.lookup_company(_mentions(t), dims.company_dim(t.spark))
    return rows.select("news_id", "ticker", "official_name", "sector", "is_supplier")


@query("suppliers", f"""{DETECTED}, {S.COMPANIES}
SELECT c.ticker, c.official_name, count(d.news_id) AS mentions FROM companies c LEFT JOIN detected d USING (ticker)
WHERE c.is_supplier GROUP BY c.ticker, c.official_name""")
def suppliers(t: Tables) -> DataFrame:
    chosen = detect.suppliers(dims.company_dim(t.spark))
    counts = metrics.mentions_by_ticker(_mentions(t))
    return chosen.join(counts, "ticker", "left").select(
        "ticker", "official_name", F.coalesce("mentions", F.lit(0)).alias("mentions"))


@query("companies_by_sector", f"""{DETECTED}, {S.COMPANIES}
SELECT c.ticker, c.official_name, count(d.news_id) AS mentions FROM companies c LEFT JOIN detected d USING (ticker)
WHERE c.sector = 'Automotive' GROUP BY c.ticker, c.official_name""")
def companies_by_sector(t: Tables) -> DataFrame:
    chosen = detect.companies_by_sector(dims.company_dim(t.spark), "Automotive")
    counts = metrics.mentions_by_ticker(_mentions(t))
    return chosen.join(counts, "ticker", "left").select(
        "ticker", "official_name", F.coalesce("mentions", F.lit(0)).alias("mentions"))


@query("sector_summary", f"""{DETECTED}, {S.COMPANIES}
SELECT sector, count(*) AS companies, count(*) FILTER (WHERE is_supplier) AS suppliers, CAST(sum(m) AS BIGINT) AS mentions
FROM (SELECT c.*, (SELECT count(*) FROM detected d WHERE d.ticker = c.ticker) AS m FROM companies c) GROUP BY sector""")
def sector_summary(t: Tables) -> DataFrame:
    companies = dims.company_dim(t.spark)
    mentions = (detect.lookup_company(_mentions(t), companies).groupBy("sector")
                .agg(F.count("*").alias("mentions")))
    return (detect.sector_summary(companies).join(mentions, "sector", "left")
            .withColumn("mentions", F.coalesce("mentions", F.lit(0))))


@query("mentions_by_ticker", f"{DETECTED} SELECT ticker, count(*) AS mentions FROM detected GROUP BY ticker")
def mentions_by_ticker(t: Tables) -> DataFrame:
    return metrics.mentions_by_ticker(_mentions(t))


@query("distinct_tickers", f"{DETECTED} SELECT DISTINCT ticker FROM detected")
def distinct_tickers(t: Tables) -> DataFrame:
    return metrics.distinct_tickers(_mentions(t))


@query("batch_summary", f"""{DETECTED}, {V.BATCHED_SQL}
SELECT b.batch_id, count(DISTINCT b.news_id) AS articles, count(d.ticker) AS mentions
FROM batched b LEFT JOIN detected d USING (news_id) GROUP BY b.batch_id""")
def batch_summary(t: Tables) -> DataFrame:
    return metrics.batch_summary(enrich.enrich_news(V.batched(t)))


@query("enrichment_stats", f"""{DETECTED}, {V.BATCHED_SQL},
routed AS (SELECT b.batch_id, b.news_id, d.ticker, {S.slow_test("t.full_body", "t.low", "d.ticker")} AS slow
  FROM batched b JOIN texts t USING (news_id) LEFT JOIN detected d USING (news_id))
SELECT count(DISTINCT news_id) AS total_requests, count(DISTINCT batch_id) AS batch_requests,
  count(*) FILTER (WHERE ticker IS NOT NULL AND NOT slow) AS fast_path_count,
  count(*) FILTER (WHERE ticker IS NOT NULL AND slow) AS slow_path_count,
  count(ticker) AS total_companies_detected, count(DISTINCT ticker) AS distinct_companies,
  printf('%.1f', count(*) FILTER (WHERE ticker IS NOT NULL AND NOT slow)::DOUBLE / count(ticker) * 100.0::DOUBLE) || '%' AS fast_path_percentage,
  {len(dims.COMPANIES)} AS total_companies, {len(dims.keyword_rows())} AS total_keywords, {len(dims.CATEGORIES)} AS supply_chain_categories
FROM routed""")
def enrichment_stats(t: Tables) -> DataFrame:
    text = full_text(F.col("headline"), F.col("full_text"))
    rows = enrich.enrich_news(V.batched(t)).select(
        "batch_id", "news_id", text.alias("text"), F.explode_outer("companies").alias("c"))
    rows = rows.select("batch_id", "news_id", "text", F.col("c.ticker").alias("ticker"))
    return metrics.enrichment_stats(rows, needs_slow_scorer(F.col("text"), F.col("ticker")))
