"""Queries: article sentiment scorers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.dims import local_table
from tidewatch.functions import scoring
from tidewatch.functions.text import full_text
from tidewatch.operators import scorers
from tidewatch.plans import sqlparts as S
from tidewatch.plans import views as V
from tidewatch.plans.catalog import query
from tidewatch.plans.views import Tables

NEWS = f"WITH {V.NEWS_SQL}, {S.CONTEXT}"
SHIFT = "greatest(-1.0::DOUBLE, least(1.0::DOUBLE, {} + sentiment_bias * 0.3::DOUBLE))"


def texts(t: Tables) -> DataFrame:
    return V.news(t).select("news_id", full_text(F.col("headline"), F.col("full_text")).alias("text"))


def _result(df: DataFrame, *columns: str) -> DataFrame:
    out = {"sentiment": F.round(F.col("result.sentiment"), 6),
           "confidence": F.round(F.col("result.confidence"), 6),
           "risk_factor": F.round(F.col("result.risk_factor"), 6),
           "model_used": F.col("result.model_used"), "reasoning": F.col("result.reasoning")}
    return df.select("news_id", *[out[c].alias(c) for c in columns])


@query("category_context", f"""{NEWS} SELECT news_id, round(risk_multiplier, 6) AS risk_multiplier, round(sentiment_bias, 6) AS sentiment_bias, categories FROM context""")
def category_context(t: Tables) -> DataFrame:
    ctx = scoring.category_context(F.col("text"))
    return texts(t).select("news_id", ctx.alias("c")).select(
        "news_id", F.round("c.risk_multiplier", 6).alias("risk_multiplier"),
        F.round("c.sentiment_bias", 6).alias("sentiment_bias"),
        F.array_join("c.categories", "|").alias("categories"))


REASON = """CASE WHEN categories <> '' THEN 'Categories: [''' || replace(categories, '|', ''', ''') || ''']' END"""


@query("f_reasoning", f"{NEWS} SELECT news_id, {REASON} AS reasoning FROM context")
def f_reasoning(t: Tables) -> DataFrame:
    return _result(scorers.score_keyword(texts(t)), "reasoning")


@query("f_fallback_sentiment", f"{NEWS} SELECT news_id, round({S.KEYWORD_SCORE}, 6) AS sentiment, 0.3::DOUBLE AS confidence FROM context")
def f_fallback_sentiment(t: Tables) -> DataFrame:
    return _result(scorers.score_keyword(texts(t)), "sentiment", "confidence")


@query("score_keyword", f"""{NEWS} SELECT news_id, round({S.KEYWORD_SCORE}, 6) AS sentiment, 0.3::DOUBLE AS confidence,
  round(risk_multiplier, 6) AS risk_factor, 'keyword_fallback' AS model_used, {REASON} AS reasoning FROM context""")
def score_keyword(t: Tables) -> DataFrame:
    return _result(scorers.score_keyword(texts(t)), "sentiment", "confidence", "risk_factor",
                   "model_used", "reasoning")


@query("f_empty_text", f"""{NEWS} SELECT t.news_id, CASE WHEN doc_id % 3 = 0 THEN 0.0::DOUBLE ELSE round({S.KEYWORD_SCORE}, 6) END AS sentiment,
  CASE WHEN doc_id % 3 = 0 THEN 0.0::DOUBLE ELSE 0.3::DOUBLE END AS confidence,
  CASE WHEN doc_id % 3 = 0 THEN 1.0::DOUBLE ELSE round(risk_multiplier, 6) END AS risk_factor,
  CASE WHEN doc_id % 3 = 0 THEN 'none' ELSE 'keyword_fallback' END AS model_used FROM texts t JOIN context USING (news_id)""")
def f_empty_text(t: Tables) -> DataFrame:
    d = F.col("news_id").cast("long")
    blanked = texts(t).withColumn("text", F.when(d % 6 == 0, "").when(d % 3 == 0, " \n\t ")
                                  .otherwise(F.col("text")))
    return _result(scorers.score_keyword(blanked), "sentiment", "confidence", "risk_factor",
                   "model_used")


LEX = S.values(V.LEXICON, "word, valence", "lex")
LEXICON = f"""{LEX},
words AS (SELECT news_id, unnest(regexp_split_to_array(low, '[^\\p{{L}}\\p{{N}}_]+')) AS word FROM texts),
sums AS (SELECT news_id, CAST(sum(CAST(valence AS DECIMAL(18,6))) AS DOUBLE) AS total FROM words JOIN lex USING (word) GROUP BY news_id),
lexed AS (SELECT t.news_id, coalesce(total, 0.0::DOUBLE) / sqrt(coalesce(total, 0.0::DOUBLE) * coalesce(total, 0.0::DOUBLE) + 15.0::DOUBLE) AS score
  FROM texts t LEFT JOIN sums USING (news_id))"""


def lexicon(t: Tables) -> DataFrame:
    return local_table(t.spark, V.LEXICON, "word string, valence double")


@query("score_lexicon", f"""{NEWS}, {LEXICON} SELECT news_id, round({SHIFT.format("score")}, 6) AS sentiment, round(abs(score), 6) AS confidence,
  'lexicon' AS model_used FROM lexed JOIN context USING (news_id)""")
def score_lexicon(t: Tables) -> DataFrame:
    return _result(scorers.score_lexicon(texts(t), lexicon(t)), "sentiment", "confidence", "model_used")


def star_model():
    """A stand-in for a user's model: stars and confidence from the text length; some texts fail."""
    def score(batch: list[str]) -> list[tuple[str, float]]:
        return [(f"{len(x) % 5 + 1}{'' if len(x) % 2 else ' stars'}", (len(x) % 100) / 100.0)
                for x in batch]
    return score


# what the stand-in and the label rules give for a text of length n
STARS = """CASE n % 5 WHEN 0 THEN -c WHEN 4 THEN c WHEN 2 THEN 0.0::DOUBLE
  ELSE CASE WHEN n % 2 = 1 THEN ((n % 5 + 1) - 3.0::DOUBLE) / 2.0::DOUBLE ELSE 0.0::DOUBLE END END"""
MODEL = f"modelled AS (SELECT news_id, {STARS} AS stars, c FROM (SELECT news_id, length(full_body) AS n, (length(full_body) % 100) / 100.0::DOUBLE AS c FROM texts))"


@query("score_model", f"""{NEWS}, {MODEL} SELECT news_id, round({SHIFT.format("stars")}, 6) AS sentiment, c AS confidence, 'model' AS model_used
FROM modelled JOIN context USING (news_id)""")
def score_model(t: Tables) -> DataFrame:
    return _result(scorers.score_model(texts(t), star_model, lexicon(t)), "sentiment", "confidence",
                   "model_used")


# every seventh article is about a company that is routed to the slow scorer
TICKER = "CASE WHEN doc_id % 7 = 0 THEN 'aapl' ELSE 'T1' END"


@query("score_tiered", f"""{NEWS}, {LEXICON}, {MODEL},
routed AS (SELECT *, {S.slow_test("full_body", "low", TICKER)} AS slow FROM texts)
SELECT r.news_id, r.slow, round(CASE WHEN slow THEN {SHIFT.format("stars")} ELSE {SHIFT.format("score")} END, 6) AS sentiment,
  round(CASE WHEN slow THEN c ELSE abs(score) END, 6) AS confidence, CASE WHEN slow THEN 'model' ELSE 'lexicon_fast' END AS model_used
FROM routed r JOIN modelled USING (news_id) JOIN lexed USING (news_id) JOIN context USING (news_id)""")
def score_tiered(t: Tables) -> DataFrame:
    ticker = F.when(F.col("news_id").cast("long") % 7 == 0, "aapl").otherwise("T1")
    scored = scorers.score_tiered(texts(t).withColumn("ticker", ticker), star_model, lexicon(t))
    return scored.select(
        "news_id", "slow", F.round("result.sentiment", 6).alias("sentiment"),
        F.round("result.confidence", 6).alias("confidence"), F.col("result.model_used").alias("model_used"))


@query("ensemble_sentiment", f"""{NEWS.replace("WITH ", "WITH ", 1)}, {LEXICON}, {MODEL},
parts AS (SELECT t.news_id, CASE WHEN doc_id % 4 <> 0 THEN score END AS s1, CASE WHEN doc_id % 3 = 1 THEN 0.0::DOUBLE ELSE abs(score) END AS c1,
  CASE WHEN doc_id % 8 <> 0 THEN stars END AS s2, CASE WHEN doc_id % 3 = 1 THEN 0.0::DOUBLE ELSE c END AS c2
  FROM texts t JOIN lexed USING (news_id) JOIN modelled USING (news_id)),
filled AS (SELECT news_id, coalesce(s1, 0) AS s1, CASE WHEN s1 IS NULL THEN 0 ELSE c1 END AS c1, coalesce(s2, 0) AS s2,
  CASE WHEN s2 IS NULL THEN 0 ELSE c2 END AS c2, (s1 IS NOT NULL)::INTEGER + (s2 IS NOT NULL)::INTEGER AS k FROM parts)
SELECT news_id, round(CASE WHEN k = 0 THEN NULL WHEN c1 + c2 > 0 THEN (s1 * c1 + s2 * c2) / (c1 + c2) ELSE (s1 + s2) / k END, 6) AS score,
  round(CASE WHEN k = 0 THEN NULL WHEN c1 + c2 > 0 THEN (c1 + c2) / k ELSE 0.5::DOUBLE END, 6) AS confidence FROM filled""")
def ensemble_sentiment(t: Tables) -> DataFrame:
    e = scoring.ensemble([F.col("s1"), F.col("s2")], [F.col("c1"), F.col("c2")])
    return _scorer_columns(t).select("news_id", e.alias("e")).select(
        "news_id", F.round("e.score", 6).alias("score"), F.round("e.confidence", 6).alias("confidence"))


def _scorer_columns(t: Tables) -> DataFrame:
    """Two scorers with gaps and zero confidences put in by rule."""
    d = F.col("news_id").cast("long")
    modelled = scorers.model_scores(scorers.with_context(texts(t)), star_model)
    both = modelled.join(scorers.lexicon_scores(texts(t), lexicon(t)), "news_id")
    return both.select(
        "news_id", scorers.CONTEXT, F.when(d % 4 != 0, F.col("score")).alias("s1"),
        F.when(d % 3 == 1, 0.0).otherwise(F.col("confidence")).alias("c1"),
        F.when(d % 8 != 0, F.col("model_score")).alias("s2"),
        F.when(d % 3 == 1, 0.0).otherwise(F.col("model_confidence")).alias("c2"))


@query("score_ensemble", f"""{NEWS}, {LEXICON}, {MODEL},
parts AS (SELECT t.news_id, CASE WHEN doc_id % 4 <> 0 THEN score END AS s1, CASE WHEN doc_id % 3 = 1 THEN 0.0::DOUBLE ELSE abs(score) END AS c1,
  CASE WHEN doc_id % 8 <> 0 THEN stars END AS s2, CASE WHEN doc_id % 3 = 1 THEN 0.0::DOUBLE ELSE c END AS c2
  FROM texts t JOIN lexed USING (news_id) JOIN modelled USING (news_id)),
filled AS (SELECT news_id, coalesce(s1, 0) AS x1, CASE WHEN s1 IS NULL THEN 0 ELSE c1 END AS w1, coalesce(s2, 0) AS x2,
  CASE WHEN s2 IS NULL THEN 0 ELSE c2 END AS w2, (s1 IS NOT NULL)::INTEGER + (s2 IS NOT NULL)::INTEGER AS k,
  CASE WHEN s1 IS NOT NULL AND s2 IS NOT NULL THEN 'lexicon+model' WHEN s1 IS NOT NULL THEN 'lexicon' WHEN s2 IS NOT NULL THEN 'model' ELSE 'keyword_fallback' END AS model_used FROM parts),
mean AS (SELECT *, CASE WHEN k = 0 THEN NULL WHEN w1 + w2 > 0 THEN (x1 * w1 + x2 * w2) / (w1 + w2) ELSE (x1 + x2) / k END AS e FROM filled)
SELECT news_id, round({SHIFT.format("coalesce(e, sentiment_bias)")}, 6) AS sentiment,
  round(CASE WHEN k = 0 THEN 0.3::DOUBLE WHEN w1 + w2 > 0 THEN (w1 + w2) / k ELSE 0.5::DOUBLE END, 6) AS confidence, model_used
FROM mean JOIN context USING (news_id)""")
def score_ensemble(t: Tables) -> DataFrame:
    scored = scorers.score_ensemble(_scorer_columns(t), [("lexicon", "s1", "c1"), ("model", "s2", "c2")])
    return _result(scored, "sentiment", "confidence", "model_used")
