"""Queries: scalar functions, each over a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch import dims
from tidewatch.functions import codecs, scoring, text
from tidewatch.operators.alerts import suppression_reason
from tidewatch.plans import sqlparts as S
from tidewatch.plans import views as V
from tidewatch.plans.catalog import query
from tidewatch.plans.views import Tables

NEWS = f"WITH {V.NEWS_SQL}"
# numbers derived from every event
SCALARS = f"""WITH {V.MENTIONS_SQL},
s AS (SELECT *, event_id % 8 AS neg, event_id % 5 AS pos, CAST((event_id * 13) % 1001 AS DOUBLE) / 1000.0::DOUBLE AS risk,
  round(sentiment, 3) AS score FROM mentions)"""


def scalars(t: Tables) -> DataFrame:
    e = F.col("news_id").cast("long")
    return V.mentions(t).withColumns({
        "event_id": e, "neg": e % 8, "pos": e % 5, "risk": (e * 13) % 1001 / 1000.0,
        "score": F.round("sentiment", 3)})


@query("f_risk", f"""{SCALARS},
scored AS (SELECT news_id, neg AS neg_news_count_5m, pos AS pos_news_count_5m, score AS sentiment_score_5m FROM s)
SELECT news_id, risk_score_5m AS risk FROM ({V.RISK_TAIL})""")
def f_risk(t: Tables) -> DataFrame:
    return scalars(t).select("news_id", scoring.risk_score(
        F.col("neg"), F.col("pos"), F.col("score")).alias("risk"))


@query("f_shock_risk", f"{SCALARS} SELECT news_id, least(1.0::DOUBLE, neg / 5.0::DOUBLE) AS risk FROM s")
def f_shock_risk(t: Tables) -> DataFrame:
    return scalars(t).select("news_id", scoring.shock_risk(F.col("neg")).alias("risk"))


@query("f_round", f"""{SCALARS} SELECT news_id, CAST(printf('%.3f', sentiment / 8.0::DOUBLE) AS DOUBLE) AS r3,
  CAST(printf('%.6f', sentiment / 7.0::DOUBLE) AS DOUBLE) AS r6 FROM s""")
def f_round(t: Tables) -> DataFrame:
    x = F.col("sentiment")
    return scalars(t).select("news_id", scoring.round_exact(x / 8.0, 3).alias("r3"),
                             scoring.round_exact(x / 7.0, 6).alias("r6"))


@query("f_clamp", f"{SCALARS} SELECT news_id, greatest(-1.0::DOUBLE, least(1.0::DOUBLE, sentiment * 2.0::DOUBLE)) AS x FROM s")
def f_clamp(t: Tables) -> DataFrame:
    return scalars(t).select("news_id", scoring.clamp(F.col("sentiment") * 2.0).alias("x"))


@query("f_parse_iso", f"""{NEWS}
SELECT news_id, CASE doc_id % 4 WHEN 3 THEN NULL WHEN 1 THEN event_ts - INTERVAL 90 MINUTE ELSE event_ts END AS ts,
  CASE doc_id % 4 WHEN 3 THEN NULL ELSE CAST(epoch_ms(CASE doc_id % 4 WHEN 1 THEN event_ts - INTERVAL 90 MINUTE ELSE event_ts END) AS BIGINT) END AS ms,
  CASE doc_id % 4 WHEN 3 THEN NULL ELSE CAST(epoch(CASE doc_id % 4 WHEN 1 THEN event_ts - INTERVAL 90 MINUTE ELSE event_ts END) AS BIGINT) END AS secs
FROM news""")
def f_parse_iso(t: Tables) -> DataFrame:
    d = F.col("news_id").cast("long")
    iso = (F.when(d % 4 == 1, F.concat(F.substring("published", 1, 19), F.lit("+01:30")))
           .when(d % 4 == 3, "not a time").otherwise(F.col("published")))
    return (V.news(t).select("news_id", codecs.parse_iso(iso).alias("ts"))
            .withColumns({"ms": F.unix_millis("ts"), "secs": F.unix_seconds("ts")}))


@query("f_format_iso", f"{SCALARS} SELECT news_id, strftime(event_ts, '%Y-%m-%dT%H:%M:%SZ') AS iso FROM s")
def f_format_iso(t: Tables) -> DataFrame:
    return scalars(t).select("news_id", codecs.format_iso(F.col("event_ts")).alias("iso"))


@query("f_store_key", f"""{SCALARS} SELECT news_id, 'feat:' || ticker || ':' || CAST(epoch(event_ts) AS BIGINT) AS feat_key,
  'shock:' || ticker || ':' || CAST(epoch(event_ts) AS BIGINT) AS shock_key, 'feat:' || ticker || ':latest' AS latest_key,
  'alert:last_sent:' || ticker AS sent_key FROM s""")
def f_store_key(t: Tables) -> DataFrame:
    tick, at = F.col("ticker"), F.col("event_ts")
    return scalars(t).select(
        "news_id", codecs.store_key("feat", tick, at).alias("feat_key"),
        codecs.store_key("shock", tick, at).alias("shock_key"),
        codecs.latest_key("feat", tick).alias("latest_key"),
        codecs.last_sent_key(tick).alias("sent_key"))


@query("f_severity", f"{SCALARS} SELECT news_id, {S.severity('risk')} AS severity FROM s")
def f_severity(t: Tables) -> DataFrame:
    return scalars(t).select("news_id", scoring.severity(F.col("risk")).alias("severity"))


@query("f_message", f"{SCALARS} SELECT news_id, {S.message('ticker', 'risk')} AS message FROM s")
def f_message(t: Tables) -> DataFrame:
    return scalars(t).select("news_id", scoring.alert_message(
        F.col("ticker"), F.col("risk")).alias("message"))


@query("f_payload", f"{SCALARS} SELECT news_id, {S.payload('ticker', 'risk', '0.7::DOUBLE', 'event_ts')} AS payload FROM s")
def f_payload(t: Tables) -> DataFrame:
    at = F.col("event_ts")
    return scalars(t).select("news_id", scoring.notification_payload(
        F.col("ticker"), F.col("risk"), F.lit(0.7), at, at).alias("payload"))


@query("f_suppression_reason", f"{SCALARS} SELECT news_id, CASE WHEN event_id % 3 = 0 THEN 'cooldown' ELSE 'threshold_not_met' END AS reason FROM s")
def f_suppression_reason(t: Tables) -> DataFrame:
    return scalars(t).select("news_id", suppression_reason(
        F.col("event_id") % 3 == 0).alias("reason"))


@query("f_keyword_sentiment", f"""{NEWS} SELECT news_id,
  {S.headline_sentiment("lower(headline)", dims.FIRST_MATCH_NEGATIVE, dims.FIRST_MATCH_POSITIVE)} AS sentiment FROM news""")
def f_keyword_sentiment(t: Tables) -> DataFrame:
    return V.news(t).select("news_id", scoring.keyword_sentiment(F.col("headline")).alias("sentiment"))


@query("f_simple_sentiment", f"""{NEWS} SELECT news_id,
  {S.headline_sentiment("lower(headline)", dims.SIMPLE_NEGATIVE, dims.SIMPLE_POSITIVE)} AS sentiment FROM news""")
def f_simple_sentiment(t: Tables) -> DataFrame:
    return V.news(t).select("news_id", scoring.simple_sentiment(F.col("headline")).alias("sentiment"))


@query("f_context_bias", f"""{SCALARS} SELECT news_id, round(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, score + (risk - 0.5::DOUBLE) * 0.3::DOUBLE)), 6) AS sentiment FROM s""")
def f_context_bias(t: Tables) -> DataFrame:
    return scalars(t).select("news_id", F.round(scoring.with_bias(
        F.col("score"), F.col("risk") - 0.5), 6).alias("sentiment"))


ROUTED_TICKER = "CASE WHEN doc_id % 7 = 0 THEN 'aapl' ELSE 'T1' END"


@query("f_route_tier", f"""{NEWS} SELECT news_id, {S.slow_test('headline', 'lower(headline)', ROUTED_TICKER)} AS headline_slow,
  {S.slow_test('full_body', 'low', None)} AS slow FROM texts""")
def f_route_tier(t: Tables) -> DataFrame:
    ticker = F.when(F.col("news_id").cast("long") % 7 == 0, "aapl").otherwise("T1")
    whole = text.full_text(F.col("headline"), F.col("full_text"))
    return V.news(t).select(
        "news_id", scoring.needs_slow_scorer(F.col("headline"), ticker).alias("headline_slow"),
        scoring.needs_slow_scorer(whole).alias("slow"))


# fixed list of labels to score, chosen by event
LABELS = ["negative", "Positive", "NEUTRAL", "1 star", "2 stars", "3 stars", "4 stars", "5 stars",
          "2", "4", "LABEL_0", "LABEL_1", "LABEL_2", "other"]


def _labelled(t: Tables) -> DataFrame:
    labels = F.array(*[F.lit(v) for v in LABELS])
    return scalars(t).withColumn("label", F.element_at(
        labels, (F.col("event_id") % len(LABELS) + 1).cast("int")))


LABELLED = f"""{SCALARS}, l AS (SELECT *, {V.sql_list(LABELS)}[event_id % {len(LABELS)} + 1] AS label FROM s)"""


@query("f_label_score", f"""{LABELLED} SELECT news_id, label, CASE
  WHEN contains(lower(label), 'negative') OR contains(label, '1') THEN -risk
  WHEN contains(lower(label), 'positive') OR contains(label, '5') THEN risk
  WHEN contains(lower(label), 'neutral') OR contains(label, '3') THEN 0.0::DOUBLE
  WHEN regexp_full_match(label, '[0-9]+') THEN (CAST(label AS DOUBLE) - 3.0::DOUBLE) / 2.0::DOUBLE ELSE 0.0::DOUBLE END AS score FROM
  (SELECT news_id, label, CASE WHEN regexp_full_match(label, '[0-9]+') THEN label ELSE label END AS l2, risk FROM l)""".replace(
      "(CAST(label AS DOUBLE)", "(TRY_CAST(label AS DOUBLE)"))
def f_label_score(t: Tables) -> DataFrame:
    return _labelled(t).select("news_id", "label", scoring.label_score(
        F.col("label"), F.col("risk")).alias("score"))


@query("f_label_maps", f"""{LABELLED} SELECT news_id, CASE lower(label) WHEN 'positive' THEN 1.0::DOUBLE WHEN 'negative' THEN -1.0::DOUBLE ELSE 0.0::DOUBLE END AS polarity,
  CASE label WHEN 'LABEL_0' THEN -1.0::DOUBLE WHEN 'LABEL_2' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS numbered FROM l""")
def f_label_maps(t: Tables) -> DataFrame:
    label = F.col("label")
    return _labelled(t).select("news_id", scoring.polarity_label(label).alias("polarity"),
                               scoring.numbered_label(label).alias("numbered"))


@query("f_confidence", f"{SCALARS} SELECT news_id, abs(sentiment) AS confidence FROM s")
def f_confidence(t: Tables) -> DataFrame:
    return scalars(t).select("news_id", F.abs("sentiment").alias("confidence"))


@query("f_word_match", f"""{NEWS} SELECT news_id, {S.word_test("low", "tesla")} AS tesla, {S.word_test("low", "at&t")} AS att,
  {S.word_test("low", "that")} AS that_word FROM texts""")
def f_word_match(t: Tables) -> DataFrame:
    body = text.full_text(F.col("headline"), F.col("full_text"))
    return V.news(t).select("news_id", text.word_match(body, "tesla").alias("tesla"),
                            text.word_match(body, "at&t").alias("att"),
                            text.word_match(body, "that").alias("that_word"))


@query("f_full_text", f"""{NEWS} SELECT news_id, CASE WHEN doc_id % 3 = 0 THEN headline ELSE headline || ' ' || full_text END AS joined,
  headline || ' ' || CASE WHEN doc_id % 3 = 0 THEN '' ELSE full_text END AS prefilter FROM news""")
def f_full_text(t: Tables) -> DataFrame:
    d = F.col("news_id").cast("long")
    body = F.when(d % 3 != 0, F.col("full_text")).when(d % 2 == 0, F.lit(""))
    return V.news(t).select("news_id", text.full_text(F.col("headline"), body).alias("joined"),
                            text.prefilter_text(F.col("headline"), body).alias("prefilter"))


# the feature is a bounded model input; scoring itself reads whole texts unless told otherwise
@query("f_truncate", f"{NEWS} SELECT news_id, md5(left(full_text, 512)) AS head, length(left(full_text, 512)) AS n FROM news")
def f_truncate(t: Tables) -> DataFrame:
    cut = F.substring("full_text", 1, 512)
    return V.news(t).select("news_id", F.md5(cut).alias("head"), F.length(cut).cast("long").alias("n"))


@query("f_to_json", f"""{SCALARS} SELECT news_id, '{{"news_id":"' || news_id || '","event_ts":"' || strftime(event_ts, '%Y-%m-%dT%H:%M:%SZ') ||
  '","ticker":"' || ticker || '","role":"' || role || '","sentiment":' || CAST(sentiment AS VARCHAR) || '}}' AS json FROM s""")
def f_to_json(t: Tables) -> DataFrame:
    return scalars(t).select("news_id", codecs.to_record(
        F.col("news_id"), codecs.format_iso(F.col("event_ts")).alias("event_ts"), F.col("ticker"),
        F.col("role"), F.col("sentiment")).alias("json"))


@query("f_from_json", f"{SCALARS} SELECT news_id, event_ts, ticker, role, sentiment FROM s")
def f_from_json(t: Tables) -> DataFrame:
    record = codecs.to_record(F.col("news_id"), codecs.format_iso(F.col("event_ts")).alias("event_ts"),
                              F.col("ticker"), F.col("role"), F.col("sentiment"))
    back = codecs.from_record(record, "news_id string, event_ts timestamp, ticker string, "
                                      "role string, sentiment double")
    return scalars(t).select(back.alias("r")).select("r.*")
