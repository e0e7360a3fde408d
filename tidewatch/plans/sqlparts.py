"""SQL building blocks of the oracle: keyword matching, categories, routing, cooldown."""

from __future__ import annotations

import re

from tidewatch import dims
from tidewatch.plans.views import sql_text


def values(rows, columns: str, name: str) -> str:
    def cell(v) -> str:
        if isinstance(v, bool):
            return "TRUE" if v else "FALSE"
        if isinstance(v, str):
            return sql_text(v)
        if isinstance(v, float):
            return f"{v}::DOUBLE"
        return str(v)
    body = ", ".join("(" + ", ".join(cell(v) for v in row) + ")" for row in rows)
    return f"{name} AS (SELECT * FROM (VALUES {body}) AS v({columns}))"


FIRST_MATCH_KEYWORDS = values(dims.keyword_rows("first_match"), "keyword, ticker, ord", "kw")
COMPANIES = values([(t, n, s, sup) for t, n, s, sup, _ in dims.COMPANIES],
                   "ticker, official_name, sector, is_supplier", "companies")
CATEGORIES = values([(i, c, m, b) for i, (c, m, b, _) in enumerate(dims.CATEGORIES)],
                    "ord, category, multiplier, bias", "cats")
PHRASES = values([(c, p) for c, _, _, ps in dims.CATEGORIES for p in ps],
                 "category, phrase", "phrases")


def word_test(text: str, keyword: str) -> str:
    """Word-boundary match of a constant, the substring test first because it is cheap."""
    pattern = f"(^|[^\\p{{L}}\\p{{N}}_]){re.escape(keyword)}($|[^\\p{{L}}\\p{{N}}_])"
    return (f"CASE WHEN contains({text}, {sql_text(keyword)}) "
            f"THEN regexp_matches({text}, {sql_text(pattern)}) ELSE FALSE END")


def hits(rows=None) -> str:
    """CTEs ending in ``hits``, all keyword matches over ``texts``; every pattern is a constant."""
    rows = dims.keyword_rows() if rows is None else rows
    both = ", ".join(
        f"CASE WHEN {word_test('low', k)} THEN CASE WHEN {word_test('head', k)} THEN "
        f"'primary' ELSE 'mentioned' END END" for k, _, _ in rows)
    return f"""{values(rows, "keyword, ticker, ord", "kw")},
roles AS (SELECT news_id, unnest([{both}]) AS role, unnest(range({len(rows)})) AS ord
          FROM (SELECT news_id, low, lower(headline) AS head FROM texts)),
hits AS (SELECT r.news_id, k.keyword, k.ticker, k.ord, r.role
         FROM roles r JOIN kw k USING (ord) WHERE r.role IS NOT NULL)"""


DETECTED = """detected AS (
  SELECT news_id, ticker, role, keyword, ord,
         row_number() OVER (PARTITION BY news_id ORDER BY length(keyword) DESC, ord) AS position
  FROM (SELECT *, row_number() OVER (PARTITION BY news_id, ticker
                                     ORDER BY length(keyword) DESC, ord) AS r FROM hits)
  WHERE r = 1)"""


def any_phrase(text: str, phrases) -> str:
    return "(" + " OR ".join(f"contains({text}, {sql_text(p)})" for p in phrases) + ")"


CONTEXT = f"""{CATEGORIES},
{PHRASES},
matched AS (
  SELECT DISTINCT t.news_id, c.ord, c.category, c.multiplier, c.bias
  FROM texts t JOIN phrases p ON contains(t.low, p.phrase) JOIN cats c USING (category)),
context AS (
  SELECT t.news_id, coalesce(product(m.multiplier), 1.0::DOUBLE) AS risk_multiplier,
         coalesce(avg(m.bias), 0.0::DOUBLE) AS sentiment_bias,
         count(m.category) AS n_categories,
         coalesce(string_agg(m.category, '|' ORDER BY m.ord), '') AS categories
  FROM texts t LEFT JOIN matched m USING (news_id) GROUP BY t.news_id)"""

KEYWORD_SCORE = "greatest(-1.0::DOUBLE, least(1.0::DOUBLE, sentiment_bias + sentiment_bias * 0.3::DOUBLE))"


def slow_test(text: str, low: str, ticker: str | None) -> str:
    company = (f"upper({ticker}) IN ({', '.join(sql_text(t) for t in dims.ROUTE_TICKERS)})"
               if ticker else "FALSE")
    return (f"(length({text}) > {dims.ROUTE_LENGTH} OR coalesce({company}, FALSE) OR "
            f"{any_phrase(low, dims.ROUTE_WORDS + dims.ROUTE_PHRASES)})")


def headline_sentiment(low: str, negative, positive) -> str:
    return (f"CASE WHEN {any_phrase(low, negative)} THEN -0.7::DOUBLE "
            f"WHEN {any_phrase(low, positive)} THEN 0.7::DOUBLE ELSE 0.0::DOUBLE END")


def cooldown(source: str, name: str = "decided", minutes: int = 30, ok: str = "TRUE",
             extra: str = "") -> str:
    """Recursive CTE: greedy cooldown over ``source`` (ticker, window_end, risk_score_5m, threshold)."""
    end = f"s.window_end + INTERVAL {minutes} MINUTE"
    over = "s.risk_score_5m > s.threshold"
    cool = "s.window_end < w.blocked"
    fires = f"{over} AND {ok}"
    return f"""seq AS (
  SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY window_end) AS rn FROM {source}),
walk AS (
  SELECT s.ticker, s.rn, FALSE AS cooling,
         CASE WHEN {fires} THEN {end} ELSE TIMESTAMP '1970-01-01' END AS blocked
  FROM seq s WHERE s.rn = 1
  UNION ALL
  SELECT s.ticker, s.rn, {cool},
         CASE WHEN NOT ({cool}) AND {fires} THEN {end} ELSE w.blocked END
  FROM walk w JOIN seq s ON s.ticker = w.ticker AND s.rn = w.rn + 1),
{name} AS (
  SELECT s.*, CASE WHEN w.cooling OR NOT ({over}) THEN 'suppressed' WHEN {ok} THEN 'sent'
                   ELSE 'failed' END AS status,
         CASE WHEN w.cooling THEN 'cooldown' WHEN NOT ({over}) THEN 'threshold_not_met' END AS reason{extra}
  FROM seq s JOIN walk w USING (ticker, rn))"""


def severity(risk: str) -> str:
    return f"CASE WHEN {risk} >= 0.8 THEN 'high' WHEN {risk} >= 0.6 THEN 'medium' ELSE 'low' END"


# fixed values in the two functions below: message texts, emoji, colours, titles
def message(ticker: str, risk: str) -> str:
    return (f"CASE WHEN {risk} >= 0.8 THEN 'CRITICAL: High supply chain risk detected for ' "
            f"WHEN {risk} >= 0.6 THEN 'WARNING: Medium supply chain risk for ' "
            f"ELSE 'NOTICE: Supply chain risk alert for ' END || {ticker} || ' (risk: ' || "
            f"printf('%.3f', {risk}) || ')'")


def payload(ticker: str, risk: str, threshold: str, end: str) -> str:
    def pick(high: str, medium: str, low: str) -> str:
        return f"CASE WHEN {risk} >= 0.8 THEN '{high}' WHEN {risk} >= 0.6 THEN '{medium}' ELSE '{low}' END"
    return f"""'{{"text":"' || {pick("🔴", "🟡", "🟢")} || ' Supply Chain Risk Alert","attachments":[{{"color":"' ||
 {pick("#ff0000", "#ffaa00", "#00aa00")} || '","title":"' || {pick("CRITICAL", "WARNING", "NOTICE")} ||
 ' Risk Alert: ' || {ticker} || '","text":"' || {message(ticker, risk)} ||
 '","fields":[{{"title":"Risk Score","value":"' || printf('%.3f', {risk}) ||
 '","short":true}},{{"title":"Threshold","value":"' || printf('%.3f', {threshold}) ||
 '","short":true}},{{"title":"Window End","value":"' || strftime({end}, '%Y-%m-%d %H:%M:%S') ||
 ' UTC","short":false}}],"footer":"Supply Chain Risk Monitor","ts":' ||
 CAST(CAST(epoch({end}) AS BIGINT) AS VARCHAR) || '}}]}}'"""


def record_value(fields: list[tuple[str, str]], version: str, ingest: str) -> str:
    """JSON record: (name, kind) with kind text, time or number."""
    parts = []
    for name, kind in fields:
        shown = {"text": f"'\"' || {name} || '\"'",
                 "time": f"'\"' || strftime({name}, '%Y-%m-%dT%H:%M:%SZ') || '\"'",
                 "number": f"CAST({name} AS VARCHAR)"}[kind]
        parts.append(f"'\"{name}\":' || {shown}")
    parts.append(f"'\"_ver\":\"{version}\"'")
    parts.append(f"'\"_ingest_ts\":\"' || strftime({ingest}, '%Y-%m-%dT%H:%M:%SZ') || '\"'")
    return "'{' || " + " || ',' || ".join(parts) + " || '}'"
