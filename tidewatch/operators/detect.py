"""Company detection: word match, first match and simple match."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch import dims
from tidewatch.functions.scoring import keyword_sentiment, simple_sentiment, simple_ticker
from tidewatch.functions.text import (anchor_word, anchor_word_column, bind, first_matching, fold,
                                      full_text, is_one_word, tokens, word_pattern,
                                      word_pattern_column)
from tidewatch.operators.common import once

def _keyword_table(keywords) -> str:
    """SQL constant: the keywords in matching order, with anchor word and pattern."""
    def text(value: str) -> str:
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"

    rows = [f"named_struct('keyword', {text(k)}, 'ticker', {text(t)}, 'ord', {i}, "
            f"'anchor', {text(anchor_word(k))}, 'one_word', {str(is_one_word(k)).lower()}, "
            f"'pattern', {text(word_pattern(k))})" for k, t, i in dims.longest_first(keywords)]
    return f"array({', '.join(rows)})"


def _folded(keywords) -> list[tuple]:
    """Keywords in the texts' folded form; of equal ones the first in order counts."""
    rows: dict[str, tuple] = {}
    for keyword, ticker, ord_ in sorted(keywords, key=lambda r: r[2]):
        low = keyword.lower().translate(str.maketrans("\u017f\u0131", "si"))
        rows.setdefault(low, (low, ticker, ord_))
    return list(rows.values())


def with_keyword_hits(news: DataFrame, keywords=None) -> DataFrame:
    """Adds ``_hits``: array<struct<keyword, ticker, ord, role>> in matching order.

    A row expression: no shuffle and no row explosion. Headline and body are folded and tokenised once
    each: the blank between them ends a word, so the text's tokens are those of both. A one-word keyword
    matches exactly where it is a token; the others run a regular expression on the whole text, and only
    where their anchor word is a token.
    """
    keywords = _folded(dims.keyword_rows() if keywords is None else keywords)
    anchors = F.array(*[F.lit(a) for a in sorted({anchor_word(k) for k, _, _ in keywords})])
    head, body = F.col("_low.head"), F.col("_low.body")
    lowered = once(news, "_low", F.struct(
        fold(F.col("headline")).alias("head"),
        F.when(F.length("full_text") > 0, fold(F.col("full_text"))).alias("body")))

    def met(part: Column) -> Column:
        return F.array_intersect(tokens(part), anchors)
    # a missing body adds nothing, a missing headline leaves no text
    seen = once(lowered, "_seen", bind(met(head), lambda h: F.struct(
        h.alias("head"), F.when(body.isNull(), h).otherwise(F.array_union(h, met(body))).alias("text"))))
    whole = "IF(_low.body IS NULL, _low.head, concat(_low.head, ' ', _low.body))"
    hits = F.expr(f"""
        transform(
          filter({_keyword_table(keywords)},
                 k -> array_contains(_seen.text, k.anchor)
                      AND (k.one_word OR {whole} rlike k.pattern)),
          k -> named_struct('keyword', k.keyword, 'ticker', k.ticker, 'ord', k.ord, 'role',
               IF(array_contains(_seen.head, k.anchor)
                  AND (k.one_word OR _low.head rlike k.pattern), 'primary', 'mentioned')))""")
    return once(seen, "_hits", hits).drop("_low", "_seen")


def with_company_hits(news: DataFrame, keywords=None) -> DataFrame:
    """Adds ``_hits`` with one entry per ticker: the longest keyword decides, and sets the role."""
    return once(with_keyword_hits(news, keywords).withColumnRenamed("_hits", "_all"), "_hits",
                F.expr("""filter(_all, (h, i) -> NOT exists(slice(_all, 1, i),
                          earlier -> earlier.ticker = h.ticker))""")).drop("_all")


def detect_companies(news: DataFrame, keywords=None) -> DataFrame:
    """One row per (article, company): the article's columns, ticker, role, keyword, position."""
    return (with_company_hits(news, keywords)
            .select(*news.columns, F.posexplode_outer("_hits").alias("position", "_h"))
            .filter(F.col("_h").isNotNull())
            .select(*news.columns, F.col("_h.ticker").alias("ticker"),
                    F.col("_h.role").alias("role"), F.col("_h.keyword").alias("keyword"),
                    (F.col("position") + 1).alias("position")))


def detect_companies_by_dim(news: DataFrame, keyword_dim: DataFrame) -> DataFrame:
    """The same for a keyword table of any size: (keyword, ticker, ord).

    Keywords are folded like the texts; of equal ones the first in order counts. Tokens meet anchor
    words in an equi-join (no nested loop over articles x keywords), and only the candidates run a
    regular expression. Tokens that are no anchor, the frequent words above all, are dropped before
    they are joined; where the anchors are few, Spark broadcasts them and no token is shuffled.
    """
    folded = (keyword_dim.groupBy(fold(F.col("keyword")).alias("keyword"))
              .agg(F.min_by(F.struct("ticker", "ord"), "ord").alias("first"))
              .select("keyword", "first.ticker", "first.ord"))
    words = folded.select(
        "keyword", "ticker", "ord", anchor_word_column(F.col("keyword")).alias("token"),
        word_pattern_column(F.col("keyword")).alias("_pattern"))
    text = fold(full_text(F.col("headline"), F.col("full_text")))
    low = once(news, "_low", F.struct(text.alias("text"), fold(F.col("headline")).alias("head")))
    low = low.select("news_id", "_low")
    seen = low.select("news_id", F.explode_outer(F.array_distinct(tokens(F.col("_low.text"))))
                      .alias("token")).join(words.select("token").distinct(), "token", "left_semi")
    candidates = seen.join(words, "token").select("news_id", "keyword", "ticker", "ord", "_pattern")
    hits = (low.join(candidates, "news_id").filter(F.expr("_low.text rlike _pattern"))
            .select("news_id", "ticker", "keyword", "ord",
                    F.when(F.expr("_low.head rlike _pattern"), "primary").otherwise("mentioned")
                    .alias("role")))
    return longest_keyword_per_ticker(hits)


def longest_keyword_per_ticker(hits: DataFrame) -> DataFrame:
    """Keeps the longest keyword (ties: dimension order) per (news_id, ticker)."""
    best = Window.partitionBy("news_id", "ticker").orderBy(F.length("keyword").desc(), "ord")
    return hits.withColumn("_r", F.row_number().over(best)).filter(F.col("_r") == 1).drop("_r")


def mention_order(mentions: DataFrame) -> DataFrame:
    """Position of every mention within its article: longest keyword first."""
    order = Window.partitionBy("news_id").orderBy(F.length("keyword").desc(), "ord")
    return mentions.withColumn("position", F.row_number().over(order))


def keyword_hits(news: DataFrame, keywords=None) -> DataFrame:
    """All (article, keyword) matches before the choice per ticker, one row each."""
    return (with_keyword_hits(news, keywords)
            .select("news_id", F.explode_outer("_hits").alias("h")).filter(F.col("h").isNotNull())
            .select("news_id", "h.keyword", "h.ticker", "h.ord"))


def detect_first_match(news: DataFrame, keywords=None) -> DataFrame:
    """Headline only, substring match, the longest keyword overall; at most one mention."""
    rows = dims.longest_first(dims.keyword_rows("first_match") if keywords is None else keywords)
    hit = first_matching(F.col("headline"), [
        (k, F.struct(F.lit(t).alias("ticker"), F.lit(k).alias("keyword"))) for k, t, _ in rows])
    return (news.withColumn("_hit", hit).filter(F.col("_hit").isNotNull())
            .select(*news.columns, F.col("_hit.ticker").alias("ticker"),
                    F.lit("primary").alias("role"), F.col("_hit.keyword").alias("keyword"),
                    keyword_sentiment(F.col("headline")).alias("sentiment")))


def detect_simple(news: DataFrame) -> DataFrame:
    """Five keywords in listed order, headline only; at most one mention."""
    return (news.withColumn("ticker", simple_ticker(F.col("headline")))
            .filter(F.col("ticker").isNotNull())
            .withColumn("sentiment", simple_sentiment(F.col("headline"))))


def lookup_company(df: DataFrame, companies: DataFrame) -> DataFrame:
    """Adds official name, sector and supplier flag; unknown tickers get nulls."""
    return df.join(companies.select("ticker", "official_name", "sector", "is_supplier"),
                   "ticker", "left")


def suppliers(companies: DataFrame) -> DataFrame:
    return companies.filter(F.col("is_supplier"))


def companies_by_sector(companies: DataFrame, sector: str) -> DataFrame:
    return companies.filter(F.col("sector") == sector)


def sector_summary(companies: DataFrame) -> DataFrame:
    return companies.groupBy("sector").agg(
        F.count("*").alias("companies"), F.count_if(F.col("is_supplier")).alias("suppliers"))
