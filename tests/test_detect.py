import re
import random

import pytest
from helpers import news
from pyspark.sql import functions as F

from tidewatch import dims
from tidewatch.functions.text import word_match, word_pattern
from tidewatch.operators import detect, enrich

CASES = [
    ("Tesla shuts a line after a factory closure", "Output stops.", [("TSLA", "primary", "tesla")]),
    ("Teslamotors production", None, []),
    ("Tesla's production", None, [("TSLA", "primary", "tesla")]),
    ("cat food maker", "indicates", []),
    ("Carmakers grow", "Several firms, Tesla too", [("TSLA", "mentioned", "tesla")]),
    ("Apple finds partners", "With Microsoft and Google on board",
     [("MSFT", "mentioned", "microsoft"), ("GOOGL", "mentioned", "google"), ("AAPL", "primary", "apple")]),
    # the longest keyword alone sets the role
    ("Tesla update", "Cybertruck recall", [("TSLA", "mentioned", "cybertruck")]),
    ("Tesla Model 3 and Tesla Model Y", "Tesla Tesla", [("TSLA", "primary", "model 3")]),
    ("AT&T and J&J meet", "sam's club opens",
     [("WMT", "mentioned", "sam's club"), ("T", "primary", "at&t"), ("JNJ", "primary", "j&j")]),
    ("F-150 beats 150 rivals", "", [("F", "primary", "f-150")]),
    ("General Electric grows", "general motors follows",
     [("GE", "primary", "general electric"), ("GM", "mentioned", "general motors")]),
    ("ÉTESLA and teslaé", "x_tesla tesla_", []),
    ("Teſla in old print", "", [("TSLA", "primary", "tesla")]),
]


def test_cases(spark):
    got = detect.detect_companies(news(spark, [(h, b) for h, b, _ in CASES]))
    found = {}
    for r in got.orderBy("position").collect():
        found.setdefault(r.news_id, []).append((r.ticker, r.role, r.keyword))
    for i, (_, _, want) in enumerate(CASES):
        assert found.get(str(i), []) == want, CASES[i]


def test_table_form_agrees(spark):
    rows = news(spark, [(h, b) for h, b, _ in CASES])
    a = detect.detect_companies(rows).select("news_id", "ticker", "role", "keyword")
    b = detect.detect_companies_by_dim(rows, dims.keyword_dim(spark)).select(
        "news_id", "ticker", "role", "keyword")
    assert sorted(a.collect()) == sorted(b.collect())


def test_against_plain_python_on_random_text(spark):
    rnd = random.Random(5)
    kws = [k for k, _, _ in dims.keyword_rows()]
    glue = [" ", "-", "'s ", "_", "x", ", ", "\n", "é", "&", "."]
    texts = ["".join(rnd.choice(kws).upper() + rnd.choice(glue) for _ in range(6)) for _ in range(60)]
    rows = news(spark, [(t, None) for t in texts])
    got = {}
    for r in detect.keyword_hits(rows).collect():
        got.setdefault(r.news_id, set()).add(r.keyword)
    for i, t in enumerate(texts):
        want = {k for k in kws if re.search(r"\b" + re.escape(k) + r"\b", t.lower(), re.IGNORECASE)}
        assert got.get(str(i), set()) == want, t


def test_first_match_is_substring(spark):
    cases = {"Tesla halts production": ("TSLA", -0.7), "Apple expands capacity": ("AAPL", 0.7),
             "General news about prices": ("GE", 0.0), "TESLA and Apple meet": ("AAPL", 0.0),
             "Foxconn delays continue": ("AAPL", -0.7), "Indicates": ("CAT", 0.0), "Zzz": None}
    rows = news(spark, [(h, None) for h in cases])
    got = {r.headline: (r.ticker, r.sentiment) for r in detect.detect_first_match(rows).collect()}
    assert got == {h: v for h, v in cases.items() if v}


def test_simple_takes_the_first_listed(spark):
    rows = news(spark, [("Apple and Tesla expand", None), ("Nobody", None)])
    got = detect.detect_simple(rows).collect()
    assert [(r.ticker, r.sentiment) for r in got] == [("TSLA", 0.7)]


def test_enrich_and_modes(spark):
    rows = news(spark, [("Tesla recall", "production delay"), ("Nothing here", None)])
    out = {r.news_id: r.companies for r in enrich.enrich_news(rows).collect()}
    assert out["1"] == [] and out["0"][0].ticker == "TSLA"
    assert out["0"][0].sentiment == pytest.approx(-0.78)
    assert enrich.drop_unmentioned(enrich.enrich_news(rows)).count() == 1
    for mode in enrich.ENRICHERS.values():
        assert enrich.to_mention_events(mode(rows)).first().ticker == "TSLA"


def test_enrichment_is_computed_once_per_row(spark):
    rows = news(spark, [("Tesla recall", "production delay")])
    plan = enrich.to_mention_events(enrich.enrich_news(rows))._jdf.queryExecution().executedPlan()
    assert plan.toString().count("taiwan semiconductor") == 1
    assert plan.toString().count("array_intersect") <= 2


@pytest.mark.parametrize("kw", [".net", "c++", "at&t", "x"])
def test_word_pattern_equals_python_boundaries(spark, kw):
    texts = [f"{a}{kw}{b}" for a in ("", "a", " ", "-", "1") for b in ("", "a", " ", "-", "1")]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r.m for r in df.select(word_match(F.col("t"), kw).alias("m")).collect()]
    assert got == [bool(re.search(r"\b" + re.escape(kw) + r"\b", t)) for t in texts], word_pattern(kw)


def test_dimension_sizes_and_lookups(spark):
    companies = dims.company_dim(spark)
    assert companies.count() == 42 and dims.keyword_dim(spark).count() == 126
    assert dims.keyword_dim(spark, "first_match").count() == 127
    assert detect.suppliers(companies).count() == 8
    assert detect.companies_by_sector(companies, "Energy").count() == 2
    assert detect.sector_summary(companies).count() == 11
    df = spark.createDataFrame([("TSLA",), ("NOPE",)], "ticker string")
    got = {r.ticker: r.sector for r in detect.lookup_company(df, companies).collect()}
    assert got == {"TSLA": "Automotive", "NOPE": None}


def test_user_keywords_are_folded_and_the_first_company_wins(spark):
    from tidewatch.operators import detect
    keys = [("Tesla", "TSLA", 1), ("tesla", "OTHER", 2), ("Q\\E plant", "QE", 3)]
    news = spark.createDataFrame(
        [("1", "TESLA opens", "a"), ("2", "the q\\e plant burns", "b"), ("3", "nothing", "c")],
        "news_id string, headline string, full_text string")
    plain = {(r.news_id, r.ticker) for r in detect.detect_companies(news, keys).collect()}
    dim = spark.createDataFrame(keys, "keyword string, ticker string, ord int")
    by_dim = {(r.news_id, r.ticker) for r in detect.detect_companies_by_dim(news, dim).collect()}
    assert plain == by_dim == {("1", "TSLA"), ("2", "QE")}


def test_headline_and_body_are_folded_apart_and_matched_as_one_text(spark):
    rows = [("a", "Made by General", "Motors in Ford"), ("b", "Tesla", ""), ("c", "Tesla", None),
            ("d", None, "Tesla"), ("e", "", "Apple"), ("f", "Tes", "la")]
    news = spark.createDataFrame(rows, "news_id string, headline string, full_text string")
    hits = detect.with_keyword_hits(news)
    got = {r["news_id"]: [(h["keyword"], h["role"]) for h in r["_hits"] or []] for r in hits.collect()}
    assert got == {"a": [("general motors", "mentioned"), ("ford", "mentioned")], "b": [("tesla", "primary")],
                   "c": [("tesla", "primary")], "d": [], "e": [("apple", "mentioned")], "f": []}
    plan = hits._jdf.queryExecution().optimizedPlan().toString()
    assert "concat(headline" not in plan  # the headline is not folded and tokenised a second time
