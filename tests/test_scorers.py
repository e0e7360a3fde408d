import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from tidewatch.functions import scoring
from tidewatch.operators import scorers

# the models below live in this file, which tasks cannot import
cloudpickle.register_pickle_by_value(sys.modules[__name__])

PHRASES = [
    ("A factory closure and a partnership", 1.6, -0.1, ["critical_disruption", "positive_developments"]),
    ("Factory closure, manufacturing halt", 2.0, -0.8, ["critical_disruption"]),
    ("Production delay and recall", 1.5, -0.6, ["operational_issues"]),
    ("A sunny day", 1.0, 0.0, []),
]


def texts(spark, rows):
    return spark.createDataFrame([(str(i), t) for i, t in enumerate(rows)],
                                 "news_id string, text string")


def test_category_context(spark):
    df = texts(spark, [p[0] for p in PHRASES])
    got = df.select("news_id", scoring.category_context(F.col("text")).alias("c")).orderBy("news_id")
    for row, (_, mult, bias, cats) in zip(got.collect(), PHRASES):
        assert row.c.risk_multiplier == pytest.approx(mult)
        assert row.c.sentiment_bias == pytest.approx(bias)
        assert list(row.c.categories) == cats


def test_keyword_scorer_and_blank_text(spark):
    out = {r.news_id: r.result for r in scorers.score_keyword(
        texts(spark, ["Production delay", " \n ", "Factory closure"])).collect()}
    assert out["0"].sentiment == pytest.approx(-0.78) and out["0"].confidence == 0.3
    assert out["0"].reasoning == "Categories: ['operational_issues']"
    assert (out["1"].sentiment, out["1"].confidence, out["1"].risk_factor, out["1"].model_used) == (
        0.0, 0.0, 1.0, "none")
    assert out["2"].sentiment == -1.0


def test_routing(spark):
    df = spark.createDataFrame(
        [("Company reports profit", "X"), ("Factory closure ahead", "X"), ("New product", "aapl"),
         ("x" * 201, "X"), ("Small update", "UNKNOWN"), ("Small update", None)],
        "text string, ticker string")
    got = df.select(scoring.needs_slow_scorer(F.col("text"), F.col("ticker")).alias("s"))
    assert [r.s for r in got.collect()] == [True, True, True, True, False, False]


def test_labels(spark):
    df = spark.createDataFrame([("1 star",), ("2 stars",), ("3 stars",), ("4",), ("5 stars",),
                                ("Positive",), ("negative",), ("LABEL_0",), ("?",)], "l string")
    got = df.select(scoring.label_score(F.col("l"), F.lit(0.9)).alias("s"))
    assert [r.s for r in got.collect()] == [-0.9, 0.0, 0.0, 0.5, 0.9, 0.9, -0.9, 0.0, 0.0]


def failing_model():
    def score(batch):
        raise RuntimeError("no answer")
    return score


def counting_model():
    def score(batch):
        assert all("slow" in t for t in batch), "only routed texts may reach the model"
        return [("5 stars", 0.8) for _ in batch]
    return score


def whole_text_model():
    return lambda batch: [("positive", len(t) / 1000.0) for t in batch]


def lexicon(spark):
    return spark.createDataFrame([("good", 2.0), ("bad", -2.0)], "word string, valence double")


def test_model_falls_back_to_the_lexicon(spark):
    out = scorers.score_model(texts(spark, ["good good bad"]), failing_model, lexicon(spark)).first()
    assert out.result.model_used == "lexicon_fallback"
    assert out.result.sentiment == pytest.approx(2 / (4 + 15) ** 0.5)
    out = scorers.score_model(texts(spark, ["recall"]), failing_model).first()
    assert out.result.model_used == "keyword_fallback"


def test_model_sees_whole_texts_unless_told(spark):
    df = texts(spark, ["x" * 900])
    assert scorers.score_model(df, whole_text_model).first().result.confidence == 0.9
    assert scorers.score_model(df, whole_text_model, max_chars=512).first().result.confidence == 0.512


def test_tiered_scores_every_row_once(spark):
    df = spark.createDataFrame([("1", "A", "slow earnings"), ("1", "B", "slow earnings"),
                                ("2", "A", "good day")], "news_id string, ticker string, text string")
    out = scorers.score_tiered(df, counting_model, lexicon(spark), key=["news_id", "ticker"])
    got = {(r.news_id, r.ticker): r.result for r in out.collect()}
    assert got[("1", "A")].model_used == got[("1", "B")].model_used == "model"
    assert got[("1", "A")].sentiment == 0.8
    assert got[("2", "A")].model_used == "lexicon_fast"
    assert got[("2", "A")].sentiment == pytest.approx(2 / 19 ** 0.5)


def test_ensemble(spark):
    df = spark.createDataFrame([(0.5, 0.5, -1.0, 0.25), (0.4, 0.0, 0.2, 0.0), (None, 0.9, 0.3, 0.6),
                                (None, None, None, None)], "a double, ca double, b double, cb double")
    e = scoring.ensemble([F.col("a"), F.col("b")], [F.col("ca"), F.col("cb")])
    got = [tuple(r.e) for r in df.select(e.alias("e")).collect()]
    assert got[0] == (pytest.approx(0.0), pytest.approx(0.375))
    assert got[1] == (pytest.approx(0.3), 0.5)
    assert got[2] == (pytest.approx(0.3), pytest.approx(0.6))
    assert got[3] == (None, None)


def test_one_bad_text_costs_no_other_text_its_answer(spark):
    def picky():
        def score(batch):
            if any("bad" in t for t in batch):
                raise ValueError("cannot read this")
            return [("positive", 0.5)] * len(batch)
        return score
    rows = texts(spark, ["one", "two", "a bad one", "three", "four", "five"]).coalesce(1)
    got = {r.text: r.model_score for r in scorers.model_scores(rows, picky).collect()}
    assert got.pop("a bad one") is None
    assert set(got.values()) == {0.5}


def exchanged(df, capsys):
    """Names of the columns that the plan shuffles."""
    import re
    df.explain("formatted")
    out = capsys.readouterr().out
    found = re.findall(r"\) Exchange\nInput \[\d+\]: \[([^\]]*)\]", out)
    assert found
    return {re.sub(r"#\d+L?$", "", c.strip()) for f in found for c in f.split(",")}


@pytest.mark.parametrize("kind", ["lexicon", "model", "tiered", "ensemble"])
def test_no_text_is_shuffled(spark, tmp_path, capsys, kind):
    rows = spark.createDataFrame([(str(i), f"text {i} with words", "X") for i in range(9)],
                                 "news_id string, text string, ticker string")
    rows.write.parquet(str(tmp_path / "t"))
    rows = spark.read.parquet(str(tmp_path / "t"))
    words = spark.createDataFrame([("words", 1.0)], "word string, valence double")

    def model():
        return lambda batch: [("positive", 0.5)] * len(batch)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        if kind == "lexicon":
            out = scorers.score_lexicon(rows, words)
        elif kind == "model":
            out = scorers.score_model(rows, model, words)
        elif kind == "tiered":
            out = scorers.score_tiered(rows, model, words)
        else:
            both = scorers.model_scores(scorers.with_context(rows), model).join(
                scorers.lexicon_scores(rows, words), "news_id")
            out = scorers.score_ensemble(both, [("lexicon", "score", "confidence"),
                                                ("model", "model_score", "model_confidence")])
        out = out.select("news_id", "result")
        assert "text" not in exchanged(out, capsys)
        assert out.filter("result.confidence > 0").count() == 9
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_a_model_that_answers_in_part_or_is_down():
    def half(batch):
        return [("positive", 0.5)] * (len(batch) if len(batch) < 3 else len(batch) - 1)
    assert scorers.Answers(half)(["a"] * 7) == [("positive", 0.5)] * 7
    asked = []

    def down(batch):
        asked.append(len(batch))
        raise ConnectionError
    answers = scorers.Answers(down)
    assert answers(["a"] * 10_000) == [None] * 10_000
    assert len(asked) < 400
