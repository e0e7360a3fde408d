"""Pluggable sentiment scorers.

A scorer turns a base score and a confidence per text; the category bias is applied afterwards.
``keyword`` needs nothing, ``lexicon`` takes a (word, valence) table, ``model`` takes a factory of
a batch function, ``tiered`` routes between two of them and ``ensemble`` averages several.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.scoring import (ensemble, label_score, lexicon_norm, needs_slow_scorer,
                                         sentiment_from, sentiment_result, text_context)
from tidewatch.functions.text import tokens
from tidewatch.operators.common import once

# builds, once per task, a function: list of texts -> list of (label, confidence)
ModelFactory = Callable[[], Callable[[list[str]], list[tuple[str, float]]]]


def _names(key: str | list[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


CONTEXT = "_context"


def with_context(df: DataFrame, text: str = "text") -> DataFrame:
    """Takes what a result needs of the text before scores are joined on, so that a plan which does
    not return the text does not shuffle it."""
    return df if CONTEXT in df.columns else once(df, CONTEXT, text_context(F.col(text)))


def score_keyword(df: DataFrame, text: str = "text") -> DataFrame:
    """Category bias only; deterministic and without any model."""
    return df.withColumn("result", sentiment_result(F.col(text)))


def lexicon_scores(df: DataFrame, lexicon: DataFrame, key: str | list[str] = "news_id", text: str = "text"
                   ) -> DataFrame:
    """(key, score, confidence) of every text from a (word, valence) table.

    ``key`` (a column or several, say article and ticker) must identify the rows.
    Valences add up as decimals, so the result does not depend on the order of partial sums. All
    tokens of a text sit in one task and collapse there before the shuffle.
    """
    words = lexicon.select("word", F.col("valence").cast("decimal(18,6)").alias("valence"))
    keys = _names(key)
    spread = df.select(*keys, F.explode_outer(tokens(F.lower(F.col(text)))).alias("word"))
    total = F.coalesce(F.sum("valence"), F.lit(0).cast("decimal(28,6)")).cast("double")
    return (spread.join(words, "word", "left").groupBy(*keys).agg(total.alias("_total"))
            .select(*keys, lexicon_norm(F.col("_total")).alias("score"))
            .withColumn("confidence", F.abs("score")))


def score_lexicon(df: DataFrame, lexicon: DataFrame, key: str | list[str] = "news_id", text: str = "text"
                  ) -> DataFrame:
    scores = lexicon_scores(df, lexicon, key, text)
    return (with_context(df, text).join(scores, _names(key), "left")
            .withColumn("result", sentiment_from(F.col(CONTEXT), F.col("score"),
                                                 F.col("confidence"), "lexicon"))
            .drop("score", "confidence", CONTEXT))


GIVE_UP = 100  # texts that fail one after the other, by themselves


class Answers:
    """A model's answers. A batch that fails, or is answered in part, is halved until the failing
    texts stand alone; those get None, so a bad text costs no other text its answer and no job its
    run. After ``GIVE_UP`` failures in a row the model counts as down, and the task asks no more."""

    def __init__(self, model: Callable):
        self.model, self.failed = model, 0

    def __call__(self, texts: list[str]) -> list[tuple[str, float] | None]:
        if self.failed >= GIVE_UP:
            return [None] * len(texts)
        try:
            answers = list(self.model(texts))
            if len(answers) != len(texts):
                raise ValueError(f"{len(answers)} answers to {len(texts)} texts")
            self.failed = 0
            return answers
        except Exception:  # whatever a user's model may raise
            if len(texts) == 1:
                self.failed += 1
                return [None]
            half = len(texts) // 2
            return self(texts[:half]) + self(texts[half:])


def model_output(text: Column, factory: ModelFactory, wanted: Column | None = None,
                 max_chars: int | None = None) -> Column:
    """struct<label, confidence> from a user-supplied batch scorer; null where it failed.

    The model is built once per task; rows that are not ``wanted`` never reach it. ``max_chars``
    cuts the text for models with a limit; by default they get all of it.
    """
    @F.pandas_udf("label string, confidence double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        answers_of = Answers(factory())
        for texts, flags in batches:
            out = pd.DataFrame({"label": None, "confidence": float("nan")}, index=texts.index)
            rows = texts[flags.fillna(False).astype(bool) & texts.notna()]
            if len(rows):
                cut = rows if max_chars is None else rows.str.slice(0, max_chars)
                answers = answers_of(cut.tolist())
                out.loc[rows.index, "label"] = [a and a[0] for a in answers]
                out.loc[rows.index, "confidence"] = [float(a[1]) if a else float("nan")
                                                     for a in answers]
            yield out
    return run(text, F.lit(True) if wanted is None else wanted)


def model_scores(df: DataFrame, factory: ModelFactory, text: str = "text",
                 wanted: Column | None = None, max_chars: int | None = None) -> DataFrame:
    """Adds ``model_score`` and ``model_confidence``; null where the model gave no answer."""
    return (df.withColumn("_m", model_output(F.col(text), factory, wanted, max_chars))
            .withColumn("model_score", F.when(F.col("_m.label").isNotNull(), label_score(
                F.col("_m.label"), F.col("_m.confidence"))))
            .withColumn("model_confidence",
                        F.when(F.col("_m.label").isNotNull(), F.col("_m.confidence")))
            .drop("_m"))


def score_model(df: DataFrame, factory: ModelFactory, lexicon: DataFrame | None = None,
                key: str | list[str] = "news_id", text: str = "text", max_chars: int | None = None
                ) -> DataFrame:
    """Model score; texts the model failed on fall back to the lexicon, then to the keywords."""
    scored = model_scores(df, factory, text, max_chars=max_chars)
    return _with_fallback(scored, lexicon, key, text, F.lit("lexicon_fallback"))


def score_tiered(df: DataFrame, factory: ModelFactory | None = None,
                 lexicon: DataFrame | None = None, key: str | list[str] = "news_id", text: str = "text",
                 ticker: str | None = "ticker", max_chars: int | None = None) -> DataFrame:
    """Slow model for critical, major-company or long texts, lexicon for the rest, in one pass."""
    slow = needs_slow_scorer(F.col(text), F.col(ticker) if ticker else None)
    routed = df.withColumn("slow", slow)
    if factory is None:
        routed = routed.withColumns({"model_score": F.lit(None).cast("double"),
                                     "model_confidence": F.lit(None).cast("double")})
    else:
        routed = model_scores(routed, factory, text, F.col("slow"), max_chars)
    fast_name = F.when(F.col("slow"), "lexicon_fallback").otherwise("lexicon_fast")
    return _with_fallback(routed, lexicon, key, text, fast_name)


def _with_fallback(scored: DataFrame, lexicon: DataFrame | None, key: str | list[str],
                   text: str, fast_name: Column) -> DataFrame:
    """Model score first, lexicon score second, category bias last."""
    scored = with_context(scored, text)
    if lexicon is not None:
        scored = scored.join(lexicon_scores(scored, lexicon, key, text), _names(key), "left")
    else:
        scored = scored.withColumns({"score": F.lit(None).cast("double"),
                                     "confidence": F.lit(None).cast("double")})
    own = F.col("model_score").isNotNull()
    return (scored.withColumn("result", sentiment_from(
        F.col(CONTEXT), F.coalesce("model_score", "score"),
        F.when(own, F.col("model_confidence")).otherwise(F.col("confidence")),
        F.when(own, F.lit("model")).otherwise(fast_name)))
        .drop("model_score", "model_confidence", "score", "confidence", CONTEXT))


def score_ensemble(df: DataFrame, scorers: list[tuple[str, str, str]], text: str = "text"
                   ) -> DataFrame:
    """Confidence-weighted mean of scorer columns: (name, score column, confidence column).

    Call ``with_context`` before the scores are joined, and the text need not come along.
    """
    both = ensemble([F.col(s) for _, s, _ in scorers], [F.col(c) for _, _, c in scorers])
    names = F.array_join(F.array_compact(F.array(
        *[F.when(F.col(s).isNotNull(), n) for n, s, _ in scorers])), "+")
    return (with_context(df, text).withColumn("_e", both)
            .withColumn("result", sentiment_from(F.col(CONTEXT), F.col("_e.score"),
                                                 F.col("_e.confidence"), names))
            .drop("_e", CONTEXT))


SCORERS: dict[str, Callable[..., DataFrame]] = {
    "keyword": score_keyword, "lexicon": score_lexicon, "model": score_model,
    "tiered": score_tiered, "ensemble": score_ensemble,
}
