"""Scores, labels and texts, as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewatch import dims
from tidewatch.functions.text import _has_any, bind, contains_any, first_matching, is_blank


def round_half_up(x: Column, digits: int) -> Column:
    """Decimal rounding that ignores binary noise below 1e-9, so 0.0624999999999 rounds as 0.0625.

    For sums whose last bits depend on the order of addition.
    """
    return F.round(F.round(x, 9), digits)


def round_exact(x: Column, digits: int) -> Column:
    """Nearest decimal to the exact binary value, ties to even, as Python rounds.

    Spark's own rounding starts from the shortest decimal form, which may lie on the other side of
    the tie. Here the comparison with the tie is exact: x is split into two halves of its bits, so
    that the products below have no rounding error.
    """
    odd, power = 5 ** digits, 2.0 ** (digits + 1)  # 2 * 10^digits = odd * power
    scale = float(10 ** digits)

    def rounded(v: Column) -> Column:
        below = F.floor(v * scale).cast("double")
        shifted = v * 134217729.0
        high = shifted - (shifted - v)
        above_tie = (high * float(odd) - (below * 2.0 + 1.0) / power) + (v - high) * float(odd)
        up = (above_tie > 0) | ((above_tie == 0) & (below % 2.0 != 0))
        return F.when(up, below + 1.0).otherwise(below) / scale
    return bind(x, rounded)


def clamp(x: Column, low: float = -1.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


# ---- window scores ----

def risk_score(neg: Column, pos: Column, score: Column) -> Column:
    """Risk in [0, 1] from counts and the (rounded) sentiment score."""
    n = (neg + pos).cast("double")
    base = clamp((F.lit(1.0) - score) / 2.0, 0.0, 1.0)
    volume = F.least(F.lit(1.5), F.lit(1.0) + (n - 1.0) * 0.1)
    bias = F.when(n > 0, F.lit(1.0) + (neg / n - 0.5) * 0.5).otherwise(F.lit(1.0))
    return round_exact(F.least(F.lit(1.0), base * volume * bias), 3)


def shock_risk(count: Column) -> Column:
    return F.least(F.lit(1.0), count / F.lit(5.0))


# ---- alert texts ----

def severity(risk: Column) -> Column:
    return F.when(risk >= 0.8, "high").when(risk >= 0.6, "medium").otherwise("low")


def alert_message(ticker: Column, risk: Column) -> Column:
    value = F.format_string("%.3f", risk)
    level = severity(risk)
    # fixed values: message per severity
    start = (F.when(level == "high", "CRITICAL: High supply chain risk detected for ")
             .when(level == "medium", "WARNING: Medium supply chain risk for ")
             .otherwise("NOTICE: Supply chain risk alert for "))
    return F.concat(start, ticker, F.lit(" (risk: "), value, F.lit(")"))


def notification_payload(ticker: Column, risk: Column, threshold: Column, window_end: Column,
                         triggered_at: Column) -> Column:
    """Chat notification as a JSON document."""
    level = severity(risk)
    # fixed values: emoji, colour and name per severity
    emoji = F.when(level == "high", "🔴").when(level == "medium", "🟡").otherwise("🟢")
    color = F.when(level == "high", "#ff0000").when(level == "medium", "#ffaa00").otherwise("#00aa00")
    name = F.when(level == "high", "CRITICAL").when(level == "medium", "WARNING").otherwise("NOTICE")

    def field(title: str, value: Column, short: bool) -> Column:
        return F.struct(F.lit(title).alias("title"), value.alias("value"), F.lit(short).alias("short"))

    # fixed values: titles, footer and field order of the document
    attachment = F.struct(
        color.alias("color"),
        F.concat(name, F.lit(" Risk Alert: "), ticker).alias("title"),
        alert_message(ticker, risk).alias("text"),
        F.array(field("Risk Score", F.format_string("%.3f", risk), True),
                field("Threshold", F.format_string("%.3f", threshold), True),
                field("Window End",
                      F.concat(F.date_format(window_end, "yyyy-MM-dd HH:mm:ss"), F.lit(" UTC")),
                      False)).alias("fields"),
        F.lit("Supply Chain Risk Monitor").alias("footer"),
        F.unix_seconds(triggered_at).alias("ts"))
    return F.to_json(F.struct(F.concat(emoji, F.lit(" Supply Chain Risk Alert")).alias("text"),
                              F.array(attachment).alias("attachments")))


# ---- article sentiment ----

def headline_sentiment(headline: Column, negative: Sequence[str], positive: Sequence[str]) -> Column:
    """-0.7 if a negative word occurs, else 0.7 if a positive one does, else 0."""
    return bind(F.lower(headline), lambda t: F.when(_has_any(t, negative), F.lit(-0.7))
                .when(_has_any(t, positive), F.lit(0.7)).otherwise(F.lit(0.0)))


def keyword_sentiment(headline: Column) -> Column:
    return headline_sentiment(headline, dims.FIRST_MATCH_NEGATIVE, dims.FIRST_MATCH_POSITIVE)


def simple_sentiment(headline: Column) -> Column:
    return headline_sentiment(headline, dims.SIMPLE_NEGATIVE, dims.SIMPLE_POSITIVE)


def simple_ticker(headline: Column) -> Column:
    return first_matching(headline, [(k, F.lit(t)) for k, t in dims.SIMPLE_KEYWORDS])


def matched_categories(text: Column, categories=None) -> Column:
    """array<struct<category, multiplier, bias>> of the categories with a phrase in the text."""
    categories = dims.CATEGORIES if categories is None else categories

    def hits(t: Column) -> Column:
        return F.array_compact(F.array(*[
            F.when(_has_any(t, phrases),
                   F.struct(F.lit(name).alias("category"), F.lit(mult).alias("multiplier"),
                            F.lit(bias).alias("bias")))
            for name, mult, bias, phrases in categories]))
    return bind(F.lower(text), hits)


def category_context(text: Column, categories=None) -> Column:
    """struct<risk_multiplier, sentiment_bias, categories> of a text."""
    def summary(hit: Column) -> Column:
        total = F.aggregate(hit, F.lit(0.0), lambda a, h: a + h["bias"])
        return F.struct(
            F.aggregate(hit, F.lit(1.0), lambda a, h: a * h["multiplier"]).alias("risk_multiplier"),
            F.when(F.size(hit) > 0, total / F.size(hit)).otherwise(F.lit(0.0)).alias("sentiment_bias"),
            F.transform(hit, lambda h: h["category"]).alias("categories"))
    return bind(matched_categories(text, categories), summary)


def with_bias(base: Column, bias: Column) -> Column:
    """Scorer output shifted by the category bias."""
    return clamp(base + bias * 0.3)


def reasoning(categories: Column) -> Column:
    """``Categories: ['a', 'b']`` or null."""
    listed = F.array_join(F.transform(categories, lambda c: F.concat(F.lit("'"), c, F.lit("'"))), ", ")
    return F.when(F.size(categories) > 0, F.concat(F.lit("Categories: ["), listed, F.lit("]")))


def text_context(text: Column) -> Column:
    """``category_context``, or null for a blank text: all that a result needs of the text."""
    return F.when(~is_blank(text), category_context(text))


def sentiment_from(context: Column, base: Column | None = None, confidence: Column | None = None,
                   model: Column | str | None = None) -> Column:
    """struct<sentiment, confidence, risk_factor, model_used, reasoning> from a ``text_context``.

    Without a scorer the category bias itself is the base score, with confidence 0.3.
    """
    def result(ctx: Column) -> Column:
        bias = ctx["sentiment_bias"]
        own = F.lit(None).cast("double") if base is None else base
        conf = F.lit(0.3) if confidence is None else F.coalesce(confidence, F.lit(0.3))
        name = F.lit(model) if isinstance(model, str) else model
        used = (F.lit("keyword_fallback") if name is None
                else F.when(own.isNull(), "keyword_fallback").otherwise(name))
        return F.struct(with_bias(F.coalesce(own, bias), bias).alias("sentiment"),
                        conf.alias("confidence"),
                        ctx["risk_multiplier"].alias("risk_factor"), used.alias("model_used"),
                        reasoning(ctx["categories"]).alias("reasoning"))

    empty = F.struct(F.lit(0.0).alias("sentiment"), F.lit(0.0).alias("confidence"),
                     F.lit(1.0).alias("risk_factor"), F.lit("none").alias("model_used"),
                     F.lit(None).cast("string").alias("reasoning"))
    return bind(context, lambda ctx: F.when(ctx.isNull(), empty).otherwise(result(ctx)))


def sentiment_result(text: Column, base: Column | None = None, confidence: Column | None = None,
                     model: Column | str | None = None) -> Column:
    """``sentiment_from`` the text itself."""
    return sentiment_from(text_context(text), base, confidence, model)


def needs_slow_scorer(text: Column, ticker: Column | None = None) -> Column:
    """Routing of the tiered scorer; the cheap tests come first."""
    company = F.lit(False) if ticker is None else F.coalesce(
        F.upper(ticker).isin(dims.ROUTE_TICKERS), F.lit(False))
    return ((F.length(text) > dims.ROUTE_LENGTH) | company
            | contains_any(text, dims.ROUTE_WORDS + dims.ROUTE_PHRASES))


# ---- model output ----

def label_score(label: Column, confidence: Column) -> Column:
    """Signed score of a sentiment label."""
    def score(name: Column) -> Column:
        return (F.when(F.contains(name, F.lit("negative")) | F.contains(name, F.lit("1")), -confidence)
                .when(F.contains(name, F.lit("positive")) | F.contains(name, F.lit("5")), confidence)
                .when(F.contains(name, F.lit("neutral")) | F.contains(name, F.lit("3")), F.lit(0.0))
                .when(name.rlike("^[0-9]+$"), (name.try_cast("double") - 3.0) / 2.0)
                .otherwise(F.lit(0.0)))
    return bind(F.lower(label), score)


def mapped_label(label: Column, mapping: dict[str, float]) -> Column:
    """Score of a label by exact name; unknown labels are neutral."""
    out = F.lit(0.0)
    for name, value in mapping.items():
        out = F.when(label == name, F.lit(value)).otherwise(out)
    return out


def polarity_label(label: Column) -> Column:
    return mapped_label(F.lower(label), dims.POLARITY_LABELS)


def numbered_label(label: Column) -> Column:
    return mapped_label(label, dims.NUMBERED_LABELS)


def lexicon_norm(total: Column) -> Column:
    """Sum of valences squeezed into (-1, 1)."""
    return total / F.sqrt(total * total + 15.0)


def ensemble(scores: Sequence[Column], confidences: Sequence[Column]) -> Column:
    """struct<score, confidence>: confidence-weighted mean over the scorers that gave a score.

    Plain mean and confidence 0.5 if all confidences are zero; nulls if no scorer gave a score.
    """
    pairs = F.filter(F.array(*[F.struct(s.alias("s"), c.alias("c"))
                               for s, c in zip(scores, confidences)]),
                     lambda p: p["s"].isNotNull())

    def combine(p: Column) -> Column:
        n = F.size(p)
        weight = F.aggregate(p, F.lit(0.0), lambda a, x: a + x["c"])
        weighted = F.aggregate(p, F.lit(0.0), lambda a, x: a + x["s"] * x["c"])
        plain = F.aggregate(p, F.lit(0.0), lambda a, x: a + x["s"])
        return F.struct(
            F.when(n == 0, F.lit(None).cast("double")).when(weight > 0, weighted / weight)
            .otherwise(plain / n).alias("score"),
            F.when(n == 0, F.lit(None).cast("double")).when(weight > 0, weight / n)
            .otherwise(F.lit(0.5)).alias("confidence"))
    return bind(pairs, combine)


