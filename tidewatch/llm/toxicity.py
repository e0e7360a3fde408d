"""Toxicity by multiple-instance learning: sentences are scored, documents are labelled.

A sentence's probability is a logistic function of the weights of its words and word stems; a document's is the noisy-or
of its sentences, 1 - prod(1 - p). The weights are trained from document labels alone, yet the
sentence probabilities then say which sentences offend.

Nulls count as empty texts. A text without words has one empty sentence and so the base score.
Repeated rows are scored each. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import (each, id_checksum, labelled_texts, per_text, sigmoid,
                                  small_batches)

WORD = re.compile(r"[^\W\d_]+")
SENTENCE = re.compile(r"[^.!?\n]+(?:[.!?]+|\n|$)")
START = -10.0  # log odds of a sentence without any telling word
STEMS = (4, 5)


@dataclass
class Model:
    weights: dict[str, float]
    base: float

    def sentences(self, text: str) -> list[tuple[int, int, float]]:
        """Start, end and log odds of every sentence that has a word with a weight."""
        low, known = text.lower(), self.by_word
        if len(low) != len(text):  # a few capitals grow in lower case; keep the positions
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        telling = {w: x for w in set(WORD.findall(low)) if (x := known(w))}
        found: list[tuple[int, int, float]] = []
        if telling:
            for m in SENTENCE.finditer(low):
                hit = {w for w in WORD.findall(m.group()) if w in telling}
                if hit:
                    names = set().union(*[telling[w] for w in hit])
                    found.append((m.start(), m.end(),
                                  self.base + sum(self.weights[k] for k in names)))
        return found

    def by_word(self, word: str) -> list[str]:
        return [m for m in marks(word) if m in self.weights]

    def score(self, text: str, at: float = 0.5) -> tuple[float, int, int | None, int | None]:
        """Probability, number of offending sentences, start and end of the worst one.

        Sentences without a weighted word all have the base probability, which is kept out of the
        product but for one, so that the length of a text alone does not make it toxic.
        """
        found = self.sentences(text)
        safe = -np.logaddexp(0, self.base) - sum(float(np.logaddexp(0, z)) for _, _, z in found)
        bad = [f for f in found if f[2] >= np.log(at / (1 - at))]
        worst = max(bad, key=lambda f: (f[2], -f[0])) if bad else None
        return (float(-np.expm1(safe)), len(bad), worst and worst[0], worst and worst[1])


def marks(word: str) -> list[str]:
    """What a word can be known by: itself, and its first four and five letters."""
    return [word, *[f"{word[:n]}-" for n in STEMS if len(word) >= n]]


def least_lift(toxic: int, clean: int, n_toxic: int, n_clean: int, sure: float) -> float:
    """The logarithm of how many times as frequent a mark is in toxic texts, less ``sure`` standard
    errors: few texts have to say it more clearly than many."""
    a, b = toxic + 0.5, clean + 0.5
    return float(np.log(a / (n_toxic + 1)) - np.log(b / (n_clean + 1)) - sure * np.sqrt(1 / a + 1 / b))


def train(texts: list[str], labels: list[int], epochs: int = 400, rate: float = 0.3,
          lasso: float = 2e-5, sure: float = 2.0, support: float = 10.0, at_least: int = 10) -> Model:
    """Fits mark weights by proximal Adam on the noisy-or likelihood, classes weighted alike.

    The marks that take part are those surely twice as frequent in toxic texts as in others, and
    ``at_least`` those that come nearest to it, so that a handful of toxic texts teaches something.
    The lasso sets weights that explain nothing more to zero; a mark of few texts is shrunk more, by
    ``support`` over their number.
    """
    y = np.asarray(labels, dtype=float)
    known: dict[str, list[str]] = {}
    toxic, clean = Counter(), Counter()
    for text, label in zip(texts, labels):
        found = set()
        for w in set(WORD.findall(text.lower())):
            if w not in known:
                known[w] = marks(w)
            found.update(known[w])
        (toxic if label else clean).update(found)
    n1, n0 = max(1, int(y.sum())), max(1, int((1 - y).sum()))
    lifts = {w: least_lift(n, clean[w], n1, n0, sure) for w, n in toxic.items()}
    nearest = sorted(lifts, key=lambda w: (-lifts[w], w))[:at_least]
    names = sorted({w for w, x in lifts.items() if x >= np.log(2)} | set(nearest))
    shrink = lasso * (1 + support / np.array([toxic[w] for w in names]))
    if not names or y.all():
        return Model({}, START)
    place = {w: k for k, w in enumerate(names)}
    ids = {w: [place[m] for m in ms if m in place] for w, ms in known.items()}
    ids = {w: v for w, v in ids.items() if v}
    owner, rows, cols = [], [], []  # text of each sentence; entries of the sentence-mark matrix
    for d, text in enumerate(texts):
        owner.append(d)  # the bare sentence that every text has
        for s in SENTENCE.findall(text.lower()):
            hit = {k for w in WORD.findall(s) if w in ids for k in ids[w]}
            if hit:
                rows += [len(owner)] * len(hit)
                cols += hit
                owner.append(d)
    owner, rows, cols = np.array(owner), np.array(rows), np.array(cols)
    cost = np.where(y == 1, 0.5 / n1, 0.5 / n0)
    w, base = np.zeros(len(names)), -5.0
    m, v = np.zeros(len(names) + 1), np.zeros(len(names) + 1)
    for step in range(1, epochs + 1):
        z = base + np.bincount(rows, w[cols], len(owner))
        p = sigmoid(z)
        safe = np.bincount(owner, -np.logaddexp(0, z), len(y))  # log prod(1 - p)
        tox = np.clip(-np.expm1(safe), 1e-9, 1)
        # d loss / d safe, then d safe / d z = -p
        g_safe = cost * np.where(y == 1, np.exp(np.clip(safe, -700, 0)) / tox, -1.0)
        g_z = -g_safe[owner] * p
        grad = np.append(np.bincount(cols, g_z[rows], len(names)), g_z.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        lr = rate / (1 + 3 * step / epochs)
        scale = lr * np.sqrt(1 - 0.999 ** step) / (1 - 0.9 ** step) / (np.sqrt(v) + 1e-8)
        w = w - scale[:-1] * m[:-1]
        w = np.maximum(w - scale[:-1] * shrink, 0)
        base = min(base - scale[-1] * m[-1], -4.0)
    return Model({names[k]: float(w[k]) for k in np.flatnonzero(w)}, float(base))


def score_toxicity(docs: DataFrame, model: Model, keep: list[str] = ["doc_id"],  # noqa: B006
                   threshold: float = 0.7) -> DataFrame:
    """Adds score, predicted, the count of offending sentences and the worst one's span."""
    scored = per_text(docs, keep, "score double, n_offending long, worst_start long, worst_end long",
                      lambda: each(model.score))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def fit_toxicity(docs: DataFrame, labels: DataFrame, per_class: int = 4000, mod: int = 3,
                 held: int = 1) -> Model:
    """Trains on at most ``per_class`` texts of either label; rows held out are not used."""
    return train(*labelled_texts(docs, labels, "toxic", id_checksum() % mod != held, per_class))


def toxicity(docs: DataFrame, labels: DataFrame, per_class: int = 4000, threshold: float = 0.7,
             mod: int = 3, held: int = 1) -> DataFrame:
    """doc_id, held_out, score, predicted and the offending sentences of every row of ``docs``."""
    model = fit_toxicity(docs, labels, per_class, mod, held)
    return score_toxicity(docs, model, threshold=threshold).select(
        "doc_id", (id_checksum() % mod == held).alias("held_out"), "score", "predicted",
        "n_offending", "worst_start", "worst_end")


def keep_clean(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is below the threshold."""
    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series([model.score(t or "")[0] for t in texts], dtype=float)
    small_batches(docs)
    return docs.where(score(docs["text"]) < threshold)
