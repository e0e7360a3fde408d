"""Language by nearest centroid over TF-IDF vectors of character n-grams.

Runs of one, two and three characters of the lower-cased text, in which each run of other characters
than letters is one space, are hashed into a fixed number of
places, weighted by (1 + log count) times idf and normalised. Each language has several centroids,
found by clustering its training vectors by cosine. A text gets the language of its nearest
centroid; it is marked as rejected if the distance exceeds what that centroid's own members show.

A text that is null or has no letter gets ``und``, score 0. Ties go to the first language in order.
Repeated rows are scored each. Without any training text every text gets ``und``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import code_points, each, id_checksum, labelled_texts, per_text

PLACES = 1 << 12
BLOCK = 1 << 16  # characters hashed at once
UNKNOWN = "und"
SPACE = np.uint32(32)
# characters beyond the first 65,536 count as the last of them, as letters
LETTERS = np.array([chr(k).isalpha() for k in range(0xFFFF)] + [True])


def counts_of(text: str) -> np.ndarray:
    """How often each place is hit by the text's runs of one to three characters."""
    total = np.zeros(PLACES, dtype=np.int64)
    codes = code_points(" " + text.lower() + " ")
    letter = LETTERS[np.minimum(codes, 0xFFFF)]
    codes = np.where(letter, codes, SPACE)[letter | np.append(True, letter[:-1])]
    for at in range(0, len(codes), BLOCK):
        c = codes[at:at + BLOCK + 2]  # two more, so that runs over the border are counted once
        a = c * np.uint32(0x9E3779B1)
        b = c[:-1] * np.uint32(0x85EBCA6B) + c[1:] * np.uint32(0xC2B2AE35)
        d = b[:-1] * np.uint32(0x27D4EB2F) + c[2:] * np.uint32(0x165667B1)
        for part in (a[:BLOCK], b[:BLOCK], d[:BLOCK]):
            total += np.bincount((part ^ (part >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
                                 >> np.uint32(20), minlength=PLACES)
    return total


@dataclass
class Centroids:
    langs: list[str]
    owner: np.ndarray  # language of each centroid
    idf: np.ndarray
    points: np.ndarray  # PLACES x centroids
    reach: np.ndarray  # largest cosine distance accepted, by centroid

    def vector(self, text: str) -> np.ndarray:
        v = np.log1p(counts_of(text)).astype(np.float32) * self.idf
        return v / max(float(np.sqrt(v @ v)), 1e-12)

    def predict(self, text: str) -> tuple[str, float, bool]:
        if not self.langs or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0, True
        near = self.vector(text) @ self.points
        k = int(near.argmax())
        cosine = float(near[k])
        return (self.langs[self.owner[k]], min(max(cosine, 0.0), 1.0),
                1 - cosine > float(self.reach[k]))


def train(texts: list[str], langs: list[str], clusters: int = 4, rounds: int = 12,
          quantile: float = 0.995, slack: float = 1.25, seed: int = 5) -> Centroids:
    """Spherical k-means within each language; ``reach`` is a quantile of member distances."""
    rows = [(t, g) for t, g in zip(texts, langs) if any(map(str.isalpha, t))]
    if not rows:
        return Centroids([], np.zeros(0, int), np.zeros(PLACES, np.float32),
                         np.zeros((PLACES, 0), np.float32), np.zeros(0))
    rng = np.random.default_rng(seed)
    tf = np.stack([np.log1p(counts_of(t)).astype(np.float32) for t, _ in rows])
    idf = (np.log((1 + len(rows)) / (1 + (tf > 0).sum(axis=0))) + 1).astype(np.float32)
    x = tf * idf
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    names, owner, points, reach = sorted({g for _, g in rows}), [], [], []
    lang = np.array([names.index(g) for _, g in rows])
    for k in range(len(names)):
        own = x[lang == k]
        n = min(clusters, len(own))
        c = own[rng.choice(len(own), n, replace=False)]
        for _ in range(rounds):
            nearest = (own @ c.T).argmax(axis=1)
            for j in range(n):
                if (nearest == j).any():
                    c[j] = own[nearest == j].sum(axis=0)
            c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
        near = own @ c.T
        nearest = near.argmax(axis=1)
        for j in range(n):
            far = 1 - near[nearest == j, j]
            owner.append(k)
            points.append(c[j])
            reach.append(slack * np.quantile(far, quantile) if len(far) else 1.0)
    return Centroids(names, np.array(owner), idf, np.stack(points, axis=1), np.array(reach))


def score_language(docs: DataFrame, model: Centroids, keep: list[str] = ["doc_id"]  # noqa: B006
                   ) -> DataFrame:
    return per_text(docs, keep, "lang_pred string, score double, rejected boolean",
                    lambda: each(model.predict))


def fit_language(docs: DataFrame, per_class: int = 600, mod: int = 5, held: int = 0) -> Centroids:
    """Trains on at most ``per_class`` texts of each language; rows held out are not used."""
    return train(*labelled_texts(docs, docs.select("doc_id", "lang"), "lang",
                                 id_checksum() % mod != held, per_class))


def language(docs: DataFrame, per_class: int = 600, mod: int = 5, held: int = 0) -> DataFrame:
    """doc_id, held_out, lang_pred, score and the rejection of every row of ``docs``."""
    scored = score_language(docs, fit_language(docs, per_class, mod, held))
    return scored.select("doc_id", (id_checksum() % mod == held).alias("held_out"), "lang_pred",
                         "score", "rejected")
