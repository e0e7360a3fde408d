"""Quality score of whole texts by a byte-level convolutional network, trained in numpy.

The text's bytes are cut into overlapping chunks that cover it from the first to the last byte. A
convolution over learned byte vectors with rectified outputs is max-pooled in each chunk; the mean
and the maximum of the chunks' pools go into one logistic unit.

Nulls count as empty texts; an empty text is one chunk of padding and so gets a score as any other.
Equal texts get equal scores. Repeated rows are scored each. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import each, id_checksum, labelled_texts, per_text, sigmoid

CHUNK, STEP, WIDTH = 256, 192, 5  # bytes; neighbouring chunks share 64
FILTERS, DEPTH = 12, 6
BLOCK = 32  # chunks convolved at once, which bounds the memory of a very long text
PAD = 256  # code of the padding after the last byte


def chunks_of(text: str) -> np.ndarray:
    """All overlapping chunks of the text's bytes, padded at the end; one row each."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    count = 1 + max(0, -(-(len(raw) - CHUNK) // STEP))
    padded = np.full((count - 1) * STEP + CHUNK, PAD, dtype=np.int16)
    padded[:len(raw)] = raw
    return np.lib.stride_tricks.sliding_window_view(padded, CHUNK)[::STEP]


@dataclass
class Network:
    vectors: np.ndarray  # bytes x DEPTH
    filters: np.ndarray  # WIDTH x DEPTH x FILTERS
    bias: np.ndarray  # FILTERS
    weights: np.ndarray  # 2 * FILTERS
    offset: float

    def tables(self) -> np.ndarray:
        """What each byte adds to each filter at each place: WIDTH x bytes x FILTERS."""
        return np.einsum("bd,wdf->wbf", self.vectors, self.filters).astype(np.float32)

    def pooled(self, chunks: np.ndarray, tables: np.ndarray, where: bool = False):
        """The maximum of every filter in every chunk, and its position if asked."""
        tops, places = [], []
        room = np.empty((min(BLOCK, len(chunks)), CHUNK - WIDTH + 1, FILTERS), dtype=np.float32)
        for k in range(0, len(chunks), BLOCK):
            part = chunks[k:k + BLOCK]
            n = CHUNK - WIDTH + 1
            total = np.take(tables[0], part[:, :n], axis=0, mode="clip")
            for w in range(1, WIDTH):
                np.take(tables[w], part[:, w:w + n], axis=0, out=room[:len(part)], mode="clip")
                total += room[:len(part)]
            tops.append(total.max(axis=1))
            if where:
                places.append(total.argmax(axis=1))
        top = np.maximum(np.concatenate(tops) + self.bias.astype(np.float32), 0)
        return (top, np.concatenate(places)) if where else top

    def score(self, text: str, tables: np.ndarray) -> float:
        top = self.pooled(chunks_of(text), tables)
        features = np.concatenate([top.mean(axis=0), top.max(axis=0)])
        return float(sigmoid(features @ self.weights + self.offset))


def train(texts: list[str], labels: list[int], epochs: int = 14, rate: float = 0.02,
          max_chunks: int = 24, seed: int = 7) -> Network:
    """Fits the network by Adam on the logistic loss, classes weighted alike.

    A step uses a random run of at most ``max_chunks`` chunks of each text; scoring uses all of them.
    """
    rng = np.random.default_rng(seed)
    net = Network(rng.normal(0, 0.5, (257, DEPTH)), rng.normal(0, 0.3, (WIDTH, DEPTH, FILTERS)),
                  np.zeros(FILTERS), rng.normal(0, 0.1, 2 * FILTERS), 0.0)
    if not texts:
        return net
    y = np.asarray(labels, dtype=float)
    share = y.mean()
    weight = np.where(y == 1, 0.5 / max(share, 1e-9), 0.5 / max(1 - share, 1e-9))
    cut = [chunks_of(t) for t in texts]
    state = [np.zeros_like(p) for p in (net.vectors, net.filters, net.bias, net.weights)]
    moment = [s.copy() for s in state]
    off_m = off_v = 0.0
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(texts))
        lr = rate * (1 - 0.9 * epoch / epochs)
        for at in range(0, len(order), 64):
            batch = order[at:at + 64]
            pick, sizes = [], []
            for i in batch:
                c = cut[i]
                if len(c) > max_chunks:
                    a = rng.integers(0, len(c) - max_chunks + 1)
                    c = c[a:a + max_chunks]
                pick.append(c)
                sizes.append(len(c))
            chunks = np.concatenate(pick)
            top, place = net.pooled(chunks, net.tables(), where=True)
            starts = np.cumsum([0, *sizes[:-1]])
            mean = np.add.reduceat(top, starts, axis=0) / np.array(sizes)[:, None]
            best = np.maximum.reduceat(top, starts, axis=0)
            feats = np.hstack([mean, best])
            error = (sigmoid(feats @ net.weights + net.offset) - y[batch]) * weight[batch] / len(batch)
            g_weights = feats.T @ error + 1e-4 * net.weights
            g_feats = error[:, None] * net.weights
            owner = np.repeat(np.arange(len(batch)), sizes)
            g_top = (g_feats[:, :FILTERS] / np.array(sizes)[:, None])[owner]
            g_top = g_top + np.where(top == best[owner], g_feats[:, FILTERS:][owner], 0)
            g_top = np.where(top > 0, g_top, 0)
            g_filters = np.zeros_like(net.filters)
            g_vectors = np.zeros_like(net.vectors)
            rows = np.arange(len(chunks))[:, None]
            for w in range(WIDTH):
                codes = chunks[rows, place + w]  # chunks x FILTERS
                g_filters[w] = np.einsum("cfd,cf->df", net.vectors[codes], g_top)
                np.add.at(g_vectors, codes, g_top[:, :, None] * net.filters[w].T[None])
            grads = [g_vectors, g_filters, g_top.sum(axis=0), g_weights]
            step += 1
            fix = np.sqrt(1 - 0.999 ** step) / (1 - 0.9 ** step)
            for p, g, m, v in zip((net.vectors, net.filters, net.bias, net.weights), grads,
                                  moment, state):
                m *= 0.9
                m += 0.1 * g
                v *= 0.999
                v += 0.001 * g * g
                p -= lr * fix * m / (np.sqrt(v) + 1e-8)
            off_m = 0.9 * off_m + 0.1 * error.sum()
            off_v = 0.999 * off_v + 0.001 * error.sum() ** 2
            net.offset -= lr * fix * off_m / (np.sqrt(off_v) + 1e-8)
    return net


def score_quality(docs: DataFrame, net: Network, keep: list[str] = ["doc_id"],  # noqa: B006
                  threshold: float = 0.7) -> DataFrame:
    """Adds ``score`` (0 to 1) and ``predicted`` (1 at the threshold or above) to the kept columns."""
    def build():
        tables = net.tables()
        return each(lambda text: (net.score(text, tables),))
    scored = per_text(docs, keep, "score double", build)
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def fit_quality(docs: DataFrame, labels: DataFrame, per_class: int = 1000, mod: int = 4,
                held: int = 2) -> Network:
    """Trains on at most ``per_class`` texts of either label; rows held out are not used."""
    return train(*labelled_texts(docs, labels, "quality", id_checksum() % mod != held, per_class))


def quality(docs: DataFrame, labels: DataFrame, per_class: int = 1000, threshold: float = 0.7,
            mod: int = 4, held: int = 2) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs``."""
    net = fit_quality(docs, labels, per_class, mod, held)
    return score_quality(docs, net, threshold=threshold).select(
        "doc_id", (id_checksum() % mod == held).alias("held_out"), "score", "predicted")
