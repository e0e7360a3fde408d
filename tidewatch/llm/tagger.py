"""A bidirectional LSTM over character classes with CRF transitions, in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from tidewatch.llm.common import sigmoid


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + np.squeeze(top, axis)


@dataclass
class Tagger:
    """Both directions are kept in one array each: index 0 reads forwards, 1 backwards."""

    inputs: np.ndarray  # 2 x classes x 4H: what a class adds to the gates
    inner: np.ndarray  # 2 x H x 4H
    out: np.ndarray  # 2H x tags
    bias: np.ndarray  # tags
    moves: np.ndarray  # tags x tags: score of a tag after another
    start: np.ndarray  # tags

    @classmethod
    def fresh(cls, classes: int, tags: int, hidden: int, seed: int) -> Tagger:
        rng = np.random.default_rng(seed)
        inputs = rng.normal(0, 0.3, (2, classes, 4 * hidden))
        inputs[:, :, hidden:2 * hidden] += 0.5  # gates forget little at first
        return cls(inputs, rng.normal(0, 0.25, (2, hidden, 4 * hidden)),
                   rng.normal(0, 0.2, (2 * hidden, tags)), np.zeros(tags), np.zeros((tags, tags)),
                   np.zeros(tags))

    def params(self) -> list[np.ndarray]:
        return [self.inputs, self.inner, self.out, self.bias, self.moves, self.start]

    def read(self, codes: np.ndarray, trace: bool = False):
        """Hidden states of both directions at every place: B x L x 2H; with all gates if asked."""
        rows, length = codes.shape
        size = self.inner.shape[1]
        both = np.stack([codes, codes[:, ::-1]])
        h = np.zeros((2, rows, size))
        c = np.zeros((2, rows, size))
        states = np.empty((length, 2, rows, size))
        kept = []
        for t in range(length):
            z = h @ self.inner
            z[0] += self.inputs[0][both[0, :, t]]
            z[1] += self.inputs[1][both[1, :, t]]
            gates = sigmoid(z[..., :3 * size])
            i, f, o = gates[..., :size], gates[..., size:2 * size], gates[..., 2 * size:]
            g = np.tanh(z[..., 3 * size:])
            before, c = c, f * c + i * g
            squashed = np.tanh(c)
            if trace:
                kept.append((h, before, i, f, o, g, squashed))
            h = o * squashed
            states[t] = h
        joined = np.concatenate([states[:, 0], states[::-1, 1]], axis=-1).transpose(1, 0, 2)
        return (joined, kept, both) if trace else joined

    def emissions(self, codes: np.ndarray) -> np.ndarray:
        return self.read(codes) @ self.out + self.bias

    def decode(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The best tags of every window, and how much each tag is better than tag 0 at its place."""
        scores = self.emissions(codes)
        rows, length, tags = scores.shape
        best = self.start + scores[:, 0]
        back = np.empty((length, rows, tags), dtype=np.int8)
        for t in range(1, length):
            ways = best[:, :, None] + self.moves
            back[t] = ways.argmax(axis=1)
            best = ways.max(axis=1) + scores[:, t]
        path = np.empty((rows, length), dtype=np.int8)
        path[:, -1] = best.argmax(axis=1)
        each = np.arange(rows)
        for t in range(length - 1, 0, -1):
            path[:, t - 1] = back[t][each, path[:, t]]
        gain = np.take_along_axis(scores, path[:, :, None].astype(np.int64), axis=2)[:, :, 0]
        return path, gain - scores[:, :, 0]

    def gradients(self, codes: np.ndarray, tags: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean negative log likelihood of the tags and its gradient for all parameters."""
        states, kept, both = self.read(codes, trace=True)
        scores = states @ self.out + self.bias
        rows, length, n = scores.shape
        each = np.arange(rows)
        ahead = np.empty((length, rows, n))
        ahead[0] = self.start + scores[:, 0]
        for t in range(1, length):
            ahead[t] = _log_sum(ahead[t - 1][:, :, None] + self.moves, 1) + scores[:, t]
        behind = np.zeros((length, rows, n))
        for t in range(length - 2, -1, -1):
            behind[t] = _log_sum(self.moves + (scores[:, t + 1] + behind[t + 1])[:, None, :], 2)
        total = _log_sum(ahead[-1], 1)
        gold = self.start[tags[:, 0]] + np.take_along_axis(scores, tags[:, :, None], 2)[..., 0].sum(1)
        gold = gold + self.moves[tags[:, :-1], tags[:, 1:]].sum(axis=1)
        marginal = np.exp(ahead + behind - total[None, :, None]).transpose(1, 0, 2)
        g_scores = marginal.copy()
        np.put_along_axis(g_scores, tags[:, :, None],
                          np.take_along_axis(g_scores, tags[:, :, None], 2) - 1, 2)
        g_scores /= rows
        g_moves = np.zeros_like(self.moves)
        for t in range(1, length):
            pair = (ahead[t - 1][:, :, None] + self.moves
                    + (scores[:, t] + behind[t])[:, None, :] - total[:, None, None])
            g_moves += np.exp(pair).sum(axis=0)
        np.add.at(g_moves, (tags[:, :-1].ravel(), tags[:, 1:].ravel()), -1.0)
        g_start = marginal[:, 0].sum(axis=0) - np.bincount(tags[:, 0], minlength=n)
        g_out = states.reshape(-1, states.shape[-1]).T @ g_scores.reshape(-1, n)
        g_states = g_scores @ self.out.T
        g_inputs, g_inner = self._through_time(g_states, kept, both)
        return float((total - gold).mean()), [g_inputs, g_inner, g_out, g_scores.sum(axis=(0, 1)),
                                              g_moves / rows, g_start / rows]

    def _through_time(self, g_states, kept, both):
        size = self.inner.shape[1]
        length = len(kept)
        g_inputs, g_inner = np.zeros_like(self.inputs), np.zeros_like(self.inner)
        rows = both.shape[1]
        g_h, g_c = np.zeros((2, rows, size)), np.zeros((2, rows, size))
        turned = self.inner.transpose(0, 2, 1)
        g_z = np.empty((2, rows, 4 * size))
        for t in range(length - 1, -1, -1):
            h, c, i, f, o, g, squashed = kept[t]
            g_h[0] += g_states[:, t, :size]
            g_h[1] += g_states[:, length - 1 - t, size:]
            g_c = g_c + g_h * o * (1 - squashed * squashed)
            g_z[..., :size] = g_c * g * i * (1 - i)
            g_z[..., size:2 * size] = g_c * c * f * (1 - f)
            g_z[..., 2 * size:3 * size] = g_h * squashed * o * (1 - o)
            g_z[..., 3 * size:] = g_c * i * (1 - g * g)
            g_inner += h.transpose(0, 2, 1) @ g_z
            for d in (0, 1):
                np.add.at(g_inputs[d], both[d, :, t], g_z[d])
            g_h = g_z @ turned
            g_c = g_c * f
        return g_inputs, g_inner


def fit(codes: np.ndarray, tags: np.ndarray, classes: int, kinds: int, hidden: int = 12,
        steps: int = 220, batch: int = 64, rate: float = 0.02, seed: int = 3) -> Tagger:
    """Adam on random batches of the labelled windows."""
    net = Tagger.fresh(classes, kinds, hidden, seed)
    if not len(codes):
        net.bias[0] = 10.0  # nothing learned: everything is tag 0
        return net
    rng = np.random.default_rng(seed)
    first = [np.zeros_like(p) for p in net.params()]
    second = [np.zeros_like(p) for p in net.params()]
    for step in range(1, steps + 1):
        pick = rng.choice(len(codes), min(batch, len(codes)), replace=False)
        _, grads = net.gradients(codes[pick], tags[pick])
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
        lr = rate * (1 - 0.9 * step / steps) * np.sqrt(1 - 0.999 ** step) / (1 - 0.9 ** step)
        for p, g, m, v in zip(net.params(), grads, first, second):
            g = g * min(1.0, 5.0 / max(norm, 1e-9))
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= lr * m / (np.sqrt(v) + 1e-8)
    return net
