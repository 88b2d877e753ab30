"""A bidirectional LSTM over characters with a conditional random field on top, in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * x))


def _logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def _lstm(x: np.ndarray, w: np.ndarray, b: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
    """States of one direction: x is (batch, time, inputs), w maps inputs and state to four gates."""
    n, steps, inputs = x.shape
    hidden = w.shape[1] // 4
    h, c, out, kept = np.zeros((n, hidden), x.dtype), np.zeros((n, hidden), x.dtype), np.empty((n, steps, hidden), x.dtype), []
    given = x @ w[:inputs] + b
    for t in range(steps):
        z = given[:, t] + h @ w[inputs:]
        i, f, o = (_sigmoid(z[:, k * hidden : (k + 1) * hidden]) for k in range(3))
        g = np.tanh(z[:, 3 * hidden :])
        before, h_before = c, h
        c = f * before + i * g
        squashed = np.tanh(c)
        h = o * squashed
        out[:, t] = h
        if keep:
            kept.append((h_before, before, i, f, o, g, squashed))
    return out, kept


def _lstm_back(x: np.ndarray, w: np.ndarray, kept: list, d_out: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gradients of inputs, weights and offsets."""
    n, steps, inputs = x.shape
    dw, db, dx = np.zeros_like(w), np.zeros(w.shape[1], w.dtype), np.empty_like(x)
    dh = dc = np.zeros((n, w.shape[1] // 4), x.dtype)
    for t in range(steps - 1, -1, -1):
        h_before, before, i, f, o, g, squashed = kept[t]
        dh = dh + d_out[:, t]
        dc = dc + dh * o * (1 - squashed * squashed)
        dz = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * squashed * o * (1 - o), dc * i * (1 - g * g)], axis=1)
        dw[:inputs] += x[:, t].T @ dz
        dw[inputs:] += h_before.T @ dz
        db += dz.sum(axis=0)
        dx[:, t] = dz @ w[:inputs].T
        dh, dc = dz @ w[inputs:].T, dc * f
    return dx, dw, db


@dataclass
class Tagger:
    """Parameters by name: character vectors, the two LSTMs, the output layer, and the field's transitions."""

    weights: dict[str, np.ndarray]

    @classmethod
    def new(cls, signs: int, tags: int, size: int = 12, hidden: int = 16, seed: int = 5) -> Tagger:
        rng = np.random.default_rng(seed)
        draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        w = {"vectors": draw(signs, size) * 3, "out": draw(2 * hidden, tags), "out_b": np.zeros(tags, np.float32)}
        for way in "lr":
            w[way] = draw(size + hidden, 4 * hidden)
            w[f"{way}_b"] = np.concatenate([np.zeros(hidden), np.ones(hidden), np.zeros(2 * hidden)]).astype(np.float32)
        w |= {"moves": np.zeros((tags, tags), np.float32), "first": np.zeros(tags, np.float32), "end": np.zeros(tags, np.float32)}
        return cls(w)

    def scores(self, signs: np.ndarray, keep: bool = False) -> tuple[np.ndarray, tuple]:
        """Scores of every tag at every place of equally long rows of signs."""
        w = self.weights
        x = w["vectors"][signs]
        left, kept_l = _lstm(x, w["l"], w["l_b"], keep)
        right, kept_r = _lstm(x[:, ::-1], w["r"], w["r_b"], keep)
        both = np.concatenate([left, right[:, ::-1]], axis=2)
        return both @ w["out"] + w["out_b"], (x, kept_l, kept_r, both)

    def gradients(self, signs: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of the tags, and its gradients by forward-backward and through time."""
        w = self.weights
        e, (x, kept_l, kept_r, both) = self.scores(signs, keep=True)
        e = e.astype(np.float64)
        n, steps, k = e.shape
        moves = w["moves"].astype(np.float64)
        a, b = np.empty_like(e), np.empty_like(e)
        a[:, 0] = e[:, 0] + w["first"]
        for t in range(1, steps):
            a[:, t] = e[:, t] + _logsumexp(a[:, t - 1, :, None] + moves, 1)
        b[:, -1] = w["end"]
        for t in range(steps - 2, -1, -1):
            b[:, t] = _logsumexp(moves + (e[:, t + 1] + b[:, t + 1])[:, None, :], 2)
        total = _logsumexp(a[:, -1] + b[:, -1], 1)
        rows, places = np.arange(n)[:, None], np.arange(steps)
        gold = e[rows, places, tags].sum(axis=1) + w["first"][tags[:, 0]] + w["end"][tags[:, -1]] + moves[tags[:, :-1], tags[:, 1:]].sum(axis=1)
        de = np.exp(a + b - total[:, None, None])
        g = {"first": de[:, 0].sum(axis=0), "end": de[:, -1].sum(axis=0), "moves": np.zeros((k, k))}
        for t in range(1, steps):
            g["moves"] += np.exp(a[:, t - 1, :, None] + moves + (e[:, t] + b[:, t] - total[:, None])[:, None, :]).sum(axis=0)
        np.add.at(g["moves"], (tags[:, :-1], tags[:, 1:]), -1)
        np.add.at(g["first"], tags[:, 0], -1)
        np.add.at(g["end"], tags[:, -1], -1)
        de[rows, places, tags] -= 1
        de = de.astype(np.float32)
        d_both = de @ w["out"].T
        hidden = both.shape[2] // 2
        g["out"], g["out_b"] = both.reshape(-1, 2 * hidden).T @ de.reshape(-1, k), de.sum(axis=(0, 1))
        dx, g["l"], g["l_b"] = _lstm_back(x, w["l"], kept_l, d_both[:, :, :hidden])
        dr, g["r"], g["r_b"] = _lstm_back(x[:, ::-1], w["r"], kept_r, d_both[:, ::-1, hidden:])
        g["vectors"] = np.zeros_like(w["vectors"])
        np.add.at(g["vectors"], signs, dx + dr[:, ::-1])
        return float((total - gold).mean()), {name: (value / n).astype(np.float32) for name, value in g.items()}

    def fit(self, signs: np.ndarray, tags: np.ndarray, steps: int = 480, batch: int = 32, rate: float = 0.02, seed: int = 5) -> list[float]:
        """About so many Adam steps over shuffled batches, whatever the sample's size; the mean loss of each round."""
        rng, first, second, step, losses = np.random.default_rng(seed), {}, {}, 0, []
        while step < steps:
            order, lost = rng.permutation(len(signs)), []
            for start in range(0, len(order), batch):
                at = order[start : start + batch]
                loss, g = self.gradients(signs[at], tags[at])
                norm = float(np.sqrt(sum((v * v).sum() for v in g.values())))
                lost.append(loss)
                step += 1
                for name, value in g.items():
                    value = value * min(1.0, 5.0 / max(norm, 1e-9))
                    first[name] = 0.9 * first.get(name, 0) + 0.1 * value
                    second[name] = 0.999 * second.get(name, 0) + 0.001 * value * value
                    update = first[name] / (1 - 0.9**step) / (np.sqrt(second[name] / (1 - 0.999**step)) + 1e-8)
                    self.weights[name] = (self.weights[name] - rate / (1 + 8 * step / steps) * update).astype(np.float32)
            losses.append(float(np.mean(lost)))
        return losses

    def decode(self, signs: np.ndarray) -> np.ndarray:
        """The best tags of each row (Viterbi)."""
        w, (e, _) = self.weights, self.scores(signs)
        best, back = e[:, 0] + w["first"], np.empty(e.shape, dtype=np.int8)
        for t in range(1, e.shape[1]):
            ways = best[:, :, None] + w["moves"]
            back[:, t] = ways.argmax(axis=1)
            best = ways.max(axis=1) + e[:, t]
        tags = np.empty(e.shape[:2], dtype=np.int8)
        tags[:, -1] = (best + w["end"]).argmax(axis=1)
        for t in range(e.shape[1] - 1, 0, -1):
            tags[:, t - 1] = back[np.arange(len(e)), t, tags[:, t]]
        return tags
