"""Small linear models fitted on bounded samples: logistic and cumulative-link ordinal regression."""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * x))


def _adam(start: np.ndarray, gradient, steps: int, rate: float) -> np.ndarray:
    x, m, v = start.copy(), np.zeros_like(start), np.zeros_like(start)
    for t in range(1, steps + 1):
        g = gradient(x)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        x -= rate * (1 - t / (steps + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return x


class Ordinal:
    """P(grade <= k) = sigmoid(cut[k] - x . weights): one weight vector for all of the ordered cuts."""

    def __init__(self, weights: np.ndarray, cuts: np.ndarray):
        self.weights, self.cuts = weights, cuts

    @classmethod
    def fit(cls, x: np.ndarray, grades: np.ndarray, classes: int, importance: np.ndarray | None = None, l2: float = 1e-4, steps: int = 600) -> Ordinal:
        """Maximum likelihood with an L2 penalty; the cuts stay in order as cumulative sums of exponentials."""
        n, d = x.shape
        weight = (np.ones(n) if importance is None else importance.astype(float))
        weight = weight / max(weight.sum(), 1e-12)
        share = np.cumsum(np.bincount(grades, weights=weight, minlength=classes))[:-1].clip(1e-4, 1 - 1e-4)
        cuts = np.maximum.accumulate(np.log(share / (1 - share)) + 1e-3 * np.arange(classes - 1))
        start = np.concatenate([np.zeros(d), cuts[:1], np.log(np.maximum(np.diff(cuts), 1e-3))])

        def cuts_of(p: np.ndarray) -> np.ndarray:
            return p[d] + np.concatenate([[0.0], np.cumsum(np.exp(p[d + 1:]))])

        def gradient(p: np.ndarray) -> np.ndarray:
            cuts, score = cuts_of(p), x @ p[:d]
            edges = np.concatenate([[-np.inf], cuts, [np.inf]])
            with np.errstate(invalid="ignore"):
                upper, lower = sigmoid(edges[grades + 1] - score), sigmoid(edges[grades] - score)
            mass = np.maximum(upper - lower, 1e-12)
            slope_upper, slope_lower = weight * upper * (1 - upper) / mass, weight * lower * (1 - lower) / mass
            out = np.empty_like(p)
            out[:d] = x.T @ (slope_upper - slope_lower) + l2 * p[:d]
            by_cut = -np.bincount(grades, weights=slope_upper, minlength=classes)[:-1] + np.bincount(grades, weights=slope_lower, minlength=classes)[1:]
            out[d] = by_cut.sum()
            out[d + 1:] = np.cumsum(by_cut[::-1])[::-1][1:] * np.exp(p[d + 1:])
            return out

        best = _adam(start, gradient, steps, 0.1)
        return cls(best[:d], cuts_of(best))

    def above(self, x: np.ndarray) -> np.ndarray:
        """P(grade > k) of each row for each cut k; their sum is the expected grade."""
        return sigmoid((x @ self.weights)[:, None] - self.cuts[None, :])


class Logistic:
    """P(label = 1) = sigmoid(x . weights + bias), on inputs scaled to zero mean and unit deviation."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias

    @classmethod
    def fit(cls, x: np.ndarray, labels: np.ndarray, importance: np.ndarray | None = None, l2: float = 1e-3, steps: int = 400) -> Logistic:
        n, d = x.shape
        weight = np.ones(n) if importance is None else importance.astype(float)
        weight = weight / max(weight.sum(), 1e-12)
        mean = weight @ x
        dev = np.sqrt(np.maximum(weight @ (x - mean) ** 2, 1e-12))
        dev[dev < 1e-5] = 1.0
        z = (x - mean) / dev
        rate = float(np.clip(weight @ labels, 1e-4, 1 - 1e-4))

        def gradient(p: np.ndarray) -> np.ndarray:
            miss = weight * (sigmoid(z @ p[:d] + p[d]) - labels)
            return np.concatenate([z.T @ miss + l2 * p[:d], [miss.sum()]])

        best = _adam(np.concatenate([np.zeros(d), [np.log(rate / (1 - rate))]]), gradient, steps, 0.1)
        return cls(best[:d] / dev, float(best[d] - best[:d] @ (mean / dev)))

    def logit(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weights + self.bias
