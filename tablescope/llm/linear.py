"""A linear model over hashed indicator features: log-count ratios, hinge loss by dual coordinate descent, calibration."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BITS = 20
SEEN_IN = 3  # documents of the sample that a feature must occur in
BLEND = 0.25  # share of the fitted weights; the rest is their mean size
CLEAR = 3.5  # standard errors by which its share must differ between the classes


def folded(h: np.ndarray) -> np.ndarray:
    """Feature numbers below ``2 ** BITS`` of 64-bit hashes."""
    return (h >> np.uint64(64 - BITS)).astype(np.int64)


def per_text(text: np.ndarray, feature: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text and feature of every distinct pair, in order."""
    both = np.unique((text.astype(np.int64) << BITS) | feature)
    return both >> BITS, both & ((1 << BITS) - 1)


@dataclass
class Model:
    """``1 / (1 + exp(-(slope * margin + shift)))`` of the margin ``weights[features].sum()``."""

    weights: np.ndarray
    slope: float
    shift: float

    def margins(self, text: np.ndarray, feature: np.ndarray, texts: int) -> np.ndarray:
        """``text, feature`` as from ``per_text``; sums run in feature order and are the same in every run."""
        return np.bincount(text, weights=self.weights[feature].astype(np.float64), minlength=texts)

    def scores(self, margins: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * margins + self.shift, -500, 500)))


def _calibrated(margin: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve by Newton steps, towards softened labels so that clear cases stay finite."""
    pos, neg = label.sum(), (1 - label).sum()
    goal = np.where(label == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x = np.stack([margin, np.ones_like(margin)], axis=1)
    beta = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -500, 500)))
        gradient = x.T @ (p - goal) + 1e-4 * beta
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-4 * np.eye(2), gradient)
        beta = beta - step
        if np.abs(step).max() < 1e-9:
            break
    return float(max(beta[0], 1e-6)), float(beta[1])


def fit(text: np.ndarray, feature: np.ndarray, label: np.ndarray, cost: float = 1.0, epochs: int = 30, smoothing: float = 1.0, seed: int = 3) -> Model:
    """Naive Bayes support vectors on the texts' indicators.

    Every indicator is scaled by the log of the ratio of its smoothed shares in the two classes; a linear hinge-loss model on
    the scaled indicators is then fitted by dual coordinate descent, one text after the other in a seeded order. A fifth of
    the texts is held back to calibrate the margin. Without both classes the score is the share of label 1, or a half. ``text``
    and ``feature`` may be of any whole type; most features are dropped before the arrays are widened.
    """
    size, weights = 1 << BITS, np.zeros(1 << BITS, dtype=np.float32)
    n = len(label)
    pos, neg = int(label.sum()), int(n - label.sum())
    if pos == 0 or neg == 0:
        share = (pos + 1) / (n + 2)
        return Model(weights, 1.0, float(np.log(share / (1 - share))))
    in_pos = np.bincount(feature[(label == 1)[text]], minlength=size).astype(np.float64)
    in_neg = np.bincount(feature[(label == 0)[text]], minlength=size).astype(np.float64)
    share = (in_pos + in_neg) / n
    error = np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / pos + 1 / neg))
    chosen = (in_pos + in_neg >= min(SEEN_IN, n)) & (np.abs(in_pos / pos - in_neg / neg) >= CLEAR * error)
    ratio = np.log((in_pos + smoothing) / (pos + 2 * smoothing)) - np.log((in_neg + smoothing) / (neg + 2 * smoothing))
    keep = chosen[feature]
    text, feature = text[keep], feature[keep].astype(np.int64)
    del keep
    begin = np.searchsorted(text, np.arange(n + 1))
    rng = np.random.default_rng(seed)
    order = rng.permutation(n)
    held = order[: n // 5] if n >= 50 else order
    train = order[n // 5 :] if n >= 50 else order
    y = np.where(label == 1, 1.0, -1.0)
    # The rarer class counts as much as the other.
    bound = np.where(label == 1, cost * n / (2 * pos), cost * n / (2 * neg))
    rows = [feature[begin[i] : begin[i + 1]] for i in range(n)]
    values = [ratio[r] for r in rows]
    norm = np.array([v @ v + 1.0 for v in values])  # one more for the shift
    w, shift, alpha = np.zeros(size), 0.0, np.zeros(n)
    for _ in range(epochs):
        largest = 0.0
        for i in rng.permutation(train).tolist():
            r, v = rows[i], values[i]
            gradient = y[i] * (w[r] @ v + shift) - 1.0
            new = min(max(alpha[i] - gradient / norm[i], 0.0), bound[i])
            change = (new - alpha[i]) * y[i]
            if change:
                alpha[i] = new
                w[r] += change * v
                shift += change
                largest = max(largest, abs(change))
        if largest < 1e-3:
            break
    # Between naive Bayes and the support vectors: words too rare to become support vectors keep their ratio's say.
    used = np.unique(feature)
    mean = np.abs(w[used]).sum() / max(len(used), 1)
    w[used] = (1 - BLEND) * mean + BLEND * w[used]
    weights = (w * ratio).astype(np.float32)
    margin = np.bincount(text, weights=weights[feature].astype(np.float64), minlength=n)
    slope, level = _calibrated(margin[held], label[held].astype(np.float64))
    return Model(weights, slope, level)
