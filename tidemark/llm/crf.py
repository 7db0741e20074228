"""Linear-chain conditional random fields in numpy, many sequences in step.

Sequences are kept end to end in flat arrays. They are walked in step, longest first:
at step t the rows of all sequences that are longer than t are handled at once, so
that a batch costs as many numpy calls as its longest sequence has items.
"""

from __future__ import annotations

import numpy as np


def _steps(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start of each sequence, longest first, and how many are longer than each step."""
    start = np.cumsum(lengths) - lengths
    order = np.argsort(-lengths, kind="stable")
    longest = int(lengths.max(initial=0))
    alive = len(lengths) - np.searchsorted(np.sort(lengths), np.arange(longest), "right")
    return start[order], alive


def posteriors(emit: np.ndarray, lengths: np.ndarray, transit: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward: the probability of each label of each item (rows sum to 1) and,
    if asked for, the expected number of each pair of adjacent labels."""
    start, alive = _steps(lengths)
    e = np.exp(emit - emit.max(axis=1, keepdims=True))
    step = np.exp(transit - transit.max())
    forward, back, counts = np.empty_like(e), np.ones_like(e), np.zeros_like(step)
    for t, n in enumerate(alive):
        at = start[:n] + t
        a = e[at] if t == 0 else (forward[at - 1] @ step) * e[at]
        forward[at] = a / a.sum(axis=1, keepdims=True)
    for t in range(len(alive) - 2, -1, -1):
        at = start[: alive[t + 1]] + t
        right = e[at + 1] * back[at + 1]
        if pairs:
            joint = forward[at][:, :, None] * step * right[:, None, :]
            counts += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        b = right @ step.T
        back[at] = b / b.sum(axis=1, keepdims=True)
    p = forward * back
    return p / p.sum(axis=1, keepdims=True), counts


def viterbi(emit: np.ndarray, lengths: np.ndarray, transit: np.ndarray) -> np.ndarray:
    """The best label sequence of each sequence, end to end."""
    start, alive = _steps(lengths)
    best, came = emit.astype(np.float64).copy(), np.zeros(emit.shape, np.int8)
    for t, n in enumerate(alive):
        if t:
            at = start[:n] + t
            ways = best[at - 1][:, :, None] + transit
            came[at] = ways.argmax(axis=1)
            best[at] += ways.max(axis=1)
    label = np.zeros(len(emit), np.int64)
    for t in range(len(alive) - 1, -1, -1):
        n, later = alive[t], alive[t + 1] if t + 1 < len(alive) else 0
        at = start[:n] + t
        label[at[later:]] = best[at[later:]].argmax(axis=1)
        if later:
            label[at[:later]] = came[at[:later] + 1, label[at[:later] + 1]]
    return label


def fit(
    features: list[np.ndarray], lengths: np.ndarray, labels: np.ndarray, n_features: int, n_labels: int,
    epochs: int = 8, rate: float = 0.3, decay: float = 1e-4, batch: int = 64, seed: int = 0,
) -> tuple[np.ndarray, np.ndarray]:
    """Weights (n_features, n_labels) and transitions by AdaGrad on the log-likelihood.

    features: for each slot, the feature number of every item (-1: none), end to end.
    """
    weight, transit = np.zeros((n_features, n_labels)), np.zeros((n_labels, n_labels))
    weight_sum, transit_sum = np.full_like(weight, 1e-6), np.full_like(transit, 1e-6)
    begin = np.cumsum(lengths) - lengths
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        order = rng.permutation(len(lengths))
        for at in range(0, len(order), batch):
            chosen = order[at : at + batch]
            size = lengths[chosen]
            rows = np.repeat(begin[chosen] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            emit = emissions(weight, [f[rows] for f in features])
            p, pair = posteriors(emit, size, transit, pairs=True)
            gold = labels[rows]
            error = p
            error[np.arange(len(rows)), gold] -= 1
            slope = np.zeros_like(weight)
            for f in features:
                used = f[rows] >= 0
                np.add.at(slope, f[rows][used], error[used])
            inner = np.ones(len(rows), bool)
            inner[np.cumsum(size) - 1] = False
            np.add.at(pair, (gold[inner], gold[1:][inner[:-1]]), -1)
            n = len(chosen)
            slope, pair = slope / n + decay * weight, pair / n + decay * transit
            weight_sum += slope**2
            transit_sum += pair**2
            weight -= rate * slope / np.sqrt(weight_sum)
            transit -= rate * pair / np.sqrt(transit_sum)
    return weight, transit


def emissions(weight: np.ndarray, features: list[np.ndarray]) -> np.ndarray:
    """Sum of the weights of each item's features."""
    padded = np.vstack([weight, np.zeros(weight.shape[1])])  # feature -1 is the row of zeros
    return sum((padded[f] for f in features[1:]), padded[features[0]].copy())
