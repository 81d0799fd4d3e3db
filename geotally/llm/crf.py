"""A two-label linear-chain conditional random field over sequences of categorical features, in numpy.

Every position has one value of each of several features; label 1's score is the sum of a weight for each value at the
position itself and at its two neighbours (an extra value stands for "outside"), label 0's is 0. Sequences run side by
side, longest first, one position a step.
"""

from __future__ import annotations

import numpy as np


class Chains:
    """Sequences laid out one after another, with the order in which they run side by side."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = np.asarray(lengths, np.int64)
        start = np.cumsum(self.lengths) - self.lengths
        self.order = np.argsort(-self.lengths, kind="stable")
        n = self.lengths[self.order]
        self.start, self.last, self.total = start[self.order], start[self.order] + n - 1, int(self.lengths.sum())
        self.live = np.searchsorted(-n, -np.arange(int(n[0]) if n.size else 0), side="left")

    def neighbours(self, values: np.ndarray, outside: int) -> tuple[np.ndarray, np.ndarray]:
        """values [position, feature] of the position before and of the one after."""
        before, after = np.full_like(values, outside), np.full_like(values, outside)
        before[1:], after[:-1] = values[:-1], values[1:]
        before[self.start], after[self.last] = outside, outside
        return before, after


def log_sum(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum(a, b) + np.log1p(np.exp(-np.abs(a - b)))


def forward_backward(score: np.ndarray, moves: np.ndarray, chains: Chains) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """P(label 1) at each position, expected moves [from, to], and log Z of each chain in running order."""
    alpha, beta = np.zeros((chains.total, 2)), np.zeros((chains.total, 2))
    alpha[chains.start, 1] = score[chains.start]
    for t, m in enumerate(chains.live[1:], 1):
        i = chains.start[:m] + t
        a = alpha[i - 1]
        alpha[i, 0] = log_sum(a[:, 0] + moves[0, 0], a[:, 1] + moves[1, 0])
        alpha[i, 1] = log_sum(a[:, 0] + moves[0, 1], a[:, 1] + moves[1, 1]) + score[i]
    total, expected = log_sum(alpha[chains.last, 0], alpha[chains.last, 1]), np.zeros((2, 2))
    for t in range(len(chains.live) - 1, 0, -1):
        m = chains.live[t]
        i = chains.start[:m] + t
        right = beta[i] + np.stack([np.zeros(m), score[i]], 1)
        for y in (0, 1):
            beta[i - 1, y] = log_sum(right[:, 0] + moves[y, 0], right[:, 1] + moves[y, 1])
            for z in (0, 1):
                expected[y, z] += np.exp(alpha[i - 1, y] + moves[y, z] + right[:, z] - total[:m]).sum()
    every = np.empty(chains.total)
    for t, m in enumerate(chains.live):
        every[chains.start[:m] + t] = total[:m]
    return np.exp(np.minimum(0, alpha[:, 1] + beta[:, 1] - every)), expected, total


def viterbi(score: np.ndarray, moves: np.ndarray, chains: Chains) -> np.ndarray:
    """The likeliest labels; ties go to label 0."""
    best, back, out = np.zeros((chains.total, 2)), np.zeros((chains.total, 2), np.int8), np.zeros(chains.total, np.int8)
    best[chains.start, 1] = score[chains.start]
    for t, m in enumerate(chains.live[1:], 1):
        i = chains.start[:m] + t
        for z in (0, 1):
            a, b = best[i - 1, 0] + moves[0, z], best[i - 1, 1] + moves[1, z]
            back[i, z] = b > a
            best[i, z] = np.maximum(a, b) + (score[i] if z else 0)
    out[chains.last] = best[chains.last, 1] > best[chains.last, 0]
    for t in range(len(chains.live) - 1, 0, -1):
        i = chains.start[: chains.live[t]] + t
        out[i - 1] = back[i, out[i]]
    return out


class Model:
    """weights [where (itself, before, after), feature, value] and moves [from, to]."""

    def __init__(self, features: int, values: int):
        self.weights, self.moves = np.zeros((3, features, values + 1)), np.zeros((2, 2))

    def score(self, x: np.ndarray, chains: Chains) -> np.ndarray:
        outside, f = self.weights.shape[2] - 1, np.arange(x.shape[1])
        around = (x, *chains.neighbours(x, outside))
        return sum(self.weights[w, f, a].sum(axis=1) for w, a in enumerate(around))

    def fit(self, x: np.ndarray, labels: np.ndarray, chains: Chains, rounds: int = 250, penalty: float = 1e-3, rate: float = 0.1, enough: float = 1e-3) -> Model:
        """Penalised maximum likelihood of labels (one a position) by Adam over all chains, until no part of the gradient exceeds ``enough``; deterministic."""
        outside, n_f = self.weights.shape[2] - 1, x.shape[1]
        flat = [a.astype(np.int64) + np.arange(n_f) * (outside + 1) for a in (x, *chains.neighbours(x, outside))]
        inner = np.ones(chains.total, bool)
        inner[chains.last] = False
        i = np.flatnonzero(inner)
        seen = np.zeros((2, 2))
        np.add.at(seen, (labels[i], labels[i + 1]), 1)
        params, moments = [self.weights, self.moves], [[np.zeros_like(p), np.zeros_like(p)] for p in (self.weights, self.moves)]
        for step in range(1, rounds + 1):
            p, expected, _ = forward_backward(self.score(x, chains), self.moves, chains)
            error = labels - p
            g = np.stack([np.bincount(a.ravel(), np.repeat(error, n_f), n_f * (outside + 1)).reshape(n_f, outside + 1) for a in flat])
            n = max(1, chains.lengths.size)
            grads = (g / n - penalty * self.weights, (seen - expected) / n - penalty * self.moves)
            if max(np.abs(grad).max() for grad in grads) < enough:
                break
            for k, grad in enumerate(grads):
                m, v = moments[k]
                m += 0.1 * (grad - m)
                v += 0.001 * (grad * grad - v)
                params[k] += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        return self
