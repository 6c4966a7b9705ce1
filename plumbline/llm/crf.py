"""Linear-chain conditional random field in numpy, over many sequences at once.

Sequences lie one after the other in the rows of a score matrix; ``lengths``
tells them apart. All recursions step through positions and treat every sequence
that is long enough at once. Fitting is full-batch on a bounded sample.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def _steps(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First rows of the sequences, longest first, and the number of sequences that reach each position."""
    order = np.argsort(-lengths, kind="stable")
    starts = np.concatenate(([0], np.cumsum(lengths)))[:-1][order]
    longest = int(lengths.max(initial=0))
    return starts, len(lengths) - np.searchsorted(np.sort(lengths), np.arange(longest), "right")


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis))


@dataclass
class Chain:
    """Weights: features x states, start scores and transition scores [from, to]."""

    weights: np.ndarray
    start: np.ndarray
    move: np.ndarray

    def forward_backward(self, scores: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """Marginals of every row, expected start and transition counts, and the sum of log partition functions."""
        starts, active = _steps(lengths)
        alpha, beta = np.zeros_like(scores), np.zeros_like(scores)
        for t, n in enumerate(active):
            rows = starts[:n] + t
            alpha[rows] = scores[rows] + (self.start if t == 0 else _lse(alpha[rows - 1][:, :, None] + self.move, 1))
        for t in range(len(active) - 2, -1, -1):
            rows = starts[: active[t + 1]] + t
            beta[rows] = _lse(self.move + (scores[rows + 1] + beta[rows + 1])[:, None, :], 2)
        log_z = np.repeat(0.0, len(scores))
        ends = starts + np.sort(lengths)[::-1] - 1
        live = np.sort(lengths)[::-1] > 0
        z = np.zeros(len(starts))
        z[live] = _lse(alpha[ends[live]], 1)
        log_z = np.repeat(z[live], np.sort(lengths)[::-1][live])
        row = np.concatenate([np.arange(s, s + n) for s, n in zip(starts, np.sort(lengths)[::-1], strict=True)]) if len(starts) else np.zeros(0, int)
        own_z = np.zeros(len(scores))
        own_z[row] = log_z
        marginals = np.exp(alpha + beta - own_z[:, None])
        moves = np.zeros_like(self.move)
        first = np.zeros(len(scores), bool)
        first[starts[live]] = True
        later = np.flatnonzero(~first)
        if len(later):
            moves = np.exp(alpha[later - 1][:, :, None] + self.move + (scores[later] + beta[later])[:, None, :] - own_z[later][:, None, None]).sum(0)
        return marginals, marginals[starts[live]].sum(0), moves, float(z.sum())

    def viterbi(self, scores: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The best state of every row; equal scores take the lower state."""
        starts, active = _steps(lengths)
        best, back = np.zeros_like(scores), np.zeros(scores.shape, np.int8)
        for t, n in enumerate(active):
            rows = starts[:n] + t
            if t:
                paths = best[rows - 1][:, :, None] + self.move
                back[rows] = paths.argmax(1)
                best[rows] = scores[rows] + paths.max(1)
            else:
                best[rows] = scores[rows] + self.start
        states = np.zeros(len(scores), np.int64)
        sizes = np.sort(lengths)[::-1]
        live = sizes > 0
        ends = starts[live] + sizes[live] - 1
        states[ends] = best[ends].argmax(1)
        for t in range(len(active) - 1, 0, -1):
            rows = starts[: active[t]] + t
            states[rows - 1] = back[rows, states[rows]]
        return states


def fit(features: np.ndarray, lengths: np.ndarray, states: np.ndarray, n_states: int, penalty: float = 1.0, rounds: int = 150, row_weight: np.ndarray | None = None) -> Chain:
    """Maximise the penalised conditional likelihood by gradient steps with a step per weight (Rprop)."""
    k = features.shape[1]
    lengths = np.asarray(lengths)
    first = np.concatenate(([0], np.cumsum(lengths)))[:-1][lengths > 0]
    gold = np.zeros((len(states), n_states))
    gold[np.arange(len(states)), states] = 1
    is_first = np.zeros(len(states), bool)
    is_first[first] = True
    later = np.flatnonzero(~is_first)
    gold_moves = np.zeros((n_states, n_states))
    np.add.at(gold_moves, (states[later - 1], states[later]), 1)
    gold_start = gold[first].sum(0)
    theta = np.zeros(k * n_states + n_states + n_states * n_states)
    step, last = np.full_like(theta, 0.05), np.zeros_like(theta)

    def unpack(v: np.ndarray) -> Chain:
        return Chain(v[: k * n_states].reshape(k, n_states), v[k * n_states : (k + 1) * n_states], v[(k + 1) * n_states :].reshape(n_states, n_states))

    for _ in range(rounds):
        chain = unpack(theta)
        marginals, start, moves, _ = chain.forward_backward(features @ chain.weights, lengths)
        gradient = np.concatenate(((features.T @ (gold - marginals)).ravel(), gold_start - start, (gold_moves - moves).ravel())) - penalty * theta
        turn = gradient * last
        step = np.clip(np.where(turn > 0, step * 1.2, np.where(turn < 0, step * 0.5, step)), 1e-6, 1.0)
        gradient = np.where(turn < 0, 0, gradient)
        theta = theta + np.sign(gradient) * step
        last = gradient
    return unpack(theta)
