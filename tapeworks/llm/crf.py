"""A linear-chain conditional random field in numpy: training and Viterbi.

Sequences of a batch are padded and advance together, so each step of the
recursions is a few array operations whatever the number of sequences.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Score of a label that a position may not take.
NEVER = -1e6


@dataclass(frozen=True)
class Chain:
    weights: np.ndarray  # [feature, label]
    moves: np.ndarray  # [label, next label]
    first: np.ndarray  # [label]


def _padded(seqs: list[np.ndarray], fill: float = 0) -> np.ndarray:
    """[step, sequence, ...]"""
    out = np.full((max(map(len, seqs)), len(seqs), *seqs[0].shape[1:]), fill, seqs[0].dtype)
    for i, s in enumerate(seqs):
        out[: len(s), i] = s
    return out


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + np.squeeze(top, axis)


def _gradient(chain: Chain, xs: list[np.ndarray], ys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Observed minus expected counts, by forward-backward."""
    k = chain.moves.shape[0]
    lengths = np.array([len(x) for x in xs])
    scores = _padded([x @ chain.weights for x in xs])
    steps, n = scores.shape[:2]
    live = np.arange(steps)[:, None] < lengths
    alpha, beta = np.zeros_like(scores), np.zeros_like(scores)
    alpha[0] = chain.first + scores[0]
    for t in range(1, steps):
        alpha[t] = np.where(live[t][:, None], _log_sum(alpha[t - 1][:, :, None] + chain.moves, 1) + scores[t], alpha[t - 1])
    total = _log_sum(alpha[-1], 1)
    for t in range(steps - 2, -1, -1):
        beta[t] = np.where(live[t + 1][:, None], _log_sum(chain.moves + (scores[t + 1] + beta[t + 1])[:, None, :], 2), 0)
    node = np.exp(alpha + beta - total[:, None]) * live[:, :, None]
    moves = np.zeros((k, k))
    for t in range(1, steps):
        edge = np.exp(alpha[t - 1][:, :, None] + chain.moves + (scores[t] + beta[t])[:, None, :] - total[:, None, None])
        moves -= (edge * live[t][:, None, None]).sum(0)
    weights, first = np.zeros_like(chain.weights), -node[0].sum(0)
    for i, (x, y) in enumerate(zip(xs, ys)):
        weights += x.T @ (np.eye(k)[y] - node[: len(y), i])
        np.add.at(moves, (y[:-1], y[1:]), 1)
        first[y[0]] += 1
    return weights, moves, first


def fit(xs: list[np.ndarray], ys: list[np.ndarray], labels: int, epochs: int = 20, batch: int = 64, rate: float = 0.05, decay: float = 1e-4, seed: int = 7) -> Chain:
    """Maximum likelihood by Adam over batches of sequences of like length."""
    xs, ys = zip(*((x, y) for x, y in zip(xs, ys) if len(x))) if any(map(len, xs)) else ((np.zeros((1, 1)),), (np.zeros(1, int),))
    f = xs[0].shape[1]
    params = [np.zeros((f, labels)), np.zeros((labels, labels)), np.zeros(labels)]
    m, v, turn = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    order = np.argsort([len(x) for x in xs], kind="stable")
    batches = [order[i : i + batch] for i in range(0, len(order), batch)]
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for at in rng.permutation(len(batches)):
            own = batches[at]
            grads, turn = _gradient(Chain(*params), [xs[i] for i in own], [ys[i] for i in own]), turn + 1
            for j, g in enumerate(grads):
                g = g / len(own) - decay * params[j]
                m[j] = 0.9 * m[j] + 0.1 * g
                v[j] = 0.999 * v[j] + 0.001 * g * g
                params[j] = params[j] + rate * (m[j] / (1 - 0.9**turn)) / (np.sqrt(v[j] / (1 - 0.999**turn)) + 1e-8)
    return Chain(*params)


def viterbi(chain: Chain, scores: list[np.ndarray], width: int = 4096) -> list[np.ndarray]:
    """Best labels for sequences of emission scores [position, label]; equal
    scores go to the smaller label. Sequences of like length advance together."""
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(scores)
    order = [i for i in np.argsort([len(s) for s in scores], kind="stable") if len(scores[i])]
    while order:
        longest = len(scores[order[-1]])
        take = max(1, min(len(order), width, 2_000_000 // longest))
        own, order = order[-take:], order[:-take]
        lengths = np.array([len(scores[i]) for i in own])
        padded = _padded([scores[i] for i in own])
        best, back = chain.first + padded[0], np.zeros(padded.shape, np.int8)
        for t in range(1, longest):
            options = best[:, :, None] + chain.moves
            back[t] = options.argmax(1)
            live = (t < lengths)[:, None]
            best = np.where(live, options.max(1) + padded[t], best)
        state, path = best.argmax(1), np.zeros((longest, len(own)), np.int64)
        rows = np.arange(len(own))
        for t in range(longest - 1, -1, -1):
            path[t] = state
            state = np.where(t < lengths, back[t][rows, state], state) if t else state
        for j, i in enumerate(own):
            out[i] = path[: lengths[j], j]
    return out
