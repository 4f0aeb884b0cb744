"""Linear-chain conditional random field with two states, over binary features.

A sequence is a list of feature lists, one per item. ``emit[f]`` is what feature ``f`` adds to the
score of state 1 (state 0 is the reference); ``move[a][b]`` is the score of going from a to b."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Crf:
    emit: list[float]
    move: list[list[float]]


def viterbi(model: Crf, items: list[list[int]]) -> list[int]:
    """Best state sequence; ties go to state 0."""
    if not items:
        return []
    emit, ((s00, s01), (s10, s11)) = model.emit, model.move
    zero, one, back = 0.0, 0.0, []
    for i, features in enumerate(items):
        score = sum([emit[f] for f in features])
        if i:
            from0, from1 = zero + s00, one + s10
            to0, to1 = zero + s01, one + s11
            back.append((from1 > from0, to1 > to0))
            zero = from1 if from1 > from0 else from0
            one = (to1 if to1 > to0 else to0) + score
        else:
            one = score
    state = int(one > zero)
    path = [state]
    for step in reversed(back):
        state = int(step[state])
        path.append(state)
    return path[::-1]


def fit(
    sequences: list[list[list[int]]],
    states: list[list[int]],
    n_features: int,
    rounds: int = 150,
    ridge: float = 0.0005,
) -> Crf:
    """Maximum likelihood with an L2 penalty, by Adam on forward-backward gradients; all
    sequences advance together, one position at a time."""
    n, longest = len(sequences), max(map(len, sequences))
    x = np.zeros((n, longest, n_features), dtype=np.float32)
    y = np.zeros((n, longest), dtype=np.int64)
    there = np.zeros((n, longest), dtype=bool)
    for i, (items, marks) in enumerate(zip(sequences, states, strict=True)):
        there[i, : len(items)] = True
        y[i, : len(marks)] = marks
        for t, features in enumerate(items):
            x[i, t, features] = 1
    total = there.sum()
    seen_emit = np.einsum("nt,ntf->f", (y * there).astype(np.float32), x).astype(np.float64)
    pairs = there[:, 1:]
    seen_move = np.array(
        [[((y[:, :-1] == a) & (y[:, 1:] == b) & pairs).sum() for b in (0, 1)] for a in (0, 1)],
        dtype=np.float64,
    )
    weights = np.zeros(n_features + 4)
    mean, square = np.zeros_like(weights), np.zeros_like(weights)
    for k in range(1, rounds + 1):
        emit, move = weights[:n_features], weights[n_features:].reshape(2, 2)
        score = np.zeros((n, longest, 2))
        score[:, :, 1] = x @ emit.astype(np.float32)
        ahead = np.zeros_like(score)
        ahead[:, 0] = score[:, 0]
        for t in range(1, longest):
            step = np.logaddexp.reduce(ahead[:, t - 1, :, None] + move, axis=1) + score[:, t]
            ahead[:, t] = np.where(there[:, t, None], step, ahead[:, t - 1])
        behind = np.zeros_like(score)
        for t in range(longest - 2, -1, -1):
            step = np.logaddexp.reduce(
                move + (score[:, t + 1] + behind[:, t + 1])[:, None, :], axis=2
            )
            behind[:, t] = np.where(there[:, t + 1, None], step, 0)
        norm = np.logaddexp.reduce(ahead[:, -1], axis=1)
        one = np.exp(ahead[:, :, 1] + behind[:, :, 1] - norm[:, None]) * there
        gain_emit = seen_emit - np.einsum("nt,ntf->f", one.astype(np.float32), x)
        joint = np.exp(
            ahead[:, :-1, :, None]
            + move
            + (score[:, 1:] + behind[:, 1:])[:, :, None, :]
            - norm[:, None, None, None]
        )
        gain_move = seen_move - (joint * pairs[:, :, None, None]).sum(axis=(0, 1))
        gain = np.concatenate([gain_emit, gain_move.ravel()]) / total - ridge * weights
        mean, square = 0.9 * mean + 0.1 * gain, 0.99 * square + 0.01 * gain**2
        weights = weights + 0.1 * (mean / (1 - 0.9**k)) / (np.sqrt(square / (1 - 0.99**k)) + 1e-8)
    rounded = np.round(weights, 9).tolist()  # sums may differ in the last bits elsewhere
    move = rounded[n_features:]
    return Crf(rounded[:n_features], [move[:2], move[2:]])
