"""Cube method of balanced sampling: flight and landing kernels.

Inclusion probabilities move through the null space of the balancing
constraints until all but a few are 0 or 1 (flight); the constraints are then
given up one by one, the least important first (landing). Expectations are kept
at every step, so each unit is drawn with its own probability.
"""

from __future__ import annotations

import numpy as np

EPS = 1e-9
#: Units that one stream of the vectorised flight walks, for each constraint.
STREAM = 32


def _null(matrix: np.ndarray) -> np.ndarray:
    """A null vector of each matrix of shape (m, p, p + 1)."""
    p = matrix.shape[1]
    if p == 0:
        return np.ones((len(matrix), 1))
    if p == 1:
        u = np.stack([matrix[:, 0, 1], -matrix[:, 0, 0]], axis=1)
    elif p == 2:
        u = np.cross(matrix[:, 0], matrix[:, 1])
    else:
        u = np.linalg.svd(matrix)[2][:, -1]
    size = np.abs(u).max(axis=1)
    if (weak := size < 1e-12).any():  # dependent rows
        u[weak] = np.linalg.svd(matrix[weak])[2][:, -1]
        size = np.abs(u).max(axis=1)
    return u / size[:, None]


def _step(pi: np.ndarray, u: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Each row of pi moves along u to the face of the cube, up or down by chance."""
    with np.errstate(divide="ignore", invalid="ignore"):
        up = np.where(u > EPS, (1 - pi) / u, np.where(u < -EPS, -pi / u, np.inf)).min(axis=1)
        down = np.where(u > EPS, pi / u, np.where(u < -EPS, (pi - 1) / u, np.inf)).min(axis=1)
    far = rng.random(len(pi)) * (up + down) < down
    moved = pi + np.where(far, up, -down)[:, None] * u
    moved[moved < EPS] = 0.0
    moved[moved > 1 - EPS] = 1.0
    return moved


def _streams(pi: np.ndarray, a: np.ndarray, width: int, rng: np.random.Generator) -> None:
    """One flight in each of ``width`` streams at once; pi is changed in place."""
    n, p = a.shape
    length = -(-n // width)
    place = np.full(width * length, -1)
    place[:n] = np.arange(n)
    place = place.reshape(length, width).T  # stream s has units s, s + width, ...
    if length <= p:
        return
    window, upto = place[:, : p + 1].copy(), np.full(width, p + 1)
    alive = np.flatnonzero((window >= 0).all(axis=1))
    while len(alive):
        w = window[alive]
        moved = _step(pi[w], _null(a[w].transpose(0, 2, 1)), rng)
        pi[w] = moved
        done = (moved == 0.0) | (moved == 1.0)
        for slot in range(p + 1):
            rows = alive[done[:, slot]]
            if len(rows):
                at = upto[rows]
                window[rows, slot] = np.where(at < length, place[rows, np.minimum(at, length - 1)], -1)
                upto[rows] += 1
        alive = alive[(window[alive] >= 0).all(axis=1)]


def flight(pi: np.ndarray, a: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Resolve all but at most as many units as a has columns.

    pi: inclusion probabilities (n); a: balancing values over the units' first
    inclusion probabilities (n, p), which stay those of the start when a flight
    goes on from an earlier one. The sums of a over the units, weighted with the
    result, stay as they were.
    """
    pi = np.clip(np.asarray(pi, dtype=float), 0.0, 1.0).copy()
    pi[pi < EPS], pi[pi > 1 - EPS] = 0.0, 1.0
    a = np.asarray(a, dtype=float).reshape(len(pi), -1)
    p = a.shape[1]
    if p and len(a):  # one scale for all constraints
        a = a / np.maximum(np.abs(a).max(axis=0), 1e-300)
    while len(rest := np.flatnonzero((pi > 0) & (pi < 1))) > p:
        width = max(1, len(rest) // (STREAM * (p + 1)))
        sub = pi[rest]
        _streams(sub, a[rest], width, rng)
        pi[rest] = sub
    return pi


def land(pi: np.ndarray, a: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Resolve the rest: columns of a are given up from the last to the first.

    Before one is given up, the few units left move as far as all columns still
    there allow; as these may depend on one another, fewer units than columns
    may be able to. So of units of several kinds with a column each, no kind
    ends a whole unit off its sum.
    """
    a = np.asarray(a, dtype=float).reshape(len(pi), -1)
    scale = np.maximum(np.abs(a).max(axis=0), 1e-300) if a.size else 1.0
    for p in range(a.shape[1], -1, -1):
        pi = flight(pi, a[:, :p], rng)
        while len(rest := np.flatnonzero((pi > 0) & (pi < 1))):
            matrix = (a / scale)[rest, :p].T
            _, size, v = np.linalg.svd(matrix, full_matrices=True) if p else (None, np.empty(0), np.eye(len(rest)))
            if (size > 1e-9).sum() >= len(rest):
                break
            u = v[-1] / np.abs(v[-1]).max()
            pi[rest] = _step(pi[rest][None], u[None], rng)[0]
        else:
            break
    return pi
