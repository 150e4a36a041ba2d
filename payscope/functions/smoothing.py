"""Additive Holt-Winters smoothing of short series of one length, together (numpy only).

For fixed smoothing weights the one-step errors are linear in the starting state, so that state is
a least-squares solution, and only the three weights are searched: a coarse grid, then finer grids
around the best point. All grid points of some series are evaluated together; a series' result does not
depend on the others. The result is deterministic.
"""

from __future__ import annotations

import numpy as np

MIN_SEASONS = 2


def _states(y: np.ndarray, weights: np.ndarray, season: int):
    """Run the smoothing for series y (s, n) and weights (s, g, 3), all at once.

    Every state is linear in the starting state and the data: of its last axis, the first `season + 2`
    places (level, trend, seasons) are the factors of the starting state, the last one is what the
    data add. Returns what the state expects before each value, and the state after the last one.
    """
    level_gain, trend_gain, season_gain = (w[..., None] for w in np.moveaxis(weights, -1, 0))
    k = season + 2
    state = np.broadcast_to(np.eye(k, k + 1)[:, None, None], (k, *weights.shape[:2], k + 1)).copy()
    level, trend, seasons = state[0], state[1], list(state[2:])
    expected = np.empty((y.shape[1], *level.shape))
    for t in range(y.shape[1]):
        expected[t] = level + trend + seasons[0]
        error = -expected[t]
        error[..., k] += y[:, t, None]
        level = level + trend + level_gain * error
        trend = trend + trend_gain * error
        seasons = [*seasons[1:], seasons[0] + season_gain * error]
    return expected, np.stack([level, trend, *seasons])


def _fitted(y: np.ndarray, weights: np.ndarray, season: int, exact: bool):
    """One-step errors (s, g, n) and last states (s, g, season + 2) of the best starting states.

    A constant may go from the level to all seasons without any effect, so one season of the
    starting state is set to zero. `exact` solves the least squares by an orthogonal method.
    """
    expected, last = _states(y, weights, season)
    design, offset = np.moveaxis(expected[..., :-1], 0, -2), np.moveaxis(expected[..., -1], 0, -1)
    target = y[:, None, :] - offset
    free = design[..., :-1]
    if exact:
        start = (np.linalg.pinv(free, rcond=1e-10) @ target[..., None])[..., 0]
    else:
        gram = np.swapaxes(free, -1, -2) @ free
        ridge = 1e-12 * np.trace(gram, axis1=-2, axis2=-1)[..., None, None] * np.eye(gram.shape[-1])
        start = np.linalg.solve(gram + ridge, np.swapaxes(free, -1, -2) @ target[..., None])[..., 0]
    errors = target - (free @ start[..., None])[..., 0]
    states = np.moveaxis(last, 0, -2)
    return errors, (states[..., :-2] @ start[..., None])[..., 0] + states[..., -1]


def _grid(centre, width: float, points: int) -> np.ndarray:
    """Admissible triples: 0 < trend < level < 1 and 0 < seasonal < 1 - level."""
    offsets = np.linspace(-width, width, points)
    level, trend, seasonal = np.meshgrid(*[c + offsets for c in centre], indexing="ij")
    level, trend, seasonal = (np.clip(a.ravel(), 1e-4, 1 - 2e-4) for a in (level, trend, seasonal))
    trend = np.minimum(trend, level * (1 - 1e-4))
    seasonal = np.minimum(seasonal, (1 - level) * (1 - 1e-4))
    return np.unique(np.stack([level, trend, seasonal], axis=1), axis=0)


def holt_winters_many(histories: np.ndarray, horizon: int, season: int = 4, at_once: int = 32):
    """Point forecasts (s, horizon) and deviations of the one-step errors (s) of series of one length."""
    every = np.asarray(histories, dtype="float64")
    if every.shape[1] < MIN_SEASONS * season:
        raise ValueError(f"ets needs at least {MIN_SEASONS * season} observations, got {every.shape[1]}")
    points, spreads = np.empty((len(every), horizon)), np.zeros(len(every))
    ahead = np.arange(1, horizon + 1)
    for begin in range(0, len(every), at_once):
        y = every[begin : begin + at_once]
        scale = np.maximum(np.abs(y).max(axis=1), 1e-300)[:, None]
        y = y / scale
        centres, width = [(0.5, 0.5, 0.5)] * len(y), 0.48
        for _ in range(5):
            grids = [_grid(c, width, 7) for c in centres]
            longest = max(map(len, grids))
            # Grids at the border have fewer points: their last one is repeated.
            weights = np.stack([g[np.minimum(np.arange(longest), len(g) - 1)] for g in grids])
            errors, _ = _fitted(y, weights, season, exact=False)
            best = (errors**2).sum(axis=2).argmin(axis=1)
            centres, width = [tuple(w[b]) for w, b in zip(weights, best, strict=True)], width / 3
        errors, states = _fitted(y, np.array(centres)[:, None, :], season, exact=True)
        states = states[:, 0] * scale
        points[begin : begin + len(y)] = (
            states[:, :1] + ahead * states[:, 1:2] + states[:, 2:][:, (ahead - 1) % season]
        )
        spreads[begin : begin + len(y)] = np.std(errors[:, 0] * scale, axis=1, ddof=1)
    return points, spreads


def holt_winters(history, horizon: int, season: int = 4):
    """Point forecasts and the standard deviation of the one-step errors of one series."""
    points, spreads = holt_winters_many(np.asarray(history, dtype="float64")[None, :], horizon, season)
    return points[0], float(spreads[0])
