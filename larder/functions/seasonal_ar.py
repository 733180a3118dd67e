"""Seasonal autoregressions with moving averages, fitted per series inside grouped tasks (numpy only).

(1 - a(L)) (1 - A(L^s)) (1 - L)^d (1 - L^s)^D y = (1 + c(L)) (1 + C(L^s)) e, by conditional least squares. The
functions see one series of at most one row per calendar day.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np

Z95 = 1.959964
BOUND = 0.999  # largest inverse root of a factor
SMALL_GAIN = 1e-8  # share of the sum of squares


@dataclass(frozen=True)
class Orders:
    """(p, d, q) (P, D, Q, s). Own and seasonal lags must not meet, so p and q stay below s."""

    order: tuple[int, int, int] = (1, 1, 1)
    seasonal_order: tuple[int, int, int, int] = (1, 1, 0, 7)

    def __post_init__(self):
        if len(self.order) != 3 or len(self.seasonal_order) != 4:
            raise ValueError("order needs 3 numbers, seasonal_order 4")
        if any(not isinstance(k, int) or isinstance(k, bool) or k < 0 for k in (*self.order, *self.seasonal_order)):
            raise ValueError(f"orders must be whole numbers from 0: {self.order} {self.seasonal_order}")
        *seasonal, season = self.seasonal_order
        if any(seasonal) and (season < 2 or season <= max(self.order[0], self.order[2])):
            raise ValueError(f"season {season} must be above 1, p and q")

    @property
    def season(self) -> int:
        """0 without a seasonal part."""
        return self.seasonal_order[3] if any(self.seasonal_order[:3]) else 0

    def factors(self) -> list[tuple[int, int, int]]:
        """Per factor its number of coefficients, the lag between them and the sign before them."""
        (p, _, q), (sp, _, sq, _) = self.order, self.seasonal_order
        return [(p, 1, -1), (sp, self.season, -1), (q, 1, 1), (sq, self.season, 1)]

    def differences(self) -> np.ndarray:
        step = np.array([1.0, -1.0])
        return _product([step] * self.order[1] + [_spread(step, self.season or 1)] * self.seasonal_order[1])


@dataclass(frozen=True)
class Fit:
    levels: np.ndarray  # polynomial of y, differences included
    shocks: np.ndarray  # polynomial of the errors
    errors: np.ndarray
    converged: bool


def _product(polynomials: Sequence[np.ndarray]) -> np.ndarray:
    return reduce(np.convolve, polynomials, np.ones(1))


def _spread(polynomial: np.ndarray, lag: int) -> np.ndarray:
    """The polynomial of L**lag."""
    out = np.zeros((len(polynomial) - 1) * lag + 1)
    out[::lag or 1] = polynomial
    return out


def _solve(a: np.ndarray, b: np.ndarray, ridge: float = 1e-6) -> np.ndarray:
    return np.linalg.solve(a.T @ a + ridge * np.eye(a.shape[1]), a.T @ b)


def _polynomials(point: np.ndarray, orders: Orders) -> tuple[np.ndarray, np.ndarray]:
    """Of z and of the errors, from the coefficients of all factors."""
    made, at = [], 0
    for count, lag, sign in orders.factors():
        made.append(_spread(np.r_[1.0, sign * point[at: at + count]], lag))
        at += count
    return np.convolve(*made[:2]), np.convolve(*made[2:])


def _inside(point: np.ndarray, orders: Orders) -> tuple[np.ndarray, np.ndarray]:
    """Each factor with its inverse roots drawn inside the bound (a single coefficient is clipped), and which are free of it."""
    point, free, at = point.copy(), np.ones(len(point), dtype=bool), 0
    for count, _, sign in orders.factors():
        part = point[at: at + count]
        radius = max(np.abs(np.roots(np.r_[1.0, sign * part])), default=0.0)
        if radius > BOUND:
            point[at: at + count] = part * (BOUND / radius) ** np.arange(1, count + 1)
            free[at: at + count] = False
        at += count
    return point, free


def one_step_errors(z: np.ndarray, levels: np.ndarray, shocks: np.ndarray) -> np.ndarray:
    """The errors e of levels(L) z = shocks(L) e from the first z with all its lags; errors before are zero."""
    filtered = np.convolve(z, levels)[len(levels) - 1: len(z)]
    lags = np.flatnonzero(shocks)[1:].tolist()
    weights, longest = shocks[lags].tolist(), len(shocks) - 1
    errors = [0.0] * longest
    for t, value in enumerate(filtered.tolist(), longest):
        for lag, weight in zip(lags, weights):
            value -= weight * errors[t - lag]
        errors.append(value)
    return np.array(errors[longest:])


def _start(z: np.ndarray, orders: Orders, past: int) -> np.ndarray:
    """Two-stage regression: a long autoregression gives errors, whose lags join the lags of z."""
    def lagged(x, lags, start):
        return np.column_stack([x[start - k: len(x) - k] for k in lags])

    levels, shocks = (np.flatnonzero(p)[1:].tolist() for p in _polynomials(np.full(_size(orders), 0.1), orders))
    own = lagged(z, range(1, past + 1), past)
    noise = np.r_[np.zeros(past), z[past:] - own @ _solve(own, z[past:])]
    start = past + max(levels + shocks)
    columns = [lagged(x, lags, start) for x, lags in ((z, levels), (noise, shocks)) if lags]
    found = _solve(np.hstack(columns), z[start:])
    of_level, of_shock = dict(zip(levels, found)), dict(zip(shocks, found[len(levels):]))
    return np.array([(of_level if sign < 0 else of_shock)[k * lag]
                     for count, lag, sign in orders.factors() for k in range(1, count + 1)])


def _size(orders: Orders) -> int:
    return sum(count for count, _, _ in orders.factors())


def fit_seasonal_ar(y: np.ndarray, orders: Orders, min_rows: int, max_steps: int) -> Fit:
    """Damped Gauss-Newton steps; where none helps, factors that it moves beyond the bound are held and the others go on.

    Converged: the last step, or the best one left, gains less than SMALL_GAIN. ValueError if fewer than `min_rows`
    differences remain beside the lags of the start.
    """
    differences = orders.differences()
    z = np.convolve(y, differences)[len(differences) - 1: len(y)]
    past = 2 * max(orders.season, orders.order[0] + orders.order[2])
    longest = max(len(p) - 1 for p in _polynomials(np.zeros(_size(orders)), orders))
    if len(z) < min_rows + max(past, longest) or len(z) - past - longest <= _size(orders):
        raise ValueError(f"only {len(y)} days")

    def errors_at(point):
        return one_step_errors(z, *_polynomials(point, orders))

    point = _inside(_start(z, orders, past), orders)[0] if _size(orders) else np.zeros(0)
    errors, converged = errors_at(point), not _size(orders)
    for _ in range(max_steps if len(point) else 0):
        slopes = np.column_stack([(errors_at(point + shift) - errors) / 1e-5 for shift in 1e-5 * np.eye(len(point))])
        before = errors @ errors
        free = np.ones(len(point), dtype=bool)
        while True:
            step = np.zeros(len(point))
            step[free] = -_solve(slopes[:, free], errors)
            for share in (1.0, 0.5, 0.25, 0.125):
                nearby, within = _inside(point + share * step, orders)
                tried = errors_at(nearby)
                if tried @ tried < before:
                    break
            still = free & within
            if tried @ tried < before or (still == free).all() or not still.any():
                break
            free = still
        if tried @ tried < before:
            point, errors = nearby, tried
            converged = bool(before - errors @ errors < SMALL_GAIN * before)
        else:
            hoped = errors + slopes[:, still] @ step[still]
            converged = bool(before - hoped @ hoped <= SMALL_GAIN * before)
        if converged or errors is not tried:
            break
    levels, shocks = _polynomials(point, orders)
    return Fit(np.convolve(levels, differences), shocks, errors, converged)


def forecast(y: np.ndarray, fit: Fit, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Means and half-widths of the 95 % bounds for the next steps."""
    weights, shocks = -fit.levels[1:], np.r_[fit.shocks, np.zeros(steps)]
    path = np.r_[y, np.zeros(steps)]
    known = np.r_[np.zeros(len(fit.shocks)), fit.errors]
    for h in range(steps):
        t = len(y) + h
        past = path[t - len(weights): t][::-1]
        # The errors of the days known, from the newest on: lags h + 1 and above.
        left = fit.shocks[h + 1:]
        path[t] = weights @ past + left @ known[len(known) - len(left):][::-1]
    psi = np.zeros(steps)
    for h in range(steps):
        k = min(h, len(weights))
        psi[h] = shocks[h] + weights[:k] @ psi[h - k: h][::-1]
    spread = Z95 * np.std(fit.errors[len(fit.shocks) - 1:]) * np.sqrt(np.cumsum(psi**2))
    return path[len(y):], spread
