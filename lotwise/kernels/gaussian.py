"""Gaussian-process regression over whitened principal components (L3): constant times squared-exponential, plus noise."""

from __future__ import annotations

from collections.abc import Generator
from dataclasses import dataclass
from itertools import product

import numpy as np

from lotwise.kernels.linear import Training, principal_components

#: Bounds of constant, length scale and noise where they are fitted.
BOUNDS = ((1e-3, 1e3), (1e-2, 1e3), (1e-5, 10.0))


@dataclass(frozen=True)
class Settings:
    components: int = 4
    length_scale: float = 1.0
    noise: float = 0.1
    optimize: bool = False

    @property
    def label(self) -> str:
        return f"pca={self.components},length={self.length_scale:g},noise={self.noise:g}" + (",optimized" if self.optimize else "")


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a**2).sum(1)[:, None] + (b**2).sum(1)[None] - 2 * a @ b.T, 0)


@dataclass(frozen=True)
class Process:
    mean: np.ndarray
    axes: np.ndarray
    theta: tuple[float, float, float]
    inputs: np.ndarray
    chol: np.ndarray
    weights: np.ndarray
    y_mean: np.ndarray
    y_scale: np.ndarray

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(means, standard deviations with noise), rows by outputs."""
        c, length, noise = self.theta
        k = c * np.exp(-_squares((np.atleast_2d(x) - self.mean) @ self.axes, self.inputs) / (2 * length**2))
        v = np.linalg.solve(self.chol, k.T)
        sd = np.sqrt(np.maximum(c + noise - (v**2).sum(axis=0), 0))
        return k @ self.weights * self.y_scale + self.y_mean, sd[:, None] * self.y_scale


def _solved(d: np.ndarray, y: np.ndarray, length: float, ratio: float) -> tuple[float, float] | None:
    """(squares of the solved outputs, logarithms of the factor's diagonal) of the matrix whose constant is 1 and whose noise is ``ratio``; None if it has no factor."""
    n, q = y.shape
    # The outputs' rows follow the matrix, so that one factorisation solves them: theirs is left of the last rows.
    k = np.zeros((n + q, n + q))
    np.multiply(d, -0.5 / length**2, out=k[:n, :n])
    np.exp(k[:n, :n], out=k[:n, :n])
    k[np.diag_indices(n)] += ratio + 1e-10
    k[n:, :n] = y.T
    k[n:, n:] = np.eye(q) * (2 * (y**2).sum() / ratio + 1)
    try:
        chol = np.linalg.cholesky(k)
    except np.linalg.LinAlgError:
        return None
    return float((chol[n:, :n] ** 2).sum()), float(np.log(np.diag(chol)[:n]).sum())


def profile(squares: float, logs: float, n: int, outputs: int, ratio: float) -> tuple[float, float]:
    """(log marginal likelihood, constant) at the best constant that the bounds leave for a ratio of noise to it, by what ``_solved`` gives."""
    (low, high), _, (least, most) = BOUNDS
    c = float(np.clip(squares / (n * outputs), max(low, least / ratio), min(high, most / ratio)))
    found = -0.5 * squares / c - outputs * (logs + 0.5 * n * np.log(2 * np.pi * c))
    return (float(found), c) if np.isfinite(found) else (-np.inf, c)


#: Offsets of the points by which a quadratic of two numbers is known, and the terms of one.
_OFFSETS = np.array([(0, 0), (1, 0), (-1, 0), (0, 1), (0, -1), (1, 1)], float)
_TERMS = np.array([[1, u, v, u * u / 2, u * v, v * v / 2] for u, v in _OFFSETS])
#: Rounds of an ascent at most; the step and the relative gain at which it ends; how many steps a centre moves at most.
ROUNDS, LEAST_STEP, LEAST_GAIN, REACH = 60, 1e-3, 1e-7, 3


def _peak(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Where in a box the quadratic through the values at ``_OFFSETS`` is largest: each side of the box is held or not."""
    _, *g, a, b, c = np.linalg.solve(_TERMS, values)
    g, h, found = np.array(g), np.array([[a, b], [b, c]]), []
    for held in product((None, 0, 1), repeat=2):
        u = np.array([0.0 if side is None else (low, high)[side][i] for i, side in enumerate(held)])
        free = [i for i, side in enumerate(held) if side is None]
        if free:
            own = h[np.ix_(free, free)]
            if np.linalg.eigvalsh(own).max() >= 0:
                continue
            u[free] = np.linalg.solve(own, -(g + h @ u)[free])
            if (u < low).any() or (u > high).any():
                continue
        found.append((float(g @ u + 0.5 * u @ h @ u), tuple(u)))
    return np.array(max(found)[1])


def ascent(settings: Settings) -> Generator[list[tuple[float, float]], list[tuple[float, float]], tuple[float, float, float]]:
    """Climbs the likelihood within the bounds: yields points (length, ratio), is sent their ``profile``, returns (constant, length, noise).

    A round asks for six points or more about a centre, whose quadratic in the logarithms tells the next centre. So the
    points of a round can be found side by side, whatever finds them.
    """
    (c_low, c_high), lengths, (n_low, n_high) = BOUNDS
    low, high = np.log([lengths[0], n_low / c_high]), np.log([lengths[1], n_high / c_low])
    centre = at = np.clip(np.log([settings.length_scale, settings.noise]), low, high)
    step, best, constant = 0.5, -np.inf, 1.0
    for _ in range(ROUNDS):
        inside = np.clip(centre, low + step, high - step)  # the six points differ at the bounds as well
        some = [inside + step * u for u in _OFFSETS]
        if (inside != centre).any():
            some += [np.clip(centre + step * u, low, high) for u in _OFFSETS[:5]]
        told = yield [tuple(np.exp(p).tolist()) for p in some]
        values = np.array([v for v, _ in told])
        top = int(np.argmax(values))
        gains = bool(values[top] > best + LEAST_GAIN * max(1.0, abs(best))) if np.isfinite(best) else bool(np.isfinite(values[top]))
        if values[top] > best:
            best, at, constant = values[top], some[top], told[top][1]
        if not gains and step <= LEAST_STEP:
            break
        own = values[: len(_OFFSETS)]
        if not gains or not np.isfinite(own).all():
            centre, step = at, max(step / 4, LEAST_STEP)
            continue
        u = _peak(own, (np.maximum(low, at - REACH * step) - inside) / step, (np.minimum(high, at + REACH * step) - inside) / step)
        centre = inside + step * u
        apart = np.abs(centre - at).max()
        step = min(1.0, 2 * step) if apart > 0.99 * REACH * step else max(LEAST_STEP, step / 4, min(step, apart))
    length, ratio = np.exp(at)
    return constant, float(length), float(constant * ratio)


def _fitted(d: np.ndarray, y: np.ndarray, settings: Settings) -> tuple[float, float, float]:
    climb = ascent(settings)
    try:
        some = next(climb)
        while True:
            solved = [(_solved(d, y, *p), p[1]) for p in some]
            some = climb.send([profile(*x, *y.shape, ratio) if x else (-np.inf, 1.0) for x, ratio in solved])
    except StopIteration as found:
        return found.value


def _likelihood(d: np.ndarray, y: np.ndarray, theta: np.ndarray) -> float:
    """By logarithms of constant, length and noise."""
    c, length, noise = np.exp(theta)
    if (solved := _solved(d, y, length, noise / c)) is None:
        return -np.inf
    return float(-0.5 * solved[0] / c - y.shape[1] * (solved[1] + 0.5 * len(d) * np.log(2 * np.pi * c)))


def _climb(d: np.ndarray, y: np.ndarray, theta: np.ndarray) -> np.ndarray:
    """The logarithms that ``ascent`` finds from those given."""
    c, length, noise = np.exp(theta)
    return np.log(_fitted(d, y, Settings(1, length, noise / c, True)))


def fit_process(x: np.ndarray, y: np.ndarray, settings: Settings) -> Process:
    y = np.asarray(y, float)
    y = y[:, None] if y.ndim == 1 else y
    count = max(1, min(settings.components, x.shape[1], len(x) - 1))
    mean, axes, variance = principal_components(x, count)
    axes = axes.T / np.sqrt(np.maximum(variance[:count], 1e-300))
    z = (x - mean) @ axes
    y_mean, y_scale = y.mean(axis=0), y.std(axis=0)
    y_scale = np.where(y_scale > 0, y_scale, 1.0)
    t = (y - y_mean) / y_scale
    d = _squares(z, z)
    c, length, noise = _fitted(d, t, settings) if settings.optimize else (1.0, settings.length_scale, settings.noise)
    chol = np.linalg.cholesky(c * np.exp(-d / (2 * length**2)) + (noise + 1e-10) * np.eye(len(d)))
    return Process(mean, axes, (c, length, noise), z, chol, np.linalg.solve(chol.T, np.linalg.solve(chol, t)), y_mean, y_scale)


@dataclass(frozen=True)
class Plan:
    """A process of lots known by their moments alone: what its wafers' entries of the matrix take. ``targets`` turns maps into outputs."""

    training: Training
    axes: np.ndarray
    theta: tuple[float, float, float]
    targets: np.ndarray
    y_scale: np.ndarray

    def inputs(self, x: np.ndarray) -> np.ndarray:
        return self.training.standard(x) @ self.axes

    def outputs(self, maps: np.ndarray) -> np.ndarray:
        return (maps - self.training.template) @ self.targets / self.y_scale

    def kernel(self, x: np.ndarray, other: np.ndarray, same: bool = False) -> np.ndarray:
        """The matrix of two groups of wafers, with the noise if they are the ``same``."""
        c, length, noise = self.theta
        k = _squares(self.inputs(x), self.inputs(other))
        k /= -2 * length**2
        np.exp(k, out=k)
        k *= c
        if same:
            k[np.diag_indices(len(k))] += noise + 1e-10
        return k

    def deviations(self, explained: np.ndarray) -> np.ndarray:
        """Standard deviations with noise, rows by outputs, of wafers whose variance the training wafers explain to ``explained``."""
        c, _, noise = self.theta
        return np.sqrt(np.maximum(c + noise - explained, 0))[:, None] * self.y_scale


def plan(t: Training, settings: Settings, targets: np.ndarray) -> Plan:
    """The process that ``fit_process`` fits, parameters as they are set; means of standard features and of outputs are 0 in training."""
    p, n = t.features, t.moments.count
    values, axes = np.linalg.eigh(t.moments.centred[:p, :p][np.ix_(t.kept, t.kept)] / np.outer(t.deviation, t.deviation))
    count = max(1, min(settings.components, len(values), n - 1))
    axes = axes[:, ::-1][:, :count] / np.sqrt(np.maximum(values[::-1][:count] / max(n - 1, 1), 1e-300))
    scale = np.sqrt(np.maximum(np.diag(targets.T @ t.moments.centred[p:, p:] @ targets) / n, 0))
    return Plan(t, axes, (1.0, settings.length_scale, settings.noise), targets, np.where(scale > 0, scale, 1.0))
