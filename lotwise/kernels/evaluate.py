"""Outer folds of nested evaluation and causal replays over lots of wafers."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np

from lotwise.kernels import gaussian, linear

FAMILIES = ("ridge", "pls", "gpr")
#: The share of residual variance that components keep, and how many there are at most.
SHARE, MOST = 0.90, 8


def label(parameter) -> str:
    return parameter.label if isinstance(parameter, gaussian.Settings) else f"{parameter:g}"


def of_moments(family: str, parameter, moments: linear.Moments, features: int) -> linear.Affine:
    if family == "ridge":
        return linear.ridge(moments, features, float(parameter))
    if family == "pls":
        return linear.partial_least_squares(moments, features, int(parameter))
    raise ValueError(f"no such model family: {family}")


class LotMoments:
    """The moments of each lot's rows (features, map), and of any set of lots by merging.

    Lots are the leaves of a balanced tree whose nodes are merged once: a set that lacks few lots is a union of few
    nodes. A node has its own lots only, so the moments of a set don't depend on what is outside it.
    """

    def __init__(self, own: dict, features: int):
        self.own, self.features, self.names = own, features, sorted(own)
        self._at = {n: i for i, n in enumerate(self.names)}
        self._node = lru_cache(maxsize=None)(self._merged)
        self.training = lru_cache(maxsize=64)(self._training)

    def _merged(self, lo: int, hi: int) -> linear.Moments:
        if hi - lo == 1:
            return self.own[self.names[lo]]
        mid = (lo + hi) // 2
        return self._node(lo, mid) + self._node(mid, hi)

    def moments(self, names: Sequence) -> linear.Moments:
        wanted = np.zeros(len(self.names) + 1, int)
        wanted[[self._at[n] + 1 for n in names]] = 1
        upto = np.cumsum(wanted)

        def within(lo: int, hi: int) -> linear.Moments | None:
            some = upto[hi] - upto[lo]
            if some in (0, hi - lo):
                return self._node(lo, hi) if some else None
            mid = (lo + hi) // 2
            a, b = within(lo, mid), within(mid, hi)
            return a + b if a and b else a or b

        out = within(0, len(self.names)) if self.names else None
        if out is None:
            raise ValueError("training takes two wafers or more")
        return out

    def _training(self, names: tuple) -> linear.Training:
        return linear.Training(self.moments(names), self.features)

    def only(self, features: np.ndarray) -> LotMoments:
        """The same lots with some of the features."""
        width = len(next(iter(self.own.values())).mean) if self.own else 0
        places = np.concatenate([np.asarray(features, int), np.arange(self.features, width)])
        return LotMoments({n: m.only(places) for n, m in self.own.items()}, len(features))

    def fitted(self, names: tuple, family: str, parameter, components: np.ndarray | None = None) -> linear.Affine:
        """A model of the lots' shifts, or with ``components`` of their residuals' components, by standard features."""
        return of_moments(family, parameter, *self.training(names).explaining(components))


class Wafers(LotMoments):
    """Lots whose wafers are at hand as well."""

    def __init__(self, x: np.ndarray, maps: np.ndarray, lots: np.ndarray):
        self.x, self.maps, self.lots = np.asarray(x, float), np.asarray(maps, float), np.asarray(lots)
        rows = np.column_stack([self.x, self.maps])
        super().__init__({n: linear.Moments.of(rows[self.lots == n]) for n in sorted(set(self.lots.tolist()))}, self.x.shape[1])

    def of(self, *names) -> np.ndarray:
        return np.flatnonzero(np.isin(self.lots, names))

    def fitted(self, names: tuple, family: str, parameter, components: np.ndarray | None = None):
        if family != "gpr":
            return super().fitted(names, family, parameter, components)
        t, rows = self.training(names), self.of(*names)
        return gaussian.fit_process(t.standard(self.x[rows]), (self.maps[rows] - t.template) @ t.targets(components), parameter)


def predict(model, x: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
    got = model.predict(x)
    return got if isinstance(got, tuple) else (got, None)


def errors_within(w: Wafers, names: tuple, family: str, parameters: Sequence, residual: bool, share: float = SHARE, most: int = MOST) -> Iterator[tuple[float, str, object]]:
    """(error, label, parameter): the mean over the lots, each predicted from the others, of the shift's absolute or the residual map's root mean square error."""
    by_lot = []
    for n in names:
        rest = tuple(x for x in names if x != n)
        t, rows = w.training(rest), w.of(n)
        by_lot.append((rest, t, t.standard(w.x[rows]), w.maps[rows], t.components(share, most)[0] if residual else None))
    for parameter in parameters:
        found = []
        for rest, t, x, maps, components in by_lot:
            p, _ = predict(w.fitted(rest, family, parameter, components), x)
            found.append(np.abs(p[:, 0] - t.shift(maps)).mean() if components is None else np.sqrt(((p @ components - t.residual(maps)) ** 2).mean()))
        yield float(np.mean(found)), label(parameter), parameter


def chosen(w: Wafers, names: tuple, family: str, parameters: Sequence, residual: bool, share: float = SHARE, most: int = MOST):
    """(parameter, error) of the least error; of equal ones that whose label comes first."""
    error, _, parameter = min(errors_within(w, names, family, parameters, residual, share, most), key=lambda x: x[:2])
    return parameter, error


@dataclass
class Fold:
    """Predictions of the test wafers by stage, and what was chosen and fitted."""

    stages: dict[str, np.ndarray]
    stds: dict[str, np.ndarray | None]
    facts: dict
    importance: np.ndarray | None = None
    sign: np.ndarray | None = None


def staged(t: linear.Training, components: np.ndarray, maps: np.ndarray, shift: np.ndarray, shift_sd: np.ndarray | None, scores: np.ndarray, score_sd: np.ndarray | None) -> tuple[dict, dict]:
    """(maps, deviations) by stage, from the predicted shifts and scores of test wafers."""
    plain = np.tile(t.template, (len(maps), 1))
    true = plain + t.shift(maps)[:, None]
    stages = {
        "template": plain, "mean_shift": plain + shift[:, :1], "full_map": plain + shift[:, :1] + scores @ components,
        "oracle_zero_residual": true, "oracle_pca_reconstruction": true + t.residual(maps) @ components.T @ components,
    }
    stds: dict[str, np.ndarray | None] = {}
    if shift_sd is not None and score_sd is not None:
        stds = {"mean_shift": np.tile(shift_sd[:, :1], (1, maps.shape[1])), "full_map": np.sqrt(shift_sd[:, :1] ** 2 + score_sd**2 @ components**2)}
    return stages, stds


def run_fold(w: Wafers, train: tuple, test, family: str, parameters: Sequence, share: float = SHARE, most: int = MOST) -> Fold:
    """Everything that is fitted sees the lots ``train`` only."""
    t, rows = w.training(train), w.of(test)
    x, maps = t.standard(w.x[rows]), w.maps[rows]
    by_shift, shift_error = chosen(w, train, family, parameters, False, share, most)
    by_residual, residual_error = chosen(w, train, family, parameters, True, share, most)
    components, explained = t.components(share, most)
    shift, shift_sd = predict(w.fitted(train, family, by_shift), x)
    scores, score_sd = predict(w.fitted(train, family, by_residual, components), x)
    stages, stds = staged(t, components, maps, shift, shift_sd, scores, score_sd)
    facts, importance, sign = fold_facts(w, train, family, by_shift, by_residual, shift_error, residual_error, len(rows), share, most)
    return Fold(stages, stds, facts) if family == "gpr" else Fold(stages, stds, facts, importance, sign)


@dataclass
class Portable:
    """Models of raw features that a group of wafers can apply without the rows or moments they were fitted on.

    ``features``: the places of those that the models take, all if None.
    """

    template: np.ndarray
    components: np.ndarray
    shifts: list[linear.Affine]
    scores: list[linear.Affine]
    features: np.ndarray | None = None

    def _own(self, x: np.ndarray) -> np.ndarray:
        return x if self.features is None else x[:, self.features]

    def errors(self, x: np.ndarray, maps: np.ndarray) -> tuple[list[float], list[float]]:
        """(mean absolute errors of the shift, root mean square errors of the residual map) of each model."""
        x = self._own(x)
        shift = maps.mean(axis=1) - self.template.mean()
        residual = maps - self.template - shift[:, None]
        return [float(np.abs(m.predict(x)[:, 0] - shift).mean()) for m in self.shifts], [float(np.sqrt(((m.predict(x) @ self.components - residual) ** 2).mean())) for m in self.scores]

    def stages(self, x: np.ndarray, maps: np.ndarray) -> dict[str, np.ndarray]:
        x = self._own(x)
        plain = np.tile(self.template, (len(x), 1))
        shift = plain + self.shifts[0].predict(x)[:, :1]
        true = plain + (maps.mean(axis=1) - self.template.mean())[:, None]
        rebuilt = (maps - true) @ self.components.T @ self.components
        return {"template": plain, "mean_shift": shift, "full_map": shift + self.scores[0].predict(x) @ self.components, "oracle_zero_residual": true, "oracle_pca_reconstruction": true + rebuilt}


def _raw(t: linear.Training, model: linear.Affine) -> linear.Affine:
    """The same model for features that are not standard."""
    w = np.zeros((len(t.kept), model.coefficients.shape[1]))
    w[t.kept] = model.coefficients / t.deviation[:, None]
    return linear.Affine(w, model.intercept - t.feature_mean @ w)


def portable(w: LotMoments, names: tuple, family: str, by_shift: Sequence, by_scores: Sequence, share: float = SHARE, most: int = MOST, features: np.ndarray | None = None) -> Portable:
    """All candidates fitted on some lots."""
    t = w.training(names)
    components, _ = t.components(share, most)
    shift, scores = t.explaining(None), t.explaining(components)
    return Portable(t.template, components, [_raw(t, of_moments(family, p, *shift)) for p in by_shift], [_raw(t, of_moments(family, p, *scores)) for p in by_scores], features)


def fold_facts(w: LotMoments, names: tuple, family: str, by_shift, by_residual, shift_error: float, residual_error: float, test_wafers: int, share: float = SHARE, most: int = MOST) -> tuple[dict, np.ndarray, np.ndarray]:
    """(what was chosen and fitted, importance, sign); features left out as constant have no importance."""
    t = w.training(names)
    components, explained = t.components(share, most)
    facts = {
        "training_wafers": t.moments.count, "test_wafers": test_wafers, "retained_features": int(t.kept.sum()), "mean_parameter": label(by_shift), "mean_inner_lot_macro_mae": shift_error,
        "residual_parameter": label(by_residual), "residual_inner_lot_macro_rmse": residual_error, "residual_components": len(components), "residual_explained_variance": explained,
    }
    sign, importance = np.full((2, len(t.kept)), np.nan)
    if family != "gpr":
        model = w.fitted(names, family, by_shift)
        sign[t.kept] = np.sign(model.coefficients[:, 0])
        importance[t.kept] = linear.vip(model) if family == "pls" else np.abs(model.coefficients[:, 0])
    return facts, importance, sign


def run_fused_fold(w: Wafers, spectra: np.ndarray, train: tuple, test, pls: Sequence, candidates: Sequence[tuple[int, float]], share: float = SHARE, most: int = MOST) -> Fold:
    """Spectra predict the shift, process features the residual."""

    def by_spectra(names: tuple, of, some: Sequence[tuple[int, float]]) -> dict[tuple[int, float], np.ndarray]:
        rows = w.of(*names)
        return linear.shrunken(spectra[rows], w.training(names).shift(w.maps[rows]), spectra[w.of(of)], some)

    errors = {c: [] for c in candidates}
    for n in train:
        rest = tuple(x for x in train if x != n)
        true = w.training(rest).shift(w.maps[w.of(n)])
        for c, p in by_spectra(rest, n, candidates).items():
            errors[c].append(np.abs(p - true).mean())
    named = lambda c: f"pca={c[0]},alpha={c[1]:g}"
    best = min(candidates, key=lambda c: (float(np.mean(errors[c])), named(c)))
    t, rows = w.training(train), w.of(test)
    parameter, error = chosen(w, train, "pls", pls, True, share, most)
    components, _ = t.components(share, most)
    plain = np.tile(t.template, (len(rows), 1))
    shifted = plain + by_spectra(train, test, [best])[best][:, None]
    full = shifted + w.fitted(train, "pls", parameter, components).predict(t.standard(w.x[rows])) @ components
    facts = {"spectral_setting": named(best), "spectral_inner_mae": float(np.mean(errors[best])), "residual_parameter": label(parameter), "residual_inner_lot_macro_rmse": error}
    return Fold({"template": plain, "mean_shift": shifted, "full_map": full}, {}, facts)


# Causal replay.


@dataclass(frozen=True)
class Known:
    """What a replay knows before a wafer: moments of standard features with shifts, and with components; the bias; how often it has learnt."""

    shifts: linear.Moments
    scores: linear.Moments
    bias: float = 0.0
    updates: int = 0


class Causal:
    """Models of the lots before a test lot. Scales, template and components stay as they are; feedback changes what is ``Known``."""

    def __init__(self, w: LotMoments, train: tuple, by_shift, by_residual, share: float = SHARE, most: int = MOST):
        self.t = w.training(train)
        self.components, _ = self.t.components(share, most)
        self.by_shift, self.by_residual = by_shift, by_residual
        (shifts, self.features), (scores, _) = self.t.explaining(None), self.t.explaining(self.components)
        self.start = Known(shifts, scores)
        self.targets = self.t.targets(None), self.t.targets(self.components)
        self.fits: dict[str, tuple[linear.Moments, linear.Affine]] = {}

    @classmethod
    def chosen(cls, w: Wafers, train: tuple, parameters: Sequence, share: float = SHARE, most: int = MOST) -> Causal:
        """With the parameters that inner folds of the training lots choose."""
        return cls(w, train, *(chosen(w, train, "pls", parameters, residual, share, most)[0] for residual in (False, True)), share, most)

    def predicted(self, known: Known, x: np.ndarray) -> np.ndarray:
        """Maps of raw features."""
        z = self.t.standard(np.atleast_2d(x))
        shift = self._fit("shift", known.shifts, self.by_shift).predict(z)
        scores = self._fit("scores", known.scores, self.by_residual).predict(z)
        return self.t.template + shift + scores @ self.components

    def _fit(self, kind: str, moments: linear.Moments, parameter) -> linear.Affine:
        """The model of these moments, which is fitted anew only if they are not those of the last time."""
        last = self.fits.get(kind)
        if last is None or last[0] is not moments:
            last = self.fits[kind] = moments, linear.partial_least_squares(moments, self.features, parameter)
        return last[1]

    def taught(self, known: Known, feedback: str, x: np.ndarray, target: np.ndarray, predicted: np.ndarray, alpha: float) -> Known:
        """F0 learns nothing, F1 an additive bias, F2 refits the shift, F3 the shift and the residual."""
        if feedback == "F0":
            return known
        known = replace(known, updates=known.updates + 1)
        if feedback == "F1":
            return replace(known, bias=(1 - alpha) * known.bias + alpha * float((target - predicted).mean()))
        z, apart = self.t.standard(x[None])[0], target - self.t.template
        known = replace(known, shifts=known.shifts + linear.Moments.of([*z, *(apart @ self.targets[0])]))
        return known if feedback == "F2" else replace(known, scores=known.scores + linear.Moments.of([*z, *(apart @ self.targets[1])]))


def replay(model: Causal, x: np.ndarray, targets: np.ndarray, measured: np.ndarray, feedback: str, alpha: float = 0.3) -> tuple[np.ndarray, np.ndarray, int]:
    """(predictions, system errors, updates) of wafers in order; what a measured wafer teaches holds from the next one on."""
    if feedback not in ("F0", "F1", "F2", "F3"):
        raise ValueError(f"no such feedback: {feedback}")
    known, out = model.start, []
    learns = np.asarray(measured, bool) & (feedback in ("F2", "F3"))
    # Between two refits nothing but the bias changes: the wafers up to the next one are predicted together.
    at = np.concatenate(([0], np.flatnonzero(learns) + 1, [len(x)]))
    for lo, hi in zip(at[:-1], at[1:]):
        plain = model.predicted(known, x[lo:hi]) if hi > lo else np.zeros((0, targets.shape[1]))
        for i, p in enumerate(plain, lo):
            out.append(p + known.bias)
            if measured[i]:
                known = model.taught(known, feedback, x[i], targets[i], p, alpha)
    predictions = np.array(out).reshape(len(x), -1)
    return predictions, np.where(measured, 0.0, np.abs(predictions - targets).mean(axis=1)), known.updates
