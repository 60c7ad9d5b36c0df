"""Tuning source scales and discounts on held-out text: the parameters, and BFGS with a strong-Wolfe line search."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

START = (0.8, 0.4, 0.2, 0.1)


def initial(names: list[str], order: int, weights: dict[str, float] | None = None) -> dict[str, float]:
    """Scales of 0.5, or by unigram weights, all different, and the usual discounts."""
    raw = np.array([weights[n] if weights else 0.5 for n in names], float)
    taken: list[float] = []
    for k, x in enumerate(raw):
        while any(abs(x - y) < 0.01 for y in taken):
            x += 0.01
        raw[k] = x
        taken.append(x)
    if len(names) > 1 or weights:
        raw += max(0.0, 0.01 - raw.min())
        raw /= raw.min() + raw.max()
    return {f"scale_{n}": float(x) for n, x in zip(names, raw)} | {f"order{o}_D{k + 1}": START[k] for o in range(2, order + 1) for k in range(4)}


def problems(params: dict[str, float], order: int) -> list[str]:
    """What is wrong with a set of parameters: scales in (0, 1), discounts falling from below 1 to above 0."""
    bad = [f"{k} is {v}" for k, v in params.items() if k.startswith("scale_") and not 0 < v < 1]
    for o in range(2, order + 1):
        d = [1.0, *(params.get(f"order{o}_D{k}", float("nan")) for k in (1, 2, 3, 4)), 0.0]
        bad += [f"discounts of order {o} don't fall: {d[1:-1]}"] * (not all(a > b for a, b in zip(d, d[1:])))
    return bad


def split(params: dict[str, float], order: int) -> tuple[dict[str, float], dict[int, list[float]]]:
    scales = {k.removeprefix("scale_"): v for k, v in params.items() if k.startswith("scale_")}
    return scales, {o: [params[f"order{o}_D{k}"] for k in (1, 2, 3, 4)] for o in range(2, order + 1)}


def _logit(p: float) -> float:
    return float(np.clip(np.log(p / (1 - p)), -100, 100)) if 0 < p < 1 else (-100.0 if p <= 0 else 100.0)


def to_free(params: dict[str, float], order: int) -> tuple[list[str], np.ndarray]:
    """Unbounded variables: logits of scales, and of each discount's ratio to the one before."""
    names, x = [k for k in params if k.startswith("scale_")], []
    x = [_logit(params[k]) for k in names]
    for o in range(2, order + 1):
        before = 1.0
        for k in (1, 2, 3, 4):
            names.append(f"order{o}_D{k}")
            x.append(_logit(params[names[-1]] / before))
            before = params[names[-1]]
    return names, np.array(x)


def from_free(names: list[str], x: np.ndarray) -> dict[str, float]:
    s = 1 / (1 + np.exp(-x))
    out, before = {}, 1.0
    for n, v in zip(names, s):
        if n.startswith("order"):
            before = float(v) if n.endswith("_D1") else before * float(v)
            out[n] = before
        else:
            out[n] = float(v)
    return {k: min(max(v, 1e-10), 1 - 1e-10) for k, v in out.items()}


def free_gradient(names: list[str], x: np.ndarray, grad: dict[str, float]) -> np.ndarray:
    s, params = 1 / (1 + np.exp(-x)), from_free(names, x)
    out = np.empty(len(names))
    for k, n in enumerate(names):
        if n.startswith("order"):
            o, place = n.split("_D")
            # a ratio moves its own discount and all later ones of its order
            out[k] = sum(grad[f"{o}_D{j}"] * params[f"{o}_D{j}"] for j in range(int(place), 5)) * (1 - s[k])
        else:
            out[k] = grad[n] * s[k] * (1 - s[k])
    return out


class Bfgs:
    """Minimises ``f`` (value and gradient): quasi-Newton steps, line searches under the strong Wolfe conditions.

    Ends when the gradient's norm is under ``gradient_tolerance``, or three iterations gain less than ``progress_tolerance`` together. ``inverse`` is
    the inverse Hessian, kept for warm starts.
    """

    def __init__(self, f: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, inverse: np.ndarray | None = None, gradient_tolerance: float = 1.25e-4,
                 progress_tolerance: float = 1e-6, most: int = 60, c1: float = 1e-4, c2: float = 0.9):
        self.f, self.x, self.c1, self.c2 = f, np.array(x, float), c1, c2
        self.known: dict[bytes, tuple[float, np.ndarray]] = {}
        self.inverse = np.eye(len(x)) if inverse is None else inverse.copy()
        value, grad = self.at(self.x)
        self.values, restarts = [value], 0
        for _ in range(most):
            if np.linalg.norm(grad) < gradient_tolerance or (len(self.values) > 3 and self.values[-4] - self.values[-1] < progress_tolerance):
                break
            p = -self.inverse @ grad
            step = self.search(p, value, grad) if p @ grad < 0 else None
            if step is None:
                restarts += 1
                if restarts > 2:
                    break
                self.inverse = np.eye(len(self.x)) / max(1.0, float(np.linalg.norm(grad)))
                continue
            new = self.x + step * p
            new_value, new_grad = self.at(new)
            s, y = new - self.x, new_grad - grad
            if s @ y > 1e-12:
                if len(self.values) == 1 and inverse is None:
                    self.inverse = np.eye(len(s)) * (s @ y) / (y @ y)
                left = np.eye(len(s)) - np.outer(s, y) / (s @ y)
                self.inverse = left @ self.inverse @ left.T + np.outer(s, s) / (s @ y)
            self.x, value, grad = new, new_value, new_grad
            self.values.append(value)

    def at(self, x: np.ndarray) -> tuple[float, np.ndarray]:
        key = x.tobytes()
        if key not in self.known:
            self.known[key] = self.f(x)
        return self.known[key]

    def search(self, p: np.ndarray, value: float, grad: np.ndarray) -> float | None:
        slope = float(grad @ p)
        last, last_value, step = 0.0, value, 1.0
        for k in range(12):
            v, g = self.at(self.x + step * p)
            if not np.isfinite(v) or v > value + self.c1 * step * slope or (k and v >= last_value):
                return self.zoom(p, value, slope, last, step)
            if abs(float(g @ p)) <= -self.c2 * slope:
                return step
            if float(g @ p) >= 0:
                return self.zoom(p, value, slope, step, last)
            last, last_value = step, v
            step *= 2 if k < 2 else 4
        return last or None

    def zoom(self, p: np.ndarray, value: float, slope: float, low: float, high: float) -> float | None:
        low_value = self.at(self.x + low * p)[0]
        for _ in range(12):
            step = low + (high - low) / 3
            v, g = self.at(self.x + step * p)
            if not np.isfinite(v) or v > value + self.c1 * step * slope or v >= low_value:
                high = step
                continue
            if abs(float(g @ p)) <= -self.c2 * slope:
                return step
            if float(g @ p) * (high - low) >= 0:
                high = low
            low, low_value = step, v
        return low or None


class SizeModel:
    """Thresholds that prune a model to a number of n-grams: how its size falls with the threshold is learned on the way."""

    def __init__(self, unigrams: int, target: int, threshold: float = 0.25):
        self.unigrams, self.target, self.threshold = unigrams, max(1, target - unigrams), threshold
        self.backtracked = False
        self.previous_power, self.threshold_power = 0.5, -1.0
        self.sizes: list[float] = []
        self.thresholds: list[float] = []

    def record(self, ngrams: int, threshold: float | None) -> None:
        self.sizes.append(max(1.0, float(ngrams - self.unigrams)))
        if threshold is not None:
            self.thresholds.append(threshold)

    def reached(self, tolerance: float = 0.05) -> bool:
        goal = self.target + self.unigrams
        return abs(self.sizes[-1] + self.unigrams - goal) <= tolerance * goal

    def overshot(self, tolerance: float = 0.05) -> bool:
        goal = self.target + self.unigrams
        return self.sizes[-1] + self.unigrams < (1 - tolerance) * goal

    def back(self) -> None:
        """The last step overshot: forget it, and expect thresholds to do more."""
        self.sizes.pop()
        self.thresholds.pop()
        self.previous_power = min(1.0, self.previous_power * 1.2)
        self.threshold_power = max(-2.0, self.threshold_power * 1.2)

    def predicted(self, threshold: float) -> float:
        x, before = self.sizes[-1], self.sizes[-2] if len(self.sizes) > 1 else self.sizes[-1]
        return x * (x / before) ** self.previous_power * (threshold / self.thresholds[-1]) ** self.threshold_power

    def goal(self) -> float:
        x, t = self.sizes[-1], self.target
        return x * max(0.25, (t / x) ** 0.5) if x > 1.5 * t else x * (t / x) ** 0.666 if x > 1.15 * t else t

    def next(self) -> float:
        """The threshold for the next step, between the last one and four times that."""
        if not self.thresholds:
            return self.threshold
        low, high, goal = self.thresholds[-1], 4 * self.thresholds[-1], self.goal()
        if self.predicted(low) <= goal:
            return low
        while high - low > 1e-4 * self.thresholds[-1]:
            mid = (low + high) / 2
            low, high = (mid, high) if self.predicted(mid) > goal else (low, mid)
        return high
