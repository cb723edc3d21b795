"""Limited-memory quasi-Newton steps that wait for their evaluations, so that many fits can share a pass over the rows."""

from __future__ import annotations

import numpy as np

MEMORY = 8
SLOPE_SHARE = 1e-4
NOISE = 1e-13


class Minimiser:
    """Asks for the value and gradient at `trial` and takes them by `feed`, until `done`.

    The function must be smooth and convex. Done means that no entry of the
    gradient is above `tolerance`, or that `most` evaluations were not enough.
    """

    def __init__(self, start: np.ndarray, tolerance: float = 1e-7, most: int = 300):
        self.tolerance, self.most = tolerance, most
        self.x = self.trial = np.array(start, float)
        self.value, self.gradient = None, np.zeros_like(self.x)
        self.direction, self.length = np.zeros_like(self.x), 0.0
        self.moved: list[np.ndarray] = []
        self.bent: list[np.ndarray] = []
        self.evaluations, self.done = 0, False

    @property
    def worst(self) -> float:
        return float(np.abs(self.gradient).max(initial=0.0))

    def feed(self, value: float, gradient: np.ndarray) -> None:
        self.evaluations += 1
        if self.value is not None:
            slope = float(self.gradient @ self.direction)
            limit = self.value + SLOPE_SHARE * self.length * slope + NOISE * (1 + abs(self.value))
            if not value <= limit and self.length > 1e-12:
                # The parabola through what is known, within a tenth and a half of the step.
                bend = value - self.value - self.length * slope
                best = -slope * self.length**2 / (2 * bend) if np.isfinite(bend) and bend > 0 else 0.0
                self._try(min(max(best, 0.1 * self.length), 0.5 * self.length))
                self.done = self.evaluations >= self.most
                return
            moved, bent = self.trial - self.x, gradient - self.gradient
            if moved @ bent > 1e-12 * (bent @ bent):
                self.moved, self.bent = [*self.moved, moved][-MEMORY:], [*self.bent, bent][-MEMORY:]
        self.x, self.value, self.gradient = self.trial, value, gradient
        if self.worst <= self.tolerance or self.evaluations >= self.most:
            self.done = True
            return
        self.direction = -self._turned(gradient)
        if self.direction @ gradient >= 0:
            self.moved, self.bent, self.direction = [], [], -gradient
        self._try(1.0 if self.moved else min(1.0, 1 / np.linalg.norm(gradient)))

    def _try(self, length: float) -> None:
        self.length = length
        self.trial = self.x + length * self.direction

    def _turned(self, gradient: np.ndarray) -> np.ndarray:
        """The inverse curvature that the last moves tell, times the gradient."""
        q, shares = gradient.copy(), []
        for s, y in zip(reversed(self.moved), reversed(self.bent)):
            share = (s @ q) / (s @ y)
            shares.append(share)
            q -= share * y
        if self.moved:
            s, y = self.moved[-1], self.bent[-1]
            q *= (s @ y) / (y @ y)
        for s, y, share in zip(self.moved, self.bent, reversed(shares)):
            q += s * (share - (y @ q) / (s @ y))
        return q

    def dumps(self) -> bytes:
        head = np.array([
            self.tolerance, self.most, np.nan if self.value is None else self.value,
            self.length, self.evaluations, self.done, len(self.moved), len(self.x),
        ])
        return np.concatenate([head, self.x, self.trial, self.gradient, self.direction, *self.moved, *self.bent]).tobytes()

    @classmethod
    def loads(cls, blob: bytes) -> Minimiser:
        flat = np.frombuffer(blob)
        tolerance, most, value, length, evaluations, done, kept, width = flat[:8].tolist()
        made = cls(np.zeros(int(width)), tolerance, int(most))
        vectors = list(flat[8:].reshape(-1, int(width)) if width else np.zeros((4 + 2 * int(kept), 0)))
        made.x, made.trial, made.gradient, made.direction = vectors[:4]
        made.moved, made.bent = vectors[4 : 4 + int(kept)], vectors[4 + int(kept) :]
        made.value = None if np.isnan(value) else value
        made.length, made.evaluations, made.done = length, int(evaluations), bool(done)
        return made
