"""Filter weights, computed once on the driver and inlined as literals."""

from __future__ import annotations

import math

import numpy as np


def odd(window: int) -> int:
    if window < 1:
        raise ValueError("window must be at least 1")
    return window if window % 2 else window + 1


def gaussian(window: int, sd: float | None = None) -> list[float]:
    """Weights of offsets -half to half, normalised; sd None: a quarter of the window."""
    window = odd(window)
    sd = window / 4 if sd is None else sd
    if sd <= 0:
        raise ValueError("sd must be positive")
    raw = [math.exp(-0.5 * (k / sd) ** 2) for k in range(-(window // 2), window // 2 + 1)]
    return [r / sum(raw) for r in raw]


def savgol(window: int, polyorder: int, deriv: int = 0, delta: float = 1.0) -> list[list[float]]:
    """Row p: the weights that give the window's least-squares polynomial (or a derivative) at position p."""
    window = odd(window)
    if window < 3 or polyorder >= window:
        raise ValueError("savgol needs window >= 3 and polyorder < window")
    rows = []
    for p in range(window):
        powers = np.vander(np.arange(window, dtype=float) - p, polyorder + 1, increasing=True)
        rows.append((np.linalg.pinv(powers)[deriv] * math.factorial(deriv) / delta**deriv if deriv <= polyorder else np.zeros(window)).tolist())
    return rows
