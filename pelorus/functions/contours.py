"""Closed contours as arrays of points: Fourier transforms, curvature, bending energy, ellipse fits; and draws around a covariance.

Each function is numpy on one contour; ``over`` lifts it to a column of arrays in Arrow batches. Contours are bounded by
the outline of one source.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the scales of the bending energy
SCALES = (1e-7, 5e-7, 1e-6, 5e-6, 1e-5, 5e-5, 1e-4, 5e-4, 1e-3, 5e-3, 1e-2, 5e-2, 0.1, 0.5, 1.0, 2.0, 5.0, 10.0)


def dft(z: np.ndarray, n: int = -1) -> np.ndarray:
    """The first ``n`` coefficients (all, if n is negative or too large) of the discrete Fourier transform, unscaled."""
    return np.fft.fft(z)[: n if 0 <= n <= len(z) else None]


def idft(z: np.ndarray, n: int = -1) -> np.ndarray:
    """The first ``n`` values of the inverse transform, divided by the length."""
    return np.fft.ifft(z)[: n if 0 <= n <= len(z) else None]


def dft_shifted(z: np.ndarray, n: int = -1) -> np.ndarray:
    """Coefficients from the frequency -floor(N / 2) upwards, divided by the length."""
    size = len(z)
    f = np.fft.fft(z) / max(size, 1)
    return f[(np.arange(size) - size // 2) % max(size, 1)][: n if 0 <= n <= size else None]


def _frequencies(n: int, compat: bool) -> np.ndarray:
    s = np.arange(n)
    upper = s > n - 1 - n // 2
    return np.where(upper, (n - s) if compat else (s - n), s).astype(float)


def curvature(z: np.ndarray, sigma: float, compat: bool = False) -> np.ndarray:
    """Curvature of a contour of complex points after Gaussian smoothing, on the scale of the unsmoothed perimeter.

    The Fourier derivative takes signed frequencies; compat: their moduli. A contour of fewer than three points has none.
    """
    n = len(z)
    if n < 3:
        return np.zeros(n)
    eta = _frequencies(n, compat)
    u, smooth = np.fft.fft(z), np.exp(-((sigma * eta) ** 2))
    first = np.fft.ifft(2j * math.pi * eta * u)
    first_s, second_s = np.fft.ifft(2j * math.pi * eta * u * smooth), np.fft.ifft(-((2 * math.pi * eta) ** 2) * u * smooth)
    length, length_s = np.abs(first).sum(), np.abs(first_s).sum()
    if not length or not length_s:
        return np.zeros(n)
    scale = length / length_s
    with np.errstate(divide="ignore", invalid="ignore"):
        out = -np.imag(first_s * np.conj(second_s)) / np.abs(first_s) ** 3 / scale
    return np.where(np.isfinite(out), out, 0.0)


def bending_energy(z: np.ndarray, scales: tuple[float, ...] = SCALES, compat: bool = False) -> np.ndarray:
    """Mean squared curvature times the squared perimeter, at every scale."""
    z = np.asarray(z, complex)
    n = len(z)
    if n < 3:
        return np.zeros(len(scales))
    z = z - z.mean()
    eta = np.arange(n) - n // 2 if compat else _frequencies(n, False)
    length = np.abs(np.fft.ifft(2j * math.pi * eta * np.fft.fft(z))).sum() * 2 * math.pi / n
    return np.array([(curvature(z, s, compat) ** 2).sum() * length**2 / n for s in scales])


def centroid_distances(z: np.ndarray) -> np.ndarray:
    """Moduli of the Fourier descriptors of the distance to the centroid, divided by that of the first frequency."""
    if len(z) < 2:
        return np.zeros(len(z))
    f = np.abs(np.fft.fft(np.abs(z - z.mean()))) / len(z)
    return f / f[1] if f[1] else np.zeros(len(z))


def fitted_conic(x: np.ndarray, y: np.ndarray) -> np.ndarray | None:
    """a, b, c, d, e, f of a x² + b xy + c y² + d x + e y + f = 0: the ellipse of least algebraic distance, or None."""
    if len(x) < 5:
        return None
    mx, my = x.mean(), y.mean()
    size = max(np.abs(x - mx).max(), np.abs(y - my).max()) or 1.0
    u, v = (x - mx) / size, (y - my) / size
    quadratic, linear = np.stack([u * u, u * v, v * v], 1), np.stack([u, v, np.ones_like(u)], 1)
    s1, s2, s3 = quadratic.T @ quadratic, quadratic.T @ linear, linear.T @ linear
    try:
        back = -np.linalg.solve(s3, s2.T)
    except np.linalg.LinAlgError:
        return None
    reduced = s1 + s2 @ back
    # the constraint 4ac - b² = 1, inverted
    values, vectors = np.linalg.eig(np.array([reduced[2] / 2, -reduced[1], reduced[0] / 2]))
    held = 4 * vectors[0].real * vectors[2].real - vectors[1].real ** 2
    good = np.flatnonzero((held > 1e-12) & (np.abs(values.imag) < 1e-9))
    if not len(good):
        return None
    p = vectors[:, good[np.argmin(np.abs(values.real[good]))]].real
    a, b, c, d, e, f = np.concatenate([p, back @ p])
    # back from centred and scaled coordinates
    a, b, c, d, e = a / size**2, b / size**2, c / size**2, d / size, e / size
    return np.array([a, b, c, d - 2 * a * mx - b * my, e - 2 * c * my - b * mx, f + a * mx * mx + b * mx * my + c * my * my - d * mx - e * my])


def conic_ellipse(conic: np.ndarray | None) -> tuple[float, float, float, float, float] | None:
    """(x, y, major and minor semi-axis, angle of the major axis in degrees from the x axis, in [0, 180)) of a conic, or None if it is no ellipse."""
    if conic is None:
        return None
    a, b, c, d, e, f = conic
    form = np.array([[a, b / 2], [b / 2, c]])
    det = np.linalg.det(form)
    if det <= 0:
        return None
    centre = -np.linalg.solve(form, np.array([d, e]) / 2)
    value = f + centre @ np.array([d, e]) / 2
    scale, axes = np.linalg.eigh(form)
    squares = -value / scale
    if (squares <= 0).any():
        return None
    semi = np.sqrt(squares)
    k = int(np.argmax(semi))
    return float(centre[0]), float(centre[1]), float(semi[k]), float(semi[1 - k]), float(math.degrees(math.atan2(axes[1, k], axes[0, k])) % 180.0)


ELLIPSE = "struct<x:double,y:double,r1:double,r2:double,theta:double>"


def over(points: Column, f: Callable[[np.ndarray], np.ndarray]) -> Column:
    """An array of doubles for each contour (array of struct x, y): ``f`` of its complex points; null for a null contour."""
    @F.pandas_udf("array<double>")
    def run(batch: pd.Series) -> pd.Series:
        out = []
        for contour in batch:
            if contour is None:
                out.append(None)
                continue
            z = np.array([complex(p["x"], p["y"]) for p in contour], complex)
            out.append([float(v) for v in f(z)])
        return pd.Series(out, dtype=object)

    return run(points)


def fit_ellipse(points: Column) -> Column:
    """The ellipse fitted to a contour; null for fewer than five points or if no ellipse fits."""
    @F.pandas_udf(ELLIPSE)
    def run(batch: pd.Series) -> pd.DataFrame:
        rows = []
        for contour in batch:
            pts = np.array([(p["x"], p["y"]) for p in contour], float).reshape(-1, 2) if contour is not None else np.zeros((0, 2))
            rows.append(conic_ellipse(fitted_conic(pts[:, 0], pts[:, 1])) or (None,) * 5)
        return pd.DataFrame(rows, columns=["x", "y", "r1", "r2", "theta"], dtype=float)

    fitted = run(points)
    return F.when(fitted["x"].isNotNull(), fitted)


def mahalanobis(diff: Column, sigma: Column) -> Column:
    """sqrt(dᵀ Σ⁻¹ d) of an array and a covariance given as an array of rows; null for a singular covariance or sizes that differ."""
    @F.pandas_udf("double")
    def run(d: pd.Series, s: pd.Series) -> pd.Series:
        out = []
        for x, m in zip(d, s):
            try:
                x, m = np.asarray(x, float), np.array([np.asarray(row, float) for row in m])
                out.append(float(np.sqrt(x @ np.linalg.solve(m, x))))
            except (np.linalg.LinAlgError, ValueError, TypeError):
                out.append(None)
        return pd.Series(out, dtype=float)

    return run(diff, sigma)


def draws(mean: Column, sigma: Column, n: int, key: Column) -> Column:
    """``n`` draws (array of arrays) of a Gaussian around ``mean`` with covariance ``sigma`` (array of rows); the same for the same key."""
    @F.pandas_udf("array<array<double>>")
    def run(m: pd.Series, s: pd.Series, k: pd.Series) -> pd.Series:
        out = []
        for x, c, seed in zip(m, s, k):
            if x is None or c is None:
                out.append(None)
                continue
            chance = np.random.default_rng(int(seed) & 0xFFFFFFFFFFFF)
            got = chance.multivariate_normal(np.asarray(x, float), np.array([np.asarray(r, float) for r in c]), n, check_valid="ignore")
            out.append([[float(v) for v in row] for row in got])
        return pd.Series(out, dtype=object)

    return run(mean, sigma, F.xxhash64(key))
