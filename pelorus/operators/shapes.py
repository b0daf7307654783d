"""Shapes of blobs and overlaps of outlines: one bounded group (a blob, a pair of outlines) at a time."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def outline(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The convex outline of pixels, anticlockwise."""
    pts = np.unique(np.stack([x, y], 1), axis=0)
    if len(pts) < 3:
        return pts

    def half(p: list) -> list:
        out: list = []
        for q in p:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-1][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-1][0]) <= 0:
                out.pop()
            out.append(q)
        return out

    low = pts.tolist()
    return np.array(half(low)[:-1] + half(low[::-1])[:-1])


def area(poly: np.ndarray) -> float:
    if len(poly) < 3:
        return 0.0
    x, y = poly[:, 0], poly[:, 1]
    return float(abs(x @ np.roll(y, -1) - y @ np.roll(x, -1)) / 2)


def clip(subject: np.ndarray, by: np.ndarray) -> np.ndarray:
    """The part of a polygon inside a convex anticlockwise one, cut side by side."""
    out, sides = subject.tolist(), by.tolist()
    for (ax, ay), (bx, by_) in zip(sides, sides[1:] + sides[:1]):
        ux, uy = bx - ax, by_ - ay
        left = [ux * (y - ay) - uy * (x - ax) for x, y in out]
        if min(left) >= 0:
            continue
        kept: list = []
        for k, (p, d) in enumerate(zip(out, left)):
            q, e = out[k + 1 - len(out)], left[k + 1 - len(out)]
            if (d >= 0) != (e >= 0):
                t = d / (d - e)
                kept.append([p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1])])
            if e >= 0:
                kept.append(q)
        out = kept
        if not out:
            break
    return np.array(out).reshape(-1, 2)


def areas(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Areas of polygons, one a row; a corner may be repeated."""
    return np.abs((x * np.roll(y, -1, 1) - y * np.roll(x, -1, 1)).sum(1)) / 2


def padded(flat: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Corners x, y of lists x, y, x, y, ..., a row a list, filled up with the last one, and their numbers: 0 (and NaN) for null or none."""
    starts, ends = flat.offsets.to_numpy()[:-1].astype(np.int64), flat.offsets.to_numpy()[1:].astype(np.int64)
    n = np.where(flat.is_valid().to_numpy(zero_copy_only=False), (ends - starts) // 2, 0)
    v = np.append(flat.values.to_numpy(zero_copy_only=False).astype(float), [np.nan, np.nan])
    at = starts[:, None] + 2 * np.minimum(np.arange(max(int(n.max(initial=0)), 1)), np.maximum(n - 1, 0)[:, None])
    at = np.where(n[:, None] > 0, at, len(v) - 2)
    return v[at], v[at + 1], n


def is_box(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Which rows of corners are boxes along the axes, corner by corner."""
    if x.shape[1] < 4:
        return np.zeros(len(n), bool)
    same = lambda z, k: z[:, k] == z[:, (k + 1) % 4]
    return (n == 4) & (same(x, 0) & same(y, 1) & same(x, 2) & same(y, 3) | same(y, 0) & same(x, 1) & same(y, 2) & same(x, 3))


def common_areas(x: np.ndarray, y: np.ndarray, bx: np.ndarray, by: np.ndarray) -> np.ndarray:
    """``area(clip(subject, by))`` of pairs of convex anticlockwise polygons, a row a pair; rows are filled up by repeating a corner."""
    out, rows, sides = np.zeros(len(x)), np.arange(len(x)), bx.shape[1]
    for s in range(sides):
        ax, ay = bx[rows, s, None], by[rows, s, None]
        left = (bx[rows, (s + 1) % sides, None] - ax) * (y - ay) - (by[rows, (s + 1) % sides, None] - ay) * (x - ax)
        inside = left >= 0
        some = inside.any(1)
        if not some.all():
            x, y, left, inside, rows = (z[some] for z in (x, y, left, inside, rows))
        cut = np.flatnonzero(~inside.all(1))
        if not len(cut):
            continue
        # of each side the point where it is cut, then its end
        px, py, d, here = x[cut], y[cut], left[cut], inside[cut]
        qx, qy, e, there = (np.roll(z, -1, 1) for z in (px, py, d, here))
        crossed = here != there
        t = np.divide(d, d - e, out=np.zeros_like(d), where=crossed)
        kept = np.stack([crossed, there], 2).reshape(len(cut), -1)
        count = kept.sum(1)
        wide = max(x.shape[1], int(count.max()))
        at = np.argsort(~kept, axis=1, kind="stable")[:, :wide]
        at = np.take_along_axis(at, np.minimum(np.arange(wide), count[:, None] - 1), 1)
        fill = ((0, 0), (0, wide - x.shape[1]))
        x, y = np.pad(x, fill, "edge"), np.pad(y, fill, "edge")
        for z, p, q in ((x, px, qx), (y, py, qy)):
            z[cut] = np.take_along_axis(np.stack([p + t * (q - p), q], 2).reshape(len(cut), -1), at, 1)
    out[rows] = areas(x, y)
    return out


def overlap_flag(s: np.ndarray, s1: np.ndarray, s2: np.ndarray, slack: float) -> np.ndarray:
    """0 apart, 1 overlapping, 2 the first inside the second, 3 the second inside the first, of overlaps and areas."""
    return np.select([s <= 1e-9 * np.minimum(s1, s2), s >= s1 * (1 - slack), s >= s2 * (1 - slack)], [0, 2, 3], 1)


def ellipse(cx: float, cy: float, a: float, b: float, theta: float, n: int = 64) -> np.ndarray:
    t, r = np.linspace(0, 2 * math.pi, n, endpoint=False), math.radians(theta)
    x, y = a * np.cos(t), b * np.sin(t)
    return np.stack([cx + x * math.cos(r) - y * math.sin(r), cy + x * math.sin(r) + y * math.cos(r)], 1)


def _ellipses(rows: np.ndarray, n: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Corners x, y of ``ellipse`` for rows of cx, cy, a, b, theta."""
    cx, cy, a, b, theta = rows.T[:, :, None]
    t, r = np.linspace(0, 2 * math.pi, n, endpoint=False), np.radians(theta)
    x, y = a * np.cos(t), b * np.sin(t)
    return cx + x * np.cos(r) - y * np.sin(r), cy + x * np.sin(r) + y * np.cos(r)


def narrowest_box(poly: np.ndarray) -> tuple[float, float]:
    """Long and short side of the smallest rectangle around a convex outline; a side lies on an edge."""
    if len(poly) < 3:
        d = float(np.ptp(poly, axis=0).max()) if len(poly) else 0.0
        return d, 0.0
    best = None
    for k in range(len(poly)):
        e = poly[(k + 1) % len(poly)] - poly[k]
        t = -math.atan2(e[1], e[0])
        r = poly @ np.array([[math.cos(t), math.sin(t)], [-math.sin(t), math.cos(t)]])
        w, h = np.ptp(r, axis=0)
        if best is None or w * h < best[0] * best[1]:
            best = (float(w), float(h))
    return max(best), min(best)


def hu_moments(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> list[float]:
    """The seven invariants of normalised central moments."""
    m = w.sum()
    if m == 0:
        return [0.0] * 7
    dx, dy = x - (w @ x) / m, y - (w @ y) / m
    n = {(p, q): float(w @ (dx**p * dy**q)) / m ** (1 + (p + q) / 2) for p in range(4) for q in range(4) if 2 <= p + q <= 3}
    a, b, c, d = n[3, 0] + n[1, 2], n[2, 1] + n[0, 3], n[3, 0] - 3 * n[1, 2], 3 * n[2, 1] - n[0, 3]
    s, t = n[2, 0] + n[0, 2], n[2, 0] - n[0, 2]
    return [
        s, t**2 + 4 * n[1, 1] ** 2, c**2 + d**2, a**2 + b**2,
        c * a * (a**2 - 3 * b**2) + d * b * (3 * a**2 - b**2), t * (a**2 - b**2) + 4 * n[1, 1] * a * b, d * a * (a**2 - 3 * b**2) - c * b * (3 * a**2 - b**2),
    ]


def zernike(x: np.ndarray, y: np.ndarray, w: np.ndarray, order: int = 4) -> list[float]:
    """Moduli of the Zernike moments up to an order, on the disc around the centroid."""
    m = w.sum()
    if m == 0:
        return []
    dx, dy = x - (w @ x) / m, y - (w @ y) / m
    rad = max(np.hypot(dx, dy).max(), 1e-9)
    r, t, out = np.hypot(dx, dy) / rad, np.arctan2(dy, dx), []
    for n in range(order + 1):
        for k in range(n % 2, n + 1, 2):
            poly = sum((-1) ** s * math.factorial(n - s) / (math.factorial(s) * math.factorial((n + k) // 2 - s) * math.factorial((n - k) // 2 - s)) * r ** (n - 2 * s) for s in range((n - k) // 2 + 1))
            out.append(float(abs((n + 1) / math.pi * (w / m * poly * np.exp(-1j * k * t)).sum())))
    return out


def fourier_descriptors(poly: np.ndarray, count: int = 8) -> list[float]:
    """Moduli of the Fourier coefficients of an outline, scaled by the first: free of place, size and turn."""
    if len(poly) < 3:
        return [0.0] * count
    f = np.abs(np.fft.fft(poly[:, 0] + 1j * poly[:, 1]))[1:]
    f = f / (f[0] or 1.0)
    return [float(v) for v in np.pad(f[:count], (0, max(0, count - len(f))))]


def blob_shapes(pixels: DataFrame) -> DataFrame:
    """Shape parameters of blobs (blob, ix, iy, v): outline area, circularity, elongation, rectangularity, roundness, invariants.

    A blob is a bounded group. Blobs of one line have no area and circularity 0.
    """
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y, w = (pdf[c].to_numpy(float) for c in ("ix", "iy", "v"))
        corners = np.concatenate([np.stack([x + a, y + b], 1) for a in (-0.5, 0.5) for b in (-0.5, 0.5)])
        poly = outline(corners[:, 0], corners[:, 1])
        s, side = area(poly), float(np.hypot(*(poly - np.roll(poly, -1, 0)).T).sum())
        a, b = narrowest_box(poly)
        row = {"blob": int(pdf["blob"].iloc[0]), "area": s, "perimeter": side, "circularity": 4 * math.pi * s / side**2 if side else 0.0, "elongation": 1 - b / a if a else 0.0, "rectangularity": s / (a * b) if a * b else 0.0, "roundness": 4 * s / (math.pi * a * a) if a else 0.0, "bmaj": a, "bmin": b}
        return pd.DataFrame([row | {"hu": hu_moments(x, y, np.abs(w)), "zernike": zernike(x, y, np.abs(w)), "fourier": fourier_descriptors(poly)}])

    return pixels.groupBy("blob").applyInPandas(run, "blob long, area double, perimeter double, circularity double, elongation double, rectangularity double, roundness double, bmaj double, bmin double, hu array<double>, zernike array<double>, fourier array<double>")


def ellipse_overlaps(pairs: DataFrame) -> DataFrame:
    """Add overlap (area) and flag (0 none, 1 overlapping, 2 first in second, 3 second in first) to pairs with ellipses x1, y1, a1, b1, t1 and x2, ..."""
    fields = [f"{c}{k}" for k in (1, 2) for c in "xyabt"]

    @F.pandas_udf("struct<overlap:double,flag:int>")
    def overlap(f: pd.DataFrame) -> pd.DataFrame:
        # equal pairs once; the slices bound the memory
        rows, back = np.unique(f.to_numpy(float), axis=0, return_inverse=True)
        s, flag = np.zeros(len(rows)), np.zeros(len(rows), int)
        for at in range(0, len(rows), 2048):
            part = slice(at, at + 2048)
            one, two = (_ellipses(rows[part, k : k + 5]) for k in (0, 5))
            s[part] = common_areas(*one, *two)
            flag[part] = overlap_flag(s[part], areas(*one), areas(*two), 1e-6)
        return pd.DataFrame({"overlap": s[back.ravel()], "flag": flag[back.ravel()]})

    return pairs.withColumn("_o", overlap(F.struct(*(F.col(c).cast("double").alias(c) for c in fields)))).select("*", "_o.overlap", "_o.flag").drop("_o")
