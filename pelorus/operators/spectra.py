"""Spectral fits, source counts, folding and unfolding, mixture fits, simulation."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def power_law_fit(points: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n, alpha, lg_norm: least-squares line of lg_s over lg_nu; two points give the line through them."""
    return points.groupBy(*keys).agg(F.count("*").alias("n"), F.regr_slope("lg_s", "lg_nu").alias("alpha"), F.regr_intercept("lg_s", "lg_nu").alias("lg_norm"))


def levenberg(f, p0: np.ndarray, y: np.ndarray, sigma: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray, float]:
    """Damped least squares with numeric derivatives: (parameters, covariance, chi²)."""
    p, lam = p0.astype(float), 1e-2
    r = (y - f(p)) / sigma
    chi = float(r @ r)
    jac = np.zeros((len(y), len(p)))
    for _ in range(rounds):
        for k in range(len(p)):
            step = 1e-6 * max(1.0, abs(p[k]))
            q = p.copy()
            q[k] += step
            jac[:, k] = (f(q) - f(p)) / step / sigma
        a, g = jac.T @ jac, jac.T @ r
        try:
            d = np.linalg.solve(a + lam * np.diag(np.diag(a) + 1e-12), g)
        except np.linalg.LinAlgError:
            break
        rn = (y - f(p + d)) / sigma
        new = float(rn @ rn)
        if np.isfinite(new) and new < chi:
            done = chi - new < 1e-10 * max(chi, 1e-30)
            p, r, chi, lam = p + d, rn, new, lam / 5
            if done:
                break
        else:
            lam *= 5
            if lam > 1e12:
                break
    return p, np.linalg.pinv(jac.T @ jac), chi


_MODELS = {
    "pol3": (4, lambda x, p: np.polyval(p, x), lambda x, y: np.polyfit(x, y, min(3, len(x) - 1)) if len(x) > 3 else None),
    "ssa": (3, lambda x, p: p[0] + p[1] * (x - p[2]) + _lg_absorbed((x - p[2]), p[1] - 2.5), lambda x, y: np.array([y.mean(), -0.7, x.min() - 0.1])),
    "ext_ffa": (3, lambda x, p: p[0] + p[1] * x - 10.0 ** (-2.1 * (x - p[2])) / math.log(10), lambda x, y: np.array([y.mean(), -0.7, x.min() - 0.5])),
    "int_ffa": (3, lambda x, p: p[0] + p[1] * (x - p[2]) + _lg_absorbed((x - p[2]), -2.1), lambda x, y: np.array([y.mean(), -0.7, x.min() - 0.1])),
}


def _lg_absorbed(lz: np.ndarray, slope: float) -> np.ndarray:
    tau = 10.0 ** np.clip(slope * lz, -30, 30)
    return np.log10(np.maximum(-np.expm1(-tau) / tau, 1e-300))


def spectral_fits(points: DataFrame, key: str) -> DataFrame:
    """key, model, params, chi2 of each source (a bounded spectrum: key, lg_nu, lg_s, lg_err) for the models with enough points."""
    kind = points.schema[key].dataType.simpleString()

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("lg_nu")
        x, y, e = (pdf[c].to_numpy(float) for c in ("lg_nu", "lg_s", "lg_err"))
        rows = []
        for name, (least, f, start) in _MODELS.items():
            if len(x) < least or (p0 := start(x, y)) is None:
                continue
            p, _, chi = levenberg(lambda q, f=f: f(x, q), np.asarray(p0, float), y, np.where(e > 0, e, 1.0))
            rows.append((pdf[key].iloc[0], name, [float(v) for v in p], chi))
        return pd.DataFrame(rows, columns=[key, "model", "params", "chi2"])

    return points.groupBy(key).applyInPandas(fit, f"{key} {kind}, model string, params array<double>, chi2 double")


def gauss_mixture(pixels: DataFrame, components: int = 2) -> DataFrame:
    """source_id, component, amp, x, y, sx, sy, theta, chi2: a Gaussian mixture fitted to each source's pixels (a bounded group).

    Start values are the brightest pixels that no brighter one lies next to; the group's spread gives the widths.
    """
    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y, v = (pdf[c].to_numpy(float) for c in ("ix", "iy", "v"))
        order, chosen = np.argsort(-v, kind="stable"), []
        for i in order:
            if all(max(abs(x[i] - x[j]), abs(y[i] - y[j])) > 2 for j in chosen):
                chosen.append(i)
            if len(chosen) == components:
                break
        if len(v) < 6 * len(chosen):
            chosen = chosen[: max(1, len(v) // 6)]
        if len(v) < 6:
            return pd.DataFrame(columns=["source_id", "component", "amp", "x", "y", "sx", "sy", "theta", "chi2"])
        p0 = np.concatenate([[max(v[i], 1e-6), x[i], y[i], max(x.std() / len(chosen), 0.7), max(y.std() / len(chosen), 0.7), 0.1] for i in chosen])

        def model(p: np.ndarray) -> np.ndarray:
            out = np.zeros(len(v))
            for a, cx, cy, sx, sy, t in p.reshape(-1, 6):
                c, s = math.cos(t), math.sin(t)
                u, w = (x - cx) * c + (y - cy) * s, (y - cy) * c - (x - cx) * s
                out += a * np.exp(-0.5 * ((u / max(abs(sx), 0.1)) ** 2 + (w / max(abs(sy), 0.1)) ** 2))
            return out

        p, _, chi = levenberg(model, p0, v, np.full(len(v), max(v.std() * 0.05, 1e-9)), 60)
        rows = [(int(pdf["source_id"].iloc[0]), k, *map(float, c), chi) for k, c in enumerate(p.reshape(-1, 6))]
        return pd.DataFrame(rows, columns=["source_id", "component", "amp", "x", "y", "sx", "sy", "theta", "chi2"])

    return pixels.groupBy("source_id").applyInPandas(fit, "source_id long, component int, amp double, x double, y double, sx double, sy double, theta double, chi2 double")


def source_counts(flux: DataFrame, column: str, lg_edges: list[float], area: float = 1.0, beta: float = 0.0, compat: bool = False) -> DataFrame:
    """bin, n, dnds, err: counts in half-open bins of lg(flux), over bin width and area, times the mean flux to ``beta``.

    compat: the width is 10^(difference of the lg edges).
    """
    lg = F.log10(F.when(F.col(column) > 0, F.col(column)))
    at = sum((F.when(F.col("lg") >= e, 1).otherwise(0) for e in lg_edges), F.lit(0)) - 1
    d = flux.select(lg.alias("lg")).filter(lg.isNotNull()).select(at.alias("bin")).filter(F.col("bin").between(0, len(lg_edges) - 2))
    lo, hi = F.get(F.lit(lg_edges), F.col("bin")), F.get(F.lit(lg_edges), F.col("bin") + 1)
    width = F.pow(F.lit(10.0), hi - lo) if compat else F.pow(F.lit(10.0), hi) - F.pow(F.lit(10.0), lo)
    scale = F.pow(F.pow(F.lit(10.0), (lo + hi) / 2), F.lit(beta)) / (width * area)
    return d.groupBy("bin").agg(F.count("*").alias("n")).select("bin", "n", (F.col("n") * scale).alias("dnds"), (F.sqrt("n") * scale).alias("err"))


def fold(spectrum: DataFrame, response: DataFrame) -> DataFrame:
    """i, folded: sum over j of response(j, i) · true(j)."""
    return spectrum.join(response, "j").groupBy("i").agg(F.sum(F.col("r") * F.col("true")).alias("folded"))


def efficiency(lg: Column, base: float, lg_s: float, width: float) -> Column:
    """Detection efficiency that rises as an error function, by its logistic approximation."""
    return base / (1 + F.exp(-1.702 * math.sqrt(2) * (lg - lg_s) / width))


def response_matrix(spark, lg_edges: list[float], bias: float, resolution: float, base: float, lg_s: float, width: float) -> DataFrame:
    """j, i, r: share of sources of true bin j that are measured in bin i, for a Gaussian error in lg(flux)."""
    def cdf(x: np.ndarray) -> np.ndarray:
        return np.array([0.5 * (1 + math.erf(v / math.sqrt(2))) for v in x])

    edges = np.array(lg_edges)
    centre = (edges[1:] + edges[:-1]) / 2
    rows = []
    for j, c in enumerate(centre):
        share = np.diff(cdf((edges - c - bias) / resolution))
        eff = base / (1 + math.exp(-1.702 * math.sqrt(2) * (c - lg_s) / width))
        rows += [(j, i, float(s * eff)) for i, s in enumerate(share)]
    return spark.createDataFrame(rows, "j int, i int, r double")


def unfold(counts: np.ndarray, response: np.ndarray, centres: np.ndarray, toys: int = 0, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Forward folding: a power law in lg(flux) is fitted through the response; (unfolded counts, spread over Poisson toys)."""
    def spectrum(p: np.ndarray) -> np.ndarray:
        return 10.0 ** np.clip(p[0] + p[1] * (centres - centres.mean()), -30, 30)

    def fitted(n: np.ndarray) -> np.ndarray:
        start = np.array([math.log10(max(n.mean(), 1.0)), -1.0])
        p, *_ = levenberg(lambda q: spectrum(q) @ response, start, n, np.sqrt(np.maximum(n, 1.0)))
        return spectrum(p)

    best, chance = fitted(counts.astype(float)), np.random.default_rng(seed)
    runs = np.array([fitted(chance.poisson(counts).astype(float)) for _ in range(toys)]) if toys else np.zeros((1, len(counts)))
    return best, runs.std(0)


def point_sources(spark, n: int, nx: int, ny: int, s_min: float, s_max: float, slope: float, seed: int = 1) -> DataFrame:
    """source_id, x, y, s: positions uniform over the image, fluxes from a power law with index ``slope`` between the limits."""
    k = 1 - slope
    u = F.rand(seed)
    flux = F.pow(s_min**k + u * (s_max**k - s_min**k), F.lit(1 / k)) if abs(k) > 1e-9 else s_min * F.pow(F.lit(s_max / s_min), u)
    return spark.range(n).select(F.col("id").alias("source_id"), (F.rand(seed + 1) * nx).alias("x"), (F.rand(seed + 2) * ny).alias("y"), flux.alias("s"))


def render(sources: DataFrame, sigma: float, reach: int) -> DataFrame:
    """ix, iy, v: Gaussian sources drawn on pixels within ``reach`` of their centre and summed."""
    steps = F.sequence(F.lit(-reach), F.lit(reach))
    d = sources.select("x", "y", "s", F.explode(steps).alias("dx")).select("*", F.explode(steps).alias("dy"))
    ix, iy = F.floor("x").cast("long") + F.col("dx"), F.floor("y").cast("long") + F.col("dy")
    v = F.col("s") * F.exp(-((ix + 0.5 - F.col("x")) ** 2 + (iy + 0.5 - F.col("y")) ** 2) / (2 * sigma**2))
    return d.select(ix.alias("ix"), iy.alias("iy"), v.alias("v")).groupBy("ix", "iy").agg(F.sum("v").alias("v"))


def annulus_offsets(rows: DataFrame, r_min: float, r_max: float, seed: int = 1) -> DataFrame:
    """Add ox, oy: offsets uniform over the area of a ring."""
    r, t = F.sqrt(r_min**2 + F.rand(seed) * (r_max**2 - r_min**2)), F.rand(seed + 1) * (2 * math.pi)
    return rows.withColumns({"ox": r * F.cos(t), "oy": r * F.sin(t)})
