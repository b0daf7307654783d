"""Images in long form (image_id, ix, iy, v): projections, masks, neighbourhood filters, backgrounds, significance.

Neighbourhood filters run on tiles with halos (``stencil``): one shuffle by tile, whatever the kernel.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pelorus.functions import stats
from pelorus.operators import stencil

PIXEL = ["image_id", "ix", "iy"]
# fixed values: kernels
LAPLACE = [[1, 1, 1], [1, -8, 1], [1, 1, 1]]
SCHARR_X = [[-3, 0, 3], [-10, 0, 10], [-3, 0, 3]]
SCHARR_Y = [[-3, -10, -3], [0, 0, 0], [3, 10, 3]]
KIRSCH_RING = [5, 5, 5, -3, -3, -3, -3, -3]
LOG7 = [[0, 0, 1, 1, 1, 0, 0], [0, 1, 3, 3, 3, 1, 0], [1, 3, 0, -7, 0, 3, 1], [1, 3, -7, -24, -7, 3, 1], [0, 0, 1, 1, 1, 0, 0], [0, 1, 3, 3, 3, 1, 0], [1, 3, 0, -7, 0, 3, 1]]
B3_SPLINE = [1 / 16, 4 / 16, 6 / 16, 4 / 16, 1 / 16]


def kirsch_kernels() -> list[list[list[float]]]:
    """Eight compass kernels: the ring of weights turned around the centre."""
    ring = [(0, 0), (0, 1), (0, 2), (1, 2), (2, 2), (2, 1), (2, 0), (1, 0)]
    out = []
    for turn in range(8):
        k = [[0.0] * 3 for _ in range(3)]
        for n, (r, c) in enumerate(ring):
            k[r][c] = float(KIRSCH_RING[(n - turn) % 8])
        out.append(k)
    return out


def b3_kernel() -> list[list[float]]:
    return [[a * b for b in B3_SPLINE] for a in B3_SPLINE]


def log_kernel(size: int, scale: float) -> list[list[float]]:
    """Scale-normalised Laplacian of Gaussian, its mean subtracted."""
    half, s2 = size // 2, scale * scale
    k = [[-s2 * (1 - (x * x + y * y) / (2 * s2)) * math.exp(-(x * x + y * y) / (2 * s2)) / (math.pi * s2 * s2) for x in range(-half, half + 1)] for y in range(-half, half + 1)]
    mean = sum(map(sum, k)) / (len(k) * len(k[0]))
    return [[v - mean for v in row] for row in k]


def gauss_kernel(bmaj: float, bmin: float, bpa: float, n_sigmas: float = 5.0) -> list[list[float]]:
    """Elliptical beam (FWHMs in pixels, position angle in degrees), largest value 1."""
    to_sigma = 2 * math.sqrt(2 * math.log(2))
    sx, sy, theta = bmaj / to_sigma, bmin / to_sigma, math.radians(bpa + 90)
    half = int(math.floor(n_sigmas * max(sx, sy) + 0.5)) + 1
    a = math.cos(theta) ** 2 / (2 * sx * sx) + math.sin(theta) ** 2 / (2 * sy * sy)
    b = math.sin(2 * theta) / (4 * sx * sx) - math.sin(2 * theta) / (4 * sy * sy)
    c = math.sin(theta) ** 2 / (2 * sx * sx) + math.cos(theta) ** 2 / (2 * sy * sy)
    return [[math.exp(-(a * x * x + 2 * b * x * y + c * y * y)) for x in range(-half, half + 1)] for y in range(-half, half + 1)]


def extent(pixels: DataFrame) -> DataFrame:
    """One row an image: its bounds."""
    return pixels.groupBy("image_id").agg(F.min("ix").alias("x0"), F.max("ix").alias("x1"), F.min("iy").alias("y0"), F.max("iy").alias("y1"))


def convolve(pixels: DataFrame, kernels: dict[str, list[list[float]]], gap: int = 1, border: str = "zero", tile: int = stencil.TILE) -> DataFrame:
    """Pixels of the input with one column a kernel: the convolution with zeros beyond the border, or the image mirrored there.

    The kernel is flipped. ``gap`` spreads its cells (à trous). Missing, null and non-finite pixels count as 0, repeated ones
    as their sum, and only input pixels come out, once.
    """
    arrays = {n: np.array(k, float) for n, k in kernels.items()}
    halo = gap * max(max(k.shape) // 2 for k in arrays.values())

    def run(field) -> dict[str, np.ndarray]:
        return {n: field.correlate(field.v, k, gap, border == "mirror") for n, k in arrays.items()}

    return stencil.near(pixels, run, list(arrays), halo, extent(pixels) if border == "mirror" else None, tile)


def log_filter(pixels: DataFrame) -> DataFrame:
    """The fixed 7 x 7 Laplacian of Gaussian; 0 where the pixel is 0, null or not finite."""
    d = convolve(pixels, {"log": LOG7})
    return d.withColumn("log", F.when(stats.finite(F.col("v")) & (F.col("v") != 0), F.col("log")).otherwise(0.0))


def laplacian(pixels: DataFrame) -> DataFrame:
    return convolve(pixels, {"laplacian": LAPLACE})


def gradient(pixels: DataFrame) -> DataFrame:
    d = convolve(pixels, {"gx": SCHARR_X, "gy": SCHARR_Y})
    return d.withColumn("gradient", F.sqrt(F.col("gx") ** 2 + F.col("gy") ** 2)).drop("gx", "gy")


def kirsch(pixels: DataFrame) -> DataFrame:
    names = [f"k{i}" for i in range(8)]
    d = convolve(pixels, dict(zip(names, kirsch_kernels())))
    return d.withColumn("kirsch", F.greatest(*names)).drop(*names)


def wavelet(pixels: DataFrame, scales: int = 3, tile: int = stencil.TILE) -> DataFrame:
    """Planes w1..wn (differences of successive B3-spline smoothings) and the last smoothing, as plane n + 1; all in one shuffle."""
    kernel = np.array(b3_kernel())
    halo = 2 * (2**scales - 1)

    def run(field) -> dict[str, np.ndarray]:
        seen, now, out = np.isfinite(field.v), np.nan_to_num(field.v), {}
        for n in range(1, scales + 1):
            smooth = np.where(seen, field.correlate(now, kernel, 2 ** (n - 1)), 0.0)
            out[f"w{n}"], now = now - smooth, smooth
        return {**out, f"w{scales + 1}": now}

    names = [f"w{n}" for n in range(1, scales + 2)]
    planes = F.array(*(F.struct(F.lit(n).alias("plane"), F.col(f"w{n}").alias("w")) for n in range(1, scales + 2)))
    return stencil.near(pixels, run, names, halo, None, tile).select(*PIXEL, F.inline(planes))


def _morphology(field, operation: str, half: int) -> np.ndarray:
    seen = np.isfinite(field.v)

    def step(a: np.ndarray, largest: bool) -> np.ndarray:
        return np.where(seen, field.extreme(a, half, largest), np.nan)

    if operation in ("dilate", "erode"):
        return step(field.v, operation == "dilate")
    if operation == "gradient":
        return step(field.v, True) - step(field.v, False)
    first = operation in ("close", "blackhat")
    inner = step(step(field.v, first), not first)
    return inner if operation in ("open", "close") else field.v - inner if operation == "tophat" else inner - field.v


def morphologies(pixels: DataFrame, operations: tuple[str, ...], size: int = 3, tile: int = stencil.TILE, repeated: str = "max") -> DataFrame:
    """Square grey morphology over existing pixels, one column an operation: dilate, erode, open, close, gradient, tophat, blackhat. One shuffle.

    A pixel given several times counts by ``repeated`` (sum, max or min).
    """
    half = size // 2
    twice = any(o not in ("dilate", "erode", "gradient") for o in operations)
    return stencil.near(pixels, lambda field: {o: _morphology(field, o, half) for o in operations}, list(operations), half * (2 if twice else 1), None, tile, repeated).select(*PIXEL, *operations)


def morphology(pixels: DataFrame, operation: str = "dilate", size: int = 3, tile: int = stencil.TILE) -> DataFrame:
    """One operation of ``morphologies`` as column ``m``."""
    return morphologies(pixels, (operation,), size, tile, "min" if operation == "erode" else "max").withColumnRenamed(operation, "m")


def _peaks(field, half: int, skip_border: bool) -> np.ndarray:
    top = (field.v == field.extreme(field.v, half, True)) & (field.v != 0) & (field.v != field.shifted(field.v, 1, 1))
    return top & field.inside(half) if skip_border else top


def peaks(pixels: DataFrame, size: int = 3, skip_border: bool = True, tile: int = stencil.TILE, repeated: str = "max") -> DataFrame:
    """Local maxima: normal pixels (not 0) equal to their dilation, off the border, not level with their lower-left neighbour."""
    half = size // 2
    # an image's bounds are one row
    bounds = extent(pixels) if skip_border else None
    return stencil.near(pixels, lambda field: {"top": _peaks(field, half, skip_border)}, ["top"], max(half, 1), bounds, tile, repeated, "top").select(*PIXEL, "v")


def multi_kernel_peaks(pixels: DataFrame, sizes: tuple[int, ...] = (3, 5, 7), tolerance: int = 1, multiplicity: int = 2, tile: int = stencil.TILE, repeated: str = "max") -> DataFrame:
    """Peaks of the first kernel that lie within ``tolerance`` pixels of peaks of ``multiplicity`` kernels or more, itself included. One shuffle."""
    def run(field) -> dict[str, np.ndarray]:
        # the largest first: its pairs of pixels serve the others
        tops = {s: _peaks(field, s // 2, True) for s in sorted(set(sizes), reverse=True)}
        votes = sum((field.extreme(np.where(t, 1.0, np.nan), tolerance, True) == 1).astype(float) for t in tops.values())
        return {"kernels": votes, "kept": tops[sizes[0]] & (votes >= multiplicity)}

    halo = max(max(sizes) // 2, 1) + tolerance
    return stencil.near(pixels, run, ["kernels", "kept"], halo, extent(pixels), tile, repeated, "kept").select(*PIXEL, "v", F.col("kernels").cast("long").alias("kernels"))


def tiled(pixels: DataFrame, w: int, h: int) -> DataFrame:
    return pixels.withColumns({"tx": F.floor(F.col("ix") / w).cast("long"), "ty": F.floor(F.col("iy") / h).cast("long")})


def _clip_box(v: np.ndarray, k: float = 3.0, rounds: int = 5, tol: float = 0.1) -> tuple[float, float]:
    """Median and rms of one box, clipped as ``stats.clipped`` does."""
    spread = lambda x: float(x.std(ddof=1)) if len(x) > 1 else 0.0
    middle, rms = float(np.median(v)), spread(v)
    for _ in range(rounds):
        kept = v[np.abs(v - middle) < k * rms]
        if not len(kept):
            break
        before, middle, rms = rms, float(np.median(kept)), spread(kept)
        if abs(rms / before - 1.0) <= tol:
            break
    return middle, rms


def _biweight_box(v: np.ndarray, c: float = 6.0, rounds: int = 10, tol: float = 1e-4) -> tuple[float, float]:
    """Location and scale of one box as ``stats.biweight`` has them."""
    at = float(np.median(v))
    scale = float(np.median(np.abs(v - at))) * stats.MAD_TO_RMS
    for _ in range(rounds):
        if scale <= 0:
            break
        u2 = ((v - at) / (c * scale)) ** 2
        inside = u2 <= 1.0
        u2, w = u2[inside], (1 - u2[inside]) ** 2
        before, at = at, float((w @ v[inside]) / w.sum()) if w.sum() else at
        if before == 0 or abs(at / before - 1.0) < tol:
            break
        den = abs(float(((1 - u2) * (1 - 5 * u2)).sum()))
        if den > 1.0:
            scale = math.sqrt(len(v) * float(((v[inside] - before) ** 2 * (1 - u2) ** 4).sum())) / den
    return at, scale


def _box_estimates(d: DataFrame, keys: list[str], estimator: str) -> DataFrame:
    """The iterated estimators of boxes: a box is a bounded group, so all rounds run on it in one task."""
    f = {"clipped": _clip_box, "biweight": _biweight_box}[estimator]
    kind = dict(d.dtypes)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(*key, *f(pdf["v"].to_numpy(float)))], columns=[*keys, "bkg", "rms"])

    return d.select(*keys, "v").groupBy(*keys).applyInPandas(run, ", ".join(f"`{k}` {kind[k]}" for k in keys) + ", bkg double, rms double")


#: name of an estimator -> keys, bkg and rms of the finite values ``v`` of each group
def _estimates(d: DataFrame, keys: list[str], estimator: str) -> DataFrame:
    if estimator == "mean":
        return d.groupBy(*keys).agg(F.avg("v").alias("bkg"), F.coalesce(F.stddev_samp("v"), F.lit(0.0)).alias("rms"))
    if estimator == "median":
        return stats.mad(d, keys, "v").select(*keys, F.col("median").alias("bkg"), (F.col("mad") * stats.MAD_TO_RMS).alias("rms"))
    if estimator == "biweight":
        return stats.biweight(d, keys, "v").select(*keys, F.col("location").alias("bkg"), F.col("scale").alias("rms"))
    if estimator == "clipped":
        return stats.clipped(d, keys, "v").select(*keys, F.col("median").alias("bkg"), "rms")
    raise ValueError(f"no estimator {estimator!r}")


def _reliable(least: int) -> Column:
    return (F.col("npix") >= least) & (F.col("bkg") != 0) & (F.col("rms") != 0) & stats.finite(F.col("bkg")) & stats.finite(F.col("rms"))


def sample_background(pixels: DataFrame, estimator: str = "median", low: float | None = None, high: float | None = None, least: int = 10) -> DataFrame:
    """image_id, npix, bkg, rms, reliable of each image as one sample, of its pixels from ``low`` to ``high``.

    estimator: mean, median (with the mad), biweight (c = 6) or clipped (median and rms clipped at 3 sigma); all spread a large image over tasks.
    """
    d = pixels.filter(stats.finite(F.col("v"))).withColumn("v", F.col("v").cast("double"))
    for bound, test in ((low, F.col("v") >= F.lit(low)), (high, F.col("v") <= F.lit(high))):
        if bound is not None:
            d = d.filter(test)
    n = d.groupBy("image_id").agg(F.count("*").alias("npix"))
    return n.join(_estimates(d, ["image_id"], estimator), "image_id").withColumn("reliable", _reliable(least)).select("image_id", "npix", "bkg", "rms", "reliable")


def _boxes(pixels: DataFrame, w: int, h: int, estimator: str) -> DataFrame:
    """image_id, tx, ty, npix, bkg, rms of each box."""
    d = tiled(pixels.filter(stats.finite(F.col("v"))).withColumn("v", F.col("v").cast("double")), w, h)
    keys = ["image_id", "tx", "ty"]
    if estimator == "median":
        m = d.groupBy(*keys).agg(F.count("*").alias("npix"), F.percentile(F.col("v"), 0.5).alias("bkg"))
        grid = d.join(m, keys).groupBy(*keys, "npix", "bkg").agg((F.percentile(F.abs(F.col("v") - F.col("bkg")), 0.5) * stats.MAD_TO_RMS).alias("rms"))
    else:
        parts = _box_estimates(d, keys, estimator) if estimator in ("clipped", "biweight") else _estimates(d, keys, estimator)
        grid = d.groupBy(*keys).agg(F.count("*").alias("npix")).join(parts, keys)
    return grid


def two_pass_background(pixels: DataFrame, w: int, h: int, estimator: str = "median", least: int = 10) -> DataFrame:
    """Boxes as of ``background``, whose rms is that of a second pass over the pixels less the interpolated background, where it is positive."""
    keys = ["image_id", "tx", "ty"]
    first = background(pixels, w, h, estimator, least)
    rest = interpolate(pixels, first, w, h).select(*PIXEL, (F.col("v") - F.col("bkg")).alias("v"))
    second = _boxes(rest, w, h, estimator).select(*keys, F.col("rms").alias("_rms"))
    return first.join(second, keys, "left").withColumn("rms", F.when(F.col("_rms") > 0, F.col("_rms")).otherwise(F.col("rms"))).drop("_rms")


def background(pixels: DataFrame, w: int, h: int, estimator: str = "median", least: int = 10) -> DataFrame:
    """image_id, tx, ty, npix, bkg, rms, reliable of each box. estimator: mean, median (with the mad), biweight or clipped.

    Boxes are bounded in size, so the built-in exact percentile serves. A box is unreliable with fewer than ``least``
    pixels or a background or rms of 0; it takes the mean of up to three reliable left and lower neighbours.
    """
    keys = ["image_id", "tx", "ty"]
    grid = _boxes(pixels, w, h, estimator)
    grid = grid.withColumn("reliable", _reliable(least))
    good = grid.filter("reliable").select("image_id", "tx", "ty", "bkg", "rms")
    shifts = F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((1, 0), (0, 1), (1, 1))))
    lent = good.select("image_id", F.explode(shifts).alias("o"), "tx", "ty", "bkg", "rms").select("image_id", (F.col("tx") + F.col("o.x")).alias("tx"), (F.col("ty") + F.col("o.y")).alias("ty"), "bkg", "rms")
    lent = lent.groupBy(*keys).agg(F.avg("bkg").alias("_b"), F.avg("rms").alias("_r"))
    out = grid.join(lent, keys, "left")
    return out.select(*keys, "npix", F.when(F.col("reliable"), F.col("bkg")).otherwise(F.coalesce("_b", "bkg")).alias("bkg"), F.when(F.col("reliable"), F.col("rms")).otherwise(F.coalesce("_r", "rms")).alias("rms"), "reliable")


def interpolate(pixels: DataFrame, grid: DataFrame, w: int, h: int) -> DataFrame:
    """Pixels with bkg and rms interpolated bilinearly between box centres; beyond the outer centres the nearest holds.

    Every box gets its nine neighbours on one row, so a pixel meets all it needs in one join on its own box.
    """
    keys = ["image_id", "tx", "ty"]
    near = [(a, b) for b in (-1, 0, 1) for a in (-1, 0, 1)]
    shifts = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(k).alias("k")) for k, (a, b) in enumerate(near)))
    spread = grid.select(*keys, "bkg", "rms", F.explode(shifts).alias("o")).select("image_id", (F.col("tx") - F.col("o.a")).alias("tx"), (F.col("ty") - F.col("o.b")).alias("ty"), F.col("o.k").alias("k"), F.struct("bkg", "rms").alias("e"))
    wide = spread.groupBy(*keys).agg(F.array(*(F.max(F.when(F.col("k") == k, F.col("e"))) for k in range(9))).alias("_n"))
    ends = grid.groupBy("image_id").agg(*(f(c).alias(f"_{n}{c}") for c in ("tx", "ty") for n, f in (("lo", F.min), ("hi", F.max))))
    d = tiled(pixels, w, h).join(wide.join(ends, "image_id"), keys)
    parts = {}
    for axis, c, size in (("x", "tx", w), ("y", "ty", h)):
        at = (F.col("i" + axis) + 0.5) / size - 0.5
        d = d.withColumns({f"_{axis}0": F.floor(at).cast("long"), f"_f{axis}": at - F.floor(at)})
        # the box on either side, no further than the outer ones, as a step from the pixel's own
        parts[axis] = [(F.greatest(F.least(F.col(f"_{axis}0") + s, F.col("_hi" + c)), F.col("_lo" + c)) - F.col(c), F.col(f"_f{axis}") if s else 1 - F.col(f"_f{axis}")) for s in (0, 1)]
    corner = lambda x, y: F.get("_n", (x[0] + 1 + 3 * (y[0] + 1)).cast("int"))
    total = lambda name: sum((F.coalesce(x[1] * y[1] * corner(x, y)[name], F.lit(0.0)) for x in parts["x"] for y in parts["y"]), F.lit(0.0)).alias(name)
    return d.select(*PIXEL, "v", total("bkg"), total("rms"))


def significance(pixels: DataFrame) -> DataFrame:
    """z = (v - bkg) / rms; 0 where the pixel is empty or the rms isn't positive."""
    return pixels.withColumn("z", F.when((F.col("v") != 0) & (F.col("rms") > 0), (F.col("v") - F.col("bkg")) / F.col("rms")).otherwise(0.0))


def normalise(pixels: DataFrame, low: float, high: float, scale: str = "linear", skip_zero: bool = True) -> DataFrame:
    """Values of each image brought to low..high; ``log``: first to 1..256, then by the logarithm."""
    seen = pixels.filter("v <> 0") if skip_zero else pixels
    ends = seen.groupBy("image_id").agg(F.min("v").alias("_a"), F.max("v").alias("_b"))
    unit = (F.col("v") - F.col("_a")) / (F.col("_b") - F.col("_a"))
    if scale == "log":
        unit = F.log10(1 + 255 * unit) / math.log10(256)
    out = low + (high - low) * unit
    return pixels.join(ends, "image_id").withColumn("v", F.when(F.col("v") == 0, F.lit(0.0)).otherwise(out) if skip_zero else out).drop("_a", "_b")


def binarize(v: Column, threshold: float, foreground: float = 1.0, below: bool = False) -> Column:
    """Non-zero pixels at or above (or below) the threshold become the foreground; others 0."""
    hit = v < threshold if below else v >= threshold
    return F.when((v != 0) & hit, F.lit(foreground)).otherwise(0.0)


def apply_threshold(v: Column, low: float, high: float, masked: float = 0.0) -> Column:
    """Non-zero pixels outside low..high become ``masked``."""
    return F.when((v != 0) & ((v < low) | (v > high)), F.lit(masked)).otherwise(v)


def masked(pixels: DataFrame, mask: DataFrame, binary: bool = False) -> DataFrame:
    """Pixels where the mask isn't 0 keep their value (or 1); elsewhere 0."""
    on = mask.filter("v <> 0").select(*PIXEL).distinct().withColumn("_on", F.lit(True))
    kept = F.lit(1.0) if binary else F.col("v").cast("double")
    return pixels.join(on, PIXEL, "left").select(*PIXEL, F.when(F.col("_on"), kept).otherwise(0.0).alias("v"))


def add(a: DataFrame, b: DataFrame, c: float = 1.0) -> DataFrame:
    """a + c·b pixel by pixel, over the pixels of both."""
    return a.join(b.select(*PIXEL, F.col("v").alias("_b")), PIXEL).select(*PIXEL, (F.col("v") + c * F.col("_b")).alias("v"))


def source_mask(pixels: DataFrame, sources: DataFrame, invert: bool = False, binary: bool = False) -> DataFrame:
    """Only the pixels of sources (or, inverted, all others)."""
    kept = pixels.join(sources.select(*PIXEL).distinct(), PIXEL, "left_anti" if invert else "left_semi")
    return kept.withColumn("v", F.lit(1.0)) if binary else kept


def crop(pixels: DataFrame, x0: int, x1: int, y0: int, y1: int) -> DataFrame:
    return pixels.filter(F.col("ix").between(x0, x1) & F.col("iy").between(y0, y1))


def plan_tiles(nx: int, ny: int, w: int, h: int, step: float = 1.0) -> list[tuple[int, int, int, int]]:
    """(x0, x1, y0, y1) of tiles with the given step as a share of the size; the last is cut at the border, one pixel is no tile."""
    def edges(n: int, size: int) -> list[tuple[int, int]]:
        out, at, move = [], 0, max(1, round(step * size))
        while at < n:
            end = min(at + size, n) - 1
            if end == at and size > 1:
                break
            out.append((at, end))
            if end == n - 1:
                break
            at += move
        return out

    return [(a, b, c, d) for a, b in edges(nx, w) for c, d in edges(ny, h)]
