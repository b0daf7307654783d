"""Models, residuals and measurements around sources."""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pelorus.functions import scalars, stats
from pelorus.operators import image, stencil
from pelorus.plans.runtime import cut_lineage

PIXEL = image.PIXEL


def model_image(components: DataFrame, n_sigma: float = 5.0) -> DataFrame:
    """image_id, ix, iy, model: fitted components (image_id, amp, x, y, sx, sy, theta) drawn within ``n_sigma`` of their centre and summed."""
    reach = F.ceil(n_sigma * F.greatest("sx", "sy")).cast("long")
    d = components.withColumn("_r", reach)
    for c in "xy":
        d = d.withColumn("i" + c, F.explode(F.sequence(F.floor(F.col(c)).cast("long") - F.col("_r"), F.floor(F.col(c)).cast("long") + F.col("_r"))))
    v = scalars.gauss2d(F.col("ix"), F.col("iy"), F.col("amp"), F.col("x"), F.col("y"), F.col("sx"), F.col("sy"), F.col("theta"))
    return d.select("image_id", "ix", "iy", v.alias("m")).groupBy(*PIXEL).agg(F.sum("m").alias("model"))


def subtract_model(pixels: DataFrame, components: DataFrame, n_sigma: float = 5.0) -> DataFrame:
    return pixels.join(model_image(components, n_sigma), PIXEL, "left").select(*PIXEL, (F.col("v") - F.coalesce("model", F.lit(0.0))).alias("v"))


def dilate_sources(pixels: DataFrame, sources: DataFrame, size: int, background: DataFrame | None = None) -> DataFrame:
    """Pixels within a square of ``size`` of a source pixel take the background (image_id, ix, iy, bkg), or 0."""
    half = size // 2
    steps = F.sequence(F.lit(-half), F.lit(half))
    near = sources.select(*PIXEL, F.explode(steps).alias("dx")).select("*", F.explode(steps).alias("dy")).select("image_id", (F.col("ix") + F.col("dx")).alias("ix"), (F.col("iy") + F.col("dy")).alias("iy")).distinct().withColumn("_near", F.lit(True))
    d = pixels.join(near, PIXEL, "left")
    fill = F.lit(0.0)
    if background is not None:
        d, fill = d.join(background.select(*PIXEL, "bkg"), PIXEL, "left"), F.coalesce("bkg", F.lit(0.0))
    return d.select(*PIXEL, F.when(F.col("_near"), fill).otherwise(F.col("v")).alias("v"))


def aperture_fluxes(pixels: DataFrame, sources: DataFrame, radius: float, cell: int = 32) -> DataFrame:
    """id, flux, npix: sum of the pixels within ``radius`` of each source (image_id, id, x, y), by a join on cells of pixels."""
    d = sources
    for c in "xy":
        d = d.withColumn("t" + c, F.explode(F.sequence(F.floor((F.col(c) - radius) / cell).cast("long"), F.floor((F.col(c) + radius) / cell).cast("long"))))
    hit = image.tiled(pixels, cell, cell).join(d, ["image_id", "tx", "ty"]).filter((F.col("ix") - F.col("x")) ** 2 + (F.col("iy") - F.col("y")) ** 2 <= radius**2)
    sums = hit.groupBy("id").agg(F.sum("v").alias("flux"), F.count("*").alias("npix"))
    return sources.select("id").join(sums, "id", "left").select("id", F.coalesce("flux", F.lit(0.0)).alias("flux"), F.coalesce("npix", F.lit(0)).alias("npix"))


def local_background(pixels: DataFrame, blobs: DataFrame, margin: int, cell: int = 64) -> DataFrame:
    """blob, n, bkg, rms: median and mad·1.4826 of the pixels in each blob's box grown by ``margin``, without any source's pixels."""
    free = image.tiled(pixels.join(blobs.select(*PIXEL).distinct(), PIXEL, "left_anti"), cell, cell)
    box = blobs.groupBy("image_id", "blob").agg((F.min("ix") - margin).alias("x0"), (F.max("ix") + margin).alias("x1"), (F.min("iy") - margin).alias("y0"), (F.max("iy") + margin).alias("y1"))
    for c in "xy":
        box = box.withColumn("t" + c, F.explode(F.sequence(F.floor(F.col(c + "0") / cell).cast("long"), F.floor(F.col(c + "1") / cell).cast("long"))))
    near = free.join(box, ["image_id", "tx", "ty"]).filter(F.col("ix").between(F.col("x0"), F.col("x1")) & F.col("iy").between(F.col("y0"), F.col("y1")))
    # a box is bounded, so the built-in exact percentile serves
    m = near.groupBy("blob").agg(F.count("*").alias("n"), F.percentile(F.col("v").cast("double"), 0.5).alias("bkg"))
    return near.join(m, "blob").groupBy("blob", "n", "bkg").agg((F.percentile(F.abs(F.col("v") - F.col("bkg")), 0.5) * stats.MAD_TO_RMS).alias("rms"))


def _flood(tile: int, half: int):
    """The reconstruction inside one tile, whose pixels see ``half`` pixels beyond its border: the highest pixel left passes its value on, under the image."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ix, iy = pdf["ix"].to_numpy(), pdf["iy"].to_numpy()
        own = (ix // tile == pdf["tx"].to_numpy()) & (iy // tile == pdf["ty"].to_numpy())
        x, y = ix - ix.min() + half, iy - iy.min() + half
        shape = (x.max() + half + 1, y.max() + half + 1)
        v, top = np.full(shape, -np.inf), np.full(shape, -np.inf)
        v[x, y] = pdf["v"].to_numpy(float)
        top[x, y] = np.where(own, pdf["_top"].to_numpy(float), -np.inf)  # pixels of other tiles give and don't take
        around = [(i, j) for i in range(-half, half + 1) for j in range(-half, half + 1) if i or j]
        gives = np.zeros(len(x), bool)
        for i, j in around:
            gives |= np.minimum(v[x, y], top[x + i, y + j]) > v[x + i, y + j]
        heap = [(-v[p, q], p, q) for p, q in zip(x[gives].tolist(), y[gives].tolist())]
        heapq.heapify(heap)
        while heap:
            low, p, q = heapq.heappop(heap)
            if -low < v[p, q]:
                continue
            for i, j in around:
                m = min(-low, top[p + i, q + j])
                if m > v[p + i, q + j]:
                    v[p + i, q + j] = m
                    heapq.heappush(heap, (-m, p + i, q + j))
        return pdf[["image_id", "ix", "iy", "_top"]].assign(old=pdf["v"], v=v[x, y])[own]

    return run


def reconstruct(pixels: DataFrame, marker: DataFrame, size: int = 3, tol: float = 0.0, rounds: int | None = None, tile: int = 512) -> DataFrame:
    """image_id, ix, iy, m: morphological reconstruction: the marker is dilated under the image until it stays.

    Tiles are flooded to the end on their own, then see their neighbours' borders, until nothing moves by more than
    ``tol``; with ``rounds``, an error if that takes more of them.
    """
    half = size // 2
    base = cut_lineage(pixels.select(*PIXEL, F.col("v").cast("double").alias("_top")))
    start = marker.select(*PIXEL, F.col("v").cast("double").alias("v"))
    # one step as it is brings a marker that is above the image under it
    now = cut_lineage(image.morphology(start, "dilate", size).join(base, PIXEL).select(*PIXEL, "_top", F.least("m", "_top").alias("v")))
    cells = lambda c: F.explode(F.sequence(F.floor((F.col(c) - half) / tile).cast("long"), F.floor((F.col(c) + half) / tile).cast("long")))
    done = 0
    while True:
        seen = now.withColumn("tx", cells("ix")).withColumn("ty", cells("iy"))
        new = cut_lineage(seen.groupBy("image_id", "tx", "ty").applyInPandas(_flood(tile, half), "image_id string, ix long, iy long, _top double, old double, v double"))
        moved = new.agg(F.max(F.abs(F.col("v") - F.col("old")))).first()[0] or 0.0
        now, done = new.select(*PIXEL, "_top", "v"), done + 1
        if moved <= tol:
            break
        if done == rounds:
            raise RuntimeError(f"reconstruct: pixels still move after {rounds} rounds")
    return now.select(*PIXEL, F.col("v").alias("m"))


def h_domes(pixels: DataFrame, height: float, size: int = 3, tile: int = 512) -> DataFrame:
    """image_id, ix, iy, dome: what rises above the reconstruction of the image less ``height``."""
    low = pixels.select(*PIXEL, (F.col("v") - height).alias("v"))
    return reconstruct(pixels, low, size, tile=tile).join(pixels.select(*PIXEL, "v"), PIXEL).select(*PIXEL, (F.col("v") - F.col("m")).alias("dome"))


def guided_filter(pixels: DataFrame, radius: int = 2, eps: float = 0.1, tile: int = stencil.TILE) -> DataFrame:
    """image_id, ix, iy, smooth: edge-preserving smoothing of an image by itself, from box means of its values and squares; one shuffle."""
    line = np.ones((1, 2 * radius + 1))

    def run(grid: np.ndarray, _) -> dict[str, np.ndarray]:
        seen = np.isfinite(grid)
        v = np.nan_to_num(grid)
        box = lambda a: stencil.correlate(stencil.correlate(np.where(seen, a, 0.0), line), line.T)
        n = np.maximum(box(seen.astype(float)), 1.0)
        mean = box(v) / n
        var = box(v * v) / n - mean**2
        a = var / (var + eps)
        return {"smooth": box(a) / n * v + box(mean * (1 - a)) / n}

    return stencil.on_tiles(pixels, run, ["smooth"], 2 * radius, None, tile).select(*PIXEL, "smooth")


def circle_grid(spark, ra0: float, ra1: float, dra: float, dec0: float, dec1: float, ddec: float, radius: float) -> DataFrame:
    """name, shape, cx, cy, r: circles on a regular grid of the sky."""
    n, m = int(math.floor((ra1 - ra0) / dra + 1e-9)) + 1, int(math.floor((dec1 - dec0) / ddec + 1e-9)) + 1
    k = F.col("id")
    return spark.range(n * m).select(F.concat(F.lit("C"), k.cast("string")).alias("name"), F.lit("circle").alias("shape"), (ra0 + (k % n) * dra).alias("cx"), (dec0 + F.floor(k / n) * ddec).alias("cy"), F.lit(radius).alias("r"))
