"""Blobs: two-threshold extraction of 4-connected pixels, found in tiles and joined at their borders."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pelorus.operators import image
from pelorus.plans.runtime import cut_lineage

PIXEL = image.PIXEL


def _least_reachable(batches):
    """Labels of a small graph in one task: hook larger labels on smaller ones and halve paths until nothing moves."""
    parts = list(batches)
    if not parts:
        return
    pdf = pd.concat(parts)
    nodes, index = np.unique(np.concatenate([pdf["a"].to_numpy(), pdf["b"].to_numpy()]), return_inverse=True)
    x, y, label = index[: len(pdf)], index[len(pdf) :], np.arange(len(nodes))
    while True:
        before = label.copy()
        low = np.minimum(label[x], label[y])
        for end in (x, y):
            np.minimum.at(label, label[end], low)
            np.minimum.at(label, end, low)
        label = label[label]
        if np.array_equal(before, label):
            break
    yield pd.DataFrame({"node": nodes, "component": nodes[label]})


def label_components(edges: DataFrame, rounds: int | None = None, bounded: int = 200_000) -> DataFrame:
    """node, component of every node of edges (a, b: long): least node reachable, by hooking and pointer jumping.

    Up to ``bounded`` edges are labelled in one task. Beyond that, each round a node takes the least label of its
    neighbours and then its label's own label, so paths halve; the rounds stop when no label changes, and with ``rounds`` it is an error if
    that takes more of them. Nodes of null or self edges are no nodes.
    """
    e = cut_lineage(edges.filter("a is not null and b is not null and a <> b").select(F.col("a").cast("long"), F.col("b").cast("long")).distinct())
    if e.limit(bounded + 1).count() <= bounded:
        return e.coalesce(1).mapInPandas(_least_reachable, "node long, component long")
    both = cut_lineage(e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    now = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("c")).withColumnRenamed("a", "node")
    done = 0
    while True:
        near = both.join(now.select(F.col("node").alias("b"), F.col("c").alias("cb")), "b").groupBy("a").agg(F.min("cb").alias("cb"))
        low = now.join(near, now["node"] == near["a"]).select("node", "c", F.least("c", "cb").alias("n"))
        jump = low.select(F.col("node").alias("n"), F.col("n").alias("nn"))
        new = cut_lineage(low.join(jump, "n", "left").select("node", F.col("c").alias("old"), F.coalesce("nn", "n").alias("c")))
        changed = new.filter("c <> old").limit(1).count()
        now, done = new.select("node", "c"), done + 1
        if not changed:
            break
        if done == rounds:
            raise RuntimeError(f"label_components: labels still change after {rounds} rounds")
    return now.withColumnRenamed("c", "component")


def _label_tile(pdf: pd.DataFrame) -> pd.DataFrame:
    """Components of the pixels of one tile (its size bounds the work), by repeated least labels along rows and columns."""
    x0, y0 = pdf["ix"].min(), pdf["iy"].min()
    x, y = (pdf["ix"] - x0).to_numpy(), (pdf["iy"] - y0).to_numpy()
    grid = np.full((x.max() + 3, y.max() + 3), np.iinfo(np.int64).max)
    grid[x + 1, y + 1] = np.arange(len(x))
    on = grid != np.iinfo(np.int64).max
    while True:
        new = grid.copy()
        for axis in (0, 1):
            for step in (1, -1):
                new = np.minimum(new, np.where(on, np.roll(new, step, axis), np.iinfo(np.int64).max))
        new[~on] = np.iinfo(np.int64).max
        # pointer jumping: a label is the index of a pixel, which has a label too
        flat = new[x + 1, y + 1]
        new[x + 1, y + 1] = flat[flat]
        if np.array_equal(new, grid):
            break
        grid = new
    return pdf.assign(local=grid[x + 1, y + 1])


def find_blobs(z: DataFrame, seed: float = 5.0, merge: float = 2.6, min_pixels: int = 5, tile: int = 512) -> DataFrame:
    """image_id, ix, iy, v, blob: pixels with v >= merge in 4-connected groups that hold a seed (v >= seed) and enough pixels.

    Tiles are labelled on their own; labels that touch across a tile border are joined through a graph of border
    pixels only. ``blob`` is one number for a blob within its image.
    """
    d = image.tiled(z.filter(F.col("v") >= merge), tile, tile)
    local = d.groupBy("image_id", "tx", "ty").applyInPandas(_label_tile, "image_id string, ix long, iy long, v double, tx long, ty long, local long")
    local = cut_lineage(local.withColumn("part", F.xxhash64("image_id", "tx", "ty", "local")))
    m, n = F.pmod("ix", F.lit(tile)), F.pmod("iy", F.lit(tile))
    right = local.filter(m == tile - 1).select("image_id", (F.col("ix") + 1).alias("ix"), "iy", F.col("part").alias("a"))
    up = local.filter(n == tile - 1).select("image_id", "ix", (F.col("iy") + 1).alias("iy"), F.col("part").alias("a"))
    meets = right.join(local.filter(m == 0).select(*PIXEL, F.col("part").alias("b")), PIXEL).select("a", "b")
    meets = meets.unionByName(up.join(local.filter(n == 0).select(*PIXEL, F.col("part").alias("b")), PIXEL).select("a", "b"))
    joined = label_components(meets).withColumnRenamed("node", "part")
    d = local.join(joined, "part", "left").select(*PIXEL, "v", F.coalesce("component", "part").alias("blob"))
    good = d.groupBy("image_id", "blob").agg(F.max("v").alias("_z"), F.count("*").alias("_n")).filter((F.col("_z") >= seed) & (F.col("_n") >= min_pixels))
    return d.join(good.select("image_id", "blob"), ["image_id", "blob"], "left_semi")


def blob_moments(pixels: DataFrame) -> DataFrame:
    """Count, sums, bounds, weighted centroid and dispersion of each blob."""
    v = F.col("v")
    low = pixels.groupBy("image_id", "blob").agg(F.min("v").alias("_low"))
    d = pixels.join(low, ["image_id", "blob"]).withColumn("w", F.abs(v - F.col("_low")))
    a = d.groupBy("image_id", "blob").agg(
        F.count("*").alias("npix"), F.sum("v").alias("s"), F.min("v").alias("smin"), F.max("v").alias("smax"), (F.sum(F.col("ix") * v) / F.sum("v")).alias("xw"), (F.sum(F.col("iy") * v) / F.sum("v")).alias("yw"),
        F.sum("w").alias("_w"), F.sum(F.col("w") ** 2).alias("_w2"), *((F.sum(F.col("w") * e)).alias(n) for n, e in (("_x", F.col("ix")), ("_y", F.col("iy")), ("_xx", F.col("ix") ** 2), ("_yy", F.col("iy") ** 2), ("_xy", F.col("ix") * F.col("iy")))),
        *(f(c).alias(n) for n, f, c in (("x0", F.min, "ix"), ("x1", F.max, "ix"), ("y0", F.min, "iy"), ("y1", F.max, "iy"))),
    )
    norm = F.col("_w") - F.col("_w2") / F.col("_w")
    spread = lambda p, q, r: F.when(norm > 0, (F.col(p) - F.col(q) * F.col(r) / F.col("_w")) / norm)
    out = a.withColumns({"var_x": spread("_xx", "_x", "_x"), "var_y": spread("_yy", "_y", "_y"), "cov_xy": spread("_xy", "_x", "_y")})
    return out.drop(*(c for c in out.columns if c.startswith("_")))


def find_sources(pixels: DataFrame, box: int = 100, seed: float = 5.0, merge: float = 2.6, min_pixels: int = 5, rounds: int = 2, step: float = 0.5) -> DataFrame:
    """image_id, ix, iy, v, blob: sources found in rounds. Each round takes the background without the pixels found so far
    and a seed lower by ``step`` (never below merge); the union of what was found is flooded again into blobs."""
    rest, found = pixels, None
    for k in range(rounds):
        z = image.significance(image.interpolate(rest, image.background(rest, box, box), box, box))
        hit = find_blobs(z.select(*PIXEL, F.col("z").alias("v")), max(seed - k * step, merge), merge, min_pixels).select(*PIXEL)
        hit = cut_lineage(hit)
        found = hit if found is None else found.unionByName(hit)
        rest = cut_lineage(rest.join(hit, PIXEL, "left_anti"))
    ones = found.distinct().withColumn("v", F.lit(1.0))
    again = find_blobs(ones, 0.5, 0.4, min_pixels)
    return again.drop("v").join(pixels.select(*PIXEL, "v"), PIXEL).select(*PIXEL, "v", "blob")


def merge_at_edges(pixels: DataFrame) -> DataFrame:
    """Sources (source_id, image_id, ix, iy, v) found in overlapping or adjacent tiles, made one where their pixels touch: source_id, merged_id."""
    around = F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x in (-1, 0, 1) for y in (-1, 0, 1)))
    grown = pixels.select("source_id", "image_id", "ix", "iy", F.explode(around).alias("o")).select(F.col("source_id").alias("a"), "image_id", (F.col("ix") + F.col("o.x")).alias("ix"), (F.col("iy") + F.col("o.y")).alias("iy"))
    pairs = grown.join(pixels.select(F.col("source_id").alias("b"), *PIXEL), PIXEL).filter("a < b").select("a", "b").distinct()
    joined = label_components(pairs)
    ids = pixels.select("source_id").distinct()
    return ids.join(joined, ids["source_id"] == joined["node"], "left").select("source_id", F.coalesce("component", "source_id").alias("merged_id"))
