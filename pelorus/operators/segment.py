"""Superpixels, saliency, region merging, page rank and level sets."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pelorus.operators import image
from pelorus.plans.runtime import cut_lineage

PIXEL = image.PIXEL


def superpixels(pixels: DataFrame, size: int = 20, weight: float = 1.0, rounds: int = 3) -> DataFrame:
    """image_id, ix, iy, v, region: each pixel with the nearest of the seeds of its own and the eight cells around, in space and value.

    Seeds start as the cells of a grid and move to the means of their pixels. A pixel looks at nine candidates by
    an equi-join on grid cells, whatever the image's size.
    """
    ends = pixels.groupBy("image_id").agg(F.min("v").alias("_a"), F.max("v").alias("_b"))
    d = pixels.join(ends, "image_id").withColumn("u", F.coalesce((F.col("v") - F.col("_a")) / F.nullif(F.col("_b") - F.col("_a"), F.lit(0.0)), F.lit(0.0)))
    d = cut_lineage(image.tiled(d, size, size).select(*PIXEL, F.col("v").cast("double").alias("v"), "u", "tx", "ty"))
    seeds = d.groupBy("image_id", "tx", "ty").agg(F.avg("ix").alias("sx"), F.avg("iy").alias("sy"), F.avg("u").alias("su"))
    around = F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x in (-1, 0, 1) for y in (-1, 0, 1)))
    for _ in range(rounds):
        offered = seeds.select("image_id", F.col("tx").alias("rx"), F.col("ty").alias("ry"), "sx", "sy", "su", F.explode(around).alias("o")).select("image_id", "rx", "ry", "sx", "sy", "su", (F.col("rx") + F.col("o.x")).alias("tx"), (F.col("ry") + F.col("o.y")).alias("ty"))
        far = (F.col("u") - F.col("su")) ** 2 + weight * ((F.col("ix") - F.col("sx")) ** 2 + (F.col("iy") - F.col("sy")) ** 2) / float(size * size)
        best = d.join(offered, ["image_id", "tx", "ty"]).groupBy(*PIXEL, "v", "u", "tx", "ty").agg(F.min(F.struct(far.alias("f"), "rx", "ry")).alias("b"))
        placed = cut_lineage(best.select(*PIXEL, "v", "u", F.col("tx"), F.col("ty"), "b.rx", "b.ry"))
        seeds = placed.groupBy("image_id", F.col("rx").alias("tx"), F.col("ry").alias("ty")).agg(F.avg("ix").alias("sx"), F.avg("iy").alias("sy"), F.avg("u").alias("su"))
    return placed.select(*PIXEL, "v", (F.col("rx") * 1_000_000 + F.col("ry")).alias("region"))


def region_stats(labelled: DataFrame) -> DataFrame:
    """image_id, region, npix, mean, rms, cx, cy."""
    return labelled.groupBy("image_id", "region").agg(F.count("*").alias("npix"), F.avg("v").alias("mean"), F.coalesce(F.stddev_samp("v"), F.lit(0.0)).alias("rms"), F.avg("ix").alias("cx"), F.avg("iy").alias("cy"))


def adjacency(labelled: DataFrame) -> DataFrame:
    """image_id, a, b: regions that share a side (both ways)."""
    d = labelled.select(*PIXEL, F.col("region").alias("a"))
    moved = [labelled.select("image_id", (F.col("ix") + dx).alias("ix"), (F.col("iy") + dy).alias("iy"), F.col("region").alias("b")) for dx, dy in ((1, 0), (0, 1))]
    one = d.join(moved[0].unionByName(moved[1]), PIXEL).filter("a <> b").select("image_id", "a", "b")
    return one.unionByName(one.select("image_id", F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def dissimilarity(regions: DataFrame, falloff: float = 100.0, spatial: float = 1.0) -> DataFrame:
    """image_id, a, b, s: exp(-falloff·dc / (1 + spatial·ds)) of all pairs of an image's regions, itself included.

    All regions of an image are compared: their number is the image's area over the region size, not the data's.
    """
    ends = regions.groupBy("image_id").agg(*(f(c).alias(f"{n}_{c}") for c in ("mean", "rms", "cx", "cy") for n, f in (("lo", F.min), ("hi", F.max))))
    d = regions.join(ends, "image_id")
    unit = lambda c: F.coalesce((F.col(c) - F.col(f"lo_{c}")) / F.nullif(F.col(f"hi_{c}") - F.col(f"lo_{c}"), F.lit(0.0)), F.lit(0.0)).alias(c)
    d = d.select("image_id", "region", *map(unit, ("mean", "rms", "cx", "cy")))
    a, b = (d.select("image_id", F.col("region").alias(k), *(F.col(c).alias(f"{k}_{c}") for c in ("mean", "rms", "cx", "cy"))) for k in "ab")
    square = lambda c: (F.col(f"a_{c}") - F.col(f"b_{c}")) ** 2
    dc, ds = F.sqrt(square("mean") + square("rms")), F.sqrt(square("cx") + square("cy"))
    return a.join(b, "image_id").select("image_id", "a", "b", F.exp(-falloff * dc / (1 + spatial * ds)).alias("s"))


def saliency(regions: DataFrame, share: float = 0.1, falloff: float = 2.0) -> DataFrame:
    """image_id, region, saliency: 1 less the min-max scaled mean of the K smallest similarities, K = max(10, share·N) within N."""
    pairs = dissimilarity(regions, falloff)
    sizes = regions.groupBy("image_id").agg(F.count("*").alias("n"))
    k = F.least(F.greatest(F.lit(10), F.round(share * F.col("n"))), F.col("n"))
    order = Window.partitionBy("image_id", "a").orderBy("s", "b")
    near = pairs.join(sizes, "image_id").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    mean = near.groupBy("image_id", F.col("a").alias("region")).agg(F.avg("s").alias("m"))
    ends = mean.groupBy("image_id").agg(F.min("m").alias("lo"), F.max("m").alias("hi"))
    return mean.join(ends, "image_id").select("image_id", "region", (1 - F.coalesce((F.col("m") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)), F.lit(0.0))).alias("saliency"))


def saliency_map(pixels: DataFrame, size: int = 20) -> DataFrame:
    labelled = superpixels(pixels, size)
    return labelled.join(saliency(region_stats(labelled)), ["image_id", "region"]).select(*PIXEL, "saliency")


def merge_regions(labelled: DataFrame, rounds: int = 5) -> DataFrame:
    """image_id, region, merged: in each round adjacent regions that are each other's nearest (in mean and rms) become one."""
    mapping = labelled.select("image_id", "region").distinct().withColumn("merged", F.col("region"))
    now = labelled
    for _ in range(rounds):
        r = region_stats(now)
        side = lambda k: r.select("image_id", F.col("region").alias(k), F.col("mean").alias("m" + k), F.col("rms").alias("r" + k))
        pairs = adjacency(now).join(side("a"), ["image_id", "a"]).join(side("b"), ["image_id", "b"])
        gap = (F.col("ma") - F.col("mb")) ** 2 + (F.col("ra") - F.col("rb")) ** 2
        nearest = pairs.groupBy("image_id", "a").agg(F.min_by("b", F.struct(gap.alias("g"), F.col("b").alias("t"))).alias("b"))
        back = nearest.select("image_id", F.col("b").alias("a"), F.col("a").alias("b"))
        mutual = cut_lineage(nearest.join(back, ["image_id", "a", "b"]).filter("b < a"))
        if mutual.isEmpty():
            break
        swap = mutual.select("image_id", F.col("a").alias("old"), F.col("b").alias("new"))
        now = cut_lineage(now.join(swap.withColumnRenamed("old", "region"), ["image_id", "region"], "left").select(*PIXEL, "v", F.coalesce("new", "region").alias("region")))
        mapping = cut_lineage(mapping.join(swap.withColumnRenamed("old", "merged"), ["image_id", "merged"], "left").select("image_id", "region", F.coalesce("new", "merged").alias("merged")))
    return mapping


def page_rank(edges: DataFrame, damping: float = 0.85, tol: float = 1e-4, rounds: int = 50) -> DataFrame:
    """node, rank of a directed graph (a, b): power iteration of damping·M + (1 - damping)/N, scaled to unit length each step."""
    e = edges.filter("a is not null and b is not null").select("a", "b").distinct()
    out = e.groupBy("a").agg(F.count("*").alias("deg"))
    e = cut_lineage(e.join(out, "a"))
    nodes = cut_lineage(e.select(F.col("a").alias("node")).unionByName(e.select(F.col("b").alias("node"))).distinct())
    n = nodes.count()
    now = nodes.withColumn("rank", F.lit(1.0 / max(n, 1) ** 0.5))
    for _ in range(rounds):
        got = e.join(now.withColumnRenamed("node", "a"), "a").groupBy(F.col("b").alias("node")).agg(F.sum(F.col("rank") / F.col("deg")).alias("got"))
        total = now.agg(F.sum("rank").alias("t"))  # one row
        raw = now.join(got, "node", "left").crossJoin(F.broadcast(total)).select("node", F.col("rank").alias("old"), (damping * F.coalesce("got", F.lit(0.0)) + (1 - damping) / n * F.col("t")).alias("r"))
        size = raw.agg(F.sqrt(F.sum(F.col("r") ** 2)).alias("s"))  # one row
        new = cut_lineage(raw.crossJoin(F.broadcast(size)).select("node", "old", (F.col("r") / F.col("s")).alias("rank")))
        moved = new.agg(F.sqrt(F.sum((F.col("rank") - F.col("old")) ** 2))).first()[0] or 0.0
        now = new.select("node", "rank")
        if moved <= tol:
            break
    return now


def _chan_vese(rounds: int, smooth: float):
    """Two-phase level set on an image of one tile: pixels go with the nearer of the inside and outside means, a box filter keeps the border short."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = (pdf["ix"] - pdf["ix"].min()).to_numpy(), (pdf["iy"] - pdf["iy"].min()).to_numpy()
        img = np.zeros((x.max() + 1, y.max() + 1))
        img[x, y] = pdf["v"].to_numpy(float)
        scale = img.std() or 1.0
        # a checkerboard start reaches every part of the image
        phi = np.sin(np.pi / 5 * np.arange(img.shape[0]))[:, None] * np.sin(np.pi / 5 * np.arange(img.shape[1]))[None, :]
        for _ in range(rounds):
            inside = phi > 0
            c1, c2 = (img[inside].mean() if inside.any() else 0.0), (img[~inside].mean() if (~inside).any() else 0.0)
            force = ((img - c2) ** 2 - (img - c1) ** 2) / scale**2
            pad = np.pad(np.tanh(phi), 1, mode="edge")
            mean = sum(pad[a : a + img.shape[0], b : b + img.shape[1]] for a in range(3) for b in range(3)) / 9
            phi = phi + 0.5 * (force + smooth * (mean - np.tanh(phi)))
        inside = phi > 0
        if inside.any() and (~inside).any() and img[inside].mean() < img[~inside].mean():
            inside = ~inside
        return pdf[["image_id", "ix", "iy"]].assign(inside=inside[x, y])

    return run


_SUMS = "n1 long, s1 double, n2 long, s2 double"
_AROUND = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j]


def _tile_state(img: np.ndarray, phi: np.ndarray) -> dict:
    """The level set of a tile, its sums on either side, and its border pixels for each neighbour."""
    inside = phi > 0
    end = {-1: slice(0, 1), 0: slice(None), 1: slice(-1, None)}
    edges = {f"e{k}": np.ascontiguousarray(phi[end[i], end[j]]).tobytes() for k, (i, j) in enumerate(_AROUND)}
    return {"phi": phi.tobytes(), "n1": int(inside.sum()), "s1": float(img[inside].sum()), "n2": int((~inside).sum()), "s2": float(img[~inside].sum()), **edges}


def _start_tile(tile: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        r = pdf.iloc[0]
        x0, y0 = int(r["x0"] + r["tx"] * tile), int(r["y0"] + r["ty"] * tile)
        img = np.zeros((min(tile, int(r["x1"]) - x0 + 1), min(tile, int(r["y1"]) - y0 + 1)))
        mask = np.zeros(img.shape, bool)
        d = pdf[pdf["ix"].notna()]
        x, y = d["ix"].to_numpy(int) - x0, d["iy"].to_numpy(int) - y0
        img[x, y], mask[x, y] = d["v"].to_numpy(float), True
        wave = lambda start, n: np.sin(np.pi / 5 * (np.arange(n) + start))
        phi = wave(r["tx"] * tile, img.shape[0])[:, None] * wave(r["ty"] * tile, img.shape[1])[None, :]
        return pd.DataFrame([{"image_id": r["image_id"], "tx": r["tx"], "ty": r["ty"], "x0": x0, "y0": y0, "w": img.shape[0], "h": img.shape[1], "img": img.tobytes(), "mask": mask.tobytes(), **_tile_state(img, phi)}])

    return run


def _move_tile(smooth: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        r = pdf.iloc[0]
        shape = (int(r["w"]), int(r["h"]))
        img, phi = np.frombuffer(r["img"]).reshape(shape), np.frombuffer(r["phi"]).reshape(shape)
        force = ((img - r["c2"]) ** 2 - (img - r["c1"]) ** 2) / r["scale"] ** 2
        pad = np.pad(phi, 1, mode="edge")
        at = {-1: slice(0, 1), 0: slice(1, -1), 1: slice(-1, None)}
        # sides first; a corner beyond the image repeats the side that is there
        for k, (i, j) in sorted(enumerate(_AROUND), key=lambda e: abs(e[1][0]) + abs(e[1][1])):
            if r[f"h{k}"] is not None:
                part = pad[at[i], at[j]]
                pad[at[i], at[j]] = np.frombuffer(r[f"h{k}"]).reshape(part.shape)
            elif i and j and r[f"h{_AROUND.index((i, 0))}"] is not None:
                pad[at[i], at[j]] = pad[at[i], 1 if j < 0 else -2]
            elif i and j and r[f"h{_AROUND.index((0, j))}"] is not None:
                pad[at[i], at[j]] = pad[1 if i < 0 else -2, at[j]]
        pad = np.tanh(pad)
        mean = sum(pad[a : a + shape[0], b : b + shape[1]] for a in range(3) for b in range(3)) / 9
        new = phi + 0.5 * (force + smooth * (mean - np.tanh(phi)))
        return pd.DataFrame([{"image_id": r["image_id"], "tx": r["tx"], "ty": r["ty"], **_tile_state(img, new)}])

    return run


def _end_tile(pdf: pd.DataFrame) -> pd.DataFrame:
    r = pdf.iloc[0]
    shape = (int(r["w"]), int(r["h"]))
    inside = np.frombuffer(r["phi"]).reshape(shape) > 0
    if r["n1"] and r["n2"] and r["c1"] < r["c2"]:
        inside = ~inside
    x, y = np.nonzero(np.frombuffer(r["mask"], bool).reshape(shape))
    return pd.DataFrame({"image_id": r["image_id"], "ix": x + int(r["x0"]), "iy": y + int(r["y0"]), "inside": inside[x, y]})


def chan_vese(pixels: DataFrame, rounds: int = 100, smooth: float = 1.0, tile: int = 512) -> DataFrame:
    """image_id, ix, iy, inside: the bright phase of a two-phase segmentation of each image.

    An image within one tile is done in one task. A larger one moves by rounds: the two means and the scale are the
    image's, and tiles see one pixel beyond their border.
    """
    d = pixels.select(*PIXEL, F.col("v").cast("double").alias("v"))
    ends = cut_lineage(d.groupBy("image_id").agg(*(f(c).alias(n) for f, c, n in ((F.min, "ix", "x0"), (F.max, "ix", "x1"), (F.min, "iy", "y0"), (F.max, "iy", "y1"))), F.count("v").alias("k"), F.avg("v").alias("m"), F.var_pop("v").alias("q")))
    large = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")) >= tile
    kind = "image_id string, ix long, iy long, inside boolean"
    # a few rows an image
    small = d.join(F.broadcast(ends.filter(~large).select("image_id")), "image_id").groupBy("image_id").applyInPandas(_chan_vese(rounds, smooth), kind)
    if ends.filter(large).isEmpty():
        return small
    # places without a pixel count as 0, as they do within one tile
    area, mean = (F.col("x1") - F.col("x0") + 1) * (F.col("y1") - F.col("y0") + 1), F.col("m") * F.col("k") / F.col("area")
    var = (F.col("q") * F.col("k") + F.col("k") * (F.col("m") - mean) ** 2 + (F.col("area") - F.col("k")) * mean**2) / F.col("area")
    size = cut_lineage(ends.filter(large).withColumn("area", area).select("image_id", "x0", "x1", "y0", "y1", F.when(var > 0, F.sqrt(var)).otherwise(1.0).alias("scale")))
    box = size.select("image_id", "x0", "x1", "y0", "y1")
    cell = lambda c, lo: F.floor((F.col(c) - F.col(lo)) / tile).cast("long")
    put = d.join(F.broadcast(box), "image_id").withColumns({"tx": cell("ix", "x0"), "ty": cell("iy", "y0")})
    every = box.withColumn("tx", F.explode(F.sequence(F.lit(0).cast("long"), cell("x1", "x0")))).withColumn("ty", F.explode(F.sequence(F.lit(0).cast("long"), cell("y1", "y0"))))
    keys, edges = ["image_id", "tx", "ty"], ", ".join(f"e{k} binary" for k in range(8))
    moving = f"phi binary, {_SUMS}, {edges}"
    first = cut_lineage(put.unionByName(every, allowMissingColumns=True).groupBy(*keys).applyInPandas(_start_tile(tile), f"image_id string, tx long, ty long, x0 long, y0 long, w long, h long, img binary, mask binary, {moving}"))
    fixed, now = first.select(*keys, "x0", "y0", "w", "h", "img", "mask"), first.drop("x0", "y0", "w", "h", "img", "mask")

    def means(state: DataFrame) -> DataFrame:
        s = state.groupBy("image_id").agg(*(F.sum(c).alias(c) for c in ("n1", "s1", "n2", "s2")))
        c = lambda k: F.when(F.col("n" + k) > 0, F.col("s" + k) / F.col("n" + k)).otherwise(0.0).alias("c" + k)
        return F.broadcast(s.select("image_id", "n1", "n2", c("1"), c("2")).join(size.select("image_id", "scale"), "image_id"))

    for _ in range(rounds):
        sent = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(7 - k).alias("k"), F.col(f"e{k}").alias("e")) for k, (i, j) in enumerate(_AROUND))))
        got = now.select(*keys, sent.alias("o")).select("image_id", (F.col("tx") + F.col("o.i")).alias("tx"), (F.col("ty") + F.col("o.j")).alias("ty"), "o.k", "o.e")
        got = got.groupBy(*keys).agg(*(F.max(F.when(F.col("k") == k, F.col("e"))).alias(f"h{k}") for k in range(8)))
        state = fixed.select(*keys, "w", "h", "img").join(now.select(*keys, "phi"), keys).join(got, keys, "left").join(means(now).drop("n1", "n2"), "image_id")
        now = cut_lineage(state.groupBy(*keys).applyInPandas(_move_tile(smooth), f"image_id string, tx long, ty long, {moving}"))
    last = fixed.join(now.select(*keys, "phi"), keys).join(means(now), "image_id")
    return small.unionByName(last.groupBy(*keys).applyInPandas(_end_tile, kind))


def multi_saliency(pixels: DataFrame, sizes: tuple[int, ...] = (8, 16), share: float = 0.5) -> DataFrame:
    """image_id, ix, iy, saliency over several region sizes: a pixel that is above its map's mean in enough of them takes the largest, others the smallest."""
    maps = None
    for k, size in enumerate(sizes):
        m = saliency_map(pixels, size).withColumn("k", F.lit(k))
        maps = m if maps is None else maps.unionByName(m)
    maps = cut_lineage(maps)
    mean = maps.groupBy("image_id", "k").agg(F.avg("saliency").alias("m"))
    d = maps.join(mean, ["image_id", "k"]).groupBy(*PIXEL).agg(F.sum((F.col("saliency") > F.col("m")).cast("int")).alias("votes"), F.max("saliency").alias("hi"), F.min("saliency").alias("lo"))
    return d.select(*PIXEL, F.when(F.col("votes") >= round(share * len(sizes)), F.col("hi")).otherwise(F.col("lo")).alias("saliency"))


def valley_threshold(hist: DataFrame, size: int = 3) -> DataFrame:
    """threshold: lower edge of the first bin, after the fullest one, that is no fuller than any within ``size`` bins around."""
    w = Window.partitionBy(F.lit(1)).orderBy("bin").rangeBetween(-(size // 2), size // 2)  # a histogram has as many rows as bins
    d = hist.withColumn("least", F.min("count").over(w))
    top = hist.agg(F.max_by("bin", F.struct("count", -F.col("bin"))).alias("top"), (F.max("bin") + 1).alias("bins"))
    low = d.crossJoin(F.broadcast(top)).filter((F.col("bin") > F.col("top")) & (F.col("count") == F.col("least")))
    return low.agg(F.min_by(F.col("lo") + F.col("bin") * (F.col("hi") - F.col("lo")) / F.col("bins"), "bin").alias("threshold"))


def optimal_threshold(otsu: DataFrame, valley: DataFrame, median: DataFrame, factor: float = 1.0) -> DataFrame:
    """threshold: the larger of the median times ``factor`` and the smaller of Otsu and valley; infinite if any is missing."""
    d = otsu.select(F.col("threshold").alias("o")).crossJoin(valley.select(F.col("threshold").alias("v"))).crossJoin(median.select(F.col("median").alias("m")))  # one row each
    return d.select(F.coalesce(F.greatest(F.least("o", "v"), F.col("m") * factor) + F.col("o") * 0 + F.col("v") * 0 + F.col("m") * 0, F.lit(float("inf"))).alias("threshold"))


def _ascend(tile: int):
    """Of each pixel of one tile the place that its steepest path ends at: a peak, or the first pixel beyond the tile.

    A step goes to the best of the pixels around and the pixel itself, the largest value first, then the least place.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ix, iy = pdf["ix"].to_numpy(), pdf["iy"].to_numpy()
        own = (ix // tile == pdf["tx"].to_numpy()) & (iy // tile == pdf["ty"].to_numpy())
        x, y, v = ix - ix.min(), iy - iy.min(), pdf["v"].to_numpy(float)
        v = np.where(np.isnan(v), -np.inf, v)
        order = np.lexsort((y, x, -v))
        grid = np.full((x.max() + 3, y.max() + 3), len(v))
        grid[x[order] + 1, y[order] + 1] = np.arange(len(v))
        best = np.minimum.reduce([grid[x + i, y + j] for i in range(3) for j in range(3)])
        end = np.where(own, order[best], np.arange(len(v)))
        while not np.array_equal(end, end[end]):
            end = end[end]
        return pdf[["image_id", "ix", "iy", "v"]].assign(ex=ix[end], ey=iy[end])[own]

    return run


def watershed(pixels: DataFrame, floor: float, tile: int = 512) -> DataFrame:
    """image_id, ix, iy, v, basin: pixels above ``floor`` with the peak that they rise to, named by its place.

    Paths are followed inside tiles that see one pixel beyond their border; a path that leaves its tile goes on from
    the border pixel that it meets, and only border pixels are joined, their paths doubling until all end at peaks.
    """
    d = pixels.filter(F.col("v") > floor).select(*PIXEL, F.col("v").cast("double").alias("v"))
    cells = lambda c: F.explode(F.sequence(F.floor((F.col(c) - 1) / tile).cast("long"), F.floor((F.col(c) + 1) / tile).cast("long")))
    seen = d.withColumn("tx", cells("ix")).withColumn("ty", cells("iy"))
    local = cut_lineage(seen.groupBy("image_id", "tx", "ty").applyInPandas(_ascend(tile), "image_id string, ix long, iy long, v double, ex long, ey long"))
    border = F.pmod("ix", F.lit(tile)).isin(0, tile - 1) | F.pmod("iy", F.lit(tile)).isin(0, tile - 1)
    now = local.filter(border).select(*PIXEL, "ex", "ey")
    while True:
        ahead = now.select("image_id", F.col("ix").alias("ex"), F.col("iy").alias("ey"), F.col("ex").alias("fx"), F.col("ey").alias("fy"))
        step = cut_lineage(now.join(ahead, ["image_id", "ex", "ey"], "left").select(*PIXEL, F.coalesce("fx", "ex").alias("ex"), F.coalesce("fy", "ey").alias("ey"), (F.coalesce("fx", "ex") != F.col("ex")).alias("mx"), (F.coalesce("fy", "ey") != F.col("ey")).alias("my")))
        now = step.select(*PIXEL, "ex", "ey")
        if step.filter("mx or my").isEmpty():
            break
    peak = now.select("image_id", F.col("ix").alias("bx"), F.col("iy").alias("by"), F.col("ex").alias("fx"), F.col("ey").alias("fy"))
    d = local.withColumnRenamed("ex", "bx").withColumnRenamed("ey", "by").join(peak, ["image_id", "bx", "by"], "left")
    return d.select(*PIXEL, "v", (F.coalesce("fx", "bx") * 1_000_000_000 + F.coalesce("fy", "by")).alias("basin"))


def nested_blobs(mothers: DataFrame, inner: DataFrame, least_share: float = 0.0, largest_share: float = 0.5) -> DataFrame:
    """blob, mother: inner blobs (image_id, ix, iy, blob) whose pixels lie in one outer blob and are a small enough share of it."""
    size = mothers.groupBy("image_id", F.col("blob").alias("mother")).agg(F.count("*").alias("big"))
    hit = inner.select(*PIXEL, "blob").join(mothers.select(*PIXEL, F.col("blob").alias("mother")), PIXEL).groupBy("image_id", "blob", "mother").agg(F.count("*").alias("n"))
    own = inner.groupBy("image_id", "blob").agg(F.count("*").alias("all"))
    d = hit.join(own, ["image_id", "blob"]).filter("n = all").join(size, ["image_id", "mother"])
    return d.filter((F.col("n") / F.col("big") > least_share) & (F.col("n") / F.col("big") <= largest_share)).select("blob", "mother")
