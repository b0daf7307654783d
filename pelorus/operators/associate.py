"""Association of sources by shape: overlapping boxes and outlines, sources at tile edges, maximal cliques, groups and types.

Candidates come from a hash join on cells that each box or search disc meets; what the cells let through is refined exactly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pelorus.functions import scalars
from pelorus.operators import match, shapes
from pelorus.plans.runtime import cut_lineage, shuffle_partitions

# fixed values: morphology ids and the colours of their regions
UNKNOWN, COMPACT, POINT_LIKE, EXTENDED, COMPACT_PLUS_EXTENDED, DIFFUSE = range(6)
COLOURS = {EXTENDED: "green", COMPACT_PLUS_EXTENDED: "magenta", POINT_LIKE: "red", COMPACT: "blue", DIFFUSE: "yellow"}
BOX = ("x0", "x1", "y0", "y1")


def boxes_overlap(a, b) -> Column:
    """Whether two boxes (each a tuple x0, x1, y0, y1 of columns) share more than a border."""
    return (a[0] < b[1]) & (b[0] < a[1]) & (a[2] < b[3]) & (b[2] < a[3])


def centroid_distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x1 - x2) ** 2 + (y1 - y2) ** 2)


def box_overlap_join(left: DataFrame, right: DataFrame, cell: float) -> DataFrame:
    """left_id, right_id of rows (id, x0, x1, y0, y1) whose boxes overlap, once each.

    A box is exploded to the cells of side ``cell`` that it meets; a pair counts in the lowest cell that both meet. Boxes with a
    null or NaN bound overlap nothing. Choose a cell about as large as a usual box.
    """
    def spread(d: DataFrame, name: str) -> DataFrame:
        d = d.select(F.col("id").alias(f"{name}_id"), *(F.col(c).cast("double").alias(f"{name}_{c}") for c in BOX))
        d = d.filter(" and ".join(f"{name}_{c} is not null and not isnan({name}_{c})" for c in BOX))
        for axis in "xy":
            d = d.withColumn("c" + axis, F.explode(F.sequence(*(F.floor(F.col(f"{name}_{axis}{k}") / cell).cast("long") for k in (0, 1)))))
        return d

    d = spread(left, "left").join(spread(right, "right"), ["cx", "cy"])
    first = lambda axis: F.col("c" + axis) == F.floor(F.greatest(f"left_{axis}0", f"right_{axis}0") / cell)
    ends = [tuple(F.col(f"{n}_{c}") for c in BOX) for n in ("left", "right")]
    return d.filter(boxes_overlap(*ends) & first("x") & first("y")).select("left_id", "right_id")


def convex_corners(verts: Column) -> Column:
    """x, y, x, y, ... of the convex outline of an array of struct x, y, anticlockwise; null for fewer than three points."""
    @F.arrow_udf("array<double>")
    def run(flat: pa.Array) -> pa.Array:
        xs, ys, n = shapes.padded(flat)
        # strict left turns at up to four corners: it is its own outline
        ex, ey = np.roll(xs[:, :4], -1, 1) - xs[:, :4], np.roll(ys[:, :4], -1, 1) - ys[:, :4]
        left = (ex * np.roll(ey, -1, 1) - ey * np.roll(ex, -1, 1) > 0).all(1) & (n == 4) if xs.shape[1] >= 4 else np.zeros(len(n), bool)
        out = np.full(len(n), None, object)
        for k in np.flatnonzero(~left & (n >= 3)):
            out[k] = shapes.outline(xs[k, : n[k]], ys[k, : n[k]]).ravel()
        for k, corners in zip(np.flatnonzero(left), np.stack([xs[left, :4], ys[left, :4]], 2).reshape(-1, 8) if left.any() else ()):
            out[k] = corners
        return pa.array(out, pa.list_(pa.float64()))

    return run(F.flatten(F.transform(verts, lambda v: F.array(v["x"].cast("double"), v["y"].cast("double")))))


def outline_overlap(left: Column, right: Column) -> Column:
    """struct(area1, area2, overlap, flag) of two outlines as of ``convex_corners``; flag 0 apart, 1 overlapping, 2 the first inside
    the second, 3 the second inside the first. Null if one is null."""
    kind = pa.struct([("area1", pa.float64()), ("area2", pa.float64()), ("overlap", pa.float64()), ("flag", pa.int32())])

    @F.arrow_udf("struct<area1:double,area2:double,overlap:double,flag:int>")
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        (ax, ay, n), (bx, by, m) = shapes.padded(a), shapes.padded(b)
        s1, s2 = (np.where(shapes.is_box(*z), np.ptp(z[0], axis=1) * np.ptp(z[1], axis=1), shapes.areas(*z[:2])) for z in ((ax, ay, n), (bx, by, m)))
        s = np.zeros(len(n))
        box = shapes.is_box(ax, ay, n) & shapes.is_box(bx, by, m)
        side = lambda p, q: np.maximum(np.minimum(p[box].max(1), q[box].max(1)) - np.maximum(p[box].min(1), q[box].min(1)), 0)
        s[box] = side(ax, bx) * side(ay, by)
        rest = np.flatnonzero(~box & (s1 != 0) & (s2 != 0) & (n > 0) & (m > 0))
        s[rest] = shapes.common_areas(ax[rest], ay[rest], bx[rest], by[rest])
        none = pa.array((n == 0) | (m == 0))
        flag = pa.array(shapes.overlap_flag(s, s1, s2, 1e-9).astype(np.int32))
        return pa.StructArray.from_arrays([*map(pa.array, (s1, s2, s)), flag], fields=list(kind), mask=none)

    # an expression that may not be repeated: it is computed once a pair
    return run.asNondeterministic()(left, right)


def shape_match(left: DataFrame, right: DataFrame, radius: float, overlap: float | None = None, area_ratio: bool = False, flux_difference: float | None = None, high_radius: float | None = None) -> DataFrame:
    """left_id, right_id, dist, overlap1, overlap2, flux_diff of rows (id, x, y, flux, verts: a convex outline) that match.

    They match if their centres lie within ``radius``; with ``overlap`` their outlines must share so large a part of both, and
    if one lies within the other, that is enough (with ``area_ratio`` the part of the larger counts); with ``high_radius``
    outlines that share too little still match that close together. ``flux_difference`` bounds |f1 - f2| / f2; a second flux that is
    null or not positive differs by 0. A row without an outline overlaps nothing.
    """
    # outlines once a row, and with it through the one join
    rows = [r.select("id", "x", "y", "flux", convex_corners(F.col("verts")).alias("c")) for r in (left, right)]
    d = match.box_join(*rows, radius, carry=("flux", "c"), parts=shuffle_partitions(left.sparkSession)).filter(F.col("dist") <= radius)
    d = d.withColumnsRenamed({"left_flux": "f1", "right_flux": "f2"})
    d = d.withColumn("flux_diff", F.when(F.col("f2") > 0, (F.col("f1") - F.col("f2")) / F.col("f2")).otherwise(0.0))
    if flux_difference is not None:
        d = d.filter(F.abs("flux_diff") <= flux_difference)
    d = d.withColumn("_o", outline_overlap(F.col("left_c"), F.col("right_c")))
    d = d.withColumns({"overlap1": F.try_divide("_o.overlap", "_o.area1"), "overlap2": F.try_divide("_o.overlap", "_o.area2")})
    if overlap is not None:
        flag = F.col("_o.flag")
        inside = (flag == 2) & (F.col("overlap2") >= overlap) | (flag == 3) & (F.col("overlap1") >= overlap) if area_ratio else flag.isin(2, 3)
        enough = inside | (flag == 1) & (F.col("overlap1") >= overlap) & (F.col("overlap2") >= overlap)
        if high_radius is not None:
            enough = enough | (flag >= 1) & (F.col("dist") <= high_radius)
        d = d.filter(F.coalesce(enough, F.lit(False)))
    return d.select("left_id", "right_id", "dist", "overlap1", "overlap2", "flux_diff")


def overlap_reliability(found: DataFrame, truth: DataFrame, least: float) -> DataFrame:
    """source_id, is_real of every found extended source (source_id, pixel_id): whether some true one shares enough of its pixels."""
    real = match.overlap_match(found, truth, least).select(F.col("left_id").alias("source_id"), F.lit(True).alias("_r"))
    return found.select("source_id").distinct().join(real, "source_id", "left").select("source_id", F.coalesce("_r", F.lit(False)).alias("is_real"))


def at_edge(sources: DataFrame, tiles: DataFrame) -> DataFrame:
    """Sources (id, tile_id, x0, x1, y0, y1) with ``at_edge``: those that touch the border of their tile, or overlap another one.

    tiles: tile_id, x0, x1, y0, y1. A source of no tile is at no edge.
    """
    own = tiles.select("tile_id", *(F.col(c).alias("_" + c) for c in BOX))
    d = sources.join(own, "tile_id", "left")
    touch = (F.col("x0") <= F.col("_x0")) | (F.col("x1") >= F.col("_x1")) | (F.col("y0") <= F.col("_y0")) | (F.col("y1") >= F.col("_y1"))
    near = match.near_tiles(tiles)
    near = near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b")))
    other = near.join(tiles.select(F.col("tile_id").alias("b"), *(F.col(c).alias("n" + c) for c in BOX)), "b").withColumnRenamed("a", "tile_id")
    over = sources.join(other, "tile_id").filter(boxes_overlap(tuple(F.col(c) for c in BOX), tuple(F.col("n" + c) for c in BOX))).select("id").distinct().withColumn("_over", F.lit(True))
    return d.join(over, "id", "left").select(*sources.columns, (F.coalesce(touch, F.lit(False)) | F.coalesce("_over", F.lit(False))).alias("at_edge"))


def adjacency(edges: DataFrame) -> DataFrame:
    """a, b, linked both ways of an undirected graph, each once: the non-zero cells of its adjacency matrix; null ends link nothing."""
    e = edges.filter("a is not null and b is not null").select("a", "b")
    return e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def maximal_cliques(edges: DataFrame, most: int) -> DataFrame:
    """members: sorted arrays of the cliques of two nodes or more to which no node can be added.

    For graphs whose cliques hold ``most`` nodes at most, as of sources of so many catalogues; a larger clique is an error, not cut.
    """
    e = cut_lineage(match.ordered_edges(edges))
    now, out = e.select(F.array("a", "b").alias("m")), None
    for size in range(2, most + 1):
        larger = cut_lineage(match.grown_cliques(now, e))
        # a clique is part of a larger one if it is that one without one of its nodes
        part = larger.select("m", F.posexplode("m").alias("k", "x")).select(F.filter("m", lambda v: v != F.col("x")).alias("m")).distinct()
        whole = now.join(part, "m", "left_anti")
        out = whole if out is None else out.unionByName(whole)
        now = larger
    if not now.isEmpty():
        raise ValueError(f"a clique holds more than {most} nodes")
    return out.select(F.sort_array("m").alias("members"))


def group_summary(members: DataFrame) -> DataFrame:
    """group_id, names (sorted, missing ones last), n, n_catalogues, flux, freq (GHz, of the first member) of groups of matched sources.

    members: group_id, catalog, name, flux, freq (Hz). A group holds a few members of each catalogue. The first member is that of the
    least text catalog|name|, so of 4 and 48 it is 48; at equal text the lowest frequency. Members without one of the three aren't first.
    """
    key = F.concat("catalog", F.lit("|"), "name", F.lit("|"))
    first = F.min(F.when(key.isNotNull() & F.col("freq").isNotNull(), F.struct(key.alias("k"), F.col("freq").alias("f"))))
    unnamed = F.array_repeat(F.lit(None).cast("string"), (F.count("*") - F.count("name")).cast("int"))
    d = members.groupBy("group_id").agg(F.concat(F.array_sort(F.collect_list("name")), unnamed).alias("names"), F.count("*").alias("n"), F.countDistinct("catalog").alias("n_catalogues"), F.sum("flux").alias("flux"), first.alias("_f"))
    return d.select("group_id", "names", "n", "n_catalogues", "flux", (F.col("_f.f") / 1e9).alias("freq"))


def merge_pixels(pixels: DataFrame, merged: DataFrame, sum_shared: bool = False) -> DataFrame:
    """blob, image_id, ix, iy, v of blobs merged into others: a pixel of several blobs counts once, with the value of the smallest id
    or, if asked, with their sum. merged: blob, into."""
    d = pixels.join(merged.select("blob", "into"), "blob", "left").withColumn("_to", F.coalesce("into", "blob"))
    g = d.groupBy(F.col("_to").alias("blob"), "image_id", "ix", "iy")
    if sum_shared:
        return g.agg(F.sum("v").alias("v"))
    return g.agg(F.min(F.struct(F.col("blob").alias("b"), "v")).alias("m")).select("blob", "image_id", "ix", "iy", "m.v")


# types of sources: each cut is optional
def is_good(npix: Column, min_box: Column, least_box: float | None = None) -> Column:
    """A source with pixels; with the cut, one whose outline isn't too narrow. Without an outline (null) it is good."""
    wide = F.lit(True) if least_box is None else min_box.isNull() | (min_box >= least_box)
    return F.coalesce(npix > 0, F.lit(False)) & wide


def is_point_like(contours: Column, npix: Column, beam_area: Column, circularity: float | None = None, elongation: float | None = None, ellipse_ratio: tuple[float, float] | None = None, beams: float | None = None, most_pixels: int | None = None) -> Column:
    """Every contour (struct circularity, elongation, ellipse_ratio) round enough, and the source small enough; no contour passes. A contour
    without an ellipse passes that cut, a source without a beam that of the beams."""
    def round_(c: Column) -> Column:
        tests = [F.lit(True)]
        if circularity is not None:
            tests.append(c["circularity"] >= circularity)
        if elongation is not None:
            tests.append(c["elongation"] <= elongation)
        if ellipse_ratio is not None:
            tests.append(c["ellipse_ratio"].isNull() | c["ellipse_ratio"].between(*ellipse_ratio))
        out = tests[0]
        for t in tests[1:]:
            out = out & F.coalesce(t, F.lit(False))
        return out

    small = F.lit(True)
    if beams is not None:
        small = small & F.coalesce((beam_area <= 0) | (F.try_divide(npix.cast("double"), beam_area) <= beams), F.lit(True))
    if most_pixels is not None:
        small = small & F.coalesce(npix <= most_pixels, F.lit(False))
    return F.coalesce(F.forall(contours, round_), F.lit(True)) & small


def is_fittable(morph: Column, npix: Column, beam_area: Column, most_beams: float) -> Column:
    """Point-like sources, and compact ones of few enough beams."""
    few = F.when(beam_area > 0, npix / beam_area <= most_beams).otherwise(F.lit(0.0) <= most_beams)
    return F.coalesce((morph == POINT_LIKE) | ((morph == COMPACT) & few), F.lit(False))


def region_colour(morph: Column) -> Column:
    out = F.lit("white")
    for k, colour in COLOURS.items():
        out = F.when(morph == k, colour).otherwise(out)
    return out


def tagged_regions(regions: DataFrame, selected: DataFrame) -> DataFrame:
    """Regions (name, tags) with the tag ``selected`` or ``rejected`` by whether their name is in a list; a region without a name is rejected."""
    on = selected.select("name").filter("name is not null").distinct().withColumn("_on", F.lit(True))
    d = regions.join(on, "name", "left")
    tag = F.array(F.when(F.col("_on"), F.lit("selected")).otherwise(F.lit("rejected")))
    return d.withColumn("tags", F.concat(F.coalesce("tags", F.array().cast("array<string>")), tag)).select(*regions.columns)


def flux_error(amp: Column, sx: Column, sy: Column, cov: Column) -> Column:
    """Error of the flux 2 pi A sx sy from the covariance (array of three rows) of A, sx, sy; a negative variance gives 0."""
    k = 2 * np.pi
    grad = F.array(k * sx * sy, k * amp * sy, k * amp * sx)
    term = lambda i, j: F.get(grad, F.lit(i)) * F.get(grad, F.lit(j)) * F.get(F.get(cov, F.lit(i)), F.lit(j))
    var = sum((term(i, j) for i in range(3) for j in range(3)), F.lit(0.0))
    return F.sqrt(F.greatest(var, F.lit(0.0)))


def without_components(components: Column, cov: Column, removed: Column, pars: int) -> tuple[Column, Column]:
    """Components at other positions than ``removed``, and the covariance (array of rows, ``pars`` a component) without their rows and columns."""
    keep = lambda i: ~F.array_contains(removed, F.floor(i / pars).cast("int"))
    kept = F.transform(F.filter(cov, lambda _, i: keep(i)), lambda row: F.filter(row, lambda _, i: keep(i)))
    return scalars.without_positions(components, removed), kept
