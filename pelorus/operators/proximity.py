"""Points near other points or inside regions, by a range join on space-filling-curve codes.

Every point gets the Morton code of its unit vector in an octree (18 bits an axis; no poles, no
wrap-around). A disc is covered by the few octree cells of its own size, each a contiguous range of
codes. Points and ranges are cut into buckets at quantiles of the sorted codes, so a crowded field
is spread over many buckets, and within a bucket every range finds its slice of the sorted points
by binary search. Candidates are then refined exactly.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 18
SALT_BITS = 9
CELLS = 1 << BITS


def _spread(c: Column) -> Column:
    """Insert two zero bits between the bits of an 18-bit integer."""
    for shift, mask in ((32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249)):
        c = c.bitwiseOR(F.shiftleft(c, shift)).bitwiseAND(F.lit(mask))
    return c


def _axis(c: Column) -> Column:
    """Cell index 0..2^18-1 of a coordinate in [-1, 1]."""
    return F.least(F.greatest(F.floor((c + 1.0) * (CELLS / 2)), F.lit(0)), F.lit(CELLS - 1)).cast("long")


def morton(x: Column, y: Column, z: Column) -> Column:
    """Interleaved code of three cell indices."""
    return _spread(x).bitwiseOR(F.shiftleft(_spread(y), 1)).bitwiseOR(F.shiftleft(_spread(z), 2))


def unit_vector(ra: Column, dec: Column) -> tuple[Column, Column, Column]:
    r, d = F.radians(ra), F.radians(dec)
    return F.cos(d) * F.cos(r), F.cos(d) * F.sin(r), F.sin(d)


def valid_position(ra: Column, dec: Column) -> Column:
    """False for null, NaN, infinite or -999 coordinates and declinations beyond the poles."""
    def present(c: Column) -> Column:
        return c.isNotNull() & ~F.isnan(c) & (c != -999.0) & (F.abs(c) < 1e300)

    return present(ra) & present(dec) & (F.abs(dec) <= 90.0)


def joint_error(ra_err: Column, dec_err: Column, default: float = 1.0) -> Column:
    """Root sum of squares of the two errors; a missing part counts as ``default`` arcsec."""
    def part(c: Column) -> Column:
        return F.when(c.isNull() | F.isnan(c) | (c < 0), F.lit(default)).otherwise(c)

    a, b = part(ra_err), part(dec_err)
    return F.sqrt(a * a + b * b)


def disc_ranges(df: DataFrame, ra: Column, dec: Column, radius_deg: Column, finer: int = 0) -> DataFrame:
    """Add one row per octree cell that a disc touches: ``lo`` and ``hi`` are its salted code range.

    A cell is at least as wide as the disc (so at most 8 are met); ``finer`` halves it so many
    times for large regions, and cells off the sphere or off the disc are dropped.
    """
    # half the box edge as a chord, padded against rounding
    half = 2.0 * F.sin(F.radians(F.least(radius_deg, F.lit(180.0))) / 2.0) + 1e-9
    width = F.least(half * 2.0, F.lit(2.0))
    # shift: how many low bits a cell of this size drops from each axis index
    shift = F.greatest(F.least(F.ceil(F.log2(width * (CELLS / 2))), F.lit(BITS - 1)), F.lit(0)).cast("int")
    shift = F.greatest(shift - finer, F.lit(0))
    x, y, z = unit_vector(ra, dec)
    d = df.withColumns({"_x": x, "_y": y, "_z": z, "_h": half, "_s": shift})
    step = F.expr("shiftleft(1L, _s)")

    def span(c: str) -> Column:
        lo = F.expr(f"shiftright(cast(least(greatest(floor(({c} - _h + 1) * {CELLS // 2}), 0), {CELLS - 1}) as bigint), _s)")
        hi = F.expr(f"shiftright(cast(least(greatest(floor(({c} + _h + 1) * {CELLS // 2}), 0), {CELLS - 1}) as bigint), _s)")
        return F.sequence(lo, hi)

    for c in ("_x", "_y", "_z"):
        d = d.withColumn(c + "i", F.explode(span(c)))
    size = step.cast("double") / (CELLS / 2)

    def centre(c: str) -> Column:
        return (F.col(c + "i").cast("double") + 0.5) * size - 1.0

    cx, cy, cz = centre("_x"), centre("_y"), centre("_z")
    reach = size * (math.sqrt(3) / 2) + 1e-12
    norm = F.sqrt(cx * cx + cy * cy + cz * cz)
    off = F.sqrt((cx - F.col("_x")) ** 2 + (cy - F.col("_y")) ** 2 + (cz - F.col("_z")) ** 2)
    d = d.filter((F.abs(norm - 1.0) <= reach) & (off <= F.col("_h") + reach))
    d = d.withColumns({c + "i": F.expr(f"shiftleft({c}i, _s)") for c in ("_x", "_y", "_z")})
    first = F.shiftleft(morton(F.col("_xi"), F.col("_yi"), F.col("_zi")), SALT_BITS)
    cells = F.expr("shiftleft(1L, 3 * _s)")
    d = d.withColumn("lo", first).withColumn("hi", first + cells * (1 << SALT_BITS) - 1)
    return d.drop(*(c + s for c in ("_x", "_y", "_z") for s in ("", "i")), "_h", "_s")


def with_code(df: DataFrame, ra: str, dec: str, row_id: str) -> DataFrame:
    """Add ``lo``: the Morton code of a position with a hash of the row in the lowest bits, so that rows at one
    position can still be split."""
    x, y, z = unit_vector(F.col(ra), F.col(dec))
    d = df.withColumns({"_x": _axis(x), "_y": _axis(y), "_z": _axis(z)})
    salt = F.pmod(F.xxhash64(row_id), F.lit(1 << SALT_BITS))
    return d.withColumn("lo", F.shiftleft(morton(F.col("_x"), F.col("_y"), F.col("_z")), SALT_BITS).bitwiseOR(salt)).drop("_x", "_y", "_z")


def _sweep(want: int, k: float):
    """Stream a partition sorted by bucket, points first, then ranges of kind ``want``; emit refined pairs."""
    block = 1_000_000

    def run(batches):
        bucket, parts, pts = None, [], None
        for pdf in batches:
            keys = pdf["bucket"].to_numpy()
            for piece in np.split(np.arange(len(keys)), np.flatnonzero(np.diff(keys)) + 1):
                if not len(piece):
                    continue
                rows = pdf.iloc[piece[0] : piece[-1] + 1]
                if keys[piece[0]] != bucket:
                    bucket, parts, pts = keys[piece[0]], [], None
                kind = rows["kind"].to_numpy()
                p, q = rows[kind == 0], rows[kind == want]
                if len(p):
                    parts.append({c: p[c].to_numpy() for c in ("id", "lo", "ra", "dec", "err")})
                if not len(q) or not parts:
                    continue
                if pts is None:
                    pts = {c: np.concatenate([x[c] for x in parts]) for c in parts[0]}
                    order = np.argsort(pts["lo"], kind="stable")
                    pts = {c: v[order] for c, v in pts.items()}
                q = {c: q[c].to_numpy() for c in ("id", "lo", "hi", "ra", "dec", "err")}
                a = np.searchsorted(pts["lo"], q["lo"], "left")
                n = np.searchsorted(pts["lo"], q["hi"], "right") - a
                ends = np.concatenate([[0], np.cumsum(n)])
                # the hits of all ranges as one numbering, taken in blocks
                for first in range(0, int(ends[-1]), block):
                    hit = np.arange(first, min(first + block, int(ends[-1])))
                    i = np.searchsorted(ends, hit, "right") - 1
                    yield _refine(want, q, i, pts, a[i] + hit - ends[i], k)

    return run


def _refine(want: int, q: dict, i: np.ndarray, p: dict, j: np.ndarray, k: float) -> pd.DataFrame:
    """Pairs of points within ``k`` joint errors, each reported by its larger-error end; or points within a cap."""
    e1, e2 = q["err"][i], p["err"][j]
    if want == 1:
        a, b = q["id"][i], p["id"][j]
        keep = ((e1 > e2) | ((e1 == e2) & (a < b))) & (a != b)
        i, j, e1, e2 = i[keep], j[keep], e1[keep], e2[keep]
    r1, d1, r2, d2 = (np.radians(v) for v in (q["ra"][i], q["dec"][i], p["ra"][j], p["dec"][j]))
    h = np.sin((d2 - d1) / 2) ** 2 + np.cos(d1) * np.cos(d2) * np.sin((r2 - r1) / 2) ** 2
    sep = np.degrees(2 * np.arcsin(np.minimum(1.0, np.sqrt(h)))) * 3600.0
    keep = sep <= k * np.sqrt(e1 * e1 + e2 * e2) if want == 1 else sep <= e1 * (1 + 1e-9) + 1e-3
    i, j = i[keep], j[keep]
    a, b = q["id"][i], p["id"][j]
    one, two = (np.minimum(a, b), np.maximum(a, b)) if want == 1 else (b, a)
    return pd.DataFrame({"id_1": one, "id_2": two, "ra": p["ra"][j], "dec": p["dec"][j]})


def proximity_join(points: DataFrame, regions: DataFrame | None, k_sigma: float = 3.0, bucket_rows: int = 50_000) -> tuple[DataFrame, DataFrame]:
    """Two frames: id_1, id_2 of two points within ``k_sigma`` joint errors (exact); and id_1, id_2, ra, dec of a
    point within the bounding cap of a region (to be refined by shape).

    points: id, ra, dec (valid degrees), err (arcsec). regions: id, ra, dec, cap (deg) or None.
    A pair is searched by the end with the larger error, whose disc of radius k·√2·err holds the other.
    ``bucket_rows`` bounds the points of one bucket; ranges stream past them. Rows with a null id are no points.
    Empty inputs give an empty result.
    """
    spark = points.sparkSession
    points = points.filter(F.col("id").isNotNull()).select("id", (F.pmod(F.col("ra"), F.lit(360.0))).alias("ra"), "dec", "err")
    coded = with_code(points, "ra", "dec", "id")
    n = coded.count()
    buckets = max(1, -(-n // bucket_rows), min(spark.sparkContext.defaultParallelism, n // 2000))
    # as many cut points as buckets: a few thousand numbers for a hundred million rows
    cuts = coded.agg(F.percentile_approx("lo", [b / buckets for b in range(1, buckets)], 20 * buckets)).first()[0] if buckets > 1 else []
    cuts = sorted(set(cuts or []))
    discs = points.withColumns({"kind": F.lit(1), "cap": F.col("err") * (k_sigma * math.sqrt(2) / 3600.0)})
    discs = disc_ranges(discs, F.col("ra"), F.col("dec"), F.col("cap"))
    if regions is not None:
        caps = regions.filter(F.col("id").isNotNull() & F.col("cap").isNotNull()).select("id", (F.pmod(F.col("ra"), F.lit(360.0))).alias("ra"), "dec", (F.col("cap") * 3600.0).alias("err"), F.lit(2).alias("kind"), "cap")
        discs = discs.unionByName(disc_ranges(caps, F.col("ra"), F.col("dec"), F.col("cap"), finer=2))

    def place(c: str) -> Column:
        """Number of cuts below a code, by halving the sorted array."""
        if not cuts:
            return F.lit(0)
        edges = F.lit([int(x) for x in cuts])
        steps = F.lit([1 << s for s in reversed(range(len(cuts).bit_length()))])
        return F.aggregate(steps, F.lit(0), lambda at, s: F.when(F.get(edges, at + s - 1) < F.col(c), at + s).otherwise(at))

    coded = coded.withColumn("bucket", place("lo"))
    discs = discs.withColumn("bucket", F.explode(F.sequence(place("lo"), place("hi"))))
    cols = ["bucket", "kind", "id", "lo", "hi", "ra", "dec", "err"]
    both = coded.withColumns({"kind": F.lit(0), "hi": F.col("lo")}).select(cols).unionByName(discs.select(cols))
    both = both.repartition(max(1, min(buckets, 20_000)), "bucket").sortWithinPartitions("bucket", "kind")
    # the cells of one disc are disjoint ranges, so no pair comes out twice; both sweeps read the same exchange
    schema = "id_1 long, id_2 long, ra double, dec double"
    return both.mapInPandas(_sweep(1, k_sigma), schema).select("id_1", "id_2"), both.mapInPandas(_sweep(2, k_sigma), schema)


def _signed(c: Column) -> Column:
    """An angle folded to [-180, 180)."""
    return F.pmod(c + 180.0, F.lit(360.0)) - 180.0


def region_caps(regions: DataFrame) -> DataFrame:
    """Bounding cap (centre and radius in degrees) of circles, boxes and polygons; cap is null for what holds nothing.

    Polygon right ascensions are unwrapped vertex by vertex, so sides across 0 or 360 stay short.
    """
    v = F.col("verts")
    unwrapped = F.aggregate(
        v,
        F.array().cast("array<struct<x:double,y:double>>"),
        lambda acc, p: F.concat(acc, F.array(F.struct(
            F.when(F.size(acc) == 0, p["x"]).otherwise(F.element_at(acc, -1)["x"] + _signed(p["x"] - F.element_at(acc, -1)["x"])).alias("x"), p["y"].alias("y")))),
    )
    good = F.col("verts").isNotNull() & (F.size("verts") >= 3) & ~F.exists("verts", lambda p: p.isNull() | p["x"].isNull() | p["y"].isNull() | F.isnan(p["x"]) | F.isnan(p["y"]))
    d = regions.withColumn("poly", F.when((F.col("shape") == "polygon") & good, unwrapped))
    xs, ys = F.transform("poly", lambda p: p["x"]), F.transform("poly", lambda p: p["y"])
    is_poly, is_box, is_circle = (F.col("shape") == s for s in ("polygon", "box", "circle"))
    d = d.withColumns({
        "x0": F.when(is_poly, F.array_min(xs)).when(is_box, F.col("cx") - F.col("w") / 2).otherwise(F.col("cx")),
        "x1": F.when(is_poly, F.array_max(xs)).when(is_box, F.col("cx") + F.col("w") / 2).otherwise(F.col("cx")),
        "y0": F.when(is_poly, F.array_min(ys)).when(is_box, F.col("cy") - F.col("h") / 2).otherwise(F.col("cy")),
        "y1": F.when(is_poly, F.array_max(ys)).when(is_box, F.col("cy") + F.col("h") / 2).otherwise(F.col("cy")),
    })
    lat0, lat1 = F.greatest(F.col("y0"), F.lit(-90.0)), F.least(F.col("y1"), F.lit(90.0))
    flat = F.when((lat0 <= 0) & (lat1 >= 0), F.lit(1.0)).otherwise(F.cos(F.radians(F.least(F.abs(lat0), F.abs(lat1)))))
    # along the meridian, then along the parallel: no shorter than the great circle
    rect = (lat1 - lat0) / 2 + F.least((F.col("x1") - F.col("x0")) / 2, F.lit(180.0)) * flat + 1e-9
    radius = F.col("r") / 3600.0
    cap = F.when(is_circle & F.col("r").isNotNull() & ~F.isnan("r") & (F.col("r") >= 0), radius).when((is_box | is_poly) & (F.col("x1") >= F.col("x0")) & (lat1 >= lat0), F.least(rect, F.lit(180.0)))
    ra = F.when(is_circle, F.col("cx")).otherwise((F.col("x0") + F.col("x1")) / 2)
    dec = F.when(is_circle, F.col("cy")).otherwise((lat0 + lat1) / 2)
    ok = ~F.isnan(ra) & ~F.isnan(dec) & (F.abs(dec) <= 90)
    return d.withColumns({"ra": ra, "dec": dec, "cap": F.when(ok & ~F.isnan(cap), cap)})


def inside_region(ra: Column, dec: Column) -> Column:
    """Exact test of a position against the columns of region_caps: shape, cx, cy, r, w, h, poly, x0, x1."""
    d1, d2 = F.radians(dec), F.radians(F.col("cy"))
    h = F.sin((d2 - d1) / 2) ** 2 + F.cos(d1) * F.cos(d2) * F.sin(F.radians(F.col("cx") - ra) / 2) ** 2
    circle = F.degrees(F.asin(F.least(F.lit(1.0), F.sqrt(h))) * 2) * 3600.0 <= F.col("r")
    box = (F.abs(_signed(ra - F.col("cx"))) <= F.col("w") / 2) & (F.abs(dec - F.col("cy")) <= F.col("h") / 2)
    mid = (F.col("x0") + F.col("x1")) / 2
    x = mid + _signed(ra - mid)
    n = F.size("poly")

    def crosses(p: Column, i: Column) -> Column:
        q = F.element_at(F.col("poly"), F.when(i + 2 > n, F.lit(1)).otherwise(i + 2))
        # the last side closes the ring to the first vertex, by the shorter way
        qx = p["x"] + _signed(q["x"] - p["x"])
        straddles = (p["y"] > dec) != (q["y"] > dec)
        return F.when(straddles & (x < (qx - p["x"]) * (dec - p["y"]) / (q["y"] - p["y"]) + p["x"]), 1).otherwise(0)

    odd = F.aggregate(F.transform("poly", crosses), F.lit(0), lambda a, b: a + b) % 2 == 1
    return F.when(F.col("shape") == "circle", circle).when(F.col("shape") == "box", box).when(F.col("shape") == "polygon", odd).otherwise(False)


def near_and_inside(objects: DataFrame, regions: DataFrame, k_sigma: float = 3.0, bucket_rows: int = 50_000) -> DataFrame:
    """kind, id_1, id_2: objects within their joint errors (``near``, smaller id first) and objects in regions (``inside``).

    objects: obj_id, ra, dec, ra_err, dec_err; regions: region_id, shape, cx, cy, r, w, h, verts. Objects without a
    usable position match nothing; a null or negative error part counts as 1 arcsec; repeated objects are near
    each other. Regions without extent hold nothing. Other columns are ignored; empty tables give no rows.
    """
    ok = objects.filter(valid_position(F.col("ra"), F.col("dec")))
    points = ok.select(F.col("obj_id").alias("id"), "ra", "dec", joint_error(F.col("ra_err"), F.col("dec_err")).alias("err"))
    shapes = region_caps(regions.select("region_id", "shape", "cx", "cy", "r", "w", "h", "verts"))
    caps = shapes.select(F.col("region_id").alias("id"), "ra", "dec", "cap")
    near, capped = proximity_join(points, caps, k_sigma, bucket_rows)
    near = near.select(F.lit("near").alias("kind"), "id_1", "id_2")
    held = (
        capped.withColumnsRenamed({"ra": "pra", "dec": "pdec"})
        .join(shapes.drop("ra", "dec", "cap").withColumnRenamed("region_id", "id_2"), "id_2")
        .filter(inside_region(F.col("pra"), F.col("pdec")))
        .select(F.lit("inside").alias("kind"), "id_1", "id_2")
    )
    return near.unionByName(held)
