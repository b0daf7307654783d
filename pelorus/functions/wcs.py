"""Pixel and sky coordinates as columns, for the TAN, SIN and CAR projections without rotation terms beyond CROTA."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pelorus.functions import scalars


def pixel_to_sky(ix: Column, iy: Column, cx: Column, cy: Column, xc: Column, yc: Column, dx: Column, dy: Column, projection: str = "TAN", rotation: Column | None = None) -> Column:
    """struct(ra, dec) in degrees of a pixel (from 0); cx, cy is the reference pixel (from 1), xc, yc its sky position."""
    u, v = (ix + 1 - cx) * dx, (iy + 1 - cy) * dy
    if rotation is not None:
        c, s = F.cos(F.radians(rotation)), F.sin(F.radians(rotation))
        u, v = u * c - v * s, u * s + v * c
    if projection == "CAR":
        return F.struct(F.pmod(xc + u, F.lit(360.0)).alias("ra"), (yc + v).alias("dec"))
    x, y, d0 = F.radians(u), F.radians(v), F.radians(yc)
    if projection == "TAN":
        z = 1.0 / F.sqrt(1.0 + x * x + y * y)
        x, y = x * z, y * z
    else:
        z = F.sqrt(F.greatest(1.0 - x * x - y * y, F.lit(0.0)))
    dec = F.asin(F.least(F.greatest(z * F.sin(d0) + y * F.cos(d0), F.lit(-1.0)), F.lit(1.0)))
    ra = xc + F.degrees(F.atan2(x, z * F.cos(d0) - y * F.sin(d0)))
    return F.struct(F.pmod(ra, F.lit(360.0)).alias("ra"), F.degrees(dec).alias("dec"))


def sky_to_pixel(ra: Column, dec: Column, cx: Column, cy: Column, xc: Column, yc: Column, dx: Column, dy: Column, projection: str = "TAN") -> Column:
    """struct(ix, iy): the inverse of pixel_to_sky; null on the far side of a TAN or SIN projection."""
    if projection == "CAR":
        du = F.pmod(ra - xc + 180.0, F.lit(360.0)) - 180.0
        return F.struct((du / dx + cx - 1).alias("ix"), ((dec - yc) / dy + cy - 1).alias("iy"))
    a, d, d0 = F.radians(ra - xc), F.radians(dec), F.radians(yc)
    z = F.sin(d) * F.sin(d0) + F.cos(d) * F.cos(d0) * F.cos(a)
    x, y = F.cos(d) * F.sin(a), F.sin(d) * F.cos(d0) - F.cos(d) * F.sin(d0) * F.cos(a)
    if projection == "TAN":
        x, y = x / z, y / z
    return F.when(z > 0, F.struct((F.degrees(x) / dx + cx - 1).alias("ix"), (F.degrees(y) / dy + cy - 1).alias("iy")))


def contour_to_sky(verts: Column, *head: Column, offset: float = 0.0, projection: str = "TAN") -> Column:
    """An array of struct(x, y) in pixels as struct(x, y) in degrees; ``offset`` is added to the pixels first."""
    def project(p: Column) -> Column:
        return scalars.let(pixel_to_sky(p["x"] + offset, p["y"] + offset, *head, projection=projection), lambda s: F.struct(s["ra"].alias("x"), s["dec"].alias("y")))

    return F.transform(verts, project)


def ellipse_to_sky(e: Column, *head: Column, offset: float = 0.0, projection: str = "TAN") -> Column:
    """struct(x, y, r1, r2, theta) in degrees of an ellipse in pixels (semi-axes, theta from the x axis).

    The axes are the great-circle distances to the ends of both; the minor one is what stands upright on the major; theta is
    90 degrees less the bearing of the major axis, since right ascension grows to the left.
    """
    x, y, t = e["x"] + offset, e["y"] + offset, F.radians(e["theta"])
    at = lambda a, b: pixel_to_sky(a, b, *head, projection=projection)
    points = F.struct(at(x, y).alias("c"), at(x + e["r1"] * F.cos(t), y + e["r1"] * F.sin(t)).alias("a"), at(x + e["r2"] * F.sin(t), y - e["r2"] * F.cos(t)).alias("b"))

    def ends(p: Column) -> Column:
        way = lambda f, q: f(p["c"]["ra"], p["c"]["dec"], p[q]["ra"], p[q]["dec"])
        skew = way(scalars.bearing, "a") - way(scalars.bearing, "b") + 90
        return F.struct(p["c"]["ra"].alias("x"), p["c"]["dec"].alias("y"), way(scalars.haversine, "a").alias("r1"), (way(scalars.haversine, "b") * F.abs(F.cos(F.radians(skew)))).alias("r2"), (90 - way(scalars.bearing, "a")).alias("theta"))

    return scalars.let(points, ends)


def ellipse_to_sky_simple(e: Column, *head: Column, projection: str = "TAN") -> Column:
    """The same by the pixel sizes alone: semi-axes times the pixel size along x, theta kept."""
    size = F.abs(head[4])
    return scalars.let(pixel_to_sky(e["x"], e["y"], *head, projection=projection), lambda s: F.struct(s["ra"].alias("x"), s["dec"].alias("y"), (e["r1"] * size).alias("r1"), (e["r2"] * size).alias("r2"), e["theta"].alias("theta")))


def sky_string(ra: Column, dec: Column, system: str = "FK5") -> Column:
    """"HH:MM:SS.sss +DD:MM:SS.ss system" of a position in degrees, rounded in the last place, never to 60."""
    def parts(total: Column, unit: int, digits: int) -> Column:
        two = lambda c: F.lpad(c.cast("string"), 2, "0")
        whole, rest = F.floor(total / unit), total % unit
        return F.concat(two(F.floor(whole / 3600)), F.lit(":"), two(F.floor(whole / 60) % 60), F.lit(":"), two(whole % 60), F.lit("."), F.lpad(rest.cast("string"), digits, "0"))

    hours = F.round(F.pmod(ra, F.lit(360.0)) * 240_000).cast("long") % 86_400_000
    degrees = F.round(F.abs(dec) * 360_000).cast("long")
    return F.concat(parts(hours, 1000, 3), F.when(dec < 0, " -").otherwise(" +"), parts(degrees, 100, 2), F.lit(" " + system))
