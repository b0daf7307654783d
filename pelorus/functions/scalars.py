"""Scalar functions as columns: sky geometry, beams, ellipses, polygons, spectra, strings."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

LN2_4 = 4 * math.log(2)


def let(value: Column, f) -> Column:
    """``f`` of a value that is computed once, however often ``f`` names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def haversine(ra1: Column, dec1: Column, ra2: Column, dec2: Column, compat: bool = False) -> Column:
    """Angular distance in degrees. compat: halves the sine of the difference in ra instead of the angle."""
    d1, d2, dr = F.radians(dec1), F.radians(dec2), F.radians(ra2 - ra1)
    s = F.sin(dr) / 2 if compat else F.sin(dr / 2)
    return F.degrees(2 * F.asin(F.least(F.lit(1.0), F.sqrt(F.sin((d2 - d1) / 2) ** 2 + F.cos(d1) * F.cos(d2) * s**2))))


def vincenty(ra1: Column, dec1: Column, ra2: Column, dec2: Column) -> Column:
    """Angular distance in degrees, stable at all separations."""
    d1, d2, dr = F.radians(dec1), F.radians(dec2), F.radians(ra2 - ra1)
    y = F.sqrt((F.cos(d2) * F.sin(dr)) ** 2 + (F.cos(d1) * F.sin(d2) - F.sin(d1) * F.cos(d2) * F.cos(dr)) ** 2)
    return F.degrees(F.atan2(y, F.sin(d1) * F.sin(d2) + F.cos(d1) * F.cos(d2) * F.cos(dr)))


def bearing(ra1: Column, dec1: Column, ra2: Column, dec2: Column) -> Column:
    """Initial bearing in degrees, in (-180, 180]."""
    d1, d2, dr = F.radians(dec1), F.radians(dec2), F.radians(ra2 - ra1)
    return F.degrees(F.atan2(F.sin(dr) * F.cos(d2), F.cos(d1) * F.sin(d2) - F.sin(d1) * F.cos(d2) * F.cos(dr)))


def beam_area(bmaj: Column, bmin: Column) -> Column:
    return bmaj * bmin * (math.pi / LN2_4)


def beam_area_pixels(bmaj: Column, bmin: Column, dx: Column, dy: Column) -> Column:
    return beam_area(bmaj, bmin) / F.abs(dx * dy)


def eccentricity(a: Column, b: Column) -> Column:
    return F.sqrt(1 - (F.least(a, b) / F.greatest(a, b)) ** 2)


def gauss2d(x, y, amp, x0, y0, sx, sy, theta) -> Column:
    """Rotated 2-D Gaussian; theta in radians."""
    c, s = F.cos(theta), F.sin(theta)
    u, v = (x - x0) * c + (y - y0) * s, (y - y0) * c - (x - x0) * s
    return amp * F.exp(-0.5 * ((u / sx) ** 2 + (v / sy) ** 2))


def gauss_integral(amp: Column, sx: Column, sy: Column) -> Column:
    return amp * sx * sy * (2 * math.pi)


def deconvolved(bmaj, bmin, pa, beam_bmaj, beam_bmin, beam_pa) -> Column:
    """struct(bmaj, bmin, pa) of an ellipse without the beam, by the standard quadratic forms; null where the beam is larger."""
    def form(a: Column, b: Column, p: Column) -> tuple[Column, Column, Column]:
        c, s = F.cos(F.radians(p)), F.sin(F.radians(p))
        return (a * c) ** 2 + (b * s) ** 2, (a * s) ** 2 + (b * c) ** 2, (a**2 - b**2) * s * c

    (x1, y1, z1), (x2, y2, z2) = form(bmaj, bmin, pa), form(beam_bmaj, beam_bmin, beam_pa)

    def axes(q: Column) -> Column:
        root = F.sqrt((q["x"] - q["y"]) ** 2 + q["z"] ** 2)
        angle = F.when(root == 0, F.lit(0.0)).otherwise(F.degrees(F.atan2(q["z"], q["x"] - q["y"])) / 2)
        return F.struct(((q["x"] + q["y"] + root) / 2).alias("major"), ((q["x"] + q["y"] - root) / 2).alias("minor"), angle.alias("pa"))

    def ends(e: Column) -> Column:
        return F.when((e["major"] >= 0) & (e["minor"] >= 0), F.struct(F.sqrt(e["major"]).alias("bmaj"), F.sqrt(e["minor"]).alias("bmin"), e["pa"].alias("pa")))

    return let(let(F.struct((x1 - x2).alias("x"), (y1 - y2).alias("y"), (2 * (z1 - z2)).alias("z")), axes), ends)


def polygon_area(verts: Column) -> Column:
    """Shoelace area of an array of struct(x, y)."""
    n = F.size(verts)
    cross = F.transform(verts, lambda p, i: p["x"] * F.get(verts, (i + 1) % n)["y"] - F.get(verts, (i + 1) % n)["x"] * p["y"])
    return F.abs(F.aggregate(cross, F.lit(0.0), lambda a, b: a + b)) / 2


def in_polygon(x: Column, y: Column, verts: Column) -> Column:
    """Ray casting in the plane."""
    n = F.size(verts)

    def side(p: Column, i: Column) -> Column:
        q = F.get(verts, (i + 1) % n)
        return F.when(((p["y"] > y) != (q["y"] > y)) & (x < (q["x"] - p["x"]) * (y - p["y"]) / (q["y"] - p["y"]) + p["x"]), 1).otherwise(0)

    return F.aggregate(F.transform(verts, side), F.lit(0), lambda a, b: a + b) % 2 == 1


def ellipse_polygon(x: Column, y: Column, a: Column, b: Column, theta: Column, n: int = 20) -> Column:
    """The corners of an ellipse of semi-axes a, b turned by theta (degrees)."""
    def corner(k: Column) -> Column:
        t, r = k * (2 * math.pi / n), F.radians(theta)
        return F.struct((x + a * F.cos(t) * F.cos(r) - b * F.sin(t) * F.sin(r)).alias("x"), (y + a * F.cos(t) * F.sin(r) + b * F.sin(t) * F.cos(r)).alias("y"))

    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), corner)


def rotated(x: Column, y: Column, cx: Column, cy: Column, theta: Column) -> Column:
    c, s = F.cos(F.radians(theta)), F.sin(F.radians(theta))
    return F.struct((cx + (x - cx) * c - (y - cy) * s).alias("x"), (cy + (x - cx) * s + (y - cy) * c).alias("y"))


def covariance_ellipse(sx: Column, sy: Column, cov: Column) -> Column:
    """struct(major, minor, theta in degrees) of a covariance."""
    half, diff = (sx**2 + sy**2) / 2, (sx**2 - sy**2) / 2
    root = F.sqrt(diff**2 + cov**2)
    return F.struct(F.sqrt(half + root).alias("major"), F.sqrt(F.greatest(half - root, F.lit(0.0))).alias("minor"), (F.degrees(F.atan2(cov, diff)) / 2).alias("theta"))


def contour_scale(level: float) -> float:
    """Axis factor of the ellipse that holds a share ``level`` of a 2-D Gaussian."""
    return math.sqrt(-2 * math.log(1 - level))


def rescaled(x: Column, low: Column, high: Column, to_low: float, to_high: float) -> Column:
    return to_low + (to_high - to_low) * (x - low) / (high - low)


# spectra: decimal logarithm of the flux at lg = log10 of the frequency in GHz
def synchrotron_self_absorbed(lg: Column, s0: float, alpha: float, nu_t: float) -> Column:
    z = F.pow(F.lit(10.0), lg) / nu_t
    tau = F.pow(z, F.lit(alpha - 2.5))
    return F.log10(s0 * F.pow(z, F.lit(alpha)) * (1 - F.exp(-tau)) / tau)


def synchrotron_external_absorbed(lg: Column, s0: float, alpha: float, nu_t: float) -> Column:
    nu = F.pow(F.lit(10.0), lg)
    return F.log10(s0 * F.pow(nu, F.lit(alpha)) * F.exp(-F.pow(nu / nu_t, F.lit(-2.1))))


def synchrotron_internal_absorbed(lg: Column, s0: float, alpha: float, nu_t: float) -> Column:
    z = F.pow(F.lit(10.0), lg) / nu_t
    tau = F.pow(z, F.lit(-2.1))
    return F.log10(s0 * F.pow(z, F.lit(alpha)) * (1 - F.exp(-tau)) / tau)


def power_law(x: Column, norm: float, index: float) -> Column:
    return norm * F.pow(x, F.lit(index))


def broken_power_law(x: Column, norm: float, first: float, second: float, at: float) -> Column:
    return F.when(x < at, norm * F.pow(x / at, F.lit(first))).otherwise(norm * F.pow(x / at, F.lit(second)))


def cutoff_power_law(x: Column, norm: float, index: float, at: float) -> Column:
    return norm * F.pow(x, F.lit(index)) * F.exp(-x / at)


# strings and codes
def split_whitespace(s: Column) -> Column:
    return F.split(F.trim(s), r"\s+")


def without_blanks(s: Column) -> Column:
    return F.replace(s, F.lit(" "), F.lit(""))


def base_name(path: Column, strip_extension: bool = False) -> Column:
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    return F.regexp_replace(name, r"\.[^.]*$", "") if strip_extension else name


def equal_parts(s: Column, size: int) -> Column:
    """Chunks of ``size`` characters; the last may be shorter."""
    starts = F.sequence(F.lit(0), F.greatest(F.ceil(F.length(s) / size).cast("int") - 1, F.lit(0)))
    return F.transform(starts, lambda i: F.substring(s, i * size + 1, F.lit(size)))


def id_code(ids: list[Column], digits: int) -> Column:
    """Ids padded with zeros and joined."""
    return F.concat(*(F.lpad(c.cast("string"), digits, "0") for c in ids))


def decode_ids(code: Column, digits: int) -> Column:
    return F.transform(equal_parts(code, digits), lambda c: c.cast("int"))


def iau_name(ra: Column, dec: Column) -> Column:
    """JHHMMSS.s±DDMMSS, truncated as is usual in names."""
    h = F.pmod(ra, F.lit(360.0)) / 15.0 + 1e-12
    hh, mm, ss = F.floor(h), F.floor(F.pmod(h * 60, F.lit(60.0))), F.floor(F.pmod(h * 3600, F.lit(60.0)) * 10) / 10.0
    d = F.abs(dec) + 1e-12
    return F.concat(
        F.lit("J"), F.lpad(hh.cast("string"), 2, "0"), F.lpad(mm.cast("string"), 2, "0"), F.lpad(F.format_string("%.1f", ss), 4, "0"), F.when(dec < 0, "-").otherwise("+"),
        F.lpad(F.floor(d).cast("string"), 2, "0"), F.lpad(F.floor(F.pmod(d * 60, F.lit(60.0))).cast("string"), 2, "0"), F.lpad(F.floor(F.pmod(d * 3600, F.lit(60.0))).cast("string"), 2, "0"),
    )


# angles, matrices, beams
def modulo(x: Column, y: Column) -> Column:
    """x modulo y with the sign of y; y = 0 gives x; a rest that rounding lifts to y is 0."""
    rest = x - y * F.floor(x / y)
    return F.when(y == 0, x).when(F.when(y > 0, rest >= y).otherwise(rest <= y), F.lit(0.0)).otherwise(rest)


def angle_in_range(theta: Column, limit: float) -> Column:
    """An angle turned into (-limit, limit]."""
    return theta - 2 * limit * F.ceil((theta - limit) / (2 * limit))


def rescaled_difference(diff: Column, low: Column, high: Column, to_low: float, to_high: float) -> Column:
    """A difference, or an rms, under the scaling of ``rescaled``."""
    return diff * (to_high - to_low) / (high - low)


def ellipse_area(a: Column, b: Column, axes: str = "semi") -> Column:
    """Area by semi-axes, or by full axes (``axes="full"``)."""
    return a * b * (math.pi if axes == "semi" else math.pi / 4)


def gauss_ellipse_integral(amp: Column, bmaj: Column, bmin: Column) -> Column:
    """Integral of a 2-D Gaussian by its full widths at half maximum."""
    return amp * beam_area(bmaj, bmin)


def beam_width_pixels(bmaj: Column, bmin: Column, dx: Column, dy: Column) -> Column:
    return F.ceil(F.sqrt(F.abs(bmaj * bmin)) / F.sqrt(F.abs(dx * dy))).cast("int")


def matrix_trace(m: Column) -> Column:
    """Trace of an array of rows."""
    return F.aggregate(F.transform(m, lambda row, i: F.get(row, i)), F.lit(0.0), lambda a, b: a + b)


def mahalanobis2(dx: Column, dy: Column, sx: Column, sy: Column, cov: Column) -> Column:
    """Mahalanobis length of (dx, dy) under a 2-D covariance."""
    return F.sqrt((dx**2 * sy**2 - 2 * dx * dy * cov + dy**2 * sx**2) / (sx**2 * sy**2 - cov**2))


def confidence_ellipse(x0: Column, y0: Column, sx: Column, sy: Column, cov: Column, level: float) -> Column:
    """struct(x, y, r1, r2, theta): the ellipse that holds a share ``level`` of a 2-D Gaussian."""
    e, k = covariance_ellipse(sx, sy, cov), contour_scale(level)
    return F.struct(x0.alias("x"), y0.alias("y"), (e["major"] * k).alias("r1"), (e["minor"] * k).alias("r2"), e["theta"].alias("theta"))


def deconvolved_ellipse(ellipse: Column, beam: Column) -> Column:
    """struct(x, y, r1, r2, theta) of an ellipse (semi-axes, theta from the x axis in degrees) without a beam; null where the beam is larger."""
    def axes(e: Column) -> Column:
        theta = F.when(e["r2"] > e["r1"], e["theta"] - 90.0).otherwise(e["theta"])
        return F.struct((2 * F.greatest(e["r1"], e["r2"])).alias("a"), (2 * F.least(e["r1"], e["r2"])).alias("b"), modulo(theta, F.lit(180.0)).alias("pa"))

    def without_beam(p: Column) -> Column:
        return deconvolved(p["e"]["a"], p["e"]["b"], p["e"]["pa"], p["o"]["a"], p["o"]["b"], p["o"]["pa"])

    def ends(d: Column) -> Column:
        return F.when(d.isNotNull(), F.struct(ellipse["x"].alias("x"), ellipse["y"].alias("y"), (d["bmaj"] / 2).alias("r1"), (d["bmin"] / 2).alias("r2"), d["pa"].alias("theta")))

    return let(let(F.struct(axes(ellipse).alias("e"), axes(beam).alias("o")), without_beam), ends)


# fixed values: Planck's constant, the speed of light, Boltzmann's constant
H_PLANCK, C_LIGHT, K_BOLTZMANN = 6.62607015e-34, 2.99792458e8, 1.380649e-23


def free_free(lg: Column, lg_omega: float, lg_te: float, lg_em: float) -> Column:
    """Thermal free-free emission: Planck's law times (1 - e^-tau) times the solid angle, in log10 Jy; 0 for a negative flux."""
    ghz, te = F.pow(F.lit(10.0), lg), 10.0**lg_te
    hz = ghz * 1e9
    planck = 2.0 * H_PLANCK / C_LIGHT**2 * F.pow(hz, F.lit(3.0)) / F.expm1(hz * (H_PLANCK / (K_BOLTZMANN * te)))
    gaunt = F.log(F.lit(4.955e-2) / ghz) + 1.5 * math.log(te)
    tau = gaunt * (3.014e-2 * te**-1.5 * 10.0**lg_em) / ghz**2
    flux = planck * (1 - F.exp(-tau)) * 10.0**lg_omega * 1e26
    return F.when(flux >= 0, F.log10(flux)).otherwise(F.lit(0.0))


# points and polygons
def on_segment(x: Column, y: Column, a: Column, b: Column, eps: float = 1e-12) -> Column:
    """Whether (x, y) lies on the segment between the points a and b."""
    at = lambda p: (F.abs(x - p["x"]) < eps) & (F.abs(y - p["y"]) < eps)
    ux, uy, vx, vy = b["x"] - a["x"], b["y"] - a["y"], x - a["x"], y - a["y"]
    along = vx * ux + vy * uy
    return at(a) | at(b) | ((F.abs(vy * ux - vx * uy) <= eps) & (along >= 0) & (along <= ux**2 + uy**2))


def on_boundary(x: Column, y: Column, verts: Column) -> Column:
    """Whether (x, y) lies on a side of a closed polygon."""
    n = F.size(verts)
    return F.exists(F.transform(verts, lambda p, i: on_segment(x, y, p, F.get(verts, (i + 1) % n))), lambda hit: hit)


def in_contour(x: Column, y: Column, verts: Column, borders: bool = False) -> Column:
    return in_polygon(x, y, verts) | on_boundary(x, y, verts) if borders else in_polygon(x, y, verts)


def in_polygon_winding(x: Column, y: Column, verts: Column, borders: bool = False) -> Column:
    """By the winding number: a polygon that overlaps itself holds what it goes round twice. A point of the border is inside if asked."""
    n = F.size(verts)

    def turn(p: Column, i: Column) -> Column:
        q = F.get(verts, (i + 1) % n)
        left = (q["x"] - p["x"]) * (y - p["y"]) - (x - p["x"]) * (q["y"] - p["y"])
        return F.when((p["y"] <= y) & (q["y"] > y) & (left > 0), 1).when((p["y"] > y) & (q["y"] <= y) & (left < 0), -1).otherwise(0)

    inside = F.aggregate(F.transform(verts, turn), F.lit(0), lambda a, b: a + b) != 0
    border = on_boundary(x, y, verts)
    return inside | border if borders else inside & ~border


def contour_polygon(points: Column) -> Column:
    """A closed ring from the points of a contour: the first point again at the end, if it isn't there."""
    first, last = F.get(points, F.lit(0)), F.get(points, F.size(points) - 1)
    return F.when((F.size(points) == 0) | (first == last), points).otherwise(F.concat(points, F.slice(points, 1, 1)))


# more strings, and arrays
def iau_coordinates(s: Column) -> Column:
    """JHHMMSS+DDMMSS from "h:m:s d:m:s system" (fk5 J, fk4 B, galactic G); parts of one character get a zero; null if it isn't of that form."""
    part = F.split(s.cast("string"), r"\s+")
    sign = F.when(F.get(part, F.lit(2)).isin("FK5", "fk5"), "J").when(F.get(part, F.lit(2)).isin("FK4", "fk4"), "B").when(F.get(part, F.lit(2)) == "galactic", "G")
    halves = [F.split(F.get(part, F.lit(k)), ":") for k in (0, 1)]
    texts = [F.array_join(F.transform(h, lambda p: F.when(F.length(p) == 1, F.concat(F.lit("0"), p)).otherwise(p)), "") for h in halves]
    plus = F.when(F.try_to_number(F.regexp_extract(F.get(halves[1], F.lit(0)), r"^-?\d+", 0), F.lit("S999")) > 0, "+").otherwise("")
    ok = (F.size(part) == 3) & (F.size(halves[0]) == 3) & (F.size(halves[1]) == 3)
    return F.when(ok, F.concat(sign, texts[0], plus, texts[1]))


def split_on(s: Column, delimiter: str) -> Column:
    """Parts between single characters; one at the end opens no further part, and an empty text has none."""
    parts = F.split(s, "\\Q" + delimiter + "\\E", -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def joined(parts: Column, delimiter: str = "") -> Column:
    return F.array_join(F.transform(parts, lambda p: p.cast("string")), delimiter)


def without(s: Column, text: str) -> Column:
    return F.replace(s, F.lit(text), F.lit(""))


def replaced(s: Column, old: str, new: str) -> Column:
    return F.replace(s, F.lit(old), F.lit(new))


def part_of(s: Column, text: str, left: bool = True) -> Column:
    """What stands before the first ``text``, or from its second character on; all of ``s`` if it doesn't occur."""
    at = F.instr(s, text)
    return F.when(at == 0, s).otherwise(F.substring(s, F.lit(1), at - 1) if left else F.substring(s, at + 1, F.length(s)))


def typed(parts: Column, kind: str) -> Column:
    """An array of texts as another type; what can't be read is null."""
    return F.transform(parts, lambda p: p.try_cast(kind))


def integer_code(ids: list[Column], digits: int) -> Column:
    return id_code(ids, digits).cast("long")


def linspace(first: Column, last: Column, n: int) -> Column:
    """``n`` values from first to last, evenly spaced."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: first + i * (last - first) / max(n - 1, 1))


def any_true(flags: Column) -> Column:
    return F.exists(flags, lambda f: f)


def all_true(flags: Column) -> Column:
    return F.forall(flags, lambda f: f)


def position_of(items: Column, value) -> Column:
    """Position of the first item equal to a value, from 0; -1 if there is none."""
    return (F.array_position(items, value) - 1).cast("int")


def without_positions(items: Column, positions: Column) -> Column:
    """The items at other positions than these (from 0)."""
    return F.filter(items, lambda _, i: ~F.array_contains(positions, i))


def reordered(items: Column, positions: Column) -> Column:
    """The items at the positions given (from 0), in that order."""
    return F.transform(positions, lambda i: F.get(items, i))


def common_positions(a: Column, b: Column) -> Column:
    """(position in sorted a, position in sorted b) of equal values; equal values pair one to one in order."""
    sa, sb = F.array_sort(a), F.array_sort(b)
    # the k-th of equal values in a meets the k-th in b
    start = lambda xs, v: F.array_position(xs, v) - 1
    count = lambda xs, v: F.size(F.filter(xs, lambda o: o == v))
    values = F.array_distinct(F.array_intersect(sa, sb))
    each = F.transform(values, lambda v: F.transform(F.sequence(F.lit(0), F.least(count(sa, v), count(sb, v)) - 1), lambda k: F.struct((start(sa, v) + k).cast("int").alias("left"), (start(sb, v) + k).cast("int").alias("right"))))
    return F.flatten(each)


def range_median(values: Column, first: Column, last: Column) -> Column:
    """Median of the sorted values between two positions (from 0, both included); null if they aren't in the array."""
    part = F.slice(F.array_sort(values), first + 1, last - first + 1)
    n = F.size(part)
    ok = (first >= 0) & (last >= first) & (last < F.size(values))
    return F.when(ok, (F.get(part, F.floor((n - 1) / 2).cast("int")) + F.get(part, F.floor(n / 2).cast("int"))) / 2)


def has_key(items: Column, key) -> Column:
    return F.map_contains_key(items, key)
