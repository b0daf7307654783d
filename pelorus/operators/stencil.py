"""Neighbourhood operations on tiles with halos: one shuffle by tile, in which only the pixels near a border are sent twice.

A tile is a bounded group, whatever the image. Where its pixels fill a good part of their box they become a dense array, so an
operation is a handful of numpy passes for each kernel cell; where they are scattered (``near``), only the pairs of pixels that are
there are visited, for many tiles at once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TILE = 512
#: a tile with fewer pixels than a part of this of their box is taken as scattered
SCATTERED = 16
#: about so many rows are worked on at once
CHUNK = 1 << 17
PIXEL = ["image_id", "ix", "iy"]

#: an operation: dense values (NaN where there is no pixel), the bounds (x0, x1, y0, y1) of the image in them -> arrays by name
Operation = Callable[[np.ndarray, tuple[int, int, int, int]], dict[str, np.ndarray]]


def on_tiles(pixels: DataFrame, operation: Operation, columns: list[str], halo: int, bounds: DataFrame | None = None, tile: int = TILE, duplicates: str = "sum") -> DataFrame:
    """Pixels of the input with the columns of an operation that looks ``halo`` pixels far.

    Arrays are indexed [y, x]. ``bounds`` (image_id, x0, x1, y0, y1: one row an image) is joined if the operation needs the
    image's borders; else the bounds given to it are those of no image. A pixel given twice counts by ``duplicates`` (sum, max
    or min) for its neighbours. Null values are no pixels for the operation but come out, as NaN turned null.
    """
    if halo > tile:
        raise ValueError("a halo can't be wider than a tile")
    d = pixels.select(*PIXEL, F.col("v").cast("double").alias("v"))
    if bounds is not None:
        d = d.join(bounds.select("image_id", "x0", "x1", "y0", "y1"), "image_id")
    else:
        d = d.withColumns({c: F.lit(None).cast("long") for c in ("x0", "x1", "y0", "y1")})
    for axis in "xy":
        lo, hi = (F.floor((F.col("i" + axis) + s * halo) / tile).cast("long") for s in (-1, 1))
        d = d.withColumn("_t" + axis, F.explode(F.sequence(lo, hi)))
    kind = dict(pixels.dtypes)
    schema = ", ".join([f"`{c}` {kind[c]}" for c in PIXEL] + ["v double"] + [f"`{c}` double" for c in columns])

    def run(t: pa.Table) -> pa.Table:
        ix, iy = t["ix"].to_numpy().astype(np.int64), t["iy"].to_numpy().astype(np.int64)
        v = t["v"].to_numpy(zero_copy_only=False).astype(float) if t["v"].null_count == 0 else np.array([np.nan if x is None else x for x in t["v"].to_pylist()])
        tx, ty = t["_tx"][0].as_py(), t["_ty"][0].as_py()
        left, low = int(ix.min()) - halo, int(iy.min()) - halo
        grid = np.full((int(iy.max()) + halo - low + 1, int(ix.max()) + halo - left + 1), np.nan)
        x, y = ix - left, iy - low
        real = np.isfinite(v)
        if duplicates == "sum":
            total, seen = np.zeros(grid.shape), np.zeros(grid.shape, bool)
            np.add.at(total, (y[real], x[real]), v[real])
            seen[y[real], x[real]] = True
            grid = np.where(seen, total, np.nan)
        else:
            np.fmax.at(grid, (y[real], x[real]), v[real]) if duplicates == "max" else np.fmin.at(grid, (y[real], x[real]), v[real])
        edges = [t[c][0].as_py() for c in ("x0", "x1", "y0", "y1")]
        far = (-(1 << 40), 1 << 40) * 2 if edges[0] is None else tuple(int(e) - o for e, o in zip(edges, (left, left, low, low)))
        out = operation(grid, far)
        home = np.flatnonzero((ix // tile == tx) & (iy // tile == ty))
        # one row for each pixel of the input, once
        home = home[np.unique(np.stack([y[home], x[home]]), axis=1, return_index=True)[1]] if len(home) else home
        rows = t.select(PIXEL).take(pa.array(home))
        values = [pa.array(v[home], pa.float64(), mask=~real[home])] + [pa.array(out[c][y[home], x[home]], pa.float64(), from_pandas=True) for c in columns]
        for name, a in zip(["v", *columns], values):
            rows = rows.append_column(name, a)
        return rows

    return d.groupBy("image_id", "_tx", "_ty").applyInArrow(run, schema)


def shifted(a: np.ndarray, dx: int, dy: int, fill: float) -> np.ndarray:
    """out[y, x] = a[y - dy, x - dx]; ``fill`` from beyond."""
    out = np.full_like(a, fill)
    h, w = a.shape
    if abs(dx) < w and abs(dy) < h:
        out[max(dy, 0) : h + min(dy, 0), max(dx, 0) : w + min(dx, 0)] = a[max(-dy, 0) : h + min(-dy, 0), max(-dx, 0) : w + min(-dx, 0)]
    return out


def correlate(a: np.ndarray, kernel: np.ndarray, gap: int = 1) -> np.ndarray:
    """The convolution (kernel flipped) of an array without NaN, zeros beyond; ``gap`` spreads the kernel's cells."""
    ry, rx = kernel.shape[0] // 2, kernel.shape[1] // 2
    out = np.zeros_like(a)
    for r, c in zip(*np.nonzero(kernel)):
        out += kernel[r, c] * shifted(a, (int(c) - rx) * gap, (int(r) - ry) * gap, 0.0)
    return out


def mirrored(a: np.ndarray, bounds: tuple[int, int, int, int], reach: int) -> np.ndarray:
    """The array with the image's pixels reflected at its borders (the border pixel once), as far as ``reach``."""
    h, w = a.shape
    x0, x1, y0, y1 = bounds
    out = a.copy()
    for axis, lo, hi, n in ((1, x0, x1, w), (0, y0, y1, h)):
        for k in range(1, reach + 1):
            for to, source in ((lo - k, lo + k), (hi + k, hi - k)):
                if 0 <= to < n and 0 <= source < n and lo <= source <= hi:
                    if axis:
                        out[:, to] = out[:, source]
                    else:
                        out[to, :] = out[source, :]
    return out


def extreme(a: np.ndarray, half: int, largest: bool) -> np.ndarray:
    """Maximum (or minimum) over a square of half width ``half``, NaN ignored; NaN where there is no pixel in it."""
    pick = np.fmax if largest else np.fmin
    for axis in (0, 1):
        out = a.copy()
        for k in range(1, half + 1):
            for s in (-k, k):
                out = pick(out, shifted(a, s if axis else 0, 0 if axis else s, np.nan))
        a = out
    return a


class Grid:
    """The pixels of a tile as a dense array: values ``v`` [y, x], NaN where there is none, and the image's bounds in it."""

    def __init__(self, v: np.ndarray, bounds: tuple[int, int, int, int], reach: int):
        self.v, self.bounds, self.reach = v, bounds, reach

    def correlate(self, a: np.ndarray, kernel: np.ndarray, gap: int = 1, mirror: bool = False) -> np.ndarray:
        """The convolution (kernel flipped) of values; NaN counts as 0, and so does what is beyond the border unless it is mirrored."""
        return correlate(np.nan_to_num(mirrored(a, self.bounds, self.reach) if mirror else a), kernel, gap)

    def extreme(self, a: np.ndarray, half: int, largest: bool) -> np.ndarray:
        """Maximum (or minimum) over the pixels of a square, NaN ignored."""
        return extreme(a, half, largest)

    def shifted(self, a: np.ndarray, dx: int, dy: int) -> np.ndarray:
        """The value of the pixel (-dx, -dy) away, NaN if there is none."""
        return shifted(a, dx, dy, np.nan)

    def inside(self, margin: int) -> np.ndarray:
        """Whether a pixel is at least ``margin`` from the image's border."""
        y, x = np.ogrid[: self.v.shape[0], : self.v.shape[1]]
        x0, x1, y0, y1 = self.bounds
        return (x >= x0 + margin) & (x <= x1 - margin) & (y >= y0 + margin) & (y <= y1 - margin)


class Points:
    """Scattered pixels of many tiles, with the methods of ``Grid`` on arrays of one value a pixel.

    ``code`` is (tile * stride + x) * stride + y, ascending and without repeats; a step of ``reach`` never leads to another tile's or
    column's codes. bounds: arrays x0, x1, y0, y1 on the scale of x and y.
    """

    def __init__(self, code: np.ndarray, v: np.ndarray, bounds: list[np.ndarray] | None, stride: int, reach: int):
        self.code, self.v, self.bounds, self.stride, self.reach = code, v, bounds, stride, reach

    def pairs(self, reach: int) -> tuple[np.ndarray, ...]:
        """i, j, dx, dy of the pairs of pixels at most ``reach`` apart on each axis, once each: j is dx columns on, or dy up in the same column."""
        made = self.__dict__.setdefault("_pairs", {})
        if reach not in made:
            parts = []
            for dx in range(reach + 1):
                lo = np.searchsorted(self.code, self.code + (dx * self.stride - reach)) if dx else np.arange(1, len(self.code) + 1)
                n = np.searchsorted(self.code, self.code + (dx * self.stride + reach), "right") - lo
                i = np.repeat(np.arange(len(n)), n)
                j = np.arange(len(i)) + np.repeat(lo - (np.cumsum(n) - n), n)
                parts.append((i.astype(np.int32), j.astype(np.int32), np.full(len(i), dx, np.int16), (self.code[j] - self.code[i] - dx * self.stride).astype(np.int16)))
            made[reach] = tuple(map(np.concatenate, zip(*parts)))
        return made[reach]

    @cached_property
    def with_mirrored(self) -> tuple[Points, np.ndarray]:
        """These pixels and their mirror images beyond the borders, and the pixel that each comes from."""
        s, low, high = self.stride, self.reach, self.stride - self.reach
        tile, x, y, source = self.code // (s * s), self.code // s % s, self.code % s, np.arange(len(self.code))
        for axis in (0, 1):
            at, parts = (x, y)[axis], [(tile, x, y, source)]
            for k, way in ((2 * axis, 1), (2 * axis + 1, -1)):
                edge = self.bounds[k][source]
                to, far = 2 * edge - at, (at - edge) * way
                hit = np.flatnonzero((far >= 1) & (far <= self.reach) & (to >= low) & (to < high))
                new = [z[hit] for z in (tile, x, y, source)]
                new[1 + axis] = to[hit]
                parts.append(tuple(new))
            tile, x, y, source = (np.concatenate(z) for z in zip(*parts))
        code = (tile * s + x) * s + y
        order = np.argsort(code, kind="stable")
        return Points(code[order], self.v[source[order]], None, s, self.reach), np.where(order < len(self.code), source[order], -1 - source[order])

    def correlate(self, a: np.ndarray, kernel: np.ndarray, gap: int = 1, mirror: bool = False) -> np.ndarray:
        if mirror:
            more, source = self.with_mirrored
            own = source >= 0
            return more.correlate(a[np.where(own, source, -1 - source)], kernel, gap)[own]
        a, ry, rx = np.nan_to_num(a), kernel.shape[0] // 2, kernel.shape[1] // 2
        reach, w = max(rx, ry) * gap, np.zeros((2 * max(rx, ry) + 1,) * 2)
        m = max(rx, ry)
        w[m - rx : m - rx + kernel.shape[1], m - ry : m - ry + kernel.shape[0]] = kernel.T
        i, j, dx, dy = self.pairs(self._shared(reach))
        if gap > 1 or reach < self._shared(reach):
            fits = np.flatnonzero((dx <= reach) & (abs(dy) <= reach) & (dx % gap == 0) & (dy % gap == 0))
            i, j, dx, dy = (z[fits] for z in (i, j, dx, dy))
        dx, dy = dx // gap, dy // gap
        n = len(a)
        return w[m, m] * a + np.bincount(i, w[m - dx, m - dy] * a[j], n) + np.bincount(j, w[m + dx, m + dy] * a[i], n)

    def _shared(self, reach: int) -> int:
        """The smallest reach of pairs already found that serves."""
        return min((r for r in self.__dict__.get("_pairs", {}) if r >= reach), default=reach)

    def extreme(self, a: np.ndarray, half: int, largest: bool) -> np.ndarray:
        sign = 1.0 if largest else -1.0
        b = np.where(np.isnan(a), -np.inf, a * sign)
        i, j, dx, dy = self.pairs(self._shared(half))
        if self._shared(half) > half:
            fits = np.flatnonzero((dx <= half) & (abs(dy) <= half))
            i, j = i[fits], j[fits]
        out = b.copy()
        np.maximum.at(out, i, b[j])
        np.maximum.at(out, j, b[i])
        return np.where(out == -np.inf, np.nan, out * sign)

    def shifted(self, a: np.ndarray, dx: int, dy: int) -> np.ndarray:
        to = self.code - dx * self.stride - dy
        at = np.minimum(np.searchsorted(self.code, to), len(to) - 1)
        return np.where(self.code[at] == to, a[at], np.nan)

    def inside(self, margin: int) -> np.ndarray:
        x, y, (x0, x1, y0, y1) = self.code // self.stride % self.stride, self.code % self.stride, self.bounds
        return (x >= x0 + margin) & (x <= x1 - margin) & (y >= y0 + margin) & (y <= y1 - margin)


def _once(code: np.ndarray, v: np.ndarray, repeated: str) -> tuple[np.ndarray, np.ndarray]:
    """Rows that stand for the pixels of ascending codes, and the pixels' values: what is finite, by ``repeated``; NaN if nothing is."""
    first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else np.arange(0)
    if len(first) == len(code):
        return first, np.where(np.isfinite(v), v, np.nan)
    real, f, none = np.isfinite(v), {"sum": np.add, "max": np.maximum, "min": np.minimum}[repeated], {"sum": 0.0, "max": -np.inf, "min": np.inf}[repeated]
    return first, np.where(np.maximum.reduceat(real, first), f.reduceat(np.where(real, v, none), first), np.nan)


def near(pixels: DataFrame, operation: Callable[[Grid | Points], dict[str, np.ndarray]], columns: list[str], halo: int, bounds: DataFrame | None = None, tile: int = TILE, repeated: str = "sum", only: str | None = None) -> DataFrame:
    """Pixels of the input, once each, with the columns of an operation that looks ``halo`` pixels far; one shuffle, of rows in any number a pixel.

    The operation works on dense or scattered tiles by the methods that both have. ``bounds`` (image_id, x0, x1, y0, y1: one row an
    image) is given if it needs the image's borders. A pixel given several times has the sum (or max, min) of its finite values, and
    none if there is no such value. With ``only``, pixels where that column isn't true are left out.
    """
    if halo > tile:
        raise ValueError("a halo can't be wider than a tile")
    d = pixels.select(*PIXEL, F.col("v").cast("double").alias("v"))
    home = {axis: F.floor(F.col("i" + axis) / tile).cast("long") for axis in "xy"}
    for axis in "xy":
        lo, hi = (F.floor((F.col("i" + axis) + s * halo) / tile).cast("long") for s in (-1, 1))
        d = d.withColumn("_t" + axis, F.explode(F.sequence(lo, hi)))
    # the hash only orders and cuts: what belongs together is told by the tile itself
    d = d.select(*PIXEL, "v", ((F.col("_tx") - home["x"]) * 3 + F.col("_ty") - home["y"] + 4).cast("tinyint").alias("_k"), F.xxhash64("image_id", "_tx", "_ty").alias("_t"))
    d = d.repartition("_t")
    edges = ["x0", "x1", "y0", "y1"] if bounds is not None else []
    if edges:
        d = d.join(F.broadcast(bounds.select(F.col("image_id").alias("_image"), *(F.col(c).cast("long").alias(c) for c in edges))), F.col("image_id").eqNullSafe(F.col("_image"))).drop("_image")
    d = d.sortWithinPartitions("_t")  # after the join, below which a sort is dropped
    kind = dict(pixels.dtypes)
    out_columns = [c for c in columns if c != only]
    schema = ", ".join([f"`{c}` {kind[c]}" for c in PIXEL] + ["v double"] + [f"`{c}` double" for c in out_columns])
    stride = tile + 4 * halo

    def work(c: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], np.ndarray, dict[str, np.ndarray]]:
        """The pixels of a chunk of whole tiles, which of them are at home, and their columns."""
        tx, ty = c["ix"] // tile + c["_k"] // 3 - 1, c["iy"] // tile + c["_k"] % 3 - 1
        other = lambda *z: np.any([x[1:] != x[:-1] for x in z], axis=0)
        if (other(c["image_id"], tx, ty) & ~other(c["_t"])).any():  # two tiles of one hash
            order = np.lexsort((ty, tx, c["image_id"]))
            c, tx, ty = {n: a[order] for n, a in c.items()}, tx[order], ty[order]
        number = np.concatenate([[0], np.cumsum(other(c["image_id"], tx, ty))])
        left, low = tx * tile - 2 * halo, ty * tile - 2 * halo
        code = (number * stride + c["ix"] - left) * stride + c["iy"] - low
        order = np.argsort(code, kind="stable")
        first, v = _once(code[order], c["v"][order], repeated)
        rows = order[first]
        c, code, number, left, low = {n: a[rows] for n, a in c.items()}, code[rows], number[rows], left[rows], low[rows]
        x, y = c["ix"] - left, c["iy"] - low
        starts = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1]]))
        count = np.diff(np.append(starts, len(number)))
        area = (np.maximum.reduceat(x, starts) - np.minimum.reduceat(x, starts) + 1) * (np.maximum.reduceat(y, starts) - np.minimum.reduceat(y, starts) + 1)
        dense = count * SCATTERED >= area
        out = {n: np.empty(len(v)) for n in columns}
        limits = [c[e] - o for e, o in zip(edges, (left, left, low, low))]
        some = np.flatnonzero(~np.repeat(dense, count))
        if len(some):
            for n, a in operation(Points(code[some], v[some], [z[some] for z in limits] if limits else None, stride, halo)).items():
                out[n][some] = a
        for at, n in zip(starts[dense], count[dense]):
            r = slice(at, at + n)
            x_, y_ = x[r] - (x[r].min() - halo), y[r] - (y[r].min() - halo)
            grid = np.full((y_.max() + halo + 1, x_.max() + halo + 1), np.nan)
            grid[y_, x_] = v[r]
            far = tuple(int(z[at]) - int(o) for z, o in zip(limits, (x[at] - x_[0],) * 2 + (y[at] - y_[0],) * 2)) if limits else (-(1 << 40), 1 << 40) * 2
            for name, a in operation(Grid(grid, far, halo)).items():
                out[name][r] = a[y_, x_]
        return c | {"v": v}, c["_k"] == 4, out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: list = []
        held: list[dict[str, np.ndarray]] = []
        numbers = ["ix", "iy", "_k", "_t", *edges]

        def chunk(c: dict[str, np.ndarray]) -> pa.RecordBatch:
            c, own, out = work(c)
            rows = np.flatnonzero(own & (out[only] != 0) if only else own)
            image = pa.array(names, image_type).take(pa.array(c["image_id"][rows]))
            of = [image] + [pa.array(c[n][rows]).cast(types[n]) for n in PIXEL[1:]] + [pa.array(a[rows], pa.float64(), from_pandas=True) for a in [c["v"], *(out[n] for n in out_columns)]]
            return pa.RecordBatch.from_arrays(of, names=[*PIXEL, "v", *out_columns])

        size, types, image_type = 0, {}, None
        for b in batches:
            if not b.num_rows:
                continue
            image_type, types = b.column("image_id").type, {n: b.column(n).type for n in PIXEL[1:]}
            coded = b.column("image_id").dictionary_encode("encode")
            known = {n: k for k, n in enumerate(names)}
            here = np.array([known.setdefault(n, len(known)) for n in coded.dictionary.to_pylist()])
            names = list(known)
            held.append({"image_id": here[coded.indices.to_numpy()], "v": b.column("v").to_numpy(zero_copy_only=False).astype(float), **{n: b.column(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in numbers}})
            size += b.num_rows
            if size < CHUNK:
                continue
            c = {n: np.concatenate([h[n] for h in held]) for n in held[0]}
            cut = int(np.searchsorted(c["_t"], c["_t"][-1]))
            if cut:
                yield chunk({n: a[:cut] for n, a in c.items()})
            rest = {n: a[cut:] for n, a in c.items()}
            left = np.unique(rest["image_id"])
            names, rest["image_id"] = [names[k] for k in left], np.searchsorted(left, rest["image_id"])
            if len(rest["v"]) > CHUNK // 2:  # a tile of many rows: its pixels once each
                order = np.lexsort((rest["iy"], rest["ix"], rest["_k"], rest["image_id"]))
                fresh = np.concatenate([[0], np.cumsum(np.any([np.diff(rest[n][order]) != 0 for n in ("image_id", "_k", "ix", "iy")], axis=0))])
                first, v = _once(fresh, rest["v"][order], repeated)
                rest = {n: a[order[first]] for n, a in rest.items()} | {"v": v}
            held, size = [rest], min(len(rest["v"]), CHUNK // 2)
        if held:
            yield chunk({n: np.concatenate([h[n] for h in held]) for n in held[0]})

    return d.mapInArrow(run, schema)
