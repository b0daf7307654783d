"""Queries of the image operators on a raster of lineitem, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from pelorus.operators import blobs, image, segment
from pelorus.plans.runtime import table

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def raster(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("image_id"), F.pmod("l_partkey", F.lit(64)).alias("ix"), F.pmod("l_suppkey", F.lit(64)).alias("iy"), "l_quantity")
    return d.groupBy("image_id", "ix", "iy").agg(F.sum("l_quantity").alias("v"))


PX = "px AS (SELECT l_returnflag AS image_id, l_partkey % 64 AS ix, l_suppkey % 64 AS iy, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2, 3)"


def rounded(df, digits=4):
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def _conv(kernel) -> str:
    """The convolution of px with a kernel, by a join on offsets."""
    half = len(kernel) // 2
    cells = ", ".join(f"({x - half}, {y - half}, CAST({kernel[y][x]!r} AS DOUBLE))" for y in range(len(kernel)) for x in range(len(kernel)))
    return f"(SELECT a.image_id, a.ix, a.iy, a.v, sum(coalesce(b.v, 0) * k.w) AS c FROM px a CROSS JOIN (VALUES {cells}) k(dx, dy, w) LEFT JOIN px b ON b.image_id = a.image_id AND b.ix = a.ix - k.dx AND b.iy = a.iy - k.dy GROUP BY 1, 2, 3, 4)"


@query(f"WITH {PX} SELECT image_id, ix, iy, round(c, 4) AS laplacian FROM {_conv(image.LAPLACE)}")
def conv_laplacian(spark, sf_dir):
    return rounded(image.laplacian(raster(spark, sf_dir)).drop("v"))


@query(f"WITH {PX}, x AS {_conv(image.SCHARR_X)}, y AS {_conv(image.SCHARR_Y)} SELECT image_id, ix, iy, round(sqrt(x.c * x.c + y.c * y.c), 4) AS gradient FROM x JOIN y USING (image_id, ix, iy)")
def gradient_magnitude(spark, sf_dir):
    return rounded(image.gradient(raster(spark, sf_dir)).drop("v"))


@query(f"WITH {PX}, u AS ({' UNION ALL '.join(f'SELECT * FROM {_conv(k)}' for k in image.kirsch_kernels())}) SELECT image_id, ix, iy, round(max(c), 4) AS kirsch FROM u GROUP BY 1, 2, 3")
def kirsch(spark, sf_dir):
    return rounded(image.kirsch(raster(spark, sf_dir)).drop("v"))


@query(f"WITH {PX} SELECT image_id, ix, iy, CAST(1 AS INTEGER) AS plane, round(v - c, 4) AS w FROM {_conv(image.b3_kernel())} UNION ALL SELECT image_id, ix, iy, 2, round(c, 4) FROM {_conv(image.b3_kernel())}")
def wavelet1(spark, sf_dir):
    return rounded(image.wavelet(raster(spark, sf_dir), 1))


@query(f"WITH {PX} SELECT image_id, ix, iy, round(c, 4) AS log FROM {_conv(image.log_kernel(5, 1.0))}")
def norm_log_filter(spark, sf_dir):
    return rounded(image.convolve(raster(spark, sf_dir), {"log": image.log_kernel(5, 1.0)}).drop("v"))


_GAUSS = image.gauss_kernel(2.5, 2.0, 30.0, 2.0)


@query(f"WITH {PX} SELECT image_id, ix, iy, round(c, 4) AS smooth FROM {_conv(_GAUSS)}")
def beam_convolution(spark, sf_dir):
    return rounded(image.convolve(raster(spark, sf_dir), {"smooth": _GAUSS}).drop("v"))


_NEAR = "a JOIN px b ON b.image_id = a.image_id AND b.ix BETWEEN a.ix - 1 AND a.ix + 1 AND b.iy BETWEEN a.iy - 1 AND a.iy + 1"


@query(f"WITH {PX}, m AS (SELECT a.image_id, a.ix, a.iy, max(b.v) AS dilated, min(b.v) AS eroded FROM px {_NEAR} GROUP BY 1, 2, 3) SELECT image_id, ix, iy, dilated, eroded, dilated - eroded AS gradient FROM m")
def morphology(spark, sf_dir):
    d = raster(spark, sf_dir)
    out = image.morphology(d, "dilate").withColumnRenamed("m", "dilated")
    return out.join(image.morphology(d, "erode").withColumnRenamed("m", "eroded"), image.PIXEL).join(image.morphology(d, "gradient").withColumnRenamed("m", "gradient"), image.PIXEL)


@query(f"""WITH {PX}, e AS (SELECT image_id, min(ix) AS x0, max(ix) AS x1, min(iy) AS y0, max(iy) AS y1 FROM px GROUP BY 1),
m AS (SELECT a.image_id, a.ix, a.iy, a.v, max(b.v) AS d FROM px {_NEAR} GROUP BY 1, 2, 3, 4)
SELECT m.image_id, m.ix, m.iy, m.v FROM m JOIN e USING (image_id) LEFT JOIN px l ON l.image_id = m.image_id AND l.ix = m.ix - 1 AND l.iy = m.iy - 1
WHERE m.v = d AND m.v <> 0 AND (l.v IS NULL OR l.v <> m.v) AND m.ix BETWEEN x0 + 1 AND x1 - 1 AND m.iy BETWEEN y0 + 1 AND y1 - 1""")
def dilate_peaks(spark, sf_dir):
    return image.peaks(raster(spark, sf_dir))


@query()
def multi_kernel_peaks(spark, sf_dir):
    return image.multi_kernel_peaks(raster(spark, sf_dir))


_GRID = f"""{PX}, t AS (SELECT *, ix // 16 AS tx, iy // 16 AS ty FROM px),
m AS (SELECT image_id, tx, ty, count(*) AS npix, median(v) AS bkg FROM t GROUP BY 1, 2, 3),
g AS (SELECT t.image_id, t.tx, t.ty, npix, bkg, median(abs(v - bkg)) * 1.4826 AS rms FROM t JOIN m USING (image_id, tx, ty) GROUP BY 1, 2, 3, 4, 5),
r AS (SELECT *, npix >= 10 AND bkg <> 0 AND rms <> 0 AS reliable FROM g),
grid AS (SELECT r.image_id, r.tx, r.ty, r.npix, CASE WHEN r.reliable THEN r.bkg ELSE coalesce(avg(n.bkg), r.bkg) END AS bkg, CASE WHEN r.reliable THEN r.rms ELSE coalesce(avg(n.rms), r.rms) END AS rms, r.reliable
 FROM r LEFT JOIN r n ON n.reliable AND n.image_id = r.image_id AND ((n.tx = r.tx - 1 AND n.ty = r.ty) OR (n.tx = r.tx AND n.ty = r.ty - 1) OR (n.tx = r.tx - 1 AND n.ty = r.ty - 1)) GROUP BY r.image_id, r.tx, r.ty, r.npix, r.bkg, r.rms, r.reliable)"""


@query(f"WITH {_GRID} SELECT image_id, tx, ty, npix, round(bkg, 4) AS bkg, round(rms, 4) AS rms, reliable FROM grid")
def bkg_grid(spark, sf_dir):
    return rounded(image.background(raster(spark, sf_dir), 16, 16))


_INTERP = f"""{_GRID}, f AS (SELECT image_id, ix, iy, v, (ix + 0.5) / 16 - 0.5 AS fx, (iy + 0.5) / 16 - 0.5 AS fy FROM px),
e AS (SELECT image_id, min(tx) AS ax, max(tx) AS bx, min(ty) AS ay, max(ty) AS by_ FROM grid GROUP BY 1),
k AS (SELECT f.image_id, ix, iy, v, least(greatest(CAST(floor(fx) AS BIGINT) + a, ax), bx) AS tx, least(greatest(CAST(floor(fy) AS BIGINT) + b, ay), by_) AS ty, (1 - abs(fx - floor(fx) - a)) * (1 - abs(fy - floor(fy) - b)) AS w
 FROM f JOIN e USING (image_id) CROSS JOIN (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) o(a, b)),
maps AS (SELECT k.image_id, ix, iy, v, sum(w * bkg) AS bkg, sum(w * rms) AS rms FROM k JOIN grid USING (image_id, tx, ty) GROUP BY 1, 2, 3, 4),
sig AS (SELECT *, CASE WHEN v <> 0 AND rms > 0 THEN (v - bkg) / rms ELSE 0 END AS z FROM maps)"""


@query(f"WITH {_INTERP} SELECT image_id, ix, iy, v, round(bkg, 4) AS bkg, round(rms, 4) AS rms FROM maps")
def bilinear_interpolation(spark, sf_dir):
    d = raster(spark, sf_dir)
    return rounded(image.interpolate(d, image.background(d, 16, 16), 16, 16))


def _significance(spark, sf_dir):
    d = raster(spark, sf_dir)
    return image.significance(image.interpolate(d, image.background(d, 16, 16), 16, 16))


@query(f"WITH {_INTERP} SELECT image_id, ix, iy, round(z, 3) AS z FROM sig")
def significance_map(spark, sf_dir):
    return rounded(_significance(spark, sf_dir).select("image_id", "ix", "iy", "z"), 3)


@query(f"WITH {PX} SELECT image_id, ix, iy, CASE WHEN v <> 0 AND v >= 150 THEN 1.0 ELSE 0.0 END AS binary_v, CASE WHEN v <> 0 AND (v < 50 OR v > 200) THEN 0.0 ELSE v END AS kept FROM px")
def thresholds(spark, sf_dir):
    return raster(spark, sf_dir).select(*image.PIXEL, image.binarize(F.col("v"), 150).alias("binary_v"), image.apply_threshold(F.col("v"), 50, 200).alias("kept"))


@query(f"WITH {PX} SELECT a.image_id, a.ix, a.iy, CASE WHEN a.v >= 100 THEN a.v ELSE 0.0 END AS v FROM px a")
def mask_join(spark, sf_dir):
    d = raster(spark, sf_dir)
    return image.masked(d, d.filter("v >= 100"))


@query(f"WITH {PX}, e AS (SELECT image_id, min(v) AS a, max(v) AS b FROM px WHERE v <> 0 GROUP BY 1) SELECT image_id, ix, iy, round(1 + 255 * (v - a) / (b - a), 4) AS v FROM px JOIN e USING (image_id)")
def normalised(spark, sf_dir):
    return rounded(image.normalise(raster(spark, sf_dir), 1.0, 256.0))


@query(f"WITH {PX}, e AS (SELECT image_id, min(v) AS a, max(v) AS b FROM px WHERE v <> 0 GROUP BY 1) SELECT image_id, ix, iy, round(100 * log10(1 + 255 * (v - a) / (b - a)) / log10(256), 4) AS v FROM px JOIN e USING (image_id)")
def normalised_log(spark, sf_dir):
    return rounded(image.normalise(raster(spark, sf_dir), 0.0, 100.0, "log"))


@query(f"WITH {PX} SELECT a.image_id, a.ix, a.iy, round(a.v - 0.5 * b.v, 4) AS v FROM px a JOIN px b ON b.image_id = 'R' AND a.ix = b.ix AND a.iy = b.iy WHERE a.image_id = 'A'")
def image_add(spark, sf_dir):
    d = raster(spark, sf_dir)
    return rounded(image.add(d.filter("image_id = 'A'"), d.filter("image_id = 'R'").withColumn("image_id", F.lit("A")), -0.5))


@query(f"WITH {PX} SELECT * FROM px WHERE ix BETWEEN 8 AND 40 AND iy BETWEEN 4 AND 20")
def image_crop(spark, sf_dir):
    return image.crop(raster(spark, sf_dir), 8, 40, 4, 20)


@query(f"""WITH {PX}, t AS (SELECT image_id, ix // 10 AS tx, iy // 10 AS ty, v FROM px)
SELECT image_id, tx, ty, count(*) AS n, round(avg(v), 4) AS mean, round(stddev_samp(v), 4) AS rms FROM t GROUP BY 1, 2, 3 HAVING count(*) > 2""")
def tile_stats(spark, sf_dir):
    d = image.tiled(raster(spark, sf_dir), 10, 10)
    return rounded(d.groupBy("image_id", "tx", "ty").agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("rms")).filter("n > 2"))


@query("SELECT x0, least(x0 + 19, 63) AS x1, y0, least(y0 + 19, 63) AS y1 FROM (VALUES (0), (10), (20), (30), (40), (50)) a(x0), (VALUES (0), (10), (20), (30), (40), (50)) b(y0)")
def tile_plan(spark, sf_dir):
    return spark.createDataFrame(image.plan_tiles(64, 64, 20, 20, 0.5), "x0 int, x1 int, y0 int, y1 int")


_BLOBS = """{base}, on_ AS (SELECT image_id, ix, iy, {z} AS z, ix * 64 + iy AS id FROM {src} WHERE {z} >= {merge}),
walk AS (SELECT image_id, id, ix, iy, z, id AS root FROM on_
 UNION SELECT b.image_id, b.id, b.ix, b.iy, b.z, w.root FROM walk w JOIN on_ b ON b.image_id = w.image_id AND ((abs(b.ix - w.ix) = 1 AND b.iy = w.iy) OR (abs(b.iy - w.iy) = 1 AND b.ix = w.ix)) WHERE w.root < b.id),
lab AS (SELECT image_id, id, ix, iy, z, min(root) AS blob FROM walk GROUP BY 1, 2, 3, 4, 5)"""


@query("WITH RECURSIVE " + _BLOBS.format(base=_INTERP, z="z", src="sig", merge=1.0) + " SELECT image_id, blob, count(*) AS npix, round(max(z), 3) AS zmax, min(ix) AS x0, max(ix) AS x1, min(iy) AS y0, max(iy) AS y1 FROM lab GROUP BY 1, 2 HAVING max(z) >= 2.0 AND count(*) >= 3")
def find_blobs(spark, sf_dir):
    """The flagship: raster, box background, significance, seeds and floods, blob statistics."""
    z = _significance(spark, sf_dir).select(*image.PIXEL, F.col("z").alias("v"))
    found = blobs.find_blobs(z, seed=2.0, merge=1.0, min_pixels=3, tile=32)
    stats = found.groupBy("image_id", "blob").agg(F.count("*").alias("npix"), F.round(F.max("v"), 3).alias("zmax"), *(f(c).alias(n) for n, f, c in (("x0", F.min, "ix"), ("x1", F.max, "ix"), ("y0", F.min, "iy"), ("y1", F.max, "iy"))))
    least = found.groupBy("image_id", "blob").agg(F.min(F.col("ix") * 64 + F.col("iy")).alias("first"))
    return stats.join(least, ["image_id", "blob"]).drop("blob").withColumnRenamed("first", "blob")


@query()
def blob_shapes(spark, sf_dir):
    z = _significance(spark, sf_dir).select(*image.PIXEL, F.col("z").alias("v"))
    return rounded(blobs.blob_moments(blobs.find_blobs(z, 2.0, 1.0, 3, 32)))


@query()
def iterative_source_finding(spark, sf_dir):
    return blobs.find_sources(raster(spark, sf_dir), box=16, seed=4.0, merge=2.0, min_pixels=3, rounds=2, step=0.5)


@query()
def saliency(spark, sf_dir):
    return rounded(segment.saliency_map(raster(spark, sf_dir), 8))


@query()
def superpixels(spark, sf_dir):
    return rounded(segment.region_stats(segment.superpixels(raster(spark, sf_dir), 8)))


@query()
def region_merging(spark, sf_dir):
    return segment.merge_regions(segment.superpixels(raster(spark, sf_dir), 8), rounds=3)


@query()
def chan_vese(spark, sf_dir):
    return segment.chan_vese(raster(spark, sf_dir), rounds=30)


def wide_lines(spark, sf_dir):
    """Every part and supplier its own pixel column and row: the image grows with the tables. A row a line; a pixel's lines are summed where its tile is."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("image_id"), F.col("l_partkey").alias("ix"), F.col("l_suppkey").alias("iy"), F.col("l_quantity").alias("v"))


def quickly_rounded(df, digits=4):
    """``rounded`` without decimals: halves away from zero, as DuckDB rounds; for columns of many rows."""
    def of(c):
        at = F.abs(c) * 10.0**digits
        up = F.when(at - F.floor(at) >= 0.5, 1.0).otherwise(0.0)
        return F.when(at < 2.0**52, F.signum(c) * (F.floor(at) + up) / 10.0**digits + 0.0).otherwise(F.col(c)).alias(c)

    return df.select(*(of(c) if t == "double" else F.col(c) for c, t in df.dtypes))


WIDE = "px AS (SELECT l_returnflag AS image_id, l_partkey AS ix, l_suppkey AS iy, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2, 3)"


def _cells(kernel, gap: int = 1) -> str:
    half = len(kernel) // 2
    return ", ".join(f"({(x - half) * gap}, {(y - half) * gap}, CAST({kernel[y][x]!r} AS DOUBLE))" for y in range(len(kernel)) for x in range(len(kernel)) if kernel[y][x])


def _conv_of(source: str, kernel, gap: int = 1) -> str:
    return f"(SELECT a.image_id, a.ix, a.iy, a.v, sum(coalesce(b.v, 0) * k.w) AS c FROM {source} a CROSS JOIN (VALUES {_cells(kernel, gap)}) k(dx, dy, w) LEFT JOIN {source} b ON b.image_id = a.image_id AND b.ix = a.ix - k.dx AND b.iy = a.iy - k.dy GROUP BY 1, 2, 3, 4)"


_UNEVEN = [[1.0, 2.0, 0.0], [0.5, 3.0, 1.0], [0.0, 4.0, 2.0]]


@query(f"""WITH {WIDE}, e AS (SELECT image_id, min(ix) AS x0, max(ix) AS x1, min(iy) AS y0, max(iy) AS y1 FROM px GROUP BY 1),
s AS (SELECT a.image_id, a.ix, a.iy, k.w, CASE WHEN a.ix - k.dx < x0 THEN 2 * x0 - a.ix + k.dx WHEN a.ix - k.dx > x1 THEN 2 * x1 - a.ix + k.dx ELSE a.ix - k.dx END AS mx,
  CASE WHEN a.iy - k.dy < y0 THEN 2 * y0 - a.iy + k.dy WHEN a.iy - k.dy > y1 THEN 2 * y1 - a.iy + k.dy ELSE a.iy - k.dy END AS my FROM px a JOIN e USING (image_id) CROSS JOIN (VALUES {_cells(_UNEVEN)}) k(dx, dy, w))
SELECT s.image_id, s.ix, s.iy, round(sum(s.w * coalesce(b.v, 0)), 4) AS c FROM s LEFT JOIN px b ON b.image_id = s.image_id AND b.ix = s.mx AND b.iy = s.my GROUP BY 1, 2, 3""")
def mirror_convolution(spark, sf_dir):
    return quickly_rounded(image.convolve(wide_lines(spark, sf_dir), {"c": _UNEVEN}, border="mirror").drop("v"))


@query(f"WITH {WIDE} SELECT image_id, ix, iy, round(c, 4) AS log FROM {_conv_of('px', image.LOG7)}")
def fixed_log_filter(spark, sf_dir):
    return quickly_rounded(image.log_filter(wide_lines(spark, sf_dir)).drop("v"))


_B3 = image.b3_kernel()


@query(f"""WITH {WIDE}, s1 AS (SELECT image_id, ix, iy, v AS before, c AS v FROM {_conv_of('px', _B3)}), s2 AS (SELECT image_id, ix, iy, v AS before, c AS v FROM {_conv_of('s1', _B3, 2)}), s3 AS (SELECT image_id, ix, iy, v AS before, c AS v FROM {_conv_of('s2', _B3, 4)})
SELECT image_id, ix, iy, 1::INT AS plane, round(before - v, 4) AS w FROM s1 UNION ALL SELECT image_id, ix, iy, 2, round(before - v, 4) FROM s2 UNION ALL SELECT image_id, ix, iy, 3, round(before - v, 4) FROM s3 UNION ALL SELECT image_id, ix, iy, 4, round(v, 4) FROM s3""")
def wavelet3(spark, sf_dir):
    return quickly_rounded(image.wavelet(wide_lines(spark, sf_dir), 3))


def _around(half: int) -> str:
    return ", ".join(f"({x}, {y})" for y in range(-half, half + 1) for x in range(-half, half + 1))


def _square(source: str, how: str) -> str:
    return f"(SELECT image_id, ix, iy, w AS v FROM (SELECT image_id, ix + dx AS ix, iy + dy AS iy, {how}(v) AS w FROM {source} CROSS JOIN (VALUES {_around(1)}) k(dx, dy) GROUP BY 1, 2, 3) JOIN px USING (image_id, ix, iy))"


@query(f"""WITH {WIDE}, lo AS {_square('px', 'min')}, hi AS {_square('px', 'max')}, op AS {_square('lo', 'max')}, cl AS {_square('hi', 'min')}
SELECT image_id, ix, iy, px.v - op.v AS tophat, cl.v - px.v AS blackhat FROM px JOIN op USING (image_id, ix, iy) JOIN cl USING (image_id, ix, iy)""")
def hat_transforms(spark, sf_dir):
    return image.morphologies(wide_lines(spark, sf_dir), ("tophat", "blackhat"), repeated="sum")


def _peak_sql(size: int) -> str:
    h = size // 2
    return f"""(SELECT p.image_id, p.ix, p.iy, p.v, {size} AS kernel FROM (SELECT px.* FROM px JOIN (SELECT image_id, ix + dx AS ix, iy + dy AS iy, max(v) AS top FROM px CROSS JOIN (VALUES {_around(h)}) k(dx, dy) GROUP BY 1, 2, 3) m USING (image_id, ix, iy) WHERE v = top AND v <> 0) p
 LEFT JOIN px l ON l.image_id = p.image_id AND l.ix = p.ix - 1 AND l.iy = p.iy - 1 JOIN e ON e.image_id = p.image_id WHERE (l.v IS NULL OR l.v <> p.v) AND p.ix BETWEEN x0 + {h} AND x1 - {h} AND p.iy BETWEEN y0 + {h} AND y1 - {h})"""


@query(f"""WITH {WIDE}, e AS (SELECT image_id, min(ix) AS x0, max(ix) AS x1, min(iy) AS y0, max(iy) AS y1 FROM px GROUP BY 1), k AS ({' UNION ALL '.join(f'SELECT * FROM {_peak_sql(n)}' for n in (3, 5, 7))})
SELECT a.image_id, a.ix, a.iy, a.v, n.kernels FROM k a JOIN (SELECT image_id, ix + dx AS ix, iy + dy AS iy, count(DISTINCT kernel) AS kernels FROM k CROSS JOIN (VALUES {_around(1)}) o(dx, dy) GROUP BY 1, 2, 3) n USING (image_id, ix, iy) WHERE a.kernel = 3 AND n.kernels >= 2""")
def peak_votes(spark, sf_dir):
    return image.multi_kernel_peaks(wide_lines(spark, sf_dir), repeated="sum")


_AVG = f"""{PX}, t AS (SELECT *, ix // 16 AS tx, iy // 16 AS ty FROM px), r AS (SELECT image_id, tx, ty, count(*) AS npix, avg(v) AS bkg, coalesce(stddev_samp(v), 0) AS rms FROM t GROUP BY 1, 2, 3)"""


@query(f"WITH {_AVG} SELECT image_id, tx, ty, npix, round(bkg, 4) AS bkg, round(rms, 4) AS rms FROM r WHERE npix >= 10")
def mean_background(spark, sf_dir):
    return rounded(image.background(raster(spark, sf_dir), 16, 16, "mean").filter("npix >= 10").drop("reliable"))


@query(f"""WITH {PX}, d AS (SELECT * FROM px WHERE v BETWEEN 20 AND 300), m AS (SELECT image_id, count(*) AS npix, median(v) AS bkg FROM d GROUP BY 1)
SELECT d.image_id, npix, round(bkg, 4) AS bkg, round(median(abs(v - bkg)) * 1.4826, 4) AS rms, npix >= 10 AS reliable FROM d JOIN m USING (image_id) GROUP BY d.image_id, npix, bkg""")
def global_background(spark, sf_dir):
    return rounded(image.sample_background(raster(spark, sf_dir), "median", 20.0, 300.0))


def _rounds(keys: str, source: str, rounds: int = 5) -> str:
    """CTEs of the clipped median and rms: s<n> holds each group's state after n rounds."""
    first = f"s0 AS (SELECT {keys}, median(v) AS med, coalesce(stddev_samp(v), 0) AS sd, false AS done FROM {source} GROUP BY {keys})"
    steps = [first]
    for n in range(1, rounds + 1):
        k = f"k{n} AS (SELECT {keys}, median(v) AS m2, coalesce(stddev_samp(v), 0) AS s2 FROM {source} JOIN s{n - 1} USING ({keys}) WHERE NOT done AND abs(v - med) < 3 * sd GROUP BY {keys})"
        s = f"s{n} AS (SELECT {keys}, CASE WHEN done OR m2 IS NULL THEN med ELSE m2 END AS med, CASE WHEN done OR m2 IS NULL THEN sd ELSE s2 END AS sd, done OR m2 IS NULL OR coalesce(abs(s2 / nullif(sd, 0) - 1) <= 0.1, true) AS done FROM s{n - 1} LEFT JOIN k{n} USING ({keys}))"
        steps += [k, s]
    return ", ".join(steps)


@query(f"WITH {PX}, t AS (SELECT *, ix // 16 AS tx, iy // 16 AS ty FROM px), {_rounds('image_id, tx, ty', 't')}, n AS (SELECT image_id, tx, ty, count(*) AS npix FROM t GROUP BY 1, 2, 3) SELECT image_id, tx, ty, npix, round(med, 4) AS bkg, round(sd, 4) AS rms FROM n JOIN s5 USING (image_id, tx, ty) WHERE npix >= 10")
def clipped_background(spark, sf_dir):
    return rounded(image.background(raster(spark, sf_dir), 16, 16, "clipped").filter("npix >= 10").drop("reliable"))


@query()
def biweight_background(spark, sf_dir):
    return rounded(image.background(raster(spark, sf_dir), 16, 16, "biweight"))


@query(f"""WITH {_INTERP}, q AS (SELECT image_id, ix // 16 AS tx, iy // 16 AS ty, v - bkg AS v FROM maps), qm AS (SELECT image_id, tx, ty, median(v) AS m FROM q GROUP BY 1, 2, 3), q2 AS (SELECT q.image_id, q.tx, q.ty, median(abs(v - m)) * 1.4826 AS rms2, any_value(m) AS m FROM q JOIN qm USING (image_id, tx, ty) GROUP BY 1, 2, 3)
SELECT image_id, tx, ty, npix, round(grid.bkg, 4) AS bkg, round(CASE WHEN rms2 > 0 THEN rms2 ELSE grid.rms END, 4) AS rms FROM grid JOIN q2 USING (image_id, tx, ty) WHERE npix >= 10""")
def second_pass_background(spark, sf_dir):
    return rounded(image.two_pass_background(raster(spark, sf_dir), 16, 16).filter("npix >= 10").drop("reliable"))
