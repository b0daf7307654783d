"""Queries of measurements around sources, shapes, projections and the classifier, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from pelorus.functions import stats, wcs
from pelorus.operators import blobs, classify, image, residual, sampling, segment, shapes
from pelorus.plans.imagequeries import PX, _significance, raster, rounded
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


def _sources(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    return s.select(F.lit("A").alias("image_id"), F.col("s_suppkey").alias("id"), F.pmod(F.col("s_suppkey") * 37, F.lit(64)).cast("double").alias("x"), F.pmod(F.col("s_suppkey") * 11, F.lit(64)).cast("double").alias("y"), (F.col("s_acctbal") / 1000.0).alias("amp"))


_SRC = "src AS (SELECT 'A' AS image_id, s_suppkey AS id, CAST(s_suppkey * 37 % 64 AS DOUBLE) AS x, CAST(s_suppkey * 11 % 64 AS DOUBLE) AS y, s_acctbal / 1000.0 AS amp FROM supplier)"


@query(f"WITH {PX}, {_SRC} SELECT id, coalesce(sum(v), 0.0) AS flux, count(v) AS npix FROM src LEFT JOIN px ON px.image_id = src.image_id AND power(ix - x, 2) + power(iy - y, 2) <= 12.25 GROUP BY 1")
def aperture_fluxes(spark, sf_dir):
    return residual.aperture_fluxes(raster(spark, sf_dir), _sources(spark, sf_dir), 3.5)


@query(f"""WITH {PX}, {_SRC}, m AS (SELECT p.image_id, p.ix, p.iy, p.v, sum(amp * exp(-0.5 * (power((ix - x) / 1.5, 2) + power((iy - y) / 1.5, 2)))) AS m FROM px p LEFT JOIN src s ON s.image_id = p.image_id AND abs(ix - x) <= 8 AND abs(iy - y) <= 8 GROUP BY 1, 2, 3, 4)
SELECT image_id, ix, iy, round(v - coalesce(m, 0), 4) AS v FROM m""")
def model_subtraction(spark, sf_dir):
    c = _sources(spark, sf_dir).withColumns({"sx": F.lit(1.5), "sy": F.lit(1.5), "theta": F.lit(0.0)})
    return rounded(residual.subtract_model(raster(spark, sf_dir), c))


@query(f"WITH {PX}, {_SRC} SELECT image_id, ix, iy, CASE WHEN EXISTS (SELECT 1 FROM src WHERE src.image_id = px.image_id AND abs(x - ix) <= 1 AND abs(y - iy) <= 1) THEN 0.0 ELSE v END AS v FROM px")
def dilated_sources(spark, sf_dir):
    s = _sources(spark, sf_dir).select("image_id", F.col("x").cast("long").alias("ix"), F.col("y").cast("long").alias("iy"))
    return residual.dilate_sources(raster(spark, sf_dir), s, 3)


@query(f"""WITH {PX}, s AS (SELECT DISTINCT 'A' AS image_id, s_suppkey * 37 % 64 AS ix, s_suppkey * 11 % 64 AS iy, s_suppkey AS blob FROM supplier),
f AS (SELECT * FROM px WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.image_id = px.image_id AND s.ix = px.ix AND s.iy = px.iy)),
b AS (SELECT image_id, blob, min(ix) - 2 AS x0, max(ix) + 2 AS x1, min(iy) - 2 AS y0, max(iy) + 2 AS y1 FROM s GROUP BY 1, 2),
n AS (SELECT blob, v FROM f JOIN b ON b.image_id = f.image_id AND ix BETWEEN x0 AND x1 AND iy BETWEEN y0 AND y1),
m AS (SELECT blob, count(*) AS n, median(v) AS bkg FROM n GROUP BY 1)
SELECT blob, m.n, round(bkg, 4) AS bkg, round(median(abs(v - bkg)) * 1.4826, 4) AS rms FROM n JOIN m USING (blob) GROUP BY 1, 2, 3""")
def local_background(spark, sf_dir):
    """Every supplier is a source of its own; the pixels of all of them are masked."""
    s = _sources(spark, sf_dir).select("image_id", F.col("x").cast("long").alias("ix"), F.col("y").cast("long").alias("iy"), F.col("id").alias("blob"))
    return rounded(residual.local_background(raster(spark, sf_dir), s, 2))


@query("SELECT 'C' || CAST(j * 5 + i AS VARCHAR) AS name, 'circle' AS shape, 10.0 + i * 2.0 AS cx, -5.0 + j * 2.5 AS cy, 0.5 AS r FROM range(5) a(i), range(5) b(j)")
def circle_grid(spark, sf_dir):
    return residual.circle_grid(spark, 10.0, 18.0, 2.0, -5.0, 5.0, 2.5, 0.5)


@query()
def h_domes(spark, sf_dir):
    return rounded(residual.h_domes(raster(spark, sf_dir), 40.0))


def _box_means(source: str, columns: list[str]) -> str:
    """Means over 5 x 5 of the existing pixels, by scattering."""
    around = ", ".join(f"({x}, {y})" for y in range(-2, 3) for x in range(-2, 3))
    return f"(SELECT m.* FROM (SELECT image_id, ix + dx AS ix, iy + dy AS iy, {', '.join(f'avg({c}) AS m{k}' for k, c in enumerate(columns))} FROM {source} CROSS JOIN (VALUES {around}) o(dx, dy) GROUP BY 1, 2, 3) m JOIN px USING (image_id, ix, iy))"


@query(f"""WITH {PX}, s AS {_box_means('px', ['v', 'v * v'])}, c AS (SELECT image_id, ix, iy, m0, (m1 - m0 * m0) / (m1 - m0 * m0 + 100) AS a FROM s), d AS (SELECT *, m0 * (1 - a) AS b FROM c), e AS {_box_means('d', ['a', 'b'])}
SELECT image_id, ix, iy, round(m0 * v + m1, 4) AS smooth FROM e JOIN px USING (image_id, ix, iy)""")
def guided_filter(spark, sf_dir):
    return rounded(residual.guided_filter(raster(spark, sf_dir), 2, 100.0))


@query("SELECT meta_id, round(((xc % 360) + 360) % 360, 6) AS ra, round(yc, 6) AS dec, 10.0 AS ix, 20.0 AS iy FROM (SELECT meta_id, CAST(xc AS DOUBLE) AS xc, CAST(yc AS DOUBLE) AS yc, dx, dy FROM imgmeta) WHERE abs(yc) < 85 AND abs(dx) > 1e-9 AND abs(dy) > 1e-9")
def wcs_round_trip(spark, sf_dir):
    """The reference pixel on the sky, and another pixel to the sky and back."""
    m = table(spark, sf_dir, "imgmeta").select("meta_id", *(F.col(c).cast("double").alias(c) for c in ("cx", "cy", "xc", "yc", "dx", "dy"))).filter("abs(yc) < 85 and abs(dx) > 1e-9 and abs(dy) > 1e-9")
    head = [F.col(c) for c in ("cx", "cy", "xc", "yc", "dx", "dy")]
    # a pixel ten by twenty beyond the reference keeps clear of the projection's edge
    d = m.withColumn("at", wcs.pixel_to_sky(F.col("cx") - 1, F.col("cy") - 1, *head, projection="SIN")).withColumn("off", wcs.pixel_to_sky(F.col("cx") + 9, F.col("cy") + 19, *head, projection="SIN"))
    back = wcs.sky_to_pixel(F.col("off.ra"), F.col("off.dec"), *head, projection="SIN")
    d = d.withColumn("back", back)
    return d.select("meta_id", F.round("at.ra", 6).alias("ra"), F.round("at.dec", 6).alias("dec"), F.round(F.col("back.ix") - F.col("cx") + 1, 3).alias("ix"), F.round(F.col("back.iy") - F.col("cy") + 1, 3).alias("iy"))


@query()
def blob_shape_parameters(spark, sf_dir):
    z = _significance(spark, sf_dir).select(*image.PIXEL, F.col("z").alias("v"))
    return shapes.blob_shapes(blobs.find_blobs(z, 2.0, 1.0, 3, 32).select("blob", "ix", "iy", "v"))


@query()
def ellipse_overlaps(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    e = {f"{c}{k}": v for k, (x, t) in ((1, (0.0, 30.0)), (2, (5.0, -20.0))) for c, v in (("x", F.lit(x)), ("y", F.lit(0.0)), ("a", F.col("p_size") + 1.0), ("b", F.col("p_size") / 2.0 + 1.0), ("t", F.lit(t)))}
    return shapes.ellipse_overlaps(p.select("p_partkey", "p_size").withColumns(e)).select("p_partkey", F.round("overlap", 3).alias("overlap"), "flag")


@query()
def component_classifier(spark, sf_dir):
    c = table(spark, sf_dir, "components").select("comp_id", F.log10(F.when(F.col("a") > 0, F.col("a"))).alias("lg_a"), F.col("npix").cast("double").alias("npix"), F.try_divide("chi2", "ndf").alias("red"), (F.col("sourcenessid") == 2).cast("int").alias("fake"))
    features = ["lg_a", "npix", "red"]
    model = classify.train(c, features, "fake", (6,))
    return classify.efficiencies(classify.apply(model, c, features), "fake")


@query("SELECT a.i, b.j, a.i * 40 - a.i * (a.i + 3) // 2 + b.j - 1 AS packed FROM range(40) a(i), range(40) b(j) WHERE a.i < b.j")
def triangle_pairs(spark, sf_dir):
    return sampling.triangle_pairs(spark, 40)


@query("SELECT name, count(*) AS n FROM skyobjects WHERE name IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def duplicate_names(spark, sf_dir):
    return sampling.duplicates(table(spark, sf_dir, "skyobjects"), "name")


@query()
def random_sample(spark, sf_dir):
    return sampling.random_k(table(spark, sf_dir, "orders"), "o_orderkey", 100).select("o_orderkey")


@query()
def random_positions(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select("s_suppkey")
    return sampling.positions_in_box(s, "s_suppkey", -1.0, 1.0, -1.0, 1.0, lambda x, y: x * x + y * y <= 1.0)


@query()
def multi_saliency(spark, sf_dir):
    return rounded(segment.multi_saliency(raster(spark, sf_dir), (8, 16)))


@query()
def global_threshold(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.lit("a").alias("k"), "value")
    h = stats.histogram(e, "value", 40)
    return rounded(segment.optimal_threshold(stats.otsu(h, 40), segment.valley_threshold(h), stats.medians(e, ["k"], "value")))


@query()
def watershed(spark, sf_dir):
    return segment.watershed(raster(spark, sf_dir), 100.0)


@query()
def nested_blobs(spark, sf_dir):
    z = _significance(spark, sf_dir).select(*image.PIXEL, F.col("z").alias("v"))
    return segment.nested_blobs(blobs.find_blobs(z, 2.0, 0.5, 4, 32), blobs.find_blobs(z, 2.5, 2.0, 1, 32))
