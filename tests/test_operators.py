import numpy as np
import pytest

from pelorus.functions import scalars, stats, wcs
from pelorus.operators import blobs, classify, cuts, image, match, residual, sampling, segment, shapes, spectra
from pelorus.sources import catalogs, config, fits
from pyspark.sql import functions as F


def pixels(spark, array, image_id="a"):
    rows = [(image_id, int(x), int(y), float(array[x, y])) for x in range(array.shape[0]) for y in range(array.shape[1])]
    return spark.createDataFrame(rows, "image_id string, ix long, iy long, v double")


def as_array(df, shape, column):
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[r["ix"], r["iy"]] = r[column]
    return out


def test_order_statistics_beyond_the_small_case(spark):
    chance = np.random.default_rng(0)
    v = np.concatenate([chance.normal(size=20_000), np.full(20_000, 0.25)])
    d = spark.createDataFrame([("a", float(x)) for x in v] + [("b", 3.0), ("b", None), ("b", float("nan"))], "k string, v double")
    got = {r["k"]: r for r in stats.box_stats(d, ["k"], "v").collect()}
    q = np.quantile(v, [0.25, 0.5, 0.75])
    assert np.allclose([got["a"]["q1"], got["a"]["median"], got["a"]["q3"]], q) and got["a"]["max"] == v.max()
    assert got["b"]["n"] == 1 and got["b"]["median"] == 3.0
    assert stats.box_stats(d.limit(0), ["k"], "v").count() == 0


def test_convolution_and_morphology(spark):
    a = np.random.default_rng(1).random((7, 6))
    d = pixels(spark, a)
    pad = np.pad(a, 1)
    lap = sum(pad[1 + i : 8 + i, 1 + j : 7 + j] for i in (-1, 0, 1) for j in (-1, 0, 1)) - 9 * a
    assert np.allclose(as_array(image.laplacian(d), a.shape, "laplacian"), lap)
    inf = np.pad(a, 1, constant_values=-np.inf)
    dil = np.max([inf[1 + i : 8 + i, 1 + j : 7 + j] for i in (-1, 0, 1) for j in (-1, 0, 1)], axis=0)
    assert np.allclose(as_array(image.morphology(d), a.shape, "m"), dil)
    assert (as_array(image.morphology(d, "tophat"), a.shape, "m") >= -1e-12).all()
    kernel = [[1, 2, 0], [0, 0, 0], [0, 0, 3]]
    k = image.convolve(d, {"c": kernel})
    # flipped: out(p) sums k(o) in(p - o), x across and y down the kernel
    expect = sum(kernel[y][x] * pad[1 - (x - 1) : 8 - (x - 1), 1 - (y - 1) : 7 - (y - 1)] for y in range(3) for x in range(3))
    assert np.allclose(as_array(k, a.shape, "c"), expect)
    planes = image.wavelet(d, 2).groupBy("ix", "iy").agg(F.sum("w").alias("s"))
    assert np.allclose(as_array(planes, a.shape, "s"), a)


def test_blobs_across_tiles_and_diagonals(spark):
    a = np.zeros((20, 20))
    a[2:15, 7] = 3.0  # crosses tile borders
    a[14, 7] = 6.0
    a[16, 16], a[17, 17] = 6.0, 6.0  # touch by a corner only
    a[0, 0:5] = 3.0  # no seed
    found = blobs.find_blobs(pixels(spark, a), 5.0, 2.6, 1, tile=6)
    sizes = sorted(r["count"] for r in found.groupBy("blob").count().collect())
    assert sizes == [1, 1, 13]
    assert blobs.find_blobs(pixels(spark, a * 0), 5.0, 2.6, 1, tile=6).count() == 0
    m = blobs.blob_moments(found).filter("npix = 13").first()
    assert (m["x0"], m["x1"], m["y0"], m["y1"]) == (2, 14, 7, 7)


def test_cuts():
    parsed = cuts.parse_cuts("# c\nb T <> AND {1} {2}\na F == OR {1,2}\n")
    assert [c.name for c in parsed] == ["a", "b"]
    with pytest.raises(ValueError):
        cuts.parse_cuts("a T ~~ OR {1}")


def test_cut_semantics(spark):
    d = spark.createDataFrame([(1, 1.0, [(5.0, 1)]), (2, 2.0, [(0.1, 2)]), (3, None, [])], "n int, v double, components array<struct<flux:double,morph_id:int>>")
    ids = lambda text, **k: sorted(r["n"] for r in cuts.select(d, cuts.parse_cuts(text), **k).collect())
    assert ids("v T >< OR {1} {2}") == [1, 2] and ids("v T <> OR {1} {2}") == [1, 2] and ids("n T >= OR {1.9}") == [1, 2, 3]
    assert ids("fitComponentFlux T >= OR {1}") == [1]
    with pytest.raises(ValueError):
        ids("nothing T == OR {1}")
    with pytest.warns(UserWarning):
        assert ids("nothing T == OR {1}", unknown="pass") == [1, 2, 3]
    assert ids("nothing F == OR {1}") == [1, 2, 3]


def test_isolated_components(spark):
    c = [(1.0, 0.0, 0.0), (5.0, 1.0, 1.0), (3.0, 9.0, 0.5), (2.0, 9.5, 1.0), (None, 50.0, 50.0)]
    d = spark.createDataFrame([(1, True, c), (2, False, c), (3, True, [])], "n int, has_fit boolean, components array<struct<a:double,x0:double,y0:double>>")
    got = {r["n"]: sorted(e["x0"] for e in r["components"]) for r in cuts.select(d, cuts.parse_cuts("fitComponentIsolatedCentroid T >= AND {2}")).collect()}
    assert got == {1: [1.0, 9.0, 50.0], 2: [0.0, 1.0, 9.0, 9.5, 50.0]}


def test_a_cut_file_of_all_names(spark):
    lines = [f"{n} F >= AND {{1}}" for n in (*cuts.ISLAND, *cuts.COMPONENT, cuts.ISOLATED)]
    assert len(lines) == 31 and cuts.select(spark.range(3), cuts.parse_cuts("\n".join(lines))).count() == 3


def test_matches_and_cliques(spark):
    a = spark.createDataFrame([(1, 0.0, 0.0), (2, 5.0, 5.0), (3, None, 1.0)], "id long, x double, y double")
    b = spark.createDataFrame([(1, 0.5, -0.5), (2, 0.5, 0.5), (3, 9.0, 9.0)], "id long, x double, y double")
    m = match.box_join(a, b, 0.5)
    assert sorted((r["left_id"], r["right_id"]) for r in m.collect()) == [(1, 1), (1, 2)]
    assert [(r["left_id"], r["right_id"]) for r in match.best(m).collect()] == [(1, 1)]
    edges = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (3, 4), (4, 1), (4, 2), (5, 1)], "a long, b long")
    assert [r["members"] for r in match.cliques(edges, 4).collect()] == [[1, 2, 3, 4]]


def test_label_components_on_a_chain(spark):
    d = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 101), (None, 1)], "a long, b long")
    for bounded in (0, 1000):
        got = {r["node"]: r["component"] for r in blobs.label_components(d, bounded=bounded).collect()}
        assert got == {**{i: 0 for i in range(51)}, 100: 100, 101: 100}
    assert blobs.label_components(d.limit(0)).count() == 0


def test_fits_round_trip(spark, tmp_path):
    a = np.random.default_rng(2).random((11, 5)).astype("f4")
    path = str(tmp_path / "img.fits")
    fits.write_fits(path, a, {"BUNIT": "JY/BEAM", "BMAJ": 0.01, "CRVAL3": 1.4e9, "NOTE": "it''s"})
    meta = fits.metadata(path)
    assert (meta["nx"], meta["ny"], meta["bunit"], meta["bmaj"], meta["epoch"]) == (5, 11, "JY/BEAM", 0.01, 2000.0)
    got = {(r["ix"], r["iy"]): r["v"] for r in fits.read_fits(spark, path).collect()}
    assert len(got) == 55 and np.isclose(got[(4, 10)], a[10, 4])
    assert fits.read_fits(spark, path, (1, 2, 3, 5)).count() == 6


def test_catalogue_formats(spark):
    lines = spark.createDataFrame([("# c",), ("1|NGC 1|Star?|10.5 -20.25",), ("2|bad",), ("",)], "value string")
    got = catalogs.parse(lines, "simbad").collect()
    assert (got[0]["name"], got[0]["class"], got[0]["confirmed"], got[0]["ra"], got[0]["dec"]) == ("NGC 1", "Star", False, 10.5, -20.25)
    assert got[1]["error"] and got[1]["ra"] is None
    with pytest.raises(Exception, match="fields"):
        catalogs.parse(lines, "simbad", strict=True).collect()
    for name, layout in catalogs.LAYOUTS.items():
        sep = "|" if "|" in layout.delimiter else " "
        d = spark.createDataFrame([(sep.join("7" for _ in range(layout.fields[0])),)], "value string")
        row = catalogs.parse(d, name).first()
        assert row["error"] is None and row["name"], name


def test_config():
    assert config.parse("seedThr = 6 # high\nuseTiles=true\n")["seedThr"] == 6.0
    for bad in ("seedThr = -1", "minNPix = x", "seedThr 5"):
        with pytest.raises(ValueError):
            config.parse(bad)
    with pytest.warns(UserWarning):
        config.parse("nothing = 1")


def test_scalars(spark):
    one = spark.range(1)
    square = F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (2, 0), (2, 2), (0, 2))))
    r = one.select(
        scalars.polygon_area(square).alias("area"), scalars.in_polygon(F.lit(1.0), F.lit(1.0), square).alias("inside"), scalars.iau_name(F.lit(15.0), F.lit(-30.5)).alias("iau"),
        scalars.deconvolved(F.lit(5.0), F.lit(4.0), F.lit(20.0), F.lit(3.0), F.lit(3.0), F.lit(0.0)).alias("d"), scalars.decode_ids(F.lit("00120003"), 4).alias("ids"), scalars.base_name(F.lit("/a/b.c.txt"), True).alias("base"),
    ).first()
    assert r["area"] == 4.0 and r["inside"] and r["iau"] == "J010000.0-303000" and r["ids"] == [12, 3] and r["base"] == "b.c"
    assert np.isclose(r["d"]["bmaj"], 4.0) and np.isclose(r["d"]["pa"], 20.0)


def test_fits_and_unfolding(spark):
    x = np.linspace(-0.5, 1.0, 12)
    rows = [(1, float(a), float(1.0 - 0.7 * a), 0.05) for a in x]
    d = spark.createDataFrame(rows, "id long, lg_nu double, lg_s double, lg_err double")
    assert np.isclose(spectra.power_law_fit(d, ["id"]).first()["alpha"], -0.7)
    fitted = {r["model"]: r for r in spectra.spectral_fits(d, "id").collect()}
    assert fitted["pol3"]["chi2"] < 1e-6
    yy, xx = np.mgrid[0:15, 0:15]
    v = 10 * np.exp(-((xx - 7) ** 2 / 8 + (yy - 6) ** 2 / 4.5))
    px = spark.createDataFrame([(1, int(a), int(b), float(c)) for a, b, c in zip(xx.ravel(), yy.ravel(), v.ravel())], "source_id long, ix long, iy long, v double")
    g = spectra.gauss_mixture(px, 1).first()
    assert np.isclose(g["amp"], 10, rtol=0.02) and np.isclose(g["x"], 7, atol=0.05) and np.isclose(g["y"], 6, atol=0.05)
    best, spread = spectra.unfold(np.array([100.0, 50.0, 25.0, 12.0]), np.eye(4), np.arange(4.0), toys=5)
    assert np.allclose(best, [100, 50, 25, 12.5], rtol=0.1) and (spread > 0).all()


def test_segmentation(spark):
    a = np.zeros((12, 12))
    a[3:9, 3:9] = 10.0
    inside = as_array(segment.chan_vese(pixels(spark, a), 40), a.shape, "inside")
    assert inside[5, 5] == 1 and inside[0, 0] == 0
    labelled = segment.superpixels(pixels(spark, a), 4, rounds=2)
    assert labelled.count() == 144
    assert segment.saliency(segment.region_stats(labelled)).filter("saliency < 0 or saliency > 1").count() == 0


def test_sources_merge_at_edges(spark):
    d = spark.createDataFrame([(1, "a", 0, 0, 1.0), (1, "a", 0, 1, 1.0), (2, "a", 1, 2, 1.0), (3, "a", 9, 9, 1.0)], "source_id long, image_id string, ix long, iy long, v double")
    assert sorted(map(tuple, blobs.merge_at_edges(d).collect())) == [(1, 1), (2, 1), (3, 3)]


def test_outlines_and_overlaps(spark):
    square = shapes.outline(np.array([0.0, 2, 2, 0, 1]), np.array([0.0, 0, 2, 2, 1]))
    assert len(square) == 4 and shapes.area(square) == 4.0
    assert np.isclose(shapes.area(shapes.clip(square + 1, square)), 1.0) and shapes.area(shapes.clip(square + 5, square)) == 0.0
    assert np.allclose(shapes.narrowest_box(square), (2, 2))
    row = dict(x1=0.0, y1=0.0, a1=2.0, b1=1.0, t1=10.0, x2=0.0, y2=0.0, a2=4.0, b2=3.0, t2=0.0)
    far = row | {"x2": 50.0}
    got = shapes.ellipse_overlaps(spark.createDataFrame([row, far])).collect()
    assert sorted(r["flag"] for r in got) == [0, 2] and np.isclose(max(r["overlap"] for r in got), 2 * np.pi, rtol=0.01)
    turned = shapes.hu_moments(np.array([0.0, 0, 0, 1]), np.array([0.0, 1, 2, 0]), np.ones(4))
    assert np.allclose(turned, shapes.hu_moments(np.array([0.0, 1, 2, 0]) * -1, np.array([0.0, 0, 0, 1]), np.ones(4)))


def test_projections(spark):
    one = spark.range(1)
    head = [F.lit(v) for v in (50.0, 60.0, 359.99, -40.0, -0.01, 0.01)]
    for name in ("TAN", "SIN", "CAR"):
        sky = wcs.pixel_to_sky(F.lit(10.0), F.lit(90.0), *head, projection=name)
        r = one.select(sky.alias("s")).select("s", wcs.sky_to_pixel(F.col("s.ra"), F.col("s.dec"), *head, projection=name).alias("p")).first()
        assert np.allclose([r["p"]["ix"], r["p"]["iy"]], [10, 90], atol=1e-6) and 0 <= r["s"]["ra"] < 360


def test_residuals(spark):
    a = np.zeros((9, 9))
    a[4, 4], a[4, 5] = 5.0, 4.0
    d = pixels(spark, a)
    dome = as_array(residual.h_domes(d, 1.0), a.shape, "dome")
    assert np.isclose(dome[4, 4], 1.0) and np.isclose(dome[0, 0], 0.0)
    assert np.allclose(as_array(residual.guided_filter(pixels(spark, a * 0 + 3.0), 1, 0.1), a.shape, "smooth"), 3.0)
    src = spark.createDataFrame([("a", 1, 4.0, 4.0)], "image_id string, id long, x double, y double")
    assert residual.aperture_fluxes(d, src, 1.0, cell=3).first()["flux"] == 9.0


def test_classifier(spark):
    chance = np.random.default_rng(3)
    rows = [(float(x), float(y), int(x + y > 0)) for x, y in chance.normal(size=(300, 2))] + [(None, 1.0, 1), (float("nan"), 1.0, 0)]
    d = spark.createDataFrame(rows, "u double, w double, real int")
    e = classify.efficiencies(classify.apply(classify.train(d, ["u", "w"], "real"), d, ["u", "w"]), "real").first()
    assert e["n"] == 300 and e["efficiency"] > 0.9 and e["purity"] > 0.9


def test_samples_and_pairs(spark):
    got = sorted(map(tuple, sampling.triangle_pairs(spark, 5).collect()))
    assert [g[2] for g in got] == list(range(10)) and sampling.triangle_pairs(spark, 1).count() == 0
    d = spark.range(2000).withColumnRenamed("id", "k")
    assert {r["k"] for r in sampling.random_k(d, "k", 10).collect()} == {r["k"] for r in sampling.random_k(d.repartition(7), "k", 10).collect()}
    assert abs(sampling.resamples(d, "k", 5).count() - 10_000) < 500
    p = sampling.positions_in_box(d, "k", -1.0, 1.0, -1.0, 1.0, lambda x, y: x * x + y * y <= 1.0)
    assert p.filter("x * x + y * y > 1 or x is null").count() == 0


def test_watershed_and_nesting(spark):
    a = np.zeros((9, 9))
    a[2, 2], a[2, 3], a[6, 6], a[4, 4] = 5, 3, 4, 1
    w = segment.watershed(pixels(spark, a), 0.5)
    assert {(r["ix"], r["iy"]): r["basin"] for r in w.collect()} == {(2, 2): 2_000_000_002, (2, 3): 2_000_000_002, (6, 6): 6_000_000_006, (4, 4): 4_000_000_004}
    outer = pixels(spark, np.ones((4, 4))).withColumn("blob", F.lit(1))
    inner = pixels(spark, np.ones((2, 2))).withColumn("blob", F.lit(7))
    assert [tuple(r) for r in segment.nested_blobs(outer, inner).collect()] == [(7, 1)]
