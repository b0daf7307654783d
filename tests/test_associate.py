"""Associations, scalar functions and contours on small fixtures: nulls, empty tables, ties and brute force."""

from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from pelorus.functions import contours, scalars
from pelorus.operators import associate, image

BOX = "id long, x0 double, x1 double, y0 double, y1 double"


def test_boxes_once_each(spark):
    rows = [(1, 0.0, 25.0, 0.0, 25.0), (2, 20.0, 21.0, 20.0, 40.0), (3, 25.0, 30.0, 0.0, 5.0), (4, None, 1.0, 0.0, 1.0), (5, float("nan"), 1.0, 0.0, 1.0), (6, -3.0, 0.5, -3.0, 0.5)]
    d = spark.createDataFrame(rows, BOX)
    got = sorted((r["left_id"], r["right_id"]) for r in associate.box_overlap_join(d, d, 4.0).collect())
    assert got == [(1, 1), (1, 2), (1, 6), (2, 1), (2, 2), (3, 3), (6, 1), (6, 6)]
    assert associate.box_overlap_join(d.limit(0), d, 4.0).count() == 0


def test_shape_match_rules(spark):
    def square(i, x, half, flux):
        return (i, x, 0.0, flux, [(x - half, -half), (x + half, -half), (x + half, half), (x - half, half)])

    schema = "id long, x double, y double, flux double, verts array<struct<x:double,y:double>>"
    a = spark.createDataFrame([square(1, 0.0, 2.0, 1.0), (2, 0.0, 0.0, 1.0, None), (3, None, 0.0, 1.0, None)], schema)
    b = spark.createDataFrame([square(1, 0.5, 0.5, 1.5), square(2, 1.0, 2.0, 9.0), square(3, 3.5, 2.0, 1.0), square(4, 9.0, 2.0, 1.0), (5, 0.1, 0.0, None, [(0.0, 0.0)])], schema)
    ids = lambda **k: sorted((r["left_id"], r["right_id"]) for r in associate.shape_match(a, b, 4.0, **k).collect())
    assert ids() == [(x, y) for x in (1, 2) for y in (1, 2, 3, 5)]
    assert ids(overlap=0.5) == [(1, 1), (1, 2)] and ids(overlap=0.5, area_ratio=True) == [(1, 2)]
    assert ids(overlap=0.5, high_radius=3.6) == [(1, 1), (1, 2), (1, 3)] and ids(overlap=0.5, flux_difference=0.5) == [(1, 1)]
    assert associate.shape_match(a.limit(0), b, 4.0).count() == 0


def test_maximal_cliques_against_enumeration(spark):
    edges = [(1, 2), (2, 3), (1, 3), (3, 4), (4, 5), (5, 3), (6, 7), (7, 6), (8, 8), (None, 9), (1, 4), (2, 4)]
    linked = {frozenset(e) for e in edges if None not in e and e[0] != e[1]}
    all_ = [set(c) for n in (2, 3, 4) for c in combinations(range(1, 8), n) if all(frozenset(p) in linked for p in combinations(c, 2))]
    expected = sorted(sorted(c) for c in all_ if not any(c < o for o in all_))
    d = spark.createDataFrame(edges, "a long, b long")
    assert sorted(r["members"] for r in associate.maximal_cliques(d, 4).collect()) == expected
    with pytest.raises(ValueError):
        associate.maximal_cliques(d, 3)
    assert associate.maximal_cliques(d.limit(0), 3).count() == 0


def test_components_dropped_with_their_covariance(spark):
    d = spark.createDataFrame([([1.0, 2.0, 3.0], [[float(10 * i + j) for j in range(6)] for i in range(6)])], "c array<double>, m array<array<double>>")
    parts = associate.without_components(F.col("c"), F.col("m"), F.array(F.lit(1)), 2)
    row = d.select(parts[0].alias("c"), parts[1].alias("m")).first()
    assert row["c"] == [1.0, 3.0] and row["m"] == [[float(10 * i + j) for j in (0, 1, 4, 5)] for i in (0, 1, 4, 5)]


def test_strings_and_arrays_of_odd_input(spark):
    d = spark.createDataFrame([("a.b..c",), ("",), (None,), ("x.",)], "s string")
    got = d.select(scalars.split_on(F.col("s"), ".").alias("p"), scalars.part_of(F.col("s"), ".").alias("l"), scalars.part_of(F.col("s"), ".", False).alias("r"), scalars.typed(scalars.split_on(F.col("s"), "."), "int").alias("t")).collect()
    assert [r["p"] for r in got] == [["a", "b", "", "c"], [], None, ["x"]] and [r["l"] for r in got] == ["a", "", None, "x"] and [r["r"] for r in got] == ["b..c", "", None, ""]
    assert got[0]["t"] == [None] * 4
    e = spark.createDataFrame([([3, 1, None], [1, 1]), ([], []), (None, None)], "a array<int>, b array<int>")
    pairs = [r["p"] for r in e.select(scalars.common_positions(F.col("a"), F.col("b")).alias("p")).collect()]
    assert [tuple(p) for p in pairs[0]] == [(0, 0)] and pairs[1] == [] and pairs[2] is None
    bad = spark.createDataFrame([("1:2:3 4:5:6 xyz",), ("1:2 3:4:5 FK5",), (None,), ("12:34:5.5 -1:2:3 galactic",)], "s string")
    assert [r[0] for r in bad.select(scalars.iau_coordinates(F.col("s"))).collect()] == [None, None, None, "G12345.5-10203"]


def test_contours_fits_and_draws(spark):
    z = np.exp(2j * np.pi * np.arange(32) / 32) * 3 + 5
    assert np.allclose(np.fft.ifft(contours.dft(z)), contours.idft(contours.dft(z))) and len(contours.dft(z, 5)) == 5
    c = contours.curvature(z, 0.0)
    assert np.allclose(np.abs(c), np.abs(c[0])) and np.allclose(contours.bending_energy(z, (1e-7,)), contours.bending_energy(2 * z + 1, (1e-7,)))
    assert not contours.curvature(z[:2], 0.1).any() and not contours.bending_energy(z[:1]).any()
    assert contours.conic_ellipse(contours.fitted_conic(np.arange(6.0), np.arange(6.0))) is None
    p = "array<struct<x:double,y:double>>"
    d = spark.createDataFrame([(1, [(float(v.real), float(v.imag)) for v in z]), (2, [(0.0, 0.0)]), (3, None)], f"id int, p {p}")
    fit = {r["id"]: r["e"] for r in d.select("id", contours.fit_ellipse(F.col("p")).alias("e")).collect()}
    assert fit[1]["r1"] == pytest.approx(3) and fit[1]["x"] == pytest.approx(5) and fit[2] is None and fit[3] is None
    cov = F.array(F.array(F.lit(4.0), F.lit(1.0)), F.array(F.lit(1.0), F.lit(1.0)))
    got = np.array(spark.range(1).select(contours.draws(F.array(F.lit(1.0), F.lit(-1.0)), cov, 4000, F.col("id"))).first()[0])
    assert np.allclose(got.mean(0), [1, -1], atol=0.15) and np.allclose(np.cov(got.T), [[4, 1], [1, 1]], atol=0.3)
    one = spark.range(1).select(contours.mahalanobis(F.array(F.lit(1.0)), F.array(F.array(F.lit(0.0)))).alias("m")).first()["m"]
    assert one is None


def test_background_estimators(spark):
    v = np.random.default_rng(3).normal(50, 4, 400)
    v[:8] = 900
    d = spark.createDataFrame([("a", i % 20, i // 20, float(x)) for i, x in enumerate(v)] + [("b", 0, 0, None), ("b", 1, 0, 5.0)], "image_id string, ix long, iy long, v double")
    for estimator in ("biweight", "clipped"):
        box = {r["image_id"]: (r["bkg"], r["rms"]) for r in image.background(d, 100, 100, estimator).collect()}
        got = {r["image_id"]: r for r in image.sample_background(d, estimator).collect()}
        assert abs(got["a"]["bkg"] - 50) < 1 and abs(got["a"]["rms"] - 4) < 1 and got["a"]["reliable"] and not got["b"]["reliable"]
        # the same in one task for a box as over tasks for an image
        assert all(box[i] == pytest.approx((got[i]["bkg"], got[i]["rms"])) for i in "ab")
    assert image.sample_background(d, "mean", high=100.0).filter("image_id = 'a'").first()["npix"] == 392
    with pytest.raises(ValueError):
        image.sample_background(d, "guess")
    twice = image.two_pass_background(d.filter("image_id = 'a'"), 10, 10).collect()
    assert len(twice) == 4 and all(r["rms"] > 0 for r in twice)
    assert image.background(d.limit(0), 10, 10, "clipped").count() == 0


def test_noise_is_the_same_in_any_partition(spark):
    from pyspark.sql import functions as F

    from pelorus.functions import skymodels

    d = spark.range(4000).select("id", skymodels.noise(3.0, 2.0, 7, F.col("id")).alias("n"))
    got = np.array([r["n"] for r in d.orderBy("id").collect()])
    assert abs(got.mean() - 3) < 0.15 and abs(got.std() - 2) < 0.15
    assert np.array_equal(got, [r["n"] for r in spark.range(4000).repartition(7).select("id", skymodels.noise(3.0, 2.0, 7, F.col("id")).alias("n")).orderBy("id").collect()])


def test_group_summary_first_member_by_joined_text(spark):
    rows = [
        (1, "N", "4", 1.0, 3e9), (1, "N", "48", 1.0, 54e9), (1, "R", "1", 1.0, 9e9),
        (2, "A", "4", 1.0, 3e9), (2, "N", "48", 1.0, 54e9),
        (3, "A", "7", 1.0, 5e9), (3, "A", "7", 1.0, 2e9),
        (4, None, "7", 1.0, 5e9), (4, "A", "7", 1.0, None), (4, "Z", "7", 1.0, 6e9),
        (5, None, "7", 1.0, 5e9),
    ]
    got = {r["group_id"]: r["freq"] for r in associate.group_summary(spark.createDataFrame(rows, "group_id long, catalog string, name string, flux double, freq double")).collect()}
    assert got == {1: 54.0, 2: 3.0, 3: 2.0, 4: 6.0, 5: None}


def test_group_summary_keeps_members_without_a_name(spark):
    rows = [(1, "A", "b", 1.0, 1e9), (1, "A", None, 1.0, 1e9), (1, "A", "a", 1.0, 1e9), (2, None, None, None, None)]
    got = {r["group_id"]: (r["names"], r["n"]) for r in associate.group_summary(spark.createDataFrame(rows, "group_id long, catalog string, name string, flux double, freq double")).collect()}
    assert got == {1: (["a", "b", None], 3), 2: ([None], 1)}
