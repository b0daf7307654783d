"""Tiles with halos against numpy on the whole image; results don't depend on the tile."""

import numpy as np
import pytest

from pelorus.operators import image


@pytest.fixture(scope="module")
def scene(spark):
    a = np.random.default_rng(5).integers(0, 9, (23, 17)).astype(float)
    rows = [("a", x - 4, y - 3, float(a[y, x])) for y in range(23) for x in range(17) if (x * 7 + y * 3) % 11]
    return a, spark.createDataFrame(rows + [("b", 0, 0, None), ("b", 1, 0, 2.0)], "image_id string, ix long, iy long, v double")


def table(df, column):
    return {(r["image_id"], r["ix"], r["iy"]): None if r[column] is None else round(r[column], 6) for r in df.collect()}


@pytest.mark.parametrize("run,column", [
    (lambda d, t: image.convolve(d, {"c": [[1.0, 2.0, 0.0], [0.5, 3.0, 1.0], [0.0, 4.0, 2.0]]}, tile=t), "c"),
    (lambda d, t: image.convolve(d, {"c": image.LOG7}, border="mirror", tile=t), "c"),
    (lambda d, t: image.morphology(d, "tophat", 3, tile=t), "m"),
    (lambda d, t: image.wavelet(d, 2, tile=t).filter("plane = 2"), "w"),
    (lambda d, t: image.peaks(d, 3, tile=t), "v"),
])
def test_tiles_do_not_matter(scene, run, column):
    assert table(run(scene[1], 7), column) == table(run(scene[1], 512), column)
    assert run(scene[1].limit(0), 7).count() == 0


def test_convolution_against_loops(scene):
    a, d = scene
    seen = {(r["ix"] + 4, r["iy"] + 3): r["v"] for r in d.filter("image_id = 'a'").collect()}
    k = [[1.0, 2.0, 0.0], [0.5, 3.0, 1.0], [0.0, 4.0, 2.0]]
    flip = lambda i, n: -i if i < 0 else 2 * (n - 1) - i if i >= n else i
    plain, mirror = {}, {}
    for x, y in seen:
        cells = [(k[r][c], x - (c - 1), y - (r - 1)) for r in range(3) for c in range(3)]
        plain["a", x - 4, y - 3] = round(sum(w * seen.get((p, q), 0.0) for w, p, q in cells), 6)
        mirror["a", x - 4, y - 3] = round(sum(w * seen.get((flip(p, 17), flip(q, 23)), 0.0) for w, p, q in cells), 6)
    got = table(image.convolve(d, {"c": k}, tile=7), "c")
    assert {p: v for p, v in got.items() if p[0] == "a"} == plain and got["b", 0, 0] == 1.0 and got["b", 1, 0] == 6.0
    assert {p: v for p, v in table(image.convolve(d, {"c": k}, border="mirror", tile=7), "c").items() if p[0] == "a"} == mirror


def test_fixed_filter_leaves_empty_pixels(scene):
    got = table(image.log_filter(scene[1]), "log")
    assert got["b", 0, 0] == 0.0 and got["b", 1, 0] == -48.0
