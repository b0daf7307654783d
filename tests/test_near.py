"""Scattered pixels against dense arrays, and rows in any number a pixel."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from pelorus.operators import image, stencil
from pelorus.plans import imagequeries

UNEVEN = [[1.0, 2.0, 0.0], [0.5, 3.0, 1.0], [0.0, 4.0, 2.0]]
OPERATIONS = [
    (lambda d, t: image.morphologies(d, ("tophat", "blackhat"), 3, t, "sum"), ("tophat", "blackhat")),
    (lambda d, t: image.multi_kernel_peaks(d, tile=t, repeated="sum"), ("v", "kernels")),
    (lambda d, t: image.convolve(d, {"c": image.LOG7}, tile=t), ("c",)),
    (lambda d, t: image.convolve(d, {"c": UNEVEN}, border="mirror", tile=t), ("c",)),
    (lambda d, t: image.wavelet(d, 3, t).groupBy(*image.PIXEL).pivot("plane", [1, 2, 3, 4]).agg(F.first("w")), ("1", "2", "3", "4")),
]
QUERIES = ["hat_transforms", "peak_votes", "fixed_log_filter", "mirror_convolution", "wavelet3"]


@pytest.fixture(scope="module")
def scattered(spark):
    """Lines of few pixels, some with many lines, without a value, or at the borders; a dense spot among them."""
    chance = np.random.default_rng(11)
    rows = [("a", int(x) - 30, int(y) - 7, float(v)) for x, y, v in zip(chance.integers(0, 150, 900), chance.integers(0, 90, 900), chance.integers(1, 9, 900))]
    rows += [("a", 40 + x, 30 + y, float((x * 5 + y * 3) % 7)) for x in range(12) for y in range(12)] + [("a", 0, 0, 1.0)] * 300
    rows += [("b", 5, 5, None), ("b", 6, 5, 2.0), ("b", 6, 5, None), ("b", 9, 5, float("nan")), (None, 6, 5, 3.0), ("c", None, 1, 1.0)]
    return spark.createDataFrame(rows, "image_id string, ix long, iy long, v double")


def found(df, columns):
    rows = [(tuple(r[c] for c in image.PIXEL), tuple(None if r[c] is None else round(r[c], 6) for c in columns)) for r in df.collect()]
    assert len(rows) == len(dict(rows))
    return dict(rows)


@pytest.mark.parametrize("n", range(len(OPERATIONS)))
def test_scattered_as_dense(scattered, monkeypatch, n):
    run, columns = OPERATIONS[n]
    monkeypatch.setattr(stencil, "SCATTERED", 10**9)
    dense = found(run(scattered, 512), columns)
    assert dense
    for share, chunk, tile in ((0, 1 << 17, 512), (0, 50, 20), (16, 50, 30)):
        monkeypatch.setattr(stencil, "SCATTERED", share)
        monkeypatch.setattr(stencil, "CHUNK", chunk)
        assert found(run(scattered, tile), columns) == dense


@pytest.mark.parametrize("n", range(len(OPERATIONS)))
def test_lines_as_their_sums(scattered, n):
    run, columns = OPERATIONS[n]
    d = scattered.filter("image_id is not null and not isnan(v)")
    assert found(run(d, 64), columns) == found(run(d.groupBy(*image.PIXEL).agg(F.sum("v").alias("v")), 64), columns)


@pytest.mark.parametrize("name", QUERIES)
def test_lines_go_once_by_tile(spark, tmp_path, name):
    rows = [("A", x, x * x % 37, 2.0) for x in range(50)]
    spark.createDataFrame(rows, "l_returnflag string, l_partkey long, l_suppkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    plan = imagequeries.QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    # the image's bounds are one row an image
    by = [k for k in re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan) if not re.fullmatch(r"image_id#\d+, \d+", k)]
    assert len(by) == 1 and by[0].startswith("_t#")
