"""Overlaps of many outlines at once against one pair at a time."""

import numpy as np
import pytest

from pelorus.operators import associate, shapes


def test_many_pairs_as_one_by_one():
    chance = np.random.default_rng(3)
    one = [shapes.ellipse(*chance.uniform(-2, 2, 2), *chance.uniform(0.1, 3, 2), chance.uniform(0, 360), n=9) for _ in range(300)]
    two = [shapes.ellipse(*chance.uniform(-2, 2, 2), *chance.uniform(0.1, 3, 2), chance.uniform(0, 360), n=5) for _ in range(300)]
    square = np.array([[0.0, 0], [2, 0], [2, 2], [0, 2]])
    for k, by in enumerate((square, square + [2, 0], square + [1, 0], square + 9, square / 2 + 0.5)):  # the same, side by side, shared sides, apart, inside
        one[k], two[k] = np.pad(square, ((0, 5), (0, 0)), "edge"), np.pad(by, ((0, 1), (0, 0)), "edge")
    a, b = np.array(one), np.array(two)
    got = shapes.common_areas(a[..., 0], a[..., 1], b[..., 0], b[..., 1])
    assert got == pytest.approx([shapes.area(shapes.clip(p, q)) for p, q in zip(one, two)], abs=1e-12)
    assert got[:5] == pytest.approx([4.0, 0.0, 2.0, 0.0, 1.0])


def test_ellipse_pairs_are_not_taken_one_by_one(spark, monkeypatch):
    fields = [f"{c}{k}" for k in (1, 2) for c in "xyabt"]
    rows = np.random.default_rng(4).uniform(0.5, 4, (200, 10))
    rows[7] = np.nan
    d = spark.createDataFrame([tuple(map(float, r)) for r in np.repeat(rows, 2, 0)], ", ".join(f"{c} double" for c in fields))
    expected = [shapes.area(shapes.clip(shapes.ellipse(*r[:5]), shapes.ellipse(*r[5:]))) for r in np.repeat(rows, 2, 0)]
    monkeypatch.setattr(shapes, "clip", None)
    got = shapes.ellipse_overlaps(d).toPandas()
    assert got["overlap"].to_numpy() == pytest.approx(expected, abs=1e-9) and set(got["flag"]) >= {0, 1}


def test_turned_outlines_and_one_shuffle_of_pairs(spark):
    chance = np.random.default_rng(6)
    rows = [[(i, float(x), float(y), 1.0, [(float(p), float(q)) for p, q in shapes.ellipse(x, y, *chance.uniform(0.5, 3, 2), chance.uniform(0, 180), int(n))][:: 1 if i % 2 else -1]) for i, (x, y, n) in enumerate(zip(*chance.uniform(0, 6, (2, 30)), chance.integers(3, 9, 30)))] for _ in range(2)]
    rows[0][5] = rows[0][5][:4] + (rows[0][5][4] * 2 + [(2.0, 2.0)],)
    rows[1][6] = rows[1][6][:4] + ([(0.0, 0.0), (1.0, 1.0), (2.0, 2.0)],)
    rows[1][7] = rows[1][7][:4] + ([(0.0, 0.0), (1.0, 1.0)],)
    a, b = (spark.createDataFrame(r, "id long, x double, y double, flux double, verts array<struct<x:double,y:double>>") for r in rows)
    d = associate.shape_match(a, b, 3.0)
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") + plan.count("ShuffledHashJoin") + plan.count("BroadcastHashJoin") == 1
    got = {(r["left_id"], r["right_id"]): (r["overlap1"], r["overlap2"]) for r in d.collect()}
    expected = {}
    for i, x, y, _, p in rows[0]:
        for j, u, v, _, q in rows[1]:
            if (x - u) ** 2 + (y - v) ** 2 <= 9.0:
                one, two = (shapes.outline(*np.array(o, float).T) for o in (p, q))
                s1, s2 = shapes.area(one), shapes.area(two)
                s = shapes.area(shapes.clip(one, two)) if s1 and s2 else 0.0
                expected[i, j] = (None, None) if len(q) < 3 else (s / s1, s / s2 if s2 else None)
    assert sorted(got) == sorted(expected) and len(got) > 100
    for k, pair in expected.items():
        assert got[k] == pytest.approx(pair, abs=1e-9)
