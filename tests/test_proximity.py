import math
import random

from pelorus.operators.proximity import near_and_inside

OBJ = "obj_id long, ra double, dec double, ra_err double, dec_err double, region_id string"
REG = "region_id long, shape string, cx double, cy double, r double, w double, h double, verts array<struct<x:double,y:double>>, obj_id int"


def sep(a, b):
    r1, d1, r2, d2 = map(math.radians, (*a, *b))
    h = math.sin((d2 - d1) / 2) ** 2 + math.cos(d1) * math.cos(d2) * math.sin((r2 - r1) / 2) ** 2
    return math.degrees(2 * math.asin(min(1, math.sqrt(h)))) * 3600


def err(a, b):
    one = lambda v: 1.0 if v is None or math.isnan(v) else v
    return math.hypot(one(a), one(b))


def run(spark, objects, regions, **k):
    out = near_and_inside(spark.createDataFrame(objects, OBJ), spark.createDataFrame(regions, REG), **k)
    return sorted(map(tuple, out.collect()))


def test_against_brute_force_with_crowds_poles_and_wraps(spark):
    random.seed(5)
    places = [(0.0, 10.0), (359.9999, -20.0), (120.0, 89.9999), (77.0, -90.0), (180.0, 0.0)]
    objects = []
    for i in range(600):
        ra, dec = random.choice(places)
        e = random.choice([0.1, 1.0, 30.0, None])
        objects.append((i, ra + random.choice([0, 360, -360]) + random.uniform(-0.002, 0.002), max(-90.0, min(90.0, dec + random.uniform(-0.002, 0.002))), e, e, "x"))
    objects += [(1000 + i, 50.0, 5.0, 0.5, 0.5, None) for i in range(30)]  # copies at one place
    objects += [(2000, None, 1.0, 1.0, 1.0, None), (2001, 10.0, -999.0, 1.0, 1.0, None), (2002, 10.0, float("nan"), 1.0, 1.0, None), (2003, 10.0, 95.0, 1.0, 1.0, None)]
    regions = [
        (1, "circle", 0.0, 10.0, 8.0, None, None, None, 1), (2, "box", 359.9999, -20.0, None, 0.003, 0.002, None, 1), (3, "polygon", 0.0, 0.0, None, None, None, [(359.999, 9.999), (360.001, 9.999), (0.0, 10.001)], 1),
        (4, "circle", 0.0, 10.0, None, None, None, None, 1), (5, "polygon", 0.0, 0.0, None, None, None, [(1.0, 2.0), (2.0, 3.0)], 1), (6, "box", 0.0, -90.0, None, 360.0, 0.002, None, 1), (7, "odd", 0.0, 10.0, 9.0, 1.0, 1.0, None, 1),
    ]
    good = [o for o in objects if o[1] is not None and o[2] == o[2] and abs(o[2]) <= 90 and o[2] != -999]
    expected = set()
    for i, a in enumerate(good):
        for b in good[i + 1 :]:
            if sep(a[1:3], b[1:3]) <= 3 * math.hypot(err(*a[3:5]), err(*b[3:5])):
                expected.add(("near", min(a[0], b[0]), max(a[0], b[0])))
    fold = lambda x: (x + 180) % 360 - 180
    for o in good:
        if sep(o[1:3], (0.0, 10.0)) <= 8:
            expected.add(("inside", o[0], 1))
        if abs(fold(o[1] - 359.9999)) <= 0.0015 and abs(o[2] + 20) <= 0.001:
            expected.add(("inside", o[0], 2))
        x, y = fold(o[1]), o[2]
        tri = [(-0.001, 9.999), (0.001, 9.999), (0.0, 10.001)]
        odd = sum((p[1] > y) != (q[1] > y) and x < (q[0] - p[0]) * (y - p[1]) / (q[1] - p[1]) + p[0] for p, q in zip(tri, tri[1:] + tri[:1])) % 2
        if odd:
            expected.add(("inside", o[0], 3))
        if abs(o[2] + 90) <= 0.001:
            expected.add(("inside", o[0], 6))
    got = run(spark, objects, regions, bucket_rows=50)
    assert len(got) == len(set(got))
    assert set(got) == expected


def test_empty_tables(spark):
    assert run(spark, [], []) == []
    assert run(spark, [(1, 1.0, 1.0, 1.0, 1.0, None)], []) == []
    assert run(spark, [], [(1, "circle", 1.0, 1.0, 5.0, None, None, None, 1)]) == []
