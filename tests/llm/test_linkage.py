import random

from pelorus.llm.linkage import link

SCHEMA = "{k} long, ra double, dec double, s double, bmaj double, q string, p int"


def test_pairs_of_noisy_catalogues(spark):
    random.seed(4)
    a, b, truth = [], [], set()
    for i in range(400):
        ra, dec, s, w = random.uniform(0, 3), random.uniform(-3, 3), 10 ** random.uniform(-3, 0), random.uniform(10, 90)
        noise = lambda: random.gauss(0, 1.2) / 3600
        if i % 4 != 1:
            a.append((i, ra + noise(), dec + noise(), s * 10 ** random.gauss(0.1, 0.04), w * random.uniform(0.95, 1.2), "x", 1))
        if i % 4 != 2:
            b.append((i + 1000, ra + 1.2 / 3600 + noise(), dec - 0.8 / 3600 + noise(), s, w, "x", 1))
        if i % 4 not in (1, 2):
            truth.add((i, i + 1000))
    b.append((*((5000,) + b[0][1:]),))  # an exact copy of the first source
    if (b[0][0] - 1000, b[0][0]) in truth:
        truth.add((b[0][0] - 1000, 5000))
    a += [(9001, None, 1.0, 1.0, 1.0, "x", 1), (9002, 1.0, float("nan"), 1.0, 1.0, None, 1), (9003, 1.0, -999.0, None, -999.0, "x", 1), (None, 1.0, 1.0, 1.0, 1.0, "x", 1)]
    left, right = spark.createDataFrame(a, SCHEMA.format(k="mgps_id")), spark.createDataFrame(b, SCHEMA.format(k="own_id"))
    rows = link(left, right, "mgps_id", "own_id").collect()
    got = {(r["mgps_id"], r["own_id"]) for r in rows}
    assert len(got) == len(rows) and all(0.5 <= r["confidence"] <= 1 for r in rows)
    assert len(got & truth) >= 0.95 * len(truth) and len(got - truth) <= 0.05 * len(truth)
    assert link(left.limit(0), right, "mgps_id", "own_id").count() == 0
