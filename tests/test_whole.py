"""Whole jobs against brute force."""

from itertools import combinations

import numpy as np
import pytest

from pelorus.operators import blobs, residual, segment
from pelorus.plans import linkqueries, measurequeries


def image_of(spark, array):
    return spark.createDataFrame([("a", int(x), int(y), float(v)) for (x, y), v in np.ndenumerate(array)], "image_id string, ix long, iy long, v double")


@pytest.fixture()
def shop(spark, tmp_path):
    """Few lines of small and large quantity between nations 0 to 5, written as tables."""
    links = [(a, b, q) for a, b, q in ((0, 1, 1.0), (1, 2, 50.0), (0, 2, 3.0), (2, 3, 46.0), (3, 1, 45.0), (4, 5, 2.0), (4, 4, 50.0))]
    spark.createDataFrame([(k, 10.0 * k) for k in range(6)], "k long, bal double").selectExpr("k as c_custkey", "cast(k as int) as c_nationkey", "bal as c_acctbal").write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(6).selectExpr("id as s_suppkey", "cast(id as int) as s_nationkey").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.createDataFrame([(i, a) for i, (a, _, _) in enumerate(links)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(i, b, q) for i, (_, b, q) in enumerate(links)], "l_orderkey long, l_suppkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    return str(tmp_path), [(a, b) for a, b, _ in links]


def test_triples_of_all_links(spark, shop):
    linked = {frozenset(e) for e in shop[1]}
    expected = [list(t) for t in combinations(range(6), 3) if all(frozenset(e) in linked for e in combinations(t, 2))]
    assert sorted(r["members"] for r in linkqueries.clique_triples(spark, shop[0]).collect()) == expected == [[0, 1, 2], [1, 2, 3]]


def test_components_of_all_customers(spark, shop):
    # balances of 0 to 50: each nation and its customer
    got = {r["node"]: r["component"] for r in linkqueries.graph_components(spark, shop[0]).collect()}
    assert got == {n: k for k in range(6) for n in (k, 1_000_000 + k)}


def test_rank_over_all_links(spark, shop):
    edges, r = set(shop[1]), np.full(6, 6**-0.5)
    m = np.zeros((6, 6))
    for a, b in edges:
        m[b, a] = 1 / sum(x == a for x, _ in edges)
    for _ in range(200):
        r = 0.85 * m @ r + 0.15 / 6 * r.sum()
        r /= np.linalg.norm(r)
    got = {x["node"]: x["rank"] for x in linkqueries.page_rank_settled(spark, shop[0]).collect()}
    assert [got[k] for k in range(6)] == pytest.approx(r, abs=1e-3)


def test_background_of_all_sources(spark, tmp_path):
    chance = np.random.default_rng(5)
    rows = [("A", x, y, float(chance.integers(1, 50))) for x in range(64) for y in range(64) if chance.random() < 0.8]
    spark.createDataFrame(rows, "l_returnflag string, l_partkey long, l_suppkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(1, 41).selectExpr("id as s_suppkey", "1.0D as s_acctbal").write.parquet(f"{tmp_path}/supplier.parquet")
    at = {k: (k * 37 % 64, k * 11 % 64) for k in range(1, 41)}
    expected = {}
    for k, (x, y) in at.items():
        v = [q for _, i, j, q in rows if abs(i - x) <= 2 and abs(j - y) <= 2 and (i, j) not in at.values()]
        expected[k] = (len(v), np.median(v), np.median(np.abs(v - np.median(v))) * 1.4826)
    got = {r["blob"]: (r["n"], r["bkg"], r["rms"]) for r in measurequeries.local_background(spark, str(tmp_path)).collect()}
    assert sorted(got) == sorted(expected) and all(got[k] == pytest.approx(expected[k], abs=1e-3) for k in got)


def test_watershed_across_tiles(spark):
    a = np.random.default_rng(1).integers(0, 40, (20, 20)).astype(float)
    a[3] = np.arange(20) + 50  # a slope through three tiles
    d = image_of(spark, a)

    def peak(x, y):
        best = min((-a[i, j], i, j) for i in range(max(x - 1, 0), min(x + 2, 20)) for j in range(max(y - 1, 0), min(y + 2, 20)))[1:]
        return best if best == (x, y) else peak(*best)

    for tile in (8, 512):
        got = {(r["ix"], r["iy"]): divmod(r["basin"], 1_000_000_000) for r in segment.watershed(d, -1.0, tile).collect()}
        assert got == {(x, y): peak(x, y) for x in range(20) for y in range(20)}


def test_domes_far_from_the_marker(spark):
    a = np.zeros((3, 460))
    a[1] = 5.0  # a filament: the marker reaches its far end after 459 steps
    a[1, 0] = 9.0
    expected = a - np.where(a == 5.0, 5.0, np.where(a == 9.0, 6.0, 0.0))
    for tile in (100, 512):
        dome = {(r["ix"], r["iy"]): r["dome"] for r in residual.h_domes(image_of(spark, a), 3.0, tile=tile).collect()}
        assert dome == {k: v for k, v in np.ndenumerate(expected)}


def test_domes_are_those_of_plain_dilation(spark):
    a = np.random.default_rng(2).integers(0, 30, (18, 21)).astype(float)
    m = a - 6
    while True:
        pad = np.pad(m, 1, constant_values=-np.inf)
        new = np.minimum(np.max([pad[i : i + 18, j : j + 21] for i in range(3) for j in range(3)], axis=0), a)
        if np.array_equal(new, m):
            break
        m = new
    dome = {(r["ix"], r["iy"]): r["dome"] for r in residual.h_domes(image_of(spark, a), 6.0, tile=8).collect()}
    assert dome == {k: v for k, v in np.ndenumerate(a - m)}


def test_unfinished_labels_are_an_error(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(200)], "a long, b long")
    with pytest.raises(RuntimeError):
        blobs.label_components(chain, rounds=2, bounded=1)


def test_level_set_across_tiles(spark):
    a = np.random.default_rng(4).normal(size=(19, 22))
    a[2:8, 3:12] += 20.0  # the tiles beyond are plain background
    d = image_of(spark, a).filter("not (ix = 15 and iy = 15)")
    one, many = ({(r["ix"], r["iy"]): r["inside"] for r in segment.chan_vese(d, 8, tile=t).collect()} for t in (512, 8))
    assert len(one) == 19 * 22 - 1 and one == many and one[4, 5] and not one[18, 21]
