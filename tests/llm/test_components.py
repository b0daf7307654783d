import random

from pelorus.llm.components import connected_components, consolidate, mixed, spanning_stars


def brute(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


def test_levels_chains_hubs_and_edges(spark):
    random.seed(3)
    edges = [(i, i + 1) for i in range(600)] + [(9000, 9000 + k) for k in range(1, 400)] + [(random.randrange(20000, 20800), random.randrange(20000, 20800)) for _ in range(500)]
    edges += [(None, 1), (2, None), (7, 7), (5, 4), (4, 5), (-3, 70000)]
    random.shuffle(edges)
    d = spark.createDataFrame([(*e, "x") for e in edges], "a long, b long, node string").repartition(6)
    for bound in (150, 500_000):
        got = connected_components(d, bounded_edges=bound, buffer_edges=50).collect()
        assert len(got) == len({r["node"] for r in got})
        assert {r["node"]: r["component"] for r in got} == brute(edges)
    assert connected_components(d.limit(0)).count() == 0


def test_stars_in_any_order():
    import numpy as np

    ids = np.arange(-5, 5)
    assert len(set(mixed(ids, 3).tolist())) == 10 and mixed(ids, 0) is ids
    node, root = spanning_stars(np.array([3, 2]), np.array([2, 1]))
    assert dict(zip(node.tolist(), root.tolist())) == {2: 1, 3: 1}


COMP = "comp_id long, catalogindex int, sname string, fitcomponentindex int, component string"
PAIR = "catalogindex_1 int, sname_1 string, fitcomponentindex_1 int, catalogindex_2 int, sname_2 string, fitcomponentindex_2 int, a int"


def test_endpoints(spark):
    comps = [(1, 0, "S1", 0, "x"), (2, 0, "s 1", 0, "x"), (3, 1, "S2", 1, "x"), (4, 1, "S3", 0, "x"), (5, 0, "S9", 0, "x"), (6, None, "S9", 0, "x"), (7, 2, "S4", 2, "x"), (8, 2, "S5", 0, "x")]
    pairs = [(0, " S1", 0, 1, "s2_FitComp2", None, 1), (1, "S3", 0, 1, "S3", 0, 1), (0, "S9", 0, 1, "S77", 0, 1), (0, None, 0, 1, "S3", 0, 1), (2, "S4_fitcomp3", None, 1, "S2", 1, 1), (2, "S5", None, 0, "S9", 0, 1)]
    got = consolidate(spark.createDataFrame(comps, COMP), spark.createDataFrame(pairs + pairs, PAIR)).collect()
    assert sorted(map(tuple, got)) == [(1, 1), (2, 1), (3, 1), (7, 1)]
    assert consolidate(spark.createDataFrame([], COMP), spark.createDataFrame([], PAIR)).count() == 0
    assert sorted(map(tuple, consolidate(spark.createDataFrame(comps, COMP), spark.createDataFrame([], PAIR)).collect())) == [(1, 1), (2, 1)]
