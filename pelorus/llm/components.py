"""Consolidating pairwise matches into groups: connected components by merging spanning forests.

Each partition of edges runs union-find and keeps only the stars of its spanning forest. Nodes are then
looked at across partitions: the roots that a node has in several partitions are joined by edges, a node
that is a root itself somewhere keeps an edge, and any other node is settled: it hangs from one root. The
remaining edges are a smaller graph, taken to the next level with fewer partitions, until one bounded
partition holds the rest; then the levels are resolved top down by joins. Every level orders nodes by
another hash, so sorted chains shrink by a fixed share a level like any other graph.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pelorus.plans.runtime import cut_lineage, table

STARS = "node long, root long, rank long"


def mixed(ids: np.ndarray, seed: int) -> np.ndarray:
    """A bijection of 64-bit integers, another one for each seed; seed 0 keeps the order."""
    if not seed:
        return ids
    x = ids.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15) % 2**64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return (x ^ (x >> np.uint64(31))).view(np.int64)


def spanning_stars(a: np.ndarray, b: np.ndarray, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) of every node but the roots; a root is the first node of its tree in the order of ``seed``."""
    both = np.concatenate([a, b])
    _, first, index = np.unique(mixed(both, seed), return_index=True, return_inverse=True)
    nodes = both[first]
    parent = np.arange(len(nodes))
    x, y = index[: len(a)], index[len(a) :]
    while len(x):
        # hook every later root on the first root it meets, then halve all paths
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent = up
        x, y = parent[x], parent[y]
        keep = x != y
        x, y = x[keep], y[keep]
        if len(x):
            pair = np.unique(np.minimum(x, y) * np.int64(len(nodes)) + np.maximum(x, y))
            x, y = pair // len(nodes), pair % len(nodes)
    hangs = parent != np.arange(len(nodes))
    return nodes[hangs], nodes[parent[hangs]]


def _forest(seed: int, buffer_edges: int):
    """Reduce a partition of edges (a, b) to its stars, taking at most about ``buffer_edges`` new edges at once."""

    def run(batches):
        a, b, held = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
        for pdf in batches:
            a.append(pdf["a"].to_numpy(np.int64))
            b.append(pdf["b"].to_numpy(np.int64))
            held += len(pdf)
            if held >= buffer_edges:
                x, y = spanning_stars(np.concatenate(a), np.concatenate(b), seed)
                a, b, held = [x], [y], 0
        x, y = spanning_stars(np.concatenate(a), np.concatenate(b), seed)
        for at in range(0, len(x), 100_000):
            root = y[at : at + 100_000]
            yield pd.DataFrame({"node": x[at : at + 100_000], "root": root, "rank": mixed(root, seed)})

    return run


def connected_components(edges: DataFrame, bounded_edges: int = 500_000, buffer_edges: int = 200_000) -> DataFrame:
    """node, component (its least node) of every node of ``edges`` (a, b: long) in a component of two or more.

    Null ends and self-edges link nothing; repeated and turned edges count once; other columns are ignored. An
    empty table gives no rows. ``bounded_edges`` is what one task may merge at the end; larger graphs take further
    levels. No group and no table of labels is ever collected.
    """
    rest = edges.filter("a is not null and b is not null and a <> b").select(F.col("a").cast("long"), F.col("b").cast("long"))
    levels: list[DataFrame] = []
    while True:
        seed = len(levels) + 1
        stars = cut_lineage(rest.mapInPandas(_forest(seed, buffer_edges), STARS))
        count = stars.count()
        if count <= bounded_edges:
            ends = stars.select(F.col("node").alias("a"), F.col("root").alias("b")).coalesce(1)
            resolved = ends.mapInPandas(_forest(0, buffer_edges), STARS).select("node", "root")
            break
        # a node meets no more roots than there are partitions: no window is large
        w = Window.partitionBy("node")
        ranked = stars.withColumn("least", F.min_by("root", "rank").over(w))
        roots = stars.select(F.col("root").alias("node"), F.lit(True).alias("is_root")).distinct()
        ranked = cut_lineage(ranked.join(roots, "node", "left"))
        levels.append(ranked.filter("is_root is null").select("node", F.col("least").alias("root")).distinct())
        among = ranked.filter("root <> least").select(F.col("root").alias("a"), F.col("least").alias("b"))
        kept = ranked.filter("is_root").select(F.col("node").alias("a"), F.col("least").alias("b"))
        partitions = max(2, min(stars.rdd.getNumPartitions(), -(-2 * count // bounded_edges)))
        rest = among.unionByName(kept).distinct().repartition(partitions, "a", "b")
    if not levels:
        tops = resolved.select(F.col("root").alias("node")).distinct().withColumn("root", F.col("node"))
        return resolved.unionByName(tops).withColumnRenamed("root", "component")
    for level in reversed(levels):
        # a root of a lower level may hang from a root of a level above; its followers may be many, its row is one
        up = resolved.select(F.col("node").alias("root"), F.col("root").alias("top"))
        lower = level.join(up, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
        resolved = cut_lineage(lower.unionByName(resolved))
    tops = resolved.select(F.col("root").alias("node")).distinct().withColumn("root", F.col("node"))
    members = resolved.unionByName(tops)
    least = members.groupBy("root").agg(F.min("node").alias("component"))
    return members.join(least, "root").select("node", "component")


def normal_name(name):
    """A name without letter case and blanks."""
    return F.regexp_replace(F.lower(name), r"\s", "")


def consolidate(components: DataFrame, matches: DataFrame, bounded_edges: int = 500_000) -> DataFrame:
    """comp_id, group_id (least comp_id of the group) of every component in a group of two or more rows.

    Components are linked by a match and by having the same catalogindex, sname (without case and blanks) and
    fitcomponentindex. An endpoint with a null index takes it from the name's ending ``_fitcompK`` (K - 1).
    Endpoints that are null or no component, and pairs of a component with itself, link nothing. A component with
    a null part in its key is in no group. Empty tables give no rows.
    """
    keyed = components.select("comp_id", F.col("catalogindex").alias("c"), normal_name(F.col("sname")).alias("n"), F.col("fitcomponentindex").alias("f")).filter("comp_id is not null and c is not null and n is not null and f is not null")
    # one node for each key: its least comp_id
    nodes = keyed.groupBy("c", "n", "f").agg(F.min("comp_id").alias("rep"), F.count("*").alias("rows"))

    def end(k: int) -> list:
        name, index = normal_name(F.col(f"sname_{k}")), F.col(f"fitcomponentindex_{k}")
        suffix = F.regexp_extract(name, r"_fitcomp([0-9]{1,9})$", 1)
        number = F.when(suffix != "", suffix.cast("int") - 1)
        return [F.col(f"catalogindex_{k}").alias(f"c{k}"), F.when(index.isNull(), F.regexp_replace(name, r"_fitcomp[0-9]{1,9}$", "")).otherwise(name).alias(f"n{k}"), F.coalesce(index, number).alias(f"f{k}")]

    # repeated pairs are dropped before the joins, so a much-matched component doesn't weigh
    pairs = matches.select(*end(1), *end(2)).distinct()
    for k in (1, 2):
        ends = nodes.select(F.col("c").alias(f"c{k}"), F.col("n").alias(f"n{k}"), F.col("f").alias(f"f{k}"), F.col("rep").alias("ab"[k - 1]))
        pairs = pairs.join(ends, [f"c{k}", f"n{k}", f"f{k}"])
    edges = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct()
    labels = connected_components(edges, bounded_edges)
    grouped = nodes.join(labels, nodes["rep"] == labels["node"], "left").filter("rows > 1 or component is not null")
    grouped = grouped.select("c", "n", "f", F.coalesce("component", "rep").alias("group_id"))
    return keyed.join(grouped, ["c", "n", "f"]).select("comp_id", "group_id")


def p3_found(spark, sf_dir):
    return consolidate(table(spark, sf_dir, "components"), table(spark, sf_dir, "compmatches"))


def p3_levels(spark, sf_dir):
    """The same answer with a small bound on what one task may merge, so that the hierarchical levels do the work."""
    return consolidate(table(spark, sf_dir, "components"), table(spark, sf_dir, "compmatches"), bounded_edges=500)


def _end_sql(k: int) -> str:
    name = f"regexp_replace(lower(sname_{k}), '\\s', '', 'g')"
    return f"""catalogindex_{k} AS c{k}, CASE WHEN fitcomponentindex_{k} IS NULL THEN regexp_replace({name}, '_fitcomp[0-9]+$', '') ELSE {name} END AS n{k},
 coalesce(fitcomponentindex_{k}, TRY_CAST(nullif(regexp_extract({name}, '_fitcomp([0-9]+)$', 1), '') AS INTEGER) - 1) AS f{k}"""


P3_SQL = f"""
WITH RECURSIVE k AS (SELECT comp_id, catalogindex AS c, regexp_replace(lower(sname), '\\s', '', 'g') AS n, fitcomponentindex AS f FROM components),
r AS (SELECT c, n, f, min(comp_id) AS rep FROM k WHERE c IS NOT NULL AND n IS NOT NULL AND f IS NOT NULL GROUP BY 1, 2, 3),
p AS (SELECT DISTINCT {_end_sql(1)}, {_end_sql(2)} FROM compmatches),
e AS (SELECT a.rep AS a, b.rep AS b FROM p JOIN r a ON a.c = c1 AND a.n = n1 AND a.f = f1 JOIN r b ON b.c = c2 AND b.n = n2 AND b.f = f2 WHERE a.rep <> b.rep),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
w AS (SELECT rep AS node, rep AS g FROM r UNION SELECT u.b, w.g FROM w JOIN u ON u.a = w.node WHERE w.g < u.b),
l AS (SELECT node, min(g) AS g FROM w GROUP BY 1),
m AS (SELECT k.comp_id, l.g AS group_id, count(*) OVER (PARTITION BY l.g) AS size FROM k JOIN r USING (c, n, f) JOIN l ON l.node = r.rep)
SELECT comp_id, group_id FROM m WHERE size > 1
"""
