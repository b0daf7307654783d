"""Cross-matching: positional and overlap joins on sky or pixel tiles, best matches, anti-matches, cliques.

A left row is exploded to the tiles that its search box meets, then hash-joined on the tile and refined
exactly; nothing is compared outside those tiles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def box_join(left: DataFrame, right: DataFrame, radius: float, x: str = "x", y: str = "y", carry: tuple[str, ...] = (), parts: int | None = None) -> DataFrame:
    """left_id, right_id, dx, dy, dist of rows (id, x, y) with |dx| <= radius and |dy| <= radius (inclusive, a box).

    Null or NaN coordinates match nothing. Columns of ``carry`` come along as left_... and right_...
    With ``parts`` the tiles keep so many tasks, which small tables that give many pairs need.
    """
    def clean(d: DataFrame, name: str) -> DataFrame:
        return d.select(F.col("id").alias(f"{name}_id"), *(F.col(c).alias(f"{name}_{c}") for c in carry), F.col(x).cast("double").alias(f"{name}_x"), F.col(y).cast("double").alias(f"{name}_y")).filter(f"not isnan({name}_x) and not isnan({name}_y) and {name}_x is not null and {name}_y is not null")

    cell = radius * 2
    tile = lambda c: F.floor(c / cell).cast("long")
    a = clean(left, "left")
    for axis in "xy":
        a = a.withColumn("t" + axis, F.explode(F.sequence(tile(F.col(f"left_{axis}") - radius), tile(F.col(f"left_{axis}") + radius))))
    b = clean(right, "right").withColumns({"tx": tile(F.col("right_x")), "ty": tile(F.col("right_y"))})
    if parts:
        a, b = (d.repartition(parts, "tx", "ty") for d in (a, b))
    dx, dy = F.col("right_x") - F.col("left_x"), F.col("right_y") - F.col("left_y")
    out = a.join(b, ["tx", "ty"]).withColumns({"dx": dx, "dy": dy}).filter((F.abs("dx") <= radius) & (F.abs("dy") <= radius))
    return out.select("left_id", "right_id", *(f"{n}_{c}" for n in ("left", "right") for c in carry), "dx", "dy", F.sqrt(F.col("dx") ** 2 + F.col("dy") ** 2).alias("dist"))


def best(matches: DataFrame) -> DataFrame:
    """Of each left row the nearest match; the smaller right id wins ties. A minimum, so it is taken before the shuffle."""
    return matches.groupBy("left_id").agg(F.min(F.struct("dist", "right_id")).alias("m")).select("left_id", "m.right_id", "m.dist")


def multiplicity(left: DataFrame, matches: DataFrame) -> DataFrame:
    """id, n_matches of every left row, 0 included."""
    counts = matches.groupBy("left_id").agg(F.count("*").alias("n"))
    return left.select("id").join(counts, left["id"] == counts["left_id"], "left").select("id", F.coalesce("n", F.lit(0)).alias("n_matches"))


def unmatched(left: DataFrame, matches: DataFrame) -> DataFrame:
    """Left rows without a match."""
    return left.join(matches.select(F.col("left_id").alias("id")).distinct(), "id", "left_anti")


def correlate(truth: DataFrame, found: DataFrame, radius: float) -> tuple[DataFrame, DataFrame]:
    """(completeness, reliability): every true row with the nearest found one, and every found row with ``is_real``."""
    m = best(box_join(truth, found, radius))
    complete = truth.select("id").join(m, truth["id"] == m["left_id"], "left").select("id", F.col("right_id").alias("found_id"), "dist", F.col("right_id").isNotNull().alias("detected"))
    back = box_join(found, truth, radius).select(F.col("left_id").alias("id")).distinct().withColumn("is_real", F.lit(True))
    reliable = found.select("id").join(back, "id", "left").withColumn("is_real", F.coalesce("is_real", F.lit(False)))
    return complete, reliable


def overlap_match(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """left_id, right_id, shared, f_left, f_right: of each left source (source_id, pixel_id) the right one with the largest
    share of its pixels, both shares reaching ``least``; the later id wins ties."""
    a, b = left.select(F.col("source_id").alias("left_id"), "pixel_id").distinct(), right.select(F.col("source_id").alias("right_id"), "pixel_id").distinct()
    na, nb = a.groupBy("left_id").agg(F.count("*").alias("na")), b.groupBy("right_id").agg(F.count("*").alias("nb"))
    d = a.join(b, "pixel_id").groupBy("left_id", "right_id").agg(F.count("*").alias("shared")).join(na, "left_id").join(nb, "right_id")
    d = d.select("left_id", "right_id", "shared", (F.col("shared") / F.col("na")).alias("f_left"), (F.col("shared") / F.col("nb")).alias("f_right")).filter((F.col("f_left") >= least) & (F.col("f_right") >= least))
    top = d.groupBy("left_id").agg(F.max(F.struct("f_left", "right_id", "shared", "f_right")).alias("m"))
    return top.select("left_id", "m.right_id", "m.shared", "m.f_left", "m.f_right")


def tag_by_name(rows: DataFrame, regions: DataFrame) -> DataFrame:
    """Rows (name, morph, sourceness) overwritten by the first region (name, region_id, morph, sourceness) of their name."""
    first = regions.groupBy("name").agg(F.min(F.struct("region_id", F.col("morph").alias("m"), F.col("sourceness").alias("s"))).alias("r"))
    d = rows.join(first, "name", "left")
    kept = [c for c in rows.columns if c not in ("morph", "sourceness")]
    return d.select(*kept, F.coalesce("r.m", "morph").alias("morph"), F.coalesce("r.s", "sourceness").alias("sourceness"))


def tag_by_matches(rows: DataFrame, matches: DataFrame) -> DataFrame:
    """id, sourceness, morph: FAKE and unknown without a region, REAL and point-like with one, REAL and compact with more."""
    n = multiplicity(rows, matches)
    return n.select("id", F.when(F.col("n_matches") == 0, "FAKE").otherwise("REAL").alias("sourceness"), F.when(F.col("n_matches") == 0, "UNKNOWN").when(F.col("n_matches") == 1, "POINT-LIKE").otherwise("COMPACT").alias("morph"))


def object_class(matches: DataFrame) -> DataFrame:
    """id, class_id, class_code, confirmed of rows matched to classified objects: more than one class gives -1 and a joined code."""
    g = matches.groupBy("id").agg(F.sort_array(F.collect_set("class_id")).alias("c"), F.max(F.col("confirmed").cast("int")).alias("k"))
    code = F.array_join(F.transform("c", lambda v: F.lpad(v.cast("string"), 4, "0")), "")
    return g.select("id", F.when(F.size("c") == 1, F.col("c")[0]).otherwise(-1).alias("class_id"), code.alias("class_code"), (F.col("k") == 1).alias("confirmed"))


def ordered_edges(edges: DataFrame) -> DataFrame:
    """a, b of an undirected graph, each edge once, from its end of lower to that of higher degree: a hub fans in, not out."""
    e = edges.filter("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    deg = e.select(F.col("a").alias("n")).unionByName(e.select(F.col("b").alias("n"))).groupBy("n").agg(F.count("*").alias("d"))
    e = e.join(deg.select(F.col("n").alias("a"), F.col("d").alias("da")), "a").join(deg.select(F.col("n").alias("b"), F.col("d").alias("db")), "b")
    swap = F.struct("db", "b") < F.struct("da", "a")
    return e.select(F.when(swap, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("b"))


def grown_cliques(now: DataFrame, e: DataFrame) -> DataFrame:
    """m: cliques (arrays of nodes in the order of ``ordered_edges``) with one more node, a later neighbour of the last that all others are linked to."""
    grown = now.withColumn("a", F.element_at("m", -1)).join(e, "a").select("m", F.col("b").alias("c"))
    pairs = grown.select("m", "c", F.explode(F.slice("m", 1, F.size("m") - 1)).alias("a"))
    linked = pairs.join(e.withColumnRenamed("b", "c"), ["a", "c"], "left_semi").groupBy("m", "c").agg(F.count("*").alias("k"))
    return linked.filter(F.col("k") == F.size("m") - 1).select(F.concat("m", F.array("c")).alias("m"))


def cliques(edges: DataFrame, size: int = 3) -> DataFrame:
    """members: sorted arrays of ``size`` nodes of an undirected graph (a, b) that are all linked to each other.

    Grown edge by edge: each step is one join on a node and one on an edge.
    """
    e = ordered_edges(edges)
    now = e.select(F.array("a", "b").alias("m"))
    for _ in range(size - 2):
        now = grown_cliques(now, e)
    return now.select(F.sort_array("m").alias("members"))


def group_flux(members: DataFrame) -> DataFrame:
    """group_id, flux, flux_err, n: summed flux density over the beam, errors in quadrature; the island's sum serves where there is no fit."""
    flux = F.coalesce(F.col("flux") / F.col("beam_area"), F.col("s"))
    err = F.col("flux_err") / F.col("beam_area")
    return members.groupBy("group_id").agg(F.sum(flux).alias("flux"), F.sqrt(F.sum(err**2)).alias("flux_err"), F.count("*").alias("n"))


def near_tiles(tiles: DataFrame) -> DataFrame:
    """a, b: tiles (tile_id, x0, x1, y0, y1; bounds included) that touch or overlap, by a join on the cells of the largest tile size."""
    size = tiles.agg(F.max(F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))).alias("w"))  # one row
    d = tiles.crossJoin(F.broadcast(size))
    cell = F.greatest(F.col("w") + 1, F.lit(1))
    over = lambda lo, hi, pad: F.explode(F.sequence(F.floor((F.col(lo) - pad) / cell).cast("long"), F.floor((F.col(hi) + pad) / cell).cast("long")))
    a = d.withColumn("tx", over("x0", "x1", 1)).withColumn("ty", over("y0", "y1", 1)).select("tx", "ty", F.col("tile_id").alias("a"), *(F.col(c).alias("a_" + c) for c in ("x0", "x1", "y0", "y1")))
    b = d.withColumn("tx", over("x0", "x1", 0)).withColumn("ty", over("y0", "y1", 0)).select("tx", "ty", F.col("tile_id").alias("b"), *(F.col(c).alias("b_" + c) for c in ("x0", "x1", "y0", "y1")))
    touch = (F.col("a_x0") <= F.col("b_x1") + 1) & (F.col("b_x0") <= F.col("a_x1") + 1) & (F.col("a_y0") <= F.col("b_y1") + 1) & (F.col("b_y0") <= F.col("a_y1") + 1)
    return a.join(b, ["tx", "ty"]).filter(touch & (F.col("a") < F.col("b"))).select("a", "b").distinct()


def first_per_group(df: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    """The first ``n`` rows of each group in an order (top-N start values, brightest peaks)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
