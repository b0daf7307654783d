"""Queries of associations by shape, of tile edges, cliques, groups and source types, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from pelorus.operators import associate
from pelorus.plans.imagequeries import quickly_rounded
from pelorus.plans.runtime import table

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def rounded(df, digits=5):
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def _boxes(spark, sf_dir, name: str, key: str, size: int):
    """Customers or suppliers as boxes around positions made of their keys."""
    k = F.col(key)
    d = table(spark, sf_dir, name).select(k.alias("id"), (F.pmod(k * 7919, F.lit(36000)) / 100.0).alias("x"), (F.pmod(k * 104729, F.lit(18000)) / 100.0).alias("y"), (k % size + 1.0).alias("w"), (k % (size - 1) + 1.5).alias("h"), (k % 11 + 0.0).alias("flux"), F.col("%s_nationkey" % name[0]).alias("nation"))
    return d.withColumns({"x0": F.col("x") - F.col("w"), "x1": F.col("x") + F.col("w"), "y0": F.col("y") - F.col("h"), "y1": F.col("y") + F.col("h")})


def _outlined(d):
    corner = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    return d.withColumn("verts", F.array(corner("x0", "y0"), corner("x1", "y0"), corner("x1", "y1"), corner("x0", "y1")))


def _box_sql(name: str, key: str, size: int) -> str:
    return f"""(SELECT *, x - w AS x0, x + w AS x1, y - h AS y0, y + h AS y1 FROM (SELECT {key} AS id, ({key} * 7919 % 36000) / 100.0 AS x, ({key} * 104729 % 18000) / 100.0 AS y, {key} % {size} + 1.0 AS w, {key} % {size - 1} + 1.5 AS h, ({key} % 11)::DOUBLE AS flux, {name[0]}_nationkey AS nation FROM {name}))"""


_C, _S = _box_sql("customer", "c_custkey", 5), _box_sql("supplier", "s_suppkey", 7)


@query(f"SELECT s.id AS left_id, c.id AS right_id FROM {_S} s JOIN {_C} c ON s.x0 < c.x1 AND c.x0 < s.x1 AND s.y0 < c.y1 AND c.y0 < s.y1")
def box_overlap(spark, sf_dir):
    return associate.box_overlap_join(_boxes(spark, sf_dir, "supplier", "s_suppkey", 7), _boxes(spark, sf_dir, "customer", "c_custkey", 5), 8.0)


@query(f"""WITH m AS (SELECT s.id AS left_id, c.id AS right_id, sqrt(power(s.x - c.x, 2) + power(s.y - c.y, 2)) AS dist, greatest(least(s.x1, c.x1) - greatest(s.x0, c.x0), 0) * greatest(least(s.y1, c.y1) - greatest(s.y0, c.y0), 0) AS o,
  4 * s.w * s.h AS a1, 4 * c.w * c.h AS a2, CASE WHEN c.flux > 0 THEN (s.flux - c.flux) / c.flux ELSE 0 END AS flux_diff FROM {_S} s JOIN {_C} c ON abs(s.x - c.x) <= 4 AND abs(s.y - c.y) <= 4)
SELECT left_id, right_id, round(dist, 5) AS dist, round(o / a1, 5) AS overlap1, round(o / a2, 5) AS overlap2, round(flux_diff, 5) AS flux_diff FROM m WHERE dist <= 4 AND abs(flux_diff) <= 2
  AND o > 1e-9 * least(a1, a2) AND (o >= a1 * (1 - 1e-9) OR o >= a2 * (1 - 1e-9) OR (o / a1 >= 0.3 AND o / a2 >= 0.3) OR dist <= 1.5)""")
def shape_match(spark, sf_dir):
    s, c = _outlined(_boxes(spark, sf_dir, "supplier", "s_suppkey", 7)), _outlined(_boxes(spark, sf_dir, "customer", "c_custkey", 5))
    return quickly_rounded(associate.shape_match(s, c, 4.0, overlap=0.3, flux_difference=2.0, high_radius=1.5), 5)


def _tiles(spark):
    # 40 x 40 tiles with steps of 36
    one = lambda c: spark.range(12).select(F.col("id").alias(c))
    return one("i").crossJoin(one("j")).select((F.col("i") * 100 + F.col("j")).alias("tile_id"), (F.col("i") * 36.0).alias("x0"), (F.col("i") * 36.0 + 40).alias("x1"), (F.col("j") * 36.0).alias("y0"), (F.col("j") * 36.0 + 40).alias("y1"))


@query(f"""WITH t AS (SELECT i * 100 + j AS tile_id, i * 36.0 AS x0, i * 36.0 + 40 AS x1, j * 36.0 AS y0, j * 36.0 + 40 AS y1 FROM range(12) a(i), range(12) b(j)), c AS (SELECT *, floor(x / 36)::BIGINT * 100 + floor(y / 36)::BIGINT AS tile_id FROM {_C})
SELECT c.id, c.x0 <= t.x0 OR c.x1 >= t.x1 OR c.y0 <= t.y0 OR c.y1 >= t.y1 OR EXISTS (SELECT 1 FROM t o WHERE o.tile_id <> t.tile_id AND o.x0 < c.x1 AND c.x0 < o.x1 AND o.y0 < c.y1 AND c.y0 < o.y1) AS at_edge FROM c JOIN t USING (tile_id)""")
def sources_at_edge(spark, sf_dir):
    c = _boxes(spark, sf_dir, "customer", "c_custkey", 5).withColumn("tile_id", F.floor(F.col("x") / 36) * 100 + F.floor(F.col("y") / 36))
    return associate.at_edge(c.select("id", "tile_id", "x0", "x1", "y0", "y1"), _tiles(spark)).select("id", "at_edge")


_LINKS = "l AS (SELECT DISTINCT l_orderkey + 100000000 AS a, l_suppkey + 10000000 AS b FROM lineitem UNION SELECT DISTINCT l_suppkey + 10000000, l_partkey FROM lineitem UNION SELECT DISTINCT l_orderkey + 100000000, l_partkey FROM lineitem)"


def _links(spark, sf_dir):
    """Three kinds of nodes: orders, suppliers and parts, linked by lines."""
    d = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") + 100000000).alias("o"), (F.col("l_suppkey") + 10000000).alias("s"), F.col("l_partkey").alias("p"))
    pair = lambda a, b: d.select(F.col(a).alias("a"), F.col(b).alias("b"))
    return pair("o", "s").unionByName(pair("s", "p")).unionByName(pair("o", "p")).distinct()


@query(f"""WITH {_LINKS}, t AS (SELECT x.a, x.b, y.b AS c FROM l x JOIN l y ON y.a = x.b JOIN l z ON z.a = x.a AND z.b = y.b)
SELECT count(*) AS cliques, sum(n)::BIGINT AS nodes, sum(total)::BIGINT AS total FROM (SELECT 3 AS n, a + b + c AS total FROM t UNION ALL SELECT 2, a + b FROM (SELECT a, b FROM l EXCEPT (SELECT a, b FROM t UNION SELECT b, c FROM t UNION SELECT a, c FROM t)))""")
def maximal_cliques(spark, sf_dir):
    c = associate.maximal_cliques(_links(spark, sf_dir), 3)
    return c.agg(F.count("*").alias("cliques"), F.sum(F.size("members").cast("long")).alias("nodes"), F.sum(F.aggregate("members", F.lit(0).cast("long"), lambda a, b: a + b)).alias("total"))


@query(f"WITH {_LINKS} SELECT a, count(*) AS degree FROM (SELECT a, b FROM l UNION SELECT b, a FROM l) GROUP BY 1")
def adjacency_degrees(spark, sf_dir):
    return associate.adjacency(_links(spark, sf_dir)).groupBy("a").agg(F.count("*").alias("degree"))


@query("""SELECT l_orderkey AS group_id, list(l_suppkey::VARCHAR ORDER BY l_suppkey::VARCHAR) AS names, count(*) AS n, count(DISTINCT l_returnflag) AS n_catalogues, round(sum(l_extendedprice), 4) AS flux,
  round(min_by((l_partkey % 100) * 1e8, l_returnflag || '|' || l_suppkey::VARCHAR || '|' || lpad((l_partkey % 100)::VARCHAR, 3, '0')) / 1e9, 5) AS freq FROM lineitem GROUP BY 1""")
def group_summary(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("group_id"), F.col("l_returnflag").alias("catalog"), F.col("l_suppkey").cast("string").alias("name"), F.col("l_extendedprice").alias("flux"), ((F.col("l_partkey") % 100) * 1e8).alias("freq"))
    return rounded(associate.group_summary(d).withColumn("flux", F.round("flux", 4)))


@query("""SELECT s_suppkey, s_suppkey % 7 > 0 AND (s_suppkey % 5 = 0 OR s_suppkey % 5 >= 2) AS good, (s_suppkey % 3 = 0 OR (0.1 * (s_suppkey % 9) >= 0.4 AND 0.1 * (s_suppkey % 8) <= 0.5)) AND (s_suppkey % 4 = 0 OR s_suppkey / (s_suppkey % 4) <= 20) AND s_suppkey <= 60 AS point_like,
  s_suppkey % 6 = 2 OR (s_suppkey % 6 = 1 AND CASE WHEN s_suppkey % 4 > 0 THEN s_suppkey / (s_suppkey % 4) <= 20 ELSE true END) AS fittable, CASE s_suppkey % 6 WHEN 3 THEN 'green' WHEN 4 THEN 'magenta' WHEN 2 THEN 'red' WHEN 1 THEN 'blue' WHEN 5 THEN 'yellow' ELSE 'white' END AS colour FROM supplier""")
def source_types(spark, sf_dir):
    k = F.col("s_suppkey")
    contour = F.struct((0.1 * (k % 9)).alias("circularity"), (0.1 * (k % 8)).alias("elongation"), F.lit(None).cast("double").alias("ellipse_ratio"))
    contours = F.when(k % 3 != 0, F.array(contour))
    beam, morph = (k % 4).cast("double"), (k % 6).cast("int")
    return table(spark, sf_dir, "supplier").select(
        "s_suppkey", associate.is_good(k % 7, F.when(k % 5 != 0, (k % 5).cast("double")), 2.0).alias("good"),
        associate.is_point_like(contours, k, beam, 0.4, 0.5, (0.6, 1.4), 20.0, 60).alias("point_like"), associate.is_fittable(morph, k, beam, 20.0).alias("fittable"), associate.region_colour(morph).alias("colour"),
    )


@query("""SELECT region_id, list_append(coalesce(tags, []), CASE WHEN name IN (SELECT name FROM skyobjects) THEN 'selected' ELSE 'rejected' END) AS tags FROM skyregions""")
def region_selection_tags(spark, sf_dir):
    return associate.tagged_regions(table(spark, sf_dir, "skyregions").select("region_id", "name", "tags"), table(spark, sf_dir, "skyobjects")).select("region_id", "tags")


@query("""WITH p AS (SELECT p_partkey, 1.0 + p_size % 9 AS a, 0.5 + p_size % 3 AS x, 1.5 + p_size % 4 AS y FROM part)
SELECT p_partkey, round(2 * pi() * sqrt(power(x * y, 2) * 0.04 + power(a * y, 2) * 0.01 + power(a * x, 2) * 0.02 + 2 * x * y * a * y * 0.005), 5) AS err FROM p""")
def flux_errors(spark, sf_dir):
    s = F.col("p_size")
    row = lambda *v: F.array(*map(F.lit, v))
    cov = F.array(row(0.04, 0.005, 0.0), row(0.005, 0.01, 0.0), row(0.0, 0.0, 0.02))
    return rounded(table(spark, sf_dir, "part").select("p_partkey", associate.flux_error(1.0 + s % 9, 0.5 + s % 3, 1.5 + s % 4, cov).alias("err")))


@query("""WITH p AS (SELECT DISTINCT l_suppkey % 40 AS blob, l_partkey % 50 AS ix, l_suppkey % 9 AS iy FROM lineitem), m AS (SELECT *, blob % 10 AS into_, (blob * 3 + ix) % 17 AS v FROM p)
SELECT into_ AS blob, ix, iy, min_by(v, blob)::DOUBLE AS v FROM m GROUP BY 1, 2, 3""")
def merged_pixels(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 40).alias("blob"), F.lit("a").alias("image_id"), (F.col("l_partkey") % 50).alias("ix"), (F.col("l_suppkey") % 9).alias("iy")).distinct()
    d = d.withColumn("v", ((F.col("blob") * 3 + F.col("ix")) % 17).cast("double"))
    into = spark.range(40).select(F.col("id").alias("blob"), (F.col("id") % 10).alias("into"))
    return associate.merge_pixels(d, into).drop("image_id")
