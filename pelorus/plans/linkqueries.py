"""Queries of selection, matching, graph, scalar and spectral operators, with their SQL.

Positions of the catalogues are made of keys: customers and suppliers spread over a plane of 360 by 180.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from pelorus.functions import scalars
from pelorus.operators import blobs, cuts, match, segment, spectra
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


def rounded(df, digits=4):
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def _placed(df, key):
    k = F.col(key)
    return df.withColumns({"id": k, "x": F.pmod(k * 7919, F.lit(36000)) / 100.0, "y": F.pmod(k * 104729, F.lit(18000)) / 100.0 - 90.0})


def customers(spark, sf_dir):
    return _placed(table(spark, sf_dir, "customer"), "c_custkey")


def suppliers(spark, sf_dir):
    return _placed(table(spark, sf_dir, "supplier"), "s_suppkey")


_CAT = """c AS (SELECT c_custkey AS id, (c_custkey * 7919 % 36000) / 100.0 AS x, (c_custkey * 104729 % 18000) / 100.0 - 90.0 AS y, c_acctbal, c_mktsegment FROM customer),
s AS (SELECT s_suppkey AS id, (s_suppkey * 7919 % 36000) / 100.0 AS x, (s_suppkey * 104729 % 18000) / 100.0 - 90.0 AS y, s_acctbal FROM supplier),
m AS (SELECT s.id AS left_id, c.id AS right_id, sqrt(power(c.x - s.x, 2) + power(c.y - s.y, 2)) AS dist FROM s JOIN c ON abs(c.x - s.x) <= 3.005 AND abs(c.y - s.y) <= 3.005)"""


def _matches(spark, sf_dir):
    return match.box_join(suppliers(spark, sf_dir), customers(spark, sf_dir), 3.005)


@query(f"WITH {_CAT} SELECT left_id, right_id, round(dist, 4) AS dist FROM m")
def box_match(spark, sf_dir):
    return rounded(_matches(spark, sf_dir).select("left_id", "right_id", "dist"))


@query(f"WITH {_CAT}, r AS (SELECT *, row_number() OVER (PARTITION BY left_id ORDER BY round(dist, 9), right_id) AS k FROM m) SELECT left_id, right_id, round(dist, 4) AS dist FROM r WHERE k = 1")
def box_match_best(spark, sf_dir):
    return rounded(match.best(_matches(spark, sf_dir).withColumn("dist", F.round("dist", 9))))


@query(f"WITH {_CAT} SELECT s.id, count(left_id) AS n_matches FROM s LEFT JOIN m ON m.left_id = s.id GROUP BY 1")
def tile_crossmatch_multiplicity(spark, sf_dir):
    return match.multiplicity(suppliers(spark, sf_dir), _matches(spark, sf_dir))


@query(f"WITH {_CAT} SELECT c.id FROM c WHERE NOT EXISTS (SELECT 1 FROM m WHERE right_id = c.id)")
def anti_match_fake(spark, sf_dir):
    return match.unmatched(customers(spark, sf_dir), _matches(spark, sf_dir).select(F.col("right_id").alias("left_id"))).select("id")


@query(f"WITH {_CAT} SELECT c.id, EXISTS (SELECT 1 FROM m WHERE right_id = c.id) AS is_real FROM c")
def reliability(spark, sf_dir):
    return match.correlate(suppliers(spark, sf_dir), customers(spark, sf_dir), 3.005)[1]


@query(f"""WITH {_CAT}, n AS (SELECT s.id, count(left_id) AS k FROM s LEFT JOIN m ON m.left_id = s.id GROUP BY 1)
SELECT id, CASE WHEN k = 0 THEN 'FAKE' ELSE 'REAL' END AS sourceness, CASE WHEN k = 0 THEN 'UNKNOWN' WHEN k = 1 THEN 'POINT-LIKE' ELSE 'COMPACT' END AS morph FROM n""")
def region_match_tags(spark, sf_dir):
    return match.tag_by_matches(suppliers(spark, sf_dir), _matches(spark, sf_dir))


@query("""WITH a AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem WHERE l_returnflag = 'A'), b AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem WHERE l_returnflag = 'N'),
na AS (SELECT s, count(*) AS n FROM a GROUP BY 1), nb AS (SELECT s, count(*) AS n FROM b GROUP BY 1),
d AS (SELECT a.s AS left_id, b.s AS right_id, count(*) AS shared FROM a JOIN b ON a.p = b.p GROUP BY 1, 2),
f AS (SELECT left_id, right_id, shared, shared / na.n AS f_left, shared / nb.n AS f_right FROM d JOIN na ON na.s = left_id JOIN nb ON nb.s = right_id WHERE shared / na.n >= 0.02 AND shared / nb.n >= 0.02),
r AS (SELECT *, row_number() OVER (PARTITION BY left_id ORDER BY f_left DESC, right_id DESC) AS k FROM f)
SELECT left_id, right_id, shared, round(f_left, 6) AS f_left, round(f_right, 6) AS f_right FROM r WHERE k = 1""")
def overlap_match(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("source_id"), F.col("l_partkey").alias("pixel_id"), "l_returnflag")
    return rounded(match.overlap_match(d.filter("l_returnflag = 'A'"), d.filter("l_returnflag = 'N'"), 0.02), 6)


@query("""SELECT p_name AS name, p_partkey, CASE WHEN p_brand = b THEN m ELSE 0 END AS morph, CASE WHEN p_brand = b THEN 1 ELSE 2 END AS sourceness
FROM part LEFT JOIN (SELECT p_brand AS b, arg_min(p_size, p_partkey) AS m FROM part WHERE p_size > 25 GROUP BY 1) ON p_brand = b""")
def region_tagger(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    regions = p.filter("p_size > 25").select(F.col("p_brand").alias("name"), F.col("p_partkey").alias("region_id"), F.col("p_size").alias("morph"), F.lit(1).alias("sourceness"))
    rows = p.select(F.col("p_brand").alias("name"), "p_name", "p_partkey", F.lit(0).alias("morph"), F.lit(2).alias("sourceness"))
    return match.tag_by_name(rows, regions).select(F.col("p_name").alias("name"), "p_partkey", "morph", "sourceness")


@query("""WITH x AS (SELECT o_custkey AS id, CAST(ascii(o_orderpriority) - 48 AS INTEGER) AS class_id, o_orderstatus = 'F' AS confirmed FROM orders),
g AS (SELECT id, list_sort(list(DISTINCT class_id)) AS c, bool_or(confirmed) AS confirmed FROM x GROUP BY 1)
SELECT id, CASE WHEN len(c) = 1 THEN c[1] ELSE -1 END AS class_id, array_to_string(list_transform(c, lambda v: lpad(CAST(v AS VARCHAR), 4, '0')), '') AS class_code, confirmed FROM g""")
def object_classes(spark, sf_dir):
    d = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), (F.ascii("o_orderpriority") - 48).alias("class_id"), (F.col("o_orderstatus") == "F").alias("confirmed"))
    return match.object_class(d)


_CUTS = """
# name, switch, operator, combination, values
l_quantity T <> OR {1,30} {10,45}
l_discount T <= AND {0.07}
l_linenumber T != AND {3}
l_tax F >= AND {0.5}
"""
_WHERE = "((l_quantity >= 1 AND l_quantity <= 10) OR (l_quantity >= 30 AND l_quantity <= 45)) {0} l_discount <= 0.07 {0} l_linenumber <> 3"


@query(f"SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE {_WHERE.format('AND')}")
def cut_select_and(spark, sf_dir):
    return cuts.select(table(spark, sf_dir, "lineitem"), cuts.parse_cuts(_CUTS)).select("l_orderkey", "l_linenumber", "l_quantity")


@query(f"SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE {_WHERE.format('OR')}")
def cut_select_or(spark, sf_dir):
    return cuts.select(table(spark, sf_dir, "lineitem"), cuts.parse_cuts(_CUTS), require_all=False).select("l_orderkey", "l_linenumber", "l_quantity")


@query("""WITH r AS (SELECT count(*) AS n, count(*) FILTER (NOT ((l_quantity >= 1 AND l_quantity <= 10) OR (l_quantity >= 30 AND l_quantity <= 45))) AS q, count(*) FILTER (NOT l_discount <= 0.07) AS d, count(*) FILTER (NOT l_linenumber <> 3) AS l FROM lineitem)
SELECT 'l_quantity' AS cut, q AS rejected, round(q / n, 6) AS share FROM r UNION ALL SELECT 'l_discount', d, round(d / n, 6) FROM r UNION ALL SELECT 'l_linenumber', l, round(l / n, 6) FROM r""")
def cut_rejection_stats(spark, sf_dir):
    return rounded(cuts.rejections(table(spark, sf_dir, "lineitem"), cuts.parse_cuts(_CUTS)), 6)


@query(f"WITH {_CAT} SELECT c.id FROM c WHERE power(x - 100, 2) + power(y - 10, 2) <= 900 OR (abs(x - 250) <= 20 AND abs(y + 30) <= 15) OR (x > 300 AND x < 340 AND y > 20 AND y < 20 + (x - 300))")
def region_contains_semi(spark, sf_dir):
    c = customers(spark, sf_dir)
    x, y = F.col("x"), F.col("y")
    corner = F.array(*(F.struct(F.lit(float(a)).alias("x"), F.lit(float(b)).alias("y")) for a, b in ((300, 20), (340, 20), (340, 60))))
    return c.filter(((x - 100) ** 2 + (y - 10) ** 2 <= 900) | ((F.abs(x - 250) <= 20) & (F.abs(y + 30) <= 15)) | scalars.in_polygon(x, y, corner)).select("id")


@query(f"""WITH {_CAT}, t AS (SELECT s.id, s.x, s.y, radians(y) AS d1, radians(10.0) AS d2, radians(120.0 - x) AS dr FROM s)
SELECT id, round(degrees(2 * asin(least(1.0, sqrt(power(sin((d2 - d1) / 2), 2) + cos(d1) * cos(d2) * power(sin(dr / 2), 2))))), 6) AS haversine,
 round(degrees(atan2(sqrt(power(cos(d2) * sin(dr), 2) + power(cos(d1) * sin(d2) - sin(d1) * cos(d2) * cos(dr), 2)), sin(d1) * sin(d2) + cos(d1) * cos(d2) * cos(dr))), 6) AS vincenty,
 round(degrees(atan2(sin(dr) * cos(d2), cos(d1) * sin(d2) - sin(d1) * cos(d2) * cos(dr))), 6) AS bearing FROM t""")
def sky_distances(spark, sf_dir):
    s, a, d = suppliers(spark, sf_dir), F.lit(120.0), F.lit(10.0)
    at = (F.col("x"), F.col("y"), a, d)
    return rounded(s.select("id", scalars.haversine(*at).alias("haversine"), scalars.vincenty(*at).alias("vincenty"), scalars.bearing(*at).alias("bearing")), 6)


@query("""SELECT p_partkey, round(pi() * p_size * p_retailprice / (4 * ln(2)), 4) AS beam_area, round(sqrt(1 - power(least(p_size, p_retailprice) / greatest(p_size, p_retailprice), 2)), 6) AS eccentricity,
 round(2 * pi() * p_size * p_size * p_retailprice, 2) AS integral FROM part""")
def ellipse_functions(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumn("a", F.col("p_size").cast("double"))
    return p.select("p_partkey", F.round(scalars.beam_area(F.col("a"), F.col("p_retailprice")), 4).alias("beam_area"), F.round(scalars.eccentricity(F.col("a"), F.col("p_retailprice")), 6).alias("eccentricity"), F.round(scalars.gauss_integral(F.col("p_retailprice"), F.col("a"), F.col("a")), 2).alias("integral"))


@query("""SELECT p_partkey, round(sqrt(greatest(power(p_size + 60.0, 2) - 2500, 0)), 4) AS bmaj, round(sqrt(greatest(power(p_size / 2.0 + 55, 2) - 2500, 0)), 4) AS bmin FROM part""")
def beam_deconvolution(spark, sf_dir):
    a, b = F.col("p_size") + 60.0, F.col("p_size") / 2.0 + 55.0
    # a round beam of 50: the axes come out one by one whatever the angle
    e = scalars.deconvolved(a, b, F.lit(30.0), F.lit(50.0), F.lit(50.0), F.lit(0.0))
    return rounded(table(spark, sf_dir, "part").select("p_partkey", e["bmaj"].alias("bmaj"), e["bmin"].alias("bmin")))


@query("""SELECT p_partkey, string_split(trim(p_name), ' ') AS words, replace(p_name, ' ', '') AS joined, lower(p_name) = lower(p_type) AS same, lpad(CAST(p_partkey % 1000 AS VARCHAR), 4, '0') || lpad(CAST(p_size AS VARCHAR), 4, '0') AS code FROM part""")
def string_utils(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", scalars.split_whitespace(F.col("p_name")).alias("words"), scalars.without_blanks(F.col("p_name")).alias("joined"), (F.lower("p_name") == F.lower("p_type")).alias("same"), scalars.id_code([F.col("p_partkey") % 1000, F.col("p_size")], 4).alias("code"))


_LG = "log10(p_size / 10.0)"


@query(f"""SELECT p_partkey, round(log10(2 * power(p_size / 10.0 / 1.5, -0.7) * (1 - exp(-power(p_size / 10.0 / 1.5, -3.2))) / power(p_size / 10.0 / 1.5, -3.2)), 6) AS ssa,
 round(log10(2 * power(p_size / 10.0, -0.7) * exp(-power(p_size / 10.0 / 0.8, -2.1))), 6) AS ext_ffa FROM part""")
def spectrum_models(spark, sf_dir):
    p, lg = table(spark, sf_dir, "part"), F.log10(F.col("p_size") / 10.0)
    return rounded(p.select("p_partkey", scalars.synchrotron_self_absorbed(lg, 2.0, -0.7, 1.5).alias("ssa"), scalars.synchrotron_external_absorbed(lg, 2.0, -0.7, 0.8).alias("ext_ffa")), 6)


@query("""WITH x AS (SELECT user_id, log10(date_part('day', ts)) AS lg_nu, log10(value) AS lg_s FROM events WHERE value > 0)
SELECT user_id, count(*) AS n, round(regr_slope(lg_s, lg_nu), 4) AS alpha, round(regr_intercept(lg_s, lg_nu), 4) AS lg_norm FROM x GROUP BY 1 HAVING count(DISTINCT lg_nu) > 1""")
def sed_power_law(spark, sf_dir):
    e = table(spark, sf_dir, "events").filter("value > 0").select("user_id", F.log10(F.dayofmonth("ts").cast("double")).alias("lg_nu"), F.log10("value").alias("lg_s"))
    several = e.groupBy("user_id").agg(F.min("lg_nu").alias("a"), F.max("lg_nu").alias("b")).filter("a < b").select("user_id")
    return rounded(spectra.power_law_fit(e.join(several, "user_id", "left_semi"), ["user_id"]))


@query()
def sed_models(spark, sf_dir):
    e = table(spark, sf_dir, "events").filter("value > 0").groupBy("event_type", F.dayofmonth("ts").alias("d")).agg(F.avg("value").alias("v"))
    return spectra.spectral_fits(e.select("event_type", F.log10(F.col("d").cast("double")).alias("lg_nu"), F.log10("v").alias("lg_s"), F.lit(0.1).alias("lg_err")), "event_type")


_EDGES = [3.0, 3.5, 4.0, 4.5, 5.0, 5.5, 6.0]


@query(f"""WITH b AS (SELECT CAST(floor((log10(o_totalprice) - 3.0) / 0.5) AS INTEGER) AS bin FROM orders WHERE o_totalprice > 0)
SELECT bin, count(*) AS n, round(1e6 * count(*) / (power(10, 3.5 + bin * 0.5) - power(10, 3.0 + bin * 0.5)), 6) AS dnds_e6 FROM b WHERE bin BETWEEN 0 AND 5 GROUP BY 1""")
def source_counts_dnds(spark, sf_dir):
    d = spectra.source_counts(table(spark, sf_dir, "orders"), "o_totalprice", _EDGES)
    return d.select("bin", "n", F.round(F.col("dnds") * 1e6, 6).alias("dnds_e6"))


@query("""WITH t AS (SELECT CAST(floor(value / 20) AS INTEGER) AS j, CAST(count(*) AS DOUBLE) AS n FROM events WHERE value IS NOT NULL GROUP BY 1)
SELECT j + o AS i, round(sum(n * w), 4) AS folded FROM t CROSS JOIN (VALUES (-1, 0.2), (0, 0.6), (1, 0.2)) k(o, w) GROUP BY 1""")
def fold_spectrum(spark, sf_dir):
    t = table(spark, sf_dir, "events").filter("value is not null").groupBy(F.floor(F.col("value") / 20).cast("int").alias("j")).agg(F.count("*").cast("double").alias("true"))
    bins = t.select("j")
    near = F.explode(F.array(*(F.struct(F.lit(o).alias("o"), F.lit(w).alias("r")) for o, w in ((-1, 0.2), (0, 0.6), (1, 0.2)))))
    response = bins.select("j", near.alias("k")).select("j", (F.col("j") + F.col("k.o")).alias("i"), "k.r")
    return rounded(spectra.fold(t, response))


@query()
def response_matrix(spark, sf_dir):
    return spectra.response_matrix(spark, _EDGES, 0.02, 0.15, 0.95, 4.0, 0.3)


@query()
def gauss_mixture(spark, sf_dir):
    from pelorus.plans.imagequeries import _significance

    z = _significance(spark, sf_dir).select("image_id", "ix", "iy", F.col("z").alias("v"))
    b = blobs.find_blobs(z, 2.0, 1.0, 6, 32)
    return spectra.gauss_mixture(b.select(F.col("blob").alias("source_id"), "ix", "iy", "v"), 2)


@query()
def simulated_map(spark, sf_dir):
    return spectra.render(spectra.point_sources(spark, 200, 256, 256, 1.0, 100.0, 1.6), 1.5, 6)


@query("""WITH RECURSIVE e AS (SELECT DISTINCT c_nationkey AS a, 1000000 + c_custkey AS b FROM customer),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e), w AS (SELECT a AS node, a AS c FROM u UNION SELECT u.b, w.c FROM w JOIN u ON u.a = w.node WHERE w.c < u.b)
SELECT node, min(c) AS component FROM w GROUP BY 1""")
def graph_components(spark, sf_dir):
    """The components of all customers, each linked to its nation."""
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("long").alias("a"), (F.col("c_custkey") + 1000000).alias("b"))
    return blobs.label_components(c)


_NATIONS = "SELECT DISTINCT c_nationkey AS a, s_nationkey AS b FROM orders JOIN customer ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey"


def _nation_edges(spark, sf_dir):
    """Nations of customer and supplier that a line links."""
    li = table(spark, sf_dir, "lineitem")
    d = li.join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return d.select(F.col("c_nationkey").alias("a"), F.col("s_nationkey").alias("b")).distinct()


@query(f"""WITH n AS ({_NATIONS}), e AS (SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM n WHERE a <> b)
SELECT [x.a, x.b, y.b] AS members FROM e x JOIN e y ON y.a = x.b JOIN e z ON z.a = x.a AND z.b = y.b""")
def clique_triples(spark, sf_dir):
    return match.cliques(_nation_edges(spark, sf_dir), 3)


def _rank_sql(rounds: int) -> str:
    out = f"WITH e AS ({_NATIONS}), d AS (SELECT a, count(*) AS deg FROM e GROUP BY 1), v AS (SELECT a AS node FROM e UNION SELECT b FROM e), n AS (SELECT count(*) AS n FROM v), r0 AS (SELECT node, 1 / sqrt(n) AS r FROM v, n)"
    for i in range(rounds):
        out += f", g{i} AS (SELECT e.b AS node, sum(r / deg) AS got FROM e JOIN d ON d.a = e.a JOIN r{i} ON r{i}.node = e.a GROUP BY 1), u{i} AS (SELECT r{i}.node, 0.85 * coalesce(got, 0) + 0.15 / n * (SELECT sum(r) FROM r{i}) AS r FROM r{i} LEFT JOIN g{i} ON g{i}.node = r{i}.node, n), r{i + 1} AS (SELECT node, r / (SELECT sqrt(sum(r * r)) FROM u{i}) AS r FROM u{i})"
    return out + f" SELECT node, round(r, 5) AS rank FROM r{rounds}"


@query(_rank_sql(4))
def page_rank(spark, sf_dir):
    return rounded(segment.page_rank(_nation_edges(spark, sf_dir), tol=0.0, rounds=4), 5)


@query()
def page_rank_settled(spark, sf_dir):
    """The same to the step or rounds that the operator ends at."""
    return rounded(segment.page_rank(_nation_edges(spark, sf_dir)), 5)


@query(f"WITH {_CAT}, r AS (SELECT c_mktsegment, id, c_acctbal, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, id) AS rank FROM c) SELECT c_mktsegment, id, c_acctbal, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5")
def top_n_per_group(spark, sf_dir):
    return match.first_per_group(customers(spark, sf_dir), ["c_mktsegment"], [F.desc("c_acctbal"), "id"], 5).select("c_mktsegment", "id", "c_acctbal", "rank")


@query("""WITH x AS (SELECT l_orderkey AS group_id, l_extendedprice AS flux, l_tax AS e, l_quantity AS b FROM lineitem)
SELECT group_id, round(sum(flux / b), 8) AS flux, round(sqrt(sum(power(e / b, 2))), 8) AS flux_err, count(*) AS n FROM x GROUP BY 1""")
def group_flux(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("group_id"), F.col("l_extendedprice").alias("flux"), F.col("l_tax").alias("flux_err"), F.col("l_quantity").alias("beam_area"), F.lit(0.0).alias("s"))
    g = match.group_flux(d)
    return g.select("group_id", F.round("flux", 8).alias("flux"), F.round("flux_err", 8).alias("flux_err"), "n")


@query("""WITH t AS (SELECT region_id AS tile_id, CAST(floor(cx) AS BIGINT) AS x0, CAST(floor(cx) AS BIGINT) + 2 AS x1, CAST(floor(cy) AS BIGINT) AS y0, CAST(floor(cy) AS BIGINT) + 2 AS y1 FROM skyregions WHERE cx IS NOT NULL AND cy IS NOT NULL)
SELECT a.tile_id AS a, b.tile_id AS b FROM t a JOIN t b ON a.tile_id < b.tile_id AND a.x0 <= b.x1 + 1 AND b.x0 <= a.x1 + 1 AND a.y0 <= b.y1 + 1 AND b.y0 <= a.y1 + 1""")
def tile_neighbours(spark, sf_dir):
    x, y = F.floor("cx").cast("long"), F.floor("cy").cast("long")
    return match.near_tiles(table(spark, sf_dir, "skyregions").filter("cx is not null and cy is not null").select(F.col("region_id").alias("tile_id"), x.alias("x0"), (x + 2).alias("x1"), y.alias("y0"), (y + 2).alias("y1")))


@query("SELECT image_id, count(*) AS n, min(s) AS s_min, max(s) AS s_max FROM (SELECT l_returnflag AS image_id, l_orderkey AS source_id, sum(l_quantity) AS s FROM lineitem GROUP BY 1, 2) GROUP BY 1")
def source_sums(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("image_id"), F.col("l_orderkey").alias("source_id")).agg(F.sum("l_quantity").alias("s"))
    return d.groupBy("image_id").agg(F.count("*").alias("n"), F.min("s").alias("s_min"), F.max("s").alias("s_max"))
