"""Queries of scalar, array, polygon and contour functions, with their SQL."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from pelorus.functions import contours, skymodels, wcs
from pelorus.functions import scalars as S
from pelorus.operators import associate
from pelorus.plans.runtime import table
from pelorus.sources import catalogs

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


@query("""SELECT o_orderkey, string_split(o_orderdate::DATE::VARCHAR, '-') AS parts, array_to_string(string_split(o_orderdate::DATE::VARCHAR, '-'), '/') AS slashed, replace(o_orderpriority, 'E', '') AS no_e,
  replace(o_orderpriority, '-', '_') AS underlined, CASE WHEN strpos(o_orderpriority, '-') = 0 THEN o_orderpriority ELSE left(o_orderpriority, strpos(o_orderpriority, '-') - 1) END AS before,
  CASE WHEN strpos(o_orderpriority, '-') = 0 THEN o_orderpriority ELSE substr(o_orderpriority, strpos(o_orderpriority, '-') + 1) END AS after, contains(o_orderpriority, 'LOW') AS is_low,
  year(o_orderdate) + month(o_orderdate) + day(o_orderdate) AS total, o_orderkey * 100000 + o_custkey % 100000 AS code FROM orders""")
def string_functions(spark, sf_dir):
    c = F.col("o_orderpriority")
    parts = S.split_on(F.to_date("o_orderdate").cast("string"), "-")
    total = F.aggregate(S.typed(parts, "int"), F.lit(0), lambda a, b: a + b).cast("long")
    code = F.concat(F.col("o_orderkey").cast("string"), F.lpad((F.col("o_custkey") % 100000).cast("string"), 5, "0")).cast("long")
    return table(spark, sf_dir, "orders").select("o_orderkey", parts.alias("parts"), S.joined(parts, "/").alias("slashed"), S.without(c, "E").alias("no_e"), S.replaced(c, "-", "_").alias("underlined"), S.part_of(c, "-").alias("before"), S.part_of(c, "-", left=False).alias("after"), c.contains("LOW").alias("is_low"), total.alias("total"), code.alias("code"))


@query("""SELECT c_custkey, ((c_custkey % 1000) * 1000000 + (c_nationkey % 1000) * 1000 + c_custkey % 7)::BIGINT AS code, len(uuid()::VARCHAR) AS uuid_size FROM customer""")
def integer_codes(spark, sf_dir):
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select("c_custkey", S.integer_code([k % 1000, F.col("c_nationkey") % 1000, k % 7], 3).alias("code"), F.length(F.uuid()).cast("long").alias("uuid_size"))


_ARRAYS = "WITH a AS (SELECT l_orderkey AS k, list(l_linenumber::INT ORDER BY l_linenumber) AS n, list((l_quantity::INT) % 5 ORDER BY l_linenumber, (l_quantity::INT) % 5) AS q FROM lineitem GROUP BY 1)"


@query(f"""{_ARRAYS} SELECT k, list_contains(q, 3) AS any_three, len(list_filter(q, lambda v: v < 4)) = len(q) AS all_below, coalesce(list_position(q, 3), 0)::INT - 1 AS at_three,
  [q[i] FOR i IN range(1, len(q) + 1) IF i NOT IN (1, 3)] AS others, list_reverse(q) AS backwards, [(0.0 + i * (len(q) - 0.0) / 3)::DOUBLE FOR i IN range(0, 4)] AS spaced, k % 2 = 0 AS has_key,
  CASE WHEN len(q) > 2 THEN (SELECT median(v) FROM (SELECT unnest(list_sort(q)[2:len(q)]) AS v)) END AS middle FROM a""")
def array_functions(spark, sf_dir):
    line = F.struct(F.col("l_linenumber").cast("int").alias("n"), (F.col("l_quantity").cast("int") % 5).alias("q"))
    # an order has at most seven lines
    d = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.array_sort(F.collect_list(line)).alias("a"))
    q = F.transform("a", lambda e: e["q"])
    n = F.size(q)
    keyed = F.create_map(F.col("k") % 2, F.lit(1))
    return d.select(
        "k", S.any_true(F.transform(q, lambda v: v == 3)).alias("any_three"), S.all_true(F.transform(q, lambda v: v < 4)).alias("all_below"), S.position_of(q, 3).alias("at_three"),
        S.without_positions(q, F.array(F.lit(0), F.lit(2))).alias("others"), S.reordered(q, F.reverse(F.sequence(F.lit(0), n - 1))).alias("backwards"), S.linspace(F.lit(0.0), n.cast("double"), 4).alias("spaced"),
        S.has_key(keyed, F.lit(0).cast("long")).alias("has_key"), F.when(n > 2, S.range_median(q, F.lit(1), n - 1)).alias("middle"),
    )


@query(f"""{_ARRAYS}, s AS (SELECT k, list_sort(n) AS x, list_sort(q) AS y FROM a), x AS (SELECT k, v, row_number() OVER (PARTITION BY k, v ORDER BY i) AS r, i - 1 AS l FROM (SELECT k, unnest(x) AS v, unnest(range(1, len(x) + 1)) AS i FROM s)),
y AS (SELECT k, v, row_number() OVER (PARTITION BY k, v ORDER BY i) AS r, i - 1 AS l FROM (SELECT k, unnest(y) AS v, unnest(range(1, len(y) + 1)) AS i FROM s))
SELECT x.k, x.l::INT AS "left", y.l::INT AS "right" FROM x JOIN y ON y.k = x.k AND y.v = x.v AND y.r = x.r""")
def common_positions(spark, sf_dir):
    line = F.struct(F.col("l_linenumber").cast("int").alias("n"), (F.col("l_quantity").cast("int") % 5).alias("q"))
    d = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.array_sort(F.collect_list(line)).alias("a"))
    return d.select("k", F.inline(S.common_positions(F.transform("a", lambda e: e["n"]), F.transform("a", lambda e: e["q"]))))


@query("""SELECT c_custkey, round(c_acctbal - 360 * floor(c_acctbal / 360), 5) AS turned, round(c_acctbal - 360 * ceil((c_acctbal - 180) / 360), 5) AS half_turned, round(-1 + 2 * (c_acctbal + 1000) / 11000, 5) AS mean, round(c_acctbal * 2 / 11000, 5) AS rms,
  round(pi() * 3 * (1 + c_custkey % 5), 5) AS semi_area, round(pi() * 3 * (1 + c_custkey % 5) / 4, 5) AS full_area, round(pi() * 2 * 3 * (1 + c_custkey % 5) / (4 * ln(2)), 5) AS integral, ceil(sqrt(3 * (1 + c_custkey % 5)) / sqrt(0.5))::INT AS width,
  factorial((c_custkey % 9)::INT)::BIGINT AS factorial, round((c_custkey % 5) + (c_custkey % 7) + 1.0, 5) AS trace FROM customer""")
def angle_functions(spark, sf_dir):
    b, k = F.col("c_acctbal"), F.col("c_custkey")
    size = (1 + k % 5).cast("double")
    low, high = F.lit(-1000.0), F.lit(10000.0)
    m = F.array(F.array((k % 5).cast("double"), F.lit(9.0), F.lit(8.0)), F.array(F.lit(7.0), (k % 7).cast("double"), F.lit(6.0)), F.array(F.lit(5.0), F.lit(4.0), F.lit(1.0)))
    return rounded(table(spark, sf_dir, "customer").select(
        "c_custkey", S.modulo(b, F.lit(360.0)).alias("turned"), S.angle_in_range(b, 180.0).alias("half_turned"), S.rescaled(b, low, high, -1.0, 1.0).alias("mean"), S.rescaled_difference(b, low, high, -1.0, 1.0).alias("rms"),
        S.ellipse_area(F.lit(3.0), size).alias("semi_area"), S.ellipse_area(F.lit(3.0), size, "full").alias("full_area"), S.gauss_ellipse_integral(F.lit(2.0), F.lit(3.0), size).alias("integral"), S.beam_width_pixels(F.lit(3.0), size, F.lit(0.5), F.lit(-1.0)).alias("width"),
        F.factorial((k % 9).cast("int")).alias("factorial"), S.matrix_trace(m).alias("trace"),
    ))


_SIGMA = """SELECT p_partkey, 1.0 + p_size % 5 AS sx, 2.0 + p_size % 3 AS sy, 0.5 * (p_size % 4) AS cv, p_retailprice / 1000 AS dx, p_size / 10.0 AS dy FROM part"""


@query(f"""WITH s AS ({_SIGMA}), e AS (SELECT *, (sx * sx + sy * sy) / 2 AS h, (sx * sx - sy * sy) / 2 AS f FROM s)
SELECT p_partkey, round(sqrt((dx * dx * sy * sy - 2 * dx * dy * cv + dy * dy * sx * sx) / (sx * sx * sy * sy - cv * cv)), 5) AS distance, round(sqrt((dx * dx * sy * sy - 2 * dx * dy * cv + dy * dy * sx * sx) / (sx * sx * sy * sy - cv * cv)), 5) AS by_matrix,
  round(sqrt(h + sqrt(f * f + cv * cv)) * sqrt(-2 * ln(0.05)), 5) AS r1, round(sqrt(h - sqrt(f * f + cv * cv)) * sqrt(-2 * ln(0.05)), 5) AS r2, round(degrees(atan2(cv, f)) / 2, 5) AS theta FROM e""")
def covariance_functions(spark, sf_dir):
    c = F.col
    z = (c("p_size") % 5 + 1.0, c("p_size") % 3 + 2.0, (c("p_size") % 4) * 0.5)
    d = table(spark, sf_dir, "part").select("p_partkey", z[0].alias("sx"), z[1].alias("sy"), z[2].alias("cv"), (c("p_retailprice") / 1000).alias("dx"), (c("p_size") / 10.0).alias("dy"))
    e = S.confidence_ellipse(F.lit(0.0), F.lit(0.0), c("sx"), c("sy"), c("cv"), 0.95)
    sigma = F.array(F.array(c("sx") ** 2, c("cv")), F.array(c("cv"), c("sy") ** 2))
    return rounded(d.select("p_partkey", S.mahalanobis2(c("dx"), c("dy"), c("sx"), c("sy"), c("cv")).alias("distance"), contours.mahalanobis(F.array("dx", "dy"), sigma).alias("by_matrix"), e["r1"].alias("r1"), e["r2"].alias("r2"), e["theta"].alias("theta")))


@query(f"""WITH n AS (SELECT p_partkey, 0.1 * p_size - 2 AS lg FROM part), f AS (SELECT *, pow(10, lg) AS ghz FROM n)
SELECT p_partkey, round(log10(1e26 * 1e-7 * 2 * {S.H_PLANCK} / ({S.C_LIGHT}::DOUBLE * {S.C_LIGHT}) * pow(ghz * 1e9, 3) / (exp(ghz * 1e9 * {S.H_PLANCK} / ({S.K_BOLTZMANN} * 1e4)) - 1)
  * (1 - exp(-3.014e-2 * pow(1e4, -1.5) / (ghz * ghz) * 1e6 * (ln(4.955e-2 / ghz) + 1.5 * ln(1e4))))), 4) AS flux FROM f""")
def free_free_emission(spark, sf_dir):
    return rounded(table(spark, sf_dir, "part").select("p_partkey", S.free_free(0.1 * F.col("p_size") - 2, -7.0, 4.0, 6.0).alias("flux")), 4)


@query("""SELECT s_suppkey, 'J' || lpad((s_suppkey % 24)::VARCHAR, 2, '0') || lpad((s_suppkey % 60)::VARCHAR, 2, '0') || '12.5' || CASE WHEN s_nationkey - 10 > 0 THEN '+' ELSE '' END || CASE WHEN length((s_nationkey - 10)::VARCHAR) = 1 THEN '0' ELSE '' END || (s_nationkey - 10)::VARCHAR || '05' || '30' AS iau FROM supplier""")
def iau_coordinates(spark, sf_dir):
    k, n = F.col("s_suppkey"), F.col("s_nationkey") - 10
    text = F.concat((k % 24).cast("string"), F.lit(":"), (k % 60).cast("string"), F.lit(":12.5 "), n.cast("string"), F.lit(":5:30 FK5"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", S.iau_coordinates(text).alias("iau"))



@query("""WITH p AS (SELECT c_custkey, (c_custkey % 9)::DOUBLE AS x, ((c_custkey / 9) % 9)::DOUBLE AS y FROM (SELECT c_custkey FROM customer)), g AS (SELECT c_custkey, x, floor(y) AS y FROM p)
SELECT c_custkey, (x IN (2, 6) AND y BETWEEN 2 AND 6) OR (y IN (2, 6) AND x BETWEEN 2 AND 6) AS border, x > 2 AND x < 6 AND y > 2 AND y < 6 AS winding, x >= 2 AND x <= 6 AND y >= 2 AND y <= 6 AS winding_closed, x >= 2 AND x <= 6 AND y >= 2 AND y <= 6 AS contour_closed FROM g""")
def polygon_borders(spark, sf_dir):
    k = F.col("c_custkey")
    x, y = (k % 9).cast("double"), (F.floor(k / 9) % 9).cast("double")
    point = lambda a, b: F.struct(F.lit(float(a)).alias("x"), F.lit(float(b)).alias("y"))
    # the square 2 to 6, gone round twice: by the winding number still inside
    once = F.array(point(2, 2), point(6, 2), point(6, 6), point(2, 6))
    twice = F.concat(once, once)
    return table(spark, sf_dir, "customer").select("c_custkey", S.on_boundary(x, y, once).alias("border"), S.in_polygon_winding(x, y, twice).alias("winding"), S.in_polygon_winding(x, y, twice, True).alias("winding_closed"), S.in_contour(x, y, once, True).alias("contour_closed"))


def _monthly(spark, sf_dir):
    """A contour of twelve points for each order status: a point for each month, as far out as its mean price."""
    o = table(spark, sf_dir, "orders").groupBy("o_orderstatus", F.month("o_orderdate").alias("m")).agg(F.avg("o_totalprice").alias("r"))
    angle = F.col("m") * (math.pi / 6)
    point = F.struct("m", (F.col("r") / 1000 * F.cos(angle)).alias("x"), (F.col("r") / 1500 * F.sin(angle)).alias("y"))
    return o.groupBy("o_orderstatus").agg(F.array_sort(F.collect_list(point)).alias("p")).select("o_orderstatus", F.transform("p", lambda e: F.struct(e["x"].alias("x"), e["y"].alias("y"))).alias("points"))


_MONTHLY = """WITH o AS (SELECT o_orderstatus, month(o_orderdate) AS m, avg(o_totalprice) AS r FROM orders GROUP BY 1, 2), p AS (SELECT o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY m) - 1 AS j, count(*) OVER (PARTITION BY o_orderstatus) AS n, r / 1000 * cos(m * pi() / 6) AS x, r / 1500 * sin(m * pi() / 6) AS y FROM o),
u AS (SELECT a.o_orderstatus, a.n, a.j AS s, sum(b.x * cos(2 * pi() * a.j * b.j / a.n) + b.y * sin(2 * pi() * a.j * b.j / a.n)) AS re, sum(b.y * cos(2 * pi() * a.j * b.j / a.n) - b.x * sin(2 * pi() * a.j * b.j / a.n)) AS im FROM p a JOIN p b ON b.o_orderstatus = a.o_orderstatus GROUP BY 1, 2, 3)"""


@query(f"{_MONTHLY} SELECT o_orderstatus, s::INT AS k, round(sqrt(re * re + im * im), 4) AS modulus, round(sqrt(re * re + im * im) / n, 4) AS shifted FROM u")
def contour_transform(spark, sf_dir):
    import numpy as np

    d = _monthly(spark, sf_dir)
    size = lambda z: np.abs(contours.dft(z))
    # the shifted transform begins at -floor(N / 2): brought back into order it is the plain one over N
    shifted = lambda z: np.abs(np.roll(contours.dft_shifted(z), -(len(z) // 2)))
    both = d.select("o_orderstatus", F.arrays_zip(contours.over(F.col("points"), size).alias("modulus"), contours.over(F.col("points"), shifted).alias("shifted")).alias("z"))
    return rounded(both.select("o_orderstatus", F.posexplode("z").alias("k", "z")).select("o_orderstatus", "k", "z.modulus", "z.shifted"), 4)


@query("""WITH o AS (SELECT o_orderstatus, month(o_orderdate) AS m, avg(o_totalprice) AS r FROM orders GROUP BY 1, 2), p AS (SELECT o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY m) - 1 AS j, count(*) OVER (PARTITION BY o_orderstatus) AS n, r / 1000 * cos(m * pi() / 6) AS x, r / 1500 * sin(m * pi() / 6) AS y FROM o),
c AS (SELECT *, sqrt(power(x - avg(x) OVER (PARTITION BY o_orderstatus), 2) + power(y - avg(y) OVER (PARTITION BY o_orderstatus), 2)) AS d FROM p),
u AS (SELECT a.o_orderstatus, a.j AS s, sum(b.d * cos(2 * pi() * a.j * b.j / a.n)) AS re, -sum(b.d * sin(2 * pi() * a.j * b.j / a.n)) AS im FROM c a JOIN c b ON b.o_orderstatus = a.o_orderstatus GROUP BY 1, 2)
SELECT o_orderstatus, s::INT AS k, round(sqrt(re * re + im * im) / max(CASE WHEN s = 1 THEN sqrt(re * re + im * im) END) OVER (PARTITION BY o_orderstatus), 4) AS descriptor FROM u""")
def centroid_descriptors(spark, sf_dir):
    d = _monthly(spark, sf_dir).select("o_orderstatus", F.posexplode(contours.over(F.col("points"), contours.centroid_distances)).alias("k", "descriptor"))
    return rounded(d, 4)


@query(f"""{_MONTHLY}, f AS (SELECT *, CASE WHEN s > n - 1 - floor(n / 2) THEN s - n ELSE s END AS eta FROM u),
t AS (SELECT p.o_orderstatus, p.n, p.j, cos(2 * pi() * f.s * p.j / p.n) AS c, sin(2 * pi() * f.s * p.j / p.n) AS d, f.re, f.im, 2 * pi() * f.eta AS w, exp(-power(0.1 * f.eta, 2)) AS g FROM p JOIN f ON f.o_orderstatus = p.o_orderstatus),
v AS (SELECT o_orderstatus, n, j, sum(-w * (im * c + re * d)) / n AS a, sum(w * (re * c - im * d)) / n AS b, sum(-w * g * (im * c + re * d)) / n AS as_, sum(w * g * (re * c - im * d)) / n AS bs,
  sum(-w * w * g * (re * c - im * d)) / n AS cs, sum(-w * w * g * (im * c + re * d)) / n AS ds FROM t GROUP BY 1, 2, 3),
k AS (SELECT *, sum(sqrt(a * a + b * b)) OVER (PARTITION BY o_orderstatus) AS l, sum(sqrt(as_ * as_ + bs * bs)) OVER (PARTITION BY o_orderstatus) AS ls FROM v)
SELECT o_orderstatus, round(sum(power(-(bs * cs - as_ * ds) / power(as_ * as_ + bs * bs, 1.5) * ls / l, 2)) * power(max(l) * 2 * pi() / max(n), 2) / max(n), 3) AS energy FROM k GROUP BY 1""")
def bending_energy(spark, sf_dir):
    d = _monthly(spark, sf_dir).select("o_orderstatus", F.get(contours.over(F.col("points"), lambda z: contours.bending_energy(z, (0.1,))), F.lit(0)).alias("energy"))
    return rounded(d, 3)


_AXES = "SELECT p_partkey, (p_partkey % 50)::DOUBLE AS x, -(p_partkey % 30)::DOUBLE AS y, 3.0 + p_size % 10 AS r1, 1.0 + p_size % 2 AS r2, (p_partkey * 7 % 170 + 5)::DOUBLE AS theta FROM part"


@query(f"SELECT p_partkey, x, y, r1::DOUBLE AS r1, r2::DOUBLE AS r2, theta FROM ({_AXES})")
def ellipse_fit(spark, sf_dir):
    k, s = F.col("p_partkey"), F.col("p_size")
    x, y, r1, r2, theta = (k % 50).cast("double"), -(k % 30).cast("double"), 3.0 + s % 10, 1.0 + s % 2, (k * 7 % 170 + 5).cast("double")
    d = table(spark, sf_dir, "part").select("p_partkey", contours.fit_ellipse(S.ellipse_polygon(x, y, r1, r2, theta, 24)).alias("e"))
    return rounded(d.select("p_partkey", "e.*"), 4)


@query("""WITH e AS (SELECT p_partkey, 6.0 + p_size % 10 AS a, 4.0 + p_size % 2 AS b FROM part) SELECT p_partkey, round(sqrt(a * a - 9) / 2, 5) AS r1, round(sqrt(b * b - 9) / 2, 5) AS r2, 40.0::DOUBLE AS theta, 1.0::DOUBLE AS x FROM e""")
def ellipse_deconvolution(spark, sf_dir):
    s = F.col("p_size")
    shape = lambda x, r1, r2, t: F.struct(x.alias("x"), F.lit(0.0).alias("y"), r1.alias("r1"), r2.alias("r2"), t.alias("theta"))
    # every second ellipse is given by its minor axis first, turned by a right angle
    major, minor = (6.0 + s % 10) / 2, (4.0 + s % 2) / 2
    turned = F.col("p_partkey") % 2 == 1
    e = shape(F.lit(1.0), F.when(turned, minor).otherwise(major), F.when(turned, major).otherwise(minor), F.when(turned, F.lit(130.0)).otherwise(F.lit(40.0)))
    beam = shape(F.lit(0.0), F.lit(1.5), F.lit(1.5), F.lit(0.0))
    return rounded(table(spark, sf_dir, "part").select("p_partkey", S.deconvolved_ellipse(e, beam).alias("d")).select("p_partkey", "d.r1", "d.r2", "d.theta", "d.x"))


_HEAD = [("cx", 10.0), ("cy", 20.0), ("xc", 50.0), ("yc", 5.0), ("dx", -0.01), ("dy", 0.01)]


@query("""WITH s AS (SELECT s_suppkey, (s_suppkey % 50)::DOUBLE AS x, (s_suppkey % 30)::DOUBLE AS y FROM supplier), p AS (SELECT s_suppkey, unnest([0, 1, 2]) AS k, x, y FROM s)
SELECT s_suppkey, k, round(50 + (x + k + 0.5 + 1 - 10) * -0.01, 6) AS ra, round(5 + (y + 2 * k + 0.5 + 1 - 20) * 0.01, 6) AS dec FROM p""")
def contour_on_sky(spark, sf_dir):
    x, y = (F.col("s_suppkey") % 50).cast("double"), (F.col("s_suppkey") % 30).cast("double")
    verts = F.array(*(F.struct((x + k).alias("x"), (y + 2 * k).alias("y")) for k in range(3)))
    sky = wcs.contour_to_sky(verts, *(F.lit(v) for _, v in _HEAD), offset=0.5, projection="CAR")
    d = table(spark, sf_dir, "supplier").select("s_suppkey", F.posexplode(sky).alias("k", "p"))
    return d.select("s_suppkey", "k", F.round("p.x", 6).alias("ra"), F.round("p.y", 6).alias("dec"))


@query("""WITH s AS (SELECT s_suppkey, (s_suppkey % 50)::DOUBLE AS x, (s_suppkey % 30)::DOUBLE AS y, 2.0 + s_suppkey % 5 AS r1, 1.0 + s_suppkey % 2 AS r2, radians(s_suppkey % 90) AS t FROM supplier),
c AS (SELECT s_suppkey, r1, r2, 50 + (x + 1 - 10) * -0.01 AS ra, 5 + (y + 1 - 20) * 0.01 AS dec, 50 + (x + r1 * cos(t) + 1 - 10) * -0.01 AS ra1, 5 + (y + r1 * sin(t) + 1 - 20) * 0.01 AS dec1 FROM s)
SELECT s_suppkey, round(degrees(2 * asin(sqrt(power(sin(radians(dec1 - dec) / 2), 2) + cos(radians(dec)) * cos(radians(dec1)) * power(sin(radians(ra1 - ra) / 2), 2)))) * 3600, 3) AS major,
  round(90 - degrees(atan2(sin(radians(ra1 - ra)) * cos(radians(dec1)), cos(radians(dec)) * sin(radians(dec1)) - sin(radians(dec)) * cos(radians(dec1)) * cos(radians(ra1 - ra)))), 3) AS theta, round(r1 * 36, 3) AS simple FROM c""")
def ellipse_on_sky(spark, sf_dir):
    k = F.col("s_suppkey")
    e = F.struct((k % 50).cast("double").alias("x"), (k % 30).cast("double").alias("y"), (2.0 + k % 5).alias("r1"), (1.0 + k % 2).alias("r2"), (k % 90).cast("double").alias("theta"))
    head = [F.lit(v) for _, v in _HEAD]
    d = table(spark, sf_dir, "supplier").select("s_suppkey", wcs.ellipse_to_sky(e, *head, projection="CAR").alias("e"), wcs.ellipse_to_sky_simple(e, *head, projection="CAR").alias("s"))
    return rounded(d.select("s_suppkey", (F.col("e.r1") * 3600).alias("major"), F.col("e.theta").alias("theta"), (F.col("s.r1") * 3600).alias("simple")), 3)


@query("""WITH c AS (SELECT c_custkey, (c_custkey * 7919 % 36000) / 100.0 AS ra, (c_custkey * 104729 % 18000) / 100.0 - 90.0 AS dec FROM customer), t AS (SELECT *, (round(ra * 240000)::BIGINT) % 86400000 AS h, round(abs(dec) * 360000)::BIGINT AS d FROM c)
SELECT c_custkey, lpad((h // 3600000)::VARCHAR, 2, '0') || ':' || lpad((h // 60000 % 60)::VARCHAR, 2, '0') || ':' || lpad((h // 1000 % 60)::VARCHAR, 2, '0') || '.' || lpad((h % 1000)::VARCHAR, 3, '0') || CASE WHEN dec < 0 THEN ' -' ELSE ' +' END
  || lpad((d // 360000)::VARCHAR, 2, '0') || ':' || lpad((d // 6000 % 60)::VARCHAR, 2, '0') || ':' || lpad((d // 100 % 60)::VARCHAR, 2, '0') || '.' || lpad((d % 100)::VARCHAR, 2, '0') || ' FK5' AS sky FROM t""")
def sky_strings(spark, sf_dir):
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select("c_custkey", wcs.sky_string((k * 7919 % 36000) / 100.0, (k * 104729 % 18000) / 100.0 - 90.0).alias("sky"))


@query("""WITH p AS (SELECT p_partkey, (p_partkey % 21 - 10)::DOUBLE AS x, (p_partkey // 21 % 21 - 10)::DOUBLE AS y FROM part), d AS (SELECT *, sqrt(x * x + y * y) AS r FROM p)
SELECT p_partkey, CASE WHEN r <= 5 THEN 2.0 ELSE 0.0 END AS disk, CASE WHEN r >= 4 AND r <= 6 THEN 2.0 ELSE 0.0 END AS ring, CASE WHEN r < 4 THEN 0.5 WHEN r <= 6 THEN 2.0 ELSE 0.0 END AS bubble,
  CASE WHEN power((x * cos(radians(30)) + y * sin(radians(30))) / 8, 2) + power((y * cos(radians(30)) - x * sin(radians(30))) / 3, 2) <= 1 THEN 2.0 ELSE 0.0 END AS ellipse,
  round(2 * exp(-(8 - 1.0 / 3 + 4.0 / 1620 + 46.0 / 408240) * (pow(r / 4, 0.25) - 1)), 5) AS sersic FROM d""")
def extended_models(spark, sf_dir):
    k = F.col("p_partkey")
    x, y = (k % 21 - 10).cast("double"), (F.floor(k / 21) % 21 - 10).cast("double")
    d = table(spark, sf_dir, "part").select("p_partkey", x.alias("x"), y.alias("y"), F.sqrt(x * x + y * y).alias("r"))
    two, lit = F.lit(2.0), F.lit
    return rounded(d.select(
        "p_partkey", skymodels.disk(F.col("r"), two, lit(5.0)).alias("disk"), skymodels.ring(F.col("r"), two, lit(4.0), lit(2.0)).alias("ring"), skymodels.bubble(F.col("r"), two, lit(4.0), lit(2.0), 0.25).alias("bubble"),
        skymodels.elliptical_disk(F.col("x"), F.col("y"), two, lit(8.0), lit(3.0), lit(30.0)).alias("ellipse"), skymodels.sersic(F.col("r"), two, lit(4.0), 4.0).alias("sersic"),
    ))


@query("""SELECT s_suppkey, 'ellipse(' || printf('%.6f', s_suppkey % 360 + 0.5) || ',' || printf('%.6f', s_suppkey % 80 - 40.25) || ',0.010000,0.005000,30.00) # color=' || CASE s_suppkey % 6 WHEN 3 THEN 'green' WHEN 4 THEN 'magenta' WHEN 2 THEN 'red' WHEN 1 THEN 'blue' WHEN 5 THEN 'yellow' ELSE 'white' END || ' text={' || s_name || '}' AS value FROM supplier""")
def coloured_regions(spark, sf_dir):
    k = F.col("s_suppkey")
    empty = {c: F.lit(None).cast("double") for c in ("r", "w", "h")}
    d = table(spark, sf_dir, "supplier").withColumns({"shape": F.lit("ellipse"), "cx": k % 360 + 0.5, "cy": k % 80 - 40.25, "a": F.lit(0.01), "b": F.lit(0.005), "theta": F.lit(30.0), "name": F.col("s_name"), "color": associate.region_colour((k % 6).cast("int")), "verts": F.lit(None).cast("array<struct<x:double,y:double>>"), "tags": F.lit(None).cast("array<string>"), **empty})
    return catalogs.region_lines(d, keep=["s_suppkey"])
