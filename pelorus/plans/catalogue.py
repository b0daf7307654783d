"""Queries of the engine's own operators over the driver's tables, with the SQL they are checked against.

The tables hold no images, so a raster is made of lineitem: the part and supplier keys folded to a 64 x 64 grid,
one image for each return flag, a pixel being the sum of quantities. Every row contributes.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from pelorus.functions import stats
from pelorus.plans import associationqueries, cutqueries, imagequeries, linkqueries, measurequeries, scalarqueries, sourcequeries
from pelorus.plans.runtime import table

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    """Register a query, with its SQL if SQL can express it."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def lineitem(spark, sf_dir):
    return table(spark, sf_dir, "lineitem")


def rounded(df, digits=4):
    """Doubles rounded, so that the order of summation doesn't show."""
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


@query("""
WITH m AS (SELECT l_returnflag AS image_id, l_extendedprice AS v FROM lineitem),
c AS (SELECT image_id, avg(v) AS mu FROM m GROUP BY 1)
SELECT m.image_id, count(*) AS n, round(avg(v), 4) AS mean, round(stddev_samp(v), 4) AS rms,
 round(avg(power(v - mu, 3)) / power(avg(power(v - mu, 2)), 1.5), 4) AS skewness, round(avg(power(v - mu, 4)) / power(avg(power(v - mu, 2)), 2) - 3, 4) AS kurtosis,
 round(min(v), 4) AS min, round(max(v), 4) AS max FROM m JOIN c USING (image_id) GROUP BY 1""")
def stats_moments(spark, sf_dir):
    d = lineitem(spark, sf_dir).select(F.col("l_returnflag").alias("image_id"), F.col("l_extendedprice").alias("v"))
    return rounded(stats.moments(d, ["image_id"], "v"))


@query("""
WITH m AS (SELECT l_returnflag AS image_id, l_quantity AS v FROM lineitem), c AS (SELECT image_id, avg(v) AS mu FROM m GROUP BY 1)
SELECT m.image_id, count(*) AS n, round(avg(v), 4) AS mean, round(sum(power(v - mu, 2)) / count(*), 4) AS var, round(sum(power(v - mu, 3)) / count(*), 2) AS c3, round(sum(power(v - mu, 4)) / count(*), 2) AS c4
FROM m JOIN c USING (image_id) GROUP BY 1""")
def moments_merge(spark, sf_dir):
    d = lineitem(spark, sf_dir).select(F.col("l_returnflag").alias("image_id"), F.pmod("l_orderkey", F.lit(16)).alias("part"), F.col("l_quantity").alias("v"))
    m = stats.merge_moments(stats.partial_moments(d, ["image_id", "part"], "v"), ["image_id"])
    return m.select("image_id", "n", F.round("mean", 4).alias("mean"), F.round(F.col("m2") / F.col("n"), 4).alias("var"), F.round(F.col("m3") / F.col("n"), 2).alias("c3"), F.round(F.col("m4") / F.col("n"), 2).alias("c4"))


_REF = """CASE WHEN (len({0}) // 2) % 2 = 0 AND len({0}) // 2 > 0 THEN ({0}[len({0}) // 2 + 1] + {0}[len({0}) // 2]) / 2 ELSE {0}[len({0}) // 2 + 1] END"""


@query(f"""
WITH g AS (SELECT l_linestatus AS image_id, list_sort(list(l_extendedprice)) AS a FROM lineitem GROUP BY 1)
SELECT image_id, CAST(len(a) AS BIGINT) AS n, round({_REF.format("a")}, 4) AS median FROM g""")
def median_ref(spark, sf_dir):
    return rounded(stats.medians(lineitem(spark, sf_dir).withColumnRenamed("l_linestatus", "image_id"), ["image_id"], "l_extendedprice", compat=True))


@query("""
WITH m AS (SELECT l_linestatus AS image_id, median(l_extendedprice) AS med FROM lineitem GROUP BY 1)
SELECT image_id, count(*) AS n, round(med, 4) AS median, round(median(abs(l_extendedprice - med)), 4) AS mad, round(median(abs(l_extendedprice - med)) * 1.4826, 4) AS rms
FROM lineitem JOIN m ON l_linestatus = image_id GROUP BY 1, med""")
def mad_rms(spark, sf_dir):
    d = stats.mad(lineitem(spark, sf_dir).withColumnRenamed("l_linestatus", "image_id"), ["image_id"], "l_extendedprice")
    return rounded(d.withColumn("rms", F.col("mad") * stats.MAD_TO_RMS))


def _clip_sql(rounds: int) -> str:
    out = "WITH x AS (SELECT l_returnflag AS k, l_quantity * l_quantity * l_extendedprice AS v FROM lineitem), s0 AS (SELECT k, avg(v) AS mean, stddev_samp(v) AS rms, median(v) AS med, FALSE AS done FROM x GROUP BY k)"
    for i in range(rounds):
        out += f""", n{i} AS (SELECT x.k, avg(v) AS mean, stddev_samp(v) AS rms, median(v) AS med FROM x JOIN s{i} s ON x.k = s.k WHERE NOT s.done AND abs(v - s.med) < 1.5 * s.rms GROUP BY x.k),
s{i + 1} AS (SELECT s.k, coalesce(n.mean, s.mean) AS mean, coalesce(n.rms, s.rms) AS rms, coalesce(n.med, s.med) AS med, s.done OR n.k IS NULL OR abs(n.rms / s.rms - 1) <= 0.1 AS done FROM s{i} s LEFT JOIN n{i} n ON n.k = s.k)"""
    return out + f" SELECT k AS image_id, round(mean, 4) AS mean, round(rms, 4) AS rms, round(med, 4) AS median FROM s{rounds}"


@query(_clip_sql(5))
def sigma_clip(spark, sf_dir):
    d = lineitem(spark, sf_dir).select(F.col("l_returnflag").alias("image_id"), (F.col("l_quantity") * F.col("l_quantity") * F.col("l_extendedprice")).alias("v"))
    return rounded(stats.clipped(d, ["image_id"], "v", k=1.5, iterations=5))


def _biweight_sql(rounds: int) -> str:
    out = "WITH x AS (SELECT c_mktsegment AS k, c_acctbal AS v FROM customer), m AS (SELECT k, median(v) AS med FROM x GROUP BY k), s0 AS (SELECT x.k, med AS loc, median(abs(v - med)) * 1.4826 AS sc, FALSE AS done FROM x JOIN m ON x.k = m.k GROUP BY x.k, med)"
    for i in range(rounds):
        out += f""", t{i} AS (SELECT x.k, loc, sc, done, v, power((v - loc) / (6 * sc), 2) AS u FROM x JOIN s{i} s ON x.k = s.k),
a{i} AS (SELECT k, loc, sc, done, sum(CASE WHEN u <= 1 THEN power(1 - u, 2) * v END) / sum(CASE WHEN u <= 1 THEN power(1 - u, 2) END) AS nl, count(*) AS n, sum(CASE WHEN u <= 1 THEN power(v - loc, 2) * power(1 - u, 4) END) AS num, abs(sum(CASE WHEN u <= 1 THEN (1 - u) * (1 - 5 * u) END)) AS den FROM t{i} GROUP BY k, loc, sc, done),
s{i + 1} AS (SELECT k, CASE WHEN done THEN loc ELSE nl END AS loc, CASE WHEN done OR abs(nl / loc - 1) < 1e-4 OR den <= 1 THEN sc ELSE sqrt(n * num) / den END AS sc, done OR abs(nl / loc - 1) < 1e-4 AS done FROM a{i})"""
    return out + f" SELECT k AS image_id, round(loc, 3) AS location, round(sc, 3) AS scale FROM s{rounds}"


@query(_biweight_sql(4))
def biweight(spark, sf_dir):
    return rounded(stats.biweight(table(spark, sf_dir, "customer").withColumnRenamed("c_mktsegment", "image_id"), ["image_id"], "c_acctbal", iterations=4), 3)


@query("""SELECT o_orderpriority AS image_id, count(*) AS n, round(quantile_cont(o_totalprice, 0.25), 4) AS q1, round(quantile_cont(o_totalprice, 0.5), 4) AS median, round(quantile_cont(o_totalprice, 0.75), 4) AS q3,
 round(min(o_totalprice), 4) AS min, round(max(o_totalprice), 4) AS max FROM orders GROUP BY 1""")
def box_stats(spark, sf_dir):
    return rounded(stats.box_stats(table(spark, sf_dir, "orders").withColumnRenamed("o_orderpriority", "image_id"), ["image_id"], "o_totalprice"))


def _tukey_sql(rounds: int) -> str:
    out = "WITH x0 AS (SELECT event_type AS k, value AS v FROM events WHERE value IS NOT NULL)"
    for i in range(rounds):
        out += f", q{i} AS (SELECT k, quantile_cont(v, 0.25) AS a, quantile_cont(v, 0.75) AS b FROM x{i} GROUP BY k), x{i + 1} AS (SELECT x.k, v FROM x{i} x JOIN q{i} q ON x.k = q.k WHERE v BETWEEN a - 0.5 * (b - a) AND b + 0.5 * (b - a))"
    return out + f" SELECT k AS event_type, count(*) AS n, round(sum(v), 3) AS total FROM x{rounds} GROUP BY k"


@query(_tukey_sql(3))
def tukey_outliers(spark, sf_dir):
    d = stats.remove_outliers(table(spark, sf_dir, "events").select("event_type", "value"), ["event_type"], "value", 0.5, 3)
    return d.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 3).alias("total"))


@query("""WITH c AS (SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY 1, 2), t AS (SELECT p_brand, max(n) AS m FROM c GROUP BY 1)
SELECT p_brand, min(p_size) AS mode, count(*) AS n_modes FROM c JOIN t USING (p_brand) WHERE n = m GROUP BY 1""")
def value_mode(spark, sf_dir):
    return stats.mode(table(spark, sf_dir, "part"), ["p_brand"], "p_size")


_HIST = """WITH x AS (SELECT value AS v FROM events WHERE value IS NOT NULL AND value <> 0), e AS (SELECT min(v) AS lo, max(v) AS hi FROM x),
h AS (SELECT CAST(floor((v - lo) / (hi - lo) * 40) AS INTEGER) AS bin, lo, hi, count(*) AS count FROM x, e WHERE v < hi GROUP BY 1, 2, 3)"""


@query(_HIST + " SELECT bin, count FROM h")
def histogram(spark, sf_dir):
    return stats.histogram(table(spark, sf_dir, "events"), "value", 40).select("bin", "count")


@query(_HIST + """, p AS (SELECT bin, lo, hi, count / sum(count) OVER () AS p, lo + (bin + 0.5) * (hi - lo) / 40 AS x FROM h),
c AS (SELECT *, sum(p) OVER (ORDER BY bin) AS wb, sum(p * x) OVER (ORDER BY bin) AS sb, sum(p * x) OVER () AS s FROM p),
b AS (SELECT lo + (bin + 1) * (hi - lo) / 40 AS edge, bin, wb * (1 - wb) * power(sb / wb - (s - sb) / (1 - wb), 2) AS q FROM c WHERE 1 - wb > 1e-12)
SELECT round(edge, 4) AS threshold FROM b ORDER BY round(q, 6) DESC, bin LIMIT 1""")
def otsu(spark, sf_dir):
    return rounded(stats.otsu(stats.histogram(table(spark, sf_dir, "events"), "value", 40), 40))


@query("""WITH s AS (SELECT o_orderstatus AS image_id, o_totalprice AS v, sum(o_totalprice) AS s FROM orders GROUP BY 1, 2),
r AS (SELECT *, sum(s) OVER (PARTITION BY image_id ORDER BY v) AS run, sum(s) OVER (PARTITION BY image_id) AS total FROM s)
SELECT image_id, round(min(v), 4) AS threshold FROM r WHERE run >= 0.6 * total GROUP BY 1""")
def cumsum_threshold(spark, sf_dir):
    return rounded(stats.cumulative_threshold(table(spark, sf_dir, "orders").withColumnRenamed("o_orderstatus", "image_id"), ["image_id"], "o_totalprice", 0.6).withColumn("threshold", F.col("threshold").cast("double")))


@query()
def bootstrap_error(spark, sf_dir):
    return stats.bootstrap(table(spark, sf_dir, "customer"), ["c_mktsegment"], "c_acctbal", 50)


for _module in (associationqueries, cutqueries, imagequeries, linkqueries, measurequeries, scalarqueries, sourcequeries):
    QUERIES.update(_module.QUERIES)
    SQL.update(_module.SQL)
