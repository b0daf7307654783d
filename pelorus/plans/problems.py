"""Queries of the general training-data problems: proximity, units, nested records, malformed rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from pelorus.operators import harmonise, malformed, nested, proximity
from pelorus.plans.runtime import table


def p1_found(spark, sf_dir):
    return proximity.near_and_inside(table(spark, sf_dir, "skyobjects"), table(spark, sf_dir, "skyregions"))


def p2_found(spark, sf_dir):
    return harmonise.harmonised_integers(table(spark, sf_dir, "imgmeta"))


def p6_found(spark, sf_dir):
    return nested.node_table(table(spark, sf_dir, "taskcollections"))


def p6_components(spark, sf_dir):
    d = nested.flat_tables(table(spark, sf_dir, "taskcollections"))["component"]
    return d.withColumn("selected", F.col("selected").cast("string"))


def p7_found(spark, sf_dir):
    return malformed.split_rows(table(spark, sf_dir, "selavyraw"))[1].select("line_id", "reason")


def p7_loaded(spark, sf_dir):
    return malformed.load_selavy(table(spark, sf_dir, "selavyraw"))[0].select("line_id", "component_name", "ra_deg_cont", "dec_deg_cont")


QUERIES = {f.__name__: f for f in (p1_found, p2_found, p6_found, p6_components, p7_found, p7_loaded)}

_SEPARATION = "degrees(2 * asin(least(1.0, sqrt(power(sin(radians({d2} - {d1}) / 2), 2) + cos(radians({d1})) * cos(radians({d2})) * power(sin(radians({r2} - {r1}) / 2), 2))))) * 3600"
_FOLD = "((({0} + 180) % 360) + 360) % 360 - 180"

SQL = {
    "p1_found": f"""
WITH o AS (SELECT obj_id, ((ra % 360.0) + 360.0) % 360.0 AS ra, dec,
  sqrt(power(CASE WHEN ra_err IS NULL OR isnan(ra_err) OR ra_err < 0 THEN 1 ELSE ra_err END, 2) + power(CASE WHEN dec_err IS NULL OR isnan(dec_err) OR dec_err < 0 THEN 1 ELSE dec_err END, 2)) AS e
  FROM skyobjects WHERE ra IS NOT NULL AND dec IS NOT NULL AND NOT isnan(ra) AND NOT isnan(dec) AND ra <> -999 AND dec <> -999 AND abs(dec) <= 90),
near AS (SELECT 'near' AS kind, a.obj_id AS id_1, b.obj_id AS id_2 FROM o a JOIN o b ON a.obj_id < b.obj_id
  WHERE {_SEPARATION.format(d1="a.dec", d2="b.dec", r1="a.ra", r2="b.ra")} <= 3 * sqrt(a.e * a.e + b.e * b.e)),
circ AS (SELECT obj_id, region_id FROM o JOIN skyregions r ON r.shape = 'circle' AND r.r IS NOT NULL
  WHERE {_SEPARATION.format(d1="dec", d2="cy", r1="ra", r2="cx")} <= r.r),
box AS (SELECT obj_id, region_id FROM o JOIN skyregions r ON r.shape = 'box'
  WHERE abs(dec - cy) <= h / 2 AND abs({_FOLD.format("ra - cx")}) <= w / 2),
v AS (SELECT region_id, unnest(range(len(verts))) AS k, verts FROM skyregions WHERE shape = 'polygon' AND len(verts) >= 3),
steps AS (SELECT region_id, k, verts[k + 1].y AS y, CASE WHEN k = 0 THEN verts[1].x ELSE {_FOLD.format("verts[k + 1].x - verts[k].x")} END AS d FROM v),
un AS (SELECT region_id, k, y, sum(d) OVER (PARTITION BY region_id ORDER BY k) AS x FROM steps),
sizes AS (SELECT region_id, count(*) AS n FROM un GROUP BY region_id),
side AS (SELECT a.region_id, a.x AS x1, a.y AS y1, a.x + ({_FOLD.format("b.x - a.x")}) AS x2, b.y AS y2 FROM un a JOIN sizes s ON s.region_id = a.region_id JOIN un b ON a.region_id = b.region_id AND b.k = (a.k + 1) % s.n),
ext AS (SELECT region_id, (min(x) + max(x)) / 2 AS mid, min(y) AS ya, max(y) AS yb FROM un GROUP BY region_id),
cand AS (SELECT obj_id, region_id, mid + ({_FOLD.format("ra - mid")}) AS x, dec AS y FROM o JOIN ext ON dec BETWEEN ya AND yb),
poly AS (SELECT obj_id, cand.region_id FROM cand JOIN side USING (region_id) WHERE (y1 > y) <> (y2 > y) AND x < (x2 - x1) * (y - y1) / (y2 - y1) + x1 GROUP BY obj_id, cand.region_id HAVING count(*) % 2 = 1)
SELECT kind, id_1, id_2 FROM near UNION ALL SELECT 'inside', obj_id, region_id FROM circ UNION ALL SELECT 'inside', obj_id, region_id FROM box UNION ALL SELECT 'inside', obj_id, region_id FROM poly
""",
    "p7_found": r"""
WITH r AS (SELECT line_id, raw_line FROM selavyraw WHERE raw_line IS NOT NULL AND NOT regexp_matches(raw_line, '^[ \t]*($|[#*/])')),
t AS (SELECT line_id, regexp_full_match(raw_line, '[ \t]*(("([^"]|"")*"|[^ \t"]+)([ \t]+|$))*') AS ok, regexp_extract_all(raw_line, '"(?:[^"]|"")*"|[^ \t"]+') AS f FROM r),
v AS (SELECT line_id, ok, len(f) AS n, list_transform([f[3], f[6], f[7]], lambda x: CASE WHEN starts_with(x, '"') THEN replace(substr(x, 2, len(x) - 2), '""', '"') ELSE x END) AS c FROM t),
n AS (SELECT *, list_transform(c, lambda x: CASE WHEN regexp_full_match(x, '[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?') THEN TRY_CAST(x AS DOUBLE) END) AS d FROM v),
e AS (SELECT line_id, CASE WHEN NOT ok THEN 'quoting' WHEN n <> 37 THEN 'columns' WHEN trim(c[1], ' ' || chr(9)) = '' THEN 'component_name'
 WHEN d[2] IS NULL OR NOT (d[2] >= 0 AND d[2] < 360) THEN 'ra_deg_cont' WHEN d[3] IS NULL OR NOT (d[3] BETWEEN -90 AND 90) THEN 'dec_deg_cont' END AS reason FROM n)
SELECT line_id, reason FROM e WHERE reason IS NOT NULL
""",
}


def _items(value: str) -> str:
    """The elements of a JSON value: of an array its own, of an object itself, else none."""
    return f"CASE json_type({value}) WHEN 'ARRAY' THEN json_extract({value}, '$[*]') WHEN 'OBJECT' THEN [{value}] ELSE [] END"


def _level(source: str, kind: str, value: str, field: str) -> str:
    """Object elements of a field of each node of a table (coll_id, path, node)."""
    return f"""SELECT coll_id, {kind} AS kind, path || '{field}[' || i || ']' AS path, path AS parent, v AS node FROM (
  SELECT coll_id, path, unnest({_items(value)}) AS v, unnest(range(len({_items(value)}))) AS i FROM {source}) WHERE json_type(v) = 'OBJECT'"""


_NODES = f"""WITH RECURSIVE root AS (SELECT coll_id, '' AS path, payload::JSON AS node FROM (SELECT * FROM taskcollections WHERE json_valid(payload))),
task AS ({_level("root", "'task'", "(node->'tasks')", "tasks")}),
src AS ({_level("task", "'source'", "(node->'sources')", ".sources")} UNION ALL {_level("task", "'ext_source'", "(node->'ext_sources')", ".ext_sources")}),
deep AS (SELECT * FROM src UNION ALL {_level("deep", "'nested'", "(node->'m_NestedSources')", ".m_NestedSources")}),
comp AS ({_level("deep", "'component'", "(node->'m_fitPars'->'pars')", ".m_fitPars.pars")})"""
SQL["p6_found"] = f"""{_NODES} SELECT coll_id, kind, path AS node_path, parent AS parent_path FROM (SELECT * FROM task UNION ALL SELECT * FROM deep UNION ALL SELECT * FROM comp)"""
SQL["p7_loaded"] = SQL["p7_found"].replace("SELECT line_id, CASE WHEN NOT ok", "SELECT line_id, c, d, CASE WHEN NOT ok").replace("SELECT line_id, reason FROM e WHERE reason IS NOT NULL", "SELECT line_id, c[1] AS component_name, d[2] AS ra_deg_cont, d[3] AS dec_deg_cont FROM e WHERE reason IS NULL")
SQL["p6_components"] = f"""{_NODES} SELECT coll_id, path AS node_path, parent AS parent_path, TRY_CAST(node->>'m_bmaj' AS DOUBLE) AS bmaj, TRY_CAST(node->>'m_bmin' AS DOUBLE) AS bmin, CAST(TRY_CAST(node->>'m_selected' AS BOOLEAN) AS VARCHAR) AS selected FROM comp"""
